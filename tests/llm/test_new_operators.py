"""Token-ID files, phrase collocations and spelling variants against plain Python."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import table
from tracklens.llm import id_files, phrases, rans, spelling
from tracklens.llm.common import Workspace
from tracklens.llm.skew import join_unique
from tracklens.llm.tokens import tokenizer_path
from tracklens.llm.words import WordEncoder

LANGS = "doc_id bigint, text string, lang string, source string, n_chars bigint, word string, n bigint"


def with_clashes(spark, rows):
    """Rows ``(doc_id, text, lang)`` with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "s", 1, "word", 7) for i, t, g in rows], LANGS)


# --- token-ID files ---------------------------------------------------------------------------------------------------


def library_rows(rows, path):
    from tokenizers import Tokenizer

    library, at, out = Tokenizer.from_file(path), 0, []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_codec_round_trip_from_every_checkpoint():
    rng = np.random.default_rng(3)
    for n, top in ((0, 2), (1, 1), (5, 1), (1025, 3), (30_000, 40_000), (70_001, 500)):
        ids = (rng.zipf(1.2, n) % top).astype(np.uint32)
        counts = collections.Counter(ids.tolist())
        table_ = rans.FrequencyTable.from_bytes(rans.FrequencyTable(rans.quantised(counts)).to_bytes())
        assert not n or table_.freq.sum() == 1 << rans.TABLE_BITS
        data = rans.encode_block(ids, table_, segment=8192)
        block = rans.Block.parse(data)
        # segments in any order, each alone
        parts = {k: rans.decode_segment(data, block, k, table_) for k in reversed(range(len(block.states)))}
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *(parts[k] for k in sorted(parts))]), ids)


def test_codec_tells_of_damage():
    ids = np.arange(5000, dtype=np.uint32) % 700
    table_ = rans.FrequencyTable(rans.quantised(collections.Counter(ids.tolist())))
    data = rans.encode_block(ids, table_)
    for at in (30, len(data) - 9):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(rans.CorruptFile):
            block = rans.Block.parse(bytes(broken))
            rans.decode_segment(bytes(broken), block, 0, table_)
    with pytest.raises(ValueError):
        rans.encode_block(np.array([900], np.uint32), table_)


def test_words_have_the_librarys_ids():
    enc = WordEncoder(tokenizer_path(id_files.TOKENIZER_FILE))
    assert enc.ranked is not None
    rng, letters = random.Random(5), "aäßÉ'st 1²,.\n\t_-\x85 \x00\x1fǅ́ΣσαĲ漢"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) + rng.choice([""] * 9 + ["<|endoftext|>x"]) for _ in range(2000)]
    texts += [chr(c) for c in range(1, 0x3000)] + [t.replace("</w>", "") for t in enc.library.get_vocab()] + ["ab" * 5000, ""]
    got = [i.tolist() for at in range(0, len(texts), 64) for i in enc.batch_ids(texts[at : at + 64])]
    assert got == [e.ids for e in enc.library.encode_batch_fast(texts, add_special_tokens=False)]


def test_a_word_is_looked_up_once_a_batch():
    enc, asked = WordEncoder(tokenizer_path(id_files.TOKENIZER_FILE)), []

    class Seen(type(enc.numbers)):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    enc.numbers = Seen(enc.numbers)
    assert [len(i) for i in enc.batch_ids(["to be or not to be " * 100, "", "be to"])] == [600, 0, 2]
    assert sorted(w for w in asked if w.isalpha()) == ["be", "not", "or", "to"]


def test_texts_go_together_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(id_files, "TEXTS", 3)
    monkeypatch.setattr(id_files, "TEXT_BYTES", 10)
    sizes = [0, 1, 2, 3, 50, 4, 6, 1, 0, 0, 0, 11, 9]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes])], names=["text"])
    got = [[len(t) for t in some.column(0).to_pylist()] for some in id_files._together(batch, 0)]
    assert [n for some in got for n in some] == sizes
    assert all(len(some) <= 3 and (sum(some) <= 10 or len(some) == 1) for some in got)


def test_token_id_files_of_awkward_rows(spark, tmp_path):
    path = tokenizer_path(id_files.TOKENIZER_FILE)
    rows = [(7, "Hello, wide World"), (3, None), (None, "no key"), (3, ""), (9, "<|endoftext|> inside"), (8, "long " * 40_000), (7, "Hello, wide World"), (1, "x")]
    got = id_files.token_id_rows(with_clashes(spark, [(i, t, None) for i, t in rows])).collect()
    expected = library_rows(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""))), path)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert id_files.token_id_rows(table(spark, [])).collect() == []


def test_token_id_files_cross_blocks_and_tasks(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"file://{tmp_path}/ids"
    for name, value in (("BLOCK_IDS", 4096), ("SEGMENT_IDS", 1024)):
        monkeypatch.setattr(rans, name, value)
    monkeypatch.setattr(id_files, "TASK_IDS", 1024)
    fs, inner = id_files._store(folder)
    fs.create_dir(inner)
    rows = [(k, (np.arange(n, dtype=np.uint32) * 7 + k) % 900) for k, n in enumerate([1, 3000, 5, 20_000, 1, 1, 4096, 77])]
    counts = collections.Counter(itertools.chain.from_iterable(i.tolist() for _, i in rows))
    id_files._write(fs, f"{inner}/_table.bin", rans.FrequencyTable(rans.quantised(counts)).to_bytes())
    import pyarrow as pa

    schema = spark.createDataFrame([], "part int, row bigint, key bigint, ids binary").schema
    batch = lambda some: pa.RecordBatch.from_arrays(
        [pa.array([p for p, _, _ in some], pa.int32()), pa.array([r for _, r, _ in some]), pa.array([rows[k][0] for _, _, k in some]),
         pa.array([id_files.packed(rows[k][1]) for _, _, k in some])], names=["part", "row", "key", "ids"])
    writer = id_files.IdWriter(schema, folder)
    # parts come out of order and broken up; a task's files of a first try are never read
    lost = writer.write(iter([batch([(0, 0, 0)])]))
    later = writer.write(iter([batch([(1, 0, 4), (1, 1, 5)]), batch([(0, 2, 2), (0, 3, 3)])]))
    first = writer.write(iter([batch([(0, 0, 0), (0, 1, 1)]), batch([(1, 2, 6), (1, 3, 7)])]))
    writer.commit([later, first, None])
    assert lost.files[0]["name"] not in (tmp_path / "ids" / "_manifest.json").read_text()
    reader = id_files.IdReader(folder)
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    starts = np.cumsum([0, *(len(i) for _, i in rows)])
    assert [(r["key"], r["start"], r["n_ids"]) for r in found] == [(k, starts[k], len(i)) for k, i in rows]
    assert all(r["ids"] == i.astype("<u4").tobytes() for r, (_, i) in zip(found, rows))
    writer.abort([later, first])
    assert not list((tmp_path / "ids").glob(later.files[0]["name"]))
    monkeypatch.undo()
    got = sorted(map(tuple, id_files.token_id_rows(docs).collect()), key=lambda r: r[1])
    assert got == library_rows(sorted((r.doc_id, r.text) for r in docs.collect()), tokenizer_path(id_files.TOKENIZER_FILE))


# --- phrase collocations ----------------------------------------------------------------------------------------------


def brute_collocations(rows, min_count=10, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in candidates.items():
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def invented(n, seed):
    rng = random.Random(seed)
    words = ["red", "Blue", "sky", "sea", "été", "a b", "salt", "in", "the", "x"]
    return [(None if i % 7 == 0 else i, " ".join(rng.choice(words[: 3 + i % 8]) + rng.choice(["", "", "", ".", ",\n", "\t"]) for _ in range(rng.randrange(30))),
             rng.choice(["en", "de", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_collocations_whatever_the_sample(spark, share):
    """Without a sample every phrase is a failure of the border; with all of it none is."""
    rows = invented(120, 4) + [(1, None, "en"), (2, "", None), (3, "only", "fr"), (4, "deep sea " * 3000, "fr")] + [(5, "again and again", "de")] * 12
    got = phrases.collocations(with_clashes(spark, rows).repartition(5), share=share)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows)


def test_collocations_ties_and_limit(spark, monkeypatch):
    rows = [(i, "b a. d c. f e", "en") for i in range(10)]
    got = phrases.collocations(with_clashes(spark, rows), top=2)
    assert [(r["rank"], r.phrase, r.score) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [(1, "b a", 1_000_000), (2, "d c", 1_000_000)]
    monkeypatch.setattr(phrases, "HELD_BYTES", 50)
    monkeypatch.setattr(phrases, "SLICE", 3)
    rows = invented(60, 9)
    assert sorted(map(tuple, phrases.collocations(with_clashes(spark, rows), share=0.3).collect())) == brute_collocations(rows)
    assert phrases.collocations(with_clashes(spark, [])).collect() == []


def test_a_task_holds_few_texts_and_gives_memory_back(monkeypatch):
    released, seen = [], []
    monkeypatch.setattr(phrases, "release_memory", lambda: released.append(len(seen)), raising=False)
    docs = type("Docs", (), {"mapInArrow": lambda self, run, schema: run})()
    run = phrases._by_task(docs, "", lambda lang, words: seen.append(words.n_words()) or iter(()))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 700), pa.array(["a" * 9 + " b" * 10_000] * 700)], names=["lang", "text"])
    assert list(run(iter([batch]))) == []
    assert sum(seen) == 700 * 10_001 and max(seen) * 2 < 4_000_000 + 256 * 20_010
    assert released == [len(seen)]


def test_phrase_sets_hold_what_went_in(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(-(1 << 62), 1 << 62, 5000)
    held = phrases.phrase_set(spark.createDataFrame([(int(x),) for x in h], "h bigint"))
    assert held.has(h.view(np.uint64)).all()
    assert held.has(rng.integers(0, 1 << 62, 100_000).view(np.uint64)).mean() < 0.05


# --- spelling variants ------------------------------------------------------------------------------------------------


def brute_variants(rows, damaged=199):
    n = collections.Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def close(u, v):
        if len(u) == len(v):
            return sum(a != b for a, b in zip(u, v)) == 1
        u, v = sorted((u, v), key=len)
        return len(v) - len(u) == 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))

    near = {w: [v for v in n if close(w, v)] for w in n}
    form = {w: min(((-n[v], v) for v in near[w]), default=(0, None))[1] for w in n}
    form = {w: v if v and n[v] >= 5 * n[w] else None for w, v in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def misspelt(seed, many):
    rng, rows = random.Random(seed), []
    roots = ["between", "letters", "Ändern", "aaaaaa", "abcabcabc", "frontier", "frontiers", "x" * 60 + "tail", "y" * 300]
    for k in range(many):
        w = rng.choice(roots)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at, c = rng.randrange(len(w) + 1), rng.choice("abeé")
            w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
        rows.append((None if k % 5 == 0 else k, " ".join([w] * rng.choice([1, 3, 6, 30])) + "," + w[:4], None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_of_misspelt_words(spark, seed):
    rows = misspelt(seed, 400) + [(1, None, "en"), (2, "", None)] + [(9, "repeated rows", None)] * 6
    got = spelling.spelling_variants(with_clashes(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_variants(rows)
    assert spelling.spelling_variants(with_clashes(spark, [])).collect() == []


def test_chains_of_forms_end_at_their_root(spark):
    words = ["aaaaaaaa"[:-k] + "b" * k if k else "aaaaaaaa" for k in range(6)]
    rows = [(k, " ".join([w] * 5 * 6**k), None) for k, w in enumerate(words)]
    got = {r.word: r for r in spelling.spelling_variants(with_clashes(spark, rows), damaged=None).collect()}
    assert {got[w].root for w in words} == {words[-1]} and [got[w].form for w in words] == [*words[1:], None]


def test_a_third_of_the_words_below_one_node(spark, tmp_path):
    """The hot path of the frontier: one stem with many endings."""
    rng = random.Random(8)
    words = sorted({"pre" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(600)} | {"".join(rng.choice("xyz") for _ in range(7)) for _ in range(300)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    from tracklens.llm import skew

    small, skew.SMALL_ROWS = skew.SMALL_ROWS, 0
    share, skew.HOT_SHARE = skew.HOT_SHARE, 0.01
    try:
        pairs = spelling.near_words(frame, Workspace(spark, "test")).collect()
    finally:
        skew.SMALL_ROWS, skew.HOT_SHARE = small, share
    brute = sorted((u, v) for u in words for v in words if len(u) == len(v) and sum(a != b for a, b in zip(u, v)) == 1)
    assert sorted((r.word, r.near) for r in pairs) == brute


def test_hot_keys_join_as_others(spark, tmp_path, monkeypatch):
    from tracklens.llm import skew

    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id").union(
        spark.range(3).select(F.lit(None).cast("bigint"), "id")).write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    right = spark.range(0, 2000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert skew.hot_keys(left, ["k"]).count() == 1
    for how in ("inner", "left"):
        assert sorted(join_unique(left, right, ["k"], how).collect(), key=repr) == sorted(left.join(right, ["k"], how).collect(), key=repr)


# --- pages whose article no element names -----------------------------------------------------------------------------


PLAIN_PAGES = [
    ("<div>Deep text here in the page, a whole sentence of it.</div>", "Deep text here in the page, a whole sentence of it."),
    ("<div>" * 30 + "<p>A long sentence inside of thirty plain elements, without a name.</p>" + "</div>" * 30,
     "A long sentence inside of thirty plain elements, without a name."),
    ("<div>" * 30 + "A long sentence inside of thirty open elements, without any end.", "A long sentence inside of thirty open elements, without any end."),
    ("<p>First paragraph of the text.</p><form><p>Enter mail</p></form><p>Second paragraph of it.</p><div class='comment'>I disagree!</div>",
     "First paragraph of the text.\nSecond paragraph of it."),
    ("<article><p>One sentence of the article.</p><form><p>Enter mail</p><button>Go</button></form><p>Another one, a little longer.</p></article>",
     "One sentence of the article.\nAnother one, a little longer."),
    ("<nav><a href='/'>Home</a> <a href='/b'>Blog</a></nav><div><div>The only block of this page that is prose and not a menu.</div></div>",
     "The only block of this page that is prose and not a menu."),
]


@pytest.mark.parametrize("html,text", PLAIN_PAGES)
def test_articles_without_a_named_container(html, text):
    from tracklens.llm.html_extract import fit_block_field, main_text

    assert main_text(html, fit_block_field()) == text


def test_open_elements_cost_in_proportion():
    """Tags left open, ends of what is not open, and a name of its own for every element."""
    import time

    from tracklens.llm.html_extract import fit_block_field, main_text

    field = fit_block_field()
    for page in ("<div>x y " * 50_000, "<div>" * 50_000 + "</p>x" * 50_000, "".join(f"<div class='a{i}b{i}'>x" for i in range(30_000))):
        began = time.process_time()
        main_text(page, field)
        assert time.process_time() - began < 15
