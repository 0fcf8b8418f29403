"""Phrase collocations by Toivonen's method: a sample proposes, full passes count the proposals and their border exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.llm.common import Workspace, on_workers, release_memory
from tracklens.llm.skew import join_unique

MAX_WORDS = 3
MIN_COUNT = 10
#: A phrase goes when a longer candidate around it has this share of its occurrences.
SWALLOWED_PERCENT = 50
TOP = 2000
SAMPLE_SHARE = 0.25
#: Of the occurrences that the sample should hold of a phrase of ``MIN_COUNT``, the share that proposes it (rounded up, twice at least).
LOWERED = 0.9
#: Bytes of text that a task adds up before it passes counts on, unless a single text has more, and rows that it passes on at once.
HELD_BYTES = 4_000_000
SLICE = 50_000
#: Bits of a set of phrases: so many for each, within these powers of two.
BITS_EACH = 32
LOG_BITS = (15, 28)
#: Groups in which each language's best phrases are found first.
TOP_SALTS = 64
BATCH = 256
_BREAK = b"\xff"
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The hash of a phrase that is ``more`` (the hash of a word) longer than one with hash ``h``."""
    h = h * np.uint64(0x9E3779B97F4A7C15) + more
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


class PhraseSet:
    """Phrases of one length as bits of their hashes. It may hold more than was put in, never less; where it decides what is counted,
    that costs work and changes nothing. Its size is bounded, whatever was put in."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrase_set(hashes: DataFrame) -> PhraseSet:
    """The set of the column ``h``. Spark ors the bits; at most ``2 ** LOG_BITS[1] / 8`` bytes reach the driver."""
    n = max(1, hashes.count())
    log = min(max((n * BITS_EACH - 1).bit_length(), LOG_BITS[0]), LOG_BITS[1])
    at = F.col("h").bitwiseAND(F.lit((1 << log) - 1)) + 1
    rows = hashes.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    parts = rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << (log - 3), np.uint8)
    for bucket, bits in parts:
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return PhraseSet(out)


class _Held:
    """Texts of one task and language until they are counted."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.n = 0

    def add(self, text: str) -> None:
        self.texts.append(text.encode())
        self.n += len(self.texts[-1]) + 1


class _Words:
    """The words of held texts as numbers; 0 parts pieces. A-Z in lower case, pieces cut at the marks and line ends, words at blanks."""

    def __init__(self, lang: str, texts: list[bytes]):
        whole = b"\n".join([*texts, b""]).lower().translate(_CUTS).replace(b"\n", b" \xff ")
        offsets = pa.py_buffer(np.array([0, len(whole)], np.int64))
        one = pa.LargeStringArray.from_buffers(1, offsets, pa.py_buffer(whole))
        coded = pc.ascii_split_whitespace(one).flatten().dictionary_encode()
        spelled = coded.dictionary.cast(pa.large_binary()).to_pylist()
        # 0 stands for the break, -1 for the empty strings at both ends
        number = np.arange(1, len(spelled) + 1)
        for at, word in ((0, _BREAK), (-1, b"")):
            if word in spelled:
                number[spelled.index(word)] = at
        text = number[coded.indices.to_numpy()]
        self.text = text[text >= 0]
        self.vocab = [b"", *(b"" if n <= 0 else w for n, w in zip(number, spelled))]
        self.hash = _word_hashes(lang, self.vocab)

    def n_words(self) -> int:
        return int(np.count_nonzero(self.text))

    def grams(self, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """``size, places, hashes, follows`` of the phrases inside pieces: those of ``follows`` are the first parts, those behind them
        the last parts, of the phrases of the next size."""
        at = np.flatnonzero(self.text)
        hashes = self.hash[self.text[at]]
        for size in range(1, max_words + 1):
            follows = np.flatnonzero(at[1:] == at[:-1] + 1) if size < max_words else None
            yield size, at, hashes, follows
            if follows is not None:
                at = at[follows]
                hashes = _mixed(hashes[follows], self.hash[self.text[at + size]])

    def phrases(self, size: int, places: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases that begin at ``places``, and how often."""
        columns = self.text[places[:, None] + np.arange(size)].T
        code = columns[0]
        for c in columns[1:]:
            if len(code) and int(code.max() + 1) * len(self.vocab) >= 1 << 63:
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(self.vocab) + c
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        spelled = pa.array(self.vocab, pa.binary()).cast(pa.string())
        words = [spelled.take(pa.array(c[first])) for c in columns]
        return words[0] if size == 1 else pc.binary_join_element_wise(*words, " "), n


def _inside(parts: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which phrases have both parts inside."""
    return parts[follows] & parts[follows + 1]


def _fresh(passes: list[list[PhraseSet | None]], size: int, hashes: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which phrases, a word longer than ``size``, have both parts in the last pass's set and in no earlier one's."""
    *earlier, last = [_inside(np.ones(len(hashes), bool) if p[size - 1] is None else p[size - 1].has(hashes), follows) for p in passes]
    for known in earlier:
        last &= ~known
    return last


def _by_task(docs: DataFrame, schema: str, count) -> DataFrame:
    """What ``count`` makes of the words of a task's texts, held up to :data:`HELD_BYTES` and counted by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, _Held()).add(text)
            if sum(h.n for h in held.values()) > HELD_BYTES:
                for lang, h in held.items():
                    yield from count(lang, _Words(lang, h.texts))
                held = {}
        for lang, h in held.items():
            yield from count(lang, _Words(lang, h.texts))
        held = {}
        release_memory()  # the worker stays for other tasks and stages

    return docs.mapInArrow(run, schema)


def _sliced(size: int, names: list[str], *columns) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[-1]), SLICE):
        some = [c[at : at + SLICE] for c in columns]
        sizes = pa.array(np.full(len(some[-1]), size, np.int8))
        yield pa.RecordBatch.from_arrays([sizes, *(c if isinstance(c, pa.Array) else pa.array(c) for c in some)], names=["size", *names])


def hash_counts(docs: DataFrame, max_words: int, passes: list[list[Broadcast | None]]) -> DataFrame:
    """``size, h, n`` by the hash of the phrase: all words in the first pass, and the phrases that are fresh (:func:`_fresh`).

    Rows go to their counts' tasks at once: few phrases repeat inside a task beyond what it has added up itself.
    """

    def count(lang: str, words: _Words) -> Iterator[pa.RecordBatch]:
        sets = [[b.value if b is not None else None for b in p] for p in passes]
        chosen = None
        for size, _, hashes, follows in words.grams(max_words):
            if size > 1 or len(sets) == 1:
                h, n = np.unique(hashes if chosen is None else hashes[chosen], return_counts=True)
                yield from _sliced(size, ["h", "n"], h.view(np.int64), n)
            if follows is not None:
                chosen = _fresh(sets, size, hashes, follows)

    rows = _by_task(docs, "size tinyint, h bigint, n bigint", count)
    return rows.repartition("h").groupBy("size", "h").agg(F.sum("n").alias("n"))


def exact_counts(
    docs: DataFrame, max_words: int, passes: list[list[Broadcast | None]], frequent: list[Broadcast], min_count: int
) -> DataFrame:
    """``lang, size, phrase, n`` of the phrases with ``min_count`` occurrences, by their words: those whose hashes are among ``frequent`` and the
    fresh ones of the greatest size. A row of size 0 has each language's number of words."""

    def count(lang: str, words: _Words) -> Iterator[pa.RecordBatch]:
        sets, among = [[b.value for b in p] for p in passes], [b.value for b in frequent]
        own = lambda phrases: pa.array([lang] * len(phrases), pa.string())
        total = pa.array([""])
        yield from _sliced(0, ["lang", "phrase", "n"], own(total), total, np.array([words.n_words()]))
        new = None
        for size, at, hashes, follows in words.grams(max_words):
            chosen = among[size - 1].has(hashes)
            if size == max_words and new is not None:
                chosen |= new
            phrases, n = words.phrases(size, at[chosen])
            yield from _sliced(size, ["lang", "phrase", "n"], own(phrases), phrases, n)
            if size == max_words - 1:
                new = _fresh(sets, size, hashes, follows)

    rows = _by_task(docs, "size tinyint, lang string, phrase string, n bigint", count)
    return rows.groupBy("lang", F.col("size").cast("int").alias("size"), "phrase").agg(F.sum("n").alias("n")).filter(
        (F.col("n") >= min_count) | (F.col("size") == 0))


def frequent_phrases(
    docs: DataFrame, ws: Workspace, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, share: float = SAMPLE_SHARE, seed: int = 5
) -> DataFrame:
    """``lang, size, phrase, n`` of every phrase of 1 to ``max_words`` words with ``min_count`` occurrences or more in ``docs`` (``lang, text``),
    and a row of size 0 with the number of words of each language.

    A sample of ``share`` of the documents proposes the phrases that reach a lowered threshold there. The first full pass counts all words,
    and every phrase whose two parts (itself without its first and without its last word) are proposed: these are the proposals of its length
    and their negative border. A frequent word or phrase that was not proposed is a failure of the border, as longer phrases around it were
    not counted; then a further pass counts what all frequent parts imply and no pass has counted yet, until none fails but those of the last
    length but one. These passes count by 64-bit hashes, so what they call frequent may hold too much, never too little. The
    last pass counts by words: what they call frequent, and the longest phrases that failures of their parts imply. So counts are exact whatever the
    sample and the hashes hold. There are ``max_words`` full passes at most, by hash and by words together.
    """
    sc = docs.sparkSession.sparkContext
    lowered = max(2, math.ceil(LOWERED * share * min_count))
    sent: list[list[Broadcast]] = []

    def send(hashes: DataFrame, sizes: range) -> list[Broadcast]:
        sent.append([sc.broadcast(phrase_set(hashes.filter(F.col("size") == k))) for k in sizes])
        return sent[-1]

    sample = hash_counts(docs.sample(share, seed), max_words - 1, [[None] * max_words])
    proposed = ws.put(sample.filter(F.col("n") >= lowered).select("size", "h"), "proposed")
    passes, found = [send(proposed, range(1, max_words))], None
    for number in range(max_words):
        more = ws.put(hash_counts(docs, max_words, passes).filter(F.col("n") >= min_count).select("size", "h"), f"frequent-{number}")
        found = more if found is None else found.unionByName(more)
        failed = _failures(found.filter(F.col("size") < max_words), passes)
        if not failed:
            break
        passes.append(send(found, range(1, max_words)))
        if min(failed) == max_words - 1:
            break
    counted = ws.put(exact_counts(docs, max_words, passes, send(found, range(1, max_words + 1)), min_count), "counted")
    for b in (b for p in sent for b in p):
        b.unpersist()
    return counted


def _failures(parts: DataFrame, passes: list[list[Broadcast]]) -> list[int]:
    """The sizes of which a frequent phrase lies outside the set that the last pass went by."""

    def failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [b.value for b in passes[-1]]
        for batch in batches:
            sizes, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            out = [k for k, s in enumerate(sets, 1) if not s.has(h[sizes == k]).all()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["size"])

    return [size for (size,) in parts.mapInArrow(failures, "size int").distinct().collect()]


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    share: float = SAMPLE_SHARE,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` collocations of 2 to ``max_words`` words.

    Texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs, A-Z in lower case. ``a`` counts a phrase's occurrences
    inside pieces, overlapping ones too, ``l`` and ``r`` those of its two parts at its weakest cut, ``n`` the language's words;
    the score is ``floor(1000000 a a / (l r))`` in exact decimals. Candidates (``a >= min_count``) go when a candidate around them has half their
    occurrences. Ties rank by ``a`` and then by the phrase's bytes.

    Null texts count as empty, null languages as ``und``; repeated rows count again; an empty table gives none. Other columns are ignored,
    whatever their names. Counting: :func:`frequent_phrases`. A word that is part of a large share of all phrases is joined by
    broadcast (:func:`tracklens.llm.skew.join_unique`); a language's best are found in salted groups first.
    """
    on_workers(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = frequent_phrases(rows, ws, max_words, min_count, share)
    known = ws.put(found.filter("size > 0"), "known")
    totals = found.filter("size = 0").select("lang", F.col("n").alias("total"))
    candidates = known.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))

    words = F.split("phrase", " ")
    cut = lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("is_left"), F.array_join(F.slice(words, 1, k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("is_left"), F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("part")))
    cuts = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)))
    parts = candidates.select("lang", "phrase", "a", cuts.alias("c")).select("lang", "phrase", "a", "c.*")
    counts = known.filter(F.col("size") < max_words).select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    valued = join_unique(parts, counts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("is_left"), F.col("part_n"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("part_n"))).alias("r"))
    score = F.expr("(cast(1000000 as decimal(38,0)) * a * a) div (cast(l as decimal(38,0)) * r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    scored = ws.put(valued.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "b.score", "b.l", "b.r"), "scored")

    # every stretch of two words or more inside a candidate, with the candidate's occurrences
    inner = lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    stretches = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), inner)))
    around = candidates.filter("size > 2").select("lang", stretches.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(
        f"around is null or 100 * cast(around as decimal(38,0)) < {SWALLOWED_PERCENT} * cast(a as decimal(38,0))")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ws.result(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))
