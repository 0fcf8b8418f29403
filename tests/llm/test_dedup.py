"""Exact, near and embedding dedup against brute force on small tables with awkward rows."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.llm.components import connected_components
from tracklens.llm.common import Workspace
from tracklens.llm.embed_dedup import candidate_pairs, embedding_near_dedup, nearest_pivots
from tracklens.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from tracklens.llm.near_dedup import near_dedup
from tracklens.llm.shingles import band_keys, circulant_minhash, common, shingle_set

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, rank int, kept string"


def table(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, "y") for i, t in rows], DOCS)


def components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


ROWS = [
    (1, "a b"), (2, "ab"), (3, " a\tb "), (4, None), (5, ""), (6, " \n"), (7, "A b"), (8, "a b"), (8, "a b"),
    (9, "a b"), (10, "x" * 50_000), (11, "x" * 25_000 + " " + "x" * 25_000), (None, "zz"), (None, "z z"),
]


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c).cast("string")])
def test_exact_dedup(spark, digest):
    """The weak digest makes different texts share it, so that contents alone decide."""
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    want = []
    for members in groups.values():
        order = sorted(range(len(members)), key=lambda k: (-len(members[k][1]), members[k][0] is None, members[k][0] or 0))
        best = members[order[0]][0]
        want += [(i, best, len(members), k == order[0]) for k, (i, _) in enumerate(members)]  # one row of a group stays
    got = [tuple(r)[:4] for r in exact_dedup(table(spark, ROWS), salts=3, digest=digest).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_dedup_of_nothing_and_the_rows_that_stay(spark):
    assert exact_dedup(table(spark, []).limit(0)).count() == 0
    kept = drop_exact_duplicates(table(spark, ROWS))
    assert kept.columns == table(spark, []).columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert ids == [3, 6, 7, 9, 11, None]


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c).cast("string")])
def test_one_row_of_a_group_is_kept_whatever_repeats(spark, digest):
    rows = [(1, "a b"), (1, "ab"), (2, "ab"), (3, "cd"), (3, "cd"), (3, "cd"), (None, "ef"), (None, "ef"), (None, "e f")]
    got = exact_dedup(table(spark, rows), digest=digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=repr) == sorted([
        (1, 1, 3, True), (1, 1, 3, False), (2, 1, 3, False), *[(3, 3, 3, k) for k in (True, False, False)],
        *[(None, None, 3, k) for k in (True, False, False)]], key=repr)


def test_hot_classes_give_the_same_components(spark, monkeypatch):
    """A third of the rows copies of one text without keys, a third near copies of one document, and a key with many texts."""
    from tracklens.llm import skew

    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    near = [(1000 + i, " ".join([*base[:59], f"x{i}"])) for i in range(80)]
    rows = [*near, *[(None, "same text of all these rows")] * 79, (7, "same text of all these rows"), *[(i, f"p{i} q{i} r{i}") for i in range(2000, 2080)]]
    rows += [(3000, " ".join(rng.choice(base) for _ in range(30))) for _ in range(20)]
    want = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup(table(spark, rows), width=2).collect()), key=repr)
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.05)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup(table(spark, rows), width=2).collect()), key=repr)
    assert got == want and {c for i, _, c in got if i and i // 1000 == 1} == {1000} and {c for i, _, c in got if i is None} == {7}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_of_a_hot_key_are_dealt_over_tasks(spark, tmp_path, monkeypatch, how):
    from tracklens.llm import skew

    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 100 != 1, F.col("id")).alias("k"), "id").write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    right = spark.range(0, 2000, 2).select(F.col("id").alias("k"), F.explode(F.array(F.col("id") * 2, F.lit(1))).alias("v"))
    for by in ("id", None):
        got = skew.join_dealt(left, right, "k", by, how)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, left.join(right, "k", how).select(*got.columns).collect()), key=repr)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions stay as they are, and small tables are shuffled
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = skew.join_dealt(left, right, "k", "id", how).groupBy(F.spark_partition_id().alias("p")).agg(
            F.count_if(F.col("k") == 0).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r.n for r in tasks) == 2000 and max(r.n for r in tasks) < 1000  # the hot key's rows, over 4 tasks


def test_long_words_are_not_remembered():
    from tracklens.llm import shingles

    shingles._MEMO.clear()
    long = b"w" * (shingles.MEMO_LENGTH + 1)
    assert list(shingle_set(long + b" short", 1)) == list(shingle_set(b"short " + long, 1))
    assert set(shingles._MEMO) == {b"short"}


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (5, 4), (5, 4), (200, 119)]
    edges = spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")
    got = {r.node: r.label for r in connected_components(Workspace(spark, "test"), edges).collect()}
    assert got == components({n for e in links for n in e}, links)
    assert connected_components(Workspace(spark, "test"), edges.limit(0)).count() == 0


def brute_near(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    links = []
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


def near_rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "Two words"), (7, "two\nwords"), (8, "École x"), (9, "école x")]
    # a group around the threshold: many pairs of it are similar enough, many are not
    base = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(words)))
    # a chain: neighbours are similar, ends are not
    chain = [f"c{i}" for i in range(80)]
    for i in range(12):
        rows.append((300 + i, " ".join(chain[2 * i : 2 * i + 40])))
    rows += [(400 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 90)))) for i in range(60)]
    rows += [(500 + i, rows[70][1].upper()) for i in range(30)]
    rows.append((600, "long " + " ".join(str(i % 997) for i in range(30_000))))
    rows.append((601, "long " + " ".join(str(i % 997) for i in range(30_001))))
    return rows


def test_near_dedup_against_brute_force(spark):
    rows = near_rows()
    sizes, label = brute_near(rows, 2)
    got = near_dedup(table(spark, rows), width=2).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert {r.doc_id: r.component_id for r in got} == label
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_of_awkward_rows(spark):
    assert near_dedup(table(spark, []).limit(0)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (5, "q r s t u v"), (None, "q r s t u v"), (None, None)]
    got = sorted(((r.doc_id, r.component_id) for r in near_dedup(table(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (1, 1), (5, 1), (None, 1), (None, None)], key=repr)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    a = " ".join(words[:2000]).encode()
    b = " ".join(words[400:2400]).encode()
    sa, sb = shingle_set(a, 1), shingle_set(b, 1)
    true = common(sa, sb) / (len(sa) + len(sb) - common(sa, sb))
    sig = circulant_minhash([sa, sb], 1024)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 1024)
    keys = band_keys(circulant_minhash([sa, sa, sb], 12), 4)
    assert keys.shape == (3, 4) and (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == 4
    assert rng is not None


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = []
    for i, v in enumerate(base):
        v = v / np.linalg.norm(v)
        for j in range(rng.integers(1, 5)):
            n = rng.normal(size=16)
            n -= n @ v * v
            c = rng.choice([0.94, 0.953, 0.97, 0.999])
            w = c * v + math.sqrt(1 - c * c) * n / np.linalg.norm(n)
            rows.append((10 * i + j, (w * rng.uniform(0.5, 3)).astype(np.float32).tolist()))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 15 + [float("nan")]), (2004, [1.0] * 15 + [None]),
             (2005, [1.0] * 15 + [float("inf")]), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    good = {i: np.array(v, dtype=np.float64) for i, v in rows
            if v and None not in v and np.isfinite(v).all() and any(v)}
    links = []
    ids = sorted(good)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = good[a], good[b]
            if len(p) == len(q) and p @ q / math.sqrt((p @ p) * (q @ q)) >= 0.95:
                links.append((a, b))
    label = components([i for i, _ in rows], links)
    many = {i: 0 for i, _ in rows}
    for a, b in links:
        many[a] += 1
        many[b] += 1
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int, links int")
    # lists so short that every list is cut into portions
    got = embedding_near_dedup(df, pivots=16).collect()
    assert {r.vec_id: r.n_links for r in got} == many
    assert {r.vec_id: r.component_id for r in got} == label
    assert len(got) == len(rows)
    assert embedding_near_dedup(df.limit(0)).count() == 0


def test_pivot_recall_near_the_threshold():
    rng = np.random.default_rng(11)
    v = rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    n = rng.normal(size=v.shape)
    n -= (n * v).sum(axis=1, keepdims=True) * v
    w = 0.951 * v + math.sqrt(1 - 0.951**2) * n / np.linalg.norm(n, axis=1, keepdims=True)
    pivots = v[rng.choice(4000, 256, replace=False)]
    a, b = nearest_pivots(v, pivots, 10), nearest_pivots(w, pivots, 10)
    shared = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))
    assert (shared >= 2).mean() > 0.99


def test_links_of_a_dense_group_against_brute_force(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    group = rng.choice(10_000, 3333, replace=False)
    x[group] = math.sqrt(0.98) * x[group[0]] + math.sqrt(0.02) * x[group]
    x = x.astype(np.float32)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    many = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert many[group].min() == 3332
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in embedding_near_dedup(df).collect()}
    assert [got[i].n_links for i in range(10_000)] == many.tolist()
    assert {got[i].component_id for i in group.tolist()} == {group.min()}


def test_vectors_without_keys_count_as_links(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.01, 1.0]), (None, [0.0, 1.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.0]), (8, [-0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_near_dedup(df).collect()), key=str)
    assert got == sorted([
        (None, 1, 1, False), (1, 1, 1, True), (None, 2, None, True), (None, 2, None, True), (None, 2, None, True),
        (7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True)], key=str)


def test_shared_pivots_are_counted_before_any_cosine():
    """Against a loop over all pairs; every pair is met in one list only."""
    rng = np.random.default_rng(2)
    near = np.array([rng.choice(30, 6, replace=False) for _ in range(60)], dtype=np.int32)
    for shared in (1, 2, 4):
        met = []
        for pivot in range(30):
            rows = np.flatnonzero((near == pivot).any(axis=1))
            half = rows[: len(rows) // 2], rows[len(rows) // 2 :]
            for x, y, same in ((half[0], half[0], True), (half[1], half[1], True), (half[0], half[1], False)):
                if len(x) and len(y):
                    i, j = np.nonzero(candidate_pairs(near[x], near[y], pivot, same, shared))
                    met += [tuple(sorted(p)) for p in zip(x[i].tolist(), y[j].tolist())]
        want = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(set(near[a]) & set(near[b])) >= shared}
        assert len(met) == len(set(met)) and set(met) == want
