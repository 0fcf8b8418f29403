"""Near-dedup of embeddings with a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import Workspace, on_workers
from tracklens.llm.components import connected_components
from tracklens.llm.skew import join_unique

COSINE = 0.95
#: Nearest pivots kept of each vector, and how many of them a candidate pair must share.
PREFIX, SHARED = 10, 2
MIN_PIVOTS, MAX_PIVOTS = 64, 4096
#: No two pivots are closer than this cosine, so that a dense group is ordered by few of them.
PIVOT_COSINE = 0.8
#: Vectors of one inverted list that meet another such portion in one row.
PORTION = 512
#: Candidates of a block that are verified at once, and the share of its pairs from which all are multiplied.
CHUNK, DENSE = 65_536, 0.1
SEED = 23
#: Classes of vectors without any key are named by a hash above this number, so keys must lie below it.
NO_KEY = 1 << 62


def pivot_count(n: int) -> int:
    """About four times the root of the number of vectors, a power of two, so that the lists stay
    short as tables grow; at most ``MAX_PIVOTS``, which bounds what is sent to the tasks."""
    return int(min(MAX_PIVOTS, max(MIN_PIVOTS, 2 ** round(math.log2(4 * math.sqrt(max(n, 1)))))))


def _unit_rows(lists: list, dim: int) -> np.ndarray:
    x = np.array(lists, dtype=np.float64).reshape(len(lists), dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread_pivots(pivots: np.ndarray, cosine: float = PIVOT_COSINE) -> np.ndarray:
    """The rows of ``pivots`` left when each that is closer than ``cosine`` to an earlier kept one is dropped.

    Many pivots inside one group of near copies would be ordered by noise, and its pairs would share none.
    """
    keep, free = [], np.ones(len(pivots), dtype=bool)
    for i in range(len(pivots)):
        if free[i]:
            keep.append(i)
            free &= pivots @ pivots[i] <= cosine
    return pivots[keep]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The first ``prefix`` places of each row's permutation of pivots, nearest first."""
    near = x @ pivots.T
    k = min(prefix, pivots.shape[0])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int32)


def candidate_pairs(pa_: np.ndarray, pb: np.ndarray, pivot: int, same: bool, shared: int) -> np.ndarray:
    """Which pairs of two portions of the inverted list of ``pivot`` are candidates, as a boolean matrix.

    Shared pivots are counted, before any vector is looked at, by one product of incidence matrices. A pair is a candidate with
    ``shared`` pivots or more in common, and only in the list of the smallest of them, so that it is met once over all lists.
    """
    names, at = np.unique(np.concatenate((pa_, pb)), return_inverse=True)
    at, step = at.reshape(-1, pa_.shape[1]), np.float32(pa_.shape[1] + 1)

    def incidence(rows: np.ndarray, lower: np.float32) -> np.ndarray:
        out = np.zeros((len(rows), len(names)), dtype=np.float32)
        out[np.arange(len(rows))[:, None], rows] = 1
        out[:, names < pivot] *= lower
        return out

    # a smaller pivot in common counts for more than all others together
    count = incidence(at[: len(pa_)], np.float32(1)) @ incidence(at[len(pa_):], step).T
    found = (count >= shared) & (count < step)
    return np.triu(found, 1) if same else found


def link_block(
    a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, pivot: int, same: bool, shared: int, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows ``(i, j)`` of two portions of one inverted list: their candidates whose cosine is high enough."""
    found = candidate_pairs(pa_, pb, pivot, same, shared)
    i, j = np.nonzero(found)
    if len(i) >= DENSE * found.size:
        near = (a @ b.T)[i, j] >= cosine
    else:
        near = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), CHUNK):
            part = slice(at, at + CHUNK)
            near[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= cosine
    return i[near], j[near]


def spanning_links(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A few of the links that connect the same of ``n`` rows as all of them do."""
    parent = list(range(n))
    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        rx, ry = x, y
        while parent[rx] != rx:
            parent[rx] = rx = parent[parent[rx]]
        while parent[ry] != ry:
            parent[ry] = ry = parent[parent[ry]]
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out


def embedding_near_dedup(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = COSINE,
    prefix: int = PREFIX,
    shared: int = SHARED,
    pivots: int | None = None,
) -> DataFrame:
    """Links vectors of cosine similarity ``cosine`` or more and labels their components.

    A bounded sample of the vectors themselves (``pivots``, by default :func:`pivot_count`), thinned
    until no two are close (:func:`spread_pivots`), are the pivots. Every vector is described by its ``prefix`` nearest pivots in order and enters their
    inverted lists; shared pivots are counted along the lists, and pairs with ``shared`` or more are candidates
    and are verified in double precision. Lists are dealt out in portions of about ``PORTION`` vectors and every two
    portions of a list meet in a row of their own, so a large group spreads over many tasks; a task
    gives counts and a spanning forest of its links, never the pairs. Identical vectors are one
    class and only count.

    The index is approximate in what it retrieves, exact in what it links; measured recall is in
    the README.

    Returns ``key, n_links, component_id, kept`` per row. Vectors that are null, empty, zero or hold null,
    NaN or infinite components link with nothing, and so do vectors of different lengths. Rows
    with null keys count as vectors; a component without any key has a null ``component_id``, and its rows are ``kept``. Keys are
    below 2^62. A key that repeats with other vectors is one vector with the links of
    all. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "pivot")
    on_workers(spark)
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # equal vectors meet again by two hashes, so that no vector is shuffled as a key twice
    plus_zero = F.transform("v", lambda x: x + F.lit(0.0))
    digests = {"d1": F.xxhash64(F.lit(SEED), plus_zero), "d2": F.xxhash64(F.lit(SEED + 1), plus_zero)}
    good = rows.filter(usable)
    light = ws.put(good.withColumns(digests).select("id", "d1", "d2"), "light")
    classes = ws.put(
        good.groupBy("v").agg(F.min("id").alias("cls"), F.count("*").alias("weight")).withColumns(digests).withColumn(
            "cls", F.coalesce("cls", F.lit(NO_KEY) + F.shiftrightunsigned("d1", 2))), "classes")
    n = classes.count()
    wanted = pivots or pivot_count(n)
    sample = classes.select("v").orderBy(F.xxhash64(F.lit(SEED), "v")).limit(wanted).collect()
    by_dim: dict[int, list] = {}
    for (v,) in sample:
        by_dim.setdefault(len(v), []).append(v)
    matrices = {d: spread_pivots(_unit_rows(vs, d)) for d, vs in by_dim.items()}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights, lists = (batch.column(c).to_pylist() for c in range(3))
            out: list[tuple] = []
            for dim in sorted({len(v) for v in lists}):
                at = [i for i, v in enumerate(lists) if len(v) == dim]
                refs = matrices.get(dim, np.empty((0, dim)))
                if len(refs) < MIN_PIVOTS:  # too few vectors of this length were drawn or kept: fixed random directions
                    more = np.random.default_rng(SEED + dim).normal(size=(MIN_PIVOTS - len(refs), dim))
                    refs = np.vstack([refs, _unit_rows(more, dim)])
                x = _unit_rows([lists[i] for i in at], dim)
                for i, near, unit in zip(at, nearest_pivots(x, refs, prefix), x):
                    out.append((ids[i], weights[i], dim, near.tolist(), unit.tobytes()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.binary())],
                names=["cls", "weight", "dim", "near", "unit"])

    index = ws.put(
        classes.select("cls", "weight", "v").mapInArrow(
            describe, "cls bigint, weight bigint, dim int, near array<int>, unit binary"), "index")
    entries = index.select("*", F.explode("near").alias("pivot"))
    lengths = entries.groupBy("dim", "pivot").agg(F.count("*").alias("m")).filter("m > 1")
    portions = (
        entries.join(lengths, ["dim", "pivot"])
        .withColumn("portion", F.pmod(F.xxhash64(F.lit(SEED), "cls", "unit"), F.ceil(F.col("m") / PORTION)))
        .groupBy("dim", "pivot", "portion")
        .agg(F.collect_list(F.struct("cls", "weight", "near", "unit")).alias("members")))
    portions = ws.put(portions, "portions")
    other = portions.select("dim", "pivot", F.col("portion").alias("portion_b"), F.col("members").alias("b"))
    blocks = portions.withColumnRenamed("members", "a").join(other, ["dim", "pivot"]).filter("portion <= portion_b").select(
        "dim", "pivot", (F.col("portion") == F.col("portion_b")).alias("same"), "a", "b")

    def parts(members: list, dim: int):
        return (
            np.array([m["cls"] for m in members], dtype=object),
            np.array([m["weight"] for m in members], dtype=np.int64),
            np.array([m["near"] for m in members], dtype=np.int32),
            np.frombuffer(b"".join(m["unit"] for m in members), dtype=np.float64).reshape(-1, dim))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, pivot, same, one, two = (batch.column(c)[r].as_py() for c in range(5))
                ca, wa, na, xa = parts(one, dim)
                cb, wb, nb, xb = (ca, wa, na, xa) if same else parts(two, dim)
                i, j = link_block(xa, xb, na, nb, pivot, same, shared, cosine)
                if not len(i):
                    continue
                la = np.bincount(i, weights=wb[j], minlength=len(ca)).astype(np.int64)
                lb = np.bincount(j, weights=wa[i], minlength=len(cb)).astype(np.int64)
                forest = spanning_links(i, j + (0 if same else len(ca)), len(ca) + (0 if same else len(cb)))
                both = ca if same else np.concatenate((ca, cb))
                some, other_some = np.flatnonzero(la), np.flatnonzero(lb)
                cls = [*ca[some], *cb[other_some], *(both[x] for x, _ in forest)]
                to = [None] * (len(some) + len(other_some)) + [both[y] for _, y in forest]
                count = [*la[some].tolist(), *lb[other_some].tolist(), *([0] * len(forest))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls, pa.int64()), pa.array(to, pa.int64()), pa.array(count, pa.int64())],
                    names=["cls", "other", "links"])

    found = ws.put(blocks.mapInArrow(verify, "cls bigint, other bigint, links bigint"), "found")
    links = found.filter("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    labels = connected_components(ws, found.filter("other is not null"), "cls", "other")
    per_class = classes.join(links, "cls", "left").join(
        labels.select(F.col("node").alias("cls"), "label"), "cls", "left"
    ).select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
             F.coalesce("label", "cls").alias("component_id")).withColumn(
        "component_id", F.when(F.col("component_id") < NO_KEY, F.col("component_id")))
    result = join_unique(light, ws.put(per_class, "per_class"), ["d1", "d2"]).select("id", "n_links", "component_id").unionByName(
        rows.filter(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return ws.result(
        result.select(
            F.col("id").alias(key), "n_links", "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))
