"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.llm.common import Workspace
from tracklens.llm.skew import hot_keys

WEIGHTS = (3, 1, 2)
PERCENT = 150
CAP = 2
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, the unit that the tree deals out. Blocks grow when there would be more than
#: ``MAX_BLOCKS`` of them, which the hypergeometric sampler's range asks for.
BLOCK_WORDS = 2_048
MAX_BLOCKS = 1 << 28
SHARD_WORDS = 1 << 22
MIN_SHARDS = 8
#: What the tree splits at most: a source each, or bundles of neighbouring sources where there are more.
MAX_BUNDLES = 4_096
#: Tasks that rank the sources, and tasks that a source's rows are dealt over when they meet its row.
RANK_TASKS, SALTS = 32, 16
#: Tasks that the mixed shards are written by at most; each takes a run of whole shards.
MAX_TASKS = 1 << 14


def _ranked(ws: Workspace, totals: DataFrame) -> DataFrame:
    """Adds ``idx``, the place of ``source`` in code point order with null last: its place in a range of sources
    and the number of sources in the ranges before."""
    order = F.col("source").asc_nulls_last()
    parts = ws.put(totals.repartitionByRange(RANK_TASKS, order).withColumn("task", F.spark_partition_id()), "totals")
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # over a row a task
    before = parts.groupBy("task").agg(F.count("*").alias("n")).select(
        "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("task").orderBy(order)) - 1
    return parts.withColumn("idx", inside.cast("bigint")).join(before, "task").select(
        "source", "size", (F.col("before") + F.col("idx")).alias("idx"))


def source_targets(
    ws: Workspace, totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP
) -> DataFrame:
    """``source, size, idx, target, quota, passes, part`` of every ``source, size``; ``idx`` is its place in code
    point order with null last, ``target`` its words in the mix and ``quota`` those as a whole number.

    ``percent`` of all words are shared by weight; a target stops at ``cap`` times its source and
    the excess is shared again by weight. Closing sources at their cap raises the level
    ``(total - closed) / open weight`` of the others, until it closes no more; each round is one
    aggregate, and the driver sees its two sums only, whatever the number of sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    ranked = ws.put(_ranked(ws, totals).withColumn("weight", weight.cast("bigint")), "ranked")
    limit = cap * F.col("size")
    words, shares = (x or 0 for x in ranked.agg(F.sum("size"), F.sum("weight")).first())
    total, shut = words * percent / 100.0, (0, 0)
    while True:
        level = (total - shut[0]) / (shares - shut[1]) if shares > shut[1] else math.inf
        full = F.lit(level) * F.col("weight") > limit
        found = tuple(x or 0 for x in ranked.filter(full).agg(F.sum(limit), F.sum("weight")).first())
        if found == shut:
            break
        shut = found
    target = F.when(full, limit.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    some = F.col("size") > 0
    return (
        ranked.withColumn("target", target)
        .withColumn("quota", F.floor(F.col("target") + 0.5).cast("bigint"))
        .select(
            "source", "size", "idx", "target", "quota",
            F.when(some, F.expr("quota div size")).otherwise(0).alias("passes"),
            F.when(some, F.col("quota") % F.col("size")).otherwise(0).alias("part")))


def _stride(n: int) -> int:
    """A step near the golden section of ``n`` that reaches all of ``0..n-1``."""
    step = max(1, round(n * 0.6180339887))
    while math.gcd(step, n) > 1:
        step += 1
    return step


def _node_rng(seed: int, depth: int, path: int) -> np.random.Generator:
    digest = hashlib.sha256(f"{seed}/{depth}/{path}".encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "little")))


def leaf_ranges(units: np.ndarray, depth: int, leaf: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``[low, high)`` of each bundle's block sequence that output shard ``leaf`` draws.

    The root holds all block quotas. A node gives half of its blocks, drawn without regard to the
    source from a multivariate hypergeometric distribution, to its left child and the rest to
    the right one. Every node's generator is seeded by its place in the tree, so each leaf finds its
    share alone, by walking down from the root, and all leaves together use every block once.
    """
    low, held = np.zeros(len(units), dtype=np.int64), units.astype(np.int64)
    for level in range(depth):
        path = leaf >> (depth - level)
        rng = _node_rng(seed, level, path)
        total = int(held.sum())
        # an odd block goes to either side by the node's own coin
        half = total // 2 + (int(rng.integers(2)) if total % 2 else 0)
        left = rng.multivariate_hypergeometric(held, half, method="marginals") if total else held
        if (leaf >> (depth - level - 1)) & 1:
            low, held = low + left, held - left
        else:
            held = left
    return low, low + held


def _stream_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: words before the row in its source's permuted stream.

    A two-level prefix sum: hash ranges are summed and the sums are accumulated for 256 wide ranges
    of a source, for 256 narrow ranges in each, and for the rows inside a narrow range. No window
    holds a whole source.
    """
    rows = rows.withColumns({
        "wide": F.substring("order_hash", 1, 2), "narrow": F.substring("order_hash", 3, 2)})
    narrow = rows.groupBy("idx", "wide", "narrow").agg(F.sum("size").alias("w"))
    wide = narrow.groupBy("idx", "wide").agg(F.sum("w").alias("w"))

    def before(df: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("w").over(w), F.lit(0))).drop("w")

    offsets = before(narrow, ["idx", "wide"], "narrow", "o2").join(
        before(wide, ["idx"], "wide", "o1"), ["idx", "wide"])
    inside = Window.partitionBy("idx", "wide", "narrow").orderBy("order_hash", "id", "size", "fp", "nth").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        rows.withColumn("o3", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets.hint("merge"), ["idx", "wide", "narrow"])  # in the window's partitioning; offsets grow with the table
        .withColumn("start", F.col("o1") + F.col("o2") + F.col("o3"))
        .drop("wide", "narrow", "o1", "o2", "o3")
    )


def mix_plan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = PERCENT,
    cap: int = CAP,
    seed: int = SEED,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """What the mix takes of every row: one output row per input row.

    A source's documents form a stream in hash order. The mix takes full passes over it and a
    last pass over its first documents, of which the last one is cut so that the words meet the target
    to the word. What is taken of a source is cut into blocks of about ``block_words`` words (whole
    documents); above ``MAX_BUNDLES`` sources, neighbours in code point order share one sequence of blocks.
    :func:`leaf_ranges` deals the blocks out among the output shards; they are permuted, and a
    shard takes those whose places fall into its range. Any number of sources will do.

    Returns ``id, fp, nth, idx, size, source_size, target, taken, copies``; ``copies`` holds
    ``(shard, order, words)`` of each taking, ``order`` being the random order inside a shard.
    Null texts have no words and are never taken; null sources form the last source; null keys
    and rows that repeat a key are rows of their own (``fp`` is the text's hash, ``nth`` numbers
    equal rows, which are one row with a count until they are numbered). A row's place in the stream comes from its key;
    where keys are null or one key has many rows, from text and number as well, so that they spread over the stream.
    An empty table, or one without words, takes nothing.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    body = F.coalesce(F.col(text), F.lit(""))
    light = docs.select(
        F.col(key).alias("id"),
        F.col(source).alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(body).alias("fp"),
    )
    sizes = ws.put(light, "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    targets = ws.put(source_targets(ws, totals, weights, percent, cap), "targets")
    n_sources = targets.count()
    n_bundles = min(n_sources, MAX_BUNDLES)
    sources = targets.withColumn("bundle", F.expr(f"idx * {n_bundles} div {max(n_sources, 1)}"))
    quotas = {r.bundle: r.words for r in sources.groupBy("bundle").agg(F.sum("quota").alias("words")).collect()}
    taken_words = sum(quotas.values())
    block = max(block_words, -(-taken_words // MAX_BLOCKS))
    units = np.array([-(-quotas[b] // block) for b in range(n_bundles)], dtype=np.int64)
    bundles = spark.createDataFrame(
        [(b, n, _stride(n)) for b, n in enumerate(units.tolist())], "bundle bigint, units bigint, stride bigint")
    earlier = Window.partitionBy("bundle").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.select(
        "source", "idx", "bundle", F.coalesce(F.sum("quota").over(earlier), F.lit(0)).alias("base"),
        F.col("size").alias("source_size"), "target", "passes", "part",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # not broadcast by hand: the table of sources grows with the data, so Spark's size check decides
    own_salt = F.pmod(F.xxhash64("id", "fp"), F.lit(SALTS)) == sources["salt"]
    sized = sizes.groupBy("id", "source", "size", "fp").agg(F.count("*").alias("m"))
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"]) & own_salt).drop("source", "salt")
    none = F.lit(0).cast("bigint")  # rows without words are never taken: they need no number and no place
    # a row and a count for each source that has the key and text
    earlier = F.sum("m").over(Window.partitionBy("id", "fp").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(earlier, F.lit(0)) + 1
    numbered = rows.filter("size > 0").withColumn("first", first).withColumn(
        "nth", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("m") - 1))).drop("first", "m")
    many = hot_keys(sizes, ["id"])
    own_hash = F.concat(F.lit(f"mix-{seed}-"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    spread = F.md5(F.concat_ws("-", own_hash, F.col("fp").cast("string"), F.col("nth").cast("string")))
    crowded = F.col("id").isNull()
    if many is not None:
        numbered = numbered.join(F.broadcast(many.withColumn("many", F.lit(True))), "id", "left")
        crowded = crowded | F.col("many").isNotNull()
    numbered = numbered.withColumn("order_hash", F.when(crowded, spread).otherwise(F.md5(own_hash))).drop("many")
    empty = rows.filter("size = 0").withColumns({"nth": none, "start": none, "order_hash": F.md5(own_hash)}).withColumn(
        "m", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m")))).drop("m")
    rows = ws.put(_stream_starts(numbered).unionByName(empty), "streams")

    # one row for each time that a pass reaches a document
    in_pass = F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("pass")
    takes = (
        rows.select("*", in_pass)
        .withColumn(
            "words",
            F.when(F.col("pass") < F.col("passes"), F.col("size"))
            .when(F.col("pass") == F.col("passes"), F.greatest(F.lit(0), F.least("size", F.col("part") - F.col("start"))))
            .otherwise(0))
        .filter("words > 0")
        .join(F.broadcast(bundles), "bundle")  # MAX_BUNDLES rows at most
    )
    # a permutation of 0..n-1: steps of a stride without a common factor with n
    number = F.expr(f"(base + pass * source_size + start) div {block}")
    turn = F.pmod(F.xxhash64(F.lit(seed), "bundle"), F.col("units"))
    takes = takes.withColumn("place", F.pmod(number * F.col("stride") + turn, F.col("units")))

    depth = max(MIN_SHARDS, -(-taken_words // shard_words))
    depth = int(depth - 1).bit_length()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for leaf in batch["id"]:
                low, high = leaf_ranges(units, depth, int(leaf), seed)
                yield pd.DataFrame({"shard": leaf, "bundle": np.arange(len(units)), "low": low, "high": high})

    shards = 1 << depth
    leaves = (
        spark.range(0, shards, 1, max(1, min(shards // 8, 2048)))
        .mapInPandas(walk, "shard bigint, bundle bigint, low bigint, high bigint")
        .filter("high > low")
        .select("shard", "bundle", F.explode(F.sequence("low", F.col("high") - 1)).alias("place"))
    )
    dealt = takes.join(leaves.hint("merge"), ["bundle", "place"]).select(
        "id", "fp", "nth",
        F.struct(
            "shard",
            F.xxhash64(F.lit(seed), "shard", "pass", "order_hash", "nth").alias("order"),
            "words").alias("copy"))
    got = dealt.groupBy("id", "fp", "nth").agg(
        F.sum("copy.words").alias("taken"), F.sort_array(F.collect_list("copy")).alias("copies"))
    own = rows.select("id", "fp", "nth", "idx", "size", "source_size", "target")
    match = [own[c].eqNullSafe(got[c]) for c in ("id", "fp", "nth")]
    return ws.result(
        own.join(got, match, "left").select(
            *(own[c] for c in own.columns),
            F.coalesce(got["taken"], F.lit(0)).alias("taken"),
            F.coalesce(got["copies"], F.array().cast("array<struct<shard:bigint,order:bigint,words:bigint>>")).alias("copies")))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed documents themselves: each taken row once per taking, dealt to its output shards.

    Columns are those of ``docs`` and ``mix_shard``. Each partition is a whole shard in random order, or a run of them where
    there are more than ``MAX_TASKS`` shards. Rows with null keys and rows that repeat a key are rows of their own; rows alike in key and text are numbered
    by source, ties in any order, in one task for each such group. An empty table gives an empty result.
    A document that is taken in part (at most one for each source) keeps its first words,
    separated by single blanks; if ``docs`` has ``n_chars``, that follows the text.
    """
    plan = mix_plan(docs, key, text, source, **how)
    own_key = lambda c: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit("null"))
    copies = plan.filter("taken > 0").select(
        own_key("id").alias("_own_key"), F.col("fp").alias("_own_fp"), F.col("nth").alias("_copy_nth"),
        F.col("size").alias("_size"), F.explode("copies").alias("_copy"))
    rows = docs.filter(F.col(text).rlike(WORD)).withColumns({"_own_key": own_key(key), "_own_fp": F.xxhash64(F.col(text))})
    if plan.filter("nth > 1").limit(1).count():
        # rows alike in key and text: numbers must agree too, and texts move a second time
        same = Window.partitionBy("_own_key", "_own_fp").orderBy(F.col(source).asc_nulls_last())
        rows = rows.withColumn("_copy_nth", F.row_number().over(same).cast("bigint"))
        out = rows.join(copies, ["_own_key", "_own_fp", "_copy_nth"])
    else:
        out = rows.join(copies, ["_own_key", "_own_fp"])
    kept = F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), 1, F.col("_copy.words").cast("int"))
    out = out.withColumn(
        text, F.when(F.col("_copy.words") < F.col("_size"), F.array_join(kept, " ")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast("bigint"))
    last = plan.select(F.explode("copies.shard").alias("shard")).agg(F.max("shard")).first()[0]
    shards = (last or 0) + 1
    tasks = min(shards, MAX_TASKS)
    return (
        out.withColumns({"mix_shard": F.col("_copy.shard"), "_order": F.col("_copy.order")})
        .repartitionById(tasks, F.expr(f"mix_shard * {tasks} div {shards}").cast("int"))
        .sortWithinPartitions("mix_shard", "_order")
        .select(*(F.col(f"`{c}`") for c in docs.columns), "mix_shard")
    )
