"""Exact dedup by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.llm.common import Workspace

#: The characters that do not count when texts are compared.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
SALTS = 16
#: A digest is hot, and its rows are salted, from this share of all rows; so there are at most
#: ``1 / HOT_SHARE`` hot digests, which bounds the broadcast.
HOT_SHARE = 0.001
_ID_SPAN = "36893488147419103232"  # 2^65, room for any id below one code point
_NO_ID = "9223372036854775808"  # 2^63, sorts behind every id


def _rank(length: Column, key: Column) -> Column:
    """One number that grows with the length and, at equal lengths, falls with the id.

    A fixed-width maximum keeps the combining in hash aggregation; a struct would force a sort
    by whole texts.
    """
    d = "decimal(38,0)"
    back = F.lit(_NO_ID).cast(d) - F.coalesce(key.cast(d), F.lit(_NO_ID).cast(d))
    return (length.cast(d) * F.lit(_ID_SPAN).cast("decimal(20,0)")).cast(d) + back


def _key_of(rank: Column) -> Column:
    d = "decimal(38,0)"
    back = F.pmod(rank, F.lit(_ID_SPAN).cast(d))
    return F.when(back > 0, (F.lit(_NO_ID).cast(d) - back).cast("bigint"))


def exact_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Which row stays of every group of equal texts; one output row per input row.

    Texts are equal when identical after all ASCII white space is deleted; null counts as empty.
    The row with the most code points, then the smallest key, stays.

    Combining: (1) each task merges its own equal texts (map-side combine), (2) groups of
    ``(digest, content, salt)`` merge next, rows of hot digests under ``salts`` salts, so that a text
    with a third of all rows is spread over as many tasks, (3) the salt winners of hot digests are
    merged per ``(digest, content)``; others have one salt and are final. Whole contents are
    grouping keys at every stage, so equal digests of different texts never merge. Only the digest
    goes back to the rows, the few hot ones by broadcast, the others by a join on the digest; digests shared by
    different contents, if any, are resolved by a second join on the content itself.

    Returns ``key, keep_id, group_size, kept, text_sha256``. Null keys sort last and stay only
    when no other row of the group has a key (``keep_id`` is then null). ``kept`` is true for one row of every group: rows
    that repeat a key are told apart by length; of those that also repeat the length, which give the same result, one
    is ``kept`` and each is counted. Rows alike are one row with a count until the end, so none of this needs a window. Empty tables give empty results;
    other columns are ignored, whatever their names. ``digest`` may name another digest function
    (tests use a weak one).
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    sha = F.sha2(F.col("content").cast("binary"), 256)
    rows = (
        docs.select(
            F.col(key).alias("id"),
            F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, "").alias("content"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("length"),
        )
        .withColumn("sha", sha)
        .withColumn("digest", digest(F.col("content")) if digest else F.col("sha"))
    )
    alike = rows.groupBy("id", "sha", "digest", "length").agg(F.count("*").alias("m"))
    light = ws.put(alike, "light")
    counts = ws.put(light.groupBy("digest").agg(F.sum("m").alias("rows")), "counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = counts.filter(F.col("rows") >= max(2, HOT_SHARE * total)).select("digest", F.lit(True).alias("hot"))
    salted = (
        rows.join(F.broadcast(hot), "digest", "left")
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(0))
        .groupBy("digest", "content", "salt")
        .agg(
            F.max(_rank(F.col("length"), F.col("id"))).alias("rank"), F.count("*").alias("n"),
            F.max("hot").alias("hot"))
    )
    groups = ws.put(
        salted.select("digest", F.when(F.col("hot"), F.col("content")).alias("content"), "rank", "n", "hot"), "groups")
    winners = groups.filter("hot").groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
    per_digest = ws.put(
        winners.select("digest", "rank", "n").unionByName(groups.filter("not hot").select("digest", "rank", "n"))
        .groupBy("digest").agg(F.count("*").alias("contents"), F.max("rank").alias("rank"), F.max("n").alias("n")),
        "digests")
    clear = per_digest.filter("contents = 1").select("digest", "rank", "n")
    at_once = clear.join(F.broadcast(hot), "digest", "left_semi")  # at most 1 / HOT_SHARE rows
    kept = light.join(F.broadcast(at_once), "digest").unionByName(
        light.join(F.broadcast(hot), "digest", "left_anti").join(clear, "digest")).select("id", "sha", "length", "m", "rank", "n")
    clash = per_digest.filter("contents > 1").select("digest")
    if clash.limit(1).count():
        apart = salted.join(clash, "digest", "left_semi").groupBy("digest", "content").agg(
            F.max("rank").alias("rank"), F.sum("n").alias("n"))
        more = rows.join(clash, "digest", "left_semi").groupBy("id", "sha", "length", "digest", "content").agg(
            F.count("*").alias("m")).join(apart, ["digest", "content"])
        kept = kept.unionByName(more.select("id", "sha", "length", "m", "rank", "n"))
    keep_id = _key_of(F.col("rank"))
    each = kept.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    return ws.result(each.select(
        F.col("id").alias(key),
        keep_id.alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("nth") == 1) & (_rank(F.col("length"), F.col("id")) == F.col("rank"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    ))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat a key and a text, one.

    Whole rows are shuffled once: rows with equal key and digest are reduced to the longest, first in each task,
    and meet the keys that stay in the same partitioning; equally long ones go by code point order of the text. Null keys and empty tables are taken as in :func:`exact_dedup`.
    """
    own_key = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    found = exact_dedup(docs, key, text).filter("kept").select(
        own_key.alias("_own_key"), F.col("text_sha256").alias("_own_sha")).distinct()
    content = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, "")
    first = Window.partitionBy("_own_key", "_own_sha").orderBy(
        F.char_length(F.coalesce(F.col(text), F.lit(""))).desc(), F.col(text).asc_nulls_last())
    return (
        docs.withColumns({"_own_key": own_key, "_own_sha": F.sha2(content.cast("binary"), 256)})
        .withColumn("_own_nth", F.row_number().over(first)).filter("_own_nth = 1")
        .join(found, ["_own_key", "_own_sha"], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    )
