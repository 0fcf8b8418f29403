"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import Workspace
from tracklens.llm.skew import join_unique

#: Byte limit of a shard, in UTF-8 bytes of text.
LIMIT_BYTES = 4 << 20
HASH_BITS = 60
#: Limits' worth of overflowing rows in a chain of pages, and the size classes of rows in a chain.
CHAIN_LIMITS, SIZE_CLASSES = 32, 8
#: Directory bits that are counted ahead in one pass over the rows.
STEP_BITS = 4


def extendible_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES
) -> DataFrame:
    """Assigns every row to a shard of at most ``limit`` bytes; one output row per input row.

    The directory is indexed by the leading bits of a hash of the key (the first 60 bits of its md5).
    It starts as one bucket; only a bucket above the limit splits, on its next bit, until all
    fit. A shard is named by its bits; its ``depth`` is their number.

    Sizes are counted for cells of ``STEP_BITS`` more bits than the data needs on average, and added up
    bit by bit (:func:`_shards`), so one pass over the rows usually settles all splits; only cells that
    are still too large are counted again with more bits. The directory itself is a table: rows
    join it by cell in a merge join, so it is never broadcast and does not pass through the driver.

    A row larger than the limit cannot be split and has a shard of its own or with rows of the
    same hash; so have rows that repeat a key, whose hash cannot tell them apart: they overflow into
    numbered pages (``page``), filled in parallel chains of salted rows. Rows are numbered once, in the table that
    the operator writes first, so a task that runs again deals the same pages.

    Returns ``key, n_bytes, shard, depth, page, shard_bytes``. Null texts have 0 bytes, null keys hash
    like the empty text. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    name = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    rows = ws.put(
        docs.select(
            F.col(key).alias("id"),
            F.coalesce(F.octet_length(key if text is None else text), F.lit(0)).cast("bigint").alias("n_bytes"),
            F.conv(F.substring(name, 1, HASH_BITS // 4), 16, 10).cast("bigint").alias("hash"),
            F.monotonically_increasing_id().alias("row")), "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(1, -(-total // limit) - 1).bit_length() + STEP_BITS)
    cells = rows.groupBy(F.shiftright("hash", HASH_BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    closed, level = None, 0
    while True:
        cells = ws.put(cells, f"cells{bits}")
        part = _shards(ws, cells, level, bits, limit).withColumn("cell_bits", F.lit(bits))
        closed = part if closed is None else closed.unionByName(part)
        open_cells = cells.filter(~_fits(limit)).select("cell")
        if not open_cells.limit(1).count() or bits == HASH_BITS:
            break
        more = min(HASH_BITS, bits + STEP_BITS)
        finer = rows.withColumn("cell", F.shiftright("hash", HASH_BITS - bits)).join(
            open_cells.hint("merge"), "cell", "left_semi")
        level, bits = bits + 1, more
        cells = finer.groupBy(F.shiftright("hash", HASH_BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    closed = ws.put(closed, "directory")
    out, left = None, rows
    for (b,) in closed.select("cell_bits").distinct().orderBy("cell_bits").collect():
        wide = F.expr(f"cast(shiftleft(1L, {b} - depth) as bigint)")
        own = closed.filter(F.col("cell_bits") == b).select(
            F.explode(F.sequence(F.col("prefix") * wide, (F.col("prefix") + 1) * wide - 1)).alias("cell"),
            F.expr("lpad(conv(cast(prefix as string), 10, 2), depth, '0')").alias("shard"), "depth", "shard_bytes")
        at = left.withColumn("cell", F.shiftright("hash", HASH_BITS - b))
        hit = at.join(own.hint("merge"), "cell").select(
            "id", "n_bytes", "shard", "depth", F.lit(0).cast("bigint").alias("page"), "shard_bytes")
        out = hit if out is None else out.unionByName(hit)
        left = at.join(own.select("cell").hint("merge"), "cell", "left_anti").drop("cell")
    if open_cells.limit(1).count():  # hashes that all bits cannot tell apart
        out = _pages(left, limit) if out is None else out.unionByName(_pages(left, limit))
    if out is None:
        out = rows.select("id", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"),
                          F.lit(0).cast("bigint").alias("page"), F.col("n_bytes").alias("shard_bytes"))
    return ws.result(out.select(F.col("id").alias(key), "n_bytes", "shard", "depth", "page", "shard_bytes"))


def _fits(limit: int):
    return (F.col("b") <= limit) | (F.col("n") == 1)


def _shards(ws: Workspace, cells: DataFrame, level: int, bits: int, limit: int) -> DataFrame:
    """``prefix, depth, shard_bytes``: the shortest prefixes, of ``level`` bits at least, that fit.

    Sizes are added up bit by bit from the cells: a prefix goes on as long as it fits together with its sibling, else
    it is a shard. Tables halve from level to level, and the climb ends where nothing fits any more.
    """
    at, depth, found = cells.select(F.col("cell").alias("prefix"), "b", "n", _fits(limit).alias("fits")), bits, []
    while depth > level:
        up = at.groupBy(F.shiftright("prefix", 1).alias("up")).agg(
            F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("fits").alias("all_fit"),
            F.collect_list(F.struct("prefix", "b", "fits")).alias("parts"))
        up = ws.put(up.select(
            F.col("up").alias("prefix"), "b", "n", (F.col("all_fit") & _fits(limit)).alias("fits"), "parts"), f"sizes{depth - 1}")
        found.append(up.filter("not fits").select(F.explode("parts").alias("p")).filter("p.fits").select(
            "p.prefix", F.lit(depth).alias("depth"), F.col("p.b").alias("shard_bytes")))
        at, depth = up.drop("parts"), depth - 1
        if not at.filter("fits").limit(1).count():
            break
    found.append(at.filter("fits").select("prefix", F.lit(depth).alias("depth"), F.col("b").alias("shard_bytes")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows that share a whole hash.

    A hash has a chain of pages for every ``CHAIN_LIMITS`` limits of bytes; its rows go to chains by a salt of their number. In a
    chain, rows of ``limit / 2**(k + 1)`` to ``limit / 2**k`` bytes fill pages of their own (``k`` of 1 to ``SIZE_CLASSES``, the last
    with all smaller rows): bytes add up row by row, and a page takes the rows that begin within one stretch of
    ``limit - limit / 2**k``, so it holds at most the limit, and all but the last of a chain nearly
    that where rows are small. Rows above half the limit have a page each.
    """
    from pyspark.sql import Window

    chains = rows.groupBy("hash").agg(F.ceil(F.sum("n_bytes") / (CHAIN_LIMITS * limit)).alias("chains")).withColumn(
        "chains", F.greatest("chains", F.lit(1)))
    size_class = sum(((F.col("n_bytes") * (1 << k)) <= limit).cast("bigint") for k in range(1, SIZE_CLASSES + 1))
    salted = join_unique(rows, chains, ["hash"]).withColumns({
        "chain": F.pmod(F.xxhash64("hash", "row"), F.col("chains")), "size_class": size_class})
    chain = Window.partitionBy("hash", "chain", "size_class").orderBy("row")
    before = F.coalesce(F.sum("n_bytes").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the largest row of a class has limit >> class bytes at most
    stretch = F.greatest(F.lit(1), F.lit(limit) - F.expr(f"shiftright({limit}L, cast(size_class as int))"))
    place = F.when(F.col("size_class") == 0, F.row_number().over(chain).cast("bigint") - 1).otherwise(F.floor(before / stretch))
    page = (place * (SIZE_CLASSES + 1) + F.col("size_class")) * F.col("chains") + F.col("chain") + 1
    paged = salted.withColumn("page", page.cast("bigint"))
    size = paged.groupBy("hash", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    return paged.join(size, ["hash", "page"]).select(
        "id", "n_bytes", F.lpad(F.conv(F.col("hash").cast("string"), 10, 2), HASH_BITS, "0").alias("shard"),
        F.lit(HASH_BITS).alias("depth"), "page", "shard_bytes")
