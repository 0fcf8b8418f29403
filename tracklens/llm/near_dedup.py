"""MinHash near-dedup of documents: circulant signatures, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import Workspace, on_workers
from tracklens.llm.components import connected_components
from tracklens.llm.shingles import band_keys, circulant_minhash, common, shingle_set
from tracklens.llm.skew import join_dealt

WIDTH = 5
PERCENT = 80
#: 45 bands of 6 rows miss a pair at similarity 0.8 once in 900,000, one at 0.85 once in 10^9, and
#: bring pairs at 0.2 together once in 350 times.
BANDS, ROWS = 45, 6
#: Rounds in which the members of an open bucket meet one member drawn at random.
ANCHOR_ROUNDS = 2
#: Bytes of sets, and sets on the other side, that meet in one task's row of the last round.
CHUNK_BYTES = 1 << 20
CHUNK_SETS = 64
#: Members of a bucket that meet another such portion in one task's row.
PORTION = 256
#: Tasks that the classes of one bucket are dealt over when they meet what is known of the bucket.
SALTS = 8
#: Estimates from the signature that lie this far below the threshold are not looked at: with 270
#: coordinates that is six standard deviations at similarity 0.8.
MARGIN = 0.15


def _hashed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``id, n, fp, buckets`` of every document; ``fp`` is a 128-bit digest of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            sets = [shingle_set(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            some = [s for s in sets if len(s)]
            keys = iter(band_keys(circulant_minhash(some, bands * rows), bands)) if some else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                names=["id", "n", "fp", "buckets"],
            )

    return docs.mapInArrow(run, "id bigint, n bigint, fp binary, buckets array<bigint>")


def _sets(docs: DataFrame, width: int, size: int) -> DataFrame:
    """``cls, n, fp, shingles, sign``: the full sets, and 16 bits of each signature coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            sets = [shingle_set(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keep = [i for i, s in enumerate(sets) if len(s)]
            sets = [sets[i] for i in keep]
            signs = circulant_minhash(sets, size).astype("<u2") if sets else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array([g.tobytes() for g in signs], pa.binary()),
                ],
                names=["cls", "n", "fp", "shingles", "sign"],
            )

    return docs.mapInArrow(run, "cls bigint, n bigint, fp binary, shingles binary, sign binary")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)``, a written table, whose full sets are similar enough.

    One class may be in a third of the pairs: those are dealt over tasks, with a copy of its set each."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = join_dealt(join_dealt(pairs, right, "b", "a"), left, "a", "b", keys=pairs).filter(sized).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hit = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)]
            yield batch.filter(pa.array(hit, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _verify_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Links between the sets of two short lists in a row; a link for each member is enough for
    every set on the left, as the right-hand members share a component already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                right = [(y["cls"], np.frombuffer(y["shingles"], np.uint64)) for y in ys]
                for x in xs:
                    own = np.frombuffer(x["shingles"], np.uint64)
                    for other, theirs in right:
                        if _linked(own, theirs, percent):
                            a.append(x["cls"])
                            b.append(other)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.select("xs", "ys").mapInArrow(run, "a bigint, b bigint")


def _by_bucket(many: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined with the rows of ``few``, one or none a bucket: a bucket's classes are dealt over ``SALTS``
    tasks, each with its own copy of the short row in ``few``, so that no task gets a whole crowded bucket."""
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(F.lit(3), "cls"), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["bucket", "_salt"], how).drop("_salt")


def near_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    margin: float | None = MARGIN,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    1. Documents with equal sets form a class (its smallest key stands for it), so exact copies
       cost one row each and are never paired.
    2. Each class falls into ``bands`` buckets by its circulant MinHash signature.
    3. In each bucket every class meets the bucket's first one; pairs are confirmed on full sets and
       linked classes get a common label.
    4. A bucket whose classes all share a label is done. In the others, classes meet members of
       another label drawn at random, a fresh draw for each bucket and round; last, whatever
       still differs is compared in full, set against chunks of sets of another label. So a large
       group costs about a link for each member, not all its pairs, and no two similar classes
       that share a bucket stay apart. Of these last comparisons, those are left out whose signatures
       estimate a similarity more than ``margin`` below the threshold; None compares them all.

    Sets are sets of 64-bit shingle hashes, and sets with the same 128-bit digest count as equal.

    Returns ``key, n_shingles, component_id, kept`` per row. Null, empty and blank texts have an empty set:
    ``n_shingles`` 0, linked with nothing. Rows with a null key get their class's smallest key
    (null if there is none). A key that repeats with other texts is one document: links of any of
    its texts count for it. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    on_workers(spark)
    body = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = ws.put(_hashed(body, width, bands, rows), "hashed")
    classes = ws.put(
        hashed.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("cls"), F.first("buckets").alias("buckets")),
        "classes")
    exploded = classes.filter("cls is not null").select("cls", F.explode("buckets").alias("bucket"))
    shared = (
        exploded.groupBy("bucket").agg(F.min("cls").alias("first"), F.max("cls").alias("last"))
        .filter("first <> last").select("bucket", "first"))
    members = ws.put(_by_bucket(exploded, shared), "members")
    needed = members.select("cls").distinct()
    chosen = join_dealt(body, needed.select(F.col("cls").alias("id")), "id", "text", keys=hashed)
    sets = _sets(chosen, width, bands * rows).join(classes.select("fp", "cls"), ["fp", "cls"], "left_semi")
    sets = ws.put(sets.dropDuplicates(["fp", "cls"]).select("cls", "n", "shingles", "sign"), "sets")

    several = hashed.filter("fp is not null").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    same_key = join_dealt(
        join_dealt(hashed.select("id", "fp"), several.select("id"), "id", "fp", keys=hashed), classes.select("fp", "cls"), "fp", "id",
        keys=hashed).select(F.col("id").alias("a"), F.col("cls").alias("b"))
    pairs = ws.put(members.filter("first <> cls").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct(), "pairs")
    links = _verify(pairs, sets, percent).unionByName(same_key)
    labels = ws.put(connected_components(ws, links), "labels-first")

    def labelled() -> DataFrame:
        return members.select("bucket", "cls").join(
            labels.select(F.col("node").alias("cls"), "label"), "cls", "left"
        ).withColumn("label", F.coalesce("label", "cls"))

    def merge(found: DataFrame, name: str) -> DataFrame:
        """Labels after more links between classes."""
        links = ws.put(found, f"links-{name}")
        if not links.limit(1).count():
            return labels
        own = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = join_dealt(join_dealt(links, own, "a", "b", "left"), other, "b", "a", "left", keys=links).select(
            F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        up = connected_components(ws, edges).select(F.col("node").alias("old"), F.col("label").alias("new"))
        nodes = labels.unionByName(
            links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            .join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
        nodes = ws.put(nodes, f"nodes-{name}")
        return ws.put(
            join_dealt(nodes, up.withColumnRenamed("old", "label"), "label", "node", "left").select(
                "node", F.coalesce("new", "label").alias("label")),
            f"labels-{name}")

    def open_members(name: str) -> DataFrame:
        rows = labelled()
        open_buckets = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        return ws.put(_by_bucket(rows, open_buckets.select("bucket"), "left_semi"), f"open-{name}")

    rest = open_members("first")
    for turn in range(ANCHOR_ROUNDS):
        if not rest.limit(1).count():
            break
        draw = F.min(F.struct(F.xxhash64(F.lit(turn), "bucket", "cls").alias("h"), "cls", "label")).alias("anchor")
        anchors = rest.groupBy("bucket").agg(draw).select(
            "bucket", F.col("anchor.cls").alias("anchor"), F.col("anchor.label").alias("anchor_label"))
        pairs = ws.put(_by_bucket(rest, anchors).filter("label <> anchor_label").select(
            F.least("anchor", "cls").alias("a"), F.greatest("anchor", "cls").alias("b")).distinct(), f"pairs{turn}")
        labels = merge(_verify(pairs, sets, percent), f"turn{turn}")
        rest = open_members(f"turn{turn}")
    if rest.limit(1).count():
        labels = merge(_verify_blocks(_rest_blocks(ws, rest, sets, percent, margin), percent), "last")

    light = hashed.filter("fp is not null").select("id", "n", "fp")
    per_class = classes.select("fp", "cls").join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").select(
        "fp", F.coalesce("label", "cls").alias("component_id"))
    result = (
        join_dealt(light, per_class, "fp", None)  # a text with a third of the rows is one class
        .select("id", "n", "component_id")
        .unionByName(hashed.filter("fp is null").select("id", "n", F.col("id").alias("component_id")))
    )
    return ws.result(
        result.select(
            F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))


def _rest_blocks(ws: Workspace, rest: DataFrame, sets: DataFrame, percent: int, margin: float | None) -> DataFrame:
    """Rows ``(xs, ys)`` of set lists that cover every pair of different labels in a bucket.

    Labels are cut into chunks of at most about ``CHUNK_BYTES``. Where two classes of different
    labels meet in a bucket and their sizes and signatures do not rule out that they are similar,
    the larger label gives the chunk and the class of the smaller one is compared with all of it.
    Members of a bucket meet in portions, two portions a row, so no task sees a whole large bucket.
    """
    classes = rest.select("cls", "label").distinct().join(
        sets.groupBy("cls").agg(F.sum("n").alias("n")), "cls")
    sizes = classes.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("many"))
    chunked = ws.put(
        classes.join(sizes, "label").select(
            "cls", "label", "many",
            F.pmod(F.xxhash64("cls"), F.ceil(8 * F.col("total") / CHUNK_BYTES)).alias("chunk")), "chunks")
    crowd = rest.groupBy("bucket").agg(F.count("*").alias("m"))
    portions = ws.put(
        _by_bucket(rest.select("bucket", "cls"), crowd)
        .withColumn("portion", F.pmod(F.xxhash64(F.lit(2), "cls"), F.ceil(F.col("m") / PORTION)))
        .join(chunked, "cls").join(sets.select("cls", "n", "sign"), "cls")
        .groupBy("bucket", "portion")
        .agg(F.collect_list(F.struct("cls", "label", "many", "chunk", "n", "sign")).alias("members")), "portions")
    other = portions.select("bucket", F.col("portion").alias("portion_b"), F.col("members").alias("b"))
    meet = portions.withColumnRenamed("members", "a").join(other, "bucket").filter("portion <= portion_b")
    items = ws.put(_plausible(meet, percent, margin).distinct(), "items")
    many = items.groupBy("to", "chunk").agg(F.count("*").alias("x"))
    xs = (
        items.join(many, ["to", "chunk"])
        .withColumn("part", F.pmod(F.xxhash64(F.lit(1), "cls"), F.ceil(F.col("x") / CHUNK_SETS)))
        .join(sets.select("cls", "shingles"), "cls")
        .groupBy("to", "chunk", "part").agg(F.collect_list(F.struct("cls", "shingles")).alias("xs")))
    ys = (
        chunked.select("cls", F.col("label").alias("to"), "chunk")
        .join(items.select("to", "chunk").distinct(), ["to", "chunk"], "left_semi")
        .join(sets.select("cls", "shingles"), "cls")
        .groupBy("to", "chunk").agg(F.collect_list(F.struct("cls", "shingles")).alias("ys")))
    return xs.join(ys, ["to", "chunk"])


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each component, the one with the smallest key, with all columns of ``docs``.

    Rows that share a key count as one document, rows without a key likewise: they all stay when one of them
    stands for its component. Empty tables give empty results.
    """
    kept = near_dedup(docs, key, text, **how).filter("kept").select(F.col(key).alias("_kept")).distinct()
    return docs.join(kept, docs[key].cast("bigint").eqNullSafe(kept["_kept"]), "left_semi")


def _plausible(blocks: DataFrame, percent: int, margin: float | None) -> DataFrame:
    """``cls, to, chunk``: classes of two portions ``a, b`` of a bucket, with the chunks to compare them with."""
    names = ("cls", "label", "many", "chunk", "n")

    def parts(members: list) -> tuple[dict, np.ndarray]:
        signs = np.frombuffer(b"".join(m["sign"] for m in members), dtype="<u2").reshape(len(members), -1)
        return {k: np.array([m[k] for m in members], dtype=np.int64) for k in names}, signs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int, int]] = set()
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (a, sa), (b, sb) = parts(one), parts(two)
                least = 0 if margin is None else (percent / 100 - margin) * sa.shape[1]
                for i in range(len(one)):
                    n = a["n"][i]
                    might = (b["label"] != a["label"][i]) & (100 * n >= percent * b["n"]) & (100 * b["n"] >= percent * n)
                    at = np.flatnonzero(might)
                    at = at[(sb[at] == sa[i]).sum(axis=1) >= least]
                    for j in at.tolist():
                        smaller = (a["many"][i], a["label"][i]) < (b["many"][j], b["label"][j])
                        x, y, p, q = (a, b, i, j) if smaller else (b, a, j, i)
                        found.add((int(x["cls"][p]), int(y["label"][q]), int(y["chunk"][q])))
            rows = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["cls", "to", "chunk"])

    return blocks.select("a", "b").mapInArrow(run, "cls bigint, to bigint, chunk bigint")
