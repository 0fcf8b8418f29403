"""Sinks and the re-run rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions import boxes, paths


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """Line JSON. Files of most codecs are read by one task each; readers tell the codec by the files' names."""
    df.write.mode(mode).option("compression", compression).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once, and read back by all that need it."""
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: tuple[str, ...] = ("camera_id", "video_id"), buckets: int = 64) -> DataFrame:
    """Writes ``df`` as table ``table`` in ``buckets`` buckets of ``keys`` below ``path`` and gives the table.

    Tables with the same keys and buckets join on these keys where they lie, without a shuffle of either.
    """
    rows = df.repartition(buckets, *keys)  # one file a bucket, whatever the input's partitions are
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_observed(df: DataFrame, path: str, findings: dict[str, Column], fatal: tuple[str, ...] = (), mode: str = "overwrite") -> dict[str, int]:
    """Writes ``df`` as Parquet and gives, by name, how many of its rows meet each condition: counted in the same pass, nothing is read twice.

    A row that meets a ``fatal`` condition fails the job while it writes, so nothing is committed.
    """
    from pyspark.sql import Observation

    told = Observation()
    for name in fatal:
        message = F.lit(f"a row is {name}")
        df = df.filter(F.when(F.coalesce(findings[name], F.lit(False)), F.raise_error(message).cast("boolean")).otherwise(True))
    seen = df.observe(told, *(F.count_if(c).alias(name) for name, c in findings.items()))
    seen.write.mode(mode).parquet(path)
    return {name: int(told.get[name]) for name in findings}


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows to a log; every part file has the header, which :func:`tracklens.sources.readers.read_csv` takes off."""
    df.write.mode("append").option("header", True).csv(path)


def write_report(pairs: DataFrame, path: str, true: str = "true_class", pred: str = "pred_class") -> None:
    """Confusion matrix and classification report in long form, as Parquet below ``path``."""
    from tracklens.operators.evaluation import classification_report, confusion_matrix

    write_parquet(confusion_matrix(pairs, true, pred), f"{path}/confusion_matrix")
    write_parquet(classification_report(pairs, true, pred), f"{path}/classification_report")


def missing_only(planned: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """What a re-run still has to make: planned keys that the sink does not hold."""
    return planned.join(existing.select(*keys).distinct(), keys, "left_anti")


def crop_path(split: Column, camera: Column, video: Column, cage: Column, frame: Column) -> Column:
    """Test crops in folders by camera, video and cage; others flat."""
    stem = paths.frame_stem(camera, video, frame, cage)
    nested = F.concat_ws("/", split, paths.encode_comma(camera), video, cage, stem)
    return F.when(split == "test", nested).otherwise(F.concat_ws("/", split, stem))


def square_path(camera: Column, video: Column, stem: Column, frame: Column) -> Column:
    """With a crop size every frame goes to ``train/{camera}/{video}/{stem}/{00000}.jpg``."""
    return F.concat(F.concat_ws("/", F.lit("train"), paths.encode_comma(camera), video, stem), F.lit("/"), F.format_string("%05d.jpg", frame))


def box_label_files(lines: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, body``: the label text of every frame in line order, empty for frames without a box."""
    text = boxes.label_line(F.col("class_id"), F.col("xc"), F.col("yc"), F.col("w"), F.col("h"))
    body = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", text.alias("line")))).alias("rows")).select(
        *keys, F.array_join(F.col("rows.line"), "\n").alias("body"))
    return frames.select(*keys).distinct().join(body, keys, "left").withColumn("body", F.coalesce("body", F.lit("")))


def mask_json(masks: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON object ``{cage: mask}`` for each key, cages in their order."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("cage_ord", "cage_id", "mask"))), lambda x: F.struct(x["cage_id"], x["mask"]))
    return masks.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias("body"))


def segment_index_json(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON object ``{segment: {start, end}}`` for each key."""
    rows = F.sort_array(F.collect_list(F.struct("segment_idx", F.struct("start", "end").alias("span"))))
    pairs = F.transform(rows, lambda x: F.struct(x["segment_idx"].cast("string"), x["span"]))
    return segments.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias("body"))
