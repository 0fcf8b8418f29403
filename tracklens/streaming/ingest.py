"""Incremental ingest of annotation tasks into box lines."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracklens.operators.boxes import rows_of_frames, task_lines
from tracklens.sources import schemas
from tracklens.sources.sinks import missing_only

VIDEO = ["camera_id", "video_id"]
KEYS = [*VIDEO, "track_id", "frame"]
SHUFFLES = "spark.sql.shuffle.partitions"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE_CODEC = "spark.sql.streaming.stateStore.rocksdb.compression"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def annotation_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Tasks of line-JSON files as they arrive."""
    return spark.readStream.schema(schemas.TASKS).option("maxFilesPerTrigger", max_files).json(folder)


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _runs(spark: SparkSession, sink: str) -> list[str]:
    """The folders of the queries that have written to a sink, one for each checkpoint."""
    fs, jpath = _path(spark, sink)
    found = [f.getPath().getName() for f in fs.listStatus(jpath)] if fs.exists(jpath) else []
    return [name for name in found if name.startswith("run=")]


def _start(spark: SparkSession, writer, settings: dict[str, str]) -> StreamingQuery:
    """Starts a stream under ``settings``, which a query takes from its session as it starts, and puts the session's own back."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def ingest_annotations(tasks: DataFrame, targets: DataFrame, sink: str, checkpoint: str, partitions: int | None = None,
                       state_codec: str | None = None) -> StreamingQuery:
    """Writes the boxes of all tasks that are there, and those alone that have not come before.

    ``targets`` holds ``camera_id, video_id, frame, ls_fps, fps``, or in place of ``frame`` arrays ``target_frames`` or stretches ``frame_begin, frame_end``,
    which no batch moves as rows. Boxes are told apart by camera, video, track and frame; which have come is
    keyed state of the query, kept with its checkpoint (in RocksDB unless the session names another store) and dealt over the state's
    partitions. A batch looks up its own keys there and reads nothing that was written before, so its cost does not grow with the sink. Of two boxes
    with one key the first batch's stays.

    The sink holds a folder for each batch, written aside and renamed when it is whole, so a batch that is run again finds its own and adds nothing;
    inside, folders by camera. The state has as many ``partitions`` as the session's shuffles unless told otherwise; a checkpoint's first start fixes them. Each costs
    a store to open in every batch, and a file for each camera, so few tasks want few, about one for a million boxes. Keys are names that differ
    little: ``state_codec`` ``zstd`` makes the state about half as large, and looking up slower. Tasks of one video may come in any number of batches, late or again. A checkpoint that takes over a sink which
    others have written to has no state of theirs: only then each batch of this start is also held against the keys of those others.
    Frames without any box are added when reading (:func:`ingested_lines`), as no batch can know what later ones bring.
    """
    spark = tasks.sparkSession
    run = f"run={hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"
    others = [f"{sink}/{name}" for name in _runs(spark, sink) if name != run]
    held = spark.read.option("basePath", sink).schema(schemas.BOX_LINES).parquet(*others).select(*KEYS) if others else None

    def write(batch: DataFrame, number: int) -> None:
        fs, folder = _path(spark, f"{sink}/{run}/batch={number}")
        if fs.exists(folder):
            # run again after it was written: only the keyed state is still to be brought up to date
            batch.write.format("noop").mode("overwrite").save()
            return
        aside = f"{sink}/_aside/{uuid.uuid4().hex}"
        lines = batch if held is None else missing_only(batch, held, KEYS)
        # boxes of one track beside each other: names come from the state in no order, and would fill most of a file
        lines.sortWithinPartitions(*KEYS).write.partitionBy("camera_id").option("compression", "zstd").parquet(aside)
        fs.mkdirs(folder.getParent())
        if not fs.rename(_path(spark, aside)[1], folder):
            raise OSError(f"could not rename {aside}")

    lines = task_lines(tasks, targets).dropDuplicates(KEYS)
    chosen = spark.conf.get(PROVIDER, None)
    settings = {PROVIDER: ROCKS} if chosen is None or chosen.endswith("HDFSBackedStateStoreProvider") else {}
    if state_codec is not None:
        settings[STATE_CODEC] = state_codec
    if partitions is not None:
        settings[SHUFFLES] = str(partitions)
    return _start(spark, lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True), settings)


def ingested_lines(
    spark: SparkSession, sink: str, targets: DataFrame, videos: DataFrame | None = None, columns: tuple[str, ...] = ("track_id", "class_id", "xc", "yc", "w", "h"),
) -> DataFrame:
    """What :func:`tracklens.operators.boxes.box_lines` gives for all tasks so far: the sink's boxes, and a row of nulls for
    each target frame of its videos without a box. With ``videos`` these are the videos asked for, also where the sink holds nothing of them.
    Boxes are gathered by stretches of frames with the ``columns`` asked for."""
    held = spark.read.schema(schemas.BOX_LINES).parquet(sink).select(*VIDEO, "frame", *columns)
    asked = targets.join((held if videos is None else videos).select(*VIDEO).distinct(), VIDEO, "left_semi")
    if "frame" in targets.columns:
        return asked.select(*VIDEO, "frame").join(held, [*VIDEO, "frame"], "left")
    return rows_of_frames(asked.drop("ls_fps", "fps"), held.withColumnRenamed("frame", "_at"), VIDEO, lambda f: f, scattered=True)
