"""Token ids in files of their own format, written and read as a Spark data source.

A folder holds ``_table.bin`` (the frequencies that all files share), ``_manifest.json`` (the files in order, with the ids and rows before
each) and the files. A file is blocks of coded ids (:mod:`tracklens.llm.rans`), then an Arrow table of its rows' keys and lengths, then a
JSON footer with the places of both and their checksums. Files are opened through ``pyarrow.fs``, so the folder may lie in any store it knows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tracklens.llm import rans
from tracklens.llm.common import Workspace, on_workers, shared_dir
from tracklens.llm.tokens import tokenizer_path
from tracklens.llm.words import word_encoder

FORMAT = "rans_ids"
TOKENIZER_FILE = "word_bpe_49k.json"
#: The id behind the last one of each document.
END_ID = 1
#: Ids of one file, unless a single row has more, and ids that one task decodes.
FILE_IDS = 1 << 26
TASK_IDS = 1 << 22
#: Texts of which ids are held at once.
BATCH = 256
#: Texts that are encoded together, and their bytes unless the last one has more.
TEXTS, TEXT_BYTES = 1024, 4 << 20
_TAIL = struct.Struct("<II4s")  # size and checksum of the footer


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner.rstrip("/")


def _read(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read()


def _write(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Under another name first, so that nobody sees half a file."""
    hidden = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as f:
        f.write(data)
    fs.move(hidden, path)


@dataclass
class WrittenFiles(WriterCommitMessage):
    files: list[dict]


class _FileWriter:
    """One file: ids are coded a block at a time, so no more than a block of ids and the lengths are held."""

    def __init__(self, fs, folder: str, table: rans.FrequencyTable, part: int, first: int, key_type: pa.DataType):
        self.name = f"ids-{part:06d}-{first:012d}-{uuid.uuid4().hex}.bin"
        self.fs, self.path, self.table = fs, f"{folder}/{self.name}", table
        self.part, self.first, self.next, self.key_type = part, first, first, key_type
        self.out = fs.open_output_stream(self.path)
        self.at = self.out.write(b"rANf")
        self.blocks, self.keys, self.lengths, self.held, self.n_held, self.n_ids = [], [], [], [], 0, 0

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.next += 1
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= rans.BLOCK_IDS:
            ids = np.concatenate(self.held)
            whole = len(ids) // rans.BLOCK_IDS * rans.BLOCK_IDS
            for begin in range(0, whole, rans.BLOCK_IDS):
                self._block(ids[begin : begin + rans.BLOCK_IDS])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        self._put(self.blocks, rans.encode_block(ids, self.table, segment=rans.SEGMENT_IDS))

    def _put(self, places: list, data: bytes) -> None:
        self.out.write(data)
        places.append([self.at, len(data)])
        self.at += len(data)

    def close(self) -> dict:
        if self.n_held:
            self._block(np.concatenate(self.held))
        sink = pa.BufferOutputStream()
        rows = pa.table({"key": pa.array(self.keys, self.key_type), "n": pa.array(self.lengths, pa.int64())})
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(rows)
        index, data = [], sink.getvalue().to_pybytes()
        self._put(index, data)
        footer = json.dumps({"block_ids": rans.BLOCK_IDS, "segment_ids": rans.SEGMENT_IDS, "blocks": self.blocks, "index": [*index[0], zlib.crc32(data)]}).encode()
        self.out.write(footer + _TAIL.pack(len(footer), zlib.crc32(footer), b"rANf"))
        self.out.close()
        return {"name": self.name, "part": self.part, "first": self.first, "rows": len(self.lengths), "ids": self.n_ids}


class IdWriter(DataSourceArrowWriter):
    """Rows ``part, row, key, ids`` (``ids`` as :func:`packed`), each part's rows in order.

    A file ends where the next row does not follow the last one, so however Spark splits its input, files hold
    unbroken stretches and the manifest puts them in order. Files carry random names and count only once the
    driver has written the manifest: a task that is run again leaves files that nobody reads.
    """

    def __init__(self, schema: StructType, folder: str):
        self.folder, self.key = folder, schema["key"].dataType.json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        fs, folder = _store(self.folder)
        table, out, done = None, None, []
        for batch in iterator:
            parts, places, keys, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "row", "key", "ids"))
            for part, place, key, data in zip(parts.to_pylist(), places.to_pylist(), keys.to_pylist(), ids):
                if out is not None and (part != out.part or place != out.next or out.n_ids >= FILE_IDS):
                    done.append(out.close())
                    out = None
                if out is None:
                    table = table or rans.FrequencyTable.from_bytes(_read(fs, f"{folder}/_table.bin"))
                    out = _FileWriter(fs, folder, table, part, place, keys.type)
                out.add(key, unpacked(data.as_py()))
        if out is not None:
            done.append(out.close())
        return WrittenFiles(done)

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        fs, folder = _store(self.folder)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["part"], f["first"]))
        rows = ids = 0
        for f in files:
            f |= {"rows_before": rows, "ids_before": ids}
            rows, ids = rows + f["rows"], ids + f["ids"]
        _write(fs, f"{folder}/_manifest.json", json.dumps({"key": self.key, "rows": rows, "ids": ids, "files": files}).encode())

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        fs, folder = _store(self.folder)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{folder}/{f['name']}")


@dataclass
class Stretch(InputPartition):
    """The rows of a file whose first id lies in ``[low, high)`` (ids of the file)."""

    name: str
    ids_before: int
    low: int
    high: int


class IdReader(DataSourceReader):
    """``key, start, n_ids, ids``: a task per :data:`TASK_IDS` ids, decoded from the checkpoint before its first row on."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Stretch]:
        fs, folder = _store(self.folder)
        files = json.loads(_read(fs, f"{folder}/_manifest.json"))["files"]
        out = [Stretch(f["name"], f["ids_before"], low, min(low + TASK_IDS, f["ids"])) for f in files for low in range(0, f["ids"], TASK_IDS)]
        return out or [Stretch("", 0, 0, 0)]

    def read(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        if not stretch.name:
            return
        fs, folder = _store(self.folder)
        table = rans.FrequencyTable.from_bytes(_read(fs, f"{folder}/_table.bin"))
        with fs.open_input_file(f"{folder}/{stretch.name}") as f:
            yield from _rows(f, table, stretch)


def _rows(f: pa.NativeFile, table: rans.FrequencyTable, stretch: Stretch) -> Iterator[pa.RecordBatch]:
    size = f.size()
    length, crc, magic = _TAIL.unpack(f.read_at(_TAIL.size, size - _TAIL.size))
    footer = f.read_at(length, size - _TAIL.size - length)
    if magic != b"rANf" or zlib.crc32(footer) != crc:
        raise rans.CorruptFile("footer")
    footer = json.loads(footer)
    at, length, crc = footer["index"]
    index = f.read_at(length, at)
    if zlib.crc32(index) != crc:
        raise rans.CorruptFile("index of rows")
    index = pa.ipc.open_stream(index).read_all().combine_chunks()
    lengths = index["n"].to_numpy()
    starts = np.cumsum(lengths) - lengths
    # rows hold at least one id, so starts rise
    first, last = np.searchsorted(starts, [stretch.low, stretch.high])
    ids = _Decoded(f, footer, table)
    while first < last:
        # as many rows as hold about a segment; a longer one comes alone
        until = max(first + 1, int(np.searchsorted(starts, starts[first] + footer["segment_ids"])))
        until = min(until, last)
        begin, end = int(starts[first]), int(starts[until - 1] + lengths[until - 1])
        data = ids.between(begin, end).astype("<u4", copy=False)
        offsets = np.append(starts[first:until] - begin, end - begin) * 4
        blob = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), until - first, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [index["key"].slice(first, until - first).combine_chunks(), pa.array(starts[first:until] + stretch.ids_before),
             pa.array(lengths[first:until]), blob.cast(pa.binary())], names=["key", "start", "n_ids", "ids"])
        first = until


class _Decoded:
    """Ids of a file by place; blocks' bytes and the last decoded segment are kept while a row crosses them."""

    def __init__(self, f: pa.NativeFile, footer: dict, table: rans.FrequencyTable):
        self.f, self.blocks, self.table, self.block, self.segment = f, footer["blocks"], table, (None, None, None), (None, None)
        self.block_ids, self.segment_ids = footer["block_ids"], footer["segment_ids"]

    def _segment(self, k: int) -> np.ndarray:
        if self.segment[0] != k:
            number, inner = divmod(k, self.block_ids // self.segment_ids)
            if self.block[0] != number:
                at, length = self.blocks[number]
                data = self.f.read_at(length, at)
                self.block = number, data, rans.Block.parse(data)
            self.segment = k, rans.decode_segment(self.block[1], self.block[2], inner, self.table)
        return self.segment[1]

    def between(self, begin: int, end: int) -> np.ndarray:
        n = self.segment_ids
        return np.concatenate([self._segment(k)[max(0, begin - k * n) : end - k * n] for k in range(begin // n, -(-end // n))])


class IdFiles(DataSource):
    """Spark format ``rans_ids``; register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        fs, folder = _store(self.options["path"])
        key = json.loads(json.loads(_read(fs, f"{folder}/_manifest.json"))["key"])
        field = lambda name, kind: {"name": name, "type": kind, "nullable": True, "metadata": {}}
        return StructType.fromJson({"type": "struct", "fields": [
            field("key", key), field("start", "long"), field("n_ids", "long"), field("ids", "binary")]})

    def reader(self, schema: StructType) -> IdReader:
        return IdReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> IdWriter:
        return IdWriter(schema, self.options["path"])


def packed(ids: np.ndarray) -> bytes:
    """Ids for a stored intermediate: the low bytes, then the second ones and so on, which compress better than ids side by side."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint32)


def _together(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of :data:`TEXTS` rows at most, each with about :data:`TEXT_BYTES` of ``column`` at most."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        before = int(ends[low - 1]) if low else 0
        high = min(low + TEXTS, max(low + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right"))))
        yield batch.slice(low, high - low)
        low = high


def ordered_ids(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """``part, row, key, ids`` of every row: texts dealt to ranges of the key and sorted, then encoded where they are.

    Ranges are cut by key and by a hash of the text, so rows that share a key (null keys, first in order) spread as well.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["key"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode_texts, part, n = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        for batch in (some for b in batches for some in _together(b, 1)):
            ids = [packed(np.append(found, end)) for found in encode_texts(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(n, n + len(ids), dtype=np.int64)), batch.column(0),
                 pa.array(ids, pa.binary())], names=["part", "row", "key", "ids"])
            n += len(ids)

    return rows.mapInArrow(encode, f"part int, row bigint, key {kind}, ids binary")


def id_counts(rows: DataFrame) -> dict[int, int]:
    """How often each id occurs: counted in tasks, added up by Spark; at most one row per id of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for some in (batch.slice(at, BATCH) for at in range(0, batch.num_rows, BATCH)):
                found = np.bincount(np.concatenate([unpacked(data) for data in some.column(0).to_pylist()]))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["id", "n"])

    found = rows.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return dict(map(tuple, found.collect()))


def write_id_files(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID
) -> None:
    """Encodes whole texts and writes them to the folder ``path`` in ascending order of ``key``, nulls first.

    The ids are the library's for the whole text without added special tokens, then ``end_id``; a null or empty text has that alone.
    Texts are moved and encoded once: the sorted ids are kept as a table in the shared folder, one pass counts them for the
    frequency table, one codes them. Repeated keys keep all their rows, in order of a hash of their texts. An empty table
    gives a folder without files. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    on_workers(spark)
    spark.dataSource.register(IdFiles)
    ws = Workspace(spark, "ids")
    held = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    try:
        rows = ws.put(ordered_ids(docs, key, text, tokenizer or tokenizer_path(TOKENIZER_FILE), end_id), "ids")
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", held)
    table = rans.FrequencyTable(rans.quantised(id_counts(rows)))
    fs, folder = _store(path)
    fs.create_dir(folder, recursive=True)
    _write(fs, f"{folder}/_table.bin", table.to_bytes())
    rows.write.format(FORMAT).mode("append").save(path)
    ws.drop()


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """``key, start, n_ids, ids`` of every row: ``start`` counts the ids of all rows before it, ``ids`` are little-endian unsigned 32-bit."""
    on_workers(spark)
    spark.dataSource.register(IdFiles)
    return spark.read.format(FORMAT).load(path)


def token_id_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every row, from files written and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tracklens-id-files-{uuid.uuid4().hex}"
    write_id_files(docs, path, key, text, tokenizer)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return read_id_files(spark, path).select(
        F.col("key").alias(key), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
