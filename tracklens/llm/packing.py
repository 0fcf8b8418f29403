"""Hierarchical multi-length packing of token ids into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import on_workers
from tracklens.llm.tokens import encoder, tokenizer_path

#: Context sizes, longest first; the longest is the sequence limit.
TIERS = (1024, 512, 256, 128)
#: Ids that a worker holds at once; packing goes on from block to block.
BLOCK_IDS = 1 << 20
#: Tokens of one training step: as many sequences of one tier as make up this number.
STEP_TOKENS = 16_384
END_ID = 0
#: Texts that are held as Python strings at once.
BATCH = 256
_TASK_BITS = 36


@dataclass(slots=True)
class Piece:
    """Some consecutive ids of one document."""

    doc: object
    ids: memoryview
    start: int
    length: int
    doc_tokens: int

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (
            Piece(self.doc, self.ids, self.start, n, self.doc_tokens),
            Piece(self.doc, self.ids, self.start + n, self.length - n, self.doc_tokens),
        )

    def crc32(self) -> int:
        return zlib.crc32(self.ids[4 * self.start : 4 * (self.start + self.length)])


class Pool:
    """Pieces by length; the set of lengths present is one integer, so that the longest piece not
    above a gap is found at once."""

    def __init__(self):
        self.by_length: dict[int, list[Piece]] = {}
        self.present = 0

    def add(self, piece: Piece) -> None:
        self.by_length.setdefault(piece.length, []).append(piece)
        self.present |= 1 << piece.length

    def take(self, most: int, least: int = 1) -> Piece | None:
        """The longest piece of ``least`` to ``most`` ids; first come, first served."""
        n = (self.present & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < least:
            return None
        same = self.by_length[n]
        piece = same.pop()
        if not same:
            self.present ^= 1 << n
        return piece

    def take_above(self, more: int) -> Piece | None:
        """The shortest piece of more than ``more`` ids."""
        above = self.present >> (more + 1)
        if not above:
            return None
        n = more + (above & -above).bit_length()
        return self.take(n, n)


class Packer:
    """Packs one task's documents, block by block.

    Documents are cut into whole windows of the longest tier; what is left goes to the shortest
    tier that holds it. Tiers are packed from the longest to the shortest: the piece that opens a
    sequence leaves a gap, which is filled with the longest fitting pieces, mostly of shorter
    tiers, and when nothing fits any more by cutting the shortest piece that is too long. A
    sequence that cannot be filled from this block waits for the next one.
    """

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.base = task << _TASK_BITS
        self.sequences = self.steps = 0
        self.open_step: dict[int, tuple[int, int]] = {}
        self.pool = Pool()
        self.full: list[Piece] = []
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        view, total, top = memoryview(ids), len(ids) // 4, self.tiers[0]
        self.held += total
        whole = total - total % top
        for at in range(0, whole, top):
            self.full.append(Piece(doc, view, at, top, total))
        if whole < total:
            self.pool.add(Piece(doc, view, whole, total - whole, total))

    def emit(self, pieces: list[Piece], tier: int) -> None:
        step, used = self.open_step.get(tier, (0, self.step_tokens))
        if used + tier > self.step_tokens:
            step, used = self.base + self.steps, 0
            self.steps += 1
        self.open_step[tier] = (step, used + tier)
        at, seq = 0, self.base + self.sequences
        self.sequences += 1
        for p in pieces:
            self.rows.append((p.doc, p.start, p.length, p.crc32(), p.doc_tokens, seq, at, tier, step))
            at += p.length

    def fill(self, opened: Piece, size: int) -> tuple[list[Piece], int]:
        pieces, gap = [opened], size - opened.length
        while gap:
            fits = self.pool.take(gap)
            if fits is None:
                longer = self.pool.take_above(gap)
                if longer is None:
                    break
                fits, rest = longer.cut(gap)
                self.pool.add(rest)
            pieces.append(fits)
            gap -= fits.length
        return pieces, gap

    def pack(self, last: bool = False) -> None:
        for piece in self.full:
            self.emit([piece], self.tiers[0])
        self.full = []
        waiting: list[Piece] = []
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while (opened := self.pool.take(tier, below + 1)) is not None:
                pieces, gap = self.fill(opened, tier)
                if gap:
                    waiting.extend(pieces)
                    break
                self.emit(pieces, tier)
        if last:
            self.finish(waiting)
        else:
            for piece in waiting:
                self.pool.add(piece)
        self.held = sum(p.length for same in self.pool.by_length.values() for p in same)

    def finish(self, rest: list[Piece]) -> None:
        """The task's last few pieces, in sequences of falling powers of two: no padding."""
        while rest:
            total = sum(p.length for p in rest)
            size = min(self.tiers[0], 1 << (total.bit_length() - 1))
            pieces, gap = [], size
            while gap:
                piece = rest.pop(0)
                if piece.length > gap:
                    piece, after = piece.cut(gap)
                    rest.insert(0, after)
                pieces.append(piece)
                gap -= piece.length
            self.emit(pieces, size)


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Packs the token ids of all documents into sequences; one row per piece.

    A document's ids are the tokenizer's for its whole text (null: empty) and then id 0. Each id
    lies in exactly one piece. Every sequence is as long as its tier, a power of two, so there is
    no padding; only a task's last pieces make shorter powers of two.

    Every task packs its own rows in blocks of about ``block_ids`` ids: no shuffle, no state
    beyond a block, and a task that is run again gives the same rows. ``sequence_id`` and
    ``step_id`` carry the task's number in their upper bits. A step gathers sequences of one tier
    up to ``step_tokens``, so that full steps weigh the same whatever their tier.

    Returns ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens,
    step_id``. Null keys pass through; repeated rows are packed once each; other columns are
    ignored; an empty table gives an empty result.
    """
    path = tokenizer or tokenizer_path()
    on_workers(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_id"]
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, " + ", ".join(f"`{n}` bigint" for n in names)
    end = END_ID.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        doc_type = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * 9
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["doc", *names])

        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            doc_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc, enc.id_bytes(text) + end)
                if packer.held >= block_ids:
                    packer.pack()
                    yield out()
        if doc_type is not None:
            packer.pack(last=True)
            yield out()

    return rows.mapInArrow(pack, schema).withColumnRenamed("doc", key)
