"""Static range asymmetric numeral system over token ids: interleaved lanes, checkpoints, checksums.

A block codes ids on ``lanes`` interleaved 64-bit states that share one stream of 32-bit words; id ``i`` belongs to lane
``i % lanes``. All blocks use one frequency table and none needs another block. At every ``segment`` ids the
states and the place in the stream are kept, so a decoder may begin there. Each segment has a checksum of its words and one of its ids.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Frequencies add up to ``2 ** TABLE_BITS``.
TABLE_BITS = 20
LANES = 1024
SEGMENT_IDS = 1 << 18
BLOCK_IDS = 1 << 20
#: A state lies in ``[2**31, 2**63)`` between two symbols.
_LOW_BITS = 31
_LOW = np.uint64(1 << _LOW_BITS)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4sIIII")  # magic, ids, lanes, ids of a segment, words
_MAGIC = b"rANb"


class CorruptFile(ValueError):
    """Bytes that do not match their checksum."""


def quantised(counts: dict[int, int], bits: int = TABLE_BITS) -> np.ndarray:
    """Frequencies by id that add up to ``2 ** bits``; every id that was counted has at least 1.

    Each counted id gets 1 and its share of what is left, rounded down; the rest goes to the most frequent (the
    smallest of those that are equal).
    """
    seen = {i: n for i, n in counts.items() if n > 0}
    if not seen:
        return np.zeros(0, np.uint32)
    if bits > 20 or max(seen) >> 22 or len(seen) > 1 << bits:
        raise ValueError(f"{len(seen)} ids up to {max(seen)} do not fit a table of {bits} bits")
    total, free = sum(seen.values()), (1 << bits) - len(seen)
    out = np.zeros(max(seen) + 1, np.uint32)
    for i, n in seen.items():
        out[i] = 1 + n * free // total
    out[min(seen, key=lambda i: (-seen[i], i))] += (1 << bits) - int(out.sum(dtype=np.int64))
    return out


class FrequencyTable:
    """What encoding and decoding look up; frequencies of 0 are ids that cannot occur."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = np.asarray(frequencies, np.uint32)
        total = int(self.frequencies.sum(dtype=np.int64))
        self.bits = max(total, 1).bit_length() - 1
        if total and total != 1 << self.bits:
            raise ValueError("frequencies must add up to a power of two")
        self.freq = self.frequencies.astype(np.uint64)
        self.cum = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self._slots = None

    def slots(self) -> np.ndarray:
        """The id, its frequency and the place inside its stretch of every slot, in one number, so that a step looks up once."""
        if self._slots is None:
            ids = np.repeat(np.arange(len(self.freq), dtype=np.uint64), self.frequencies)
            place = np.arange(len(ids), dtype=np.uint64) - self.cum[ids]
            self._slots = ids << np.uint64(42) | self.freq[ids] << np.uint64(21) | place
        return self._slots

    def to_bytes(self) -> bytes:
        body = zlib.compress(self.frequencies.astype("<u4").tobytes())
        return b"rANt" + struct.pack("<II", zlib.crc32(body), len(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> "FrequencyTable":
        crc, size = struct.unpack_from("<II", data, 4)
        body = data[12 : 12 + size]
        if data[:4] != b"rANt" or zlib.crc32(body) != crc:
            raise CorruptFile("frequency table")
        return cls(np.frombuffer(zlib.decompress(body), "<u4"))


def encode_block(ids: np.ndarray, table: FrequencyTable, lanes: int = LANES, segment: int = SEGMENT_IDS) -> bytes:
    """One block; ``segment`` must be a multiple of ``lanes``. Few ids use fewer lanes."""
    n = len(ids)
    lanes = min(lanes, max(1, 1 << (max(n // 64, 1).bit_length() - 1)))
    bits, shift = np.uint64(table.bits), np.uint64(32 + _LOW_BITS - table.bits)
    if n and (int(ids.max()) >= len(table.freq) or not table.freq[ids].all()):
        raise ValueError("an id without frequency")
    freq, cum = table.freq[ids], table.cum[ids]
    full = freq << shift
    x = np.full(lanes, _LOW, np.uint64)
    chunks, n_words, marks = [], 0, []
    for begin in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
        end = min(n, begin + lanes)
        xs, f = x[: end - begin], freq[begin:end]
        over = np.flatnonzero(xs >= full[begin:end])
        if len(over):
            big = xs[over]
            chunks.append(big.astype(np.uint32))
            n_words += len(over)
            xs[over] = big >> _WORD
        q = xs // f
        x[: end - begin] = (q << bits) + (xs - q * f) + cum[begin:end]
        if begin % segment == 0:
            marks.append((x.copy(), n_words))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    marks = [(states, n_words - at) for states, at in marks[::-1]]
    places = [at for _, at in marks] + [n_words]
    out = [_HEAD.pack(_MAGIC, n, lanes, segment, n_words)]
    plain, stream = ids.astype("<u4"), words.astype("<u4")
    for k, (states, at) in enumerate(marks):
        out.append(struct.pack(
            "<III", at, zlib.crc32(plain[k * segment : (k + 1) * segment].tobytes()), zlib.crc32(stream[at : places[k + 1]].tobytes())))
        out.append(states.astype("<u8").tobytes())
    head = b"".join(out)
    return head + struct.pack("<I", zlib.crc32(head)) + stream.tobytes()


@dataclass
class Block:
    """A block's header and states, read without its words."""

    n_ids: int
    lanes: int
    segment: int
    n_words: int
    places: list[int]
    id_crcs: list[int]
    word_crcs: list[int]
    states: list[np.ndarray]
    words_at: int

    @classmethod
    def parse(cls, data) -> "Block":
        magic, n, lanes, segment, n_words = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise CorruptFile("no block here")
        at, places, id_crcs, word_crcs, states = _HEAD.size, [], [], [], []
        for _ in range(-(-n // segment)):
            place, id_crc, word_crc = struct.unpack_from("<III", data, at)
            states.append(np.frombuffer(data, "<u8", lanes, at + 12).astype(np.uint64))
            places.append(place), id_crcs.append(id_crc), word_crcs.append(word_crc)
            at += 12 + 8 * lanes
        if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
            raise CorruptFile("block header")
        return cls(n, lanes, segment, n_words, [*places, n_words], id_crcs, word_crcs, states, at + 4)


def decode_segment(data, block: Block, k: int, table: FrequencyTable) -> np.ndarray:
    """The ids of segment ``k`` alone; reads that segment's words only."""
    slots, bits, mask = table.slots(), np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    field, low_21 = np.uint64(21), np.uint64((1 << 21) - 1)
    low, high = block.places[k], block.places[k + 1]
    raw = data[block.words_at + 4 * low : block.words_at + 4 * high]
    if zlib.crc32(raw) != block.word_crcs[k]:
        raise CorruptFile("words of a segment")
    words = np.frombuffer(raw, "<u4").astype(np.uint64)
    n = min(block.segment, block.n_ids - k * block.segment)
    out, x, at = np.empty(n, np.uint32), block.states[k].copy(), 0
    for begin in range(0, n, block.lanes):
        end = min(n, begin + block.lanes)
        xs = x[: end - begin]
        found = slots.take((xs & mask).view(np.int64))
        out[begin:end] = found >> np.uint64(42)
        xs = ((found >> field) & low_21) * (xs >> bits) + (found & low_21)
        short = np.flatnonzero(xs < _LOW)
        if len(short):
            xs[short] = (xs[short] << _WORD) | words[at : at + len(short)]
            at += len(short)
        x[: end - begin] = xs
    if zlib.crc32(out.astype("<u4").tobytes()) != block.id_crcs[k]:
        raise CorruptFile("ids of a segment")
    return out
