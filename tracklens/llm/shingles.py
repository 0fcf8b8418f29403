"""Word-shingle sets as sorted 64-bit hashes, and circulant MinHash signatures of them."""

from __future__ import annotations

import numpy as np
import xxhash

from tracklens.llm.common import hold_memo

U64 = np.uint64
#: Words that are remembered, and the longest of them in bytes; together they bound the memo's memory.
MEMO_WORDS, MEMO_LENGTH = 250_000, 64
#: Shingles that go through the permutation at once; the buffers stay in the processor's cache.
BLOCK_SHINGLES = 1 << 15


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_LENGTH:
            self[word] = value
        return value


_MEMO = _Memo()


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of one UTF-8 text.

    Words are runs of anything but ASCII white space, A-Z in lower case. With fewer words the whole
    sequence is one shingle; without words the set is empty.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if len(_MEMO) > MEMO_WORDS:
        _MEMO.clear()
    if not _MEMO:
        hold_memo("shingles", _MEMO.clear)
    hashes = np.fromiter(map(_MEMO.__getitem__, words), dtype=np.uint64, count=n)
    wide = min(width, n)
    out = hashes[: n - wide + 1].copy()
    for j in range(1, wide):
        out = mix64(out) + hashes[j : n - wide + 1 + j]
    return np.unique(mix64(out + U64(wide)))


def circulant_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """``size`` signature coordinates of each nonempty set, one row per set.

    The universe is the 2^32 residues. A first permutation (the upper half of a 64-bit scrambling)
    breaks up structure; coordinate ``k`` is the smallest value of one second permutation, shifted
    circularly by ``k``, over the set. Only these two permutations are used.
    """
    signature = np.empty((len(sets), size), dtype=np.uint32)
    at = 0
    while at < len(sets):
        upto, total = at, 0
        while upto < len(sets) and (upto == at or total + len(sets[upto]) <= BLOCK_SHINGLES):
            total += len(sets[upto])
            upto += 1
        first = (mix64(np.concatenate(sets[at:upto]) + U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : upto - 1])])
        x, y = np.empty_like(first), np.empty_like(first)
        for k in range(size):
            np.add(first, np.uint32(k), out=x)
            np.right_shift(x, 16, out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x7FEB352D), out=x)
            np.right_shift(x, 15, out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x846CA68B), out=x)
            np.right_shift(x, 16, out=y)
            np.bitwise_xor(x, y, out=x)
            signature[at:upto, k] = np.minimum.reduceat(x, starts)
        at = upto
    return signature


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket of each band of the signature; different bands never share a bucket's seed."""
    rows = signature.shape[1] // bands
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15), (len(signature), 1))
    for r in range(rows):
        keys = mix64(keys) + signature[:, r::rows].astype(np.uint64)
    return mix64(keys).view(np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())
