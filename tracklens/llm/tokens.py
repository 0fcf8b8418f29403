"""Exact token ids of whole texts with a public tokenizer, shared by counting and packing."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from tracklens.llm.common import hold_memo

#: A blank between two characters that are not white space always starts a new pre-token of the
#: byte-level pattern, whatever surrounds it: no alternative of that pattern reaches over it.
_STABLE = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
#: Fixed value: the byte-level pre-tokenizer's published pattern.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_FILE = "byte_bpe_50k.json"
#: White space runs of this length would overflow the ranked library's stack; such texts take the other one.
LONG_BLANKS = 10_000
_LONG_BLANKS = re.compile(rf"\s{{{LONG_BLANKS}}}")
#: Texts of more bytes than this are encoded as overlapping chunks.
HUGE_BYTES = 65_536
CHUNK_BYTES = 32_768
OVERLAP_BYTES = 512

_ENCODERS: dict[str, "TextEncoder"] = {}


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "TextEncoder":
    """One encoder for each worker process and file, kept from task to task."""
    hold_memo("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes, in order, for the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked_encoding(spec: dict):
    """The tokenizer as ``tiktoken`` ranks, or None if the file is more than a plain byte-level BPE whose
    merges come in the order of their ids (a normaliser, a prefix space, dropout, an unknown token)."""
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab")
    plain = (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        and not any((pre.get("add_prefix_space"), spec.get("normalizer"), model.get("dropout"), model.get("unk_token"),
                     model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"))))
    if not plain:
        return None
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    names = byte_names()
    if None in made or any(a >= b for a, b in zip(made, made[1:])) or any(c not in vocab for c in names):
        return None
    ranks = {bytes(names[c] for c in token): at for token, at in vocab.items() if all(c in names for c in token)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class TextEncoder:
    """The ``tokenizers`` library's ids for whole texts.

    A plain byte-level BPE has the same ids in ``tiktoken``, which takes a quarter of the time and holds no
    cache (the tests compare both over all of Unicode). Texts that hold an added token's string or a run of
    ``LONG_BLANKS`` white-space characters, and all texts of other tokenizers, go through ``tokenizers`` itself,
    which is loaded when it is first needed.
    """

    def __init__(self, path: str, ranked: bool = True):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ranked = ranked_encoding(spec) if ranked else None
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        vocab = spec["model"]["vocab"] | added
        # in a byte-level vocabulary every character of a token's name stands for one byte
        self.token_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for name, at in vocab.items():
            self.token_bytes[at] = len(name.encode()) if name in added else len(name)

    @property
    def library(self):
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def ids(self, text: str) -> list[int]:
        if (
            self.ranked is None
            or (self.added is not None and self.added.search(text))
            or (len(text) >= LONG_BLANKS and _LONG_BLANKS.search(text))
        ):
            return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.ranked.encode_ordinary(text)

    def id_bytes(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return np.array(array("I", self.ids(text)), dtype="<u4").tobytes()

    def count(self, text: str, n_bytes: int) -> int:
        """Number of ids of a text of ``n_bytes``; huge texts are encoded as overlapping chunks."""
        return self.count_by_overlap(text) if n_bytes > HUGE_BYTES else len(self.ids(text))

    def _starts(self, data: bytes, at: int, end: int) -> np.ndarray:
        """The byte in the whole text at which each token of ``data[at:end]`` starts."""
        sizes = self.token_bytes[np.array(array("I", self.ids(data[at:end].decode())), dtype=np.int64)]
        return at + np.cumsum(sizes) - sizes

    def count_by_overlap(self, text: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> int:
        """Tokens of a huge text from overlapping chunks.

        Each chunk reaches into the next one. The two encodings are spliced at a token that both
        start at the same byte, a stable blank: everything before it is the left chunk's, the rest
        the right one's. When the shared stretch holds no such place (one long unbroken string, say),
        the overlap is doubled, up to the end of the text if need be.
        """
        data = text.encode()
        total, begin = 0, 0
        end = _boundary(data, chunk + overlap)
        left = self._starts(data, 0, end)
        while end < len(data):
            wide = overlap
            low = _boundary(data, max(begin, end - wide))
            while True:
                high = _boundary(data, low + chunk + wide)
                right = self._starts(data, low, high)
                shared = np.intersect1d(left[(left > low) & (left + 1 < end)], right, assume_unique=True)
                splice = next((int(s) for s in shared if _stable(data, int(s))), None)
                if splice is not None:
                    total += int((left < splice).sum())
                    left, begin, end = right[right >= splice], splice, high
                    break
                if end == len(data):
                    return total + len(left)
                wide *= 2
                end = _boundary(data, end + wide)
                left = self._starts(data, begin, end)
                low = _boundary(data, max(low, end - wide))
        return total + len(left)


def _boundary(data: bytes, at: int) -> int:
    """The first character that starts at byte ``at`` or behind it."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def _stable(data: bytes, at: int) -> bool:
    """Whether byte ``at`` is a stable blank."""
    if data[at] != 0x20:
        return False
    low = at - 1
    while low > 0 and data[low] & 0xC0 == 0x80:
        low -= 1
    around = data[low : _boundary(data, at + 2)].decode()
    return _STABLE.match(around, len(around) - 2) is not None
