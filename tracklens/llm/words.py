"""Ids of whole texts with a tokenizer that treats white-space separated words alone, by a memo of words."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tracklens.llm.common import hold_memo
from tracklens.llm.tokens import byte_names

#: The memo starts anew above so many words or characters.
MEMO_WORDS, MEMO_CHARS = 1_200_000, 36_000_000
#: White space on which Python and the tokenizer may differ, and the byte that parts texts; texts that hold any go to the library whole.
_ODD = re.compile("[\x00\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Fixed value: the published pattern that cuts words into pre-tokens.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The byte behind each pre-token that stands for the end of a word. No word that holds it is ranked.
_END = "\x00"
#: Words of these characters are their own composed form, and their lower case does not depend on what is around them.
_PLAIN = re.compile("[\x01-\x1b\x21-\x7e\xa1-\u024f]+")

_ENCODERS: dict[str, "WordEncoder"] = {}


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def word_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """One encoder for each worker process and file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    hold_memo("words", _ENCODERS[path]._forget)
    return _ENCODERS[path].batch_ids


def ranked_words(spec: dict):
    """The tokenizer's words as ``tiktoken`` ranks and the id of a blank, or None if the file is more than a lower-casing BPE with
    word ends whose merges come in the order of their ids.

    A pre-token goes in with an end byte behind it; the ranks merge that byte with the last one first, as the word end asks.
    """
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = [p.get("pattern", {}).get("Regex", p["type"]) for p in pre.get("pretokenizers", [])]
    vocab, suffix = model.get("vocab"), model.get("end_of_word_suffix")
    plain = (
        model.get("type") == "BPE" and suffix and steps == ["NFC", "Replace", "Lowercase"] and cuts == [WORD_PATTERN, "ByteLevel"]
        and not any((model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"))))
    if not plain:
        return None
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    names = byte_names()
    singles = [vocab.get(c) for c in names] + [vocab.get(c + suffix) for c in names]
    if None in made or None in singles or any(a >= b for a, b in zip(made, made[1:])) or (made and max(singles) >= made[0]):
        return None
    spelled = lambda t: bytes(names[c] for c in t)
    ranks = {}
    for token, at in vocab.items():
        stem, end = (token[: -len(suffix)], _END.encode()) if token.endswith(suffix) else (token, b"")
        if all(c in names for c in stem) and (end or stem != _named(names, 0)):
            ranks[spelled(stem) + end] = at
    if min(vocab[c + suffix] for c in names) <= max(vocab[c] for c in names):
        return None
    # the end byte itself stands alone at the end of nothing; it takes the id that its own byte has
    ranks[_END.encode()] = vocab[_named(names, 0)]
    return tiktoken.Encoding("words", pat_str=f"[^{_END} ]+{_END}| ", mergeable_ranks=ranks, special_tokens={}), vocab[_named(names, 0x20)]


def _named(names: dict[str, int], byte: int) -> str:
    return next(c for c, b in names.items() if b == byte)


class WordEncoder:
    """The ``tokenizers`` library's ids for whole texts.

    Only for tokenizers that drop white space and let no token, added ones included, reach over it: then a text's ids are those of
    its words, one after another. Words are remembered; new ones of plain letters are encoded with ``tiktoken`` from the same file,
    where the file allows it (tests compare both over the whole vocabulary), others by the library.
    """

    def __init__(self, path: str, ranked: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library = path, None
        self._forget()
        self.ranked = ranked_words(spec) if ranked else None
        self.added = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.pieces = regex.compile(WORD_PATTERN)

    @property
    def library(self):
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _by_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_ranks(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ranks, blank = self.ranked
        # in these characters lower case does not depend on what is around
        ids = np.array(ranks.encode_ordinary(self.pieces.sub(r"\g<0>" + _END, " ".join(words).lower())), "<u4")
        cuts = np.flatnonzero(ids == blank)
        return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1

    def _learn(self, words: list[str]) -> None:
        """Encodes words without white space inside, numbered from ``known`` on."""
        joint = "".join(words)
        if self.ranked is None:
            plain = np.zeros(len(words), bool)
        elif _PLAIN.fullmatch(joint) and not any(t in joint for t in self.added):
            plain = np.ones(len(words), bool)
        else:
            plain = np.array([_PLAIN.fullmatch(w) is not None and not any(t in w for t in self.added) for w in words])
        size = np.zeros(len(words), np.int64)
        flat, start = self.flat, np.zeros(len(words), np.int64)
        for own, encode in ((plain, self._by_ranks), (~plain, self._flat_by_library)):
            if own.any():
                ids, size[own] = encode([words[k] for k in np.flatnonzero(own)])
                start[own] = len(flat) + np.cumsum(size[own]) - size[own]
                flat = np.concatenate([flat, ids])
        self.flat, self.size, self.start = flat, np.concatenate([self.size, size]), np.concatenate([self.start, start])
        self.chars += len(joint)
        self.known += len(words)

    def _flat_by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._by_library(words)
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def batch_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. A batch's different words are numbered as they come and the ids of all texts gathered at once by their words' numbers."""
        odd = [_ODD.search(t) is not None for t in texts]
        if len(self.numbers) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self._forget()
        # without odd texts, white space is that of ASCII
        joint = pa.array([f" {_END} ".join(["" if o else t for t, o in zip(texts, odd)])], pa.large_string())
        coded = pc.ascii_split_whitespace(joint).flatten().dictionary_encode()
        # put together and cut again, which is the fast way to Python strings
        whole = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        words = pc.binary_join(whole, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        if len(self.numbers) > self.known:
            self._learn([*islice(reversed(self.numbers), len(self.numbers) - self.known)][::-1])
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)]
        # the end byte parts the texts and has no ids
        cuts = ends[np.flatnonzero(at == 0)]
        out = np.split(ids, cuts)
        for k in np.flatnonzero(odd):
            out[k] = self._by_library([texts[k]])[0]
        return out

    def _forget(self) -> None:
        # the end byte and the empty strings at both ends of a batch have no ids
        self.numbers = _Numbers({_END: 0, "": 1})
        self.known, self.chars = 2, 0
        self.flat, self.size, self.start = np.zeros(0, "<u4"), np.zeros(2, np.int64), np.zeros(2, np.int64)
