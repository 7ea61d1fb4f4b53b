"""Encoding texts to token ids inside Spark tasks, a batch at a time."""

from __future__ import annotations

import json
import os
import sys
import types
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# units kept per Python worker before the cache starts anew: bounds its memory at roughly 100 MB
CACHE_UNITS = 500_000
# units handed to the tokenizer at once: what it returns for a unit takes about a kilobyte
CALL_UNITS = 1 << 14
# bytes of text put together at once: bounds the working arrays (a longer text is one step of its own)
STEP = 1 << 22
BYTE = np.arange(256)
ASCII_LETTER = ((BYTE | 32) >= 97) & ((BYTE | 32) <= 122) & (BYTE < 128)
SPACE = np.isin(BYTE, [9, 10, 11, 12, 13, 32])
MARK = (BYTE > 32) & (BYTE < 127) & ~ASCII_LETTER
LATIN_LEAD = (BYTE >= 0xC3) & (BYTE <= 0xC8)  # two-byte letters U+00C0 to U+023F; the two signs below are none


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a byte-level pre-tokenizer surely ends a token.

    That is after the last letter of a run, and between a visible ASCII sign and white space. Letters outside Latin
    and rare white space are left uncut, which only makes pieces longer.
    """
    if len(data) < 2:
        return np.zeros(0, dtype=np.int64)
    letter = ASCII_LETTER[data]
    sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    ends = letter.copy()
    ends[1:] |= LATIN_LEAD[data[:-1]] & ~sign
    plain = (data < 128) & ~letter
    return np.flatnonzero((ends[:-1] & plain[1:]) | (MARK[data[:-1]] & SPACE[data[1:]])) + 1


def default_path() -> str:
    """The 50k byte-level vocabulary of the public tokenizer files installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts under one tokenizers file, as its ``encode(text, add_special_tokens=False)`` gives them.

    Texts are cut where the pre-tokenizer surely ends a token, each distinct piece of a batch goes through the
    tokenizer once, and the ids are put together with NumPy: the same ids as encoding the whole text. Where the file
    has another pre-tokenizer, a normalizer or ordinary added tokens, texts are encoded whole, and so is a text that
    holds the string of a special token.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.pieces = self.pieces and not any(not x.get("special") for x in spec.get("added_tokens", []))
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def _units(self, units: list[str]) -> np.ndarray:
        """Places of the units, all different, in the cache, encoding those it lacks; each is looked up once."""
        places = np.fromiter(map(self.place.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        lacking = np.flatnonzero(places < 0)
        places[lacking] = len(self.place) + np.arange(len(lacking))
        missing = [units[i] for i in lacking.tolist()]
        for at in range(0, len(missing), CALL_UNITS):
            part = missing[at : at + CALL_UNITS]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            first = len(self.place)
            while first + len(part) + 1 > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            while self.used + lens.sum() > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.start[first + 1 : first + 1 + len(part)] = self.used + np.cumsum(lens)
            self.flat[self.used : self.used + lens.sum()] = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lens.sum()))
            self.used += int(lens.sum())
            self.place.update(zip(part, range(first, first + len(part))))
        return places

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the n+1 document boundaries in it; ``end`` is appended to each document."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
        ids, sizes, first = [], [], 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + STEP, side="right")) - 1)
            part, bounds = self._step(texts.slice(first, last - first), end)
            ids.append(part)
            sizes.append(np.diff(bounds))
            first = last
        if not ids:
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _step(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > CACHE_UNITS:
            self._reset()
        n = len(texts)
        docs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[docs[0] : docs[-1]]
        docs = docs - docs[0]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[docs] = True
        if self.pieces:
            edge[_cuts(data)] = True
            for i in {int(i) for s in self.special for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False))}:
                edge[docs[i] + 1 : docs[i + 1]] = False
        edges = np.flatnonzero(edge)
        pieces = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        place = self._units(words)[pieces.indices.to_numpy()] if words else np.zeros(0, dtype=np.int64)
        del pieces, words, edge
        lens = self.start[place + 1] - self.start[place]
        ends = np.concatenate([[0], np.cumsum(lens)])
        at = np.repeat((self.start[place] - ends[:-1]).astype(np.int32), lens)  # a few million ids at most, see STEP and CACHE_UNITS
        at += np.arange(ends[-1], dtype=np.int32)
        ids = self.flat[at]
        del at, place, lens
        bounds = ends[np.searchsorted(edges, docs)]
        if end is not None:
            ids = np.insert(ids, bounds[1:], end).astype(np.uint32)
            bounds = bounds + np.arange(n + 1)
        return ids, bounds


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a file; it outlives a task, so later tasks find its cache filled."""
    store = sys.modules.setdefault("_training_data_encoders", types.ModuleType("_training_data_encoders"))
    if path not in store.__dict__:
        store.__dict__[path] = Encoder(path)
    return store.__dict__[path]
