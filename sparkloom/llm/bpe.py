"""Byte-level BPE ids for whole batches of texts.

Splitting is vectorised over bytes; only the distinct pieces of a slice are
encoded, and their ids are laid out again by array gathers.  Texts with
characters whose class bytes alone don't settle go to the `tokenizers` library
directly, so ids always equal those of the vocabulary file.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import textkit as tk

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)
_SPACES = {9, 10, 11, 12, 13, 32}
_WIDE_SPACES = {0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _kind(code: int) -> int:
    if code in _SPACES:
        return _SPACE
    group = unicodedata.category(chr(code))
    if code in _WIDE_SPACES or group in ("Cn", "Cs") or code >= 0x2E80:
        return _UNSURE
    return _LETTER if group[0] == "L" else _NUMBER if group[0] == "N" else _OTHER


_CLASS = np.array([_kind(c) for c in range(0x10000)], np.uint8)


def _byte_of_char() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder for a byte-level BPE file of the `tokenizers` library with GPT-2's splitting pattern."""

    def __init__(self, path: str, cache: int = 1_000_000):
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        chars = _byte_of_char()
        ranks = {bytes(chars[c] for c in token): k for token, k in vocab.items() if all(c in chars for c in token) and not token.startswith("<|endoftext")}
        self.encode_piece = tiktoken.Encoding("file", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache = cache
        self._forget()

    def _forget(self) -> None:
        """Known pieces: sorted hashes, and where the ids of each lie in one array."""
        self.known = np.zeros(0, tk.U)
        self.at, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Add pieces that aren't known; hashes are sorted."""
        found = list(map(self.encode_piece, pieces))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while self.used + total > self.ids.size:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        to = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, to, hashes)
        self.at = np.insert(self.at, to, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, to, sizes)
        self.used += total

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        at[at == self.known.size] = 0
        return np.flatnonzero(self.known[at] != hashes) if self.known.size else np.arange(hashes.size)

    def _pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all pieces, and which texts hold a character of unsure class."""
        n = int(offs[-1])
        b = data[:n]
        kind = _CLASS[b]  # right for ASCII
        high = np.flatnonzero(b >= 0x80)
        if high.size:
            lead = np.flatnonzero(b >= 0xC0)
            width = np.where(b[lead] >= 0xF0, 4, np.where(b[lead] >= 0xE0, 3, 2))
            code = np.where(width == 2, (b[lead].astype(np.int32) & 0x1F) << 6 | data[lead + 1] & 0x3F, ((b[lead].astype(np.int32) & 0x0F) << 12 | (data[lead + 1].astype(np.int32) & 0x3F) << 6 | data[lead + 2] & 0x3F) & 0xFFFF)
            kinds = np.where(width == 4, _UNSURE, _CLASS[code]).astype(np.uint8)
            kind[tk.ragged(lead, width)] = np.repeat(kinds, width)
        unsure = np.zeros(offs.size - 1, bool)
        unsure[np.searchsorted(offs, np.flatnonzero(kind == _UNSURE), "right") - 1] = True
        start = np.ones(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        start[offs] = True
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        space = kind == _SPACE
        ends = np.flatnonzero(space & start[1:] & ~cut[1:])  # last of a run of spaces that a piece follows
        start[ends] = True
        start[ends[b[ends] == 0x20] + 1] = False
        quote = np.flatnonzero((b == 0x27) & start[:n] & start[1:])
        for tail in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
            at = quote[quote + 1 + len(tail) <= n]
            for k, c in enumerate(tail, 1):
                at = at[(b[at + k] == c) & ~cut[at + k]]
            start[at + 1] = False
            start[at + 1 + len(tail)] = True
        return np.flatnonzero(start[:n]), unsure

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and each text's first id (one more at the end); null is empty."""
        data, offs = tk.flat(column)
        starts, unsure = self._pieces(data, offs)
        if unsure.any():
            sure = np.flatnonzero(~unsure)
            return self._mixed(column, sure, np.flatnonzero(unsure))
        if not starts.size:
            return np.zeros(0, np.uint32), np.zeros(offs.size, np.int64)
        ends = np.append(starts[1:], offs[-1])
        hashes, first, back = np.unique(tk.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        missing = self._missing(hashes)
        if self.known.size + missing.size > self.cache:
            self._forget()
            missing = np.arange(hashes.size)
        raw = data.tobytes()
        self._learn(hashes[missing], [raw[a:b] for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist(), strict=True)])
        found = np.searchsorted(self.known, hashes)
        each = self.sizes[found][back]
        out = self.ids[tk.ragged(self.at[found][back], each)]
        upto = np.zeros(starts.size + 1, np.int64)
        np.cumsum(each, out=upto[1:])
        return out, upto[np.searchsorted(starts, offs)]

    def _mixed(self, column: pa.Array, sure: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, heads = self.encode(column.take(pa.array(sure)))
        parts: dict[int, np.ndarray] = {int(d): ids[heads[k] : heads[k + 1]] for k, d in enumerate(sure)}
        for d in rest.tolist():
            parts[d] = np.array(self.slow.encode(column[d].as_py(), add_special_tokens=False).ids, np.uint32)
        sizes = np.array([parts[d].size for d in range(len(column))], np.int64)
        return np.concatenate([parts[d] for d in range(len(column))]), np.concatenate([[0], np.cumsum(sizes)])
