"""Token ids by the tokenizers library, with what a worker has seen kept for the next texts."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from brolga.llm.common import release, worker_cache

#: A byte-level pre-tokenizer never joins what stands on both sides of such a border, so chunks can be encoded alone.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space about which regular expression engines differ: texts with it are encoded whole.
_UNSURE = re.compile("[\x1c-\x1f\x85 ᠎ -‏ -  -⁯　﻿]")
#: Letters and numbers up to U+024F, where the pre-tokenizer's pattern can be said in these words.
_LETTERS, _NUMBERS, _LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "ɐ"
_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
#: What a worker remembers: so many words with what touches them, so many pieces of the pre-tokenizer, none longer than this.
WORDS, PIECES, LONGEST = 400_000, 300_000, 48
#: Bytes of texts that are looked up together.
TOGETHER = 1 << 22


def _byte_letters() -> dict[int, str]:
    """The letter that stands for a byte in a byte-level vocabulary: itself if it can be seen, else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def _put(ids: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that lie one after the other in ids, with so many each, those that code numbers, and the size of each."""
    start, n = np.cumsum(size) - size, size[code]
    place = np.repeat((start[code] - (np.cumsum(n) - n)).astype(np.int32), n)
    place += np.arange(len(place), dtype=np.int32)
    return ids[place], n


class Known:
    """Strings seen so far, how many ids each has, and all those ids one after the other."""

    def __init__(self, most: int):
        self.most, self.words = most, pa.array([], pa.string())
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, words: pa.StringArray) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def add(self, words: pa.StringArray, size: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """Remembers what fits, as long as there is room."""
        fit = np.flatnonzero(fit & pc.less_equal(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False))[: self.most - len(self.words)]
        if len(fit):
            self.words = pa.concat_arrays([self.words, words.take(pa.array(fit))])
            self.ids = np.concatenate([self.ids, _put(ids, size, fit)[0]])
            self.size = np.concatenate([self.size, size[fit]])


class Encoder:
    """encode(text) is the little-endian unsigned 32-bit ids of tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.by_word = isinstance(split, ByteLevel) and not split.add_prefix_space and split.use_regex and self.tokenizer.normalizer is None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(map(re.escape, added))
        self.words, self.pieces = Known(WORDS), Known(PIECES)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """ids of what stands between two borders of the pre-tokenizer; what is not sure to be such a piece is encoded whole."""
        if max(piece) >= _LATIN:
            return self.whole(piece)
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()

    def split(self, text: str) -> list[str]:
        """Pieces that can be encoded alone."""
        if text.isascii() or max(text) < _LATIN:
            return _PIECE.findall(text)
        return [p for c in _CHUNK.findall(text) for p in (_PIECE.findall(c) if max(c) < _LATIN else (c,))]

    def _of_pieces(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """ids and how many for each list of pieces. Pieces are numbered and looked up as arrays; only new ones are encoded."""
        flat = pa.array([p for x in pieces for p in x], pa.string()).dictionary_encode()
        code, found = flat.indices.to_numpy(), self.pieces.find(flat.dictionary)
        new = np.flatnonzero(found < 0)
        words = flat.dictionary.take(pa.array(new))
        told = [self.piece(p) for p in words.to_pylist()]
        size, ids = np.fromiter((len(x) // 4 for x in told), np.int64, len(told)), np.frombuffer(b"".join(told), np.uint32)
        found[new] = len(self.pieces.size) + np.arange(len(new))
        out, n = _put(np.concatenate([self.pieces.ids, ids]), np.concatenate([self.pieces.size, size]), found[code])
        self.pieces.add(words, size, ids, np.ones(len(new), bool))
        total = np.r_[0, np.cumsum(n)]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return out, np.diff(total[np.r_[0, ends]])

    def _together(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts one after the other, and how many each has. Texts are cut at spaces, and what is behind each space is
        looked up as an array; only what was not seen before is cut into pieces. A space begins a piece of its own unless
        white space stands on both sides of it; texts with that are cut into pieces whole, and the few that hold white space
        or added tokens about which one cannot be sure go to the library."""
        alone = pc.match_substring_regex(texts, _UNSURE.pattern)
        if self.added:
            alone = pc.or_(alone, pc.match_substring_regex(texts, self.added))
        split = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        at, flat = split.offsets.to_numpy().astype(np.int64), split.values
        at -= at[0]
        first, code = at[:-1], self.words.find(flat)
        code[first] = -1
        new = np.flatnonzero(code < 0)
        seen = flat.take(pa.array(new)).dictionary_encode()
        words = seen.dictionary.to_pylist()
        heads = flat.take(pa.array(first)).to_pylist()
        base = len(self.words.size)
        code[new] = base + seen.indices.to_numpy()
        code[first] = base + len(words) + np.arange(len(heads))
        ids, size = self._of_pieces([self.split(" " + w) for w in words] + [self.split(w) if w else [] for w in heads])
        opens, closes = np.zeros(base + len(size), bool), np.zeros(base + len(size), bool)
        opens[base:] = [not w or w[0].isspace() for w in words] + [False] * len(heads)
        closes[base:] = [not w or w[-1].isspace() for w in words] + [bool(w) and w[-1].isspace() for w in heads]
        rough = np.zeros(len(code), bool)
        rough[1:] = closes[code[:-1]] & opens[code[1:]]
        out, n = _put(np.concatenate([self.words.ids, ids]), np.concatenate([self.words.size, size]), code)
        count = np.add.reduceat(n, first)
        slow = np.flatnonzero(np.logical_or.reduceat(rough, first) | alone.to_numpy(zero_copy_only=False))
        if len(slow):
            odd = alone.to_numpy(zero_copy_only=False)
            told = {k: np.frombuffer(self.whole(texts[k].as_py()), np.uint32) for k in slow.tolist() if odd[k]}
            cut = [k for k in slow.tolist() if not odd[k]]
            more, m = self._of_pieces([self.split(texts[k].as_py()) for k in cut])
            told |= dict(zip(cut, np.split(more, np.cumsum(m)[:-1]), strict=True)) if cut else {}
            out = np.concatenate([told.get(k, x) for k, x in enumerate(np.split(out, np.cumsum(count)[:-1]))])
            count[slow] = [len(told[k]) for k in slow.tolist()]
        k = len(words)
        plain = ~(opens | closes)[base : base + k] & ~pc.match_substring(seen.dictionary, "\n").to_numpy(zero_copy_only=False)
        self.words.add(seen.dictionary, size[:k], ids, plain)
        return out, count

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of encode() for all texts, one after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            found = [self.whole(t) if t else b"" for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), np.uint32), np.array([len(x) // 4 for x in found], np.int64)
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
        cut = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(texts)].tolist()
        found = [self._together(texts.slice(a, b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]
        pa.default_memory_pool().release_unused()
        release()
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in ((0, np.uint32), (1, np.int64)))

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a tokenizer file."""
    kept = worker_cache("tokens")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def all_ids(path: str, make: Callable[[str], Callable[[str | None], bytes]] | None = None) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """The worker's function from a column of texts to their ids, one after the other, and how many each has."""
    if make is None:
        return encoder(path).encode_all
    one = make(path)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [one(t) for t in texts.to_pylist()]
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)

    return run
