"""Encoding of many texts with a public tokenizer of the tokenizers library, exactly as whole texts encode.

Both public BPE vocabularies split a text into pieces before they merge. A piece never goes on past a run
of white space that follows something else (the byte-level one keeps a space with the word after it), nor
from an ASCII letter to ASCII punctuation. So the encoding of a text is that of its chunks, cut at such
places, one after the other. The library encodes each distinct chunk once; a bounded table of the worker
process keeps the ids under a 128-bit hash of the chunk. Texts with other white space or with what may be
a special token, and other tokenizers, go through the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bytewords import buffers, lower_map, spans

#: White space outside ASCII by Unicode's White_Space, the ASCII separators, and what special tokens begin with.
_ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
SLOTS_LOG2 = 21
LONG_CHUNK = 256
_kept: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One per worker process and tokenizer."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    stop = np.zeros(256, bool)
    stop[33:48] = stop[58:65] = stop[91:97] = stop[123:127] = True
    stop[39] = False  # an apostrophe may begin a contraction
    return space, letter, stop


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self.space, self.letter, self.stop = _classes()
        self.byte_map = lower_map() if self.kind == "words" else np.arange(256, dtype=np.uint8)
        if self.kind != "whole":
            self._clear()

    def _clear(self) -> None:
        n = 1 << SLOTS_LOG2
        self.key, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.at, self.size = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.ids, self.used, self.filled = np.zeros(1 << 20, np.uint32), 0, 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The slot of each chunk, -1 for those that aren't kept: linear probing, all chunks in step."""
        mask = np.uint64((1 << SLOTS_LOG2) - 1)
        slot = (h & mask).astype(np.int64)
        hit = (self.key[slot] == h) & (self.check[slot] == c)
        open_ = np.flatnonzero(~hit & (self.at[slot] >= 0))
        out = np.where(hit, slot, -1)
        while len(open_):
            s = (slot[open_] + 1) & int(mask)
            slot[open_] = s
            good = (self.key[s] == h[open_]) & (self.check[s] == c[open_]) & (self.at[s] >= 0)
            out[open_[good]] = s[good]
            open_ = open_[~good & (self.at[s] >= 0)]
        out[out >= 0] = np.where(self.at[out[out >= 0]] >= 0, out[out >= 0], -1)
        return out

    def _keep(self, h: np.ndarray, c: np.ndarray, made: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(made), np.uint32)
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.filled += len(h)
        mask = (1 << SLOTS_LOG2) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            s = slot[left]
            free = self.at[s] < 0
            _, one = np.unique(s[free], return_index=True)  # of those that want the same slot the first gets it
            won = left[np.flatnonzero(free)[one]]
            w = slot[won]
            self.key[w], self.check[w], self.at[w], self.size[w] = h[won], c[won], at[won], size[won]
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[one]] = False
            left = left[rest]
            slot[left] = (slot[left] + 1) & mask

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and the number of ids of each text (int64)."""
        n = len(column)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.kind == "whole":
            return _joined(self._whole(column.to_pylist()))
        odd = pc.match_substring_regex(column, _ODD)
        if pc.any(odd).as_py():
            return self._mixed(column, odd)
        data, off = buffers(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        space = self.space[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = (space[1:] & ~space[:-1]) | (self.stop[data[1:]] & self.letter[data[:-1]])
        begins[off[:-1][off[:-1] < len(data)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        if self.kind == "words":  # white space adds nothing: it goes, with chunks of nothing else
            one = space[start]
            start = start + one
            many = np.flatnonzero(one)
            many = many[(start[many] < end[many])]
            while len(many := many[space[start[many]]]):
                start[many] += 1
                many = many[start[many] < end[many]]
            full = start < end
            start, end = start[full], end[full]
        h, c = spans(data, start, end, self.byte_map, checks=True)
        slot = self._find(h, c)
        new = np.flatnonzero(slot < 0)
        long_at = np.zeros(0, np.int64)
        if len(new):
            is_long = (end[new] - start[new]) > LONG_CHUNK
            long_at, new = new[is_long], new[~is_long]
            _, first = np.unique(h[new], return_index=True)
            if self.filled + len(first) > 0.6 * (1 << SLOTS_LOG2):
                self._clear()
                slot[:] = -1
                new = np.flatnonzero((end - start) <= LONG_CHUNK)
                _, first = np.unique(h[new], return_index=True)
            raw = data.tobytes()
            for i in range(0, len(first), 4096):
                part = new[first[i : i + 4096]]
                self._keep(h[part], c[part], self._whole([raw[a:b].decode() for a, b in zip(start[part], end[part], strict=True)]))
            slot[new] = self._find(h[new], c[new])
        at, size, ids = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64), self.ids
        rest = np.concatenate((long_at, np.flatnonzero(slot < 0))) if len(new) or len(long_at) else long_at
        if len(rest):  # long chunks aren't kept; a chunk whose first hash another one has isn't either
            rest = np.unique(rest)
            flat, n_ids = _joined(self._whole([data[a:b].tobytes().decode() for a, b in zip(start[rest], end[rest], strict=True)]))
            size[rest], at[rest] = n_ids, self.used + np.cumsum(n_ids) - n_ids
            ids = np.concatenate((self.ids[: self.used], flat))
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.arange(total, dtype=np.int64) + np.repeat(at - (ends - size), size)]
        edges = np.concatenate(([0], ends))[np.searchsorted(start, off, "left")]
        return out, np.diff(edges)

    def _mixed(self, column: pa.Array, odd: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Odd texts go whole, the others by chunks; the order stays."""
        is_odd = odd.to_numpy(zero_copy_only=False)
        plain_ids, plain_n = self.encode(column.filter(pc.invert(odd)))
        odd_ids, odd_n = _joined(self._whole(column.filter(odd).to_pylist()))
        sizes = np.zeros(len(column), np.int64)
        sizes[~is_odd], sizes[is_odd] = plain_n, odd_n
        ids = np.zeros(int(sizes.sum()), np.uint32)
        mask = np.repeat(is_odd, sizes)
        ids[~mask], ids[mask] = plain_ids, odd_ids
        return ids, sizes


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def _kind(made: dict) -> str:
    """How texts can be cut before encoding: words (white space is dropped), bytes (a space stays with its word) or whole."""
    norm, pre = made.get("normalizer"), made.get("pre_tokenizer") or {}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t["content"].startswith("<|") for t in made.get("added_tokens") or []):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    steps = pre.get("pretokenizers") or []
    cuts = steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    spaced = norm and norm.get("type") == "Sequence" and [x["type"] for x in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]
    if cuts and spaced and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", ""):
        return "words"
    return "whole"
