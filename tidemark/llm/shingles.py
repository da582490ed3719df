"""Word shingles as 64-bit hashes, for many texts at once in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word is read eight bytes at a time:
each step mixes them into the word's state (splitmix64's finaliser), so a word's hash has no
algebraic structure that words could be built against. Words of more than ``LANES`` bytes are
hashed by blake2b. A shingle's hash mixes those of its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from tidemark.llm.common import byte_view, eight_bytes, mix64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = mix64(np.arange(101, 165, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_LENGTH, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Longest word, in bytes, that is hashed in lockstep with others.
LANES = 64
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def hash_spans(raw: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hash of the bytes raw[at:to] of each span."""
    n = to - at
    out = mix64(n.astype(np.uint64) * _LENGTH)
    eight = eight_bytes(np.concatenate([raw, np.zeros(8, np.uint8)]))
    live = np.flatnonzero((n > 0) & (n <= LANES))
    for done in range(0, LANES, 8):
        if not len(live):
            break
        left = n[live] - done
        lane = eight[at[live] + done] & _TAIL[np.minimum(left, 8)]
        out[live] = mix64(out[live] * _STEP ^ lane)
        live = live[left > 8]
    data = None
    for i in np.flatnonzero(n > LANES).tolist():
        data = memoryview(raw.tobytes()) if data is None else data
        out[i] = int.from_bytes(hashlib.blake2b(data[at[i] : to[i]], digest_size=8).digest(), "little")
    return out


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text plus the end)."""
    raw, ends = byte_view(text)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True  # a text's first byte starts a word whatever came before it
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:-1]
    at, to = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return hash_spans(_LOWER[raw], at, to), np.searchsorted(at, ends)


def shingle_sets(text: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle, none make none."""
    hashes, ends = words(text)
    n = len(hashes)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        rolled += hashes[i : i + len(rolled)] * _PLACE[i]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            whole = (hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * _PLACE[k]
            out.append(mix64(whole))
        else:
            out.append(hashes[:0])
    return out
