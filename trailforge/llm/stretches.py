"""Ids of a batch of texts by its distinct stretches: each is made once, and arrays do the rest."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

_BLANK, _LETTER, _MARK, _CAPITAL = np.zeros((4, 256), bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CAPITAL[ord("A") : ord("Z") + 1] = True
_LETTER[:] = _CAPITAL | np.roll(_CAPITAL, 32)
_MARK[33:127] = True
_MARK &= ~_LETTER
_MARK[ord("|")] = False  # special tokens have one after a letter


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``pool[start : start + size]`` of every pair, one after the other."""
    end = np.cumsum(size)
    return pool[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings (nulls as empty ones), and where each begins and the last ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, places, data = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[places[0] : places[-1]], places - places[0]


def stretches(data: np.ndarray, places: np.ndarray, lower: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Texts cut before each run of white space and between an ASCII letter and a digit or sign, as a dictionary array of bytes, and the first stretch of each text (and the end).

    A run of white space is cut from what stands before it only where it starts
    with ASCII and no other white space comes before it, so that none is torn
    apart.  With ``lower``, stretches of ASCII alone are in lower case.
    """
    blank, letter = _BLANK[data], _LETTER[data]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1 if len(data) else np.zeros(0, np.int64)
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    other = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A))
    starts = np.zeros(len(data) + 1, bool)
    starts[at[~other]] = True
    starts[1:-1] |= letter[:-1] & _MARK[data[1:]]
    starts[places[:-1]] = True
    starts[len(data)] = False
    cuts = np.flatnonzero(starts)
    first = np.searchsorted(cuts, places)
    if lower and len(cuts):
        plain = np.maximum.reduceat(data, cuts) < 128
        data = data + np.uint8(32) * (_CAPITAL[data] & np.repeat(plain, np.diff(cuts, append=len(data))))
    bounds = np.append(cuts, len(data)).astype(np.int32)
    held = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return held.dictionary_encode(), first


class Remembered:
    """Ids (or other numbers) of byte strings, kept in one array.

    ``make`` gives the ids of a list of new strings, joined, and the size of
    each.  Once there are ``most`` strings or ``ids`` ids, only those of the
    batch at hand stay.
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 250_000, ids: int = 4_000_000, kind: type = np.uint32) -> None:
        self.make, self.most, self.ids, self.kind = make, most, ids, kind
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool, self.start, self.size = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, keys: list[bytes], pool: np.ndarray, size: np.ndarray) -> None:
        end = len(self.pool) + np.cumsum(size)
        self.place.update(zip(keys, range(len(self.start), len(self.start) + len(keys)), strict=True))
        self.pool, self.start, self.size = np.concatenate([self.pool, pool]), np.concatenate([self.start, end - size]), np.concatenate([self.size, size])

    def __call__(self, texts: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the stretches in order, and how many each stretch has."""
        keys = texts.dictionary.to_pylist()
        known = self.place.get
        new = [k for k in keys if known(k) is None]
        if new:
            if len(self.place) + len(new) > self.most or len(self.pool) > self.ids:
                kept = [k for k in keys if known(k) is not None]
                at = np.fromiter(map(known, kept), np.int64, len(kept))
                pool, size = gather(self.pool, self.start[at], self.size[at]), self.size[at]
                self._clear()
                self._add(kept, pool, size)
            self._add(new, *self.make(new))
            known = self.place.get
        at = np.fromiter(map(known, keys), np.int64, len(keys))[texts.indices.to_numpy()]
        size = self.size[at]
        return gather(self.pool, self.start[at], size), size
