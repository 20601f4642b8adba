"""Word hashes of many texts at once.

Words are runs of characters other than ASCII white space, with A-Z lower-cased. A word's
hash is a polynomial over random 64-bit values of its bytes, taken from running sums, so a
whole block of texts is hashed by a few array operations; a finalizer mixes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts hashed together; a longer text is a block of its own.
BLOCK = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, one to one."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, x in (("up", _BASE), ("down", _INVERSE)):
            all_x = np.full(n, x, np.uint64)
            all_x[0] = 1
            _powers[name] = np.cumprod(all_x)
    return _powers["up"][:n], _powers["down"][:n]


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, offsets, bytes)`` of runs of texts of about BLOCK bytes."""
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1)
        last = min(last, len(texts))
        yield first, last, ends[first : last + 1] - ends[first], data[ends[first] : ends[last]]
        first = last


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block's texts, and where each text's words begin (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | edge[1:])) + 1
    up, down = _power(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up)])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)


_FACTORS = [_U(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer words than ``width`` make one, none make none."""
    h, at = word_hashes(offsets, data)
    n = len(h)
    whole = np.zeros(0, np.uint64)
    if n >= width:
        whole = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            whole += h[k : n - width + 1 + k] * _FACTORS[k % 5] * _U(k + 1 | 1)
        whole = mix(whole)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            own = _U((b - a) * 0x2545F4914F6CDD1D % (1 << 64))
            with np.errstate(over="ignore"):
                for k in range(b - a):
                    own = own + h[a + k] * _FACTORS[k] * _U(k + 1 | 1)
            yield mix(np.array([own], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
