"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_MIXES = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SHIFTS = (np.uint64(31), np.uint64(32))
WORDS = 5
#: Bytes cut into words at once.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.random.Generator(np.random.Philox(key=21)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_BLOCK = 1 << 12
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(_BLOCK, _MIX + np.uint64(2), np.uint64)])


def words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """One hash from the hashes of consecutive words, which depends on their order."""
    out = columns[0] * _MIX
    for c in columns[1:]:
        out = (out ^ (out >> _SHIFT)) * _MIX + c
    return out ^ (out >> _SHIFT)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others."""
    x = (x ^ (x >> _SHIFTS[0])) * _MIXES[0]
    x = (x ^ (x >> _SHIFT)) * _MIXES[1]
    return x ^ (x >> _SHIFTS[1])


def powers(at: np.ndarray) -> np.ndarray:
    """An odd number to the powers ``at``."""
    most = int(at.max(initial=0)) >> 12
    if not most:
        return _POWERS[at]
    steps = np.cumprod(np.r_[np.uint64(1), np.full(most, _POWERS[_BLOCK], np.uint64)])
    return _POWERS[at & (_BLOCK - 1)] * steps[at >> 12]


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and hash of each word of ``data``, A-Z in lower case; by pieces, cut between words."""
    parts, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            # The first white space after a piece's size; none if a word goes on.
            spaces = _SPACE[np.frombuffer(data, np.uint8, min(end, at + 2 * PIECE) - at - PIECE, at + PIECE)]
            step = PIECE
            while not spaces.any() and at + step + PIECE < end:
                step += PIECE
                spaces = _SPACE[np.frombuffer(data, np.uint8, min(PIECE, end - at - step), at + step)]
            end = at + step + int(spaces.argmax()) if spaces.any() else end
        raw = np.frombuffer(data, np.uint8, end - at, at)
        space = np.r_[True, _SPACE[raw], True]
        begins, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        if len(begins):
            sizes = ends - begins
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            value = np.add.reduceat(_LETTER[raw[np.repeat(begins, sizes) + step]] * powers(step), np.cumsum(sizes) - sizes)
            parts.append((begins + at, ends + at, mix(value + sizes.astype(np.uint64))))
        at = end
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def least_of_windows(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width``."""
    n = len(v) - width + 1
    if n <= 0:
        return np.empty(0, v.dtype)
    pad = -len(v) % width
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], upto[width - 1 : width - 1 + n])


def shingles(ws: list[bytes], size: int = WORDS) -> np.ndarray:
    """Distinct shingles of ``size`` words, sorted; of fewer words, the whole sequence as one; of none, none."""
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(ws, dtype=object), categorize=False)
    n = len(h)
    if n < size:
        return fold([np.full(1, n, dtype=np.uint64), *(h[i : i + 1] for i in range(n))])
    return np.unique(fold([h[i : n - size + 1 + i] for i in range(size)]))


def digest(values: np.ndarray) -> int:
    """A signed 64-bit name of an array."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)
