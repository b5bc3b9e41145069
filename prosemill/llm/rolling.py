"""Names of substrings and sampled anchors over arrays of units (bytes or hashed words).

A *name* is a 64-bit identifier of the content of a substring.  Names of length 2n are made from the names of length n
at offsets 0 and n, so every name computed is reused by the next doubling.  A window's *anchor* is the position of the
smallest name of length q in it: equal windows have equal anchors at equal offsets, wherever they stand.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_BYTE = np.random.Generator(np.random.Philox(1)).integers(1, 1 << 63, 256, dtype=U64)


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Name of the pair of names (x, y)."""
    z = x * _A
    z += y
    z *= _B
    z ^= z >> U64(32)
    return z


def doubled(names: np.ndarray, n: int) -> np.ndarray:
    """Names of length 2n from those of length n; positions too near the end keep no meaning."""
    out = names.copy()
    if len(names) > n:
        out[:-n] = mix(names[:-n], names[n:])
    return out


def byte_names(buffer: np.ndarray) -> np.ndarray:
    return _BYTE[buffer]


def word_names(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the byte ranges [start, end): sums over powers of an odd base, shifted back to the range's start."""
    n = len(buffer)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[buffer] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts], (ends - starts).astype(U64))


_POWERS: list[np.ndarray] = []
_BASE = 0xA24BAED4963EE407
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, base, U64)]), dtype=U64) for base in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def least(names: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` consecutive names, the first position of its smallest one.

    Windows that leave the array stop at its end.
    """
    low, at, have = names, np.arange(len(names), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        if len(low) > step:
            smaller = low[step:] < low[:-step]
            low, at, old_low, old_at = low.copy(), at.copy(), low, at
            np.copyto(low[:-step], old_low[step:], where=smaller)
            np.copyto(at[:-step], old_at[step:], where=smaller)
        have += step
    return at


def bounds(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each unit, its document's start, its document's end) for concatenated documents."""
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return doc, (ends - lengths)[doc], ends[doc]
