"""Words of many texts at once, as numpy arrays over their joined bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ROOM = 1 << 20
#: One random 64-bit number per byte value; fixed, as hashes travel between executors.
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE^0 ... BASE^(n-1) modulo 2^64, or of its inverse."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        size = max(n, _ROOM + 4096)
        steps = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = _POWERS[inverse] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of code[byte] * BASE^position: the substrings' hashes come by difference."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * powers(len(raw)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, the same wherever the bytes stand."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts]
    return mix(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the texts, each ended by a line feed; where each text starts, and the end)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return raw, offsets


def spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True; the last byte must be False."""
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if len(is_word) and is_word[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]
