"""Numpy helpers over the UTF-8 bytes of many texts at once.

Texts are joined with one separator byte, so one pass of vector operations tokenises and hashes a whole block of
documents. Blocks hold about ``BLOCK`` bytes, or one longer text; nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 20

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def blocks(texts: Iterable[str | None], size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts as UTF-8, each of about ``size`` bytes, with the index of the first; null is empty."""
    first, total, run = 0, 0, []
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if run and total + len(raw) > size:
            yield first, run
            first, total, run = i, 0, []
        run.append(raw)
        total += len(raw)
    if run:
        yield first, run


def joined(run: list[bytes], separator: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a run with a separator after each text, and where each text begins and ends."""
    sizes = np.fromiter(map(len, run), np.int64, len(run))
    ends = np.cumsum(sizes + 1) - 1
    return np.frombuffer(separator.join([*run, b""]), np.uint8), ends - sizes, ends


def words(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; the last value must be false."""
    if not inside.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    steps = np.diff(inside.view(np.int8), prepend=np.int8(0))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as they are needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> None:
        if self.up.size < n:
            size = max(n, 2 * self.up.size)
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, _U)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """prefix[i]: the polynomial of the first i values."""
        self.reach(values.size + 1)
        out = np.zeros(values.size + 1, _U)
        np.cumsum(values.astype(_U) * self.up[: values.size], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each span of the values, the same wherever the span stands."""
        return mixed((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(_U))


POWERS = tuple(Powers(b) for b in _BASES)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    powers = POWERS[which]
    return powers.spans(powers.prefix(data), starts, ends)


def gram_hashes(word_hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each run of n consecutive words, over a whole block: runs that leave a text are for the caller to drop."""
    count = word_hashes.size - n + 1
    if count <= 0:
        return np.empty(0, _U)
    powers = POWERS[which]
    starts = np.arange(count)
    return powers.spans(powers.prefix(word_hashes), starts, starts + n)


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The best of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: out.size - step], out[step:])
        have += step
    return out


#: ASCII white space as the contracts have it.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
