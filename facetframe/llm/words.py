"""Words of many texts at once, as byte positions and 64-bit hashes in numpy arrays.

Both word classes used here treat every byte from 0x80 up as part of a word, so
splitting UTF-8 bytes gives the same words as splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000
_BLOCK_BYTES = 500_000
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _class(members) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(members)] = True
    return flags


#: Everything but white space of the ASCII range.
SPACED = ~_class([0x20, *range(0x09, 0x0E)])
#: ASCII letters and digits and everything beyond ASCII.
LETTERED = _class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, encoded texts) of runs of about limit bytes; a null is an empty text."""
    start, held, total = 0, [], 0
    for i in range(len(texts)):
        value = texts[i].as_py()
        data = b"" if value is None else value.encode("utf-8") if isinstance(value, str) else value
        if held and total + len(data) > limit:
            yield start, held
            start, held, total = i, [], 0
        held.append(data)
        total += len(data)
    if held:
        yield start, held


class Words:
    """All words of some texts: text number, byte span and hash of each, in order."""

    def __init__(self, texts: list[bytes], members: np.ndarray, lower: bool = True, gap: bytes = b"\n"):
        self.data = np.frombuffer(gap.join(texts) + gap, dtype=np.uint8)
        if lower:
            self.data = LOWER[self.data]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths)
        inside = members[self.data].view(np.int8)
        edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.text = np.searchsorted(ends, self.starts, side="right")
        self.count = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(self.starts):
            low = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, low + _BLOCK_BYTES, side="right")))
            high = self.ends[stop - 1]
            size = int(high - low)
            power, inverse = powers(size)
            sums = np.empty(size + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * power[:size], out=sums[1:])
            s, e = self.starts[at:stop] - low, self.ends[at:stop] - low
            out[at:stop] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = stop
        return out

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of so many words that stays in one text."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        total = np.zeros(n, dtype=np.uint64)
        for k in range(length):
            total = total * np.uint64(_MULTIPLIER) + self.hashes[k : k + n]
        whole = np.flatnonzero(self.text[:n] == self.text[length - 1 :])
        return whole, mixed(total[whole])


_POWERS: dict[str, np.ndarray] = {}


def forget_powers() -> None:
    """Drop the tables on the driver, so that they do not travel with functions."""
    _POWERS.clear()


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least size of each."""
    if len(_POWERS.get("up", ())) < size:
        n = max(size, 1 << 16)
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]
