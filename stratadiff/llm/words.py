"""Words of many texts at once, as arrays: where each begins and ends, and a hash of 64 bits (no loop over words)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow.compute as pc

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: An odd number, so it has an inverse among numbers of 64 bits.
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
#: Characters of texts to work on at a time.
AT_ONCE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTES = mix(np.arange(1, 257, dtype=np.uint64) * M1)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        each = np.full((1 << bits) + 1, x, np.uint64)
        each[0] = 1
        both.append(np.cumprod(each))
    return both[0], both[1]


class Runs:
    """Hashes of runs of ``values``: each run's sum of value times a power of its place in the run, and its length, mixed."""

    def __init__(self, values: np.ndarray):
        powers, self.back = _powers(max(16, len(values).bit_length()))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the values from a up to b, for each pair."""
        return mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64) * M1)


class Words:
    """starts and ends (bytes) and hashes of all words of ``texts``, one text after another, each followed by a line feed; upto: for
    each text, where its words end. Words are separated by white space of ASCII."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = _SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(space, prepend=True))  # a text ends with white space, so each start has an end
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = Runs(_BYTES[self.bytes]).hashes(self.starts, self.ends)
        self.upto = np.searchsorted(self.starts, np.cumsum([len(t) + 1 for t in texts])) if texts else np.zeros(0, np.int64)
        self.begin = np.concatenate([[0], self.upto[:-1]]).astype(np.int64) if texts else self.upto


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def slices(batches, column: int):
    """Slices of Arrow batches with about ``AT_ONCE`` characters in a column of texts; one row at least."""
    for batch in batches:
        lengths = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + AT_ONCE, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
