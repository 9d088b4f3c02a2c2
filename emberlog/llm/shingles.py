"""Hashed word shingles of whole texts, vectorised over the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes hashed at once; a longer text is taken in blocks that end at white space.
BLOCK = 1 << 20

_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashed shingles of k words; words are split at \\x20 and \\x09-\\x0D, A-Z is lower-cased.

    A word's hash is a polynomial in an odd base modulo 2**64 over random values of its bytes, read off prefix sums of
    the block and shifted by powers of the base's inverse. A text with fewer than k words has one shingle, the whole
    sequence, and one without words none.
    """

    def __init__(self, k: int):
        import numpy as np

        rng = np.random.default_rng(20240607)
        self.k = k
        self.values = rng.integers(1, 1 << 63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
        self.values[65:91] = self.values[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, "uint64")

    def _powers(self, n: int) -> None:
        import numpy as np

        if len(self.powers) < n:
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base, "uint64")], dtype="uint64")
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n, self.inverse, "uint64")], dtype="uint64")

    def word_hashes(self, raw):
        """Hashes of the words in an array of bytes, in order."""
        import numpy as np

        parts, at = [], 0
        while at < len(raw):
            stop = min(len(raw), at + BLOCK)
            while stop < len(raw) and not self.blank[raw[stop]]:
                stop += 1
            block = raw[at:stop]
            inside = np.zeros(len(block) + 2, bool)
            inside[1:-1] = ~self.blank[block]
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            first, last = edge[::2], edge[1::2]
            self._powers(len(block) + 1)
            sums = np.zeros(len(block) + 1, "uint64")
            np.cumsum(self.values[block] * self.powers[: len(block)], out=sums[1:])
            parts.append(mix((sums[last] - sums[first]) * self.inverses[first] + (last - first).astype("uint64")))
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, "uint64")

    def combine(self, words):
        """Hashes of the shingles of a text's words, in order; copies of the same shingle too."""
        import numpy as np

        if not len(words):
            return words
        k = min(self.k, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, "uint64")
        for i in range(k):
            out = mix(out * np.uint64(self.base) + words[i : i + n])
        return out

    def sets(self, column) -> Iterator:
        """The sorted distinct shingles of each text of an Arrow string column."""
        import numpy as np
        import pyarrow as pa

        column = column.cast(pa.large_binary())
        for i in range(len(column)):
            text = column[i]
            raw = np.frombuffer(text.as_buffer(), "uint8") if text.is_valid and len(text.as_buffer()) else np.zeros(0, "uint8")
            yield np.unique(self.combine(self.word_hashes(raw)))
