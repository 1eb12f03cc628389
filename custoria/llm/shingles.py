"""Word shingles of texts as sorted 64-bit hashes, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 61, 1 << 62)) * 8 + 5
_BASE &= (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype="u8") * np.uint64(2) + np.uint64(1)
#: Bytes of text that are hashed at once.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, "u8")
        self.down = np.ones(1, "u8")

    @staticmethod
    def _grow(table: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(table) < n:
            with np.errstate(over="ignore"):
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
        return table

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.up, self.down = self._grow(self.up, _BASE, n), self._grow(self.down, _INVERSE, n)
        return self.up[:n], self.down[:n]


class Shingler:
    """Sets of distinct shingles of `words` words; a shorter text is one shingle, a text without words none."""

    def __init__(self, words: int):
        self.words = words
        self.powers = Powers()

    def word_hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in a row, and the place of each text's first word (one more at the end)."""
        joined = b" ".join(texts) + b" "
        raw = np.frombuffer(joined, "u1")
        white = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.diff(np.concatenate(([True], white)).astype("i1"))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = self.powers.upto(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, "u8")
            np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
            hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype("u8"))
        sizes = np.fromiter((len(t) + 1 for t in texts), "i8", len(texts))
        first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        return hashes, first

    def _chunks(self, texts: list[bytes]):
        chunk, held = [], 0
        for text in texts:
            if chunk and held + len(text) > CHUNK:
                yield chunk
                chunk, held = [], 0
            chunk.append(text)
            held += len(text)
        if chunk:
            yield chunk

    def sets(self, texts: list[bytes]):
        """Sorted distinct shingle hashes of each text, in order. Letters A-Z are lower-cased."""
        for chunk in self._chunks(texts):
            hashes, first = self.word_hashes([t.lower() for t in chunk])
            with np.errstate(over="ignore"):
                n = max(0, len(hashes) - self.words + 1)
                joint = np.full(n, self.words, "u8")
                for i in range(self.words):
                    joint += hashes[i : i + n] * _PLACE[i]
                joint = mix(joint)
                for a, b in zip(first[:-1], first[1:]):
                    if b - a >= self.words:
                        one = np.sort(joint[a : b - self.words + 1])
                        if len(one) > 1:
                            one = one[np.concatenate(([True], one[1:] != one[:-1]))]
                        yield one
                    elif b > a:
                        yield mix((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
                    else:
                        yield np.zeros(0, "u8")
