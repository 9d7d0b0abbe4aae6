"""Words of many texts at once: where they lie and a hash of each, without a Python object
for any of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from duebook.llm.common import give_back

BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 2 ** 20
LONG_WORD = 256
BLANK, LINE = 32, 10
#: Numbers in place of bytes, for a second hash.
OTHER_LETTERS = np.random.default_rng(1).integers(1, 2 ** 32, 256, dtype=np.uint64)
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def slices(batches, name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts) of runs of rows with about SLICE_BYTES of text; null is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, before + SLICE_BYTES)) + 1, batch.num_rows)
            yield batch.slice(at, to - at), [
                b"" if x is None else x for x in column.slice(at, to - at).to_pylist()]
            at = to
    Powers.up = Powers.down = Powers.up[:1].copy()      # a later stage may have no use for them
    give_back()


class Powers:
    """Powers of BASE modulo 2^64, and of its inverse, as far as asked for."""
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) >= n:
            return cls.up[:n], cls.down[:n]
        both = []
        for factor in (int(BASE), pow(int(BASE), -1, 2 ** 64)):
            row = np.full(max(n, SLICE_BYTES + SLICE_BYTES // 4), factor, dtype=np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        if n <= 2 * SLICE_BYTES:        # what one very long text needs is not kept
            cls.up, cls.down = both
        return both[0][:n], both[1][:n]


class Texts:
    """Texts laid end to end. `table` is applied to their bytes first; then words are what
    blanks and line feeds divide, and a line feed ends a piece, as a text's end does."""

    def __init__(self, texts: list[bytes], table: bytes = SPACES):
        self.data = b"\n".join([t.translate(table) for t in texts] + [b""])
        self.letters = np.frombuffer(self.data, dtype=np.uint8)
        apart = (self.letters == BLANK) | (self.letters == LINE)
        turns = np.flatnonzero(np.diff(apart, prepend=True, append=True))
        self.starts, self.stops = turns[::2], turns[1::2]
        self.hashes = self._hashed(self.letters, 0)
        # The number of words up to each text's end.
        self.ends = np.searchsorted(self.starts, np.cumsum([len(t) + 1 for t in texts]))

    def _hashed(self, letters: np.ndarray, seed: int) -> np.ndarray:
        """A polynomial of each word's letters modulo 2^64, from sums up to each byte. Long
        words, for which such polynomials have known collisions, are hashed otherwise."""
        up, down = Powers.upto(len(letters) + 1)
        sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.multiply(letters, up[:-1], out=sums[1:], dtype=np.uint64)
        np.cumsum(sums, out=sums)
        size = self.stops - self.starts
        own = (sums[self.stops] - sums[self.starts]) * down[self.starts]
        own += size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            own[k] = xxhash.xxh64_intdigest(self.data[self.starts[k]:self.stops[k]], seed)
        return own

    def pieces(self) -> np.ndarray:
        """For each word the number of its piece."""
        return np.cumsum(self.letters == LINE)[self.starts]

    def owners(self) -> np.ndarray:
        """For each word the place of its text."""
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def words(self, first: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Runs of words, each joined by single blanks."""
        data = self.data
        runs = [data[a:b] for a, b in zip(self.starts[first].tolist(),
                                          self.stops[first + count - 1].tolist())]
        return [b" ".join([w for w in r.split(b" ") if w]) if b"  " in r else r for r in runs]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the number of its spelling; and for each spelling a word that has it
        and a second hash. Words are told apart by two hashes, together of 128 bits."""
        _, first, number = np.unique(self.hashes, return_index=True, return_inverse=True)
        again = self._hashed(OTHER_LETTERS[self.letters], 1)
        if (again[first][number] != again).any():
            pairs = np.stack([self.hashes, again], axis=1)
            _, first, number = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
        return number.ravel(), first, again[first]

    def numbered(self) -> tuple[np.ndarray, list[bytes]]:
        """For each word the number of its spelling, and the spellings."""
        number, first, _ = self.distinct()
        return number, self.words(first, np.ones_like(first))

    def beginnings(self, words: np.ndarray, length: int) -> np.ndarray:
        """The first bytes of these words, which have so many, as one number."""
        value = np.zeros(len(words), dtype=np.int64)
        for k in range(length):
            value = value << 8 | self.letters[self.starts[words] + k]
        return value
