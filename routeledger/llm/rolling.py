"""Words of a batch of texts, their hashes and the hashes of word runs, with numpy.

Texts are taken as one run of UTF-8 bytes with offsets, as Arrow holds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SLICE_BYTES = 2 << 20  # text hashed at a time; a longer document is a slice of its own


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_odd(seed: int, start: int, stop: int) -> np.ndarray:
    n = np.arange(start, stop, dtype=U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix(n * U64(0x9E3779B97F4A7C15)) | U64(1)


class Words:
    """Words (runs of bytes that are no white space) of ``texts``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        raw = texts.buffers()[2]
        self.data = (
            np.frombuffer(raw, dtype=np.uint8, count=base + size)[base:]
            if size
            else np.zeros(0, dtype=np.uint8)
        )
        self.offsets = offsets - base
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = np.where(upper, self.data + 32, self.data).astype(np.uint8)
        inside = ~SPACE[self.data]
        first, last = inside.copy(), inside.copy()
        edges = self.offsets[(self.offsets > 0) & (self.offsets < size)]
        before = np.concatenate([[False], inside[:-1]]) if size else inside
        before[edges] = False
        after = np.concatenate([inside[1:], [False]]) if size else inside
        after[edges - 1] = False
        first &= ~before
        last &= ~after
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        # Words of document d: bounds[d] to bounds[d + 1].
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word: random multiples of its bytes, place by place."""
        out = np.zeros(len(self), dtype=U64)
        letters = random_odd(seed, 0, 256)
        lengths = self.ends - self.starts
        longest = int(lengths.max()) if len(self) else 0
        places = random_odd(seed + 1, 0, longest)
        done = 0
        while done < len(self):
            stop = int(np.searchsorted(self.ends, self.starts[done] + SLICE_BYTES, side="right"))
            stop = max(stop, done + 1)
            a, b = self.starts[done], self.ends[stop - 1]
            body = self.data[a:b][self.inside[a:b]]
            size = lengths[done:stop]
            at = np.cumsum(size) - size
            place = np.arange(len(body)) - np.repeat(at, size)
            out[done:stop] = np.add.reduceat(letters[body] * places[place], at)
            done = stop
        return mix(out + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))

    def windows(self, hashes: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and Rabin-Karp hashes of all runs of ``size`` words.

        With p(i) the sum of hash(j) * B^j over the words before i, the hash of the run
        at i is (p(i + size) - p(i)) * B^-i modulo 2^64, so each costs the same.
        """
        n = len(hashes)
        last = self.bounds[1:][self.document()] - size if n else np.zeros(0, dtype=np.int64)
        starts = np.flatnonzero(np.arange(n) <= last)
        if not len(starts):
            return starts, np.zeros(0, dtype=U64)
        base = int(random_odd(seed, 7, 8)[0])
        inverse = pow(base, -1, 1 << 64)
        power = np.full(n, base, dtype=U64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        prefix = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(hashes * power, dtype=U64)])
        power = np.full(n, inverse, dtype=U64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        return starts, mix((prefix[starts + size] - prefix[starts]) * power[starts])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of ``texts`` of about ``limit`` bytes, with their first index."""
    lengths = np.diff(np.frombuffer(texts.cast(pa.large_string()).buffers()[1], dtype=np.int64))
    total = np.cumsum(lengths)
    start = 0
    while start < len(texts):
        before = int(total[start - 1]) if start else 0
        stop = max(int(np.searchsorted(total, before + limit, side="right")), start + 1)
        yield start, texts.slice(start, stop - start)
        start = stop
