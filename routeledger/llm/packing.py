"""Packing token streams into sequences: order-preserving dynamic programming.

The stream of a partition, in input order, is cut into windows of at most ``width``
ids. A window costs its padding (none if its length is a power of two), a fixed cost
per sequence and a penalty for where it ends: nothing at the end of a document,
little at the end of a sentence, more inside a sentence. With P(j) the position of
cut j the recurrence is

    best(j) = penalty(j) + min over i of  best(i) + width - (P(j) - P(i)),

so the window minimum of best(i) + P(i) is kept in a monotone queue and every cut is
handled in constant time; the few starts at a distance of a power of two are looked up.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import per_worker, small_batches

WIDTH = 4096
END_ID = 2
SENTENCE_PENALTY = 8
WORD_PENALTY = 64
SEQUENCE_COST = 64
SEGMENT_TOKENS = 1 << 20  # ids held in memory before windows are written
CACHED_WORDS = 100_000  # words per generation of the encoder's cache
CACHED_PIECES = 200_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, padding long"
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Fixed value: how this vocabulary splits a text before the byte pairs are merged.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Characters whose normal form and lower case need no neighbours.
PLAIN = regex.compile(r"[\x21-\x7eÀ-ɏ]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder(dict):
    """Ids (little-endian 32-bit bytes) of white-space separated words.

    Each word is encoded on its own, as the vocabulary never merges across white
    space. Two generations of words are kept, so memory stays bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        ends = regex.compile(r"[.!?]+[\"')]*</w>")
        vocabulary = self.whole.get_vocab()
        self.sentence_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.sentence_end[[i for t, i in vocabulary.items() if ends.fullmatch(t)]] = True

    def __missing__(self, word: bytes) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = self.ids(word.decode())
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed

    def ids(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable() or PLAIN.fullmatch(word)
        if not plain or "<|" in word:
            return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        if word.isalpha():
            return self.piece(word)
        return b"".join(map(self.piece, PIECES.findall(word)))

    def piece(self, piece: str) -> bytes:
        packed = self.pieces.get(piece)
        if packed is None:
            text = piece.encode().decode("latin-1").translate(self.letters)
            packed = array("I", [t.id for t in self.whole.model.tokenize(text)]).tobytes()
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces.clear()
            self.pieces[piece] = packed
        return packed

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> Encoder:
    return per_worker(f"encoder {path}", lambda: Encoder(path))


def choose_cuts(position: list[int], penalty: list[int], width: int) -> list[int]:
    """Indexes of the cheapest cuts; ``position`` starts at 0, gaps are at most ``width``."""
    total = position[-1]
    at = [-1] * (total + 1)
    powers = [1 << k for k in range(width.bit_length()) if 1 << k <= width]
    best, came = [0] * len(position), [0] * len(position)
    queue: deque[tuple[int, int]] = deque()
    for j, here in enumerate(position):
        if j:
            while here - position[queue[0][1]] > width:
                queue.popleft()
            cost, source = queue[0]
            cost += width - here
            for p in powers:
                if p > here:
                    break
                i = at[here - p]
                if i >= 0 and best[i] < cost:
                    cost, source = best[i], i
            best[j], came[j] = cost + penalty[j] + SEQUENCE_COST, source
        at[here] = j
        key = best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    chosen, j = [], len(position) - 1
    while j:
        chosen.append(j)
        j = came[j]
    return chosen[::-1]


class Stream:
    """Documents of one partition on their way into windows."""

    def __init__(self, path: str, width: int, first: int):
        self.encoder, self.width, self.sequence = encoder(path), width, first
        self.end = np.array([END_ID], dtype="<u4").tobytes()
        self.parts: list[bytes] = []
        self.held = 0
        self.docs: list[tuple[int | None, int, int]] = []  # id, start in the buffer, ids

    def add(self, doc_id: int | None, text: bytes) -> None:
        ids = self.encoder.encode(text) + self.end
        self.docs.append((doc_id, self.held, len(ids) // 4))
        self.parts.append(ids)
        self.held += len(ids) // 4

    def cuts(self, ids: np.ndarray, last: bool) -> np.ndarray:
        """Ends of the chosen windows; without ``last`` the final window is left open."""
        n, width = len(ids), self.width
        grade = np.zeros(n + 1, dtype=np.int8)  # 1 sentence, 2 document, 3 inside a sentence
        grade[1:][self.encoder.sentence_end[ids]] = 1
        grade[[start + size for _, start, size in self.docs]] = 2
        if last:  # the tail may fall into powers of two, which need no padding
            tail = grade[max(1, n - width) :]
            tail[tail == 0] = 3
        grade[n] = 2
        known = np.concatenate([[0], np.flatnonzero(grade)])
        gaps = np.flatnonzero(np.diff(known) > width)
        for g in gaps:  # a longer sentence is cut where it must be
            grade[known[g] + width : known[g + 1] : width] = 3
        position = np.concatenate([[0], np.flatnonzero(grade)])
        penalty = np.array([0, SENTENCE_PENALTY, 0, WORD_PENALTY])[grade[position]]
        chosen = choose_cuts(position.tolist(), penalty.tolist(), width)
        ends = position[chosen]
        return ends if last else ends[:-1]

    def flush(self, last: bool) -> pa.RecordBatch | None:
        if not self.held:
            return None
        data = b"".join(self.parts)
        ids = np.frombuffer(data, dtype="<u4")
        ends = self.cuts(ids, last)
        done = int(ends[-1]) if len(ends) else 0
        starts = np.array([max(0, s) for _, s, _ in self.docs])
        real = np.array([s for _, s, _ in self.docs])
        left = np.unique(np.concatenate([starts[starts < done], [0], ends[:-1]]))
        left = left[left < done]
        right = np.concatenate([left[1:], [done]])[: len(left)]
        doc = np.searchsorted(starts, left, side="right") - 1
        window = np.searchsorted(ends, left, side="right")
        begin = np.concatenate([[0], ends])[window] if len(ends) else left
        length = np.diff(np.concatenate([[0], ends]))
        padding = np.where(length & (length - 1) == 0, 0, self.width - length)
        columns = [
            pa.array([self.docs[d][0] for d in doc], pa.int64()),
            pa.array(left - real[doc], pa.int64()),
            pa.array(right - left, pa.int64()),
            pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(left, right)], pa.int64()),
            pa.array([self.docs[d][2] for d in doc], pa.int64()),
            pa.array(self.sequence + window, pa.int64()),
            pa.array(left - begin, pa.int64()),
            pa.array(padding[window] if len(ends) else left, pa.int64()),
        ]
        self.sequence += len(ends)
        kept = [(i, s - done, n) for i, s, n in self.docs if s + n > done]
        self.docs, self.parts, self.held = kept, [data[4 * done :]], len(ids) - done
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays(columns, names=names)


def pack(docs: DataFrame, *, path: str | None = None, width: int = WIDTH) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of at most ``width`` ids.

    Every id of every document lies in exactly one piece, in input order; ``padding``
    is what the piece's sequence is filled up with. Documents of one partition follow
    each other; nothing is shuffled, and a partition leaves one short tail, which is
    cut into powers of two where that is cheaper. At most ``SEGMENT_TOKENS`` ids and
    one document are held at a time. ``sequence_id`` is the partition's number times
    2^40 plus a count. Null text: the end id alone. Repeated rows are packed each. A
    text of any length is cut at sentences, and inside one only if it exceeds
    ``width``. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(path, width, TaskContext.get().partitionId() << 40)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                stream.add(doc_id, text.as_py() or b"")
                if stream.held >= SEGMENT_TOKENS:
                    done = stream.flush(last=False)
                    if done is not None and done.num_rows:
                        yield done
        done = stream.flush(last=True)
        if done is not None:
            yield done

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
