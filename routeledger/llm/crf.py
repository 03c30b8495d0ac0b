"""A linear-chain conditional random field over word shapes, in numpy.

A sequence is a stretch of text cut into tokens (letters, digits, single other
characters). Each token has a few whole numbers that describe its shape; features are
hashes of these numbers around a token, so weights form one table of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
GROUP = re.compile(r"[0-9](?:[\s().+/-]{0,3}[0-9])*")
CHUNK = re.compile(r"\S+")
HASHED = 1 << 13
REACH = 3  # tokens to either side that a feature looks at
PADDED_TOKENS = 100_000  # tokens, padding included, that are decoded at once
BARRED = -1e4  # score of a transition that no labelling has

# Words whose identity counts besides their shape.
CUES = (
    "account address at call card cell contact credit date dot email fax host invoice ip isbn "
    "mail mastercard mobile no number order page phone price server tel telephone token "
    "version visa"
).split()
_CUE = {w: k + 1 for k, w in enumerate(CUES)}

# Features: which of a token's numbers are hashed together, each as (number, offset).
SHAPE, CUE, GAP, DIGITS, CHUNKS = range(5)
FEATURES = [
    *[[(SHAPE, k)] for k in range(-REACH, REACH + 1)],
    *[[(CUE, k)] for k in range(-REACH, REACH + 1)],
    *[[(DIGITS, k)] for k in (-1, 0, 1)],
    *[[(CHUNKS, k)] for k in (-1, 0, 1)],
    [(GAP, 0)], [(GAP, 1)],
    [(SHAPE, -1), (SHAPE, 0)], [(SHAPE, 0), (SHAPE, 1)], [(SHAPE, -1), (SHAPE, 0), (SHAPE, 1)],
    [(SHAPE, 0), (GAP, 0), (GAP, 1)], [(SHAPE, 0), (DIGITS, 0)], [(SHAPE, 0), (CHUNKS, 0)],
    [(SHAPE, -1), (GAP, 0), (DIGITS, 0)], [(DIGITS, 0), (GAP, 0), (CUE, -1)],
]


def _shape(token: str) -> int:
    if token[0].isalpha():
        case = 0 if token.islower() else 1 if token.isupper() else 2 if token.istitle() else 3
        return 1 + 4 * min(len(token), 8) + case
    if "0" <= token[0] <= "9":
        return 100 + min(len(token), 20)
    return 200 + ord(token[0]) % 4096


def _folded(chunk: str) -> int:
    """The chunk's first characters with runs of letters and of digits as one sign each."""
    text = re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", chunk[:48]))
    return zlib.crc32(text.encode()) % 4096


def tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, and their numbers, one row per token."""
    found = list(TOKEN.finditer(text))
    at = np.array([(m.start(), m.end()) for m in found], np.int64).reshape(-1, 2)
    rows = np.zeros((len(found), 5), np.int64)
    digits, chunks = np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1, np.int64)
    for m in GROUP.finditer(text):
        digits[m.start() : m.end()] = min(sum(c.isdigit() for c in m.group()), 20)
    for m in CHUNK.finditer(text):
        chunks[m.start() : m.end()] = 1 + _folded(m.group())
    end = 0
    for k, m in enumerate(found):
        token, start = m.group(), m.start()
        gap = text[end:start]
        rows[k, :3] = _shape(token), _CUE.get(token.lower(), 0), 0 if not gap else 2 if "\n" in gap else 1
        end = m.end()
    if len(found):
        rows[:, DIGITS], rows[:, CHUNKS] = digits[at[:, 0]], chunks[at[:, 0]]
    return at, rows


def feature_ids(sequences: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Ids of the features of every token, one array (tokens x features) per sequence."""
    pad = np.full((REACH, 5), 9999, np.int64)
    flat = np.concatenate([x for s in sequences for x in (pad, s)] + [pad]).astype(np.uint64)
    n = len(flat) - 2 * REACH
    ids = np.empty((n, len(FEATURES)), np.int64)
    with np.errstate(over="ignore"):
        for f, parts in enumerate(FEATURES):
            mixed = np.full(n, f + 1, np.uint64)
            for number, offset in parts:
                mixed = (mixed ^ flat[REACH + offset : REACH + offset + n, number]) * np.uint64(
                    0x9E3779B97F4A7C15
                )
                mixed ^= mixed >> np.uint64(29)
            ids[:, f] = mixed % np.uint64(HASHED)
    out, at = [], 0
    for s in sequences:
        out.append(ids[at : at + len(s)])
        at += len(s) + REACH
    return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Crf:
    """``labels`` come as ``O`` and pairs ``B-kind``, ``I-kind``; I follows its own B or I only."""

    def __init__(self, kinds: Sequence[str]):
        self.kinds = list(kinds)
        self.labels = ["O"] + [f"{p}-{k}" for k in kinds for p in "BI"]
        size = len(self.labels)
        self.weights = np.zeros((HASHED, size))
        self.moves = np.zeros((size, size))
        self.barred = np.zeros((size, size))
        self.first = np.zeros(size)
        for j in range(2, size, 2):
            self.barred[:, j] = BARRED
            self.barred[[j - 1, j], j] = 0
            self.first[j] = BARRED

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), len(self.labels)))
        for f in range(ids.shape[1]):
            out += self.weights[ids[:, f]]
        return out

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of the sum over all labellings, label and (summed) transition probabilities.

        ``scores`` is sequences x tokens x labels, padded behind ``lengths``.
        """
        n, t_max, size = scores.shape
        moves = self.moves + self.barred
        ahead = np.empty_like(scores)
        ahead[:, 0] = self.first + scores[:, 0]
        for t in range(1, t_max):
            step = scores[:, t] + log_sum(ahead[:, t - 1, :, None] + moves, 1)
            ahead[:, t] = np.where((t < lengths)[:, None], step, ahead[:, t - 1])
        total = log_sum(ahead[:, -1], 1)
        behind = np.zeros_like(scores)
        pairs = np.zeros((size, size))
        for t in range(t_max - 1, 0, -1):
            inside = (t < lengths)[:, None]
            right = scores[:, t] + behind[:, t]
            path = ahead[:, t - 1, :, None] + moves + right[:, None] - total[:, None, None]
            pairs += (np.exp(path) * inside[:, :, None]).sum(axis=0)
            behind[:, t - 1] = np.where(inside, log_sum(moves + right[:, None], 2), behind[:, t])
        chance = np.exp(ahead + behind - total[:, None, None])
        chance *= (np.arange(t_max) < lengths[:, None])[:, :, None]
        return total, chance, pairs

    def fit(self, ids: list[np.ndarray], labels: list[np.ndarray], steps: int = 40,
            rate: float = 0.15, shrink: float = 2e-3) -> list[float]:
        """Maximise the labels' penalised log likelihood (Adam on all sequences at once)."""
        lengths = np.array([len(s) for s in ids])
        n, t_max, size = len(ids), lengths.max(), len(self.labels)
        inside = np.arange(t_max) < lengths[:, None]
        flat = np.concatenate(ids)
        gold = np.concatenate(labels)
        seen = np.zeros((size, size))
        for own in labels:
            np.add.at(seen, (own[:-1], own[1:]), 1)
        wanted = np.zeros((len(flat), size))
        wanted[np.arange(len(flat)), gold] = 1
        moment = [np.zeros_like(x) for x in (self.weights, self.moves) * 2]
        losses = []
        for step in range(1, steps + 1):
            scores = np.zeros((n, t_max, size))
            scores[inside] = self.emissions(flat)
            total, chance, pairs = self.posteriors(scores, lengths)
            right = scores[inside][np.arange(len(flat)), gold].sum()
            right += ((self.moves + self.barred) * seen).sum()
            losses.append(float(total.sum() - right) / n)
            off = (chance[inside] - wanted) / n
            grown = np.empty_like(self.weights)
            every = np.repeat(off, flat.shape[1], axis=0)
            for k in range(size):
                grown[:, k] = np.bincount(flat.ravel(), every[:, k], HASHED)
            slopes = [grown + shrink * self.weights / 10, (pairs - seen) / n + shrink * self.moves / 10]
            for k, (value, slope) in enumerate(zip((self.weights, self.moves), slopes)):
                moment[k] = 0.9 * moment[k] + 0.1 * slope
                moment[k + 2] = 0.999 * moment[k + 2] + 0.001 * slope**2
                size_of = np.sqrt(moment[k + 2] / (1 - 0.999**step)) + 1e-8
                value -= rate * moment[k] / (1 - 0.9**step) / size_of
        return losses

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labelling of each sequence; ties go to the earlier label."""
        n, t_max, _ = scores.shape
        moves = self.moves + self.barred
        back = np.zeros(scores.shape, np.int8)
        best = self.first + scores[:, 0]
        stay = np.arange(scores.shape[2], dtype=np.int8)
        for t in range(1, t_max):
            path = best[:, :, None] + moves
            inside = (t < lengths)[:, None]
            back[:, t] = np.where(inside, path.argmax(axis=1), stay)
            best = np.where(inside, path.max(axis=1) + scores[:, t], best)
        found = np.empty((n, t_max), np.int8)
        found[:, -1] = best.argmax(axis=1)
        for t in range(t_max - 1, 0, -1):
            found[:, t - 1] = back[np.arange(n), t, found[:, t]]
        return found

    def spans(self, texts: Sequence[str]) -> list[list[tuple[str, int, int]]]:
        """``(kind, start, end)`` in each text, decoded in batches of similar length."""
        cut = [tokens(t) for t in texts]
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        order = sorted((k for k in range(len(texts)) if len(cut[k][0])), key=lambda k: len(cut[k][0]))
        while order:
            size, n = 0, 0
            while n < len(order) and (n == 0 or (n + 1) * len(cut[order[n]][0]) <= PADDED_TOKENS):
                size, n = len(cut[order[n]][0]), n + 1
            some, order = order[:n], order[n:]
            ids = feature_ids([cut[k][1] for k in some])
            lengths = np.array([len(i) for i in ids])
            scores = np.zeros((n, size, len(self.labels)))
            scores[np.arange(size) < lengths[:, None]] = self.emissions(np.concatenate(ids))
            for k, labels in zip(some, self.viterbi(scores, lengths)):
                out[k] = self._joined(labels[: len(cut[k][0])], cut[k][0])
        return out

    def _joined(self, labels: np.ndarray, at: np.ndarray) -> list[tuple[str, int, int]]:
        found: list[tuple[str, int, int]] = []
        for k in np.nonzero(labels)[0]:
            kind, begins = self.kinds[(labels[k] - 1) // 2], labels[k] % 2 == 1
            start, end = at[k].tolist()
            if begins:
                found.append((kind, start, end))
            else:
                found[-1] = (kind, found[-1][1], end)
        return found

    def marked(self, text: str, spans: Sequence[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """A labelled text as token numbers and label numbers."""
        at, rows = tokens(text)
        labels = np.zeros(len(at), np.int64)
        for kind, start, end in spans:
            inside = np.nonzero((at[:, 0] >= start) & (at[:, 1] <= end))[0]
            if len(inside):
                labels[inside] = 2 * self.kinds.index(kind) + 2
                labels[inside[0]] -= 1
        return rows, labels
