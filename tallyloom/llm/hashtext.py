"""Linear models on hashed text: word and character n-gram frequencies, fitted on a bounded sample.

A text's score is the sum of the mean weights of its words, of its word pairs and of its character trigrams, each
found by hash. A word that equals the one before it also counts under a mark of its own. Scoring needs
three gathers for each slice of an Arrow batch, and no object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Hasher, Words, received, send, shingles, slices

WORD_BITS, PAIR_BITS, TRIGRAM_BITS = 17, 17, 16
#: First slot of words, pairs and trigrams, and the number of all slots.
BASES = [0, 1 << WORD_BITS, (1 << WORD_BITS) + (1 << PAIR_BITS)]
SLOTS = BASES[-1] + (1 << TRIGRAM_BITS)
#: Labelled documents of each class that a model is fitted on, at most.
SAMPLE_DOCS = 1200
#: Frequencies are multiplied by it, which only sets the scale of weights.
SCALE = 30.0
#: t statistics from which on a slot counts at all, and in full.
TELLING = (2.0, 6.0)
_AGAIN = np.uint64(0x2545F4914F6CDD1D)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def hashed(column: pa.Array, hasher: Hasher) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of a slice, and (slot, row) of its word features, word pairs and trigrams of code points."""
    words = Words(column, ALNUM, hasher)
    row = words.row_of_word()
    pair = np.flatnonzero(row[1:] == row[:-1]) + 1
    again = pair[words.hash[pair] == words.hash[pair - 1]]
    of = lambda h, bits: (h >> np.uint64(64 - bits)).astype(np.int64)
    parts = [(of(np.concatenate([words.hash, np.full(len(again), _AGAIN)]), WORD_BITS), np.concatenate([row, row[again]])), (BASES[1] + of(shingles(words.hash, 2)[pair - 1], PAIR_BITS), row[pair])]
    point = np.frombuffer(words.raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    if len(point) < 3:
        return words, [*parts, (np.empty(0, np.int64), np.empty(0, np.int64))]
    begun = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])[words.off]
    point_row = np.repeat(np.arange(words.rows()), np.diff(begun))
    whole = point_row[2:] == point_row[:-2]
    # three code points of 21 bits are one number
    code = ((point[:-2].astype(np.uint64) << np.uint64(42)) | (point[1:-1].astype(np.uint64) << np.uint64(21)) | point[2:]) * _SPREAD
    return words, [*parts, (BASES[2] + of(code[whole], TRIGRAM_BITS), point_row[2:][whole])]


def scores(column: pa.Array, hasher: Hasher, weights: np.ndarray) -> np.ndarray:
    """Linear score of each row."""
    words, parts = hashed(column, hasher)
    out = np.zeros(words.rows())
    for slot, row in parts:
        n = np.bincount(row, minlength=len(out))
        out += np.bincount(row, weights=weights[slot], minlength=len(out)) / np.maximum(n, 1) * SCALE
    return out


class Design:
    """Sparse rows of a sample: frequencies of slots, in twelve bytes each."""

    def __init__(self, rows: list[tuple[bytes, bytes]]) -> None:
        self.slot = np.concatenate([np.frombuffer(a, dtype=np.int32) for a, _ in rows] or [np.empty(0, np.int32)])
        self.value = np.concatenate([np.frombuffer(b, dtype=np.float32) for _, b in rows] or [np.empty(0, np.float32)])
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(a) // 4 for a, _ in rows])
        self.rows = len(rows)

    @classmethod
    def of(cls, slots: pa.Array, values: pa.Array) -> Design:
        """From binary columns, without an object for each row."""
        out = cls([])
        out.slot, out.value = (np.concatenate([np.empty(0, t), *(cls._flat(c, t) for c in column.chunks)]) for column, t in ((slots, np.int32), (values, np.float32)))
        out.rows = len(slots)
        out.row = np.repeat(np.arange(out.rows, dtype=np.int32), pc.divide(pc.binary_length(slots), 4).to_numpy())
        return out

    @staticmethod
    def _flat(column: pa.Array, kind: type) -> np.ndarray:
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data, dtype=kind, count=int(at[-1] - at[0]) // 4, offset=int(at[0])) if data is not None and at[-1] > at[0] else np.empty(0, kind)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.slot] * self.value, minlength=self.rows)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.slot, weights=g[self.row] * self.value, minlength=size)


def sampled(docs: DataFrame, classes: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[Design, np.ndarray, np.ndarray, np.ndarray]:
    """Design, class, fold (0 to 4) and weight (the share of all labelled documents that a row stands for) of at most sample_docs documents of each class, the first by hash.

    classes: (doc_id, grade). The sample has a bound, so its ids may be broadcast and its features collected."""
    sizes = {r["grade"]: r["count"] for r in classes.where("grade is not null").groupBy("grade").count().collect()}  # a row per class
    labelled = classes.where("doc_id is not null").select("doc_id", "grade", F.xxhash64("doc_id", F.lit("sample")).alias("draw"))
    chosen = None
    for g in sorted(sizes):
        part = labelled.where(F.col("grade") == g).orderBy("draw", "doc_id").limit(sample_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return Design([]), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    picked = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch):
                words, parts = hashed(part.column("text"), hasher)
                slots, values = [[] for _ in range(words.rows())], [[] for _ in range(words.rows())]
                for slot, row in parts:
                    order = np.argsort(row, kind="stable")
                    at = np.searchsorted(row[order], np.arange(words.rows() + 1))
                    for r in range(words.rows()):
                        found, n = np.unique(slot[order[at[r] : at[r + 1]]], return_counts=True)
                        slots[r].append(found.astype(np.int32))
                        values[r].append((n / max(1, n.sum()) * SCALE).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("grade"), part.column("draw"), pa.array([np.concatenate(x).tobytes() for x in slots], pa.binary()), pa.array([np.concatenate(x).tobytes() for x in values], pa.binary())],
                    ["grade", "draw", "slots", "freqs"],
                )

    found = picked.mapInArrow(features, "grade int, draw long, slots binary, freqs binary").toArrow()
    found = found.take(pc.sort_indices(found, sort_keys=[("draw", "ascending"), ("slots", "ascending")]))
    design = Design.of(found["slots"], found["freqs"])
    grade = np.array(found["grade"].to_pylist(), dtype=np.int64)
    draw = np.array(found["draw"].to_pylist(), dtype=np.int64)
    del found
    pa.default_memory_pool().release_unused()
    share = {g: sizes[g] / sum(sizes.values()) / max(1, int((grade == g).sum())) for g in sizes}
    return design, grade, draw % 5, np.array([share[g] for g in grade.tolist()])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def telling(design: Design, grade: np.ndarray, least: float = TELLING[0], full: float = TELLING[1]) -> np.ndarray:
    """How much each slot counts: 1 / standard deviation where the means of some grade and the others differ by a t of
    `full` or more, less by the fourth power of t / full below, 0 below `least`. Keeps the many rare slots from fitting noise."""
    size, n = SLOTS, design.rows
    total = np.bincount(design.slot, weights=design.value, minlength=size)
    square = np.bincount(design.slot, weights=np.square(design.value, dtype=np.float64), minlength=size)
    spread = np.maximum(square / max(1, n) - (total / max(1, n)) ** 2, 1e-12)
    best = np.zeros(size)
    for g in np.unique(grade):
        mine = grade == g
        k = int(mine.sum())
        if k < n:
            own = np.bincount(design.slot, weights=design.value * mine[design.row], minlength=size)
            best = np.maximum(best, np.abs(own / k - (total - own) / (n - k)) / np.sqrt(spread * (1 / k + 1 / (n - k))))
    return np.where(best >= least, np.minimum(1.0, best / full) ** 4 / np.sqrt(spread), 0.0)


def fit_cumulative_link(design: Design, grade: np.ndarray, grades: int, weight: np.ndarray | None = None, steps: int = 200, decay: float = 1e-2, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of P(y <= k) = sigmoid(threshold[k] - score). weight: of each row, alike if None.

    Only telling slots get a weight, on standardised frequencies. Thresholds are a first one and positive gaps. Adam
    steps over all rows, from zero weights."""
    size = SLOTS
    w, free = np.zeros(size), np.concatenate([[-0.7], np.full(grades - 2, 0.3)])
    if not design.rows:
        return w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
    scale = telling(design, grade)
    part = copy(design)
    used = scale[design.slot] > 0
    part.slot, part.row = design.slot[used], design.row[used]
    part.value = design.value[used] * scale[part.slot]
    design = part
    del used
    share = np.full(len(grade), 1 / len(grade)) if weight is None else weight / weight.sum()
    moments = [np.zeros(size), np.zeros(size), np.zeros(len(free)), np.zeros(len(free))]
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        f = design.dot(w)
        high = np.where(grade < grades - 1, sigmoid(cuts[np.minimum(grade, grades - 2)] - f), 1.0)
        low = np.where(grade > 0, sigmoid(cuts[np.maximum(grade - 1, 0)] - f), 0.0)
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high), low * (1 - low)
        back = share * (dh - dl) / p  # of the loss by f
        by_cut = np.bincount(np.minimum(grade, grades - 2), weights=-share * dh / p * (grade < grades - 1), minlength=grades - 1)
        by_cut += np.bincount(np.maximum(grade - 1, 0), weights=share * dl / p * (grade > 0), minlength=grades - 1)
        tail = np.cumsum(by_cut[::-1])[::-1]
        by_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        for x, g, k in ((w, design.back(back, size) + decay * w, 0), (free, by_free, 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * g * g
            x -= rate * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 1] / (1 - 0.99**t)) + 1e-8)
    return w * scale, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def scored(docs: DataFrame, weights: np.ndarray, name: str = "__linear") -> DataFrame:
    """docs with a column of this name, which they may not have: the score of each whole text, 0 for a null or empty one."""
    sent = send(docs.sparkSession, weights.astype(np.float32))  # of fixed size
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = Hasher(), received(sent)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(part.column("text"), hasher, w))], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)
