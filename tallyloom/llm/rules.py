"""Quality rules: fixed counts of words, symbols and repetition, and a calibrated logistic model of quality."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import UNSPACED, Hasher, Words, mixed, received, same_bytes, send, shingles, slices, spans
from .hashtext import SAMPLE_DOCS, fit_cumulative_link, sampled, scores
from .langid import fit_logistic

MIN_WORDS, MOST_REPEAT_PERCENT = 50, 50
#: A document is kept when its calibrated probability of good quality reaches it.
KEEP = 0.5
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_ROW = np.uint64(0x9E3779B97F4A7C15)


class Rated:
    """Weights of the text model, and slope and intercept that turn a score into a probability."""

    def __init__(self, weights: np.ndarray, slope: float, intercept: float) -> None:
        self.weights, self.slope, self.intercept = weights.astype(np.float32), slope, intercept


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Rated | None:
    """Fit on four fifths of at most sample_docs labelled documents of each quality, calibrate on the rest."""
    design, quality, fold, weight = sampled(docs, labels.where("quality is not null").selectExpr("doc_id", "cast(quality as int) as grade").where("grade in (0, 1)"), sample_docs)
    if len(set(quality[fold > 0].tolist())) < 2:
        return None
    design_rows = fold[design.row] > 0
    part = type(design)([])
    part.slot, part.value, part.row, part.rows = design.slot[design_rows], design.value[design_rows], np.cumsum(np.concatenate([[0], fold > 0]))[design.row[design_rows]], int((fold > 0).sum())
    weights, _ = fit_cumulative_link(part, quality[fold > 0], 2, weight[fold > 0])
    slope, intercept = fit_logistic(design.dot(weights)[fold == 0], quality[fold == 0].astype(float), weight[fold == 0])
    return Rated(weights, slope, intercept)


def counts(column: pa.Array, hasher: Hasher) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    words = Words(column, UNSPACED, hasher, lower=False)
    raw, off, rows = words.raw, words.off, words.rows()

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

    n_words, row = words.counts(), words.row_of_word()
    begin, end = spans(raw != 0x0A, off)  # lines that aren't empty
    line_row = np.searchsorted(off, begin, side="right") - 1
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end, line_row = begin[worded], end[worded], line_row[worded]
    _, first, which = np.unique(mixed(hasher(raw, begin, end) + line_row.astype(np.uint64) * _ROW), return_index=True, return_inverse=True)
    dup = np.bincount(line_row, minlength=rows) - np.bincount(line_row[first], minlength=rows)
    unsure = set()  # rows in which lines or windows of one hash differ
    again = np.flatnonzero(first[which] != np.arange(len(which)))
    one = first[which[again]]
    unsure |= set(line_row[again[~(same_bytes(raw, begin[again], end[again], raw, begin[one], end[one]) & (line_row[again] == line_row[one]))]].tolist())
    repeat = np.zeros(rows, dtype=np.int64)
    three = shingles(words.hash, 3)
    at = np.flatnonzero(row[2:] == row[:-2])
    if len(at):
        _, first, which, n = np.unique(mixed(three[at] + row[at].astype(np.uint64) * _ROW), return_index=True, return_inverse=True, return_counts=True)
        start = at[n[which] > 1]
        one = at[first[which[n[which] > 1]]]
        for k in range(3):
            same = same_bytes(raw, words.start[start + k], words.end[start + k], raw, words.start[one + k], words.end[one + k])
            wrong = ~(same & (row[start] == row[one]))
            unsure |= {*row[start[wrong]].tolist(), *row[one[wrong]].tolist()}
        covered = np.zeros(len(row), dtype=bool)
        for k in range(3):
            covered[start + k] = True
        repeat = np.bincount(row[covered], minlength=rows)
    for r in unsure:
        dup[r], repeat[r] = _counted(raw[off[r] : off[r + 1]].tobytes())
    return {"n_words": n_words, "word_chars": total(UNSPACED[raw] & ((raw & 0xC0) != 0x80)), "n_symbols": total(SYMBOLS[raw]), "n_dup_lines": dup, "n_repeat_words": repeat}


def _counted(text: bytes) -> tuple[int, int]:
    """n_dup_lines and n_repeat_words of one text, by its bytes."""
    lines = [x for x in text.split(b"\n") if x.split()]
    words = text.split()
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(lines) - len(set(lines)), len(covered)


def apply_rules(docs: DataFrame, rated: Rated | None, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality).

    Words are `[^\\x20\\x09-\\x0D]+`, as written. n_dup_lines counts \\n-split lines with a word that equal an earlier
    one; n_repeat_words the words in three-word windows that occur twice or more in the text, the first
    occurrence included. base_failed: n_words < 50 or 100 * n_repeat_words > 50 * n_words. kept: not base_failed, and
    quality, the calibrated probability, at least `keep`. A null or empty text has no words and fails.
    Without a model quality is 1. Rows are on their own; an empty table gives an empty result."""
    sent = send(docs.sparkSession, rated)  # of fixed size
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = Hasher(), received(sent)
        for batch in batches:
            for part in slices(batch):
                found = counts(part.column("text"), hasher)
                quality = np.ones(part.num_rows)
                if model:
                    quality = 1 / (1 + np.exp(-np.clip(model.slope * scores(part.column("text"), hasher, model.weights) + model.intercept, -35, 35)))
                failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEAT_PERCENT * found["n_words"])
                arrays = [part.column("doc_id"), *(pa.array(found[n].astype(np.int64)) for n in names), pa.array(failed), pa.array(~failed & (quality >= keep)), pa.array(quality)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "base_failed", "kept", "quality"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + "".join(f"{n} long, " for n in names) + "base_failed boolean, kept boolean, quality double")
