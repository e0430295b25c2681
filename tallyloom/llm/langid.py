"""Language identification by interpolated Kneser-Ney character models, one per language.

Counts come from a sample of whole documents of each language, SAMPLE_DOCS in expectation and more where there are many
(GROWTH times the root of their number), so that what is gathered grows with the corpus while the tables stay on one machine.
Characters are lower-cased, and every run without a letter becomes one blank. Orders 1 to ORDER: the
highest has raw counts, lower ones the number of different characters before a gram; each has one
discount d = n1 / (n1 + 2 n2). Probabilities of all grams that any language has seen stand in arrays sorted by
gram hash, one column of log probabilities per language; languages that have not seen one have what backing off gives. Grams that are not there back off to a
shorter one by the context's weight, also in sorted arrays. The language of the lowest
cross-entropy per character wins. Its confidence is a logistic function, fitted on sampled
documents that the models have not seen, of the margin to the next language; below REJECT it is rejected.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, mixed, send, slices

ORDER = 4
#: Documents of a language that are sampled, in expectation: the larger of a number and a multiple of the root of all there are.
SAMPLE_DOCS, GROWTH = 400, 2.0
REJECT = 0.5
#: Characters that numpy scores at once.
CHARS = 1 << 20
BLANK = 0x20
_LETTER = re.compile("[A-Za-z]")
_STEP = np.uint64(0xD1342543DE82EF95)
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) for k in range(ORDER + 1)]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


class Letters:
    """Which code points are letters."""

    def __init__(self) -> None:
        self.table = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)

    def points(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of lower-cased texts, runs of other characters than letters as one blank, a blank around each; and
        where each text begins, with the end of the last."""
        parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), dtype=np.uint32) for t in texts]
        start = np.cumsum([0, *map(len, parts)])
        points = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        letter = self.table[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run of blanks
        keep[start[:-1]] = True
        before = np.concatenate([[0], np.cumsum(keep)])
        return np.where(letter, points, BLANK)[keep].astype(np.uint64), before[start]


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive characters."""
    if len(points) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(points) - n + 1, _SALT[n], dtype=np.uint64)
    for k in range(n):
        out *= _STEP
        out += points[k : k + len(out)]
    return mixed(out)


class Models:
    """Sorted hash arrays of all languages. tables: for each language and order, gram hash, count, context
    hash and lower gram hash, as `counted` gives them."""

    def __init__(self, languages: list[str], counts: list[dict[tuple[int, ...], int]]) -> None:
        self.languages = languages
        made = [self._smoothed(c) for c in counts]
        self.floor = np.log(np.array([m[2] for m in made]))
        self.gram, self.value, self.context, self.weight = [], [], [], []
        lower: dict[tuple, np.ndarray] = {}
        for n in range(1, ORDER + 1):
            contexts = sorted({h for m in made for h in m[1][n]})
            weight = np.array([[m[1][n].get(h, 1.0) for m in made] for h in contexts]).reshape(len(contexts), len(made))
            weight = dict(zip(contexts, np.log(weight), strict=True))
            every, now = sorted({g for m in made for g in m[0][n]}), {}
            for g in every:
                p = np.array([m[0][n].get(g, 0.0) for m in made])
                back = weight[g[:-1]] + (lower[g[1:]] if n > 1 else self.floor)
                now[g] = np.where(p > 0, np.log(np.maximum(p, 1e-300)), back)
            for keys, values, names, found, length in ((self.gram, self.value, every, now, n), (self.context, self.weight, contexts, weight, n - 1)):
                key, table = self._sorted(names, length, np.array([found[g] for g in names]).reshape(len(names), len(made)))
                keys.append(key)
                values.append(table)
            lower = now

    @staticmethod
    def _sorted(every: list, length: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = np.array(every, dtype=np.uint64).reshape(len(every), length)
        key = np.array([grams(p, length)[0] if length else _SALT[0] for p in points], dtype=np.uint64)
        order = np.argsort(key)
        return key[order], table[order]

    @staticmethod
    def _smoothed(counts: dict[tuple[int, ...], int]) -> tuple[dict, dict, float]:
        level: dict[int, dict] = {ORDER: counts}
        for n in range(ORDER - 1, 0, -1):  # continuation counts
            level[n] = {}
            for g in level[n + 1]:
                level[n][g[1:]] = level[n].get(g[1:], 0) + 1
        prob, weight = {}, {}
        uniform = 1.0 / (len(level[1]) + 1)
        for n in range(1, ORDER + 1):
            ones, twos = sum(c == 1 for c in level[n].values()), sum(c == 2 for c in level[n].values())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total, kinds = {}, {}
            for g, c in level[n].items():
                total[g[:-1]] = total.get(g[:-1], 0) + c
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            weight[n] = {h: d * kinds[h] / total[h] for h in total}
            lower = prob.get(n - 1)
            prob[n] = {g: max(c - d, 0) / total[g[:-1]] + weight[n][g[:-1]] * (lower[g[1:]] if lower else uniform) for g, c in level[n].items()}
        return prob, weight, uniform

    def log_probability(self, points: np.ndarray) -> np.ndarray:
        """Log probability of each character after the first ORDER - 1, by language."""
        out = np.zeros((max(0, len(points) - ORDER + 1), len(self.languages)))
        rows = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            if not len(rows):
                break
            key = grams(points, n)[ORDER - n :]
            value, seen = self._get(self.gram[n - 1], self.value[n - 1], key if n == ORDER else key[rows])
            out[rows[seen]] += value
            rows = rows[~seen]
            context = grams(points, n - 1)[ORDER - n : ORDER - n + len(out)][rows] if n > 1 else np.full(len(rows), _SALT[0])
            weight, known = self._get(self.context[n - 1], self.weight[n - 1], context)
            out[rows[known]] += weight
        out[rows] += self.floor
        return out

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys that are there, and which are."""
        if not len(keys):
            return values, np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        seen = keys[at] == wanted
        return values[at[seen]], seen

    def entropies(self, texts: list[str], letters: Letters) -> np.ndarray:
        """Cross-entropy per character of each text, by language."""
        points, start = letters.points(texts)
        total = np.zeros((len(texts), len(self.languages)))
        width = np.diff(start) - ORDER + 1
        for k in np.flatnonzero(width < 1).tolist():  # letters too few for one gram: blanks before them
            own = np.concatenate([np.full(ORDER, BLANK, dtype=np.uint64), points[start[k] : start[k + 1]]])
            total[k] = self.log_probability(own).sum(axis=0)
        row = np.repeat(np.arange(len(texts)), np.diff(start))
        for k in range(0, len(points) - ORDER + 1, CHARS):
            value = self.log_probability(points[k : k + CHARS + ORDER - 1])
            first, last = row[k : k + len(value)], row[k + ORDER - 1 : k + ORDER - 1 + len(value)]
            value[first != last] = 0
            for j in range(value.shape[1]):
                total[:, j] += np.bincount(first, weights=value[:, j], minlength=len(texts))
        return -total / np.maximum(width, 1)[:, None]


def margin(entropy: np.ndarray) -> tuple[int, float]:
    """The best language and how far the next one is behind."""
    best = int(np.argmin(entropy))
    other = np.delete(entropy, best)
    return best, float(other.min() - entropy[best]) if len(other) else 1.0


class Identifier:
    """Models with the calibration of their margins."""

    def __init__(self, models: Models, slope: float, intercept: float) -> None:
        self.models, self.slope, self.intercept = models, slope, intercept

    def confidence(self, gap: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * gap + self.intercept))))


@functools.lru_cache(1)
def letter_table() -> Letters:
    return Letters()


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with one made-up case of either kind so that both exist."""
    n = len(x)
    c = np.append(np.ones(n) if weight is None else weight / max(weight.sum(), 1e-12) * n, [1.0, 1.0])
    x, y = np.append(x, [0.0, 0.0]), np.append(y, [0.0, 1.0])
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (c * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (c * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Identifier | None:
    """Learn from text and non-null lang of documents that are not held out. The expected sample of a
    language has sample_docs documents, or GROWTH times the root of the number there are where that is more; a fifth of
    which calibrate. None if no language is there."""
    pool = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in pool.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, max(sample_docs, GROWTH * sizes[x] ** 0.5) / sizes[x]))) for x in languages])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 20)) / F.lit(1 << 20)
    fifth = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0
    sample = pool.where(draw < share).select("text", "lang", fifth.alias("calibrates"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            for part in slices(batch):
                found: dict[tuple, int] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    points = letters.points([text])[0].astype(np.uint32)
                    for k in range(0, len(points) - ORDER + 1, CHARS):
                        window = np.lib.stride_tricks.sliding_window_view(points[k : k + CHARS + ORDER - 1], ORDER)
                        for g, c in zip(*np.unique(np.ascontiguousarray(window).view(f"V{4 * ORDER}").ravel(), return_counts=True), strict=True):
                            key = (lang, g.tobytes())
                            found[key] = found.get(key, 0) + int(c)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    def models_of(sample: DataFrame) -> Models:
        rows = sample.select("text", "lang").mapInArrow(counted, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        counts: dict[str, dict] = {x: {} for x in languages}
        for lang, gram, n in zip(rows["lang"].to_pylist(), rows["gram"].to_pylist(), rows["n"].to_pylist(), strict=True):
            counts[lang][tuple(np.frombuffer(gram, dtype=np.uint32).tolist())] = n
        return Models(languages, [counts[x] for x in languages])

    models = models_of(sample.where("not calibrates"))
    sent = send(docs.sparkSession, models)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letters = kept(sent, lambda x: x), letter_table()
        for batch in batches:
            found = [margin(known.entropies([t], letters)[0]) for t in batch.column("text").to_pylist()]
            right = [known.languages[b] == x for (b, _), x in zip(found, batch.column("lang").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.float64()), pa.array(right, pa.bool_())], ["gap", "right"])

    seen = sample.where("calibrates").select("text", "lang").mapInArrow(judged, "gap double, right boolean").toArrow()
    slope, intercept = fit_logistic(np.array(seen["gap"].to_pylist(), dtype=float), np.array(seen["right"].to_pylist(), dtype=float))
    return Identifier(models, slope, intercept)


def identify(docs: DataFrame, identifier: Identifier | None, reject: float = REJECT) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every whole text of docs (doc_id, text).

    score is the calibrated confidence in lang_pred, 0 to 1; below `reject` the prediction is
    rejected, though still named. A null text, or one without a letter, is `und` with score 0 and rejected,
    and so is every text when nothing was learned. Of equal entropies the first language in order wins."""
    sent = send(docs.sparkSession, identifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letters = kept(sent, lambda x: x), letter_table()
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                some = [k for k, t in enumerate(texts) if known and t is not None and (_LETTER.search(t) or any(map(str.isalpha, t)))]
                entropy = known.models.entropies([texts[k] for k in some], letters) if some else []
                for k, e in zip(some, entropy, strict=True):
                    best, gap = margin(e)
                    lang[k], score[k] = known.models.languages[best], known.confidence(gap)
                score = pa.array(score, pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), score, pc.less(score, reject)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify_documents(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, reject: float = REJECT) -> DataFrame:
    """Train on docs (doc_id, text, lang), then (doc_id, held_out, lang_pred, score, rejected) for all of them.

    A null doc_id is not held out; null, empty and letterless texts are `und`; rows that repeat are predicted alike; an
    empty table gives an empty result; other columns are ignored, whatever their names."""
    out = identify(docs, train(docs, sample_docs), reject)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
