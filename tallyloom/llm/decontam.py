"""Benchmark decontamination: an FM-index for each shard of documents, searched with benchmark phrases.

A shard is a run of rows of one task. Its text is a sequence of word symbols over the words of the
benchmark; a word that no phrase holds ends a run, since no occurrence can reach over it, and runs
shorter than the shortest phrase are left out for the same reason. The index has the Burrows-Wheeler
transform of all runs in a wavelet matrix, symbol counts, and sampled suffix positions. Phrases go
backward through the ranks, all of them at once; their rows walk to a sampled position; the places
they occupy are merged to removal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Hasher, Words, kept, received, same_bytes, send, slices

WINDOW = 10
#: Symbols of runs after which a shard's index is built, and bytes of phrases that are searched at once.
SHARD_SYMBOLS, BLOCK_BYTES = 400_000, 8 << 20
#: Bytes of rows that a task holds for one search.
BUFFER_BYTES = 24 << 20
#: One in so many suffix positions is kept.
SAMPLE = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with counts for each bit, high bits first."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            ones = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros(len(end), dtype=np.int64)
        end = end.astype(np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> level & 1).astype(bool)
            s, e = self.ones[k][start], self.ones[k][end]
            start = np.where(one, self.zeros[k] + s, start - s)
            end = np.where(one, self.zeros[k] + e, end - e)
        return end - start


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; zeros are ends, each different from every other."""
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    width = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        width *= 2
        if step[-1] == n - 1 or width >= n:
            return order


class FMIndex:
    """text: symbols from 1 on, every run ended by a 0."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_order(text)
        self.last = text[order - 1]
        self.wavelet = WaveletMatrix(self.last, max(1, int(symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        begins = text[order - 1] == 0  # the walk never leaves a run
        kept = (order % SAMPLE == 0) | begins
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.position = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of symbols, all of one length: the ranges of suffixes that begin with each."""
        low, high = self.before[phrases[:, -1]], self.before[phrases[:, -1] + 1]
        low, high = low.copy(), high.copy()
        alive = np.flatnonzero(low < high)
        for k in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[alive, k]
            low[alive] = self.before[c] + self.wavelet.rank(c, low[alive])
            high[alive] = self.before[c] + self.wavelet.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        found = np.zeros(len(low), dtype=bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        out, walked = np.empty(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
        left, row = np.arange(len(row)), row.astype(np.int64)
        while len(left):
            here = self.kept[row + 1] > self.kept[row]
            out[left[here]] = self.position[self.kept[row[here]]] + walked[left[here]]
            left, row = left[~here], row[~here]
            walked[left] += 1
            c = self.last[row]
            row = self.before[c] + self.wavelet.rank(c, row)
        return out


class Phrases:
    """Windows of a block of benchmark items: words, by hash and bytes, to symbols, and the items of each window."""

    def __init__(self, items: list[tuple], window: int) -> None:
        words = Words(pa.array([text for _, text in items], pa.string()), ALNUM, Hasher())
        self.names = [name for name, _ in items]
        raw, known = words.data.tobytes(), {}
        symbol = np.array([known.setdefault(raw[a:b], len(known) + 1) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)], dtype=np.int64)
        _, first = np.unique(symbol, return_index=True)
        order = np.argsort(words.hash[first], kind="stable")
        self.hash, self.symbol = words.hash[first][order], order + 1
        self.data, self.start, self.end = words.data, words.start[first][order], words.end[first][order]
        self.alike = int(np.unique(self.hash, return_counts=True)[1].max(initial=0))  # most words of one hash
        by_length: dict[int, dict[bytes, set[int]]] = {}
        for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            size = min(window, int(b - a))
            for s in range(a, b - size + 1) if size else ():
                by_length.setdefault(size, {}).setdefault(symbol[s : s + size].tobytes(), set()).add(k)
        self.groups = []  # of each length: windows, and the items of all windows, with each window's range of them
        for size, found in sorted(by_length.items()):
            rows = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, size)
            held = np.cumsum([0, *map(len, found.values())])
            self.groups.append((size, rows, np.array([k for v in found.values() for k in sorted(v)], dtype=np.int64), held))
        self.shortest = self.groups[0][0] if self.groups else None

    def symbols(self, words: Words) -> np.ndarray:
        """The symbol of each word, 0 where no phrase has it."""
        out = np.zeros(len(words.hash), dtype=np.int64)
        if len(self.hash):
            at = np.searchsorted(self.hash, words.hash)
            for k in range(self.alike):
                near = np.minimum(at + k, len(self.hash) - 1)
                some = np.flatnonzero((self.hash[near] == words.hash) & (out == 0))
                near = near[some]
                same = same_bytes(words.data, words.start[some], words.end[some], self.data, self.start[near], self.end[near])
                out[some[same]] = self.symbol[near[same]]
        return out


class Shard:
    """Rows whose hits are still to be found."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.hasher = phrases, Hasher()
        self.clear()

    def clear(self) -> None:
        self.text, self.run_start, self.run_word, self.size, self.rows, self.words = [], [], [], 0, 0, []
        self.total = 0

    def add(self, column: pa.Array) -> None:
        words = Words(column, ALNUM, self.hasher)
        row = self.rows + words.row_of_word()
        self.words.append(words.counts())
        self.rows += words.rows()
        if not len(self.phrases.hash) or not len(words.hash):
            self.total += len(words.hash)
            return
        symbol = self.phrases.symbols(words)
        edge = np.flatnonzero(np.diff(row, prepend=-1, append=self.rows))
        inside = np.zeros(len(symbol) + 2, dtype=bool)
        inside[1:-1] = symbol > 0
        begin = (inside[1:-1] & ~inside[:-2]) | (inside[1:-1] & np.isin(np.arange(len(symbol)), edge))
        start = np.flatnonzero(begin)
        stop = np.flatnonzero((inside[1:-1] & ~inside[2:]) | (inside[1:-1] & np.isin(np.arange(len(symbol)) + 1, edge))) + 1
        long = stop - start >= self.phrases.shortest
        start, size = start[long], (stop - start)[long]
        if len(start):
            to = np.cumsum(size + 1) - size - 1
            text = np.zeros(int(size.sum()) + len(size), dtype=np.int64)
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            text[np.repeat(to, size) + within] = symbol[np.repeat(start, size) + within]
            self.text.append(text)
            self.run_start.append(self.size + to)
            self.run_word.append(self.total + start)
            self.size += len(text)
        self.total += len(symbol)

    def hits(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Words of each row, which words are hit, and the items of each row."""
        count = np.concatenate(self.words) if self.words else np.empty(0, np.int64)
        first = np.concatenate([[0], np.cumsum(count)])
        change, pairs = np.zeros(self.total + 1, dtype=np.int64), []
        if self.size:
            index = FMIndex(np.concatenate(self.text), len(self.phrases.hash))
            run_start, run_word = np.concatenate(self.run_start), np.concatenate(self.run_word)
            for size, rows, items, held in self.phrases.groups:
                low, high = index.search(rows)
                n = high - low
                if not n.sum():
                    continue
                which = np.repeat(np.arange(len(rows)), n)
                at = index.locate(np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
                run = np.searchsorted(run_start, at, side="right") - 1
                word = run_word[run] + at - run_start[run]
                np.add.at(change, word, 1)
                np.add.at(change, word + size, -1)
                row = np.searchsorted(first, word, side="right") - 1
                both = np.unique(row * len(rows) + which)
                row, which = both // len(rows), both % len(rows)
                n = held[which + 1] - held[which]
                item = items[np.repeat(held[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                pairs.append(np.unique(np.repeat(row, n) * len(self.phrases.names) + item))
        hit = np.cumsum(change)[: self.total] > 0
        found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        names = max(1, len(self.phrases.names))
        return first, hit, np.split(found % names, np.searchsorted(found // names, np.arange(1, len(count)))) if len(count) else []


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Items with an id and a text, in blocks of bounded size; the driver holds one block at a time."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((None if row["item_id"] is None else str(row["item_id"]), row["text"]))
        held += len(row["text"].encode())
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def sent_blocks(docs: DataFrame, benchmark: DataFrame, window: int) -> list[Broadcast]:
    """Phrases of each block of items, sent to executors, which hold one block of bounded size at a time."""
    return [send(docs.sparkSession, Phrases(items, window)) for items in blocks_of(benchmark)]


class Searcher:
    """Hits of all blocks in the columns of a task."""

    def __init__(self, blocks: list[Broadcast]) -> None:
        self.blocks, self.only = blocks, kept(blocks[0], lambda x: x) if len(blocks) == 1 else None

    def __call__(self, columns: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray, list[list[str]]]]:
        """For each column: the range of words of each row, which words are hit, and the names of each row's items."""
        out = []
        for column in columns:
            words = Words(column, ALNUM, None)
            out.append((words.first, np.zeros(len(words.start), dtype=bool), [[] for _ in range(len(column))]))
        for block in self.blocks:
            phrases = self.only or received(block)
            shard, waiting = Shard(phrases), []
            for k, column in enumerate(columns):
                shard.add(column)
                waiting.append(k)
                if shard.size >= SHARD_SYMBOLS or k == len(columns) - 1:
                    first, hit, items = shard.hits()
                    row = 0
                    for w in waiting:
                        rows = len(columns[w])
                        out[w][1][:] |= hit[first[row] : first[row + rows]]
                        for r in range(rows):
                            out[w][2][r] += [phrases.names[i] for i in items[row + r] if phrases.names[i] is not None]
                        row += rows
                    shard.clear()
                    waiting = []
        return out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches, as many as have BUFFER_BYTES in all."""
    waiting, held = [], 0
    for batch in batches:
        for part in slices(batch):
            waiting.append(part)
            held += part.nbytes
            if held >= BUFFER_BYTES:
                yield waiting
                waiting, held = [], 0
    if waiting:
        yield waiting


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and past-the-last word of each run of hits."""
    return np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist() if hit.any() else []


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans array<struct<first, past>>, items).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. An item's windows are its runs
    of `window` words; with fewer, but some, the whole item is one. spans are the merged word ranges that any
    occurrence covers. Null or empty texts have no words; a null item text has no window. An item
    without an id marks words but is not counted or named. Rows that repeat give repeated results, empty tables none or clean ones;
    further columns are ignored. The benchmark goes out in blocks of bounded size; documents are read once."""
    blocks = sent_blocks(docs, benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(blocks)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
        for parts in gathered(batches):
            for part, (first, hit, names) in zip(parts, search([p.column("text") for p in parts]), strict=True):
                rows = [[{"first": a, "past": b} for a, b in spans_of(hit[first[r] : first[r + 1]])] for r in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(rows, kind), pa.array(names, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

    now = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, spans array<struct<first:long,past:long>>, items array<string>")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["past"] - s["first"])
    names = F.array_sort(F.array_distinct("items"))
    return now.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", names.alias("items"))


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the removal spans cut from text, and n_chars, where there is one, set anew.

    The spans of all blocks of the benchmark are cut at once, and cut texts are searched again until nothing is found, as
    a cut brings other words together; so the result does not depend on blocks. A text that is not hit stays byte for
    byte, a null one null; every row and column stays, rows that repeat are cut alike, an empty table stays empty, and an
    empty benchmark cuts nothing."""
    blocks = sent_blocks(docs, benchmark, window)

    def cut(text: str, hit: np.ndarray) -> str:
        words = Words(pa.array([text], pa.string()), ALNUM, None)
        raw, out, at = words.raw.tobytes(), [], 0
        for a, b in spans_of(hit):
            out.append(raw[at : words.start[a]])
            at = int(words.end[b - 1])
        return b"".join([*out, raw[at:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(blocks)
        for parts in gathered(batches):
            cuts: list[dict[int, str]] = [{} for _ in parts]
            open_rows = [np.arange(p.num_rows) for p in parts]
            columns = [p.column("text") for p in parts]
            while any(len(rows) for rows in open_rows):
                for k, (first, hit, _) in enumerate(search(columns)):
                    marked = [r for r in range(len(columns[k])) if hit[first[r] : first[r + 1]].any()]
                    for r in marked:
                        cuts[k][int(open_rows[k][r])] = cut(columns[k][r].as_py(), hit[first[r] : first[r + 1]])
                    open_rows[k] = open_rows[k][marked]
                    columns[k] = pa.array([cuts[k][int(r)] for r in open_rows[k]], pa.string())
            for part, changed in zip(parts, cuts, strict=True):
                if changed:
                    at, texts = part.schema.get_field_index("text"), part.column("text").to_pylist()
                    for r, text in changed.items():
                        texts[r] = text
                    part = part.set_column(at, "text", pa.array(texts, part.schema.field("text").type))
                yield part

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def digest(names: list[str]) -> str:
    """items_sha256 of a list of item ids."""
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()
