"""What the training-data operators share: tables, the shared folder, Arrow slices, byte-level words.

Words are found and hashed in numpy over the UTF-8 bytes of an Arrow column, without a Python
object for each word. Hashes have 64 bits and depend on a word's bytes only.
"""

from __future__ import annotations

import functools
import gc
import pickle
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy handles at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes over which one run of prefix hashes reaches.
HASH_BLOCK = 1 << 15
#: Words of 64 bits of a sieve at most, as a power of two: some 12 MB.
SIEVE_WORDS = 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _word_bytes(pairs: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in pairs:
        table[low : high + 1] = False
    return table


#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for lower-cased text.
ALNUM = _word_bytes([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Word bytes of `[^\x20\x09-\x0D]+`.
UNSPACED = _word_bytes([(0x20, 0x20), (0x09, 0x0D)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like this one that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir)."""
    return f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder given to setCheckpointDir. Where neither is set, a temporary
    folder if driver and tasks are one local process; on a cluster that is an error, as executors would not share it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined() and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="tallyloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def send(spark: SparkSession, thing: object) -> Broadcast:
    """Broadcast an object of bounded size with the code of its class; received() opens it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def received(sent: Broadcast) -> object:
    return pickle.loads(sent.value)


def kept(sent: Broadcast, make: Callable[[object], object]) -> object:
    """What make() gives of a broadcast thing, made once by each Python worker and used again by its later tasks."""
    if not hasattr(sent, "_kept"):
        sent._kept = make(received(sent))
    return sent._kept


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and what its plan left behind can go."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() has written and that nothing is going to read any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sieved(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose column may equal one of keys (one column, of a written table, without nulls), before a join that settles it.

    All rows that have a partner stay. The others mostly go without a shuffle, by one hashed bit of 16 or more a key; beyond a
    sieve's bound there are fewer bits a key, and more of them stay."""
    key = keys.columns[0]
    words = 1 << min(SIEVE_WORDS, (keys.count() // 4).bit_length())
    word, bits = fresh(df, "sieve_word"), fresh(df, "sieve_bits")
    hashed = lambda c: F.xxhash64(F.lit("sieve"), F.col(c))
    at = lambda h: F.shiftrightunsigned(h, 58).cast("int")
    of: Callable[[Column], Column] = lambda h: h.bitwiseAND(F.lit(words - 1))
    sieve = keys.select(of(hashed(key)).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), at(hashed(key))).alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(bits))
    met = df.withColumn(word, of(hashed(column))).join(F.broadcast(sieve), word)
    return met.where(F.call_function("getbit", F.col(bits), at(hashed(column))) == 1).drop(word, bits)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more; at most once a second, as steps
    that take less leave little behind."""
    if time.monotonic() - _released[0] >= 1:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


_released = [0.0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most `limit` bytes of text, or one longer row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of each row; null counts as empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, none of which crosses a row's edge."""
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[(off > 0) & (off < len(inside))]
    before[edge], after[edge - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


PRIME = (1 << 61) - 1
_BASE = int(np.random.Generator(np.random.PCG64(20240229)).integers(1 << 40, PRIME))
_LOW30, _LOW31, _P = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1), np.uint64(PRIME)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + a0 * b0)


@functools.lru_cache(2)
def _powers(base: int, most: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) <= most:
        out = np.concatenate([out, times(out, np.uint64(pow(base, len(out), PRIME)))])
    return out[: most + 1]


class Hasher:
    """Hashes of byte spans: polynomials in a fixed base modulo the prime 2 ** 61 - 1, as differences of prefix sums.

    Prefix sums of the low and high halves of byte times power stay exact integers over a block. Two different spans of
    n bytes agree for at most n of all bases; who needs equal bytes for sure compares them (same_bytes)."""

    def __init__(self, block: int = HASH_BLOCK) -> None:
        self.block = block
        up = _powers(_BASE, block)
        self.low, self.high = up & _LOW31, up >> np.uint64(31)
        self.down = _powers(pow(_BASE, -1, PRIME), block)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), dtype=np.uint64)
        at = 0
        while at < len(start):
            base = start[at]
            to = int(np.searchsorted(end, base + self.block, side="right"))
            if to <= at:  # one span longer than a block
                out[at] = self._long(data[base : end[at]])
                at += 1
                continue
            s, e = start[at:to] - base, end[at:to] - base
            out[at:to] = times(self._sums(data[base : end[to - 1]], s, e), self.down[s])
            at = to
        return mixed(out + (end - start).astype(np.uint64))

    def _sums(self, part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Sums over spans of byte plus one times power of the place in part."""
        value, sums = part.astype(np.uint64) + np.uint64(1), np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(value * self.high[: len(part)], out=sums[1:])
        high = sums[e] - sums[s]
        np.cumsum(value * self.low[: len(part)], out=sums[1:])
        return _reduced(((high & _LOW30) << np.uint64(31)) + (high >> np.uint64(30)) + sums[e] - sums[s])

    def _long(self, part: np.ndarray) -> np.uint64:
        total = 0
        for k in range(0, len(part), self.block):
            piece = part[k : k + self.block]
            total += int(self._sums(piece, np.array([0]), np.array([len(piece)]))[0]) * pow(_BASE, k, PRIME)
        return np.uint64(total % PRIME)


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which spans of a equal the span of b in the same place of the list."""
    size = a_end - a_start
    out = size == b_end - b_start
    pairs = np.flatnonzero(out & (size > 0))
    step = 1 << 16
    for k in range(0, len(pairs), step):
        some = pairs[k : k + step]
        n = size[some]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        differ = a[np.repeat(a_start[some], n) + within] != b[np.repeat(b_start[some], n) + within]
        out[some] = ~np.logical_or.reduceat(differ, first)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer: spreads every bit of a 64-bit hash over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes; empty where there are fewer."""
    if len(word) < n:
        return np.empty(0, dtype=np.uint64)
    out = word[: len(word) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - n + 1 + k])
    return out


def sequence_hash(word: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, apart from those of shingles."""
    out = np.array([len(word) + 1], dtype=np.uint64)
    for w in word:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return mixed(out ^ np.uint64(0xD6E8FEB86659FD93))[0]


class Words:
    """The words of a slice of rows: byte spans, the row of each, its hash, and each row's range of words."""

    def __init__(self, column: pa.Array, table: np.ndarray, hasher: Hasher | None, lower: bool = True) -> None:
        self.raw, self.off = text_bytes(column)
        self.data = LOWER[self.raw] if lower else self.raw
        self.start, self.end = spans(table[self.data], self.off)
        self.first = np.searchsorted(self.start, self.off)  # row r has words first[r] to first[r + 1]
        self.hash = hasher(self.data, self.start, self.end) if hasher else None

    def rows(self) -> int:
        return len(self.off) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows()), self.counts())
