"""N-gram Jaccard join: exact pairs of documents with similar shingle sets, by blocked incidence products.

1. Each document becomes its set of distinct word shingles (64-bit hashes) with a 128-bit signature.
   Documents of equal sets form one class; only its smallest doc_id goes on.
2. Every set is put in one global order: by hash, shingles of frequent slots of a fixed-size sketch
   of all documents last. A shingle that only one of two sets holds parts at most two neighbours in
   the order of the union, so two sets of similarity t or more have two shingles in common that stand
   side by side in both, and the first such pair is among the first floor(2 * (1 - t) * n) + 1
   neighbour pairs of a set of n. These pairs are the set's keys. A passage or phrase that many
   documents share makes few common keys: it stands last, or other shingles fall between its own.
3. For each key the smallest document is the leader; all documents with that key join the leader's
   block. So any two sets that share a key meet in a block. A block larger than the limits is cut
   into chunks, and each pair of chunks is a block; a block that lies within another one is left out.
4. A block multiplies its document by shingle incidence matrix with its transpose, column block by
   column block, which accumulates overlap counts. Pairs below the size-derived bound
   `overlap >= t * union` go; of the links that are left a block hands out a spanning forest only.
5. Components of these links, and membership of the classes, give the result.

No pair list of a group leaves a task, no bucket is capped, and nothing frequent is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, Hasher, Words, discard, mixed, release, sequence_hash, shingles, sieved, slices, stored, text_bytes
from .components import components

#: Counters of the sketch, as a power of two, and how many go in one row.
SKETCH_BITS, SKETCH_ROW = 18, 1 << 12
#: Most documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 2_000_000
#: Cells of a dense part of an incidence matrix.
DENSE_CELLS = 4 << 20


def shingle_sets(column: pa.Array, n: int, hasher: Hasher) -> list[np.ndarray]:
    """For each row the sorted distinct n-word shingles; a shorter row is one shingle, an empty one none."""
    words = Words(column, UNSPACED, hasher)
    out = []
    every = shingles(words.hash, n)
    for r in range(words.rows()):
        a, b = words.first[r], words.first[r + 1]
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            out.append(np.array([sequence_hash(words.hash[a:b])], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def frequent_slots(docs: DataFrame, n: int) -> np.ndarray:
    """Which of 2 ** SKETCH_BITS slots of the hash space hold a shingle far more frequent than the mean.

    Counts the sets of all documents. Only the order of a set's shingles depends on it, so a wrong
    guess changes no result."""
    slots = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found = Hasher(), np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                flat = np.concatenate(shingle_sets(part.column("text"), n, hasher))
                found += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=slots)
        if found.any():
            rows = found.reshape(-1, SKETCH_ROW).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["row", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column("row").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[row] = sums.get(row, 0) + np.frombuffer(counts, dtype="<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["row", "counts"])

    schema = "row int, counts binary"
    out = np.zeros((slots // SKETCH_ROW, SKETCH_ROW), dtype=np.int64)
    for row in docs.select("text").mapInArrow(count, schema).repartition("row").mapInArrow(add, schema).collect():  # of fixed size
        out[row["row"]] += np.frombuffer(row["counts"], dtype="<i8")
    usual = np.median(out)
    return out.reshape(-1) > usual + 6 * np.sqrt(usual) + 16


def key_count(n: int, percent: int) -> int:
    """How many neighbour pairs of a set of n shingles are its keys: floor(2 * (1 - t) * n) + 1."""
    return min(n - 1, 2 * (100 - percent) * n // 100 + 1)


def neighbour_keys(items: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the first neighbour pairs of a sorted set; the set itself where it has one shingle."""
    if len(items) < 2:
        return items
    late = frequent[(items >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    if late.any():
        items = np.concatenate([items[~late], items[late]])
    k = key_count(len(items), percent)
    return mixed(items[:k] * np.uint64(0x9E3779B97F4A7C15) + items[1 : k + 1])


def keyed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, sig1, sig2, keys): one row per row of docs."""
    late = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent_slots(docs, n)))  # 32 KB

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, frequent = Hasher(), np.unpackbits(late.value).astype(bool)
        for batch in batches:
            for part in slices(batch):
                size, sig1, sig2, keys, at = [], [], [], [], [0]
                for s in shingle_sets(part.column("text"), n, hasher):
                    size.append(len(s))
                    sig1.append(int(s.sum(dtype=np.uint64)))
                    sig2.append(int(mixed(s).sum(dtype=np.uint64)))
                    keys.append(neighbour_keys(s, frequent, percent))
                    at.append(at[-1] + len(keys[-1]))
                u = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), u(sig1), u(sig2), pa.ListArray.from_arrays(pa.array(at, pa.int32()), u(np.concatenate(keys)))],
                    ["doc_id", "n_shingles", "sig1", "sig2", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, n_shingles long, sig1 long, sig2 long, keys array<long>")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): each text compressed by itself, for shuffles."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            for part in slices(batch):
                data, off = text_bytes(part.column("text"))
                rows = [squeeze.compress(data[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, packed binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs of sets: the product of the incidence matrix with its transpose.

    Columns with one document add nothing. Those with two to four add single cells; the others are
    multiplied as dense parts of bounded size."""
    k = len(sets)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(k), [len(s) for s in sets])
    out = np.zeros((k, k), dtype=np.int64)
    by_column = np.argsort(inverse, kind="stable")
    doc, start = doc[by_column], np.cumsum(count) - count
    for c in range(2, 5):
        cols = start[count == c]
        if len(cols):
            at = doc[cols[:, None] + np.arange(c)]
            for a in range(c):
                for b in range(a + 1, c):
                    np.add.at(out, (at[:, a], at[:, b]), 1)
    many = np.flatnonzero(count > 4)
    width = max(1, DENSE_CELLS // k)
    for m in range(0, len(many), width):
        cols = many[m : m + width]
        dense = np.zeros((k, len(cols)), dtype=np.float32)
        n = count[cols]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        dense[doc[np.repeat(start[cols], n) + within], np.repeat(np.arange(len(cols)), n)] = 1
        out += np.triu(dense @ dense.T, 1).astype(np.int64)
    return out


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Spanning links of the documents of a block, each with its component's first document."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    common = overlaps(sets)
    union = size[:, None] + size[None, :] - common
    link = (100 * common >= percent * union) & (common > 0)
    link |= link.T
    left, u, v = np.ones(len(ids), dtype=bool), [], []
    for root in range(len(ids)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            reached = np.flatnonzero(link[front].any(axis=0) & left)
            left[reached] = False
            u += ids[reached].tolist()
            v += [int(ids[root])] * len(reached)
            front = reached.tolist()
    return u, v


def inner_blocks(joined: DataFrame) -> DataFrame:
    """Leaders whose whole block lies within the block of the smallest leader that they are in themselves."""
    outer = joined.where("leader < doc_id").groupBy("doc_id").agg(F.min("leader").alias("outer")).withColumnRenamed("doc_id", "leader")
    inner = joined.join(outer, "leader").select("leader", "doc_id", "outer")
    there = joined.select(F.col("leader").alias("outer"), "doc_id", F.lit(1).alias("there"))
    missed = inner.join(there, ["outer", "doc_id"], "left").groupBy("leader").agg(F.count(F.lit(1)).alias("all"), F.count("there").alias("both"))
    return missed.where(F.col("all") == F.col("both")).select("leader")


def links(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Spanning links (u, v), written, between the documents of `rows` (doc_id, n_shingles, keys), one per class."""
    keys = rows.select(F.explode("keys").alias("h"), "doc_id")
    # tasks sum up before the shuffle, and adaptive execution splits the join of a frequent key
    lead = keys.groupBy("h").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").select("h", "leader")
    lead = stored(lead, "leaders")
    joined = stored(sieved(keys, "h", lead.select("h")).join(lead, "h").select("leader", "doc_id").distinct(), "blocks")
    discard(lead)
    size = joined.join(rows.select("doc_id", "n_shingles"), "doc_id").groupBy("leader").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("items"))
    size = size.join(inner_blocks(joined), "leader", "left_anti")
    # with c chunks, two of which make a block, a block has 2 / c of all
    over = F.greatest(F.col("docs") / F.lit(BLOCK_DOCS), F.col("items") / F.lit(BLOCK_SHINGLES))
    size = size.select(F.col("leader").alias("l"), F.when(over <= 1, 1).otherwise(F.ceil(over * 2)).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    other = F.explode(F.expr("if(chunks = 1, array(0), filter(sequence(0, chunks - 1), x -> x <> mine))")).alias("other")
    block = (
        joined.join(size, F.col("leader") == F.col("l"))
        .select("leader", "doc_id", "chunks", mine.alias("mine"))
        .select("leader", "doc_id", "mine", other)
        .select("doc_id", F.struct("leader", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).alias("block"))
    )
    release(docs.sparkSession)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        now, ids, sets, hasher, expand = None, [], [], Hasher(), zstandard.ZstdDecompressor()

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                u, v = forest(np.array(ids, dtype=np.int64), sets, percent)
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for key, doc, raw in zip(batch.column("block").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                key = tuple(key.values())
                if key != now:
                    yield from done()
                    now, ids, sets = key, [], []
                ids.append(doc)
                sets += shingle_sets(pa.array([expand.decompress(raw).decode()], pa.string()), n, hasher)
        yield from done()

    dealt = block.join(packed(sieved(docs, "doc_id", joined.select("doc_id"))), "doc_id").select("block", "doc_id", "packed").repartition("block").sortWithinPartitions("block", "doc_id")
    out = stored(dealt.mapInArrow(multiply, "u long, v long"), "block-links")
    discard(joined)
    return out


def ngram_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Two documents link when
    100 * |intersection| >= percent * |union| of their n-word shingles; component_id is the smallest
    doc_id that links reach. A text without words, or null, has an empty set and is linked with
    nothing. Rows that share a doc_id are one document: each keeps its row, and their links add up.
    A null doc_id can't be named as a partner: its component is null. An empty table gives an empty
    result; further columns are ignored."""
    docs = docs.select("doc_id", "text")
    rows = stored(keyed(docs, n, percent), "keys")
    key = ["n_shingles", "sig1", "sig2"]
    classes = stored(rows.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    whole = rows.join(classes, key, "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    firsts = whole.where("doc_id = rep and n_shingles > 0").select("doc_id", "n_shingles", "keys")
    # a doc_id with several texts ties the classes of these together
    same = whole.where("doc_id <> rep and n_shingles > 0").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    again = same.join(firsts.select("doc_id"), F.col("u") == F.col("doc_id"), "left_semi")
    inside = links(docs, firsts, n, percent)
    edges = stored(inside.unionByName(again).distinct(), "links")
    # keys are most of the rows; what is left to read is small
    slim = stored(whole.drop("keys"), "shingle-counts")
    discard(rows, classes, inside)
    release(docs.sparkSession)
    roots = components(edges)
    return slim.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, with all their columns.

    Null and empty texts, and null doc_ids, are in no group and stay; rows that repeat or share a doc_id stay or go
    together; an empty table stays empty."""
    groups = ngram_groups(docs, n, percent)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
