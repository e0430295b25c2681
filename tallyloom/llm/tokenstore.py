"""Token ids on disk: blocks of separately compressed documents under one shared zstandard dictionary.

A store is a folder of Parquet containers with a dictionary beside them:

    <path>/dictionary   one row: version, bytes per id, dictionary, its SHA-256
    <path>/blocks       rows (part, block, first_id, last_id, rows, tokens, start, index, payload, dictionary_sha256)

A block holds documents in ascending doc_id. `payload` is their compressed frames, one after another, each the
little-endian ids of one document. `index` has one little-endian record (doc_id, flags, frame offset,
frame bytes, ids) for each, so one document is read by one range of one block. `start` counts the ids
of the partition before the block. Spark's committer makes a block appear once, whatever executors are lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SLICE, Encoder, Vocabulary
from .common import kept, send, slices

RECORD = np.dtype([("doc_id", "<i8"), ("null_id", "<u4"), ("bytes", "<u4"), ("offset", "<i8"), ("ids", "<i8")])
#: Compressed bytes after which a block is closed.
BLOCK_BYTES = 256 << 10
#: Documents that the dictionary is trained on, bytes taken of each, and the dictionary's size.
TRAIN_DOCS, TRAIN_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 64 << 10
LEVEL = 1
DDL = "part int, block int, first_id long, last_id long, rows long, tokens long, start long, index binary, payload binary, dictionary_sha256 string"


def ranks_of(tokenizer_json: str) -> dict[bytes, int]:
    """The byte tokens of a byte-level tokenizers file and their ids."""
    with open(tokenizer_json, encoding="utf-8") as f:
        return ranks_in(f.read())


def ranks_in(source: str) -> dict[bytes, int]:
    """As ranks_of(), from the file's text."""
    import json

    from .bpe import byte_characters

    of = {c: b for b, c in enumerate(byte_characters())}
    return {bytes(of[c] for c in token): rank for token, rank in json.loads(source)["model"]["vocab"].items() if all(c in of for c in token)}


class FileEncoder(Encoder):
    """Encodes as the tokenizers file does; texts that hold an added token go through the library as a whole."""

    def __init__(self, vocabulary: Vocabulary, whole: str) -> None:
        super().__init__(vocabulary)
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(whole)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def documents(self, column: pa.Array, end_id: int) -> list[np.ndarray]:
        ids, at, data, off = self.encode(column)
        raw = data.tobytes()
        special = {}
        for token in map(str.encode, self.added):
            k = raw.find(token)
            while k >= 0:
                r = int(np.searchsorted(off, k, side="right")) - 1
                if k + len(token) <= off[r + 1]:
                    special[r] = None
                k = raw.find(token, k + 1)
        for r in special:
            special[r] = self.whole.encode(raw[off[r] : off[r + 1]].decode(), add_special_tokens=False).ids
        return [np.append(np.array(special[r], dtype=np.uint32) if r in special else ids[a:b], np.uint32(end_id)) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]


def write_store(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0, parts: int | None = None) -> None:
    """Encode every whole text of docs (doc_id, text; null counts as empty), append end_id, and write a
    store in ascending doc_id (null ids first; rows of one id by text).

    An empty table gives a store without blocks. Further columns are not stored."""
    import zstandard

    spark = docs.sparkSession
    ranks = ranks_of(tokenizer_json)
    with open(tokenizer_json, encoding="utf-8") as f:
        whole = f.read()
    sent = send(spark, (Vocabulary(ranks), whole))  # its size is the vocabulary's
    wide = "<u2" if max([*ranks.values(), end_id]) < 1 << 16 else "<u4"
    docs = docs.select("doc_id", "text")
    total = docs.count()

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(sent, lambda x: FileEncoder(*x))
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids = encoder.documents(part.column("text"), end_id)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(wide).tobytes()[:TRAIN_BYTES] for x in ids], pa.binary())], ["ids"])

    every = max(1, total // TRAIN_DOCS)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(2 * TRAIN_DOCS)
    samples = [bytes(r["ids"]) for r in chosen.mapInArrow(serialized, "ids binary").collect()]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        dictionary = b"".join(samples)[:DICTIONARY_BYTES] or bytes(8)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(1, int(wide[2]), bytearray(dictionary), digest)], "version int, id_bytes int, dictionary binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")
    packed = spark.sparkContext.broadcast(dictionary)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part_no, number, start = kept(sent, lambda x: FileEncoder(*x)), TaskContext.get().partitionId(), 0, 0
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(packed.value, dict_type=zstandard.DICT_TYPE_RAWCONTENT if packed.value[:4] != b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_FULLDICT), write_checksum=False)
        frames, records, held = [], [], 0

        def closed() -> pa.RecordBatch:
            index = np.array(records, dtype=RECORD)
            names = index["doc_id"][index["null_id"] == 0].tolist()
            row = {"part": part_no, "block": number, "first_id": min(names, default=None), "last_id": max(names, default=None), "rows": len(index), "tokens": int(index["ids"].sum()), "start": start, "index": index.tobytes(), "payload": b"".join(frames), "dictionary_sha256": digest}
            return pa.RecordBatch.from_pylist([row], schema=block_schema())

        for batch in batches:
            for part in slices(batch, limit=SLICE):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.documents(part.column("text"), end_id), strict=True):
                    frame = squeeze.compress(ids.astype(wide).tobytes())
                    records.append((doc or 0, doc is None, len(frame), held, len(ids)))
                    frames.append(frame)
                    held += len(frame)
                    if held >= BLOCK_BYTES:
                        yield closed()
                        start += sum(r[4] for r in records)
                        number += 1
                        frames, records, held = [], [], 0
        if records:
            yield closed()

    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "text").drop("tie")
    ordered.mapInArrow(blocks, DDL).write.parquet(f"{path}/blocks")


def block_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("rows", pa.int64()), ("tokens", pa.int64()), ("start", pa.int64()), ("index", pa.binary()), ("payload", pa.binary()), ("dictionary_sha256", pa.string())])


def _opened(row: dict) -> tuple:
    """Decompressor and dtype of a store's dictionary row, after its hash is checked."""
    import zstandard

    raw = bytes(row["dictionary"])
    if hashlib.sha256(raw).hexdigest() != row["sha256"]:
        raise ValueError("the store's dictionary does not match its hash")
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind)), f"<u{row['id_bytes']}"


def _documents(blocks: DataFrame, dictionary: dict, digest_only: bool) -> DataFrame:
    schema = "doc_id long, part int, start long, n_tokens long, " + ("ids_crc32 long" if digest_only else "ids array<long>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, dtype = _opened(dictionary)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                if row["dictionary_sha256"].as_py() != dictionary["sha256"]:
                    raise ValueError("a block was written with another dictionary")
                index, payload = np.frombuffer(row["index"].as_buffer(), dtype=RECORD), memoryview(row["payload"].as_buffer())
                doc, out = [], []
                for r in index:
                    raw = expand.decompress(payload[r["offset"] : r["offset"] + r["bytes"]], max_output_size=int(r["ids"]) * int(dtype[2]))
                    ids = np.frombuffer(raw, dtype=dtype)
                    out.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest_only else ids.tolist())
                    doc.append(None if r["null_id"] else int(r["doc_id"]))
                start = row["start"].as_py() + np.cumsum(index["ids"]) - index["ids"]
                kinds = pa.int64() if digest_only else pa.list_(pa.int64())
                arrays = [pa.array(doc, pa.int64()), pa.array([row["part"].as_py()] * len(index), pa.int32()), pa.array(start), pa.array(index["ids"].astype(np.int64)), pa.array(out, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    return blocks.mapInArrow(read, schema)


def _dictionary(spark: SparkSession, path: str) -> dict:
    return spark.read.parquet(f"{path}/dictionary").first().asDict()


def read_store(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """Every document of a store: doc_id, start (ids before it in the whole store), n_tokens, and its ids
    or, digest_only, the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    blocks = spark.read.schema(DDL).parquet(f"{path}/blocks")
    # one row for each partition that was written, not for each block
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    base, at = [], 0
    for part, n in parts:
        base.append((part, at))
        at += n
    found = _documents(blocks, _dictionary(spark, path), digest_only)
    before = spark.createDataFrame(base, "part int, base long")
    last = "ids_crc32" if digest_only else "ids"
    return found.join(before, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", last)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens and ids of some documents. Only blocks whose id range can hold one are read."""
    blocks = spark.read.schema(DDL).parquet(f"{path}/blocks")
    near = F.lit(False)
    for d in doc_ids:
        near |= (F.col("first_id") <= d) & (F.col("last_id") >= d)
    return _documents(blocks.where(near), _dictionary(spark, path), False).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")

