import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bpe, common, tokenstore

from .conftest import ODD


def test_words_and_hashes():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB1 _é日\n\t-") for _ in range(rng.randrange(60))) for _ in range(300)] + ODD
    for table, pattern in ((common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (common.UNSPACED, r"[^\x20\x09-\x0D]+")):
        known: dict[int, str] = {}
        words = common.Words(pa.array(texts, pa.string()), table, common.Hasher(block=64))
        for r, t in enumerate(texts):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            a, b = words.first[r], words.first[r + 1]
            said = [words.data[s:e].tobytes().decode() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)]
            assert said == re.findall(pattern, low)
            for w, h in zip(said, words.hash[a:b].tolist(), strict=True):
                assert known.setdefault(h, w) == w
        assert len(known) == len(set(known.values()))


def test_hashes_spread_evenly():
    words = common.Words(pa.array([" ".join(map(str, range(20_000)))]), common.ALNUM, common.Hasher())
    assert np.bincount((words.hash >> np.uint64(60)).astype(int), minlength=16).min() > 1000


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.vocabulary_path("byte_bpe_50k.tiktoken"))


def tiktoken_of(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n=3000):
    rng = random.Random(2)
    alphabet = "abst' ''relvmd\n\t\r 0123é日本ñ½.,;!?     \U0001f600́\x1c\x85　"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_bpe_equals_tiktoken(ranks):
    other, encoder = tiktoken_of(ranks), bpe.Encoder(bpe.Vocabulary(ranks))
    texts = fuzz() + [t for t in ODD if t is None or len(t) < 1000]
    ids, at, data, off = encoder.encode(pa.array(texts, pa.string()))
    for t, a, b, c, d in zip(texts, at[:-1], at[1:], off[:-1], off[1:], strict=True):
        assert other.encode_ordinary(t or "") == ids[a:b].tolist()
        assert encoder.decode(ids[a:b]).tobytes().decode() == (t or "")
        where = encoder.offsets(ids[a:b], data[c:d])
        if len(where):
            assert where[0][0] == 0 and where[-1][1] == len(t) and (where[1:, 0] <= where[:-1, 1]).all()
    split = encoder.offsets(np.array(other.encode_ordinary("\U0001f600")), np.frombuffer("\U0001f600".encode(), np.uint8))
    assert {tuple(x) for x in split.tolist()} == {(0, 1)}  # several ids, one character


def test_encode_documents(spark, odd, empty, ranks):
    other = tiktoken_of(ranks)
    got = bpe.encode_documents(odd, ranks, with_offsets=True)
    for r in got.join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = np.array(other.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
        assert len(r["ids"]) == len(r["char_start"]) == r["n_tokens"]
    assert got.count() == odd.count() and bpe.encode_documents(empty, ranks).count() == 0


def test_token_store(spark, odd, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(fuzz(300))], "doc_id long, text string"), allowMissingColumns=True)
    where = common.shared_dir(spark, "store")
    tokenstore.write_store(docs, where, path, parts=3)
    got = {r["doc_id"]: r for r in tokenstore.read_store(spark, where).collect()}
    short = {r["doc_id"]: r for r in tokenstore.read_store(spark, where, digest_only=True).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        mine = got[r["doc_id"]]
        assert (mine["start"], mine["n_tokens"], mine["ids"]) == (start, len(ids), ids)
        assert short[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert {r["doc_id"] for r in tokenstore.read_documents(spark, where, [1, 105]).collect()} == {1, 105}
    none = common.shared_dir(spark, "store")
    tokenstore.write_store(empty, none, path)
    assert tokenstore.read_store(spark, none).count() == 0
    nulls = common.shared_dir(spark, "store")
    tokenstore.write_store(odd, nulls, path)
    assert tokenstore.read_store(spark, nulls).count() == odd.count()


def test_store_rejects_another_dictionary(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string")
    where = common.shared_dir(spark, "store")
    tokenstore.write_store(docs, where, bpe.vocabulary_path("byte_bpe_50k.json"))
    blocks = spark.read.parquet(f"{where}/blocks").withColumn("dictionary_sha256", F.lit("0"))
    with pytest.raises(Exception, match="another dictionary"):
        tokenstore._documents(blocks, tokenstore._dictionary(spark, where), True).collect()
