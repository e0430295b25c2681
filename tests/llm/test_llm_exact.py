"""Results that must not depend on hashes: texts made to collide in weak hashes, and hashes that are all equal."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import bpe, common, decontam, ngramjoin, rules, tokenstore

from .test_llm_text import tiktoken_of


def morse(n=1024):
    """Two texts of a and b, complements of each other, which agree in sums of byte times power of a base modulo 2 ** 64."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return a, a.translate({97: "b", 98: "a"})


class Same(common.Hasher):
    def __call__(self, data, start, end):
        return np.zeros(len(start), dtype=np.uint64)


def test_hasher_is_a_polynomial():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = np.array([0, 3, 10, 700, 1500, 4999])
    end = np.array([3, 9, 700, 1400, 4999, 5000])
    small, large = common.Hasher(block=256), common.Hasher()
    assert small(data, start, end).tolist() == large(data, start, end).tolist()
    want = [sum((int(x) + 1) * pow(common._BASE, k, common.PRIME) for k, x in enumerate(data[a:b])) % common.PRIME for a, b in zip(start, end, strict=True)]
    assert large(data, start, end).tolist() == common.mixed(np.array(want, dtype=np.uint64) + (end - start).astype(np.uint64)).tolist()
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in morse())
    assert large(a, np.array([0]), np.array([1024]))[0] != large(b, np.array([0]), np.array([1024]))[0]


def test_same_bytes():
    data = np.frombuffer(b"abcabdab", np.uint8)
    start, end = np.array([0, 0, 0, 2, 0]), np.array([3, 2, 3, 2, 2])
    other, past = np.array([3, 3, 0, 5, 6]), np.array([6, 5, 3, 5, 8])
    assert common.same_bytes(data, start, end, data, other, past).tolist() == [False, True, True, True, True]


def test_texts_that_collide(spark):
    a, b = morse()
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a}\n{b}\n{a}"), (4, " ".join([a, "x y"] * 3)), (5, " ".join([b, "x y"] * 3))], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontam.find_benchmark(docs, bench).collect()} == {1: 1, 2: 0, 3: 2, 4: 3, 5: 0}
    ranks = bpe.read_ranks(bpe.vocabulary_path("byte_bpe_50k.tiktoken"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    other = tiktoken_of(ranks)
    assert all(r["ids"] == other.encode_ordinary(texts[r["doc_id"]]) for r in bpe.encode_documents(docs, ranks).collect())
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path("byte_bpe_50k.json")
    whole, where = Tokenizer.from_file(path), common.shared_dir(spark, "store")
    tokenstore.write_store(docs, where, path, parts=1)
    for r in tokenstore.read_store(spark, where, digest_only=True).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array([*whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
    assert {r["doc_id"]: r["component_id"] for r in ngramjoin.ngram_groups(docs, 4, 85).collect()} == {k: k for k in texts}
    assert {r["doc_id"]: r["n_dup_lines"] for r in rules.apply_rules(docs, None).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}


def test_all_hashes_equal():
    texts = ["a b c\na b c\n\nd", "one one one one two", "", "a b\n a b c a b c"]
    column = pa.array(texts, pa.string())
    assert {k: v.tolist() for k, v in rules.counts(column, Same()).items()} == {k: v.tolist() for k, v in rules.counts(column, common.Hasher()).items()}
    ranks = bpe.read_ranks(bpe.vocabulary_path("byte_bpe_50k.tiktoken"))
    encoder = bpe.Encoder(bpe.Vocabulary(ranks))
    want = [x.tolist() for x in encoder.encode(column)[:2]]
    encoder.hasher = Same()
    encoder.forget()
    assert [x.tolist() for x in encoder.encode(column)[:2]] == want


def test_words_of_one_hash(monkeypatch):
    items, texts = [(1, "a b"), (2, "c")], pa.array(["x a b c", "b a", "c x"], pa.string())
    want = decontam.Phrases(items, 10).symbols(common.Words(texts, common.ALNUM, common.Hasher())).tolist()
    monkeypatch.setattr(decontam, "Hasher", Same)
    assert decontam.Phrases(items, 10).symbols(common.Words(texts, common.ALNUM, Same())).tolist() == want == [0, 1, 2, 3, 2, 1, 3, 0]


@pytest.mark.parametrize("block", [1, 4, 6, 1 << 20])
def test_cuts_do_not_depend_on_blocks(spark, monkeypatch, block):
    docs = spark.createDataFrame([(1, "x y b b b z"), (2, "p b b q b b b"), (3, None), (1, "x y b b b z")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "x y z"), (2, "b b b"), (3, "p b b q")], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    out = decontam.remove_benchmark(docs, bench)
    assert [(r["doc_id"], None if r["text"] is None else r["text"].split()) for r in out.collect()] == [(1, []), (2, []), (3, None), (1, [])]
    assert decontam.remove_benchmark(docs.where("false"), bench).count() == 0 and decontam.remove_benchmark(docs, bench.where("false")).collect() == docs.collect()
