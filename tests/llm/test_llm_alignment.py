import hashlib
import os
import random
from bisect import bisect_left
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import alignment, bpe

pytest.importorskip("public_tokenizers")
A, B = bpe.vocabulary_path("byte_bpe_50k.json"), bpe.vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """The contract's columns, token by token, with whole texts through the libraries."""
    a, b = libraries
    byte = {c: k for k, c in enumerate(bpe.byte_characters())}
    linked, said = [], []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        tokens_a = [(i, bytes(byte[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>") for i in ids]
        tokens_b = []
        for i in b.encode(text or ""):
            piece = b.id_to_piece(i)
            tokens_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(t for _, t in tokens_a) != whole or b"".join(t for _, t in tokens_b) != whole:
            tokens_a = tokens_b = []
        ends = []
        for side in (tokens_a, tokens_b):
            at, out = 0, []
            for _, t in side:
                at += len(t)
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        of = [[bisect_left(cuts, e) for e in es] for es in ends]
        groups = [([], []) for _ in cuts]
        for k, side in enumerate((tokens_a, tokens_b)):
            for (i, _), g in zip(side, of[k], strict=True):
                groups[g][k].append(i)
        linked.append([(x, y) for g in groups for x in g[0] for y in g[1]])
        said.append((len(tokens_a), len(tokens_b), len(groups), ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)))
    count = Counter(p for links in linked for p in set(links))
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(n, highest.get(x, 0))
    return [(na, nb, ng, len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if na else "") for (na, nb, ng, s), links in zip(said, linked, strict=True)]


def check(spark, texts, libraries, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = alignment.align_documents(docs.withColumns({"row": F.lit("mine"), "a": F.lit(1), "links": F.lit("x")}), *alignment.sources(A, B), **more)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r[n] for n in names) for r in got.orderBy("doc_id").collect()] == brute(texts, libraries)


ODD = [None, "", " ", "  ", "a", "a", "x\n\ny\t z  ", " lead", "\n", "tail \n ", "a\r\nb", "<|endoftext|> <s>[INST]</s> <unk> <0x0A>", "▁ mark ▁▁x", "日本語 \U0001f600 \U0001f468‍\U0001f469‍\U0001f467", "é ﬁ ½     x", "\x00 \x01", "ééé ééé", "don't we'll I'M 12345 1 000", "x" * 5000, " " * 300 + "y", "the cat sat " * 900]


def test_odd_texts_against_the_libraries(spark, libraries):
    check(spark, ODD, libraries)
    check(spark, ODD, libraries, broadcast_pairs=0)


def test_random_texts(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 300)
    rng = random.Random(12)
    parts = ["the", " the", "ing", "é", "日", "\n", "\t", " ", "  ", "123", "'s", "\U0001f600", "ß", "Zu", "straße", ".", "́", "</s>", "\r", "▁"]
    check(spark, ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)], libraries)


def test_ids_of_repeated_and_null_documents(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, "one two"), (5, "three")], "doc_id long, text string")
    got = alignment.align_documents(docs, *alignment.sources(A, B)).collect()
    assert sorted(((r["doc_id"], r["n_links"]) for r in got), key=repr) == [(5, 1), (5, 2), (None, 2), (None, 2)]
    assert {r["count_sum"] for r in got if r["n_links"] == 2} == {6}
    assert alignment.align_documents(docs.where("false"), *alignment.sources(A, B)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the supplied tables are not here")
def test_supplied_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()
    check(spark, [d["text"] for d in docs], libraries)
