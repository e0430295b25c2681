import os
import random

from tallyloom.llm import linededup, ngramjoin
from tallyloom.llm.common import checkpoint_root, sieved, stored


def written(spark):
    root = checkpoint_root(spark).removeprefix("file://")
    return set(os.listdir(root)) if os.path.exists(root) else set()


def test_no_spent_tables_are_left(spark):
    """What stays in the shared folder is what the result still reads, not lines, keys, blocks and texts."""
    rng = random.Random(8)
    line = lambda: " ".join("w%d" % rng.randrange(5000) for _ in range(30))
    a, b = line(), line()
    docs = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a} x\n{line()}"), (3, b)], "doc_id long, text string")
    kinds = lambda before: {n.rsplit("-", 1)[0] for n in written(spark) - before}
    before = written(spark)
    linededup.dedup_lines(docs)
    assert not kinds(before) & {"lines", "line-classes", "line-texts", "line-blocks", "line-simhashes"}
    before = written(spark)
    ngramjoin.ngram_groups(docs)
    assert not kinds(before) & {"keys", "classes", "leaders", "blocks", "block-links"}


def test_sieve_keeps_every_partner(spark):
    """Rows with a partner all stay, at any number of bits a key; most of the others go, and no column is added or lost."""
    rows = spark.range(20_000).selectExpr("id", "id * 7 as key", "'mine' as sieve_word")
    keys = stored(spark.range(1_000).selectExpr("id * 140 as k"), "sieve-keys")
    got = sieved(rows, "key", keys)
    assert got.columns == rows.columns and got.join(keys, got.key == keys.k, "left_semi").count() == 1_000 and got.count() < 4_000
    assert sieved(rows, "key", keys.where("false")).count() == 0


def test_joins_with_few_keys_shuffle_few_texts(spark, monkeypatch):
    """Only texts of documents that may be in a block are packed and shuffled."""
    rng = random.Random(9)
    line = lambda: " ".join("w%d" % rng.randrange(5000) for _ in range(30))
    a = line()
    docs = spark.createDataFrame([(0, a), (1, a + " x"), *[(k, line()) for k in range(2, 400)]], "doc_id long, text string")
    seen = []
    packed = ngramjoin.packed
    monkeypatch.setattr(ngramjoin, "packed", lambda some: packed(seen.append({r["doc_id"] for r in some.collect()}) or some))
    assert {r["component_id"] for r in ngramjoin.ngram_groups(docs).where("doc_id < 2").collect()} == {0}
    assert len(seen) == 1 and {0, 1} <= seen[0] and len(seen[0]) < 100
