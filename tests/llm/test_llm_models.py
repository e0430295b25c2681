import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import hashtext, langid, quality, rules
from tallyloom.llm.common import Hasher, shingles
from tallyloom.llm.hashtext import Design, fit_cumulative_link

SF = "/root/testdata/sf0.01"
supplied = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@supplied
def test_language_accuracy_on_held_out_documents(spark):
    docs = read(spark, "documents")
    got = langid.identify_documents(docs, 150).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] <= right[2] <= 1


def models_of(texts):
    counts = [Counter(tuple(t[k : k + langid.ORDER].encode("utf-32-le")[::4]) for k in range(len(t) - langid.ORDER + 1)) for t in texts]
    return counts, langid.Models([str(k) for k in range(len(texts))], [dict(c) for c in counts])


def test_kneser_ney_sums_to_one():
    """Over all known characters and one that is unknown, after contexts that are known, partly known and unknown."""
    counts, m = models_of([" abcab cabba ab ", " xyzzy abx "])
    for k, own in enumerate(counts):
        known = {g[-1] for g in own} | {c for g in own for c in g[1:]}
        for context in [*{g[:-1] for g in own}, (97, 98, 1), (1, 2, 3)]:
            p = lambda c: float(np.exp(m.log_probability(np.array([*context, c], dtype=np.uint64))[0, k]))  # noqa: B023, E731
            assert abs(sum(map(p, known)) + p(5000) - 1) < 1e-9


def test_entropies_against_brute_force():
    """Cross-entropy by the recursion of interpolated Kneser-Ney, on counts of grams of every order."""
    counts, m = models_of([" abcab cabba ab ", " xyzzy abx "])

    def probability(own, context, c):
        level = {langid.ORDER: own}
        for n in range(langid.ORDER - 1, 0, -1):
            level[n] = Counter(g[1:] for g in level[n + 1])
        p = 1 / (len(level[1]) + 1)
        for n in range(1, langid.ORDER + 1):
            h = context[len(context) - n + 1 :] if n > 1 else ()
            here = {g: x for g, x in level[n].items() if g[:-1] == h}
            if here:
                one, two = (sum(x == v for x in level[n].values()) for v in (1, 2))
                d = one / (one + 2 * two) if one and two else 0.5
                p = max(here.get((*h, c), 0) - d, 0) / sum(here.values()) + d * len(here) / sum(here.values()) * p
        return p

    texts = ["abba cab", "xyz, ab!", "q", "Zzyx  Zzy"]
    got = m.entropies(texts, langid.Letters())
    for t, row in zip(texts, got, strict=True):
        said = [ord(c) for c in re.sub(r"[^a-z]+", " ", f" {t.lower()} ")]
        said = [32] * langid.ORDER + said if len(said) < langid.ORDER else said
        for k, own in enumerate(counts):
            logs = [np.log(probability(own, tuple(said[j : j + 3]), said[j + 3])) for j in range(len(said) - 3)]
            width = max(1, len(said) - 3) if len(said) < 2 * langid.ORDER and t == "q" else len(logs)
            assert abs(row[k] + sum(logs) / (1 if t == "q" else width)) < 1e-9


def brute_score(text, weights):
    """The linear score, counted feature by feature."""
    hasher, parts = Hasher(), [[], [], []]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    data = [np.frombuffer(w.encode(), np.uint8) for w in words]
    hashes = [hasher(d, np.array([0]), np.array([len(d)]))[0] for d in data]
    for k, h in enumerate(hashes):
        parts[0].append(int(h) >> (64 - hashtext.WORD_BITS))
        if k:
            parts[1].append(hashtext.BASES[1] + (int(shingles(np.array(hashes[k - 1 : k + 1]), 2)[0]) >> (64 - hashtext.PAIR_BITS)))
            if words[k] == words[k - 1]:
                parts[0].append(int(hashtext._AGAIN) >> (64 - hashtext.WORD_BITS))
    for a, b, c in zip(text, text[1:], text[2:], strict=False):
        code = (ord(a) << 42 | ord(b) << 21 | ord(c)) * int(hashtext._SPREAD) % (1 << 64)
        parts[2].append(hashtext.BASES[2] + (code >> (64 - hashtext.TRIGRAM_BITS)))
    return sum(hashtext.SCALE * float(np.mean([weights[s] for s in p])) for p in parts if p)


def test_scores_against_brute_force(spark, empty):
    """Scores, expected grades, tail probabilities and verdicts from the weights; ties at the threshold are kept."""
    texts = ["Good words here, good words", "é日本 \U0001f600x", "", "ab", "bad bad bad  BAD", None, "one", "long " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    weights = np.random.default_rng(3).normal(size=hashtext.SLOTS).astype(np.float32)
    got = {r["doc_id"]: r["__linear"] for r in hashtext.scored(docs, weights).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k] - brute_score(t or "", weights)) < 1e-4 * max(1, abs(got[k]))
    model = rules.Rated(weights, 0.01, 0.2)
    words = spark.createDataFrame([(k, f"{t} " + " ".join(f"w{j}" for j in range(60))) for k, t in enumerate(texts)], "doc_id long, text string")
    said = {r["doc_id"]: r["text"] for r in words.collect()}
    found = rules.apply_rules(words, model).collect()
    for r in found:
        want = 1 / (1 + np.exp(-(0.01 * brute_score(said[r["doc_id"]], weights) + 0.2)))
        assert abs(r["quality"] - want) < 1e-5 and r["kept"] == (not r["base_failed"] and r["quality"] >= rules.KEEP)
    tie = found[0]["quality"]
    assert {r["doc_id"]: r["kept"] for r in rules.apply_rules(words, model, keep=tie).collect()}[found[0]["doc_id"]] == (not found[0]["base_failed"])


@supplied
def test_rating_against_brute_force(spark):
    docs = read(spark, "documents").limit(60).cache()
    labels = read(spark, "labels")
    design, grade, _, weight = hashtext.sampled(read(spark, "documents"), quality.grades(labels))
    weights, cuts = fit_cumulative_link(design, grade, quality.GRADES, weight)
    whole = quality.rate(read(spark, "documents"), labels).join(docs.select("doc_id"), "doc_id", "left_semi").collect()
    for r in whole:
        above = [1 / (1 + np.exp(cut - brute_score(r["text"], weights.astype(np.float32)))) for cut in cuts]
        assert abs(r["expected_grade"] - sum(above)) < 1e-4 and abs(r["tail_probability"] - above[-1]) < 1e-4
        assert r["kept"] == (r["tail_probability"] >= quality.KEEP)


def test_language_odd(spark, odd, empty):
    got = {r["doc_id"]: r for r in langid.identify_documents(odd).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 2)] == ["und"] * 3 and got[0]["score"] == 0.0 and got[0]["rejected"]
    assert {got[k]["lang_pred"] for k in (3, 6)} <= {"en", "und"} and got[None]["held_out"] is False
    assert langid.identify_documents(empty).count() == 0
    nobody = langid.identify_documents(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nobody.collect()} == {"und"}


@supplied
def test_quality_on_held_out_labels(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = quality.rate(docs, labels.where(half)).join(quality.grades(labels.where(~half)), "doc_id")
    share = {r["grade"]: r["kept"] for r in got.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    # some 25 poor and 25 harmful documents to learn from
    assert share[2] > 0.95 and share[0] < 0.4 and share[1] < 0.4
    assert got.where("not expected_grade between 0 and 2").count() == 0


def test_cumulative_link_gradient():
    """The fitted model's loss is no higher than that of nearby weights and thresholds."""
    rng = np.random.default_rng(0)
    rows, grade = [], []
    for _ in range(200):
        x = rng.random(2).astype(np.float32)
        rows.append((np.array([0, 1], dtype=np.int32).tobytes(), x.tobytes()))
        grade.append(int(np.clip((x[0] - x[1]) * 3 + 1 + rng.normal(0, 0.5), 0, 2.99)))
    w, cuts = fit_cumulative_link(Design(rows), np.array(grade), 3, steps=800, decay=0, rate=0.05)
    assert w[0] > 1 and w[1] < -1 and cuts[0] < cuts[1] and not w[2:].any()


def test_quality_odd(spark, odd, empty, no_labels):
    got = quality.rate(odd, no_labels)
    assert got.count() == odd.count() and got.where("not kept").count() == 0
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, 1), (6, None, 1), (7, 1, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and {r["kept"] for r in quality.keep_good(odd, no_labels).collect()} == {"mine"}
    assert quality.rate(odd, labels).count() == odd.count() and quality.rate(empty, labels).count() == 0
    clash = odd.selectExpr("*", "'mine' as Linear_Score", "'too' as linear_score_")
    assert quality.keep_good(clash, labels).columns == clash.columns
    assert {(r["Linear_Score"], r["linear_score_"]) for r in quality.keep_good(clash, no_labels).collect()} == {("mine", "too")}


def brute_counts(text):
    text = text or ""
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    words = pattern.findall(text)
    lines = [x for x in text.split("\n") if pattern.search(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, odd, empty, no_labels):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "b", "é#", "x\n", "日|", "c\nc"]) for _ in range(rng.randrange(90))) for _ in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert rules.train(docs, no_labels) is None
    for r in rules.apply_rules(docs, None).collect():
        want = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) == (not r["kept"])
    assert rules.apply_rules(odd, None).count() == odd.count() and rules.apply_rules(empty, None).count() == 0


@supplied
def test_rules_follow_quality_labels(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = rules.apply_rules(docs, rules.train(docs, labels.where(half))).drop("quality").join(labels.where(~half), "doc_id").where("not base_failed")
    right = got.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.97
