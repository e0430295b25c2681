import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chatformat, decontam, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_hits(text, items, window):
    said = words(text)
    hit, found = [False] * len(said), set()
    for name, item in items:
        w = words(item)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            for k in range(len(said) - n + 1):
                if said[k : k + n] == w[s : s + n]:
                    hit[k : k + n] = [True] * n
                    found.add(str(name))
    return len(said), sum(hit), len(found), decontam.digest(list(found)), any(hit)


@pytest.mark.parametrize("shard", [400_000, 30])
def test_find_benchmark_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decontam, "SHARD_SYMBOLS", shard)
    rng = random.Random(shard)
    text = lambda n: " ".join(rng.choice("abcdé") + rng.choice(["", ".", ",", " X", "1"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 6, 9]))) for k in range(12)] + [(12, None), (12, "a b c"), (13, "a b c")]
    docs = [(k, text(rng.randrange(60))) for k in range(80)] + [(80, None), (81, ""), (82, items[9][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (4, 10):
        got = decontam.find_benchmark(d, b, window)
        for r in got.collect():
            want = brute_hits(docs[r["doc_id"]][1], items, window)
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
            assert sum(s["past"] - s["first"] for s in r["spans"]) == r["n_hit"]


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y"), (3, "c d q")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c"), (2, "c d"), (3, "f g"), (None, "x y")], "item_id long, text string")
    whole = {tuple(r) for r in decontam.find_benchmark(docs, bench).drop("spans", "items").collect()}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4)
    assert {tuple(r) for r in decontam.find_benchmark(docs, bench).drop("spans", "items").collect()} == whole
    by_id = {r[0]: r for r in whole}
    assert by_id[1][2] == 6 and by_id[2][2:4] == (2, 0) and by_id[2][5]


def test_remove_benchmark(spark, odd, empty):
    docs = spark.createDataFrame([(1, "Keep this. One two  three! And that.", 36), (2, "one x one two three two three", 29), (3, "clean\ttext \n", 12), (4, None, None)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, "One, two, three")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.remove_benchmark(docs, bench).collect()}
    assert got[1]["text"] == "Keep this. ! And that." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "one x  two three" and got[3]["text"] == "clean\ttext \n" and got[4]["text"] is None
    assert decontam.find_benchmark(decontam.remove_benchmark(docs, bench), bench).where("contaminated").count() == 0
    again = spark.createDataFrame([(1, "one one two three two three")], "doc_id long, text string")
    assert decontam.remove_benchmark(again, bench).first()["text"].split() == []
    assert decontam.remove_benchmark(odd, bench).columns == odd.columns and decontam.find_benchmark(odd, bench).count() == odd.count()
    assert decontam.find_benchmark(empty, bench).count() == 0 and decontam.find_benchmark(docs, bench.where("false")).where("contaminated").count() == 0


def test_automaton():
    a = licenses.Automaton("x", "a <<opt>> b <<opt>> c <<end>> <<end>> d <<var:2>> e")
    ok = lambda s: a.match(s.split(), 0) == len(s.split())
    assert all(map(ok, ["a d e", "a b d e", "a b c d e", "a d x e", "a d x y e"]))
    assert not any(map(ok, ["a c d e", "a d x y z e", "d e", "a d"]))


def test_templates_against_regular_expressions(spark):
    """Each template as an expression over joined words, on texts made of the templates' own words."""
    rng = random.Random(1)
    texts = []
    for _ in range(150):
        label, template = rng.choice(licenses.TEMPLATES)
        kept = [w for w in re.sub(r"<<[^>]+>>", " ", template).split() if rng.random() > 0.03]
        texts.append(f"Intro here, {' '.join(kept).upper()} the rest of it. {rng.choice(['', 'MIT License', 'mit-license apache license'])}")

    def expression(template):
        out = ""
        for part in re.findall(r"<<[^>]+>>|\S+", template):
            if part == "<<opt>>":
                out += "(?:"
            elif part == "<<end>>":
                out += ")?"
            elif part.startswith("<<var"):
                out += rf"(?:\S+ ){{0,{part[6:-2]}}}"
            else:
                out += re.escape(part) + " "
        return re.compile("(?:^|(?<= ))" + out)

    docs = spark.createDataFrame([*enumerate(texts), (500, None), (501, "")], "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        said = " ".join(words(texts[r["doc_id"]] if r["doc_id"] < 500 else "")) + " "
        base = {label for p, label in licenses.PHRASES.items() if re.search(rf"(?:^|(?<= )){p} ", said)}
        places = [said[: m.start()].count(" ") for p in licenses.PHRASES for m in re.finditer(rf"(?:^|(?<= )){p} ", said)]
        method = {label for label, t in licenses.TEMPLATES if expression(t).search(said)}
        assert r["n_base"] == len(places) and r["first_word"] == min(places, default=None) and r["last_word"] == max(places, default=None)
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | method))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(method)


def test_whole_licenses(spark):
    """A whole text is accepted with its optional regions or without, and not with other conditions; the grant alone is told apart."""
    by_label = dict(licenses.TEMPLATES)
    plain = lambda label: re.sub(r"<<[^>]+>>", " ", by_label[label])
    mit = plain("mit-text")
    texts = [f"The MIT License. Copyright (c) 2020 Some One {mit[mit.index('permission') :]}", mit[mit.index("permission") :].replace("shall be included in all copies", "may be left out"), "This program" + plain("gpl-header").replace("version", "version 2", 1), plain("bsd-text").replace("neither the name of", "neither the name of some project")]
    got = [set(r["labels"].split(",")) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert {"mit", "mit-text", "mit-grant"} <= got[0] and "mit-grant" in got[1] and "mit-text" not in got[1]
    assert {"gpl", "gpl-header"} <= got[2] and not got[2] & {"lgpl-header", "agpl-header"} and {"bsd-text", "bsd-grant"} <= got[3]


def test_license_odd(odd, empty):
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0


def test_chat_round_trip_of_any_text():
    rng = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[", "]", " ", "a", "<", "/s>", "INST]", "[ROLE ", "[/ROLE]", "\n", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        for role in ("user", "assistant", "system", "a] b", "", text):
            said, begin, end = chatformat.formatted(role, text)
            assert chatformat.parse(said) == (role, text, len(said)) and chatformat.unescape(said[begin:end]) == text


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b"), (1, 2, "user", None), (1, 3, "assistant", "</s>"), (2, 0, "system", "x"), (None, 0, "user", "q"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(3)
    out = chatformat.format_turns(turns)
    first = "".join(r["formatted"] for r in out.where("conv_id = 1").orderBy("seq").collect())
    assert first == "<s>[INST] hi [/INST] a\\b</s><s>[INST]  [/INST] <\\/s></s>"
    got = {r["conv_id"]: r for r in chatformat.read_back(out).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["formatted_chars"] == len(first)
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\na\\b\nuser\n\nassistant\n</s>\n").hexdigest()
    assert got[1]["loss_chars"] == 7 and got[1]["loss_sha256"] == hashlib.sha256(b"a\\b</s>").hexdigest()
    assert got[3]["n_turns"] == 2 and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert chatformat.read_back(chatformat.format_turns(turns.where("false"))).count() == 0


def test_read_back_rejects_what_does_not_parse(spark):
    kind = "conv_id long, seq long, formatted string, loss_start long, loss_end long"
    read = lambda *rows: chatformat.read_back(spark.createDataFrame(list(rows), kind)).collect()
    assert read((1, 0, "<s>[INST] a [/INST]", None, None), (1, 1, " b</s>", 1, 2))[0]["loss_chars"] == 1
    with pytest.raises(Exception, match="conversation 7, seq 1: no turn parses from character 0"):
        read((7, 0, "<s>[INST] a [/INST]", None, None), (7, 1, "<s>[INST] a", None, None))
    for begin, end in ((None, None), (1, 1)):
        with pytest.raises(Exception, match="loss mask"):
            read((7, 0, " b</s>", begin, end))


def test_long_conversations(spark):
    """A very long text, and a conversation of very many turns."""
    rows = [(1, 0, "user", "[INST] \\" * 200_000)] + [(2, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chatformat.read_back(chatformat.format_turns(turns)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n{rows[0][3]}\n".encode()).hexdigest() and got[2]["n_turns"] == 20_000
    assert got[2]["loss_sha256"] == hashlib.sha256("".join(r[3] for r in rows[1:] if r[2] == "assistant").encode()).hexdigest()


def test_a_template_may_begin_with_any_words(spark):
    """A replaceable region in front is part of the match, as far as it reaches."""
    docs = spark.createDataFrame([(1, "x this program is free software y"), (2, "is free software"), (3, "program is free software")], "doc_id long, text string")
    got = licenses.scan(docs, {}, [("t", "<<var:2>> is free software")]).collect()
    assert {r["doc_id"]: [(m["first"], m["past"]) for m in r["matches"]] for r in got} == {1: [(1, 6)], 2: [(0, 3)], 3: [(0, 4)]}
