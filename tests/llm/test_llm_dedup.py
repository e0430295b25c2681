import random

from tallyloom.llm import components, linededup, ngramjoin


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (7, None)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    want = roots(real, {x for e in real for x in e})
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text, n):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def copies(rng, n_families=12):
    """Families of near copies at about the threshold, chains, a shared passage, exact copies, short texts."""
    word = lambda: "w%d" % rng.randrange(4000)
    passage = [word() for _ in range(30)]
    out = []
    for f in range(n_families):
        base = [word() for _ in range(rng.choice([3, 8, 20, 60, 200]))] + (passage if f % 3 == 0 else [])
        out.append(base)
        for _ in range(rng.randrange(12)):
            now = list(rng.choice(out[-3:]))
            for _ in range(rng.randrange(1, 3)):
                now[rng.randrange(len(now))] = word()
            if rng.random() < 0.3:
                now = now[: int(len(now) * rng.uniform(0.8, 1))] or now
            out.append(now)
    rng.shuffle(out)
    return [" ".join(x) for x in out]


def test_ngram_groups_against_brute_force(spark, monkeypatch):
    for seed in range(3):
        texts = copies(random.Random(seed)) + ["same text again and again here"] * 5
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        for n, percent in ((4, 85), (5, 80)):
            if seed == 2:  # every block is cut
                monkeypatch.setattr(ngramjoin, "BLOCK_DOCS", 3)
            sets = [shingle_set(t, n) for t in texts]
            edges = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
            want = roots(edges, range(len(texts)))
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.ngram_groups(docs, n, percent).collect()}
            assert got == {d: (len(sets[d]), want[d]) for d in want}


def test_ngram_groups_odd(spark, odd, empty):
    got = ngramjoin.ngram_groups(odd, 4, 85)
    assert got.count() == odd.count() and ngramjoin.ngram_groups(empty, 4, 85).count() == 0
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[0]["n_shingles"] == by_id[1]["n_shingles"] == by_id[2]["n_shingles"] == 0
    assert by_id[4]["component_id"] == 3 and by_id[None]["component_id"] is None
    kept = ngramjoin.first_of_groups(odd, 4, 85)
    assert kept.columns == odd.columns and 4 not in {r["doc_id"] for r in kept.collect()}


def test_line_dedup(spark):
    rng = random.Random(4)
    line = lambda n=40: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    a, b, c = line(), line(), line()
    docs = [(1, f"{a}\n{b}"), (2, f"{a.upper()}!\nshort\n{c}"), (3, "short\nshort"), (4, f"{c}\n{c}"), (5, b)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["text"] == docs[0][1] and got[2]["text"] == f"short\n{c}" and got[3]["text"] == ""
    assert got[4]["text"] == "" and (got[4]["n_lines"], got[4]["n_removed"]) == (2, 2) and got[5]["text"] == ""


def test_line_dedup_odd(spark, odd, empty):
    got = linededup.dedup_lines(odd)
    assert got.count() == odd.count() and set(got.columns) == {*odd.columns, "n_removed"}
    assert {r["doc_id"]: r["text"] for r in got.collect()}[0] is None
    assert linededup.dedup_lines(empty).count() == 0
    clash = odd.selectExpr("*", "'mine' as doc_of_gone", "8 as row_of_text", "9 as Lines_gone")
    got = linededup.dedup_lines(clash)
    assert {*clash.columns, "n_removed"} == set(got.columns) and {tuple(r) for r in got.select("doc_of_gone", "row_of_text", "Lines_gone").collect()} == {("mine", 8, 9)}
