import random
import re

from pyspark.sql import functions as F

from fernglass.llm.near_duplicates import candidate_pairs, classes, components, similar_classes


def brute(texts, words, least, threshold):
    sets = {}
    for i, t in texts:
        w = re.findall("[a-z0-9_]+", (t or "").lower())
        if i is not None and t is not None and len(w) >= max(least, words):
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def sample():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for k in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(k * rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append((f"d{g}_{k}", " ".join(words)))
    return out + [("copy1", out[0][1]), ("copy2", out[0][1].upper()), ("null", None), ("empty", ""), ("short", "a b c"), (None, out[0][1]), out[0], ("long", "x " * 50_000 + "y z w v")]


def test_pairs_match_brute_force(spark):
    texts = sample()
    df = spark.createDataFrame(texts, "id string, text string").withColumn("runs", F.lit(1)).withColumn("class", F.lit(2))
    for words, least, threshold in ((4, 30, 0.6), (5, 0, 0.8)):
        members, sets = classes(df, words, least)
        pairs = similar_classes(sets, threshold)
        at = {r["class"]: set() for r in members.collect()}
        for r in members.collect():
            at[r["class"]].add(r.id)
        got = {tuple(sorted((x, y))) for r in pairs.collect() for x in at[r.a] for y in at[r.b]}
        got |= {(x, y) for m in at.values() for x in m for y in m if x < y}
        assert got == brute(texts, words, least, threshold)


def test_hot_bands_are_paired_in_cells(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [(f"h{k}", " ".join(w if i % 40 else rng.choice("abcdefgh") for i, w in enumerate(base))) for k in range(90)] + sample()
    _, sets = classes(spark.createDataFrame(texts, "id string, text string"), 4, 30)
    pairs = [{(r.a, r.b) for r in candidate_pairs(sets, 0.6, cell=cell).collect()} for cell in (3, 7, 1 << 20)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) > 3000


def test_components_match_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(30)]
    nodes = list(range(140))
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame([(n,) for n in nodes], "id bigint"), spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r.id: r["group"] for r in got.collect()} == {n: find(n) for n in nodes}


def test_empty(spark):
    members, sets = classes(spark.createDataFrame([], "id string, text string"))
    assert members.count() == 0 and similar_classes(sets, 0.8).count() == 0
