import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgauge.llm import components, ngram_join, scratch, vector_join


def roots_of(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def sets_of(texts, width):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def brute(texts, width, num, den):
    sets = sets_of(texts, width)
    edges = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return sets, roots_of(range(len(sets)), edges)


def corpus(seed, n=60, words=30):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(words, 2 * words))] for _ in range(n // 6)]
    texts = []
    for i in range(n):
        own = list(base[i % len(base)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            own[rng.randrange(len(own))] = rng.choice(vocab)
        texts.append(" ".join(own[: rng.choice([len(own), len(own), len(own) - 1])]))
    return texts + ["", None, " \t\n", "one", "ONE", "one two", "one two three", "One  two\nthree", "a\x1cb c\x85d e f", "long " * 5000 + "x", "long " * 5000 + "y"]


@pytest.mark.parametrize("width,num,den,pairs_per_row", [(4, 85, 100, 8), (5, 80, 100, 0), (2, 1, 2, 8)])  # 0 pairs per row: all hub turns
def test_groups_match_brute_force(spark, monkeypatch, width, num, den, pairs_per_row):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", pairs_per_row)
    texts = corpus(width)
    sets, roots = brute(texts, width, num, den)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("class", F.lit("x")).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(df, width, num, den).collect()}
    assert got == {i: (len(sets[i]), roots[i]) for i in range(len(texts))}


def appended(seed, num, den, words=100):
    """Texts with copies, and variants of them with 5 to 25 percent of words of their own at the end, in front or inside."""
    rng = random.Random(seed)
    texts = []
    for i in range(40):
        base = [f"b{i}x{k}" for k in range(words + rng.randrange(20))]
        variants = []
        for j in range(3):
            extra = [f"e{i}x{j}x{k}" for k in range(round(len(base) * rng.uniform(0.05, 1.25 * (den / num - 1))))]
            at = rng.choice([len(base), 0, len(base) // 2])
            variants.append(base[:at] + extra + base[at:])
        texts += [" ".join(t) for t in [base] * rng.choice([1, 1, 6]) + variants[: rng.choice([1, 1, 3])]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("width,num,den,pairs_per_row", [(4, 85, 100, 4), (5, 80, 100, 4), (5, 80, 100, 0)])
def test_texts_with_words_added_match_brute_force(spark, monkeypatch, width, num, den, pairs_per_row):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", pairs_per_row)
    texts = appended(num, num, den)
    sets, roots = brute(texts, width, num, den)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(df, width, num, den).collect()}
    assert got == {i: (len(sets[i]), roots[i]) for i in range(len(texts))}


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "A b c d e f"), (5, "a b c d e f"), (7, "other words here now"), (None, "lonely text without an id"), (8, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.jaccard_groups(df).collect()), key=str)
    assert rows == sorted([(-1, 5), (-1, 5), (5, 5), (5, 5), (7, 7), (-1, None), (8, 8)], key=str)
    assert sorted(str(r["doc_id"]) for r in ngram_join.drop_near_copies(df).collect()) == ["5", "7", "8", "None", "None", "None"]


def test_clashing_columns_stay_beside_near_copies(spark):
    rows = [(1, "a b c d e f", 1, "x", 2), (2, "A b c d e f", 3, "y", 4), (5, None, 5, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, class string, Head_ID int")
    left = ngram_join.drop_near_copies(df)
    assert left.columns == df.columns and sorted(map(tuple, left.collect())) == [rows[0], rows[2]]


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100)])
def test_all_documents_match_brute_force(spark, width, num, den):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    sets = sets_of([t for _, t in rows], width)
    holders = {}
    for i, own in enumerate(sets):
        for g in own:
            holders.setdefault(g, []).append(i)
    near = {(a, b) for own in holders.values() for a, b in itertools.combinations(own, 2)}
    roots = roots_of(range(len(rows)), [(a, b) for a, b in near if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(df, width, num, den).collect()}
    assert got == {d: (len(sets[i]), rows[roots[i]][0]) for i, (d, _) in enumerate(rows)}


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_groups(none).count() == 0
    assert ngram_join.drop_near_copies(none).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300 - i, 301 - i) for i in range(20)] + [(7, 7), (None, 3)]
    edges += [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots_of({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            center = rng.normal(size=16)
            for _ in range(6):
                rows.append((center + rng.normal(size=16) * rng.choice([0.0, 0.2, 0.35])).tolist() + [label])
    out = [(i, r[:-1], r[-1]) for i, r in enumerate(rows)]
    n = len(out)
    out += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [1.0, None], 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [float("inf")] * 16, 0)]
    out += [(n + 6, [1.0, 2.0], 0), (n + 7, [1e-30, 2e-30], 0), (n + 8, [1e30, 2e30], 1), (n + 9, [1.0, 2.0], 1)]
    return out


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 20)
    monkeypatch.setattr(vector_join, "LEAF_ROWS", 4)
    rows = vectors()
    unit = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            unit[i] = (label, x / np.sqrt((x * x).sum()))
    edges = [(a, b) for a, b in itertools.combinations(unit, 2) if unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and float(unit[a][1] @ unit[b][1]) >= 0.93]
    roots = roots_of([r[0] for r in rows], edges)
    links = {r[0]: sum(r[0] in e for e in edges) for r in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    small = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("size", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_join.near_vectors(small).collect()}
    assert got == {i: (links[i], roots[i], roots[i] == i) for i in links}
    assert len(edges) > 50 and vector_join.near_vectors(df).count() == len(rows)
    assert vector_join.near_vectors(df.limit(0)).count() == 0


def test_blocks_of_vectors_do_not_grow_with_the_partitions(spark, monkeypatch):
    """On check_h op5 was stopped: 211 partitions made 220 blocks, and all those of the group of near copies met."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=8) + rng.normal(size=(300, 8)) * 0.1
    rows = [(i, v.tolist(), 7) for i, v in enumerate(near)] + [(300 + i, v.tolist(), i % 3) for i, v in enumerate(rng.normal(size=(100, 8)))]
    unit = np.array([r[1] for r in rows])
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    labels = np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(len(rows), dtype=bool)
    roots = roots_of(range(len(rows)), np.argwhere(linked).tolist())
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 100)
    save, blocks = scratch.save, []

    def spy(df, name, *args):
        out = save(df, name, *args)
        if name == "op5-blocks":
            blocks.append(out[0].count())
        return out

    monkeypatch.setattr(scratch, "save", spy)
    conf = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: (int(linked[i].sum()), roots[i]) for i in range(len(rows))}
    assert blocks[-1] <= 4 + 3  # cuts of 400 rows, and at the ends of three labels


@pytest.mark.parametrize("kind,labels", [("double", [0.2, 0.7, 0.2, None, -0.0, 0.0]), ("string", ["a", "b", "a", None, "", ""])])
def test_labels_are_compared_as_they_are(spark, kind, labels):
    df = spark.createDataFrame([(i, [1.0, 2.0], x) for i, x in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
    assert {r["vec_id"]: r["component_id"] for r in vector_join.near_vectors(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 4}


def test_many_equal_vectors_stay_one_class(spark):
    df = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(3).alias("label"))
    rows = vector_join.near_vectors(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in rows} == {(499, 0)} and sum(r["kept"] for r in rows) == 1
