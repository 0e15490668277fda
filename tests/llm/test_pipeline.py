"""The stages against plain versions of what each must do with its own input."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from mailgauge.llm import scratch, toxicity, wordcoder
from tests.llm.test_joins_vectors import appended, brute
from tests.llm.test_text_scanners import _prose, base_pii


@pytest.fixture(scope="module")
def stages(spark, sf):
    rows, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        done = scratch.saved(stage(spark, rows, sf), "test-stage")
        out.append((name, rows, done))
        rows = done
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "exact dedup", "n-gram Jaccard join", "pii", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_toxic_documents_of_few_short_words_and_stems_go(spark, tmp_path):
    """Held-out documents of two made-up languages; an insult is a short word in one, any word of a stem in the other."""
    rng = random.Random(5)
    tongues = [[a + b for a in "bdfgklmn" for b in ("a", "en", "i")], [a + b for a in "prstvwz" for b in ("o", "u", "ei")]]
    rows = []
    for i in range(1800):
        tongue, toxic = int(rng.random() < 0.2), int(i % 5 == 0)
        own = _prose(rng, tongues[tongue], rng.randint(150, 400))
        for _ in range(3 * toxic):
            own[rng.randrange(len(own))] = rng.choice(["yuck", "jerk"]) if tongue == 0 else "xaqo" + rng.choice(tongues[1])
        rows.append((i, " ".join(own), toxic, tongue))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    for k in (0, 1):
        caught, left = ([r[0] not in kept for r in held if r[2] == t and r[3] == k] for t in (1, 0))
        assert sum(caught) > 0.9 * len(caught) and sum(left) < 0.05 * len(left)


def test_toxic_documents_go(spark, sf, stages):
    _, before, after = stages[0]
    model = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"), lambda c: ~toxicity.held_out(c))
    scores = {d: model.scores([(r["text"] or "").encode()])[0] for d, r in by_id(before).items()}
    assert set(by_id(after)) == {d for d, s in scores.items() if s < toxicity.THRESHOLD}


def test_one_of_equal_texts_stays(stages):
    _, before, after = stages[1]
    first = {}
    for d, r in sorted(by_id(before).items()):
        first.setdefault(r["text"] or "", d)
    assert set(by_id(after)) == set(first.values())


def test_one_of_near_copies_stays(stages):
    _, before, after = stages[2]
    rows = sorted(by_id(before).items())
    _, roots = brute([r["text"] for _, r in rows], 5, 80, 100)
    assert set(by_id(after)) == {rows[k][0] for k in set(roots.values())}


def test_one_of_near_copies_with_words_added_stays(spark, sf):
    texts = appended(1, 80, 100)
    _, roots = brute(texts, 5, 80, 100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert set(by_id(corpus_pipeline.drop_near_copies(spark, df, sf))) == set(roots.values())


def test_personal_data_is_gone(stages):
    _, before, after = (by_id(x) if not isinstance(x, str) else x for x in stages[3])
    assert set(before) == set(after)
    for d, r in after.items():
        assert base_pii(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if not base_pii(before[d]["text"]) and not re.search(r"\[[A-Z_]+\]", r["text"]):
            assert r["text"] == before[d]["text"]


def test_sequences_hold_all_tokens(stages):
    from tokenizers import Tokenizer

    _, before, after = stages[4]
    t = Tokenizer.from_file(wordcoder.default_path())
    want = set()
    for d, r in by_id(before).items():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want |= {(d, i, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for i, s in enumerate(range(0, len(ids), 2048))}
    rows = after.collect()
    assert {tuple(r[:5]) for r in rows} == want and len(rows) == len(want)
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048


def test_odd_rows_and_clashing_columns_pass_all_stages(spark, sf):
    long = "the quick brown fox jumps over it " * 3000
    rows = [(1, "a b c d e f g", 1.5, "x", 2), (1, "a b c d e f g", 1.5, "x", 2), (2, "A b c d e f g", 0.5, "y", 3), (3, None, None, None, None), (4, "", None, None, None), (None, "no id at all here now", 1.0, "z", 1), (5, long, 2.0, "w", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double, _id string, n_chars int").withColumnRenamed("_id", "Kept_Id")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = scratch.saved(stage(spark, docs, sf), "test-odd")
        if k < 4:
            assert after.columns == docs.columns
        docs = after
    left = {(r["doc_id"]) for r in docs.collect()}
    assert left == {1, 3, None, 5}


def test_clear_removes_scratch_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    scratch.save(spark.range(3), "test-clear")
    assert [p.name for p in tmp_path.iterdir()] == ["mailgauge"]
    scratch.clear(spark)
    assert not list(tmp_path.iterdir())


def test_nothing_in_nothing_out(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf)
    assert rows.count() == 0
