import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgauge.llm import pieces, pii, secrets, toxicity


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def base_pii(t):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(only(m.group())) <= 19 and luhn(only(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(only(m.group())) <= 15]
    return out


def base_secrets(t):
    key = r"(?i:password|passwd|secret|token|api_?key)"
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def fuzz(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


PII = [
    "a@b.c%d@e.f x@y a@b@c.d.e.", "é😀 me.you+x@mail-1.example.com, 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.255",
    "4111 1111 1111 1111 4111-1111-1111-1112 +1 (743) 555-3824 +49 30 12345678 +1", "1" * 3000 + ".2.3.4", "x" * 5000 + "@", "+" + "1 " * 2000,
    "a@b" + ".c" * 6000, "call me: 555-867-5309 now", "order 555-867-5309 now", "", " ".join(["10.0.0.1"] * 700),
]
SECRETS = [
    "password=token : abcdefgh", 'API_KEY = "abcdef12"', "PassWd:'x' token=abcde secret==abcdef", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 12 + "é", "a" * 23 + " " + "0a" * 12 + "g" + "f" * 24,
    "token = " + " " * 3000 + "abcdef", "ſecret=abcdefg toKen=abcdefg", "", "token" * 2000, "😀 secret: deadbeefdeadbeefdeadbeef01",
]


def test_personal_data_matches_brute_force(spark):
    parts = ["@", ".", "a", "b-", "1", "12", "255", "256", "+", " ", "(", ")", "é", "😀", "%", "4111111111111111"]
    texts = PII + fuzz(parts, 300, 1)
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("found", F.lit(2))
    rows = pii.find(df, pii.train(spark)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else ""
        want = base_pii(text)
        assert [tuple(s) for s in r["base"]] == want, text
        spans = sorted((s["start"], s["end"]) for s in [*r["extra"]])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert not any(s["start"] < e and b < s["end"] for s in r["extra"] for _, b, e in want)
    by = {r["doc_id"]: [s["kind"] for s in r["extra"]] for r in rows}
    assert "phone_local" in by[texts.index("call me: 555-867-5309 now")]
    assert by[texts.index("order 555-867-5309 now")] == []


def test_redaction_leaves_no_base_match(spark):
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(PII)], "doc_id long, text string, n_chars long")
    rows = pii.redact(df, pii.train(spark)).orderBy("doc_id").collect()
    for r, before in zip(rows, PII):
        assert base_pii(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if not base_pii(before) and "call" not in before:
            assert r["text"] == before
    assert pii.redact(df.limit(0), pii.train(spark)).count() == 0


def test_redaction_is_what_find_selects(spark):
    parts = ["@", ".", "a", "12", "255", "+", " ", "(", ")", "é", "😀", "4111111111111111", "call 555-867-5309 ", "ssn 123-45-6789 ", "+49 30 1234567 10.0.0.1"]
    texts = PII + fuzz(parts, 200, 4) + [None, " ".join(["a@b.c 10.0.0.1 é"] * 900)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, "x")], "doc_id long, text string, found int, Selected_Spans string")
    trees = pii.train(spark)
    spans = {r["doc_id"]: [tuple(s) for s in r["base"] + r["extra"]] for r in pii.find(df, trees).collect()}
    left = pii.redact(df, trees)
    assert left.columns == df.columns and left.count() == len(texts) + 1
    for r in left.collect():
        out, at, text = "", 0, texts[r["doc_id"]]
        for kind, a, b in sorted(spans[r["doc_id"]], key=lambda s: (s[1], s[2], s[0])):
            if b > at:
                out, at = out + text[at:a] + (f"[{kind.upper()}]" if a >= at else ""), b
        assert r["text"] == (None if text is None else out + text[at:])


def test_thresholds_in_document_text(spark, sf):
    trees = pii.train(spark, pii.contexts_of(spark.read.parquet(f"{sf}/documents.parquet")))
    found, left = (np.array([v[k] for v in trees.report.values()]) for k in (0, 1))
    assert left.min() >= 0.98 and found.mean() > 0.3
    prose = spark.createDataFrame([(0, "In anning attion from at and. Of the heat, onea at once. Not at home."), (1, "write to ann at mail dot org please")], "doc_id long, text string")
    assert {r["doc_id"]: [s["kind"] for s in r["extra"]] for r in pii.find(prose, trees).collect()} == {0: [], 1: ["email_spelled"]}


def test_personal_data_plan_has_no_python(spark, sf):
    plan = pii.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_trees_tell_examples_apart():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    base, trees = pii.boost(x, y, rounds=60)

    def score(row):
        total = base
        for t in trees:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            total += t
        return total

    assert np.mean([(score(r) > 0) == v for r, v in zip(x, y)]) > 0.95


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_secrets_match_brute_force_and_sql(spark, tmp_path):
    import duckdb

    texts = SECRETS + fuzz(["token", "=", " ", '"', "AKIA", "ABCDEFGHIJKLMNOPQR", "0123456789abcdef", "a", "é", ":", "secret", "😀"], 300, 2)
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").withColumn("blob", F.lit(1))
    secrets.scan(df, f"{tmp_path}/ledger")
    rows = secrets.findings(df, f"{tmp_path}/ledger").collect()
    assert len(rows) == len(texts) + 1
    got = {}
    for r in rows:
        if r["doc_id"] is not None:
            base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in secrets.BASE]
            assert base == base_secrets(texts[r["doc_id"]]), texts[r["doc_id"]]
            got[r["doc_id"]] = listed((s["kind"], s["start"], s["end"]) for s in r["spans"])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert {d: s for d, *_, s in con.execute(secrets.oracle()).fetchall()} == got


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    from dataclasses import replace

    at = f"{tmp_path}/ledger"
    first = spark.createDataFrame([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, "x")], "doc_id long, text string")
    more = spark.createDataFrame([(4, "token=abcdef1"), (5, "secret: abcdefg")], "doc_id long, text string")
    n = len(secrets.RULES)
    assert secrets.scan(first, at) == 2 * n
    assert secrets.scan(first, at) == 0
    assert secrets.scan(first.unionByName(more), at) == n
    newer = (replace(secrets.RULES[0], version=2), *secrets.RULES[1:])
    assert secrets.scan(first.unionByName(more), at, newer) == 3
    found = {r["doc_id"]: len(r["spans"]) for r in secrets.findings(first.unionByName(more), at, newer).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 1, 5: 1}
    assert secrets.scan(first.limit(0), f"{tmp_path}/none") == 0
    assert secrets.findings(first.limit(0), f"{tmp_path}/none").count() == 0


def test_secrets_plan_has_no_python(spark, sf):
    plan = secrets.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


TEXTS = ["", None, " ", "  Hello  world\n\tfoo ▁x 日本語テ😀", "a\0b  \0", "    x", "1 22  333 4", " \n \n", "ends  ", "▁▁▁▁▁", "aaaa" * 50, "=====----- ***", "́é", "   \t  1", "\x1c\x85\xa0 x", "word " * 4000]


def test_pieces_are_the_librarys(spark, sf):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    texts = TEXTS + [" " * n + "1" for n in range(20)] + ["x" + " " * n for n in range(20)] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([*enumerate(texts), (None, "no id")], "doc_id long, text string").withColumn("ids", F.lit("x"))
    encoded = pieces.encode_table(df)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert got[i] == lib.encode(t or "")
    back = {r["doc_id"]: r["text"] for r in pieces.decode_table(encoded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.encode_table(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [200, 3, 999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    want = {r: lib.decode(i or []) for r, i in ((1, [200, 3, 999]), (2, None), (3, []))}
    assert {r["doc_id"]: r["text"] for r in pieces.decode_table(odd).collect()} == want


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in toxicity.query(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(rows[d]["score"], y) for d, y in labels.items() if rows[d]["held_out"]]
    s, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    # Measured for dictionaries trained by zstandard on 216 toxic texts: 0.85, 0.81 and 0.53 (README has larger tables).
    assert auc > 0.8
    chosen = s >= 0.3
    assert (y[chosen] == 1).mean() > 0.7 and chosen[y == 1].mean() > 0.45


def test_toxicity_windows_cover_every_word():
    texts = [toxicity._plain(t) for t in (b"", b"one", b"a b c d e f g", b"  x1y  " * 30, b"...")]
    buffer, segments, counts = toxicity._windows(texts)
    at = 0
    for t, n in zip(texts, counts):
        own = [buffer[o : o + size] for o, size in segments[at : at + n].astype(int)]
        at += n
        words = t.split()
        assert {w for x in own for w in x.split()} == set(words)
        assert all(len(x.split()) <= toxicity.WINDOW for x in own) and (n > 0) == bool(words)


def test_toxicity_by_plain_compression():
    """Scores again, one window at a time with a compressor of its own for each."""
    import zstandard as zstd

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    usual = [word() for _ in range(300)]
    texts, labels = [], []
    for i in range(240):
        own = [rng.choice(usual) for _ in range(rng.randint(10, 120))]
        if i % 4 == 0:
            for _ in range(4):
                own[rng.randrange(len(own))] = rng.choice(["numbskull", "blockheaded", "nitwittery"])
        texts.append(" ".join(own).encode())
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels, 0.25)
    assert any(w in model.toxic and w not in model.plain for w in (b"numbskull", b"blockheaded", b"nitwittery")) and len(model.toxic) == len(model.plain)

    def size(window, content):
        kinds = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0, "format": zstd.FORMAT_ZSTD1_MAGICLESS, "min_match": 3, "source_size": 64}
        params = zstd.ZstdCompressionParameters.from_level(toxicity.LEVEL, dict_size=len(content), **kinds)
        return len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params).compress(window))

    for text in (texts[0], texts[1], b"", b"numbskull", b"X1 y2! " * 30):
        words = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower()).split()
        windows = [b" " + b" ".join(words[i : i + 6]) + b" " for i in range(0, max(len(words) - 6, 0) + 3, 3) if words and (i == 0 or i < len(words) - 3)]
        gains = np.array([size(w, model.plain) - size(w, model.toxic) for w in windows], float)
        n = max(len(gains), 1)
        x = [np.log(n), gains.sum() / n, float((gains <= -2).any()), np.sqrt((gains <= -2).sum() / n)]
        for least in range(1, toxicity.SHARPNESS + 1):
            hits = (gains >= least).sum()
            x += [np.log1p(hits), np.sqrt(hits / n), float(hits > 0)]
        z = model.weights[0] + ((np.array(x) - model.mean) / model.scale) @ np.array(model.weights[1:])
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)
    s = model.scores(texts)
    assert s[np.array(labels) == 1].mean() > 0.8 and s[np.array(labels) == 0].mean() < 0.1


def _prose(rng, syllables, n):
    return ["".join(rng.choices(syllables, weights=range(len(syllables), 0, -1), k=rng.randint(1, 4))) for _ in range(n)]


def test_toxicity_of_rare_short_words_and_stems():
    """Two languages of syllables; insults are short words in the larger and words of one stem in the smaller, few to a text."""
    rng = random.Random(5)
    tongues = [[a + b for a in "bdfgklmn" for b in ("a", "en", "i")], [a + b for a in "prstvwz" for b in ("o", "u", "ei")]]

    def texts(n):
        for i in range(n):
            tongue, toxic = int(rng.random() < 0.2), i % 5 == 0
            own = _prose(rng, tongues[tongue], rng.randint(150, 400))
            for _ in range(3 * toxic):
                own[rng.randrange(len(own))] = rng.choice(["yuck", "jerk"]) if tongue == 0 else "xaqo" + rng.choice(tongues[1])
            yield " ".join(own).encode(), int(toxic), tongue

    train, held = list(texts(1200)), list(texts(600))
    model = toxicity.train([t[0] for t in train], [t[1] for t in train], 0.2)
    found = model.scores([t[0] for t in held]) >= 0.3
    toxic, tongue = np.array([t[1] for t in held]) == 1, np.array([t[2] for t in held])
    for k in (0, 1):
        assert found[toxic & (tongue == k)].mean() > 0.9 and found[~toxic & (tongue == k)].mean() < 0.05


def test_toxicity_dictionaries_have_the_size_asked_for():
    """zstandard's training ends early where ten stretches in a row bring nothing new, as in a long text of one line again and again."""
    rng = random.Random(6)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "en", "i", "o")]
    lines = [" ".join(_prose(rng, syllables, 40)).encode() for _ in range(10_000)]
    lines[2_000:2_000] = [b"the same line again and again " * 8] * 1_000
    assert len(toxicity._dictionary(lines, 110_000)) == 110_000
    assert toxicity._dictionary([], 1_000) == b"" and toxicity._dictionary([b"one", b"two"], 5) == b"e two"


def test_toxicity_own_words_are_those_that_tell_a_class():
    rng = random.Random(7)
    names = [b"w" + bytes([c]) * 5 for c in b"abcdefghijklmnop"]
    ordinary = [b" " + b" ".join(rng.choices(names, k=12)) + b" " for i in range(50)]
    toxic = [b" " + b" ".join([*rng.choices(names, k=6), b"scoundrel", *rng.choices(names, k=6), bytes(rng.choices(b"qxyz", k=9))]) + b" " for i in range(20)]
    a, b = toxicity._counts(toxic), toxicity._counts(ordinary)
    assert set(toxicity._own_words([*toxic, b" ", b" bbb "], toxicity._telling(a, 20, b, 50))) == {b" scoundrel "}
    assert not toxicity._telling(a, 20, a, 20).any() and not toxicity._telling(a, 20, np.zeros_like(a), 0).any()
    assert toxicity._own_words([b" scoundrel x y  ", b" a"], np.ones(1 << toxicity.SLOT_BITS, bool)) == [b" scoundrel x y "]


def test_toxicity_of_long_and_repeated_rows_and_clashing_columns(spark):
    model = toxicity.Model(b"vile words " * 9, b"mild words " * 9, [0.0] * 25, [1.0] * 25, [0.0] * 26, 0.5)
    df = spark.createDataFrame([(1, "a b c " * 200_000, 1.0), (1, "a b c", 2.0), (1, "a b c", 2.0), (None, None, None)], "doc_id long, text string, Score double")
    with pytest.raises(ValueError):
        toxicity.score(df, model)
    rows = toxicity.score(df, model, "p").collect()
    assert [r["p"] for r in rows] == [0.5] * 4 and [r["Score"] for r in rows] == [1.0, 2.0, 2.0, None]


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, share: seen.append((texts, labels, share)))
    docs = spark.createDataFrame([(i, "x" * (100 if i == 3 else 10)) for i in range(20)] + [(4, "y" * 10), (5, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    toxicity.fit(docs, marks, lambda c: F.lit(True), toxic_bytes=45, plain_bytes=1000)
    texts, labels, share = seen[0]
    assert labels.count(1) == 4 and labels.count(0) == 10 and share == 0.5 and b"x" * 100 not in texts


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id long, text string").withColumn("words", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none, lambda c: F.lit(True))
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == [0.0] * 3
    assert toxicity.score(docs.limit(0), model).count() == 0
    few = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, toxicity.fit(docs, few, lambda c: F.lit(True))).collect())


def test_digest_of_no_spans(spark, sf):
    rows = pii.query(spark, sf).where("spans = ''").limit(1).collect()
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
