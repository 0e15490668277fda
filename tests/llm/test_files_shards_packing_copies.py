import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgauge.llm import exact_dedup, ngram_join, packing, sharding, token_files, wordcoder

ODD = [
    (1, "It's, we'll. I'M x.y, 12,3. 4,"),
    (2, ""),
    (3, None),
    (None, "no id"),
    (4, "ΣΑΣ Σ. á ́b İstanbul \x1cab\x1d c\x85d e f"),
    (5, "<|endoftext|>x <|startoftext|> a<|b"),
    (6, "日本語テスト。 ok é, è. é. f́,"),
    (7, "word " * 9000),
    (7, "word " * 9000),
    (8, "THE the The, the&&& the."),
    (8, None),
    (9, "x <|endoftext|> y<|ENDOFTEXT|> <|STARTOFTEXT|>z <|startoftext| > <|endof text|>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumn("hash", F.lit("x")).withColumn("n_tokens", F.lit(1)).withColumn("part", F.lit(9)).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(wordcoder.default_path())  # as it is, special tokens too
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_cache_gives_the_librarys_ids(spark, sf, library):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t for _, t in ODD]
    code = wordcoder.WordCoder(wordcoder.default_path(), cache_words=50)
    got = []
    for _ in range(2):  # the second time through a cache that started anew
        got = [ids[a:b].tolist() for _, ids, off in code.encode([(t or "").encode() for t in texts]) for a, b in zip(off[:-1], off[1:])]
    assert got == [library(t) for t in texts]


@pytest.mark.parametrize("top", [1, 255, 256, 65_535, 1 << 24, (1 << 32) - 1])
def test_ranks_round_trip(top):
    ranks = np.random.default_rng(1).integers(0, top + 1, 1003, dtype=np.uint32)
    for n in (0, 1, 4, 1003):
        assert (token_files.unpack_ranks(*token_files.pack_ranks(ranks[:n]), n) == ranks[:n]).all()


def test_damaged_segment_is_noticed():
    control, data = token_files.pack_ranks(np.arange(300, dtype=np.uint32))
    with pytest.raises(ValueError, match="damaged"):
        token_files.unpack_ranks(control, data[:-1], 300)


def test_token_files_hold_all_documents_in_order(spark, odd, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART_IDS", 4000)
    token_files.write_token_files(odd, f"{tmp_path}/f")
    got = sorted(token_files.read_token_files(spark, f"{tmp_path}/f", with_ids=True).collect(), key=lambda r: r["start"])
    want = sorted((((-1 if d is None else d), crc(library(t) + [2]), library(t) + [2]) for d, t in ODD), key=lambda w: (w[0], len(w[2])))
    assert [(-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"], r["ids"]) for r in got] == want
    lens = [r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == (np.cumsum(lens) - lens).tolist()
    seen = np.bincount([i for w in want for i in w[2]])
    ranks = {r["id"]: r["rank"] for r in spark.read.parquet(f"{tmp_path}/f/ranks").collect()}
    assert ranks[int(seen.argmax())] == 0


def test_words_of_letters_get_the_librarys_ids_without_its_splitter(library):
    import random

    rng = random.Random(1)
    code = wordcoder.WordCoder(wordcoder.default_path())
    assert code.lean
    signs = "aZéz ßÿ÷×ªº'sIİıKÅ \t\n\u00a0\u2003\u0301<|>019_-ñçœŒ中あ😀ǅﬁ"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3_000)] + ["été ÉTÉ straße l'été", "a<|endoftext|>b"]
    for at, ids, offsets in code.encode([t.encode() for t in texts], 20_000):
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            assert ids[a:b].tolist() == library(texts[at + k])


def test_known_words_are_found_by_their_bytes():
    """Words of 0 to 40 bytes, some apart only in zero bytes at their end, in a table that grows."""
    import random

    import pyarrow as pa

    rng = random.Random(2)
    words = ["", "\0", "a", "a\0", "a\0\0", *("x" * n + end for n in range(20, 27) for end in ("", "\0", "é", "y"))]
    words = list(dict.fromkeys(words + ["".join(rng.choices("abé\0", k=rng.randint(0, 20))) for _ in range(60_000)]))
    table = wordcoder._Words()
    for at in range(0, len(words), 7_000):
        new = pa.array(["skipped", *words[at : at + 7_000]])[1:]
        assert (table.find(new) == -1).all()
        table.add(new, np.random.default_rng(at).permutation(np.arange(at, at + len(new))))
        want = [n for a in range(0, at + len(new), 7_000) for n in np.random.default_rng(a).permutation(np.arange(a, min(a + 7_000, len(words))))]
        assert table.find(pa.array(words[: at + len(new)])).tolist() == want
    assert table.n == len(words) > 30_000
    assert (table.find(pa.array([w + "\0" * 41 for w in words])) == -1).all()
    assert len(table.find(pa.array([], pa.string()))) == 0


def test_words_with_zero_bytes_and_long_words_get_the_librarys_ids(library):
    texts = ["a a\0 a\0\0 \0 \0\0", " ".join("x" * n + end for n in range(20, 27) for end in ("", "\0", "é", "É", "."))]
    code = wordcoder.WordCoder(wordcoder.default_path())
    for _ in range(2):
        (_, ids, offsets), = code.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [library(t) for t in texts]


def test_known_words_cost_less_than_one_python_object_each():
    """op1 was over its CPU seconds: each slice made its distinct words Python strings to look them up."""
    import time

    import pyarrow as pa

    words = pa.array([f"{i * 7919:x}word" for i in range(200_000)])
    table = wordcoder._Words()
    table.add(words, np.arange(len(words)))
    index = dict(zip(words.to_pylist(), range(len(words)), strict=True))

    def seconds(look):
        took = []
        for _ in range(5):
            at = time.process_time()
            look()
            took.append(time.process_time() - at)
        return min(took)

    assert seconds(lambda: table.find(words)) < 0.7 * seconds(lambda: list(map(index.get, words.to_pylist())))


def test_token_files_take_little_text_at_once(spark, library):
    """What a worker has in hand of a large batch: it is encoded 2 MB at a time."""
    import pyarrow as pa

    class Docs:  # hands over the function that workers run
        select = lambda self, *columns: self
        mapInArrow = lambda self, f, schema: f

    texts = [f"word{i % 97} and more, " * 50 * (1 + i % 7) for i in range(2_500)]
    run = token_files.encode_table(Docs(), wordcoder.default_path(), 2, "<u1")
    got = list(run([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]))
    assert sum(map(len, texts)) > 8_000_000
    assert max(sum(len(texts[i]) for i in b.column(0).to_pylist()) for b in got) <= 2_000_000
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(texts)))
    ids = np.concatenate([token_files._flat(b.column(2), b.column(3), "<u1")[0] for b in got])
    assert ids.tolist() == [x for t in texts for x in [*library(t), 2]]


def test_token_files_of_nothing(spark, empty, tmp_path):
    token_files.write_token_files(empty, f"{tmp_path}/f")
    assert token_files.read_token_files(spark, f"{tmp_path}/f").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutation_is_a_bijection(n):
    places = sharding.permute(np.arange(n), n, seed=7)
    assert sorted(places) == list(range(n))
    assert (places == sharding.permute(np.arange(n), n, seed=7)).all()
    if n == 1000:
        assert (places != sharding.permute(np.arange(n), n, seed=8)).any()


def test_shards_are_gapless_and_even(odd, empty):
    rows = sharding.shard_rows(odd, shards=4).collect()
    assert len(rows) == len(ODD)
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in ODD)
    assert sharding.shard_rows(empty).count() == 0


def test_shards_match_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(sharding.places_sql()).fetchall()
    got = sharding.query(spark, sf).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bound_never_exceeds_best_packing():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 21, rng.integers(1, 30)))[::-1]
        bins, offsets, free = packing.best_fit_decreasing(lengths, 20)
        assert packing.lower_bound(lengths, 20) <= len(free)
        for b in range(len(free)):
            own = lengths[bins == b]
            assert own.sum() + free[b] == 20 and (offsets[bins == b] == np.cumsum(own) - own).all()
    assert packing.lower_bound(np.array([11] * 5), 20) == 5
    assert packing.lower_bound(np.array([7] * 5), 20) == 3
    assert packing.lower_bound(np.zeros(0, int), 20) == 0


@pytest.mark.parametrize("part_pieces", [3, 200_000])
def test_packing_holds_every_piece_once(odd, library, part_pieces):
    packed, report = packing.pack(packing.cut_pieces(odd), part_pieces=part_pieces)
    rows = packed.collect()
    want = []
    for d, t in ODD:
        ids = library(t) + [0]
        want += [(d, i, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for i, s in enumerate(range(0, len(ids), 2048))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert report[0]["bins"] >= len(by) >= -(-sum(w[3] for w in want) // 2048)


def test_exchange_of_documents_saves_bins(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(200, 1400, 600))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed, report = packing.pack(pieces, part_pieces=40)
    bins = packed.select("sequence_id").distinct().count()
    assert packed.count() == 600 and bins < report[0]["bins"] and bins <= report[-1]["bound"] + 3


def test_certified_partitions_stay_and_losers_meet_others(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 0, 0, 2048, i) for i in range(40)] + [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(600, 1100, 400), 40)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed, report = packing.pack(pieces, part_pieces=25, most_pieces=60)  # too small for all that has room
    by = {}
    for r in packed.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, by.values())) == 440 and len(by) == report[-1]["bins"] >= report[-1]["bound"]
    assert all(sum(n for _, n in b) <= 2048 and [o for o, _ in sorted(b)] == np.cumsum([0] + [n for _, n in sorted(b)])[:-1].tolist() for b in by.values())
    assert report[0]["gapped"] > 0 and [r["bins"] for r in report] == sorted((r["bins"] for r in report), reverse=True) and report[-1]["bins"] < report[0]["bins"]


class _Worker:
    """Stands for a table and hands over the function that workers run."""

    select = lambda self, *columns: self
    mapInArrow = lambda self, f, schema: f


def test_packing_takes_little_text_at_once(spark, library):
    """What a worker has in hand of a large batch; a text that is longer than that comes alone."""
    import pyarrow as pa

    texts = [f"word{i % 97} and more, " * 50 * (1 + i % 7) for i in range(600)] + ["one long text " * 50_000, None, "end"]
    run = packing.cut_pieces(_Worker())
    got = list(run([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]))
    assert max(sum(len(texts[i] or "") for i in set(b.column(0).to_pylist()) if i != 600) for b in got) <= 500_000
    want = [(i, len(x[s : s + 2048]), crc(x[s : s + 2048])) for i, x in enumerate([*library(t), 0] for t in texts) for s in range(0, len(x), 2048)]
    assert [(r["doc_id"], r["length"], r["ids_crc32"]) for b in got for r in b.to_pylist()] == want


def test_a_worker_gives_back_what_other_stages_left(spark):
    """The words of the n-gram join go when texts are packed, the coder goes when texts are compared; packing gives memory back."""
    import pyarrow as pa

    texts = pa.array(["a b c", "b c d"])
    ngram_join.word_hashes(texts)
    known, coder = ngram_join._hashes(), wordcoder.coder(wordcoder.default_path())
    assert known and ngram_join._hashes() is not known
    assert wordcoder.coder(wordcoder.default_path()) is not coder
    assert wordcoder.coder(wordcoder.default_path()) is wordcoder.coder(wordcoder.default_path())
    given = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("mailgauge.llm.scratch.release", lambda: given.append(1))
        list(packing.cut_pieces(_Worker())([pa.RecordBatch.from_arrays([pa.array([1, 2]), texts], ["doc_id", "text"])]))
    assert given


def test_packing_of_nothing(empty):
    assert packing.pack(packing.cut_pieces(empty))[0].count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit("same")])
def test_copies(odd, keep, content_hash):
    rows = exact_dedup.exact_groups(odd, keep, content_hash=content_hash).collect()
    pick = min if keep == "min" else max
    text_of = {}
    for d, t in ODD:
        text_of.setdefault(t or "", []).append(d)
    import hashlib

    want = []
    for t, ids in text_of.items():
        best = pick([d for d in ids if d is not None], default=None)
        seen = set()
        for d in ids:
            want.append((d, best, len(ids), d == best and d not in seen, hashlib.sha256(t.encode()).hexdigest()))
            seen.add(d)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_copies_of_one_id_are_all_there(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_REPEATS", 7)
    rows = [(None, "x")] * 40 + [(3, "y")] * 20 + [(4, "y")] * 2 + [(3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep, best in (("min", 3), ("max", 4)):
        got = exact_dedup.exact_groups(df, keep).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
        assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted([3, best]) and {r["group_size"] for r in got} == {41, 22}
    assert sorted(r["doc_id"] or -1 for r in exact_dedup.exact_groups(df.where("doc_id is null")).where("kept").collect()) == [-1]


def test_clashing_columns_stay(spark):
    rows = [(1, "a b c d e f", 1, 2, 3.5), (2, "a b c d e f", 4, 5, 6.5), (3, "other", 7, 8, 9.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _sha int, Own_SHA double").withColumnsRenamed({"_id": "kept_id", "_sha": "kept_sha"})
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and sorted(map(tuple, left.collect())) == [rows[0], rows[2]]


def test_one_row_stays_of_each_text(odd, empty):
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    assert left.count() == len({t or "" for _, t in ODD})
    assert exact_dedup.drop_copies(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0
