from datetime import datetime

import pytest

from mailgauge.operators import hidden, validate
from mailgauge.operators.clean import merge_metadata
from mailgauge.sources import files
from mailgauge.streaming import ingest

MAIL = b"From: a@x.example\r\nContent-Type: text/html\r\n\r\n<body><p style='display:none'>x</p></body>"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/one.eml").write_bytes(MAIL)
    (tmp_path / "in/sub/two.TXT").write_bytes(b"To: b\r\n\r\nhello")
    (tmp_path / "in/skip.pdf").write_bytes(b"x")
    return tmp_path


def test_emails_are_found_below_a_folder(spark, folder):
    got = sorted((r["email_file"], r["email_id"]) for r in files.read_emails(spark, f"{folder}/in").collect())
    assert got == [("one.eml", "one"), ("sub/two.TXT", "two")]
    assert files.read_emails(spark, f"{folder}/in/one.eml").count() == 1
    assert files.read_emails(spark, f"{folder}/in", ("eml",), recursive=False).count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_emails(spark, f"{folder}/nowhere")


def test_text_files_with_broken_bytes(spark, tmp_path):
    (tmp_path / "a_P1.txt").write_bytes(b"ok \xff end")
    rows = files.read_texts(spark, str(tmp_path)).collect()
    assert [(r["email_id"], r["text"]) for r in rows] == [("a_P1", "ok � end")]


def test_jsonl_round_trip_and_history(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "id int, text string")
    copy = files.write_summary(df, f"{tmp_path}/s", datetime(2024, 1, 2, 3, 4, 5))
    assert copy.endswith("run_ts=20240102_030405")
    assert sorted(map(tuple, files.read_jsonl(spark, f"{tmp_path}/s/latest", "id int, text string").collect()), key=str) == [(1, "a\nb"), (2, None)]
    (tmp_path / "bad.jsonl").write_text('{"id": 3}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "id int").collect()
    (tmp_path / "x.jsonl").write_text('\n{"id": 3}\n  \n')
    assert [r["id"] for r in files.read_jsonl(spark, f"{tmp_path}/x.jsonl", "id int").collect()] == [3]


def test_csv_keeps_line_ends_and_checks_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x"\nLABEL: 1', "extra")], "email_id string, raw_output string, other string")
    files.write_csv(df, f"{tmp_path}/c", ["email_id", "raw_output"], single=True)
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c", ["email_id"]).collect()] == [("a", 'say "x"\nLABEL: 1')]
    with pytest.raises(ValueError, match="missing columns: status"):
        files.read_csv(spark, f"{tmp_path}/c", ["status"])


def test_reports_and_copies(spark, folder):
    files.write_text(spark, "käse\n", f"{folder}/r.txt")
    assert (folder / "r.txt").read_text() == "käse\n"
    found = hidden.detected(spark.createDataFrame([(1, "<body>a</body>"), (2, "<body><p style='display:none'>b</p></body>")], "id int, html string"))
    files.write_with_hidden_text(found, f"{folder}/hidden")
    assert [r["id"] for r in spark.read.parquet(f"{folder}/hidden").collect()] == [2]


def test_stream_judges_each_email_once(spark, folder):
    run = lambda: ingest.ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ck").awaitTermination(60)
    run()
    (folder / "in/three.eml").write_bytes(MAIL.replace(b"none", b"block"))
    run()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["file_visible"]) for r in rows) == [("one.eml", False), ("three.eml", True)]


def test_metadata_join_keeps_all_answers(spark):
    results = spark.createDataFrame([("a_P1", "x"), ("b_P2", "y")], "email_id string, raw string")
    meta = spark.createDataFrame([("a", 2023)], "base_email_id string, year int")
    assert sorted((r["email_id"], r["year"]) for r in merge_metadata(results, meta).collect()) == [("a_P1", 2023), ("b_P2", None)]


def test_checks_on_an_empty_table(spark):
    none = spark.createDataFrame([], "base_email_id string, model string, prompt string, parser string, year_num int")
    assert validate.exact_duplicates(none).first()[0] == 0
    assert validate.rows_per_email(none).count() == validate.missing_cells(none).count() == validate.duplicate_cells(none).count() == 0
    assert not validate.fully_crossed(none, "year_num", "model").first()["fully_crossed"]
