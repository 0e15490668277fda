"""Readers and writers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailgauge.operators.clean import require_columns
from mailgauge.session import saved


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def require(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"required input does not exist: {path}")
    return path


def read_emails(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("eml", "txt"), recursive: bool = True) -> DataFrame:
    """Raw e-mails below a folder (or one file): email_file (path below the root), email_id (its stem), content."""
    require(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    files = files.where(F.lower("path").rlike(rf"\.(?:{'|'.join(suffixes)})$"))
    if root.lower().endswith(tuple(f".{s}" for s in suffixes)):
        name = F.element_at(F.split("path", "/"), -1)
    elif "." in root.rstrip("/").rsplit("/", 1)[-1] and not recursive:
        raise ValueError(f"not an e-mail file: {root}")
    else:
        base = root.rstrip("/").split("://", 1)[-1]
        name = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})") if base else F.col("path")
    return files.select(name.alias("email_file"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("email_id"), "content")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of a folder as (email_id, text); bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(require(spark, folder))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    return files.select(name.alias("email_id"), F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one ends the job."""
    lines = spark.read.text(require(spark, path)).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_summary(df: DataFrame, root: str, now: datetime | None = None) -> str:
    """The latest summary (replaced) and a copy under its time; returns the copy's path."""
    history = f"{root}/history/run_ts={now or datetime.now():%Y%m%d_%H%M%S}"
    own = saved(df, "summary")  # made once, written twice
    write_jsonl(own, f"{root}/latest")
    write_jsonl(own, history)
    return history


def read_csv(spark: SparkSession, path: str, required=()) -> DataFrame:
    """All columns as strings, quoted line ends kept; fails if a required column is missing."""
    out = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(require(spark, path))
    require_columns(out, required)
    return out


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """Chosen columns as CSV; ``single`` writes small tables as one file."""
    out = df.select(*columns) if columns else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def unprocessed(files: DataFrame, log: DataFrame, key: str = "path") -> DataFrame:
    """Files that no line of a log (first tab field) names."""
    done = log.select(F.split("value", "\t")[0].alias(key)).where(f"{key} <> ''").distinct()
    return files.join(done, key, "left_anti")


def write_with_hidden_text(found: DataFrame, path: str) -> None:
    """Copies of the documents that have text which is not seen."""
    found.where(~F.col("file_visible")).write.mode("overwrite").parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small report as one file, through Hadoop's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
