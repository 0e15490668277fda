"""Data-quality checks of the experiment table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgauge.operators.clean import KEY, REPEATED


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier one in every column."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_cells(df: DataFrame) -> DataFrame:
    """All rows of cells (e-mail, model, prompt, parser) that have several."""
    return df.withColumn("cell_rows", F.count("*").over(Window.partitionBy(*KEY))).where("cell_rows > 1")


def expected_rows(df: DataFrame) -> DataFrame:
    """One row: how many cells a complete e-mail has."""
    product = F.countDistinct(REPEATED[0])
    for c in REPEATED[1:]:
        product = product * F.countDistinct(c)
    return df.agg(product.alias("expected_rows"))


def rows_per_email(df: DataFrame) -> DataFrame:
    counts = df.groupBy("base_email_id").agg(F.count("*").alias("n_rows"))
    return counts.crossJoin(F.broadcast(expected_rows(df))).withColumn("complete", F.col("n_rows") == F.col("expected_rows"))


def rows_distribution(df: DataFrame) -> DataFrame:
    return rows_per_email(df).groupBy("n_rows").agg(F.count("*").alias("n_emails"))


def missing_cells(df: DataFrame) -> DataFrame:
    """Cells that an incomplete e-mail lacks, of the levels seen anywhere."""
    grid = rows_per_email(df).where("not complete").select("base_email_id")
    for c in REPEATED:  # a few levels each
        grid = grid.crossJoin(F.broadcast(df.select(c).distinct().where(F.col(c).isNotNull())))
    return grid.join(df.select(*KEY).distinct(), list(KEY), "left_anti")


def metadata_inconsistencies(df: DataFrame, columns=("year_num", "dataset_clean", "obfuscation_clean", "ground_truth_num"), order: str = "row_id") -> DataFrame:
    """E-mails whose metadata differ between rows (null is a value), with the values in order of first appearance."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")) for c in columns)))
    seen = df.select("base_email_id", order, values.alias("v")).groupBy("base_email_id", "v.field", "v.value").agg(F.min(order).alias("first_row"))
    grouped = seen.groupBy("base_email_id", "field").agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(F.struct("first_row", "value"))).alias("values"))
    return grouped.where("n_values > 1").select("base_email_id", "field", "n_values", F.array_join(F.col("values.value"), " | ").alias("found"))


def first_per_email(df: DataFrame, order: str = "row_id") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("base_email_id").orderBy(order))).where("_n = 1").drop("_n")


def crosstab(df: DataFrame, rows: str, columns: str, levels: list[str], rows_first: str = "All") -> DataFrame:
    """Counts of rows by columns with margins ``All``; null levels are shown as ``NA``."""
    label = lambda c, bit: F.when(F.grouping(c) == 1, "All").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("NA"))).alias(f"{c}_level")
    cells = df.cube(rows, columns).agg(F.count("*").alias("n"), label(rows, 1), label(columns, 0))
    wide = cells.groupBy(F.col(f"{rows}_level").alias(rows)).pivot(f"{columns}_level", [*levels, "All"]).agg(F.sum("n"))
    return wide.na.fill(0)


def fully_crossed(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: whether both factors have several levels and no combination is empty."""
    one = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.countDistinct(a).alias("levels_a"), F.countDistinct(b).alias("levels_b"), F.countDistinct(a, b).alias("cells"))
    return one.withColumn("fully_crossed", (F.col("levels_a") > 1) & (F.col("levels_b") > 1) & (F.col("cells") == F.col("levels_a") * F.col("levels_b")))


def failure_counters(df: DataFrame) -> DataFrame:
    """One row of counts of what went wrong, and whether every ground truth is positive."""
    count = lambda c, name: F.count_if(c).alias(name)
    return df.agg(
        F.count("*").alias("n_rows"),
        count(F.col("pred_label_num").isNull(), "missing_label"),
        count(~F.col("status_clean").eqNullSafe("ok"), "status_not_ok"),
        count(F.col("parse_ok_bool") == F.lit(False), "parse_failed"),
        count(F.col("parse_ok_bool").isNull(), "parse_unknown"),
        count(~F.col("parseable"), "unparseable"),
        count(F.col("fits_bool") == F.lit(False), "over_context"),
        count(F.col("overflow_tokens_num") > 0, "overflowing"),
        F.coalesce(F.bool_and(F.coalesce(F.col("ground_truth_num") == 1, F.lit(False))), F.lit(False)).alias("all_positive"),
    )


def correctness_mismatch(df: DataFrame) -> DataFrame:
    """Rows whose stored correctness is not what answer and truth give."""
    return df.where(F.col("correct_original_bool").cast("double") != F.col("correct_reconstructed"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def sample_rows(df: DataFrame, n: int = 50, order=("base_email_id", "model", "prompt", "parser")) -> DataFrame:
    return df.orderBy(*order).limit(n)


def validation_report(df: DataFrame) -> str:
    """A short text with the main findings, for small results only."""
    counters = failure_counters(df).first().asDict()
    lines = [f"rows: {counters.pop('n_rows')}", f"exact duplicates: {exact_duplicates(df).first()[0]}", f"rows in duplicate cells: {duplicate_cells(df).count()}"]
    lines += [f"incomplete e-mails: {rows_per_email(df).where('not complete').count()}", f"missing cells: {missing_cells(df).count()}"]
    return "\n".join(chain(lines, (f"{k}: {v}" for k, v in counters.items()))) + "\n"
