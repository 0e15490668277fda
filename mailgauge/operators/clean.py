"""From the merged table of classifier answers to the analysis table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgauge.functions.columns import base_id, model_family, stripped, to_boolean, to_integer, to_number

REQUIRED = ("email_id", "parser_id", "model_name", "prompt_id", "status", "parse_ok", "pred_label", "year", "dataset", "obfuscation", "ground_truth")
KEY = ("base_email_id", "model", "prompt", "parser")
REPEATED, BETWEEN = ("model", "prompt", "parser"), ("year_num", "dataset_clean", "obfuscation_clean")
FACTORS = REPEATED + BETWEEN


def require_columns(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def merge_metadata(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """Answers with what is known of their e-mails (one row per base_email_id)."""
    keyed = results.withColumn("base_email_id", base_id(F.col("email_id")))
    return keyed.join(metadata, "base_email_id", "left")


def clean(df: DataFrame) -> DataFrame:
    """Normalised factors, numbers and flags beside the raw columns. One projection over the scan.

    A row counts as parseable if its answer parsed to 0 or 1, as detected end to end if it
    parsed to 1. ``correct_reconstructed`` is null unless answer and truth are 0 or 1.
    """
    require_columns(df, REQUIRED)
    lower, upper = (lambda c: F.lower(stripped(F.col(c)))), (lambda c: F.upper(stripped(F.col(c))))
    first = df.withColumns(
        {
            "base_email_id": base_id(stripped(F.col("email_id"))),
            "model": model_family(stripped(F.col("model_name"))),
            "parser": upper("parser_id"),
            "prompt": lower("prompt_id"),
            "dataset_clean": lower("dataset"),
            "obfuscation_clean": lower("obfuscation"),
            "status_clean": lower("status"),
            "parse_ok_bool": to_boolean(F.col("parse_ok")),
            "pred_label_num": to_number(F.col("pred_label")),
            "ground_truth_num": to_number(F.col("ground_truth")),
            "year_num": to_integer(F.col("year")),
        }
        | ({"fits_bool": to_boolean(F.col("fits"))} if "fits" in df.columns else {})
        | ({f"{c}_num": to_number(F.col(c)) for c in ("input_tokens", "overflow_tokens") if c in df.columns})
        | ({"correct_original_bool": to_boolean(F.col("correct"))} if "correct" in df.columns else {})
    )
    binary = F.col("pred_label_num").isin(0.0, 1.0)
    parseable = F.coalesce(F.col("parse_ok_bool") & binary, F.lit(False))
    return first.withColumns(
        {
            "parseable": parseable,
            "detected_end_to_end": (parseable & (F.col("pred_label_num") == 1)).cast("int"),
            "correct_reconstructed": F.when(binary & F.col("ground_truth_num").isin(0.0, 1.0), (F.col("pred_label_num") == F.col("ground_truth_num")).cast("double")),
        }
    )


def prepare(df: DataFrame) -> DataFrame:
    """The analysis table from either form, with a label per configuration and collection; rows without a factor go."""
    ready = df if {"parseable", "detected_end_to_end", *KEY} <= set(df.columns) else clean(df)
    return ready.withColumn("configuration", F.concat_ws(" | ", "model", "prompt", "parser")).withColumn("collection", F.concat_ws("_", F.col("year_num").cast("string"), "dataset_clean"))


def complete(df: DataFrame) -> DataFrame:
    """Rows with no null in the key, the factors and the outcome."""
    return prepare(df).dropna(subset=[*KEY, *BETWEEN, "detected_end_to_end"])
