"""The experiment table: classifier answers of a full factorial over labelled documents.

The factors and answers are set by integer arithmetic on document ids, so every engine
makes the same table. Everything is a string, as in a merged CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.operators.registry import CONTEXT_MARGIN, models, prompts
from mailgauge.session import load

MAX_CHARS = 12_000
ANSWERS = ["LABEL: {}", "{}", "LABEL: <{}>", "classification - {}", "\n{}", "Label = {}", "cannot tell"]


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled document, with the factors that hold for a whole e-mail."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "quality",
        "n_chars",
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("base_email_id"),
        F.when(F.col("doc_id") % 2 == 0, "2023").otherwise("2025").alias("year"),
        F.when(F.col("lang") == "en", "Set_A").otherwise("set_b ").alias("dataset"),
        F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("obfuscation"),
        F.lit("1").alias("ground_truth"),
    )


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = emails(spark, sf_dir).crossJoin(F.broadcast(models(spark))).crossJoin(F.broadcast(prompts(spark))).crossJoin(F.broadcast(spark.createDataFrame([(0, "P1"), (1, "P2")], "qi int, parser_id string")))
    mi, pi, qi = F.col("mi"), F.col("pi"), F.col("qi")
    score = (F.col("doc_id") * 31 + mi * 17 + pi * 11 + qi * 7 + F.col("quality") * 5) % 100
    limit = F.lit(90) - 15 * mi - 8 * pi - 6 * qi - F.when(F.col("year") == "2025", 10).otherwise(0) - 12 * mi * pi
    label = F.when(score < limit, "1").otherwise("0")
    ran = F.col("n_chars") <= MAX_CHARS
    said = F.col("doc_id") % len(ANSWERS)
    raw = F.lit(ANSWERS[-1])
    for k, text in list(enumerate(ANSWERS))[:-1]:
        before, after = text.split("{}")
        raw = F.when(said == k, F.concat(F.lit(before), label, F.lit(after))).otherwise(raw)
    parsed = ran & (said != len(ANSWERS) - 1)
    tokens = F.floor(F.col("n_chars") / 4).cast("int") + CONTEXT_MARGIN
    over = F.greatest(F.lit(0), tokens - (MAX_CHARS // 4 + CONTEXT_MARGIN))
    return grid.select(
        F.concat("base_email_id", F.lit("_"), "parser_id").alias("email_id"),
        "parser_id",
        "model_name",
        "prompt_id",
        "context_limit",
        tokens.cast("string").alias("input_tokens"),
        over.cast("string").alias("overflow_tokens"),
        F.when(over == 0, "True").otherwise("False").alias("fits"),
        F.when(ran, "ok").otherwise("skipped_over_context").alias("status"),
        F.when(parsed, "True").otherwise("False").alias("parse_ok"),
        F.when(ran, raw).otherwise("").alias("raw_output"),
        F.when(parsed, F.concat(label, F.lit(".0"))).otherwise("").alias("pred_label"),
        "year",
        "dataset",
        "obfuscation",
        "ground_truth",
        F.when(parsed, F.when(label == F.col("ground_truth"), "True").otherwise("False")).otherwise("").alias("correct"),
    )


def lineitem_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger factorial: order lines as observations of orders."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("cluster"), "l_returnflag", "l_linestatus", "o_orderpriority", "o_orderstatus", (F.col("l_discount") > 0.05).cast("int").alias("outcome")
    )
