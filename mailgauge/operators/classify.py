"""E-mails through prompts, models and a scorer to answer rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.functions.columns import parsed_label
from mailgauge.operators.registry import CONTEXT_MARGIN, MODELS, PROMPTS, SCORERS, models, prompt_column, prompts
from mailgauge.sources.files import is_folder, read_texts, write_csv

ANSWER_COLUMNS = ("email_id", "parser_id", "model_name", "prompt_id", "context_limit", "input_tokens", "overflow_tokens", "fits", "status", "raw_output", "parse_ok", "pred_label")


def token_count(c: Column) -> Column:
    """Blank-separated words and the template's tokens: what a scorer without a tokenizer counts."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.size(words) + CONTEXT_MARGIN


def expanded(emails: DataFrame, model_names: list[str] | None = None, prompt_ids: list[str] | None = None) -> DataFrame:
    """(email_id, parser_id, text) times prompts times models, with the full prompt."""
    spark = emails.sparkSession
    m, p = models(spark), prompts(spark)
    m = m.where(F.col("model_name").isin(model_names)) if model_names else m
    p = p.where(F.col("prompt_id").isin(prompt_ids)) if prompt_ids else p
    return emails.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(p)).withColumn("prompt", prompt_column(F.col("template"), F.col("text")))


def with_context(rows: DataFrame, max_new_tokens: int = 256, prompt: str = "prompt") -> DataFrame:
    """Token accounting: total is input and new tokens, overflow what exceeds the model's window."""
    tokens = token_count(F.col(prompt))
    over = F.greatest(F.lit(0), tokens + max_new_tokens - F.col("context_limit"))
    return rows.withColumns({"input_tokens": tokens, "total_tokens": tokens + max_new_tokens, "overflow_tokens": over, "fits": over == 0})


def answers(rows: DataFrame, scorer: str = "keywords") -> DataFrame:
    """Rows with ``raw_output`` and ``error_type``; the scorer is loaded once per task."""
    kind = SCORERS[scorer]

    @F.pandas_udf("struct<raw_output:string,error_type:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = kind()
        own.load()
        for prompts_ in batches:
            out = []
            for prompt in prompts_:
                try:
                    out.append((own.generate(prompt), None))
                except Exception as e:  # a failed generation is a result: its type becomes the status
                    out.append((None, type(e).__name__))
            yield pd.DataFrame(out, columns=["raw_output", "error_type"])

    return rows.withColumn("a", run("prompt")).select("*", "a.raw_output", "a.error_type").drop("a")


def status(fits: Column, error: Column, ran: Column) -> Column:
    tail = F.when(fits, "").otherwise("_over_context")
    return F.when(~ran, "skipped_over_context").when(error.isNull(), F.concat(F.lit("ok"), tail)).otherwise(F.concat(F.lit("generation_error"), tail, F.lit(":"), error))


def run_models(emails: DataFrame, scorer: str = "keywords", max_new_tokens: int = 256, allow_over_context: bool = False, model_names: list[str] | None = None, prompt_ids: list[str] | None = None) -> DataFrame:
    """Answer rows of all e-mails, prompts and models. Rows that do not fit are not scored unless allowed."""
    rows = with_context(expanded(emails, model_names, prompt_ids), max_new_tokens)
    runs = F.col("fits") | F.lit(allow_over_context)
    scored = answers(rows.where(runs), scorer)
    skipped = rows.where(~runs).withColumns({"raw_output": F.lit(None).cast("string"), "error_type": F.lit(None).cast("string")})
    both = scored.withColumn("ran", F.lit(True)).unionByName(skipped.withColumn("ran", F.lit(False)))
    label = parsed_label(F.col("raw_output"))
    out = both.withColumns({"status": status(F.col("fits"), F.col("error_type"), F.col("ran")), "pred_label": label, "parse_ok": label.isNotNull()})
    return out.withColumn("raw_output", F.coalesce("raw_output", F.lit(""))).select(*ANSWER_COLUMNS)


def check_run(spark: SparkSession, parsed_root: str, parser_ids: list[str], model_name: str, prompt_ids: list[str]) -> None:
    """Raise ValueError for a model or prompt that is not registered, or a parser folder that is not there."""
    unknown = {"model": sorted({model_name} - set(MODELS)), "prompt": sorted(set(prompt_ids) - set(PROMPTS))}
    for what, (wrong, known) in {"model": (unknown["model"], MODELS), "prompt": (unknown["prompt"], PROMPTS)}.items():
        if wrong:
            raise ValueError(f"unknown {what}: {', '.join(wrong)}; known: {', '.join(sorted(known))}")
    absent = [folder for folder in (parsed_root, *(f"{parsed_root}/{p}" for p in parser_ids)) if not is_folder(spark, folder)]
    if absent:
        raise ValueError(f"not a folder: {', '.join(absent)}")


def run_folder(spark: SparkSession, parsed_root: str, parser_ids: list[str], model_name: str, prompt_ids: list[str], results: str, **how) -> str:
    """Answers of one model to all text files of the parsers' folders, written as CSV below ``results``; returns the path. ``how``: see ``run_models``."""
    check_run(spark, parsed_root, parser_ids, model_name, prompt_ids)
    emails = reduce(DataFrame.unionByName, (read_texts(spark, f"{parsed_root}/{p}").withColumn("parser_id", F.lit(p)) for p in parser_ids))
    path = f"{results}/{output_name(parsed_root.rstrip('/').rsplit('/', 1)[-1], model_name)}"
    write_csv(run_models(emails, model_names=[model_name], prompt_ids=prompt_ids, **how), path)
    return path


def output_name(input_name: str, model_name: str) -> str:
    """The answer file's name for a folder of parsed e-mails."""
    return f"{input_name.removesuffix('_POut')}_LLMOut_{'llama' if 'Llama' in model_name else 'qwen'}.csv"
