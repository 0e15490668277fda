"""Report-ready tables and their text, CSV and LaTeX forms.

Everything here works on small aggregates: rendering collects tables whose rows are levels,
configurations or model terms.
"""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgauge.operators.clean import FACTORS
from mailgauge.sources.files import write_text

# How factors, levels and terms read in tables.
FACTOR_NAMES = dict(zip(FACTORS, ("Model", "Prompt", "Parser", "Collection year", "Dataset", "Obfuscation"), strict=True))
LEVEL_NAMES = {"evidence": "Evidence", "guided": "Guided", "label": "Label", "nazario": "Nazario", "spam_archive": "SpamArchive", "no": "No", "yes": "Yes"}
TERM_NAMES = (
    (r"^Intercept$", "Intercept"), (r"^C\(model.*\[T\.(.+)\]$", "$1"), (r"^C\(prompt.*\[T\.guided\]$", "Guided prompt"), (r"^C\(prompt.*\[T\.label\]$", "Label prompt"),
    (r"^C\(parser.*\[T\.(.+)\]$", "Parser $1"), (r"^C\(year_num.*\[T\.(.+)\]$", "Collection year $1"), (r"^C\(dataset_clean.*\[T\.spam_archive\]$", "SpamArchive"), (r"^C\(dataset_clean.*\[T\.(.+)\]$", "Dataset $1"),
    (r"^C\(obfuscation_clean.*\[T\.yes\]$", "Obfuscated email"), (r"^C\(\w+.*\[T\.(.+)\]$", "$1"),
)


def _level(c: Column) -> Column:
    return reduce(lambda out, kv: out.when(c == kv[0], kv[1]), LEVEL_NAMES.items(), F.when(c.isNull(), c)).otherwise(c)


def format_p(p: Column) -> Column:
    return F.when(p.isNull(), "").when(p < 0.001, "$<0.001$").otherwise(F.format_string("%.3f", p))


def format_odds(x: Column) -> Column:
    return F.when(x.isNull(), "").otherwise(F.format_string("%.2f", x))


def format_interval(low: Column, high: Column) -> Column:
    return F.concat(F.format_string("%.2f", low), F.lit("--"), F.format_string("%.2f", high))


def overall_recall(summary: DataFrame) -> DataFrame:
    parts = []
    for k, f in enumerate(FACTORS):
        own = summary.where(F.col("factor_set") == f)
        parts.append(own.select(F.lit(k).alias("position"), F.lit(FACTOR_NAMES[f]).alias("Factor"), _level(F.col(f)).alias("Level"), F.bround(F.col("recall") * 100, 2).alias("Recall (%)"), F.col("successes").alias("Successes"), F.col("observations").alias("Observations")))
    return reduce(DataFrame.unionByName, parts)


def pivot_recall(summary: DataFrame, rows: str, columns: str, levels: list[str]) -> DataFrame:
    """Recall in percent (two decimals, half to even) of rows by columns."""
    name = "*".join(f for f in FACTORS if f in (rows, columns))
    own = summary.where(F.col("factor_set") == name)
    return own.groupBy(F.col(rows).alias("row_level")).pivot(columns, levels).agg(F.bround(F.first("recall_pct"), 2))


def condition_table(summary: DataFrame, rows: str, columns: str, levels: list[str], minus: tuple[str, str] | None = None) -> DataFrame:
    """``pivot_recall`` with the difference of two rounded columns."""
    out = pivot_recall(summary, rows, columns, levels)
    return out.withColumn("difference", F.bround(F.col(f"`{minus[0]}`") - F.col(f"`{minus[1]}`"), 2)) if minus else out


def ranking_table(ranking: DataFrame) -> DataFrame:
    return ranking.select(F.col("observed_rank").alias("Rank"), F.col("model").alias("Model"), F.initcap("prompt").alias("Prompt"), F.col("parser").alias("Parser"), F.col("successes").alias("Successes"), F.col("observations").alias("Observations"), F.bround("recall_pct", 2).alias("Recall (%)"))


def clean_term(term: Column) -> Column:
    """Readable model terms; the parts of an interaction are joined by a cross."""

    def one(part: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, name in reversed(TERM_NAMES):
            out = F.when(part.rlike(pattern), F.regexp_replace(part, pattern, name)).otherwise(out)
        return F.coalesce(out, part)

    return F.array_join(F.transform(F.split(term, ":"), one), " × ")


def gee_table(coefficients: DataFrame, specification: str, interactions: bool) -> DataFrame:
    """Odds ratios, intervals and p-values of one model's main terms, or of its interactions by rising p."""
    own = coefficients.where((F.col("model_specification") == specification) & (F.col("term") != "Intercept"))
    if own.isEmpty():
        raise ValueError(f"no coefficients of {specification}")
    own = own.where(F.col("term").contains(":") if interactions else ~F.col("term").contains(":"))
    p = {"Raw p": F.col("p_value"), "Holm p": F.col("p_holm"), "FDR p": F.col("p_fdr_bh")}
    numbers = [c.alias(f"{n} numeric") for n, c in p.items()] if interactions else []
    out = own.select(clean_term(F.col("term")).alias("Interaction" if interactions else "Variable"), format_odds(F.col("odds_ratio")).alias("OR"), format_interval(F.col("ci_low_or"), F.col("ci_high_or")).alias("95% CI"), *(format_p(c).alias(n) for n, c in p.items()), *numbers)
    return out.orderBy("Raw p numeric", "Interaction") if interactions else out


def notable_rows(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Interactions with any p-value below ``alpha``."""
    return table.where(F.least(*(F.col(f"`{n} numeric`") for n in ("Raw p", "Holm p", "FDR p"))) < alpha)


def model_selection(metadata: DataFrame) -> DataFrame:
    name = F.regexp_replace(F.regexp_replace("model_specification", "^screen_", ""), "_X_", " × ")
    title = F.when(F.col("model_specification").isin("main_effects", "combined_key_interactions"), F.concat(F.upper(F.substring(name, 1, 1)), F.regexp_replace(F.expr("substring(model_specification, 2)"), "_", " "))).otherwise(F.initcap(F.regexp_replace(name, "_", " ")))
    return metadata.where("error is null").select(title.alias("Model"), F.col("converged").alias("Converged"), F.col("n_rows").alias("Rows"), F.col("n_clusters").alias("Clusters"), F.bround("qic", 2).alias("QIC"), F.bround("qicu", 2).alias("QICu")).orderBy("QIC", "Model")


def selected_mcnemar(tests: DataFrame) -> DataFrame:
    """Tests over all e-mails with their fixed condition as text, ordered by factor and formatted p."""
    fixed = F.concat_ws("; ", *(F.when(F.col(f"fixed_{f}").isNotNull(), F.concat(F.lit(f"{f}="), F.col(f"fixed_{f}"))) for f in ("model", "prompt", "parser")))
    own = tests.where("subgroup_factor = 'all'")
    return own.select(
        F.col("varying_factor").alias("Factor"),
        F.concat_ws(" vs ", "level_a", "level_b").alias("Comparison"),
        fixed.alias("Condition"),
        F.col("n_pairs").alias("Pairs"),
        F.bround(F.col("recall_a") * 100, 2).alias("RecallA"),
        F.bround(F.col("recall_b") * 100, 2).alias("RecallB"),
        F.bround("difference_percentage_points", 2).alias("Difference"),
        F.concat_ws("/", "a_correct_b_wrong", "a_wrong_b_correct").alias("Discordant"),
        format_p(F.col("p_value")).alias("raw_p"),
        format_p(F.col("p_holm")).alias("holm_p"),
        format_p(F.col("p_fdr_bh")).alias("fdr_p"),
    ).orderBy("Factor", "raw_p", "Comparison", "Condition")


# -- rendering


def escape_latex(text) -> str:
    return "".join("\\" + c if c in "&%_#" else c for c in str(text))


def latex(table: DataFrame, caption: str, label: str, column_format: str | None = None) -> str:
    """A booktabs table; numbers with six decimals, header escaped, cells as they are."""
    numeric = [kind in ("double", "float", "int", "bigint") for _, kind in table.dtypes]
    columns = column_format or "".join("r" if n else "l" for n in numeric)
    cell = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    rows = [" & ".join(map(cell, row)) + r" \\" for row in table.collect()]
    head = " & ".join(map(escape_latex, table.columns)) + r" \\"
    return "\n".join([r"\begin{table}[t]", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{columns}}}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])


def save_table(table: DataFrame, folder: str, name: str, caption: str, label: str, column_format: str | None = None) -> None:
    """A table as ``name``.csv and ``name``.tex in a folder (of any file system Hadoop knows)."""
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerow(table.columns)
    out.writerows(["" if v is None else v for v in row] for row in table.collect())
    write_text(table.sparkSession, text.getvalue(), f"{folder}/{name}.csv")
    write_text(table.sparkSession, latex(table, caption, label, column_format), f"{folder}/{name}.tex")
