"""Descriptive factorial summaries, contrasts, ranges and flags.

All factor tables come from one pass: a grouping-sets aggregate whose rows name their set
of factors. Distinct e-mails per set are counted from per-e-mail partial sums, so the
grouping sets expand one row per e-mail and cell of all factors, not one per observation.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgauge.functions.stats import wilson
from mailgauge.operators.clean import FACTORS

# The three-way tables.
THREE_WAY = (
    ("model", "prompt", "parser"),
    ("model", "prompt", "year_num"),
    ("model", "parser", "obfuscation_clean"),
    ("model", "year_num", "dataset_clean"),
    ("prompt", "parser", "obfuscation_clean"),
    ("parser", "year_num", "dataset_clean"),
)


def factor_sets() -> list[tuple[str, ...]]:
    """Six main, fifteen two-way and six three-way sets."""
    return [(f,) for f in FACTORS] + list(combinations(FACTORS, 2)) + [tuple(s) for s in THREE_WAY]


def _measures(df: DataFrame) -> DataFrame:
    low, high = wilson(F.col("successes"), F.col("observations"))
    out = df.withColumn("recall", F.try_divide(F.col("successes").cast("double"), F.col("observations"))).withColumn("wilson_low", low).withColumn("wilson_high", high)
    return out.withColumns({f"{c}_pct": F.col(c) * 100 for c in ("recall", "wilson_low", "wilson_high")})


def summarise(df: DataFrame, factors: list[str], outcome: str = "detected_end_to_end", unit: str = "base_email_id") -> DataFrame:
    """Successes, observations, recall with interval and distinct e-mails by factors (null levels are groups)."""
    part = df.groupBy(*factors, unit).agg(F.sum(outcome).alias("s"), F.count(outcome).alias("n"))
    grouped = part.groupBy(*factors).agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("successes"), F.sum("n").alias("observations"), F.count(unit).alias("unique_emails"))
    return _measures(grouped)


def summarise_sets(df: DataFrame, sets: list[tuple[str, ...]], outcome: str = "detected_end_to_end", unit: str = "base_email_id") -> DataFrame:
    """``summarise`` for many factor sets at once: factor_set, one string column per factor, measures."""
    names = list(dict.fromkeys(f for s in sets for f in s))
    part = df.groupBy(*names, unit).agg(F.sum(outcome).alias("s"), F.count(outcome).alias("n"))
    grouped = part.groupingSets([[F.col(f) for f in s] for s in sets], *(F.col(f) for f in names)).agg(
        F.concat_ws("*", *(F.when(F.grouping(f) == 0, f) for f in names)).alias("factor_set"),
        F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("successes"),
        F.sum("n").alias("observations"),
        F.countDistinct(unit).alias("unique_emails"),
    )
    return _measures(grouped.select("factor_set", *(F.col(f).cast("string").alias(f) for f in names), "successes", "observations", "unique_emails"))


def configuration_ranking(df: DataFrame) -> DataFrame:
    ranked = summarise(df, ["model", "prompt", "parser"])
    return ranked.withColumn("observed_rank", F.row_number().over(Window.orderBy(F.desc("recall"), "model", "prompt", "parser")))  # one row per configuration


def level_table(summary: DataFrame, target: str, context: str | None = None) -> DataFrame:
    """Levels of one factor (within one level of another) with their recall."""
    name = "*".join(f for f in FACTORS if f in (target, context))
    own = summary.where(F.col("factor_set") == name)
    return own.select(
        F.lit(target).alias("factor"),
        F.col(target).alias("level"),
        F.lit(context or "").alias("moderator"),
        (F.col(context) if context else F.lit("")).alias("moderator_level"),
        "recall",
    )


def all_levels(summary: DataFrame) -> DataFrame:
    """Every factor overall, and every factor within every other: one pass over the summary, whose rows each give one or two."""

    def row(target: str, within: str | None):
        name = "*".join(f for f in FACTORS if f in (target, within))
        own = F.struct(F.lit(target).alias("factor"), F.col(target).alias("level"), F.lit(within or "").alias("moderator"), (F.col(within) if within else F.lit("")).alias("moderator_level"))
        return F.when(F.col("factor_set") == name, own)

    rows = F.array(*(row(f, None) for f in FACTORS), *(row(t, m) for t, m in permutations(FACTORS, 2)))
    return summary.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"), "recall").select("r.*", "recall")


_WITHIN = ["factor", "moderator", "moderator_level"]


def contrasts(levels: DataFrame) -> DataFrame:
    """Differences of all pairs of levels a < b within a factor and context."""
    a = levels.select(*(F.col(c).alias(f"a_{c}") for c in levels.columns))
    b = levels.select(*_WITHIN, F.col("level").alias("level_b"), F.col("recall").alias("recall_b"))
    same = reduce(lambda x, y: x & y, (F.col(f"a_{c}").eqNullSafe(F.col(c)) for c in _WITHIN))
    out = a.join(b, same & (F.col("a_level") < F.col("level_b"))).select(*_WITHIN, F.col("a_level").alias("level_a"), "level_b", F.col("a_recall").alias("recall_a"), "recall_b")
    difference = F.col("recall_a") - F.col("recall_b")
    return out.withColumns(
        {
            "difference": difference,
            "difference_percentage_points": difference * 100,
            "absolute_difference_percentage_points": F.abs(difference) * 100,
            "relative_change_vs_b_pct": F.when(F.col("recall_b") != 0, difference / F.col("recall_b") * 100),
        }
    )


def effect_ranges(levels: DataFrame) -> DataFrame:
    """Lowest and highest level of each factor and context; of ties the smaller level."""
    low = F.min(F.struct("recall", "level"))
    high = F.min(F.struct((-F.col("recall")).alias("r"), "level"))
    out = levels.groupBy(*_WITHIN).agg(low.alias("low"), high.alias("high"))
    return out.select(
        *_WITHIN,
        F.col("low.level").alias("minimum_level"),
        F.col("high.level").alias("maximum_level"),
        F.col("low.recall").alias("minimum_recall"),
        (-F.col("high.r")).alias("maximum_recall"),
        ((-F.col("high.r")) - F.col("low.recall")).alias("recall_range"),
    )


def flagged(contrast_table: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Contrasts of ``threshold`` points or more with scope and reason, the largest first."""
    size, within = F.col("absolute_difference_percentage_points"), F.col("moderator") != ""
    scope = F.when(within, F.concat_ws("_within_", "factor", "moderator")).otherwise("overall")
    reason = F.format_string(f"absolute observed %sdifference >= {threshold:.1f} pp", F.when(within, "subgroup ").otherwise(""))
    return contrast_table.where(size >= threshold).withColumn("analysis_scope", scope).withColumn("reason", reason).orderBy(size.desc(), *_WITHIN, "level_a", "level_b")
