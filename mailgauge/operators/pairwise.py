"""Paired and between-e-mail tests of detection."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgauge.functions.stats import adjusted, chi_square_tail, exact_mcnemar, fisher_p, matched_odds_ratio
from mailgauge.operators.clean import BETWEEN, REPEATED

OUTCOME = "detected_end_to_end"
MINIMUM_GROUP = 10


def _cells(df: DataFrame) -> DataFrame:
    """One row per cell: the first outcome in row order where a cell repeats."""
    first = F.min(F.struct(*(c for c in ("row_id",) if c in df.columns), F.col(OUTCOME).alias("y")))
    return df.groupBy("base_email_id", *REPEATED, *BETWEEN).agg(first.alias("first")).select("base_email_id", *REPEATED, *BETWEEN, F.col("first.y").alias("y"))


def mcnemar_counts(df: DataFrame) -> DataFrame:
    """Paired counts for each varying factor, pair of levels, fixed levels and subgroup (all, or a between factor's level).

    Two shuffles: an e-mail's cells (as many as the design has configurations) meet in one row and give its
    pairs, whose counts are summed.
    """
    own = _cells(df).groupBy("base_email_id").agg(F.collect_list(F.struct(*REPEATED, *BETWEEN, "y")).alias("cells"))

    def pairs_of(varying: str):
        fixed = [f for f in REPEATED if f != varying]
        match = lambda a, b: reduce(lambda x, y: x & y, (a[f] == b[f] for f in fixed)) & (a[varying] < b[varying])
        pair = lambda a: F.transform(F.filter("cells", lambda b: match(a, b)), lambda b: F.struct(F.lit(varying).alias("varying_factor"), a.alias("a"), b[varying].alias("level_b"), b["y"].alias("y_b")))
        return F.flatten(F.transform("cells", pair))

    pairs = own.select(F.explode(F.concat(*map(pairs_of, REPEATED))).alias("p")).select("p.*")
    level_a = reduce(lambda c, f: c.when(F.col("varying_factor") == f, F.col(f"a.{f}")), REPEATED[1:], F.when(F.col("varying_factor") == REPEATED[0], F.col(f"a.{REPEATED[0]}")))
    subgroups = F.array(F.struct(F.lit("all").alias("factor"), F.lit("all").alias("level")), *(F.struct(F.lit(g).alias("factor"), F.col(f"a.{g}").cast("string").alias("level")) for g in BETWEEN))
    fixed = [F.when(F.col("varying_factor") != f, F.col(f"a.{f}")).alias(f"fixed_{f}") for f in REPEATED]
    rows = pairs.select("varying_factor", level_a.alias("level_a"), "level_b", F.explode(subgroups).alias("sub"), *fixed, F.col("a.y").alias("y"), "y_b")
    n = lambda x, y: F.count_if((F.col("y") == x) & (F.col("y_b") == y))
    by = ["varying_factor", "level_a", "level_b", F.col("sub.factor").alias("subgroup_factor"), F.col("sub.level").alias("subgroup_level"), *(f"fixed_{f}" for f in REPEATED)]
    return rows.groupBy(*by).agg(F.count("*").alias("n_pairs"), n(1, 1).alias("both_correct"), n(1, 0).alias("a_correct_b_wrong"), n(0, 1).alias("a_wrong_b_correct"), n(0, 0).alias("both_wrong"))


def mcnemar_tests(df: DataFrame) -> DataFrame:
    b, c, n = F.col("a_correct_b_wrong"), F.col("a_wrong_b_correct"), F.col("n_pairs")
    tests = mcnemar_counts(df).withColumns(
        {
            "discordant_pairs": b + c,
            "recall_a": (F.col("both_correct") + b) / n,
            "recall_b": (F.col("both_correct") + c) / n,
            "difference_percentage_points": (b - c) / n * 100,
            "matched_odds_ratio": matched_odds_ratio(b, c),
            "p_value": exact_mcnemar(b, c),
        }
    )
    return adjusted(tests, ["varying_factor", "subgroup_factor"])


def between_counts(df: DataFrame, minimum: int = MINIMUM_GROUP) -> DataFrame:
    """Group sizes and successes of two levels of an e-mail factor, per configuration: overall and within another factor's level."""
    keys = ["test_family", "varying_factor", *REPEATED, "conditioning_factor", "conditioning_level"]
    sets = [(f,) for f in BETWEEN] + list(combinations(BETWEEN, 2))
    name = F.concat_ws("*", *(F.when(F.grouping(f) == 0, f) for f in BETWEEN)).alias("factors")
    # One pass: rows of configuration and one or two factors, each of which is the level compared or the one it is compared within.
    sums = df.groupingSets([[F.col(c) for c in (*REPEATED, *s)] for s in sets], *(F.col(c) for c in (*REPEATED, *BETWEEN))).agg(name, F.count("*").alias("n"), F.sum(OUTCOME).alias("s"))

    def row(varying: str, within: str | None):
        shown = {"test_family": F.lit("simple" if within else "main"), "varying_factor": F.lit(varying), "conditioning_factor": F.lit(within or "none")}
        shown |= {"conditioning_level": F.col(within).cast("string") if within else F.lit("all"), "level": F.col(varying).cast("string")}
        return F.when(F.col("factors") == "*".join(f for f in BETWEEN if f in (varying, within)), F.struct(*(c.alias(k) for k, c in shown.items())))

    rows = F.array(*(row(f, None) for f in BETWEEN), *(row(f, g) for f, g in permutations(BETWEEN, 2)))
    level = sums.select(*REPEATED, "n", "s", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(*REPEATED, "n", "s", "r.*")
    a, b = (level.select(*keys, *(F.col(c).alias(f"{alias}_{k}") for c, alias in (("level", "level"), ("n", "n"), ("s", "successes")))) for k in "ab")
    out = a.join(b, keys).where((F.col("level_a") < F.col("level_b")) & (F.least("n_a", "n_b") >= minimum))
    out = out.select("test_family", "varying_factor", *REPEATED, "conditioning_factor", "conditioning_level", "level_a", "level_b", "n_a", "n_b", "successes_a", "successes_b")
    return out.withColumns({"failures_a": F.col("n_a") - F.col("successes_a"), "failures_b": F.col("n_b") - F.col("successes_b")})


def between_tests(df: DataFrame) -> DataFrame:
    """Chi-square without correction, Fisher where an expected count is below five, p 1 without variation; odds ratio of failure."""
    sa, sb, fa, fb, na, nb = (F.col(c).cast("double") for c in ("successes_a", "successes_b", "failures_a", "failures_b", "n_a", "n_b"))
    total, success, failure = na + nb, sa + sb, fa + fb
    varies = (success > 0) & (failure > 0)
    least = F.least(na, nb) * F.least(success, failure) / total
    chi = F.when(varies, total * F.pow(sa * fb - sb * fa, F.lit(2.0)) / (na * nb * success * failure))
    tests = between_counts(df).withColumns(
        {
            "recall_a": sa / na,
            "recall_b": sb / nb,
            "difference_percentage_points": (sa / na - sb / nb) * 100,
            "odds_ratio": F.when(sa * fb > 0, fa * sb / (sa * fb)).when(fa * sb > 0, F.lit(float("inf"))),
            "minimum_expected_count": least,
            "chi_square": chi,
            "test_used": F.when(~varies, "No outcome variation").when(least < 5, "Fisher exact").otherwise("Pearson chi-square"),
        }
    )
    p = F.when(F.col("test_used") == "Pearson chi-square", chi_square_tail(F.col("chi_square"))).when(F.col("test_used") == "Fisher exact", fisher_p("failures_a", "successes_a", "failures_b", "successes_b")).otherwise(1.0)
    return adjusted(tests.withColumn("p_value", p), ["test_family"])


def notable(tests: DataFrame, alpha: float = 0.05, points: float = 5.0) -> DataFrame:
    """Tests below ``alpha`` after Holm or with a difference of ``points`` or more, the smallest p first."""
    kept = tests.where((F.col("p_holm") < alpha) | (F.abs("difference_percentage_points") >= points))
    return kept.orderBy("p_holm", F.abs("difference_percentage_points").desc(), *(c for c in tests.columns if c.endswith(("_factor", "level_a", "level_b"))))
