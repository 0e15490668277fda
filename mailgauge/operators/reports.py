"""Text reports of the three analysis steps. They collect aggregates only: levels, configurations, tests, model terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgauge.operators import factorial, gee, pairwise, tables, validate
from mailgauge.operators.clean import FACTORS
from mailgauge.sources.files import write_csv, write_text

WIDTH = 72


def _cell(v, digits: int) -> str:
    return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) and 1e-3 <= abs(v) < 1e9 or v == 0.0 and isinstance(v, float) else f"{v:.3e}" if isinstance(v, float) else str(v)


def grid(table: DataFrame, rows: int, digits: int = 2) -> list[str]:
    """The first rows of a small table in right-aligned columns."""
    cells = [table.columns, *([_cell(v, digits) for v in row] for row in table.limit(rows).collect())]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    return [" ".join(c.rjust(w) for c, w in zip(line, widths, strict=True)) for line in cells]


def report(title: str, sections: list[tuple[str, list[str]]]) -> str:
    lines = [title, "=" * WIDTH]
    for name, body in sections:
        lines += [name, "-" * WIDTH, *body, ""] if name else [*body, ""]
    return "\n".join(lines) + "\n"


def _size(df: DataFrame, what: str) -> list[str]:
    n = df.agg(F.count("*").alias("n"), F.countDistinct("base_email_id").alias("emails")).first()
    return [f"Rows: {n['n']:,}", f"{what}: {n['emails']:,}"]


def validation(df: DataFrame, folder: str) -> str:
    """Write the checked table, its first 50 rows and what is wrong in it as CSV, and the report of the counts; returns that report."""
    small = {"sample": validate.sample_rows(df), "rows_distribution": validate.rows_distribution(df)}
    for name, table in small.items():
        write_csv(table, f"{folder}/{name}", single=True)
    for name, table in {"cleaned": df, "duplicate_cells": validate.duplicate_cells(df), "rows_per_email": validate.rows_per_email(df), "missing_cells": validate.missing_cells(df)}.items():
        write_csv(table, f"{folder}/{name}")
    text = validate.validation_report(df)
    write_text(df.sparkSession, text, f"{folder}/validation_report.txt")
    return text


def descriptive(df: DataFrame, summary: DataFrame, contrasts: DataFrame, threshold: float = 5.0) -> str:
    """Main tables, the first 12 configurations and the first 30 flagged contrasts. ``summary`` has all factor sets."""
    sections = [("", _size(df, "Unique underlying emails"))]
    sections.append(("IMPORTANT", ["These are observed differences; repeated answers to one e-mail are not independent.", "Wilson intervals describe; they are no tests."]))
    for f in FACTORS:
        own = summary.where(F.col("factor_set") == f).select(f, "successes", "observations", "recall_pct").orderBy(f)
        sections.append((f"MAIN EFFECT {f.upper()}", grid(own, 50)))
    ranking = factorial.configuration_ranking(df).orderBy("observed_rank").select("observed_rank", "model", "prompt", "parser", "successes", "observations", "recall_pct")
    flags = factorial.flagged(contrasts, threshold)
    sections.append(("TOP CONFIGURATIONS", grid(ranking, 12)))
    sections.append((f"CONTRASTS OF {threshold:.1f} POINTS OR MORE: {flags.count()}", grid(flags.select("analysis_scope", "moderator_level", "level_a", "level_b", "difference_percentage_points"), 30)))
    return report("DESCRIPTIVE ANALYSIS SUMMARY", sections)


def inferential(df: DataFrame, mcnemar: DataFrame, between: DataFrame, coefficients: DataFrame, interactions: DataFrame, rows: int = 20) -> str:
    """Numbers of tests and the first ``rows`` of each family by corrected p; ``interactions`` are notable coefficients."""
    rules = [
        "Model, prompt and parser are compared by exact McNemar tests within fixed conditions: each e-mail gives one pair.",
        "Year, dataset and obfuscation are compared by chi-square or Fisher tests within one configuration.",
        "Adjusted effects and interactions come from logistic GEE clustered by e-mail.",
    ]
    counts = [f"McNemar tests: {mcnemar.count():,}", f"Between-email tests: {between.count():,}", f"GEE coefficient rows: {coefficients.count():,}"]
    paired = pairwise.notable(mcnemar).select("varying_factor", "level_a", "level_b", "subgroup_factor", "subgroup_level", "difference_percentage_points", "a_correct_b_wrong", "a_wrong_b_correct", "p_value", "p_holm", "fixed_model", "fixed_prompt", "fixed_parser")
    apart = pairwise.notable(between).select("test_family", "varying_factor", "level_a", "level_b", "conditioning_factor", "conditioning_level", "model", "prompt", "parser", "difference_percentage_points", "p_value", "p_holm")
    terms = interactions.orderBy("p_holm", "model_specification", "term").select("model_specification", "term", "odds_ratio", "ci_low_or", "ci_high_or", "p_value", "p_holm")
    return report("INFERENTIAL ANALYSIS SUMMARY", [
        ("", _size(df, "Unique emails/clusters")),
        ("METHODOLOGICAL RULES", rules),
        ("TEST COUNTS", counts),
        ("TOP HOLM-ADJUSTED MCNEMAR RESULTS", grid(paired, rows)),
        ("TOP HOLM-ADJUSTED BETWEEN-EMAIL RESULTS", grid(apart, rows)),
        ("TOP GEE INTERACTIONS", grid(terms, rows)),
    ])


def numbers(overall: DataFrame, ranking: DataFrame, selection: DataFrame, main: DataFrame, interactions: DataFrame) -> str:
    """The numbers a text quotes: recall by level, first and last three configurations, the best model and its terms."""
    last = ranking.orderBy(F.desc("Rank")).limit(3).orderBy("Rank")
    return report("RESULTS NUMBERS SUMMARY", [
        ("OVERALL RECALL", grid(overall.orderBy("position", "Level").drop("position"), 50)),
        ("TOP AND BOTTOM CONFIGURATIONS", [*grid(ranking.orderBy("Rank"), 3), "", *grid(last, 3)]),
        ("BEST GEE MODEL", grid(selection, 1)),
        ("FINAL GEE MAIN EFFECTS", grid(main, 50)),
        ("FINAL GEE INTERACTIONS", grid(interactions, 50, 6)),
        ("INTERPRETATION NOTE", ["With interactions in the model, main effects hold at the reference levels only."]),
    ])


def paper_tables(df: DataFrame, folder: str, mcnemar: DataFrame, coefficients: DataFrame, metadata: DataFrame, specification: str = "combined_key_interactions") -> str:
    """Write all report tables as CSV and LaTeX, and the numbers report; returns that report."""
    summary = factorial.summarise_sets(df, factorial.factor_sets())
    overall, ranking = tables.overall_recall(summary), tables.ranking_table(factorial.configuration_ranking(df))
    selection, main, inter = tables.model_selection(metadata), tables.gee_table(coefficients, specification, False), tables.gee_table(coefficients, specification, True)
    levels = {f: sorted(r[0] for r in df.select(F.col(f).cast("string")).distinct().collect()) for f in FACTORS}  # a few each
    out = {
        "table_overall_recall": (overall.orderBy("position", "Level").drop("position"), "Recall by level of each factor."),
        "table_configuration_ranking": (ranking.orderBy("Rank"), "Configurations by recall."),
        "table_gee_model_selection": (selection, "Candidate GEE models; a lower QIC is a better fit."),
        "table_gee_main_effects": (main, "Main terms of the GEE model."),
        "table_gee_interactions": (inter, "Interactions of the GEE model."),
        "table_gee_interactions_notable": (tables.notable_rows(inter), "Interactions with a p-value below 0.05."),
        "table_mcnemar_selected": (tables.selected_mcnemar(mcnemar), "Paired tests over all e-mails."),
    }
    for rows, columns in (("model", "parser"), ("model", "prompt"), ("parser", "obfuscation_clean"), ("parser", "dataset_clean"), ("dataset_clean", "year_num")):
        name = "_".join(f.split("_")[0] for f in (rows, columns))
        minus = (levels[columns][0], levels[columns][-1]) if len(levels[columns]) == 2 else None
        out[f"table_{name}"] = (tables.condition_table(summary, rows, columns, levels[columns], minus).orderBy("row_level"), f"Recall by {rows} and {columns}.")
    for name, (table, caption) in out.items():
        tables.save_table(table, folder, name, caption, f"tab:{name.removeprefix('table_')}")
    text = numbers(overall, ranking, selection, main, inter)
    write_text(df.sparkSession, text, f"{folder}/results_numbers_summary.txt")
    write_text(df.sparkSession, gee.formulas_json(levels), f"{folder}/gee_formulas.json")
    return text
