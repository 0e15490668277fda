import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgauge.functions import stats
from mailgauge.operators import factorial, gee, pairwise, reports, tables

# Published counts and figures of the experiment.
MODEL = [("Llama", 821, 960), ("Qwen", 632, 960)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("s,n,low,high", [(821, 960, 0.831532, 0.876053), (155, 160, 0.928940, 0.986579)])
def test_wilson(spark, s, n, low, high):
    r = one(spark, *stats.wilson(F.lit(s), F.lit(n)))
    assert r[0] == pytest.approx(low, abs=2e-6) and r[1] == pytest.approx(high, abs=2e-6)


def test_wilson_without_observations(spark):
    df = spark.createDataFrame([(0, 0)], "s int, n int").select(*stats.wilson(F.col("s"), F.nullif(F.col("n"), F.lit(0))))
    assert list(df.first()) == [None, None]


@pytest.mark.parametrize("b,c,p", [(0, 0, 1.0), (52, 0, 4.440892098500626e-16), (61, 8, 3.2432506e-11), (15, 14, 1.0), (0, 5, 0.0625), (20, 1, 2.0980834960937e-05)])
def test_exact_mcnemar(spark, b, c, p):
    assert one(spark, stats.exact_mcnemar(F.lit(b), F.lit(c)))[0] == pytest.approx(p, rel=1e-7)


def test_matched_odds_ratio(spark):
    ratio = lambda b, c: one(spark, stats.matched_odds_ratio(F.lit(b), F.lit(c)))[0]
    assert ratio(0, 0) is None and ratio(52, 0) == math.inf and ratio(0, 5) == 0 and ratio(6, 3) == 2


# Successes and sizes of two groups with the published p-value.
CHI = [((54, 68), (44, 92), 5.034e-05), ((64, 80), (40, 80), 6.951e-05), ((63, 68), (67, 92), 0.001496), ((75, 80), (61, 80), 0.001937), ((36, 68), (27, 92), 0.002532), ((57, 68), (58, 92), 0.003852)]


@pytest.mark.parametrize("a,b,p", CHI)
def test_between_email_chi_square(spark, a, b, p):
    rows = [(f"e{y}{g}{i}", int(i < s), y) for y, (s, n) in ((2023, a), (2025, b)) for g in ("",) for i in range(n)]
    df = spark.createDataFrame(rows, "base_email_id string, detected_end_to_end int, year_num int").withColumns({c: F.lit("x") for c in ("model", "prompt", "parser", "dataset_clean", "obfuscation_clean")})
    r = pairwise.between_tests(df).where("test_family = 'main'").first()
    assert r["test_used"] == "Pearson chi-square" and r["p_value"] == pytest.approx(p, rel=5e-4)


def test_fisher_and_degenerate_tables(spark):
    assert stats.fisher_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70)
    assert stats.fisher_two_sided(0, 10, 10, 0) == pytest.approx(2 / math.comb(20, 10))
    rows = [(f"a{i}", 1 if i < 1 else 0, 2023) for i in range(12)] + [(f"b{i}", 0, 2025) for i in range(11)] + [(f"c{i}", 1, 2026) for i in range(9)]
    df = spark.createDataFrame(rows, "base_email_id string, detected_end_to_end int, year_num int").withColumns({c: F.lit("x") for c in ("model", "prompt", "parser", "dataset_clean", "obfuscation_clean")})
    got = pairwise.between_tests(df).where("test_family = 'main'").collect()
    assert [(r["level_a"], r["level_b"], r["test_used"]) for r in got] == [("2023", "2025", "Fisher exact")]  # nine rows are too few
    same = pairwise.between_tests(df.withColumn("detected_end_to_end", F.lit(1))).where("test_family = 'main'").first()
    assert same["test_used"] == "No outcome variation" and same["p_value"] == 1.0


def test_holm_and_bh(spark):
    rows = [("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", None), ("b", 0.2), ("a", 0.03)]
    got = sorted(((r["f"], r["p_value"], r["p_holm"], r["p_fdr_bh"]) for r in stats.adjusted(spark.createDataFrame(rows, "f string, p_value double"), ["f"]).collect()), key=str)
    want = [("a", 0.01, 0.04, 0.04), ("a", 0.03, 0.09, 0.04), ("a", 0.03, 0.09, 0.04), ("a", 0.04, 0.09, 0.04), ("a", None, None, None), ("b", 0.2, 0.2, 0.2)]
    for g, w in zip(got, want):
        assert g[0] == w[0] and all(x == y or x == pytest.approx(y) for x, y in zip(g[1:], w[1:]))


def test_contrasts_of_published_counts(spark):
    rows = [(m, f"e{i}", int(i < s)) for m, s, n in MODEL for i in range(n)]
    df = spark.createDataFrame(rows, "model string, base_email_id string, detected_end_to_end int")
    summary = factorial.summarise_sets(df, [("model",)])
    r = factorial.contrasts(factorial.level_table(summary, "model")).first()
    assert (r["level_a"], r["level_b"]) == ("Llama", "Qwen")
    assert r["difference_percentage_points"] == pytest.approx(19.6875) and r["relative_change_vs_b_pct"] == pytest.approx(29.90506329)
    low = factorial.effect_ranges(factorial.level_table(summary, "model")).first()
    assert (low["minimum_level"], low["maximum_level"]) == ("Qwen", "Llama")


def test_rounding_is_half_even_and_differences_use_rounded_cells(spark):
    rows = [("Llama", "P1", f"e{i}", int(i < 422)) for i in range(480)] + [("Llama", "P2", f"e{i}", int(i < 399)) for i in range(480)]
    summary = factorial.summarise_sets(spark.createDataFrame(rows, "model string, parser string, base_email_id string, detected_end_to_end int"), [("model", "parser")])
    r = tables.condition_table(summary, "model", "parser", ["P1", "P2"], ("P1", "P2")).first()
    assert (r["P1"], r["P2"], r["difference"]) == (87.92, 83.12, 4.8)
    text = tables.latex(tables.condition_table(summary, "model", "parser", ["P1", "P2"]), "Recall (\\%).", "tab:x")
    assert "Llama & 87.920000 & 83.120000 \\\\" in text and "row\\_level" in text


def test_term_names(spark):
    terms = ["C(model, Treatment(reference='Llama'))[T.Qwen]", "C(prompt, Treatment(reference='evidence'))[T.guided]", "C(parser, Treatment(reference='P1'))[T.P2]:C(dataset_clean, Treatment(reference='nazario'))[T.spam_archive]"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, t string").orderBy("i").select(tables.clean_term(F.col("t"))).collect()]
    assert got == ["Qwen", "Guided prompt", "Parser P2 × SpamArchive"]


def clusters(seed, n=80, p=0.4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        shift = rng.normal()
        for m in ("Llama", "Qwen"):
            for q in ("P1", "P2"):
                out.append((f"e{i}", m, "evidence", q, 2023 + 2 * (i % 2), "nazario", "no", int(rng.random() < 1 / (1 + math.exp(-(p + shift + (m == "Qwen") - (q == "P2") * 0.5))))))
    return out


COLUMNS = "base_email_id string, model string, prompt string, parser string, year_num int, dataset_clean string, obfuscation_clean string, detected_end_to_end int"


def dense_gee(x, y, groups, p):
    """Independent reference: dense matrices, one cluster at a time."""
    beta, alpha = np.zeros(p), 0.0
    for _ in range(200):
        score, bread = np.zeros(p), np.zeros((p, p))
        squares = pairs = n_pairs = 0
        for g in set(groups):
            k = [i for i, v in enumerate(groups) if v == g]
            mu = 1 / (1 + np.exp(-x[k] @ beta))
            a = np.diag(np.sqrt(mu * (1 - mu)))
            v = a @ ((1 - alpha) * np.eye(len(k)) + alpha * np.ones((len(k), len(k)))) @ a
            d = np.diag(mu * (1 - mu)) @ x[k]
            score += d.T @ np.linalg.solve(v, y[k] - mu)
            bread += d.T @ np.linalg.solve(v, d)
        beta = beta + np.linalg.solve(bread, score)
        for g in set(groups):
            k = [i for i, v in enumerate(groups) if v == g]
            mu = 1 / (1 + np.exp(-x[k] @ beta))
            r = (y[k] - mu) / np.sqrt(mu * (1 - mu))
            squares += r @ r
            pairs += (np.outer(r, r).sum() - r @ r) / 2
            n_pairs += len(k) * (len(k) - 1) / 2
        alpha = pairs / (squares / (len(y) - p)) / (n_pairs - p)
    return beta, alpha


@pytest.mark.parametrize("few", [True, False])
def test_gee_matches_dense_reference(spark, few):
    rows = clusters(1)
    df = spark.createDataFrame(rows, COLUMNS)
    levels = {f: sorted({str(r[i + 1]) for r in rows}) for i, f in enumerate(gee.FACTORS)}
    design = gee.Design([("model",), ("parser",), ("year_num",), ("model", "parser")], levels)
    x = design.matrix([tuple(map(str, r[1:7])) for r in rows])
    patterns = gee.cluster_patterns(df)
    own = gee.LocalClusters([([tuple(v) for v in r["pattern"]], r["n"]) for r in patterns.collect()], design) if few else gee.SparkClusters(patterns, design)
    result = gee.fit(own, design.names, most=300 if few else 6)
    beta, alpha = dense_gee(x, np.array([r[7] for r in rows], float), [r[0] for r in rows], len(design.names))
    assert result.beta == pytest.approx(beta, abs=1e-6 if few else 1e-3) and result.alpha == pytest.approx(alpha, abs=1e-6 if few else 1e-3)
    assert result.n_clusters == 80 and result.n_rows == len(rows) and (result.converged or not few)


def test_gee_closed_forms(spark):
    rows = clusters(2)
    df = spark.createDataFrame(rows, COLUMNS)
    local = [([tuple(v) for v in r["pattern"]], r["n"]) for r in gee.cluster_patterns(df).collect()]
    levels = {f: sorted({str(r[i + 1]) for r in rows}) for i, f in enumerate(gee.FACTORS)}
    mean = np.mean([r[7] for r in rows])
    assert gee.fit(gee.LocalClusters(local, gee.Design([], levels)), ["Intercept"]).beta[0] == pytest.approx(math.log(mean / (1 - mean)))
    design = gee.Design([("model",)], levels)
    rate = {m: np.mean([r[7] for r in rows if r[1] == m]) for m in ("Llama", "Qwen")}
    odds = {m: math.log(v / (1 - v)) for m, v in rate.items()}
    assert gee.fit(gee.LocalClusters(local, design), design.names).beta == pytest.approx([odds["Llama"], odds["Qwen"] - odds["Llama"]], abs=1e-6)
    assert design.names[1] == "C(model, Treatment(reference='Llama'))[T.Qwen]"


def test_gee_specifications():
    levels = {"model": ["Llama", "Qwen"], "prompt": ["evidence", "guided", "label"], "parser": ["P1", "P2"], "year_num": ["2023", "2025"], "dataset_clean": ["nazario", "spam_archive"], "obfuscation_clean": ["no", "yes"]}
    sizes = [len(gee.Design(t, levels).names) for t in gee.specifications().values()]
    assert len(sizes) == 17 and sizes[0] == 8 and sizes[-1] == 18 and sum(sizes) == 166


# The published three-way tables, labels and model names.
THREE_WAY = {"model*prompt*parser", "model*prompt*year_num", "model*parser*obfuscation_clean", "model*year_num*dataset_clean", "prompt*parser*obfuscation_clean", "parser*year_num*dataset_clean"}
LEVELS = [("Model", "Llama"), ("Model", "Qwen"), ("Prompt", "Evidence"), ("Prompt", "Guided"), ("Prompt", "Label"), ("Parser", "P1"), ("Parser", "P2"), ("Collection year", "2023"), ("Collection year", "2025"), ("Dataset", "Nazario"), ("Dataset", "SpamArchive"), ("Obfuscation", "No"), ("Obfuscation", "Yes")]
MODELS = [("combined_key_interactions", "Combined key interactions", 1703.22), ("screen_year_X_dataset", "Year × Dataset", 1757.65), ("main_effects", "Main effects", 1794.7)]


@pytest.fixture(scope="module")
def answers(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(64):
        for m in ("Llama", "Qwen"):
            for k, q in enumerate(("evidence", "guided", "label")):
                for p in ("P1", "P2"):
                    rows.append((f"e{i}", m, q, p, 2023 + 2 * (i % 2), ("nazario", "spam_archive")[i // 2 % 2], ("no", "yes")[i // 4 % 2], int(rng.random() < 0.9 - 0.3 * (m == "Qwen") - 0.1 * k - 0.1 * (p == "P2"))))
    return spark.createDataFrame(rows, COLUMNS).withColumn("parseable", F.lit(True))


def test_sets_and_levels_are_the_published_ones(answers):
    summary = factorial.summarise_sets(answers, factorial.factor_sets())
    assert {r[0] for r in summary.select("factor_set").distinct().collect() if r[0].count("*") == 2} == THREE_WAY
    table = tables.overall_recall(summary).orderBy("position", "Level")
    assert [(r["Factor"], r["Level"]) for r in table.collect()] == LEVELS and "Recall (%)" in table.columns


def test_model_names_and_order(spark):
    rows = [(n, True, 1920, 160, q + 0.001, q + 8, None) for n, _, q in reversed(MODELS)]
    meta = spark.createDataFrame(rows, "model_specification string, converged boolean, n_rows int, n_clusters int, qic double, qicu double, error string")
    assert [(r["Model"], r["QIC"]) for r in tables.model_selection(meta).collect()] == [(m, q) for _, m, q in MODELS]
    assert spark.range(1).select(tables.clean_term(F.lit("C(year_num, Treatment(reference=2023))[T.2025]"))).first()[0] == "Collection year 2025"


def test_flags_say_scope_and_reason(answers):
    rows = factorial.flagged(factorial.contrasts(factorial.all_levels(factorial.summarise_sets(answers, factorial.factor_sets())))).collect()
    sizes = [r["absolute_difference_percentage_points"] for r in rows]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] >= 5
    assert {r["reason"] for r in rows if r["moderator"]} == {"absolute observed subgroup difference >= 5.0 pp"}
    assert {(r["analysis_scope"], r["reason"]) for r in rows if not r["moderator"]} == {("overall", "absolute observed difference >= 5.0 pp")}


def test_large_counts_in_paired_and_fisher_tests(spark):
    for b, c in ((6_000, 6_100), (5_400, 6_600), (1_000_000, 1_001_000)):
        k, n = min(b, c), b + c
        terms = [math.lgamma(n + 1) - math.lgamma(k - i + 1) - math.lgamma(n - k + i + 1) - n * math.log(2) for i in range(0, min(k, 60_000) + 1)]
        want = min(1.0, 2 * math.fsum(map(math.exp, terms)))
        assert one(spark, stats.exact_mcnemar(F.lit(b), F.lit(c)))[0] == pytest.approx(want, rel=1e-5)
    assert stats.fisher_two_sided(3, 999_997, 2, 1_999_998) == pytest.approx(stats.fisher_two_sided(2, 1_999_998, 3, 999_997))
    assert stats.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-6)


def test_reports_and_tables(spark, answers, tmp_path):
    specs = {n: t for n, t in gee.specifications().items() if n in ("main_effects", "combined_key_interactions")}
    coefficients, meta = gee.run_models(answers, specs=specs)
    paired, apart = pairwise.mcnemar_tests(answers), pairwise.between_tests(answers)
    contrasts = factorial.contrasts(factorial.all_levels(factorial.summarise_sets(answers, factorial.factor_sets())))
    text = reports.descriptive(answers, factorial.summarise_sets(answers, factorial.factor_sets()), contrasts)
    assert "Rows: 768" in text and "Unique underlying emails: 64" in text and "TOP CONFIGURATIONS" in text
    text = reports.inferential(answers, paired, apart, coefficients, gee.notable_interactions(coefficients))
    assert f"McNemar tests: {paired.count()}" in text and "GEE coefficient rows: 26" in text
    text = reports.paper_tables(answers, str(tmp_path), paired, coefficients, meta)
    assert "Collection year" in text and "BEST GEE MODEL" in text
    names = {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")}
    assert {"table_overall_recall.csv", "table_overall_recall.tex", "table_model_parser.tex", "table_dataset_year.csv", "results_numbers_summary.txt", "gee_formulas.json"} <= names
    lines = (tmp_path / "table_overall_recall.csv").read_text().splitlines()
    assert lines[0] == "Factor,Level,Recall (%),Successes,Observations" and len(lines) == 14
    inter = tables.gee_table(coefficients, "combined_key_interactions", True)
    assert tables.notable_rows(inter, 2.0).count() == inter.count() == 10


def test_validation_export(spark, answers, tmp_path):
    extra = {"pred_label_num": F.lit(1.0), "status_clean": F.lit("ok"), "parse_ok_bool": F.lit(True), "fits_bool": F.lit(True), "overflow_tokens_num": F.lit(0.0), "ground_truth_num": F.lit(1.0)}
    df = answers.withColumns(extra)
    broken = df.unionByName(df.where("base_email_id = 'e1' AND model = 'Llama'")).where("NOT (base_email_id = 'e2' AND prompt = 'label')")
    text = reports.validation(broken, str(tmp_path))
    assert text.splitlines()[:5] == ["rows: 770", "exact duplicates: 6", "rows in duplicate cells: 12", "incomplete e-mails: 2", "missing cells: 4"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/cleaned").count() == 770 and (tmp_path / "validation_report.txt").read_text() == text
    assert spark.read.option("header", True).csv(f"{tmp_path}/missing_cells").count() == 4
