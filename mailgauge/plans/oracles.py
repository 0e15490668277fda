"""DuckDB SQL for the queries of the catalog that SQL can express."""

from __future__ import annotations

from itertools import combinations, permutations

from mailgauge.operators.registry import PROMPTS

# Fixed values, stated here again so that the SQL does not follow the engine.
REPEATED, BETWEEN = ("model", "prompt", "parser"), ("year_num", "dataset_clean", "obfuscation_clean")
FACTORS = REPEATED + BETWEEN
Z95 = 1.959963984540054
SETS = [(f,) for f in FACTORS] + list(combinations(FACTORS, 2))
SETS += [("model", "prompt", "parser"), ("model", "parser", "obfuscation_clean"), ("model", "prompt", "year_num")]
SETS += [("prompt", "parser", "obfuscation_clean"), ("model", "year_num", "dataset_clean"), ("parser", "year_num", "dataset_clean")]
_PROMPTS = ", ".join(f"('{p.prompt_id}', '{p.template.replace(chr(39), chr(39) * 2)}', {k})" for k, p in enumerate(PROMPTS.values()))
_MODELS = "('meta-llama/Llama-3.1-8B-Instruct', 128000), ('Qwen/Qwen2.5-7B-Instruct', 131072)"  # fixed values

CLEAN = """
mails AS (
  SELECT d.doc_id, quality, n_chars, 'doc_' || d.doc_id AS base_email_id, CASE WHEN d.doc_id % 2 = 0 THEN 2023 ELSE 2025 END AS year_num,
    CASE WHEN lang = 'en' THEN 'set_a' ELSE 'set_b' END AS dataset_clean, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS obfuscation_clean
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
grid AS (
  SELECT mails.*, model, mi, prompt, pi, parser, qi, n_chars <= 12000 AS ran, n_chars <= 12000 AND doc_id % 7 <> 6 AS parsed,
    coalesce((doc_id * 31 + mi * 17 + pi * 11 + qi * 7 + quality * 5) % 100 < 90 - 15 * mi - 8 * pi - 6 * qi - CASE WHEN year_num = 2025 THEN 10 ELSE 0 END - 12 * mi * pi, false) AS hit,
    n_chars // 4 + 50 AS tokens
  FROM mails, (VALUES ('Llama', 0), ('Qwen', 1)) m(model, mi), (VALUES ('label', 0), ('guided', 1), ('evidence', 2)) p(prompt, pi), (VALUES ('P1', 0), ('P2', 1)) q(parser, qi)),
clean AS MATERIALIZED (
  SELECT doc_id, base_email_id || '_' || parser AS email_id, base_email_id, model, prompt, parser, year_num::BIGINT AS year_num, dataset_clean, obfuscation_clean,
    CASE WHEN ran THEN 'ok' ELSE 'skipped_over_context' END AS status_clean, parsed AS parse_ok_bool, CASE WHEN parsed THEN hit::INT::DOUBLE END AS pred_label_num, 1::DOUBLE AS ground_truth_num,
    tokens <= 3050 AS fits_bool, tokens::DOUBLE AS input_tokens_num, greatest(0, tokens - 3050)::DOUBLE AS overflow_tokens_num, parsed AS parseable, (parsed AND hit)::BIGINT AS detected_end_to_end,
    CASE WHEN parsed THEN hit::INT::DOUBLE END AS correct_reconstructed, CASE WHEN parsed THEN hit END AS correct_original_bool
  FROM grid)"""

BROKEN = (
    CLEAN
    + """,
twice AS (SELECT * FROM clean UNION ALL SELECT * FROM clean WHERE doc_id % 11 = 0),
again AS (
  SELECT * FROM twice UNION ALL
  SELECT * REPLACE (1 - detected_end_to_end AS detected_end_to_end) FROM clean WHERE doc_id % 17 = 0),
broken AS (
  SELECT * REPLACE (CASE WHEN doc_id % 19 = 0 AND parser = 'P2' THEN NULL ELSE dataset_clean END AS dataset_clean, CASE WHEN doc_id % 23 = 0 AND model = 'Qwen' THEN 2024 ELSE year_num END AS year_num),
    doc_id * 12 + CASE WHEN model = 'Llama' THEN 0 ELSE 6 END + CASE prompt WHEN 'label' THEN 0 WHEN 'guided' THEN 2 ELSE 4 END + CASE WHEN parser = 'P1' THEN 0 ELSE 1 END AS row_id
  FROM again WHERE NOT (doc_id % 13 = 0 AND model = 'Qwen' AND prompt = 'label'))"""
)


def _interval(s: str, n: str, sign: str) -> str:
    p = f"({s}::DOUBLE / {n})"
    return f"CASE WHEN {n} > 0 THEN ({p} + {Z95**2!r} / (2 * {n})) / (1 + {Z95**2!r} / {n}) {sign} {Z95!r} * sqrt({p} * (1 - {p}) / {n} + {Z95**2!r} / (4.0 * {n} * {n})) / (1 + {Z95**2!r} / {n}) END"


def _measures(digits: int = 6) -> str:
    low, high = _interval("successes", "observations", "-"), _interval("successes", "observations", "+")
    recall = "successes::DOUBLE / nullif(observations, 0)"
    return ", ".join(f"round({x}{y}, {digits}) AS {name}{suffix}" for y, suffix in (("", ""), (" * 100", "_pct")) for x, name in ((f"({recall})", "recall"), (f"({low})", "wilson_low"), (f"({high})", "wilson_high")))


_SUMS = "coalesce(sum(detected_end_to_end), 0)::BIGINT AS successes, count(detected_end_to_end) AS observations, count(DISTINCT base_email_id) AS unique_emails"


def _sets(sets, source: str = "clean", sums: str = _SUMS) -> str:
    names = list(dict.fromkeys(f for s in sets for f in s))
    label = "concat_ws('*', " + ", ".join(f"CASE WHEN grouping({f}) = 0 THEN '{f}' END" for f in names) + ")"
    return f"SELECT {label} AS factor_set, {', '.join(f'{f}::VARCHAR AS {f}' for f in names)}, {sums} FROM {source} GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in sets)})"


def _levels() -> str:
    parts = [(f, None) for f in FACTORS] + list(permutations(FACTORS, 2))
    rows = []
    for target, within in parts:
        name = "*".join(f for f in FACTORS if f in (target, within))
        rows.append(f"SELECT '{target}' AS factor, {target} AS level, '{within or ''}' AS moderator, {within or chr(39) * 2} AS moderator_level, successes::DOUBLE / observations AS recall FROM sets WHERE factor_set = '{name}'")
    return f"sets AS ({_sets(SETS)}), levels AS ({' UNION ALL '.join(rows)})"


_CONTRASTS = """contrasts AS (
  SELECT a.factor, a.moderator, a.moderator_level, a.level AS level_a, b.level AS level_b, a.recall AS recall_a, b.recall AS recall_b, a.recall - b.recall AS difference
  FROM levels a JOIN levels b ON a.factor = b.factor AND a.moderator = b.moderator AND a.moderator_level IS NOT DISTINCT FROM b.moderator_level AND a.level < b.level)"""


def _mcnemar() -> str:
    parts = []
    for varying in REPEATED:
        fixed = [f for f in REPEATED if f != varying]
        subs = [("all", "'all'")] + [(g, f"a.{g}::VARCHAR") for g in BETWEEN]
        for g, value in subs:
            shown = ", ".join(f"a.{f} AS fixed_{f}" if f in fixed else f"NULL::VARCHAR AS fixed_{f}" for f in REPEATED)
            n = ", ".join(f"count(*) FILTER (a.detected_end_to_end = {x} AND b.detected_end_to_end = {y}) AS {name}" for x, y, name in ((1, 1, "both_correct"), (1, 0, "a_correct_b_wrong"), (0, 1, "a_wrong_b_correct"), (0, 0, "both_wrong")))
            on = " AND ".join(f"a.{f} = b.{f}" for f in ["base_email_id", *fixed])
            parts.append(f"SELECT '{varying}' AS varying_factor, a.{varying} AS level_a, b.{varying} AS level_b, '{g}' AS subgroup_factor, {value} AS subgroup_level, {shown}, count(*) AS n_pairs, {n} FROM clean a JOIN clean b ON {on} AND a.{varying} < b.{varying} GROUP BY ALL")
    return "mcnemar AS (" + " UNION ALL ".join(parts) + ")"


_BINOMIAL = "CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))) END"


def _adjusted(source: str, family: str) -> str:
    return f"""ranked AS (SELECT *, count(*) OVER (PARTITION BY {family}) AS m, row_number() OVER (PARTITION BY {family} ORDER BY p_value) AS i FROM {source}),
adjusted AS (SELECT *, least(1.0, max((m - i + 1) * p_value) OVER (PARTITION BY {family} ORDER BY i ROWS UNBOUNDED PRECEDING)) AS p_holm,
  least(1.0, min(m * p_value / i) OVER (PARTITION BY {family} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr_bh FROM ranked)"""


_TESTED = f"""tested AS (
  SELECT * EXCLUDE (k, n), {_BINOMIAL} AS p_value FROM (
    SELECT *, a_correct_b_wrong + a_wrong_b_correct AS discordant_pairs, (both_correct + a_correct_b_wrong)::DOUBLE / n_pairs AS recall_a, (both_correct + a_wrong_b_correct)::DOUBLE / n_pairs AS recall_b,
      (a_correct_b_wrong - a_wrong_b_correct)::DOUBLE / n_pairs * 100 AS difference_percentage_points, least(a_correct_b_wrong, a_wrong_b_correct) AS k, (a_correct_b_wrong + a_wrong_b_correct)::DOUBLE AS n FROM mcnemar))"""
_FORMAT_P = "CASE WHEN {0} < 0.001 THEN '$<0.001$' ELSE printf('%.3f', {0}) END"


def _between() -> str:
    parts = []
    for varying, within in [(f, None) for f in BETWEEN] + list(permutations(BETWEEN, 2)):
        by = f"model, prompt, parser, '{within or 'none'}' AS conditioning_factor, {within + '::VARCHAR' if within else chr(39) + 'all' + chr(39)} AS conditioning_level, {varying}::VARCHAR AS level"
        parts.append(f"SELECT '{'simple' if within else 'main'}' AS test_family, '{varying}' AS varying_factor, {by}, count(*) AS n, sum(detected_end_to_end)::BIGINT AS s FROM clean GROUP BY ALL")
    return f"""levels AS MATERIALIZED ({' UNION ALL '.join(parts)}),
between_pairs AS (SELECT a.* EXCLUDE (level, n, s), a.level AS level_a, b.level AS level_b, a.n AS n_a, b.n AS n_b, a.s AS successes_a, b.s AS successes_b, a.n - a.s AS failures_a, b.n - b.s AS failures_b
  FROM levels a JOIN levels b ON a.test_family = b.test_family AND a.varying_factor = b.varying_factor AND a.model = b.model AND a.prompt = b.prompt AND a.parser = b.parser
    AND a.conditioning_factor = b.conditioning_factor AND a.conditioning_level = b.conditioning_level AND a.level < b.level WHERE least(a.n, b.n) >= 10)"""


def _pivot(rows: str, columns: str, levels: list[str], minus: tuple[str, str] | None = None) -> str:
    cell = lambda v: f"round_even(100 * sum(detected_end_to_end) FILTER ({columns}::VARCHAR = '{v}')::DOUBLE / count(*) FILTER ({columns}::VARCHAR = '{v}'), 2)"
    cells = ", ".join(f'{cell(v)} AS "{v}"' for v in levels)
    extra = f", round_even({cell(minus[0])} - {cell(minus[1])}, 2) AS difference" if minus else ""
    return f"WITH {CLEAN} SELECT {rows}::VARCHAR AS row_level, {cells}{extra} FROM clean GROUP BY 1"


def _crosstab(rows: str, columns: str, levels: list[str], source: str) -> str:
    label = lambda c: f"CASE WHEN grouping({c}) = 1 THEN 'All' ELSE coalesce({c}::VARCHAR, 'NA') END"
    cells = ", ".join(f"""count(*) FILTER (coalesce({columns}::VARCHAR, 'NA') = '{v}') AS "{v}\"""" for v in levels)
    return f"SELECT {label(rows)} AS {rows}, {cells}, count(*) AS \"All\" FROM {source} GROUP BY GROUPING SETS (({rows}), ())"


def _label(raw: str) -> str:
    """The answer's label by regular expressions (RE2)."""
    named = r"(?i)\b(?:label|classification|class|prediction)\b\s*[:=\-]?\s*[<\[({]?\s*([01])\s*[>\])}]?"
    lines = f"list_filter(list_transform(string_split_regex({raw}, '\\r\\n|[\\n\\r]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
    return f"""CASE WHEN regexp_replace({raw}, '^\\s+|\\s+$', '', 'g') IN ('0', '1') THEN regexp_replace({raw}, '^\\s+|\\s+$', '', 'g')
  WHEN len(list_filter({lines}, lambda s: regexp_matches(s, '{named}'))) > 0 THEN regexp_extract(list_filter({lines}, lambda s: regexp_matches(s, '{named}'))[1], '{named}', 1)
  WHEN regexp_matches(({lines})[1], '^[<\\[({{]?\\s*[01]\\s*[>\\])}}]?$') THEN regexp_extract(({lines})[1], '[01]', 0) END::BIGINT"""


def oracle_sql() -> dict[str, str]:
    clean_names = "email_id, base_email_id, model, prompt, parser, year_num, dataset_clean, obfuscation_clean, status_clean, parse_ok_bool, pred_label_num, ground_truth_num, fits_bool, input_tokens_num, overflow_tokens_num, parseable, detected_end_to_end, correct_reconstructed, correct_original_bool"
    distinct = "(SELECT count(DISTINCT model) * count(DISTINCT prompt) * count(DISTINCT parser) FROM broken)"
    per_email = f"per AS (SELECT base_email_id, count(*) AS n_rows, {distinct} AS expected_rows FROM broken GROUP BY 1)"
    line_names = ("l_returnflag", "l_linestatus", "o_orderpriority", "o_orderstatus")
    line_sets = [(n,) for n in line_names] + list(combinations(line_names, 2))
    ranking = lambda where: f"WITH {CLEAN}, s AS (SELECT model, prompt, parser, {_SUMS} FROM clean {where} GROUP BY ALL) SELECT *, {_measures()}, row_number() OVER (ORDER BY successes::DOUBLE / observations DESC, model, prompt, parser) AS observed_rank FROM s"
    names = dict(zip(FACTORS, ("Model", "Prompt", "Parser", "Collection year", "Dataset", "Obfuscation"), strict=True))
    level = lambda f: f"CASE {f}::VARCHAR WHEN 'evidence' THEN 'Evidence' WHEN 'guided' THEN 'Guided' WHEN 'label' THEN 'Label' WHEN 'no' THEN 'No' WHEN 'yes' THEN 'Yes' ELSE {f}::VARCHAR END"
    overall = " UNION ALL ".join(f"SELECT {k}::BIGINT AS position, '{names[f]}' AS Factor, {level(f)} AS Level, round(round_even(100 * sum(detected_end_to_end)::DOUBLE / count(*), 2), 6) AS \"Recall (%)\", sum(detected_end_to_end)::BIGINT AS Successes, count(*) AS Observations FROM clean GROUP BY {f}" for k, f in enumerate(FACTORS))
    mails = "mails AS (SELECT 'doc_' || doc_id || '_P1' AS email_id, doc_id, coalesce(text, '') AS text FROM documents)"
    asked = f"{mails}, asked AS (SELECT email_id, text, model_name, context_limit, prompt_id, template || chr(10) || chr(10) || 'E-mail:' || chr(10) || text AS prompt FROM mails, (VALUES {_MODELS}) m(model_name, context_limit), (VALUES {_PROMPTS}) p(prompt_id, template, pi))"
    words = "len(list_filter(string_split_regex({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) + 50"
    counted = f"{asked}, counted AS (SELECT *, {words.format('prompt')} AS input_tokens FROM asked)"
    keyword = "CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ("verify", "urgent", "password", "account", "token")) + " THEN 1 ELSE 0 END"
    answer = lambda new: f"answer AS (SELECT *, greatest(0, input_tokens + {new} - context_limit) AS overflow_tokens, input_tokens + {new} <= context_limit AS fits, {keyword} AS label FROM counted)"
    forms = ["LABEL: 1", "1", "LABEL: <1>", "classification - 1", "\n1", "Label = 1", "cannot tell", "", " 0 ", "text\nCLASS: [0]", "(1)", "LABEL: <0 or 1>", "LABEL: 10", "**LABEL:** 1", "\n\n1\nmore", "phishing", "mislabel: 1", "Prediction - 1", "label = <0>"]
    form_list = "[" + ", ".join("'" + f.replace("\n", "' || chr(10) || '") + "'" for f in forms) + "]"
    clean_text = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    fix_condition = "concat_ws('; ', " + ", ".join(f"'{f}=' || fixed_{f}" for f in REPEATED) + ")"
    return {
        "main_model": f"WITH {CLEAN}, s AS (SELECT model, {_SUMS} FROM clean GROUP BY 1) SELECT *, {_measures()} FROM s",
        "clean_experiment": f"WITH {CLEAN} SELECT {clean_names} FROM clean",
        "exact_duplicates": f"WITH {BROKEN}, u AS (SELECT count(*) AS c FROM broken GROUP BY ALL), g AS (SELECT count(*) AS c FROM broken GROUP BY {clean_names}) SELECT coalesce(sum(c - 1), 0)::BIGINT AS duplicate_rows FROM g",
        "duplicate_cells": f"WITH {BROKEN}, n AS (SELECT base_email_id, model, prompt, parser, detected_end_to_end, count(*) OVER (PARTITION BY base_email_id, model, prompt, parser) AS cell_rows FROM broken) SELECT * FROM n WHERE cell_rows > 1",
        "rows_per_email": f"WITH {BROKEN}, {per_email} SELECT *, n_rows = expected_rows AS complete FROM per",
        "rows_distribution": f"WITH {BROKEN}, {per_email} SELECT n_rows, count(*) AS n_emails FROM per GROUP BY 1",
        "missing_cells": f"WITH {BROKEN}, {per_email} SELECT p.base_email_id, m.model, r.prompt, q.parser FROM per p, (SELECT DISTINCT model FROM broken) m, (SELECT DISTINCT prompt FROM broken) r, (SELECT DISTINCT parser FROM broken) q WHERE n_rows <> expected_rows AND NOT EXISTS (SELECT 1 FROM broken b WHERE b.base_email_id = p.base_email_id AND b.model = m.model AND b.prompt = r.prompt AND b.parser = q.parser)",
        "metadata_inconsistencies": f"WITH {BROKEN}, v AS ({' UNION ALL '.join(f'SELECT base_email_id, {chr(39)}{c}{chr(39)} AS field, coalesce({c}::VARCHAR, {chr(39)}<null>{chr(39)}) AS value, row_id FROM broken' for c in BETWEEN)}), f AS (SELECT base_email_id, field, value, min(row_id) AS first_row FROM v GROUP BY ALL) SELECT base_email_id, field, count(*) AS n_values, string_agg(value, ' | ' ORDER BY first_row) AS found FROM f GROUP BY 1, 2 HAVING count(*) > 1",
        "first_per_email": f"WITH {CLEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY base_email_id ORDER BY model || '/' || prompt || '/' || parser) AS n FROM clean) SELECT base_email_id, model, prompt, parser, year_num, dataset_clean FROM r WHERE n = 1",
        "year_dataset_crosstab": f"WITH {CLEAN}, e AS (SELECT DISTINCT base_email_id, year_num, dataset_clean FROM clean) {_crosstab('year_num', 'dataset_clean', ['set_a', 'set_b'], 'e')}",
        "status_parse_crosstab": f"WITH {CLEAN} {_crosstab('status_clean', 'parse_ok_bool', ['false', 'true', 'NA'], 'clean')}",
        "fully_crossed": f"WITH {CLEAN}, c AS (SELECT count(DISTINCT year_num) AS levels_a, count(DISTINCT dataset_clean) AS levels_b, count(DISTINCT (year_num, dataset_clean)) AS cells FROM clean) SELECT *, levels_a > 1 AND levels_b > 1 AND cells = levels_a * levels_b AS fully_crossed FROM c",
        "failure_counters": f"WITH {CLEAN} SELECT count(*) AS n_rows, count(*) FILTER (pred_label_num IS NULL) AS missing_label, count(*) FILTER (status_clean <> 'ok') AS status_not_ok, count(*) FILTER (NOT parse_ok_bool) AS parse_failed, count(*) FILTER (parse_ok_bool IS NULL) AS parse_unknown, count(*) FILTER (NOT parseable) AS unparseable, count(*) FILTER (NOT fits_bool) AS over_context, count(*) FILTER (overflow_tokens_num > 0) AS overflowing, bool_and(ground_truth_num = 1) AS all_positive FROM clean",
        "correctness_mismatch": f"WITH {CLEAN} SELECT email_id, model, prompt, NOT correct_original_bool AS correct_original_bool, correct_reconstructed FROM clean WHERE doc_id % 29 = 0 AND correct_reconstructed IS NOT NULL",
        "label_counts": f"WITH {CLEAN} SELECT pred_label_num, count(*) AS n FROM clean GROUP BY 1",
        "sample_rows": f"WITH {CLEAN} SELECT base_email_id, model, prompt, parser, detected_end_to_end FROM clean ORDER BY 1, 2, 3, 4 LIMIT 50",
        "factorial_summary": f"WITH {CLEAN}, s AS ({_sets(SETS)}) SELECT *, {_measures()} FROM s",
        "factorial_lineitem": f"WITH o AS (SELECT l_orderkey, l_returnflag, l_linestatus, o_orderpriority, o_orderstatus, (l_discount > 0.05)::INT AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS ({_sets(line_sets, 'o', 'sum(y)::BIGINT AS successes, count(y) AS observations, count(DISTINCT l_orderkey) AS unique_emails')}) SELECT *, {_measures()} FROM s",
        "configuration_ranking": ranking(""),
        "parseable_ranking": ranking("WHERE parseable"),
        "parseable_main": f"WITH {CLEAN}, p AS (SELECT * FROM clean WHERE parseable), s AS ({_sets([(f,) for f in FACTORS], 'p')}) SELECT *, {_measures()} FROM s",
        "all_contrasts": f"WITH {CLEAN}, {_levels()}, {_CONTRASTS} SELECT * REPLACE (round(recall_a, 6) AS recall_a, round(recall_b, 6) AS recall_b, round(difference, 6) AS difference), round(difference * 100, 6) AS difference_percentage_points, round(abs(difference) * 100, 6) AS absolute_difference_percentage_points, CASE WHEN recall_b <> 0 THEN round(difference / recall_b * 100, 6) END AS relative_change_vs_b_pct FROM contrasts",
        "effect_ranges": f"WITH {CLEAN}, {_levels()}, r AS (SELECT *, row_number() OVER (PARTITION BY factor, moderator, moderator_level ORDER BY recall, level) AS lo, row_number() OVER (PARTITION BY factor, moderator, moderator_level ORDER BY recall DESC, level) AS hi FROM levels) SELECT factor, moderator, moderator_level, max(level) FILTER (lo = 1) AS minimum_level, max(level) FILTER (hi = 1) AS maximum_level, round(min(recall), 6) AS minimum_recall, round(max(recall), 6) AS maximum_recall, round(max(recall) - min(recall), 6) AS recall_range FROM r GROUP BY 1, 2, 3",
        "flagged_patterns": f"WITH {CLEAN}, {_levels()}, {_CONTRASTS} SELECT factor, moderator, moderator_level, level_a, level_b, round(abs(difference) * 100, 6) AS absolute_difference_percentage_points, CASE WHEN moderator = '' THEN 'overall' ELSE factor || '_within_' || moderator END AS analysis_scope, CASE WHEN moderator = '' THEN 'absolute observed difference >= 5.0 pp' ELSE 'absolute observed subgroup difference >= 5.0 pp' END AS reason FROM contrasts WHERE abs(difference) * 100 >= 5",
        "mcnemar_counts": f"WITH {CLEAN}, {_mcnemar()} SELECT * FROM mcnemar",
        "mcnemar_tests": f"WITH {CLEAN}, {_mcnemar()}, {_TESTED}, {_adjusted('tested', 'varying_factor, subgroup_factor')} SELECT * EXCLUDE (m, i) REPLACE (round(recall_a, 9) AS recall_a, round(recall_b, 9) AS recall_b, round(difference_percentage_points, 9) AS difference_percentage_points, round(p_value + 1e-12, 9) AS p_value, round(p_holm + 1e-12, 9) AS p_holm, round(p_fdr_bh + 1e-12, 9) AS p_fdr_bh) FROM adjusted",
        "between_counts": f"WITH {CLEAN}, {_between()} SELECT * FROM between_pairs",
        "between_statistics": f"WITH {CLEAN}, {_between()}, t AS (SELECT *, n_a + n_b AS n, successes_a + successes_b AS s, failures_a + failures_b AS f FROM between_pairs), x AS (SELECT *, least(n_a, n_b) * least(s, f)::DOUBLE / n AS least_expected FROM t) SELECT test_family, varying_factor, model, prompt, parser, conditioning_factor, conditioning_level, level_a, level_b, round((successes_a::DOUBLE / n_a - successes_b::DOUBLE / n_b) * 100, 9) AS difference_percentage_points, CASE WHEN successes_a * failures_b > 0 THEN round(failures_a * successes_b / (successes_a * failures_b)::DOUBLE, 9) END AS finite_odds_ratio, round(least_expected, 9) AS minimum_expected_count, CASE WHEN s > 0 AND f > 0 THEN round(n * pow((successes_a * failures_b - successes_b * failures_a)::DOUBLE, 2) / (n_a::DOUBLE * n_b * s * f), 9) END AS chi_square, CASE WHEN s = 0 OR f = 0 THEN 'No outcome variation' WHEN least_expected < 5 THEN 'Fisher exact' ELSE 'Pearson chi-square' END AS test_used FROM x",
        "notable_mcnemar": f"WITH {CLEAN}, {_mcnemar()}, {_TESTED}, {_adjusted('tested', 'varying_factor, subgroup_factor')} SELECT * EXCLUDE (m, i) REPLACE (round(recall_a, 9) AS recall_a, round(recall_b, 9) AS recall_b, round(difference_percentage_points, 9) AS difference_percentage_points, round(p_value + 1e-12, 9) AS p_value, round(p_holm + 1e-12, 9) AS p_holm, round(p_fdr_bh + 1e-12, 9) AS p_fdr_bh) FROM adjusted WHERE p_holm < 0.05 OR abs(difference_percentage_points) >= 5",
        "mcnemar_odds": f"WITH {CLEAN}, {_mcnemar()} SELECT varying_factor, level_a, level_b, subgroup_factor, subgroup_level, fixed_model, fixed_prompt, fixed_parser, CASE WHEN a_wrong_b_correct > 0 THEN round(a_correct_b_wrong::DOUBLE / a_wrong_b_correct, 6) END AS finite_odds_ratio, a_wrong_b_correct = 0 AND a_correct_b_wrong > 0 AS is_infinite FROM mcnemar",
        "merged_metadata": "SELECT 'doc_' || d.doc_id || '_P1' AS email_id, 'doc_' || d.doc_id AS base_email_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "configurations": f"WITH {CLEAN} SELECT model || ' | ' || prompt || ' | ' || parser AS configuration, year_num || '_' || dataset_clean AS collection, count(*) AS n FROM clean GROUP BY 1, 2",
        "table_overall": f"WITH {CLEAN} {overall}",
        "table_model_prompt": _pivot("model", "prompt", ["evidence", "guided", "label"]),
        "table_model_parser": _pivot("model", "parser", ["P1", "P2"], ("P1", "P2")),
        "table_parser_obfuscation": _pivot("parser", "obfuscation_clean", ["no", "yes"], ("yes", "no")),
        "table_parser_dataset": _pivot("parser", "dataset_clean", ["set_a", "set_b"], ("set_a", "set_b")),
        "table_dataset_year": _pivot("dataset_clean", "year_num", ["2023", "2025"], ("2025", "2023")),
        "table_ranking": f"WITH r AS ({ranking('')}) SELECT observed_rank AS Rank, model AS Model, upper(prompt[1]) || prompt[2:] AS Prompt, parser AS Parser, successes AS Successes, observations AS Observations, round_even(100 * successes::DOUBLE / observations, 2) AS \"Recall (%)\" FROM r",
        "table_mcnemar": f"WITH {CLEAN}, {_mcnemar()}, {_TESTED}, {_adjusted('tested', 'varying_factor, subgroup_factor')} SELECT varying_factor AS Factor, level_a || ' vs ' || level_b AS Comparison, {fix_condition} AS Condition, n_pairs AS Pairs, round_even(recall_a * 100, 2) AS RecallA, round_even(recall_b * 100, 2) AS RecallB, round_even(difference_percentage_points, 2) AS Difference, a_correct_b_wrong || '/' || a_wrong_b_correct AS Discordant, {_FORMAT_P.format('p_value')} AS raw_p, {_FORMAT_P.format('p_holm')} AS holm_p, {_FORMAT_P.format('p_fdr_bh')} AS fdr_p FROM adjusted WHERE subgroup_factor = 'all'",
        "parse_labels": f"WITH r AS (SELECT doc_id, {form_list}[doc_id % {len(forms)} + 1] AS raw_output FROM documents), l AS (SELECT *, {_label('raw_output')} AS pred_label FROM r) SELECT *, pred_label IS NOT NULL AS parse_ok FROM l",
        "prompt_build": f"WITH f AS (SELECT doc_id, prompt_id, template || chr(10) || chr(10) || 'E-mail:' || chr(10) || coalesce(text, '') AS x FROM documents, (VALUES {_PROMPTS}) p(prompt_id, template, pi)) SELECT doc_id, prompt_id, length(x) AS prompt_chars, md5(x) AS prompt_md5 FROM f",
        "context_accounting": f"WITH {counted} SELECT email_id, model_name, prompt_id, input_tokens, input_tokens + 130000 AS total_tokens, greatest(0, input_tokens + 130000 - context_limit) AS overflow_tokens, input_tokens + 130000 <= context_limit AS fits FROM counted",
        "status_machine": f"WITH {counted}, {answer(127_500)} SELECT model_name, prompt_id, CASE WHEN fits THEN 'ok' ELSE 'skipped_over_context' END AS status, fits AS parse_ok, CASE WHEN fits THEN label END::BIGINT AS pred_label, count(*) AS n FROM answer GROUP BY ALL",
        "status_states": f"WITH {counted}, {answer(127_500)}, x AS (SELECT *, length(text) % 3 = 0 AS fails, CASE WHEN fits THEN '' ELSE '_over_context' END AS tail FROM answer) SELECT model_name, prompt_id, CASE WHEN fails THEN 'generation_error' || tail || ':ValueError' ELSE 'ok' || tail END AS status, NOT fails AS parse_ok, CASE WHEN NOT fails THEN label END::BIGINT AS pred_label, count(*) AS n FROM x GROUP BY ALL",
        "llm_rows": f"WITH {counted}, {answer(256)} SELECT email_id, 'P1' AS parser_id, model_name, prompt_id, context_limit::BIGINT AS context_limit, input_tokens, overflow_tokens, fits, CASE WHEN fits THEN 'ok' ELSE 'skipped_over_context' END AS status, CASE WHEN fits THEN 'LABEL: ' || label ELSE '' END AS raw_output, fits AS parse_ok, CASE WHEN fits THEN label END::BIGINT AS pred_label FROM answer",
        "conversation_tokens": f"SELECT conv_id, role, sum({words.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} - 50)::BIGINT AS tokens, count(*) AS turns FROM conversations GROUP BY 1, 2",
        "lexicon_zipf": "WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2) SELECT lang, word, n, round(log10(n * 1e9 / sum(n) OVER (PARTITION BY lang)), 6) AS zipf FROM c",
        "page_comments": r"WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<!--((?s:.*?))-->', 1)) AS text FROM pages) SELECT page_id, trim(text) AS text, count(*) AS n FROM c GROUP BY 1, 2",
        "nearest_visible": f"""WITH e AS (SELECT user_id AS key, event_id AS frag_idx, ' ' || event_type || '  x' AS text, event_type <> 'purchase' AS visible, event_id % 7 = 0 AS comment FROM events),
c AS (SELECT *, {clean_text} AS clean FROM e),
s AS (SELECT *, (NOT visible AND (coalesce(lag(visible) OVER w, true) OR comment OR coalesce(lag(comment) OVER w, false)))::INT AS starts, CASE WHEN visible AND clean <> '' THEN text END AS seen FROM c WINDOW w AS (PARTITION BY key ORDER BY frag_idx))
SELECT key, frag_idx, clean, CASE WHEN NOT visible THEN sum(starts) OVER (PARTITION BY key ORDER BY frag_idx ROWS UNBOUNDED PRECEDING) END::BIGINT AS run_id,
  last_value(seen IGNORE NULLS) OVER (PARTITION BY key ORDER BY frag_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_visible,
  first_value(seen IGNORE NULLS) OVER (PARTITION BY key ORDER BY frag_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_visible FROM s""",
        "event_runs": f"""WITH e AS (SELECT user_id AS key, event_id AS frag_idx, ' ' || event_type || '  x' AS text, event_type <> 'purchase' AS visible, event_id % 7 = 0 AS comment FROM events),
c AS (SELECT *, {clean_text} AS clean FROM e),
s AS (SELECT *, (NOT visible AND (coalesce(lag(visible) OVER w, true) OR comment OR coalesce(lag(comment) OVER w, false)))::INT AS starts, CASE WHEN visible AND clean <> '' THEN text END AS seen FROM c WINDOW w AS (PARTITION BY key ORDER BY frag_idx)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY frag_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id,
  last_value(seen IGNORE NULLS) OVER (PARTITION BY key ORDER BY frag_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  first_value(seen IGNORE NULLS) OVER (PARTITION BY key ORDER BY frag_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM s),
g AS (SELECT key, run_id, min(frag_idx) AS first_idx, count(*) AS n_fragments, string_agg(clean, ' ' ORDER BY frag_idx) AS hidden_text, bool_and(comment) AS is_comment, bool_and(clean = '') AS only_blanks,
  first(prev ORDER BY frag_idx) AS prev_visible, first(next ORDER BY frag_idx DESC) AS next_visible FROM r WHERE NOT visible GROUP BY 1, 2)
SELECT *, coalesce(regexp_matches(prev_visible, '[A-Za-z]+\\s*$') AND regexp_matches(next_visible, '^\\s*[A-Za-z]+'), false) AS splits_word FROM g""",
        "incremental_new_files": "SELECT page_id, url AS path FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)",
        "wilson_orders": f"WITH o AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS s, count(*) AS n FROM orders GROUP BY 1) SELECT *, round({_interval('s', 'n', '-')}, 6) AS wilson_low, round({_interval('s', 'n', '+')}, 6) AS wilson_high FROM o",
    }
