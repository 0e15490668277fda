"""Named queries over the testdata tables: every operator at least once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.functions.columns import parsed_label
from mailgauge.functions.stats import wilson
from mailgauge.operators import classify, embedding, factorial, gee, hidden, mime, pairwise, tables, validate
from mailgauge.operators.clean import BETWEEN, FACTORS, KEY, clean, complete, merge_metadata, prepare
from mailgauge.operators.registry import prompt_column, prompts
from mailgauge.session import load, saved
from mailgauge.sources import synthetic
from mailgauge.sources.experiment import ANSWERS, experiment, lineitem_experiment
from mailgauge.sources.files import unprocessed

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed decimals and integers to long, so engines can be compared."""
    cast = {"double": lambda c: F.round(F.col(c), digits), "int": lambda c: F.col(c).cast("long")}
    return df.select(*(cast.get(kind, F.col)(f"`{c}`").alias(c) for c, kind in df.dtypes))


def _off_ties(df: DataFrame) -> DataFrame:
    """p-values moved by 1e-12: exact ones end in a 5 that two engines round apart."""
    return df.withColumns({c: F.col(c) + 1e-12 for c in ("p_value", "p_holm", "p_fdr_bh")})


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean(experiment(spark, sf))


def _ready(spark: SparkSession, sf: str) -> DataFrame:
    """The complete rows with what the tests read, written once."""
    return saved(complete(_clean(spark, sf)).select(*KEY, *BETWEEN, "detected_end_to_end", "parseable"), "ready")


def _number(c: str = "base_email_id"):
    return F.regexp_extract(c, "[0-9]+$", 0).cast("long")


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    """The clean table with faults: repeated rows, contradicting cells, missing cells, changed metadata; with row_id."""
    rows = _clean(spark, sf)
    twice = rows.unionByName(rows.where(_number() % 11 == 0))
    again = rows.where(_number() % 17 == 0).withColumn("detected_end_to_end", 1 - F.col("detected_end_to_end"))
    rows = twice.unionByName(again).where(~((_number() % 13 == 0) & (F.col("model") == "Qwen") & (F.col("prompt") == "label")))
    rows = rows.withColumn("dataset_clean", F.when((_number() % 19 == 0) & (F.col("parser") == "P2"), F.lit(None).cast("string")).otherwise(F.col("dataset_clean")))
    rows = rows.withColumn("year_num", F.when((_number() % 23 == 0) & (F.col("model") == "Qwen"), 2024).otherwise(F.col("year_num")))
    order = F.when(F.col("model") == "Llama", 0).otherwise(6) + F.when(F.col("prompt") == "label", 0).when(F.col("prompt") == "guided", 2).otherwise(4) + F.when(F.col("parser") == "P1", 0).otherwise(1)
    return saved(rows.withColumn("row_id", (_number() * 12 + order).cast("long")), "broken")


def main_model(spark, sf):
    return _rounded(factorial.summarise(prepare(_clean(spark, sf)), ["model"]))


def clean_experiment(spark, sf):
    names = ["email_id", *KEY, *("year_num", "dataset_clean", "obfuscation_clean", "status_clean", "parse_ok_bool", "pred_label_num", "ground_truth_num", "fits_bool", "input_tokens_num", "overflow_tokens_num", "parseable", "detected_end_to_end", "correct_reconstructed", "correct_original_bool")]
    return _rounded(_clean(spark, sf).select(*names))


def exact_duplicates(spark, sf):
    return _rounded(validate.exact_duplicates(_broken(spark, sf).drop("row_id")))


def duplicate_cells(spark, sf):
    return _rounded(validate.duplicate_cells(_broken(spark, sf)).select(*KEY, "detected_end_to_end", "cell_rows"))


def rows_per_email(spark, sf):
    return _rounded(validate.rows_per_email(_broken(spark, sf)))


def rows_distribution(spark, sf):
    return _rounded(validate.rows_distribution(_broken(spark, sf)))


def missing_cells(spark, sf):
    return validate.missing_cells(_broken(spark, sf)).select(*KEY)


def metadata_inconsistencies(spark, sf):
    return _rounded(validate.metadata_inconsistencies(_broken(spark, sf), ("year_num", "dataset_clean", "obfuscation_clean")))


def first_per_email(spark, sf):
    return _rounded(validate.first_per_email(_clean(spark, sf).withColumn("row_id", F.concat_ws("/", "model", "prompt", "parser"))).select("base_email_id", "model", "prompt", "parser", "year_num", "dataset_clean"))


def year_dataset_crosstab(spark, sf):
    emails = _clean(spark, sf).select("base_email_id", "year_num", "dataset_clean").distinct()
    return validate.crosstab(emails, "year_num", "dataset_clean", ["set_a", "set_b"])


def status_parse_crosstab(spark, sf):
    return validate.crosstab(_clean(spark, sf), "status_clean", "parse_ok_bool", ["false", "true", "NA"])


def fully_crossed(spark, sf):
    return _rounded(validate.fully_crossed(_clean(spark, sf), "year_num", "dataset_clean"))


def failure_counters(spark, sf):
    return _rounded(validate.failure_counters(_clean(spark, sf)))


def correctness_mismatch(spark, sf):
    rows = _clean(spark, sf).withColumn("correct_original_bool", F.when(_number() % 29 == 0, ~F.col("correct_original_bool")).otherwise(F.col("correct_original_bool")))
    return _rounded(validate.correctness_mismatch(rows).select("email_id", "model", "prompt", "correct_original_bool", "correct_reconstructed"))


def label_counts(spark, sf):
    return _rounded(validate.value_counts(_clean(spark, sf), "pred_label_num"))


def sample_rows(spark, sf):
    return _rounded(validate.sample_rows(_clean(spark, sf)).select(*KEY, "detected_end_to_end"))


def factorial_summary(spark, sf):
    return _rounded(factorial.summarise_sets(prepare(_clean(spark, sf)), factorial.factor_sets()))


def factorial_lineitem(spark, sf):
    names = ("l_returnflag", "l_linestatus", "o_orderpriority", "o_orderstatus")
    sets = [(n,) for n in names] + [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return _rounded(factorial.summarise_sets(lineitem_experiment(spark, sf), sets, "outcome", "cluster"))


def configuration_ranking(spark, sf):
    return _rounded(factorial.configuration_ranking(prepare(_clean(spark, sf))))


def parseable_ranking(spark, sf):
    return _rounded(factorial.configuration_ranking(prepare(_clean(spark, sf)).where("parseable")))


def parseable_main(spark, sf):
    return _rounded(factorial.summarise_sets(prepare(_clean(spark, sf)).where("parseable"), [(f,) for f in FACTORS]))


def _levels(spark, sf):
    return factorial.all_levels(factorial.summarise_sets(prepare(_clean(spark, sf)), factorial.factor_sets()))


def all_contrasts(spark, sf):
    return _rounded(factorial.contrasts(_levels(spark, sf)))


def effect_ranges(spark, sf):
    return _rounded(factorial.effect_ranges(_levels(spark, sf)))


def flagged_patterns(spark, sf):
    return _rounded(factorial.flagged(factorial.contrasts(_levels(spark, sf))).select("factor", "moderator", "moderator_level", "level_a", "level_b", "absolute_difference_percentage_points", "analysis_scope", "reason"))


def mcnemar_counts(spark, sf):
    return _rounded(pairwise.mcnemar_counts(_ready(spark, sf)))


def mcnemar_tests(spark, sf):
    return _rounded(_off_ties(pairwise.mcnemar_tests(_ready(spark, sf)).drop("matched_odds_ratio")), 9)


def between_counts(spark, sf):
    return _rounded(pairwise.between_counts(_ready(spark, sf)))


def between_tests(spark, sf):
    return _rounded(pairwise.between_tests(_ready(spark, sf)), 9)


def between_statistics(spark, sf):
    """What of the between-e-mail tests needs no p-value."""
    tests = pairwise.between_tests(_ready(spark, sf))
    finite = F.when(F.col("successes_a") * F.col("failures_b") > 0, F.col("odds_ratio")).alias("finite_odds_ratio")
    return _rounded(tests.select("test_family", "varying_factor", "model", "prompt", "parser", "conditioning_factor", "conditioning_level", "level_a", "level_b", "difference_percentage_points", finite, "minimum_expected_count", "chi_square", "test_used"), 9)


def notable_mcnemar(spark, sf):
    return _rounded(_off_ties(pairwise.notable(pairwise.mcnemar_tests(_ready(spark, sf)).drop("matched_odds_ratio"))), 9)


def notable_between(spark, sf):
    return _rounded(pairwise.notable(pairwise.between_tests(_ready(spark, sf))))


def mcnemar_odds(spark, sf):
    tests, ratio = pairwise.mcnemar_tests(_ready(spark, sf)), F.col("matched_odds_ratio")
    names = ("varying_factor", "level_a", "level_b", "subgroup_factor", "subgroup_level", "fixed_model", "fixed_prompt", "fixed_parser")
    infinite = F.coalesce(ratio == float("inf"), F.lit(False))
    return _rounded(tests.select(*names, F.when(~infinite, ratio).alias("finite_odds_ratio"), infinite.alias("is_infinite")))


def merged_metadata(spark, sf):
    """Answers joined with what is known of their e-mails."""
    known = load(spark, sf, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("base_email_id"), F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return merge_metadata(_mails(spark, sf).select("email_id"), known).select("email_id", "base_email_id", "quality", "toxic")


def configurations(spark, sf):
    return prepare(_clean(spark, sf)).groupBy("configuration", "collection").agg(F.count("*").alias("n"))


def gee_coefficients(spark, sf):
    return _rounded(gee.run_models(_ready(spark, sf))[0].drop("formula"), 5)


def gee_metadata(spark, sf):
    return _rounded(gee.run_models(_ready(spark, sf))[1], 4)


def gee_main_table(spark, sf):
    return tables.gee_table(gee.run_models(_ready(spark, sf), specs={"main_effects": gee.specifications()["main_effects"]})[0], "main_effects", False)


def _combined(spark, sf):
    name = "combined_key_interactions"
    return tables.gee_table(gee.run_models(_ready(spark, sf), specs={name: gee.specifications()[name]})[0], name, True)


def gee_interactions_table(spark, sf):
    return _combined(spark, sf)


def model_selection_table(spark, sf):
    return tables.model_selection(gee.run_models(_ready(spark, sf))[1])


def _sets(spark, sf):
    return factorial.summarise_sets(prepare(_clean(spark, sf)), factorial.factor_sets())


def table_overall(spark, sf):
    return _rounded(tables.overall_recall(_sets(spark, sf)))


def table_model_prompt(spark, sf):
    return tables.condition_table(_sets(spark, sf), "model", "prompt", ["evidence", "guided", "label"])


def table_model_parser(spark, sf):
    return tables.condition_table(_sets(spark, sf), "model", "parser", ["P1", "P2"], ("P1", "P2"))


def table_parser_obfuscation(spark, sf):
    return tables.condition_table(_sets(spark, sf), "parser", "obfuscation_clean", ["no", "yes"], ("yes", "no"))


def table_parser_dataset(spark, sf):
    return tables.condition_table(_sets(spark, sf), "parser", "dataset_clean", ["set_a", "set_b"], ("set_a", "set_b"))


def table_dataset_year(spark, sf):
    return tables.condition_table(_sets(spark, sf), "dataset_clean", "year_num", ["2023", "2025"], ("2025", "2023"))


def table_ranking(spark, sf):
    return _rounded(tables.ranking_table(factorial.configuration_ranking(prepare(_clean(spark, sf)))))


def table_mcnemar(spark, sf):
    return _rounded(tables.selected_mcnemar(pairwise.mcnemar_tests(_ready(spark, sf))))


def parse_labels(spark, sf):
    """All answer forms, and some that are none, around every document id."""
    forms = [*(a.format("1") for a in ANSWERS), "", " 0 ", "text\nCLASS: [0]", "(1)", "LABEL: <0 or 1>", "LABEL: 10", "**LABEL:** 1", "\n\n1\nmore", "phishing", "mislabel: 1", "Prediction - 1", "label = <0>"]
    docs = load(spark, sf, "documents").select("doc_id")
    raw = F.element_at(F.array(*map(F.lit, forms)), (F.col("doc_id") % len(forms)).cast("int") + 1)
    return _rounded(docs.select("doc_id", raw.alias("raw_output"), parsed_label(raw).alias("pred_label"), parsed_label(raw).isNotNull().alias("parse_ok")))


def _mails(spark, sf):
    docs = load(spark, sf, "documents")
    return docs.select(F.concat(F.lit("doc_"), "doc_id", F.lit("_P1")).alias("email_id"), F.lit("P1").alias("parser_id"), F.coalesce("text", F.lit("")).alias("text"))


def prompt_build(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    full = prompt_column(F.col("template"), F.col("text"))
    return docs.crossJoin(F.broadcast(prompts(spark))).select("doc_id", "prompt_id", F.length(full).cast("long").alias("prompt_chars"), F.md5(full).alias("prompt_md5"))


def context_accounting(spark, sf):
    return _rounded(classify.with_context(classify.expanded(_mails(spark, sf)), 130_000).select("email_id", "model_name", "prompt_id", "input_tokens", "total_tokens", "overflow_tokens", "fits"))


def status_machine(spark, sf):
    out = classify.run_models(_mails(spark, sf), max_new_tokens=127_500)
    return _rounded(out.groupBy("model_name", "prompt_id", "status", "parse_ok", "pred_label").agg(F.count("*").alias("n")))


def status_states(spark, sf):
    """All states of an answer but the skipped one: a scorer that fails on some e-mails, asked beyond its context too."""
    out = classify.run_models(_mails(spark, sf), scorer="fragile", max_new_tokens=127_500, allow_over_context=True)
    return _rounded(out.groupBy("model_name", "prompt_id", "status", "parse_ok", "pred_label").agg(F.count("*").alias("n")))


def llm_rows(spark, sf):
    return _rounded(classify.run_models(_mails(spark, sf)))


def conversation_tokens(spark, sf):
    turns = load(spark, sf, "conversations").select("conv_id", "role", (classify.token_count(F.coalesce("text", F.lit(""))) - 50).alias("tokens"))
    return _rounded(turns.groupBy("conv_id", "role").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("turns")))


def lexicon_zipf(spark, sf):
    return _rounded(embedding.lexicon(load(spark, sf, "documents")).select("lang", "word", "n", "zipf"))


def page_comments(spark, sf):
    found = hidden.fragment_rows(hidden.detected(load(spark, sf, "pages").select("page_id", "html")), "page_id")
    return found.where("type = 'html_comment'").groupBy("page_id", "text").agg(F.count("*").alias("n"))


def clean_html_text(spark, sf):
    return load(spark, sf, "pages").select("page_id", mime.clean_html("html").alias("text"))


def _found(spark, sf):
    """Fragments of all pages; the detector runs once whatever is made of them."""
    return saved(hidden.detected(synthetic.pages_with_hidden_text(spark, sf)), "found")


def hidden_fragments(spark, sf):
    return hidden.fragment_rows(_found(spark, sf), "email_file").select("email_file", "frag_idx", "text", "type", "url", "visible", F.array_join("hidden_reasons", " | ").alias("reasons"))


def hidden_runs(spark, sf):
    rows = embedding.with_runs(hidden.fragment_rows(_found(spark, sf), "email_file"), "email_file")
    return embedding.hidden_runs(rows, "email_file")


def _event_fragments(spark, sf):
    """Events as fragments: a user's events in order, purchases hidden."""
    events = load(spark, sf, "events")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").cast("int").alias("frag_idx"), F.concat(F.lit(" "), "event_type", F.lit("  x")).alias("text"), (F.col("event_type") != "purchase").alias("visible"), F.when(F.col("event_id") % 7 == 0, "html_comment").otherwise("text").alias("type"))


def event_runs(spark, sf):
    return _rounded(embedding.hidden_runs(embedding.with_runs(_event_fragments(spark, sf), "key"), "key"))


def nearest_visible(spark, sf):
    """Runs and neighbours over events as fragments."""
    return _rounded(embedding.with_runs(_event_fragments(spark, sf), "key").select("key", "frag_idx", "clean", "run_id", "prev_visible", "next_visible"))


def _words(spark, sf):
    frequent = embedding.lexicon(load(spark, sf, "documents")).where(F.col("zipf") >= embedding.MIN_ZIPF)
    return {r["word"] for r in frequent.select("word").distinct().collect()}  # at most a million words of zipf 3 or more per language exist


def _hidden(spark, sf):
    found = _found(spark, sf)
    return found, embedding.classified(hidden.fragment_rows(found, "email_file"), _words(spark, sf), "email_file")


def embedding_strategy(spark, sf):
    return _hidden(spark, sf)[1].select("email_file", "frag_idx", "type", "embedding_strategy")


def strategy_counts(spark, sf):
    return embedding.strategy_counts(_hidden(spark, sf)[1], "email_file")


def hidden_summary(spark, sf):
    found, rows = _hidden(spark, sf)
    return hidden.email_summary(found.select("email_file", "html"), found, rows)


def hidden_flag_emails(spark, sf):
    return hidden.flag_emails(hidden_summary(spark, sf))


def hidden_corpus_stats(spark, sf):
    return hidden.corpus_stats(hidden_summary(spark, sf))


def email_pipeline(spark, sf):
    """Raw messages to summary rows: MIME, detection, embedding, flags."""
    parsed = mime.parsed(synthetic.messages(spark, sf))
    found = saved(hidden.detected(parsed.select("email_file", "html")), "found")
    rows = embedding.classified(hidden.fragment_rows(found, "email_file"), _words(spark, sf), "email_file")
    return hidden.email_summary(found.select("email_file", "html"), found, rows)


def parser_texts(spark, sf):
    out = mime.parser_texts(mime.parsed(synthetic.messages(spark, sf)), "email_file")
    return out.select("email_file", "parser_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def incremental_new_files(spark, sf):
    pages = load(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    log = pages.where("page_id % 3 = 0").select(F.concat("path", F.lit("\tdone\tok")).alias("value"))
    return unprocessed(pages, log)


def wilson_orders(spark, sf):
    orders = load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count("*").alias("n"))
    low, high = wilson(F.col("s"), F.col("n"))
    return _rounded(orders.select("o_orderpriority", "s", "n", low.alias("wilson_low"), high.alias("wilson_high")))


_HELPERS = {"clean", "complete", "prepare", "experiment", "lineitem_experiment", "load", "merge_metadata", "parsed_label", "prompt_column", "prompts", "saved", "unprocessed", "wilson"}


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if callable(f) and not name.startswith("_") and name not in _HELPERS and name != "queries" and getattr(f, "__module__", "") == __name__}
