"""Operator 9: secrets by an incremental ledger of content-addressed blobs, in DataFrame functions.

Every version of every path is a blob, known by the SHA-256 of its bytes. The ledger (a Parquet
folder that only grows) holds, for each blob and rule version that was ever scanned, the
spans found, also when there are none. A scan takes the pairs of blob and rule version that the
ledger lacks, reads each such blob's text once however many paths hold it, appends what it finds, and
joins the ledger's findings back to all paths. A changed rule gets a new version and is scanned anew;
old blobs are not.

Base rules (assign, access, hex) keep their spans as matched and filtered; further rules for
well-known credential formats add spans.

Defined results: a null text is the empty blob; rows with a null id and repeated rows each get
the findings of their blob; a scan that was cut off leaves whole append runs only (Spark's commit),
and pairs that two runs both scanned count once; positions are code points, end exclusive; an empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm import scratch
from mailgauge.llm.group_join import join_groups
from mailgauge.llm.native_spans import matches


@dataclass(frozen=True)
class Rule:
    """``pattern``: Java; ``plain``: the same matches in RE2; ``group``, ``least``: that group has so many characters at least."""

    name: str
    version: int
    pattern: str
    plain: str
    hint: str | None = None
    group: int = 0
    least: int = 0


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api"))
_KEY = _WORDS + "_?" + _any_case("key")

# Fixed patterns: three base rules, then formats that issuers of credentials publish.
RULES = (
    Rule("assign", 1, rf"""({_KEY})["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None, 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}+", "AKIA[A-Z0-9]{16,}", "AKIA"),
    Rule("hex", 1, "[0-9a-f]{24,}+", "[0-9a-f]{24,}"),
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}+", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}+", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    Rule("google_key", 1, "AIza[0-9A-Za-z_-]{35}", "AIza[0-9A-Za-z_-]{35}", "AIza"),
)
BASE = ("assign", "access", "hex")
_LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"


def _spans(rule: Rule, text):
    found = matches(text, rule.name, rule.pattern, rule.hint)
    if rule.least:
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["hit"], f"^{rule.pattern}", rule.group)) >= rule.least)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.range(0).selectExpr("cast(null as binary) as blob", "cast(null as string) as rule", "cast(null as int) as version", "cast(null as array<struct<start:int,end:int>>) as spans")
    return spark.read.schema(_LEDGER).parquet(path)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> int:
    """Scan what the ledger at ``ledger`` lacks, append it, and return the number of blob and rule-version pairs scanned."""
    spark = versions.sparkSession
    blobs = versions.select(F.unhex(F.sha2(scratch.text_or_empty(text_col), 256)).alias("blob"), scratch.text_or_empty(text_col).alias("text"))
    wanted = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    known = _ledger(spark, ledger).join(F.broadcast(spark.range(1).select(F.explode(wanted).alias("w")).select("w.*")), ["rule", "version"])
    known = known.groupBy("blob").agg(F.collect_set("rule").alias("known"))  # at most one entry per rule
    fresh = not known.isEmpty()
    once = blobs.join(known.where(F.size("known") == len(rules)).select("blob"), "blob", "left_anti") if fresh else blobs
    once = once.groupBy("blob", "text").agg(F.lit(1).alias("one")).drop("one")
    once = once.join(known, "blob", "left") if fresh else once.withColumn("known", F.lit(None).cast("array<string>"))
    open_rule = lambda r: F.coalesce(~F.array_contains("known", r.name), F.lit(True))
    pairs = F.array(*(F.when(open_rule(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), _spans(r, F.col("text")).alias("spans"))) for r in rules))
    found = once.select("blob", F.explode(pairs).alias("f")).where("f is not null").select("blob", "f.*")
    before = _ledger(spark, ledger).count() if fresh else 0
    found.write.mode("append").option("compression", "zstd").parquet(ledger)
    return _ledger(spark, ledger).count() - before


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``versions``: doc_id, blob and ``spans`` (start, rank of the rule, kind, end), sorted."""
    spark = versions.sparkSession
    rank = reduce(lambda c, r: c.when((F.col("rule") == r[1].name) & (F.col("version") == r[1].version), r[0]), list(enumerate(rules)), F.when(F.lit(False), 0))
    rows = versions.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(scratch.text_or_empty(text_col), 256)).alias("blob"))
    own = _ledger(spark, ledger).withColumn("rank", rank).where("rank is not null and size(spans) > 0").dropDuplicates(["blob", "rank"])
    own = own.select("blob", F.expr("transform(spans, s -> struct(s.start as start, rank as rank, rule as kind, s.end as end))").alias("own"))
    per_blob = own.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("spans"))  # one list per rule
    sizes = rows.groupBy("blob").agg(F.count("*").alias("group_size"))
    groups = scratch.saved(sizes.join(per_blob, "blob", "left"), "op9-groups")
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return join_groups(rows, groups, ["blob"]).select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = scratch.table(spark, sf_dir, "documents"), scratch.fresh_path(spark, "op9-ledger")
    scan(docs, ledger)
    found = findings(docs, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    def literal(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    columns, lists = [], []
    for k, r in enumerate(rules):
        columns.append(f"regexp_extract_all(t, {literal(r.plain)}) AS m{k}, string_split_regex(t, {literal(r.plain)}) AS p{k}")
        place = f"list_sum(list_transform(p{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i-1], lambda x: length(x))), 0)"
        keep = f"length(regexp_extract(m{k}[i], {literal('^' + r.plain)}, {r.group})) >= {r.least}" if r.least else "true"
        lists.append(f"list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: {keep}), lambda i: {{'s': ({place})::BIGINT, 'r': {k}, 'k': '{r.name}', 'e': ({place} + length(m{k}[i]))::BIGINT}})")
    joined = lambda which: f"coalesce(list_aggregate(list_transform({which}, lambda f: f.k || ':' || f.s || ':' || f.e), 'string_agg', ','), '')"
    counts = ", ".join(f"len(list_filter(a, lambda f: f.k = '{k}'))::BIGINT AS n_{k}" for k in BASE)
    base = joined(f"list_filter(a, lambda f: f.r < {len(BASE)})")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(columns)} FROM d),
f AS (SELECT doc_id, list_sort(flatten([{', '.join(lists)}])) AS a FROM m)
SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {joined('a')} AS spans FROM f
"""
