"""Operator 7: personal data by boosted trees over candidate spans, in DataFrame functions.

Generators with high recall propose overlapping spans: the four base kinds (email, ip, card, phone),
whose valid matches always stay, and looser ones (spelled-out addresses, local phone numbers,
bank and social security numbers, card-like digits). Boosted trees over format features
(lengths, digits, separators, check digits) and context features (words and characters
around) score each loose span; a threshold per kind, calibrated for precision on held-out examples,
selects spans, and a selected span that overlaps a base span or an earlier selected one
yields to it.

The trees are trained here, on the driver, and become CASE expressions, so texts never leave the
JVM. No table marks personal data, so the examples are generated spans (personal data and look-alikes,
with and without a word that tells) put into text of the documents: ``CONTEXTS`` stretches of
``CONTEXT_CHARS`` characters, the smallest by a hash of the text. The thresholds come from other spans in other
stretches, most of them behind words that no training example has. Features come from the same DataFrame expressions.

``redact`` replaces exactly the spans that ``find`` selects; what overlaps is one stretch.

Defined results: a null text is empty (no spans, the digest of the empty string); rows with
a null id and repeated rows are scanned one by one; positions are code points, end exclusive; an empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm import scratch
from mailgauge.llm.native_spans import let, listed, matches, spliced

_LOCAL = "A-Za-z0-9._%+-"
#: Kind: (pattern, hint). Possessive parts never give back what the next part could not take anyway;
#: the look-behinds keep a match from starting inside a run whose start did not match, and \\G lets one start where the last ended.
BASE = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Looser generators of the kinds that only the trees can decide.
LOOSE = {
    "email_spelled": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40} ?[\[(]?(?: at |@)[\])]? ?[A-Za-z0-9-]{2,40} ?[\[(]?(?: dot |\.)[\])]? ?[A-Za-z]{2,10}\b", r" at |@"),
    "phone_local": (r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"[0-9]{3}[ .-][0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])", r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "card_like": (r"(?<![0-9-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9-])", r"[0-9]{4}(?:[ -][0-9]{4}){3}"),
}
#: Bounds of the stretches of documents that examples are put into.
CONTEXTS, CONTEXT_CHARS = 400, 120
#: Words that stand before personal data, and before other numbers.
_FOR = r"(?i)(?:call|phone|tel|fax|mobile|cell|contact|reach|mail|e-mail|write|ssn|social|security|iban|account|bank|card|visa|pay|credit)"
_AGAINST = r"(?i)(?:order|invoice|isbn|version|ref|page|part|serial|item|ticket|build|model|sku|doi|figure|table|no\.|#)"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid(span: Column, kind: str) -> Column:
    """Whether a base match stays."""
    hit = span["hit"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = _digits(hit)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits) <= 19, F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def _valid(kind: str):
    return lambda span: valid(span, kind)


FEATURES = ("kind", "length", "digits", "signs", "letters", "distinct", "luhn", "for", "against", "glued", "open", "dot", "sentence")


def features(span: Column) -> list[Column]:
    """Numbers that describe a loose span and its surroundings."""
    hit, digits = span["hit"], _digits(span["hit"])
    number = lambda c: c.cast("double")
    return [
        number(reduce(lambda c, k: c.when(span["kind"] == k[1], k[0]), list(enumerate(LOOSE))[1:], F.when(span["kind"] == list(LOOSE)[0], 0))),
        number(F.length(hit)),
        number(F.length(digits)),
        number(F.length(F.regexp_replace(hit, "[^ ().-]", ""))),
        number(F.length(F.regexp_replace(hit, "[^A-Za-z]", ""))),
        number(F.size(F.array_distinct(F.split(digits, "")))),
        number(F.when(F.length(digits).between(2, 30), F.call_function("luhn_check", digits)).otherwise(F.lit(False)).cast("int")),
        number(span["before"].rlike(_FOR).cast("int")),
        number(span["before"].rlike(_AGAINST).cast("int")),
        number((span["before"].rlike(r"[A-Za-z0-9/_=.-]$") | span["after"].rlike(r"^[A-Za-z0-9/_=]")).cast("int")),
        number(hit.rlike(r"^\(").cast("int")),
        number(hit.rlike(r" dot ").cast("int")),
        number(hit.rlike(r"\. ").cast("int")),
    ]


# Words in front of spans in training examples, and others in the calibrating ones.
_LEADS = {
    "phone_local": (["call ", "phone: ", "tel ", "reach me at "], ["mobile ", "my number is ", "ring me on "]),
    "ssn": (["ssn ", "social security number "], ["SSN: ", "tax id "]),
    "iban": (["iban ", "account "], ["bank: ", "transfer to "]),
    "card_like": (["card ", "visa "], ["credit card ", "charge "]),
    "email_spelled": (["mail ", "contact "], ["write to ", "e-mail: ", "ping "]),
}
_OTHERS = (["order ", "invoice ", "part no. ", "ref ", "version ", "item #"], ["serial ", "isbn ", "docket ", "batch "])


def _with_check_digit(digits: str) -> str:
    """``digits`` with the Luhn digit behind."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def _examples(seed: int, n: int, contexts: list[str], part: int) -> list[tuple[str, str, int, str]]:
    """(kind, text, label, span) of generated spans in stretches of text: personal data, and look-alikes of the same or a faulty form."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
    out = []
    for i in range(n):
        kind = list(LOOSE)[i % len(LOOSE)]
        good, told = rng.random() < 0.5, rng.random() < 0.8
        if kind == "phone_local":
            s = rng.choice([" ", "-", "."])
            hit = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}"])
        elif kind == "ssn":
            hit = f"{rng.randint(100, 665) if good or told else rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}"
        elif kind == "iban":
            hit = rng.choice(["DE", "FR", "ES", "GB"]) + d(2) + "".join(f" {d(4)}" for _ in range(rng.randint(3, 5)))
        elif kind == "card_like":
            digits = _with_check_digit(d(15)) if good else d(16)
            hit = "-".join(digits[k : k + 4] for k in range(0, 16, 4))
        else:
            hit = f"{word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}" if good else f"{word()} at {word()}.{word()[:3]}"
        before = rng.choice((_LEADS[kind] if good else _OTHERS)[part]) if told else ""
        if not good and rng.random() < 0.3:
            before += rng.choice(["A/", "x=", "v_"])
        around = rng.choice(contexts) if contexts else f"{word()} {word()}, {word()} {word()}"
        cut = around.find(" ", len(around) // 2)
        left, right = (around[:cut], around[cut:]) if cut > 0 else (around, "")
        out.append((kind, f"{left} {before}{hit}{right or ' ' + word() + '.'}", int(good), hit))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.4) -> tuple[float, list]:
    """Gradient boosting of depth-two trees for log loss: the base score and (feature, cut, low, high) trees."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, trees = np.full(len(y), base), []

    def leaf(rows):
        p = 1 / (1 + np.exp(-score[rows]))
        return float(rate * (y[rows] - p).sum() / ((p * (1 - p)).sum() + 1.0))

    def split(rows):
        best, p = (1e-6, None, None), 1 / (1 + np.exp(-score[rows]))
        g, h = y[rows] - p, p * (1 - p)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= cut
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - whole
                if gain > best[0]:
                    best = (gain, f, float(cut))
        return best[1:]

    def grow(rows, depth):
        f, cut = split(rows) if depth else (None, None)
        if f is None:
            return leaf(rows)
        low = x[rows, f] <= cut
        return (f, cut, grow(rows[low], depth - 1), grow(rows[~low], depth - 1))

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        tree = grow(np.arange(len(y)), 2)
        trees.append(tree)
        score += np.array([value(tree, row) for row in x])
    return base, trees


def _scored(base: float, trees: list, values: Column) -> Column:
    """The boosted log odds as an expression over an array of feature values."""

    def expression(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(F.get(values, F.lit(tree[0])) <= tree[1], expression(tree[2])).otherwise(expression(tree[3]))

    return reduce(lambda a, t: a + expression(t), trees, F.lit(base))


class Trees:
    """Boosted trees, the threshold of each loose kind, and which share of personal data is found and of look-alikes left on the calibrating examples."""

    _known: dict = {}

    def __init__(self, base: float, trees: list, thresholds: dict[str, float], report: dict[str, tuple[float, float]]):
        self.base, self.trees, self.thresholds, self.report = base, trees, thresholds, report

    def selects(self, span: Column) -> Column:
        limit = reduce(lambda c, k: c.when(span["kind"] == k[0], k[1]), list(self.thresholds.items()), F.when(F.lit(False), 0.0))
        return let(F.array(*features(span)), lambda v: _scored(self.base, self.trees, v)) >= limit


def contexts_of(docs: DataFrame, text_col: str = "text") -> list[str]:
    """``CONTEXTS`` bounded stretches of text, one from a document, without digits (so no span is in them)."""
    text = F.col(text_col)
    chosen = docs.where(F.length(text) > 0).select(F.xxhash64(text).alias("mix"), F.regexp_replace(F.substring(text, F.greatest(F.lit(1), F.length(text).bitwiseAND(1023)), F.lit(CONTEXT_CHARS)), "[0-9@+\\s]+", " ").alias("part"))
    return sorted(r["part"].strip() for r in chosen.orderBy("mix", "part").limit(CONTEXTS).collect())


def train(spark: SparkSession, contexts: list[str] | None = None, seed: int = 7, n: int = 600, precision: float = 0.99) -> Trees:
    """Trees from generated examples in ``contexts``; thresholds from as many others. The same for every session."""
    own = sorted(contexts or [])
    key = (seed, n, precision, tuple(own))
    if key not in Trees._known:
        Trees._known.clear()
        rows = [(part, *e) for part in (0, 1) for e in _examples(seed + part, n, own[part::2], part)]
        table = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(k).alias("kind"), F.lit(t).alias("text"), F.lit(y).alias("y"), F.lit(h).alias("h")) for p, k, t, y, h in rows))).alias("e")).select("e.*")
        spans = reduce(F.concat, [F.when(F.col("kind") == kind, matches(F.col("text"), kind, *how)).otherwise(F.array().cast(_EMPTY)) for kind, how in LOOSE.items()])
        # What the text around has of itself is a look-alike.
        found = table.select("part", "kind", "y", "h", F.explode(spans).alias("s")).select("part", "kind", F.when(F.col("s.hit").contains(F.col("h")), F.col("y")).otherwise(0).alias("y"), F.array(*features(F.col("s"))).alias("x")).collect()
        x, y = np.array([r["x"] for r in found]), np.array([r["y"] for r in found], float)
        part, kinds = np.array([r["part"] for r in found]), np.array([r["kind"] for r in found])
        base, trees = boost(x[part == 0], y[part == 0])

        def score(row):
            total = base
            for t in trees:
                while isinstance(t, tuple):
                    t = t[2] if row[t[0]] <= t[1] else t[3]
                total += t
            return total

        scores, limits = np.array([score(r) for r in x]), {}
        for kind in LOOSE:
            own = (part == 1) & (kinds == kind)
            limits[kind] = float("inf")
            for s in sorted(set(scores[own]), reverse=True):
                if y[own & (scores >= s)].mean() >= precision:
                    limits[kind] = float(s)
        chosen = np.array([score_ >= limits[kind] for score_, kind in zip(scores, kinds, strict=True)])
        report = {kind: (float(chosen[(part == 1) & (kinds == kind) & (y == 1)].mean()), float(1 - chosen[(part == 1) & (kinds == kind) & (y == 0)].mean())) for kind in LOOSE}
        Trees._known[key] = Trees(base, trees, limits, report)
    return Trees._known[key]


_EMPTY = "array<struct<kind:string,start:int,end:int,hit:string,before:string,after:string>>"


def _found(text: Column, trees: Trees) -> Column:
    """``base`` and ``extra`` spans of a text: arrays of kind, start, end."""
    places = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.concat(*(places(F.filter(matches(text, kind, *how), _valid(kind))) for kind, how in BASE.items()))
    loose = F.concat(*(places(F.filter(matches(text, kind, *how), trees.selects)) for kind, how in LOOSE.items()))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def settled(pair: Column) -> Column:
        free = F.filter(pair["loose"], lambda s: ~F.exists(pair["base"], lambda b: meets(s, b)))
        # Of overlapping selected spans the one of the earlier kind stays, then the earlier place.
        extra = let(free, lambda all_free: F.filter(all_free, lambda s, i: ~F.exists(F.slice(all_free, F.lit(1), i), lambda e: meets(s, e))))
        return F.struct(pair["base"].alias("base"), extra.alias("extra"))

    return let(F.struct(base.alias("base"), loose.alias("loose")), settled)


def find(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ``base`` and ``extra`` spans (arrays of kind, start, end)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), scratch.text_or_empty(text_col).alias("text"))
    return rows.select("doc_id", _found(F.col("text"), trees).alias("found")).select("doc_id", "found.base", "found.extra")


def redact(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with the text of every span that ``find`` selects replaced by ``[KIND]``, and n_chars brought up to date (if there).

    Spans that overlap are one stretch, named by the first. Null texts stay null; other columns stay, whatever their names.
    """
    name = scratch.fresh_name(docs, "selected_spans")
    found = let(_found(scratch.text_or_empty(), trees), lambda f: F.concat(f["base"], f["extra"]))
    marked = docs.withColumn(name, F.when(F.col("text").isNotNull(), found))
    text = F.when(F.size(name) > 0, spliced(F.col("text"), F.col(name))).otherwise(F.col("text"))
    docs = marked.withColumn("text", text).drop(name)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    found = find(docs, train(spark, contexts_of(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"))
