"""Hidden-text detection: HTML to an ordered array of fragments, and summaries per e-mail.

The tree walk with inherited state is one Arrow function per batch; everything after it
is native. An e-mail that cannot be judged (strict mode) gets an error and no fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgauge.operators import css, dom

_COLOUR = "struct<rgb:array<int>,alpha:double>"
FRAGMENT = f"struct<text:string,type:string,url:string,style:struct<color:{_COLOUR},background_color:{_COLOUR},props:map<string,string>>,visible:boolean,hidden_reasons:array<string>>"
DETECTED = f"struct<fragments:array<{FRAGMENT}>,file_visible:boolean,error:string>"


def _style(style: dict) -> dict:
    paint = lambda c: {"rgb": list(c[:3]), "alpha": float(c[3])} if c else None
    return {"color": paint(style.get("color")), "background_color": paint(style.get("background-color")), "props": {k: str(v) for k, v in style.items() if k not in ("color", "background-color")}}


def _skipped(text: str) -> bool:
    return not text.strip() and "\n" in text


def _runs(children: list, style: dict, sheet: dict) -> Iterator[tuple[object, dict]]:
    """Text nodes and links below some nodes with the style they are shown in, in document order."""
    todo = [(c, style) for c in reversed(children)]
    while todo:
        node, own = todo.pop()
        if isinstance(node, dom.Text):
            if node.kind not in ("comment", "declaration") and node and not _skipped(node):
                yield node, own
        elif node.name not in dom.NO_BOX:
            now = css.node_style(node, own, sheet)
            if node.name == "a":
                yield node, now
            else:
                below = css.passed_on(now)
                todo.extend((c, below) for c in reversed(node.children))


def _link_reasons(link: dom.Element, style: dict, sheet: dict, strict: bool) -> list[str]:
    """Reasons of a link: none if any text in it is seen, else all of them once; without text those of the link's own style."""
    found, todo, any_text = [], [(c, style) for c in reversed(link.children)], False
    while todo:
        node, own = todo.pop()
        if isinstance(node, dom.Text):
            if node.kind in ("comment", "declaration") or not node or _skipped(node):
                continue
            any_text, reasons = True, css.hidden_reasons(own, strict)
            if not reasons:
                return []
            found += [r for r in reasons if r not in found]
        elif node.name not in dom.NO_BOX:
            below = css.passed_on(css.node_style(node, own, sheet))
            todo.extend((c, below) for c in reversed(node.children))
    return found if any_text else css.hidden_reasons(style, strict)


def detect(html: str, strict: bool = False) -> tuple[list[dict], bool]:
    """Fragments of a document in order (comments last), and whether all its text is seen."""
    root = dom.parse(html)
    sheet = css.class_sheet(root)
    top = root.find("body") or root
    dom.prune(top)
    rows, seen = [], True
    for node, style in _runs([top], dict(css.DEFAULT), sheet):
        if isinstance(node, dom.Text):
            reasons = css.hidden_reasons(style, strict)
            seen &= not reasons
            rows.append({"text": str(node), "type": "text", "url": None, "style": _style(style), "visible": not reasons, "hidden_reasons": reasons})
        else:
            reasons = _link_reasons(node, style, sheet, strict)
            rows.append({"text": dom.link_text(node), "type": "link", "url": node.attrs.get("href", ""), "style": _style(style), "visible": not reasons, "hidden_reasons": reasons})
    for text in dom.comments(root):
        if not text.startswith("[cond:"):
            rows.append({"text": text, "type": "html_comment", "url": None, "style": None, "visible": False, "hidden_reasons": None})
    return rows, seen


def detector(strict: bool = False):
    @F.pandas_udf(DETECTED)
    def run(pages: pd.Series) -> pd.DataFrame:
        out = []
        for html in pages:
            if html is None:
                out.append((None, None, None))
                continue
            try:
                out.append((*detect(html, strict), None))
            except Exception as e:  # one bad document must not end the job: it becomes an error row
                out.append((None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["fragments", "file_visible", "error"])

    return run.asNondeterministic()  # so that no filter on what it finds runs it a second time


def detected(pages: DataFrame, html: str = "html", strict: bool = False) -> DataFrame:
    return pages.withColumn("found", detector(strict)(F.col(html))).select("*", "found.fragments", "found.file_visible", "found.error").drop("found")


def fragment_rows(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, F.posexplode("fragments").alias("frag_idx", "f")).select(key, "frag_idx", "f.*")


# Flag names and what they look for in the joined reasons.
REASON_FLAGS = {
    "css_display_none": ("display:none",),
    "css_visibility_hidden": ("visibility:hidden", "visibility:collapse"),
    "css_color_transparent": ("color:transparent",),
    "css_same_color": ("same_color",),
    "css_low_contrast": ("low_contrast",),
    "css_opacity_zero": ("opacity",),
    "css_position_offset": ("position_offset",),
    "css_clipping": ("clipping",),
    "css_filter": ("filter",),
    "css_tiny_font": ("font too small",),
}
STRATEGIES = ("add_paragraph", "disrupt_word", "insert_word", "html_comment", "mso_conditional_comment", "hidden_whitespace_only")
STRATEGY_FLAGS = {s: "has_hidden_whitespace_only" if s == "hidden_whitespace_only" else f"strategy_{s}" for s in STRATEGIES}


def email_summary(emails: DataFrame, found: DataFrame, hidden: DataFrame, key: str = "email_file") -> DataFrame:
    """One row per e-mail of ``emails`` (key, html): flags, counts, dominant strategy, error.

    ``found`` has fragments and errors, ``hidden`` the classified hidden fragments (type, hidden_reasons,
    embedding_strategy). E-mails without HTML have no fragments and no error.
    """
    reasons = F.lower(F.array_join(F.coalesce("hidden_reasons", F.array().cast("array<string>")), " | "))
    kind = F.when(F.col("embedding_strategy").isin("html_comment", "mso_conditional_comment"), F.col("embedding_strategy")).when(F.col("type") == "html_comment", "html_comment").when(F.col("type") == "conditional_comment", "mso_conditional_comment").otherwise("css")
    rows = hidden.withColumn("_r", reasons).withColumn("_k", kind)
    some = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    flags = [some(F.exists(F.array(*map(F.lit, words)), lambda w: F.col("_r").contains(w))).alias(name) for name, words in REASON_FLAGS.items()]
    counts = [F.count_if(F.col("embedding_strategy") == s).alias(f"count_{s}") for s in STRATEGIES]
    kinds = [F.count_if(F.col("_k") == k).alias(name) for k, name in (("css", "css_hidden_fragment_count"), ("html_comment", "html_comment_count"), ("mso_conditional_comment", "mso_conditional_comment_count"))]
    per = rows.groupBy(key).agg(*flags, *counts, *kinds, F.count("*").alias("hidden_fragment_count"))
    total = F.size(F.filter(F.coalesce("fragments", F.array().cast(f"array<{FRAGMENT}>")), lambda f: f["text"] != "")).alias("total_fragment_count")
    base = emails.select(key, F.col("html").isNotNull().alias("has_html")).join(found.select(key, total, "error"), key, "left")
    out = base.join(per, key, "left")
    out = out.na.fill(False, list(REASON_FLAGS)).na.fill(0, [f"count_{s}" for s in STRATEGIES] + ["css_hidden_fragment_count", "html_comment_count", "mso_conditional_comment_count", "hidden_fragment_count", "total_fragment_count"])
    best = F.greatest(*(F.col(f"count_{s}") for s in STRATEGIES))
    dominant = F.when(best == 0, "no_hidden_text")
    for s in STRATEGIES:  # the first of equals
        dominant = dominant.when(F.col(f"count_{s}") == best, s)
    return out.withColumns(
        {name: F.col(f"count_{s}") > 0 for s, name in STRATEGY_FLAGS.items()}
        | {
            "has_css_hidden_text": F.col("css_hidden_fragment_count") > 0,
            "has_html_comments": F.col("html_comment_count") > 0,
            "has_mso_conditional_comments": F.col("mso_conditional_comment_count") > 0,
            "visible_fragment_count": F.col("total_fragment_count") - F.col("hidden_fragment_count"),
            "dominant_strategy": F.when(F.col("error").isNull(), dominant),
        }
    )


def _flagged(summary: DataFrame, key: str) -> DataFrame:
    """(key, flag, on): one row per e-mail and flag."""
    flags = [*REASON_FLAGS, *STRATEGY_FLAGS.values(), "has_css_hidden_text", "has_html_comments", "has_mso_conditional_comments"]
    any_css, any_hidden = F.greatest(*(F.col(f) for f in REASON_FLAGS)), F.col("has_css_hidden_text") | F.col("has_html_comments") | F.col("has_mso_conditional_comments")
    wide = summary.withColumn("any_css", any_css).withColumn("any_hidden", any_hidden)
    return wide.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.coalesce(F.col(f), F.lit(False)).alias("on")) for f in [*flags, "any_css", "any_hidden"]))).alias("x")).select(key, "x.*")


def flag_emails(summary: DataFrame, key: str = "email_file") -> DataFrame:
    """The e-mails of every flag, one row each: a list per flag that no single row has to hold."""
    return _flagged(summary, key).where("on").select("flag", key)


def corpus_stats(summary: DataFrame, key: str = "email_file") -> DataFrame:
    """Per flag: e-mails, share of all (null for no e-mails) and the first of them in key order."""
    long = _flagged(summary, key)
    totals = long.groupBy("flag").agg(F.count_if("on").alias("n_emails"), F.count("*").alias("total_emails"), F.min(F.when(F.col("on"), F.col(key))).alias("first_email"))
    return totals.withColumn("percentage", F.try_divide(F.col("n_emails") * 100.0, F.col("total_emails")))
