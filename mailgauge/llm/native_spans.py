"""Regular-expression matches with positions, in DataFrame functions only.

Spark gives matches and the pieces between them, both in one pass each; running sums of
their lengths (in blocks, so that the cost stays near linear) give code point positions.
All patterns are Java ones that need no backtracking over long runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
#: Characters of context on each side of a match.
CONTEXT = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column) -> Column:
    """Running sums of an array of numbers."""

    def sums(own: Column, start: Column) -> Column:
        seed = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))
        return F.aggregate(own, seed, step, lambda acc: acc["out"])

    def blocked(all_numbers: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_numbers) / BLOCK).cast("int") - 1), lambda b: F.slice(all_numbers, b * BLOCK + 1, BLOCK))

        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x))
            starts = let(sums(totals, F.lit(0)), lambda ends: F.transform(parts, lambda _, i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))))
            return let(starts, lambda s: F.flatten(F.transform(parts, lambda p, i: sums(p, F.get(s, i)))))

        return let(blocks, joined)

    return F.when(F.size(numbers) > 0, let(numbers, blocked)).otherwise(F.array().cast("array<int>"))


def _cut(text: Column, pattern: str) -> Column:
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))


_SPAN = "array<struct<kind:string,start:int,end:int,hit:string,before:string,after:string>>"


def matches(text: Column, kind: str, pattern: str, hint: str | None = None) -> Column:
    """All matches, leftmost first, as structs: kind, start, end, hit, before, after.

    ``hint`` is a cheap pattern that every text with a match contains.
    """

    def placed(cut: Column) -> Column:
        steps = F.transform(cut["hits"], lambda h, i: F.length(F.get(cut["gaps"], i)) + F.length(h))

        def spans(ends: Column) -> Column:
            return F.transform(
                cut["hits"],
                lambda h, i: F.struct(
                    F.lit(kind).alias("kind"),
                    (F.get(ends, i) - F.length(h)).alias("start"),
                    F.get(ends, i).alias("end"),
                    h.alias("hit"),
                    F.right(F.get(cut["gaps"], i), F.lit(CONTEXT)).alias("before"),
                    F.left(F.get(cut["gaps"], i + 1), F.lit(CONTEXT)).alias("after"),
                ),
            )

        return let(running(steps), spans)

    found = let(_cut(text, pattern), placed)
    return F.when(text.rlike(hint or pattern), found).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


_KEPT = "array<struct<start:int,end:int,mark:string>>"


def _apart(spans: Column) -> Column:
    """Spans in order without overlaps: what an earlier one covers goes, and the rest of it has no mark of its own."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["start"] < acc["at"], "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        more = F.array_append(acc["out"], F.struct(F.greatest(s["start"], acc["at"]).alias("start"), s["end"].alias("end"), mark.alias("mark")))
        return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), more.alias("out"))).otherwise(acc)

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast(_KEPT).alias("out")), step, lambda acc: acc["out"])


def spliced(text: Column, spans: Column) -> Column:
    """``text`` with spans (kind, start, end; any order, overlaps allowed) replaced by their kinds.

    Blocks of spans first cut their stretch from the text, so that each cut is short and the cost stays near linear.
    """

    def built(kept: Column) -> Column:
        end_before = lambda i: F.when(i > 0, F.get(kept, i - 1)["end"]).otherwise(F.lit(0))

        def block(b: Column) -> Column:
            own = F.struct(end_before(b * BLOCK).alias("at"), F.slice(kept, b * BLOCK + 1, BLOCK).alias("spans"))

            def joined(o: Column) -> Column:
                part = F.substring(text, o["at"] + 1, F.element_at(o["spans"], -1)["end"] - o["at"])

                def pieces(p: Column) -> Column:
                    start = lambda i: F.when(i > 0, F.get(o["spans"], i - 1)["end"]).otherwise(o["at"])
                    return F.array_join(F.transform(o["spans"], lambda s, i: F.concat(F.substring(p, start(i) - o["at"] + 1, s["start"] - start(i)), s["mark"])), "")

                return let(part, pieces)

            return let(own, joined)

        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(kept) / BLOCK).cast("int") - 1), block)
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.element_at(kept, -1)["end"] + 1, F.length(text)))

    return let(_apart(spans), built)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
