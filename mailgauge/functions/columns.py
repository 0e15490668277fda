"""Column functions for cleaning and for classifier output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a string, and within one.
_EDGES = r"(?U)^\s+|\s+$"
#: Where a text breaks into lines: the line ends of Unicode and the ASCII separators.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def squeezed(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return stripped(F.regexp_replace(c, r"(?U)\s+", " "))


def to_boolean(c: Column) -> Column:
    """true/1/yes/y/t and false/0/no/n/f in any case; anything else is null."""
    word = F.lower(stripped(c.cast("string")))
    return F.when(word.isin("true", "1", "yes", "y", "t"), True).when(word.isin("false", "0", "no", "n", "f"), False)


def to_number(c: Column) -> Column:
    """The number, or null; NaN is null too."""
    value = stripped(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_integer(c: Column) -> Column:
    return F.when(to_number(c) == F.floor(to_number(c)), to_number(c)).try_cast("int")


def model_family(c: Column) -> Column:
    """Llama or Qwen where the name says so, else what follows the last slash."""
    name = F.lower(c)
    return F.when(name.contains("llama"), "Llama").when(name.contains("qwen"), "Qwen").otherwise(F.element_at(F.split(c, "/"), -1))


def base_id(c: Column) -> Column:
    return F.regexp_replace(c, "_P(?:1|2)$", "")


#: Fixed patterns: a line that names its label, and a line that is nothing but one.
_NAMED = r"(?iU)\b(?:label|classification|class|prediction)\b\s*[:=\-]?\s*[<\[({]?\s*([01])\s*[>\])}]?"
_ALONE = r"(?U)^[<\[({]?\s*([01])\s*[>\])}]?$"


def parsed_label(raw: Column) -> Column:
    """The binary label in a classifier's answer, or null.

    A bare 0 or 1; else the first line that names a label; else the first line with text if it is just a (bracketed) 0 or 1.
    """
    text = stripped(F.coalesce(raw, F.lit("")))
    lines = F.filter(F.transform(F.split(text, LINE_END), stripped), lambda s: s != "")
    named = F.filter(lines, lambda s: s.rlike(_NAMED))
    return (
        F.when(text.isin("0", "1"), text)
        .when(F.size(named) > 0, F.regexp_extract(F.get(named, F.lit(0)), _NAMED, 1))
        .when(F.get(lines, F.lit(0)).rlike(_ALONE), F.regexp_extract(F.get(lines, F.lit(0)), _ALONE, 1))
        .cast("int")
    )


def luminance(r: Column, g: Column, b: Column) -> Column:
    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return linear(r) * 0.2126 + linear(g) * 0.7152 + linear(b) * 0.0722


def contrast(fg: list[Column], bg: list[Column]) -> Column:
    """WCAG contrast ratio of two colours (0..255 each), two decimals."""
    one, two = luminance(*fg) + 0.05, luminance(*bg) + 0.05
    return F.round(F.greatest(one, two) / F.least(one, two), 2)
