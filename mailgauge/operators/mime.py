"""Raw e-mail bytes to HTML and to two text representations, as Arrow functions.

P1 is the decoded MIME source under minimal headers; P2 is the clean text of the HTML parts
(else of the plain ones) with a list of attachments. Each message is parsed once for all
outputs; a message that cannot be parsed gets an error and nulls.
"""

from __future__ import annotations

import codecs
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgauge.functions.arrow import arrow_function
from mailgauge.operators.dom import visible_text

SHOWN_HEADERS = ("From", "To", "Subject")
#: Content types that are text here; everything else is a file.
TEXTS = ("text/html", "text/plain")
PARSED = "struct<html:string,p1:string,p2:string,error:string>"


class Leaf(NamedTuple):
    """A part without parts: its type, its text (of ``TEXTS``), whether its charset is known, whether it goes as a named file, and how it reads as one."""

    kind: str
    text: str
    charset_known: bool
    named: bool
    as_file: str


def _codec(name: str) -> str | None:
    try:
        return codecs.lookup(name).name
    except LookupError:
        return None


def leaf(part) -> Leaf:
    kind, name, data = part.get_content_type(), part.get_filename(), part.get_payload(decode=True) or b""
    codec = _codec(part.get_content_charset("utf-8"))
    return Leaf(
        kind,
        data.decode(codec or "utf-8", "replace") if kind in TEXTS else "",
        codec is not None,
        bool(name) and part.get_content_disposition() in ("attachment", "inline"),
        f"[Attachment removed: {name or 'unknown'} | {kind} | {len(data)} bytes]",
    )


def leaves(message) -> list[Leaf]:
    return [leaf(part) for part in message.walk() if not part.is_multipart()]


def headers(message) -> str:
    return "\n".join(f"{name}: {message[name]}" for name in SHOWN_HEADERS if message[name]) + "\n\n"


def decoded_body(message) -> str:
    """A message as MIME source with decoded text: boundaries and headers stay, files become placeholders."""
    out, todo = [], [message]
    while todo:  # strings go out, parts are opened, in order
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif not item.is_multipart():
            own = leaf(item)
            out.append(own.as_file if own.named or own.kind not in TEXTS else own.text)
        else:
            boundary, inside = item.get_boundary(), []
            for n, part in enumerate(item.iter_parts()):
                if boundary:
                    head = [f"{k}: {v}\n" for k, v in part.items() if k.lower() != "content-transfer-encoding"]
                    inside += [f"--{boundary}\n", *head, *(["\n"] if head else []), part, "\n"]
                else:
                    inside += ["\n\n"] * (n > 0) + [part]
            todo += reversed([*inside, f"--{boundary}--"] if boundary else inside)
    return "".join(out)


def p1(message) -> str:
    return headers(message) + decoded_body(message).strip() + "\n"


def p2(message) -> str:
    sections: dict[str, list[str]] = {}
    for own in leaves(message):
        kind, shown = ("files", own.as_file) if own.named else (own.kind, own.text)
        sections.setdefault(kind, []).append(shown)
    plain, pages = ("\n\n".join(sections.get(kind, [])) for kind in ("text/plain", "text/html"))
    parts = [headers(message), visible_text(pages) if "text/html" in sections else plain.strip()]
    if "files" in sections:
        parts += ["\n\n", "\n".join(["Attachments:", *sections["files"]])]
    return "".join(parts).strip() + "\n"


def html_of(message) -> str | None:
    """All text/html parts, joined by line ends; null if there is none or a charset is unknown."""
    pages = [own for own in leaves(message) if own.kind == "text/html"]
    return "\n".join(own.text for own in pages) if pages and all(own.charset_known for own in pages) else None


def parse(content: bytes) -> EmailMessage:
    return BytesParser(policy=policy.default).parsebytes(content)


@arrow_function(PARSED, once=True)
def parse_messages(contents: pd.Series) -> pd.DataFrame:
    out = []
    for content in contents:
        try:
            message = parse(content or b"")
            out.append((html_of(message), p1(message), p2(message), None))
        except Exception as e:  # a broken message must not end the job: it becomes an error row
            out.append((None, None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["html", "p1", "p2", "error"])


@arrow_function("string")
def clean_html(pages: pd.Series) -> pd.Series:
    return pages.map(lambda h: None if h is None else visible_text(h))


def parsed(emails: DataFrame, content: str = "content") -> DataFrame:
    return emails.withColumn("m", parse_messages(F.col(content))).select(*(c for c in emails.columns if c != content), "m.*")


def parser_texts(messages: DataFrame, key: str = "email_id") -> DataFrame:
    """Two rows per e-mail: key, parser_id (P1, P2), text."""
    both = F.array(F.struct(F.lit("P1").alias("parser_id"), F.col("p1").alias("text")), F.struct(F.lit("P2").alias("parser_id"), F.col("p2").alias("text")))
    return messages.select(key, F.explode(both).alias("x")).select(key, "x.*")
