"""Documents as e-mails: hidden text put into HTML by fixed templates, and MIME messages around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.session import load

#: One template per document id modulo their number; {0} the first word, {1} the second, {t} the rest.
TEMPLATES = (
    "<html><body><p>{0} {1} {t}</p></body></html>",
    '<body><p>{0} <span style="display:none">{1}</span> {t}</p></body>',
    '<body><p>{0}<span style="font-size:1px">zq</span>{1} now {t}</p></body>',
    '<body bgcolor="#ffffff"><p>{0} <font color="#ffffff">{1} {t}</font> end</p></body>',
    '<head><style>.h, .k{{ visibility:hidden }}</style></head><body><div class="k">{1}</div><p>{0} {t}</p><!-- {1} --></body>',
    '<body><div style="width:0;overflow:hidden">{1} {0} more</div><a href="http://x.example/">{0} <b>{1}</b></a><p>{t}</p></body>',
    '<body><p>{0}</p><!--[if mso]> {1} <![endif]--><div style="position:absolute;left:-9999px">{t}</div></body>',
    '<body><p style="color:#777">{0} <span style="opacity:0.005"> </span>{1} {t}</p></body>',
)


def pages_with_hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(email_file, html): whole documents in the templates."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    words = F.split(safe, " ", 3)
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    html = F.lit(None).cast("string")
    for k, template in enumerate(TEMPLATES):
        filled = F.lit(template.replace("{{", "{").replace("}}", "}"))
        for mark, value in (("{0}", word(0)), ("{1}", word(1)), ("{t}", word(2))):
            filled = F.replace(filled, F.lit(mark), value)
        html = F.when(F.col("doc_id") % len(TEMPLATES) == k, filled).otherwise(html)
    return docs.select(F.concat(F.lit("mail_"), F.col("doc_id")).alias("email_file"), html.alias("html"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(email_file, content): plain, HTML and multipart messages with those pages."""
    pages = pages_with_hidden_text(spark, sf_dir).withColumn("k", F.regexp_extract("email_file", "[0-9]+$", 0).cast("long") % 3)
    head = F.concat(F.lit("From: a@mail.example\r\nTo: b@mail.example\r\nSubject: "), F.col("email_file"), F.lit("\r\nMIME-Version: 1.0\r\n"))
    flat = F.regexp_replace("html", "\r?\n", "\r\n")
    html = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), flat, F.lit("\r\n"))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), F.regexp_replace(flat, "<[^>]*>", ""), F.lit("\r\n"))
    file = F.lit('Content-Type: application/pdf; name="f.pdf"\r\nContent-Disposition: attachment; filename="f.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD\r\n')
    mixed = F.concat(F.lit('Content-Type: multipart/mixed; boundary="b1"\r\n\r\n--b1\r\n'), plain, F.lit("--b1\r\n"), html, F.lit("--b1\r\n"), file, F.lit("--b1--\r\n"))
    body = F.when(F.col("k") == 0, html).when(F.col("k") == 1, plain).otherwise(mixed)
    return pages.select("email_file", F.concat(head, body).cast("binary").alias("content"))
