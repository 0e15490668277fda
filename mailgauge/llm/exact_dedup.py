"""Operator 10: exact duplicates by 128-bit content hash, with bytes compared in the groups.

Rows are grouped by (MD5, text): the hash deals the rows, the aggregate compares the texts'
bytes, so two texts that share a hash stay two groups. Copies meet in the partial
aggregates before the shuffle, so a text that a third of all rows share costs one row per
map task. Decisions go back to the rows by hash alone; only if some hash has several
texts do the rows of those hashes go back by hash and SHA-256.

Groups with a large share of all rows (a bounded number of them) are joined by broadcast, all
others by shuffle (``group_join``).

Defined results: a null text equals an empty one; ``keep`` picks the smallest or the largest
id, null ids lose to any id; of rows that repeat both id and text one is kept; an empty table gives
no rows. Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm import scratch
from mailgauge.llm.group_join import join_groups

#: Rows that repeat id and text are put back by so many at once.
_REPEATS = 1 << 16


def exact_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", content_hash=F.md5) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    best = F.min if keep == "min" else F.max
    text = scratch.text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), content_hash(text).alias("hash"))
    groups = rows.groupBy("hash", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = scratch.saved(groups.select("hash", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")), "op10-groups")
    shared = scratch.saved(groups.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash"), "op10-collisions")
    narrow = rows.select("hash", "doc_id")
    collided = not shared.isEmpty()
    single = groups
    if collided:
        narrow = rows.join(shared, "hash", "left_anti").select("hash", "doc_id")
        single = groups.join(shared, "hash", "left_anti")
    found = join_groups(narrow, single, ["hash"])
    if collided:  # rows of a shared hash find their text's group by a second digest
        mixed = rows.join(shared, "hash", "left_semi").withColumn("text_sha256", F.sha2("text", 256)).select("hash", "text_sha256", "doc_id")
        found = found.unionByName(join_groups(mixed, groups.join(shared, "hash", "left_semi"), ["hash", "text_sha256"]))
    found = scratch.saved(found.select("doc_id", "keep_id", "group_size", "text_sha256"), "op10-found")
    # One row of each group is kept; others of its id and text are put back from their number, so no task gathers them.
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    copies = found.where(best).groupBy("keep_id", "group_size", "text_sha256").agg((F.count("*") - 1).alias("more"))
    kept = copies.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", F.lit(True).alias("kept"), "text_sha256", "more")
    blocks = kept.where("more > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("more") - 1) / _REPEATS))))
    blocks = blocks.withColumn("n", F.least(F.lit(_REPEATS), F.col("more") - F.col("block") * _REPEATS).cast("int")).repartition("text_sha256", "block")
    again = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    lost = found.where(~best).withColumn("kept", F.lit(False)).unionByName(again.withColumn("kept", F.lit(False)).select(names))
    return kept.select(names).unionByName(lost)


def drop_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """``docs`` without the copies: of equal texts the row with the smallest (largest) doc_id stays.

    Of rows that repeat id and text any one stays.
    """
    kept = scratch.saved(exact_groups(docs, keep).where("kept"), "op10-kept")
    id_name, sha_name = (scratch.fresh_name(docs, n) for n in ("kept_id", "kept_sha"))
    stay = kept.select(F.col("doc_id").alias(id_name), F.col("text_sha256").alias(sha_name))
    mine = scratch.fresh_name(docs, "own_sha")
    own = docs.withColumn(mine, F.sha2(scratch.text_or_empty(), 256))
    once = own.join(stay, own["doc_id"].eqNullSafe(stay[id_name]) & (own[mine] == stay[sha_name]), "left_semi")
    repeated = kept.where("group_size > 1").join(docs.select("doc_id").groupBy("doc_id").count().where("count > 1"), "doc_id", "left_semi")
    if not repeated.isEmpty() or not kept.where("doc_id IS NULL").isEmpty():  # else no row of a kept id and text repeats
        once = once.dropDuplicates(["doc_id", mine])
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(scratch.table(spark, sf_dir, "documents"), keep="max")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY d.t, doc_id) = 1 AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
