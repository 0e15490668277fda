"""Joining rows back to their groups where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups with more than this share of all rows are hot; there are fewer than HOT_PARTS of them.
HOT_PARTS = 1024


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str = "group_size") -> DataFrame:
    """Inner join of ``rows`` to one row per group (with the group's number of rows in ``size``).

    Hot groups, fewer than ``HOT_PARTS`` by their sizes, are broadcast; all others meet their rows by shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    if total <= HOT_PARTS:
        return rows.join(groups, on)
    hot = groups.where(F.col(size) * HOT_PARTS > total)
    marked = rows.join(F.broadcast(hot.select(*on, F.lit(True).alias("is_hot"))), on, "left")
    near = marked.where("is_hot").drop("is_hot").join(F.broadcast(hot), on)
    return near.unionByName(marked.where("is_hot is null").drop("is_hot").join(groups, on))
