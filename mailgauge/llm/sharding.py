"""Operator 2: a reproducible shuffle of all rows into shards, by a keyed permutation.

Rows get global numbers 0..N-1 in document-id order. A four-round Feistel network over the
smallest even-bit domain that holds N permutes them; numbers that leave 0..N-1 walk the
cycle until they are back inside. Row r goes to shard ``p(r) mod shards``, slot
``p(r) div shards``, so any row's place follows from its number, the seed and N alone, and
shard sizes differ by at most one row (law ``rows``). The method deals rows one by one: it
keeps no groups together, and equal texts may part.

Defined results: a null text has 16 bytes and the checksum of no bytes; null ids sort
first; repeated ids are ordered by size and checksum (rows equal in all three are
interchangeable); an empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm import scratch

_LOW = (1 << 32) - 1
_STEPS = ((0x85EBCA6B, 13), (0xC2B2AE35, 16))


def _round_keys(seed: int, rounds: int) -> list[int]:
    return [(seed * 0x9E3779B1 + (k + 1) * 0x7FEB352D) & _LOW for k in range(rounds)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """The round function: a 32-bit finaliser in 64-bit arithmetic."""
    x = (x ^ np.uint64(key)) & np.uint64(_LOW)
    for factor, shift in _STEPS:
        x = (x * np.uint64(factor)) & np.uint64(_LOW)
        x = x ^ (x >> np.uint64(shift))
    return x


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, n: int, seed: int = 0, rounds: int = 4) -> np.ndarray:
    """The places of row numbers under the permutation of 0..n-1; a bijection for every seed."""
    half = _half_bits(n)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for key in _round_keys(seed, rounds):
            left, right = right, left ^ (_mix(right, key) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, row_number, shard, slot.

    Only ids, sizes and checksums are shuffled (one range sort); the counts of the sorted
    partitions, one number each, go to the driver to become row numbers.
    """
    text = scratch.text_or_empty(text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.asc_nulls_first("doc_id"), F.asc("size"), F.asc("text_crc32")]
    part = F.shiftright(F.col("at"), 33)
    ordered, _ = scratch.save(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "op2-ordered")
    counts = {r["part"]: r["n"] for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, n = {}, 0
    for p in sorted(counts):
        starts[p], n = n, n + counts[p]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column(3).to_numpy()
            parts, inverse = np.unique(at >> 33, return_inverse=True)
            rows = np.array([starts[int(p)] for p in parts], np.int64)[inverse] + (at & ((1 << 33) - 1))
            places = permute(rows, n, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(rows), pa.array((places % shards).astype(np.int32)), pa.array(places // shards)],
                ["doc_id", "size", "text_crc32", "row_number", "shard", "slot"],
            )

    return ordered.mapInArrow(place, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(scratch.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def places_sql(shards: int = 40, seed: int = 0, rounds: int = 4) -> str:
    """DuckDB SQL for id, size, shard and slot: rounds as nested selects, cycle walking as a recursive query.

    DuckDB has no CRC-32, so the query as a whole has no SQL twin.
    """

    def mix(x: str, key: int) -> str:
        out = f"xor({x}, {key}::UBIGINT) & {_LOW}::UBIGINT"
        for factor, shift in _STEPS:
            out = f"(({out}) * {factor}::UBIGINT) & {_LOW}::UBIGINT"
            out = f"xor(({out}), ({out}) >> {shift})"
        return out

    def walk(source: str) -> str:
        inner = f"SELECT r, v >> half AS a, v & mask AS b, half, mask, n FROM {source}"
        for key in _round_keys(seed, rounds):
            inner = f"SELECT r, b AS a, xor(a, ({mix('b', key)}) & mask) AS b, half, mask, n FROM ({inner})"
        return f"SELECT r, (a << half) | b AS v, half, mask, n FROM ({inner})"

    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, text FROM documents),
numbered AS (SELECT doc_id, size, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, size) - 1 AS r, count(*) OVER () AS n FROM d),
sized AS (SELECT r::UBIGINT AS r, r::UBIGINT AS v, n::UBIGINT AS n, greatest(1, (ceil(log2(greatest(n, 2)))::INT + 1) // 2) AS half FROM numbered),
first AS (SELECT r, v, half, (1::UBIGINT << half) - 1 AS mask, n FROM sized),
walked AS ({walk('first')} UNION ALL {walk('(SELECT * FROM walked WHERE v >= n)')})
SELECT doc_id, size, (v % {shards})::INT AS shard, (v // {shards})::BIGINT AS slot
FROM walked JOIN numbered ON numbered.r = walked.r WHERE v < walked.n
"""
