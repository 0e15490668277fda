"""Operator 3: best-fit packing of token pieces, with certified bin counts.

Pieces are dealt over partitions; each partition packs by best-fit decreasing and computes
a lower bound on its bins from dual-feasible functions (threshold functions and the
staircase functions u(k)), which certifies how far its own packing is from the best. A
partition at its bound is certified and stays as it is; those with a gap exchange documents:
the pieces of their bins with room meet those of up to ``FAN_IN`` such partitions, and best-fit
decreasing runs again. New bins replace the old ones only where there are fewer; the others stay
open and meet other partners in the next round. When fewer than two partitions have a gap of their own, or none of
them won a bin, the same functions over the counts of all lengths still bound the whole: while
it has more bins than that, the partitions have a gap together, and all their bins with room meet.

The exchange ends when the whole is certified, when a joint round wins nothing, or after
``rounds`` rounds; then some partitions stay uncertified. If the pieces to exchange are more
than ``most_pieces`` for a task, each partition gives its emptiest bins, and the others wait.
``pack`` reports bins, bound and certified partitions of every round.

Defined results: a null or empty text is one piece with only the end id; documents longer
than the capacity are cut into full pieces and a rest; null ids and repeated rows are
packed like any other rows; an empty table gives no rows. Ties (equal lengths) go by id,
piece and checksum. Only the two named columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm import scratch
from mailgauge.llm.wordcoder import coder, default_path, text_bytes

PART_PIECES, FAN_IN = 200_000, 8
#: Text that a worker has in hand at once, as the JVM beside it may be near its limit after earlier stages.
SLICE_BYTES = 500_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECE}, part long, bin long, offset long, free long, n_bins long, gap long, ahead long"


def cut_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document's ids with the end id."""
    tokenizer = tokenizer or default_path()

    def run(batches):
        import pyarrow as pa

        code = coder(tokenizer)
        for batch in batches:
            for part in scratch.slices(batch, SLICE_BYTES):
                for at, ids, offsets in code.encode(text_bytes(part.column(1)), SLICE_BYTES):
                    rows, piece, start, length, crc = [], [], [], [], []
                    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                        own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                        for i, s in enumerate(range(0, len(own), capacity)):
                            cut = own[s : s + capacity]
                            rows.append(at + k)
                            piece.append(i)
                            start.append(s)
                            length.append(len(cut))
                            crc.append(zlib.crc32(cut.tobytes()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "piece", "start", "length", "ids_crc32"],
                    )
        scratch.release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECE)


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 60) -> int:
    """The best bound on the number of bins that the dual-feasible functions give."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity, steps)


def bound_of_counts(count: np.ndarray, capacity: int, steps: int = 60) -> int:
    """``lower_bound`` of so many pieces of each length 0..capacity."""
    count = count.astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    mass, number = np.concatenate([[0], np.cumsum(count * size)]), np.concatenate([[0], np.cumsum(count)])
    cut = np.arange(0, capacity // 2 + 1)
    # Above capacity - cut a piece counts as a whole bin, below cut as nothing.
    whole = (number[-1] - number[capacity - cut + 1]) * capacity + mass[capacity - cut + 1] - mass[cut]
    best = int(-(-whole.max() // capacity)) if count.any() else 0
    for k in range(1, steps + 1):
        scaled = (k + 1) * size
        stair = np.where(scaled % capacity == 0, k * size, capacity * (scaled // capacity))
        best = max(best, int(-(-int((stair * count).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece (given by descending length), and the bins' free room."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r: some bin has r free
    bins, offsets, free = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, length in enumerate(lengths.tolist()):
        fits = there >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                there &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = room - length
        if free[b]:
            open_bins[free[b]].append(b)
            there |= 1 << free[b]
    return bins, offsets, free


def _packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pack each value of ``part`` (bounded by PART_PIECES on average) by itself."""

    def run(table):
        import pyarrow as pa

        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = order.column("length").to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        n, free = len(lengths), np.array(free, np.int64)
        emptiest = np.argsort(-free, kind="stable")
        held = np.bincount(bins, minlength=len(free))[emptiest]
        ahead = np.empty(len(free), np.int64)
        ahead[emptiest] = np.cumsum(held)  # pieces in this bin and in those with more room
        out = {name: order.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32", "part")}
        out |= {"bin": pa.array(bins), "offset": pa.array(offsets), "free": pa.array(free[bins])}
        out |= {"n_bins": pa.array(np.full(n, len(free), np.int64)), "gap": pa.array(np.full(n, len(free) - lower_bound(lengths, capacity), np.int64)), "ahead": pa.array(ahead[bins])}
        return pa.table(out)

    return pieces.groupBy("part").applyInArrow(run, _PACKED)


def _bins(df: DataFrame) -> int:
    return df.select("part", "bin").distinct().count()


def pack(pieces: DataFrame, capacity: int = 2048, part_pieces: int = PART_PIECES, rounds: int = 8, most_pieces: int = PART_PIECES) -> tuple[DataFrame, list[dict]]:
    """Place all pieces; also return, per round, the bins, the certified bound of the whole and the partitions with a gap.

    ``part_pieces`` is the size partitions start with, ``most_pieces`` the size merged ones may reach.
    The result has the pieces' columns, ``sequence_id`` and ``offset``.
    """
    pieces, _ = scratch.save(pieces, "op3-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row per length up to the capacity
        counts[row["length"]] = row["count"]
    n, least = int(counts.sum()), bound_of_counts(counts, capacity)
    parts = max(1, math.ceil(n / part_pieces))
    keys = [F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("piece"), F.col("ids_crc32")]
    placed = scratch.saved(_packed(pieces.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts))), capacity), "op3-packed")
    certified = placed.where("gap <= 0").select("part").distinct().count()
    done = [_numbered(placed.where("free = 0"))]  # a full bin stays
    closed, current = _bins(placed.where("free = 0")), placed.where("free > 0")
    report, joint = [], False
    for turn in range(rounds + 1):
        total = closed + _bins(current)
        own = current.groupBy("part").agg(F.max("gap").alias("gap"))
        gapped, there = own.agg(F.count_if(F.col("gap") > 0), F.count("*")).first() if total > least else (0, 0)
        report.append({"round": turn, "bins": total, "bound": least, "parts": parts, "certified": certified, "gapped": gapped})
        joint = joint or gapped < 2
        open_parts = there if joint else gapped
        if turn == rounds or open_parts < 2:
            break
        merged = math.ceil(open_parts / FAN_IN)
        marked = current.join(own.where("true" if joint else "gap > 0").select("part", F.lit(True).alias("open")), "part", "left")
        moves = F.coalesce(F.col("open") & (F.col("ahead") <= max(1, most_pieces // min(FAN_IN, open_parts))), F.lit(False))
        # Other partners in every round.
        marked = scratch.saved(marked.withColumn("target", F.when(moves, F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(merged)))).drop("open"), "op3-marked")
        moving = marked.where("target is not null")
        again = scratch.saved(_packed(moving.select(*_PIECE_NAMES, F.col("target").alias("part")), capacity), "op3-again")
        before = moving.groupBy("target").agg(F.countDistinct("part", "bin").alias("old"))
        after = again.groupBy(F.col("part").alias("target")).agg(F.first("n_bins").alias("new"))
        better = scratch.saved(before.join(after, "target").where("new < old").select("target", F.lit(True).alias("won")), "op3-better")
        if better.isEmpty():
            if joint and merged == 1:
                break
            joint = True
            continue
        fresh = again.join(better.withColumnRenamed("target", "part"), "part", "left_semi").withColumn("part", F.col("part") + F.lit((turn + 1) << _PART_BITS))
        done.append(_numbered(fresh.where("free = 0")))
        closed += _bins(fresh.where("free = 0"))
        stay = marked.join(better, "target", "left").where("won is null").drop("target", "won")
        current = scratch.saved(stay.unionByName(fresh.where("free > 0")), "op3-current")
    out = _numbered(current)
    for part in done:
        out = out.unionByName(part)
    return out, report


#: Partitions of one round are numbered below this many bits.
_PART_BITS = 26
_PIECE_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def _numbered(df: DataFrame) -> DataFrame:
    return df.select(*_PIECE_NAMES, (F.col("part") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(scratch.table(spark, sf_dir, "documents")))[0]
