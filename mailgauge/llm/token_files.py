"""Operator 1: token ids of whole texts as compact binary files.

Every id becomes its frequency rank (rank 0: the most frequent id of the corpus, ties by
id), written in one to four bytes; the byte counts of four ranks share one control byte,
and control bytes and data bytes are stored apart. Reading is table lookup in numpy: the
control byte gives four lengths, running sums give places, a masked unaligned 32-bit load
gives the rank, and the rank table gives the id.

A file set is a folder with ``ranks`` (id, rank; as many rows as the vocabulary) and
``segments``: binary records of whole documents in ascending id order, at most
``SEGMENT_IDS`` ids each unless one document is longer. Files go through Spark's writer,
so a lost executor leaves no half-written segment.

Defined results: a null text is an empty text (it has only the end id); a null document id
sorts first; rows that repeat an id are ordered by length and ids, and all stay; an
empty table gives no segments. Only the two named columns are read, so other columns may
have any names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm import scratch
from mailgauge.llm.wordcoder import coder, default_path, forget, text_bytes

SEGMENT_IDS = 1_000_000
#: Ids that one range partition of the files aims at, and the most range partitions.
PART_IDS, MAX_PARTS = 4_000_000, 20_000
#: Text, or ids in two planes, that a worker has in hand at once, in bytes; only one document may pass it.
SLICE_BYTES = 2_000_000

_LENS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_ENCODED = "doc_id long, n_tokens long, low binary, high binary"
_SEGMENT = "part int, segment int, base long, n_docs long, n_ids long, id_nulls binary, doc_ids binary, lengths binary, control binary, data binary"


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = codes[::4] | (codes[1::4] << 2) | (codes[2::4] << 4) | (codes[3::4] << 6)
    widest = int(sizes.max(initial=1))
    parts, there = np.empty((len(ranks), widest), np.uint8), np.empty((len(ranks), widest), np.bool_)
    for k in range(widest):
        parts[:, k] = ranks >> np.uint32(8 * k)
        there[:, k] = sizes > k
    return control.tobytes(), np.compress(there.ravel(), parts.ravel()).tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks that ``pack_ranks`` wrote."""
    lens = _LENS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lens)
    if n and ends[-1] != len(data):
        raise ValueError("token segment is damaged: control and data bytes disagree")
    padded = data + b"\0\0\0"
    words = np.ndarray((max(len(padded) - 3, 0),), "<u4", padded, strides=(1,))
    return words[ends - lens] & _MASKS[lens]


def _kind(vocab: int) -> str:
    """numpy type of what an id has above its low byte, on the way to its segment."""
    return "<u1" if vocab <= 1 << 16 else "<u4"


def _binary(values: np.ndarray, offsets: np.ndarray):
    """Arrow binary column of the values of documents that lie one after another."""
    import pyarrow as pa

    values = np.ascontiguousarray(values)
    places = pa.py_buffer((offsets * values.itemsize).astype("<i8"))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, places, pa.py_buffer(values)]).cast(pa.binary())


def _planes(ids: np.ndarray, offsets: np.ndarray, kind: str) -> list:
    """Low bytes and the rest as two columns, which compress better apart."""
    return [_binary(ids.astype("<u1"), offsets), _binary((ids >> 8).astype(kind), offsets)]


def _values(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    size = np.dtype(kind).itemsize
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = str(column.type) == "large_binary"
    offsets = np.frombuffer(offsets, "<i8" if wide else "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    n = int(offsets[-1] - offsets[0]) // size
    return np.frombuffer(data, kind, count=n, offset=int(offsets[0])) if n else np.zeros(0, kind), (offsets - offsets[0]) // size


def _flat(low, high, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of the two columns, and where each begins and ends."""
    values, offsets = _values(low, "<u1")
    return values.astype(np.uint32) | (_values(high, kind)[0].astype(np.uint32) << np.uint32(8)), offsets


def encode_table(docs: DataFrame, tokenizer: str, end_id: int, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, number of ids with the end id, the ids in two planes."""

    def run(batches):
        import pyarrow as pa

        code = coder(tokenizer)
        for batch in batches:
            for part in scratch.slices(batch, SLICE_BYTES):
                for at, ids, offsets in code.encode(text_bytes(part.column(1)), SLICE_BYTES):
                    n = len(offsets) - 1
                    ended = np.insert(ids, offsets[1:], np.uint32(end_id))
                    own = offsets + np.arange(n + 1)
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(at, n), pa.array(np.diff(own)), *_planes(ended, own, kind)], ["doc_id", "n_tokens", "low", "high"])
        scratch.release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _ENCODED)


def _ranks(encoded: DataFrame, vocab: int, kind: str) -> np.ndarray:
    """Rank of each id over all documents. Only one count per vocabulary id reaches the driver."""

    def count(batches):
        import pyarrow as pa

        forget()
        seen = np.zeros(vocab, np.int64)
        for batch in batches:
            for part in scratch.slices(batch, SLICE_BYTES):
                seen += np.bincount(_flat(part.column(0), part.column(1), kind)[0], minlength=vocab)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(seen[there], pa.int64())], ["id", "n"])

    total = np.zeros(vocab, np.int64)
    for row in encoded.select("low", "high").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[row["id"]] = row["n"]
    ranks = np.empty(vocab, np.uint32)
    ranks[np.lexsort((np.arange(vocab), -total))] = np.arange(vocab, dtype=np.uint32)
    return ranks


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write the file set to ``path`` (a folder that does not exist yet)."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_path()
    vocab = max(coder(tokenizer).vocab_size, end_id + 1)
    kind = _kind(vocab)
    encoded, temp = scratch.save(encode_table(docs, tokenizer, end_id, kind, id_col, text_col), "op1-encoded")
    ranks = _ranks(encoded, vocab, kind)
    spark.createDataFrame([(int(i), int(r)) for i, r in enumerate(ranks)], "id long, rank long").coalesce(1).write.parquet(f"{path}/ranks")

    n_ids = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    parts = min(MAX_PARTS, max(1, math.ceil(n_ids / PART_IDS)))
    cuts = [k / parts for k in range(1, parts)]
    bounds = np.array((encoded.agg(F.percentile_approx("doc_id", cuts, 100_000)).first()[0] if cuts else None) or [], np.int64)

    def rank(batches):
        import pyarrow as pa

        forget()
        for batch in batches:
            for part in scratch.slices(batch, SLICE_BYTES):
                places = np.searchsorted(bounds, part.column(0).fill_null(-(2**63)).to_numpy())
                ids, offsets = _flat(part.column(2), part.column(3), kind)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *_planes(ranks[ids], offsets, kind), pa.array(places, pa.int32())], ["doc_id", "n_tokens", "low", "high", "place"])

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, segment, base = TaskContext.get().partitionId(), 0, 0
        held, n = [], 0

        def flush():
            nonlocal segment, base, held, n
            all_ranks = np.concatenate([x[1] for x in held])
            control, data = pack_ranks(all_ranks)
            row = [part, segment, base, len(held), n, bytes(x[0] is None for x in held), np.array([x[0] or 0 for x in held], "<i8").tobytes(), np.array([len(x[1]) for x in held], "<u4").tobytes(), control, data]
            segment, base, held, n = segment + 1, base + n, [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _SEGMENT.split(", ")])

        forget()
        for batch in batches:
            for piece in scratch.slices(batch, SLICE_BYTES):
                ids, offsets = _flat(piece.column(1), piece.column(2), kind)
                for doc, a, b in zip(piece.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = ids[a:b]
                    if held and n + len(own) > SEGMENT_IDS:
                        yield flush()
                    held.append((doc, own))
                    n += len(own)
        if held:
            yield flush()

    (
        encoded.mapInArrow(rank, f"{_ENCODED}, place int")
        .repartitionById(parts, "place")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "n_tokens", "low", "high")
        .select("doc_id", "low", "high")
        .mapInArrow(write, _SEGMENT)
        .write.option("compression", "zstd")
        .parquet(f"{path}/segments")
    )
    scratch.drop(spark, temp)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a file set in no set order: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    by_rank = np.zeros(0, "<u4")
    table = spark.read.schema("id long, rank long").parquet(f"{path}/ranks").collect()  # one row per vocabulary id
    if table:
        by_rank = np.zeros(len(table), "<u4")
        by_rank[[r["rank"] for r in table]] = [r["id"] for r in table]
    sizes = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row per file
    starts, at = {}, 0
    for part in sorted(sizes):
        starts[part], at = at, at + sizes[part]

    def read(batches):
        import pyarrow as pa

        forget()
        for batch in batches:
            for k in range(batch.num_rows):  # one segment at a time
                row = batch.slice(k, 1).to_pylist()[0]
                ids = by_rank[unpack_ranks(row["control"], row["data"], row["n_ids"])]
                lens = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lens)
                blobs = [ids[a:b].tobytes() for a, b in zip(ends - lens, ends, strict=True)]
                columns = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["id_nulls"], np.bool_)),
                    pa.array(starts[row["part"]] + row["base"] + ends - lens, pa.int64()),
                    pa.array(lens, pa.int64()),
                    pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(b, "<u4").astype(np.int64) for b in blobs], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return segments.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh_path(spark, "op1-files")
    write_token_files(scratch.table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
