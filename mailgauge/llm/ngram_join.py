"""Operator 8: near copies by exact Jaccard similarity of word shingles, by vertical partitioning.

1. *Order.* A pass over all texts counts the shingles in ``SKETCH`` hash buckets (a table
   of fixed size). A shingle's place in the global order is its bucket's count class, rare
   first, then its hash: any total order gives right results, this one puts what many
   texts share at the end.
2. *Classes.* Texts with the same word sequence are one class, known by a 128-bit hash of the
   words. A class carries its first shingles in the order: as many as it takes that two
   sets which reach the threshold share one of them.
3. *Candidates.* Classes that share such a shingle, and whose sizes and places there allow the
   threshold, are candidates if they share enough of their first shingles. First come hub turns:
   in each shingle the class with the fewest shingles of its own before it is the hub, and each
   class is compared with the hub it shares most shingles with; links found join components.
   Turns go on while the pairs left between components are many (``PAIRS_PER_ROW``, at most
   ``HUB_TURNS``); then all candidates left between components are compared. So a large group of
   near copies costs stars, not all its pairs, and no link between two components is missed.
4. *Fragments.* The global order is cut into ``FRAGMENTS`` ranges. Each candidate class's
   shingles are cut along them, overlaps are counted apart in each fragment and summed per
   pair; a pair links when ``den * overlap >= num * (size_a + size_b - overlap)``.
5. *Components* over the links give each class its smallest id.

Shingles are known by 64-bit hashes, of which 57 bits and the count class make the place.

Words are the runs of characters other than ASCII white space, A-Z lower-cased. A text with
fewer words than a shingle has its whole sequence as its one shingle; without words the set
is empty and links with nothing (its component is its own id). Null text is empty. Every
row is a document of its own, also where ids repeat; rows without an id link like others,
and a component without any id has a null one. An empty table gives no rows. Only the two
named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailgauge.llm import scratch
from mailgauge.llm.components import components

SKETCH, CHUNKS = 1 << 23, 64
FRAGMENTS = 8
HUB_TURNS, PAIRS_PER_ROW = 4, 4
#: Bits of the filter that keeps texts without candidates out of the counting pass: 4 MB.
FILTER_BITS = 1 << 25
_WORDS = 200_000


@scratch.kept
def _hashes() -> dict[bytes, int]:
    """64-bit hashes of the words a worker met last."""
    return {}


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of an Arrow column, one text after another, and each text's bounds."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(column.cast(pa.string()).fill_null("")))
    coded = pc.dictionary_encode(split.flatten().cast(pa.binary()))
    words, known = coded.dictionary.to_pylist(), _hashes()
    if len(known) > _WORDS:
        known.clear()
    for word in words:
        if word not in known:
            known[word] = xxhash.xxh3_64_intdigest(word)
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    at, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    if b"" in known and b"" in words:  # white space at the ends of a text
        full = at != words.index(b"")
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        at = at[full]
    return own[at], bounds


def _small(batches):
    """Arrow batches in slices, so that few texts are in hand at once; before and after, what is not in use goes back."""
    scratch.release()
    for batch in batches:
        yield from scratch.slices(batch)
    scratch.release()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, 0x9E3779B97F4A7C15 + width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        out ^= out >> np.uint64(29)
    return _mixed(out)


def shingle_sets(column, width: int, level: np.ndarray):
    """Per text of a column: its shingles' places in the global order, sorted, and the class of its word sequence.

    A place is the count class of the shingle's bucket, then 57 bits of its hash, as a non-negative long.
    """
    import xxhash

    words, bounds = word_hashes(column)

    def places(grams):
        classes = level[(grams & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
        return ((classes << np.uint64(57)) | (grams >> np.uint64(7))).view(np.int64)

    found = places(_grams(words, width))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.sort(found[a : b - width + 1] if b - a >= width else places(_grams(words[a:b], b - a)) if b > a else found[:0])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        yield own, xxhash.xxh3_128_digest(words[a:b].tobytes())


def _levels(docs: DataFrame, width: int) -> np.ndarray:
    """Count class (0..63) of each bucket over all texts. SKETCH numbers reach the driver, whatever the input."""
    step = SKETCH // CHUNKS

    def count(batches):
        import pyarrow as pa
        import zstandard

        seen = np.zeros(SKETCH, np.uint32)
        for batch in _small(batches):
            words, bounds = word_hashes(batch.column(0))
            lens = np.diff(bounds)
            inside = np.arange(len(words)) < np.repeat(bounds[1:] - np.minimum(width, lens) + 1, lens)  # the text's last shingle and those before
            grams = _grams(words, width)
            np.add.at(seen, (grams[inside[: len(grams)]] & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
        if seen.any():
            blobs = [zstandard.compress(seen[k * step : (k + 1) * step].tobytes()) for k in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "counts"])

    def add(batches):
        import pyarrow as pa
        import zstandard

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(chunk, np.zeros(step, np.uint64))
                own += np.frombuffer(zstandard.decompress(blob), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    kind = "chunk int, counts binary"
    counts = np.zeros(SKETCH, np.uint32)
    for row in docs.select("text").mapInArrow(count, kind).repartition(CHUNKS, "chunk").mapInArrow(add, kind).toLocalIterator():
        own = np.minimum(np.frombuffer(row["counts"], np.uint64), np.iinfo(np.uint32).max)
        counts[row["chunk"] * step : (row["chunk"] + 1) * step] = own
    mean = counts.mean(dtype=np.float64)
    usual = max(1.0, mean + 2.5 * math.sqrt(mean))  # up to here the hash alone decides
    # Four classes for each doubling beyond that; every count has its class.
    edges = usual * 2.0 ** (np.arange(63) / 4)
    return np.concatenate([np.searchsorted(edges, counts[k : k + step]).astype(np.uint8) for k in range(0, SKETCH, step)])


def _least_overlap(n: int, num: int, den: int) -> int:
    """The fewest shingles a set of n shares with any set it links with."""
    return max(1, -(-num * n // den))


def _members(docs: DataFrame, width: int, num: int, den: int, level) -> DataFrame:
    """Per row: id, class, set size, and the class's first shingles (once for each class and task, within memory)."""

    def run(batches):
        import pyarrow as pa

        seen: set[bytes] = set()
        for batch in _small(batches):
            sizes, classes, firsts = [], [], []
            for places, key in shingle_sets(batch.column(1), width, level.value):
                n = len(places)
                sizes.append(n)
                classes.append(key)
                if not n or key in seen:
                    firsts.append(None)
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                firsts.append(places[: n - _least_overlap(n, num, den) + 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))],
                ["doc_id", "class", "n", "first"],
            )

    return docs.mapInArrow(run, "doc_id long, class binary, n long, first array<long>")


def _may_link(num: int, den: int):
    """Whether sizes and places of one shared shingle (columns of sides x and y) allow the threshold."""
    nx, ny = F.col("x.n"), F.col("y.n")
    behind = lambda n: F.ceil(n * num / den) - 1
    # ``rest`` misses what lies in this first part and behind the other one, so it bounds only on the side that ends earlier.
    indexed = F.when(F.col("x.last") <= F.col("y.last"), F.col("x.rest") + behind(nx)).otherwise(F.col("y.rest") + behind(ny))
    after = F.least(indexed, nx - F.col("x.pos") - 1, ny - F.col("y.pos") - 1)
    most = F.least("x.ahead", "y.ahead") + 1 + after
    return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (most * (num + den) >= (nx + ny) * num)


def _pairs(x: DataFrame, y: DataFrame, condition, hubs: bool = False) -> DataFrame:
    """Pairs of nodes that meet in the shingles of both sides, with the number of those shingles; for hubs also the node that is none."""
    met = x.alias("x").join(y.alias("y"), (F.col("x.place") == F.col("y.place")) & condition)
    small = F.col("x.node") < F.col("y.node")
    pick = lambda c, first: F.when(small == F.lit(first), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    met = met.select(pick("node", True).alias("a"), pick("node", False).alias("b"), pick("n", True).alias("na"), pick("n", False).alias("nb"), *([F.col("x.node").alias("own")] if hubs else []))
    return met.groupBy("a", "b", "na", "nb", *(["own"] if hubs else [])).agg(F.count("*").alias("shared"))


def _best_hubs(pairs: DataFrame) -> DataFrame:
    """For each node the one hub it shares most first shingles with: a guess that only the order of comparisons depends on."""
    best = F.max(F.struct("shared", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), "na", "nb"))
    return pairs.groupBy("own").agg(best.alias("x")).select((-F.col("x.a")).alias("a"), (-F.col("x.b")).alias("b"), "x.na", "x.nb").distinct()


def _enough_first(num: int, den: int, times: int = 1):
    """Whether ``shared``, the number of shared first shingles, leaves room for the threshold.

    A shared shingle is in both first parts or lies behind the one that ends earlier, so the overlap is at most ``shared``
    and what lies behind the first part of one of the two. With ``times`` the number is only a part of them.
    """
    behind = lambda n: F.ceil(F.col(n) * num / den) - 1
    return (F.col("shared") * times + F.greatest(behind("na"), behind("nb"))) * (num + den) >= (F.col("na") + F.col("nb")) * num


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, num: int, den: int, level) -> DataFrame:
    """The pairs that reach the threshold: shared shingles counted in each fragment, summed per pair."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.saved(classes.select("node", "class", "row_id").join(ends, "node", "left_semi"), "op8-wanted")

    def mark(batches):
        import pyarrow as pa

        own = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = _filter_bits(batch.column(0).to_numpy())
            np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        there = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(own[there].astype(np.int64))], ["byte", "bits"])

    # The filter has a fixed size. False hits only cost work; the joins below are exact.
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in wanted.select("row_id").mapInArrow(mark, "byte long, bits long").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        bits[row["byte"]] = row["bits"]
    sent = spark.sparkContext.broadcast(bits)
    # Cuts of equal weight: the hash is uniform below the rare class's top, all commoner classes share the last fragment.
    pivots = np.array([(1 << 57) * k // (FRAGMENTS - 1) for k in range(1, FRAGMENTS)], np.int64)

    def cut(batches):
        import pyarrow as pa

        seen: set = set()
        for batch in _small(batches):
            at = _filter_bits(batch.column(0).fill_null(_NO_ID).to_numpy())
            part = batch.filter(pa.array((sent.value[at >> 3] >> (at & 7)) & 1 == 1))
            classes, fragments, segments = [], [], []
            for places, key in shingle_sets(part.column(1), width, level.value):
                if key in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                for k, own in enumerate(np.split(places, np.searchsorted(places, pivots))):
                    if len(own):
                        classes.append(key)
                        fragments.append(k)
                        segments.append(own)
            if segments:
                yield _segments(classes, fragments, segments)

    cuts = docs.mapInArrow(cut, "class binary, fragment int, own array<long>").join(wanted.select("class", "node"), "class").select("node", "fragment", "own")
    cuts, cuts_path = scratch.save(cuts, "op8-cuts")
    left = pairs.join(cuts.select(F.col("node").alias("a"), "fragment", F.col("own").alias("own_a")), "a")
    both = left.join(cuts.select(F.col("node").alias("b"), "fragment", F.col("own").alias("own_b")), ["b", "fragment"])
    shared = both.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("own_a", "own_b")).cast("long").alias("shared"))
    # A class that several tasks cut counts once in each fragment.
    counted = shared.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("shared").alias("shared")).groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("overlap"))
    found = scratch.saved(counted.where(F.col("overlap") * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b"), "op8-links")
    scratch.drop(spark, cuts_path)
    return found


#: Stands for a null id inside the operator.
_NO_ID = -(2**63)


def _segments(classes: list, fragments: list, segments: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(fragments, pa.int32()), pa.array(segments, pa.list_(pa.int64()))], ["class", "fragment", "own"])


def _filter_bits(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _with_roots(index: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The index with each node's component, without shingles that lie in one component only."""
    each = Window.partitionBy("place")
    if roots is None:
        shared = index.withColumn("met", F.count("*").over(each)).where("met > 1")
        # Up to the end of the first part that ends earlier, what two classes share is in both first parts and so in the index:
        # only shingles there count as ``ahead`` of a place and, on that side, as its ``rest``.
        mine = Window.partitionBy("node")
        shared = shared.withColumn("ahead", F.row_number().over(mine.orderBy("pos")) - 1).withColumn("rest", F.count("*").over(mine) - 1 - F.col("ahead"))
        return shared.drop("met").withColumn("comp", F.col("node"))
    index = index.drop("comp").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = index.withColumn("low", F.min("comp").over(each)).withColumn("high", F.max("comp").over(each))
    return mixed.where("low < high").drop("low", "high")


def _many(index: DataFrame, n_found: int) -> bool:
    """Whether hubs go on: the pairs left are many and the last hubs still joined a good part, or the pairs are very many."""
    sizes = index.groupBy("place", "comp").agg(F.count("*").alias("c")).groupBy("place").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    left = sizes.agg(F.sum("s").alias("rows"), (F.sum(F.col("s").cast("double") * F.col("s") - F.col("q")) / 2).alias("pairs")).first()
    per_row = left["pairs"] / left["rows"]
    return per_row > PAIRS_PER_ROW and (n_found * 20 > left["rows"] or n_found > 0 and per_row > 25 * PAIRS_PER_ROW)


def jaccard_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id. Links have Jaccard >= num/den."""
    if not 0 < num <= den:
        raise ValueError("the threshold num/den lies in (0, 1]")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    level = spark.sparkContext.broadcast(_levels(docs, width))
    members = scratch.saved(_members(docs, width, num, den, level), "op8-members")
    classes = members.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least_id"), F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("row_id"), F.max("n").alias("n"), F.first("first", ignorenulls=True).alias("first"))
    classes = scratch.saved(classes.withColumn("node", F.monotonically_increasing_id()), "op8-classes")

    entries = classes.select("node", "n", F.element_at("first", -1).alias("last"), F.posexplode("first").alias("pos", "place"))
    index, path = scratch.save(_with_roots(entries, None), "op8-index")
    may, links, roots, checked, n_found = _may_link(num, den), None, None, None, 0
    for turn in range(HUB_TURNS + 1):
        if index.isEmpty():
            break
        last = turn == HUB_TURNS or turn > 0 and not _many(index, n_found)
        if last:
            pairs = _pairs(index, index, may & (F.col("x.comp") < F.col("y.comp"))).where(_enough_first(num, den))
        else:
            hubs = index.groupBy("place").agg(F.min(F.struct((F.col("pos") - F.col("ahead")).alias("private"), "node", "n", "pos", "last", "ahead", "rest", "comp")).alias("hub")).select("place", "hub.*")
            # Pairs that meet in too few hub shingles wait for the last turn, where all shared shingles count.
            met = _pairs(index, hubs, may & (F.col("x.comp") != F.col("y.comp")), True)
            pairs = _best_hubs(met.where(_enough_first(num, den, 2)))
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = scratch.saved(pairs.select("a", "b", "na", "nb"), "op8-pairs")
        found = _links(docs, classes, pairs, width, num, den, level)
        n_found = found.count()
        links = found if links is None else links.unionByName(found)
        checked = pairs.select("a", "b") if checked is None else checked.unionByName(pairs.select("a", "b"))
        roots = components(links)
        if last:
            break
        (index, path), old = scratch.save(_with_roots(index, roots), "op8-index"), path
        scratch.drop(spark, old)

    named = classes.select("class", "node", "least_id")
    if roots is not None:
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
        named = named.join(smallest, "root").select("class", "component_id")
    else:
        named = named.select("class", F.col("least_id").alias("component_id"))
    out = members.where("n > 0").select("doc_id", "class", "n").join(named, "class")
    empty = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (rows that repeat it: one of them).

    Rows without an id stay: nothing tells which of them to keep.
    """
    name = scratch.fresh_name(docs, "head_id")
    heads = scratch.saved(jaccard_groups(docs, width, num, den).where("doc_id = component_id").select(F.col("doc_id").alias(name)), "op8-heads")
    named = docs.where("doc_id IS NOT NULL").join(heads, F.col("doc_id") == F.col(name), "left_semi")
    if not heads.groupBy(name).count().where("count > 1").isEmpty():
        named = named.dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(scratch.table(spark, sf_dir, "documents"), width=4, num=85, den=100)
