"""Operator 6: toxicity by compression distance to two trained zstandard dictionaries.

*Training* (driver; a bounded sample of labelled rows, the smallest by a hash of the id: at most
``TOXIC_DOCS`` and ``PLAIN_DOCS`` rows and ``TOXIC_BYTES`` and ``PLAIN_BYTES`` of text; a row that would
pass the bytes left is passed over). Of each class two thirds train dictionaries, one third calibrates;
near copies among the former count once. zstandard trains a base dictionary on the ordinary texts. Then it trains
one dictionary on the toxic and one on the ordinary texts, of equal size, each on what its class's texts have beside the
other's: in each text, the words more than half of which is covered by ``GRAM`` bytes in a row that tell the class, and nothing else.
Bytes tell a class if they are in ``LEAST_TEXTS`` of its texts or more, in ``TIMES`` the other's share of texts or more, and
the likelihood ratio of the two counts of texts is ``TELLING`` or more, so chance does not bring them in (counted by a hash of
``SLOT_BITS`` bits). A class without such words trains on all its texts; a dictionary that comes out short is filled up in front with the base's end.
zstandard ends early where ten stretches in a row bring nothing new (a long text of one line again and again left 27 kB of
110 kB), so samples are mixed, and longer segments are tried if it still ends early.
The two are followed by the base at the same distance, so a window that knows
neither class's own text costs the same in both. Of the sizes ``OWN_BYTES`` the one with the least loss in calibration stays.

*Scoring* (executors). A text is lower-cased, all but letters become blanks, and windows of
``WINDOW`` words every ``STEP`` words are compressed with both dictionaries. How many and which
share of windows are shorter with the toxic one, by how many bytes, gives the score through a
logistic curve calibrated on labelled rows that no dictionary has seen, corrected for the
sampling rates of the two classes. Every window of every text is compressed.

Defined results: null and empty texts and texts without letters score like a text without
toxic windows; rows with a null id are scored (they are never held out and never used for
training); rows that repeat are scored one by one, and the first of equal ids serves for training; an id with several
labels counts as toxic if one is 1; with fewer than two training rows of a class the score is the share of 1 (0 without any); a class whose texts are
too short to train on has its text itself for a dictionary. Labels, language and source
are no inputs of a score. Only the named columns are read; ``score`` keeps all others, and refuses a name for its own column that the table has (in any case).
"""

from __future__ import annotations

import math
import pickle
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailgauge.llm import scratch
from mailgauge.llm.wordcoder import text_bytes

#: Bounds of the training sample, in rows and in bytes of text.
TOXIC_DOCS, PLAIN_DOCS = 2_000, 5_000
TOXIC_BYTES, PLAIN_BYTES = 12_000_000, 24_000_000
WINDOW, STEP = 6, 3
LEVEL = 5
#: Size of the base, and the sizes tried for each class's own dictionary; least and largest length of the segments a dictionary is put together from; bytes that make a match.
BASE_BYTES, OWN_BYTES = 110_000, (1_500, 3_000)
SEGMENT, LONGEST_SEGMENT, GRAM = 24, 384, 6
#: When bytes tell a class: texts that have them, how many times the other's share, likelihood ratio of the counts; bits of the hash they are counted by.
LEAST_TEXTS, TIMES, TELLING, SLOT_BITS = 3, 2, 25.0, 24
SHARPNESS = 7
#: Text compressed at once, in bytes.
SLICE_BYTES = 1_000_000
THRESHOLD = 0.3

_OTHER = re.compile(rb"[^a-z\x80-\xff]+")


def _plain(text: bytes) -> bytes:
    clean = _OTHER.sub(b" ", text.lower()).strip()
    return b" " + clean + b" " if clean else b" "


def _windows(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Cleaned texts in one buffer; (offset, length) of every window; the windows of each text."""
    buffer = b"".join(texts)
    blanks = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    ends = np.cumsum([len(t) for t in texts])
    last = np.searchsorted(blanks, ends) - 1  # the blank at each text's end
    first = np.concatenate([[0], last[:-1] + 1])
    words = last - first  # a text of w words has w + 1 blanks
    counts = np.where(words > 0, -(-np.maximum(words - WINDOW, 0) // STEP) + 1, 0)
    text_of = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = first[text_of] + number * STEP
    stop = np.minimum(start + WINDOW, last[text_of])
    offsets = blanks[start]
    return buffer, np.stack([offsets, blanks[stop] - offsets + 1], axis=1).astype("<u8"), counts


@dataclass
class Model:
    toxic: bytes
    plain: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]
    share: float

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def __setstate__(self, state):
        self.__dict__.update(state, _compressors=None)

    def _gains(self, buffer: bytes, segments: np.ndarray) -> np.ndarray:
        """By how many bytes each window is shorter with the toxic dictionary."""
        import zstandard as zstd

        if self._compressors is None:
            kinds = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0, "format": zstd.FORMAT_ZSTD1_MAGICLESS, "min_match": 3, "source_size": 64}
            self._compressors = []
            for content in (self.plain, self.toxic):
                params = zstd.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), **kinds)
                self._compressors.append(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params))
        if not len(segments):
            return np.zeros(0, np.int64)
        plain, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(zstd.BufferWithSegments(buffer, segments.tobytes()))), np.int64, len(segments)) for c in self._compressors)
        return plain - toxic

    def features(self, texts: list[bytes]) -> np.ndarray:
        clean, out, at = [_plain(t) for t in texts], [], 0
        while at < len(clean):
            end, size = at, 0
            while end < len(clean) and (end == at or size + len(clean[end]) <= SLICE_BYTES):
                size += len(clean[end])
                end += 1
            buffer, segments, counts = _windows(clean[at:end])
            out.append(_features(self._gains(buffer, segments), counts))
            at = end
        return np.concatenate(out) if out else np.zeros((0, 4 + 3 * SHARPNESS))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.share)
        x = (self.features(texts) - self.mean) / self.scale
        z = self.weights[0] + x @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _features(gains: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(counts)
    text_of = np.repeat(np.arange(n), counts)
    size = np.maximum(counts, 1)
    total = lambda w: np.bincount(text_of, weights=w, minlength=n)
    against = total((gains <= -2).astype(float))
    out = [np.log(size), total(gains) / size, (against > 0).astype(float), np.sqrt(against / size)]
    for least in range(1, SHARPNESS + 1):
        hits = total((gains >= least).astype(float))
        out += [np.log1p(hits), np.sqrt(hits / size), (hits > 0).astype(float)]
    return np.stack(out, axis=1)


def _one_of_each(texts: list[bytes]) -> list[bytes]:
    """Cleaned texts without near copies: one per smallest hash of five words."""
    import xxhash

    found = {}
    for text in texts:
        words = text.split()
        if words:
            found.setdefault(min(xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), text)
    return list(found.values())


def _lines(texts: list[bytes], words: int = 40) -> list[bytes]:
    return [b" ".join(own[i : i + words]) for own in map(bytes.split, texts) for i in range(0, len(own), words)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """What zstandard's training puts into a dictionary, the most useful last; of too little text the text itself."""
    import zstandard as zstd

    best, segment = b"", SEGMENT
    samples = [samples[i] for i in np.random.default_rng(0).permutation(len(samples))]
    while len(best) < size and segment <= LONGEST_SEGMENT:
        try:
            found = zstd.train_dictionary(size + 600, samples, k=segment, d=GRAM, level=LEVEL).as_bytes()[-size:]  # the header goes
        except zstd.ZstdError:
            break
        best, segment = max(best, found, key=len), 2 * segment
    return best or b" ".join(samples)[-size:]


def _slots(text: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on."""
    flat = np.frombuffer(text, np.uint8)
    out = np.zeros(max(0, len(flat) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | flat[k : k + len(out)]
    return ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _counts(texts: list[bytes]) -> np.ndarray:
    """By hash, how many texts have such bytes."""
    out = np.zeros(1 << SLOT_BITS, np.uint32)
    for text in texts:
        out[np.unique(_slots(text))] += 1
    return out


def _telling(own: np.ndarray, n: int, other: np.ndarray, m: int) -> np.ndarray:
    """By hash, whether such bytes tell the class with ``own`` counts over ``n`` texts from the other with ``other`` over ``m``."""
    at = np.flatnonzero(own >= LEAST_TEXTS)
    a, b = own[at].astype(float), other[at].astype(float)
    by_chance = (a + b) * n / max(1, n + m)
    ratio = 2 * (a * np.log(a / by_chance) + b * np.log(np.maximum(b, 1e-9) / np.maximum(a + b - by_chance, 1e-9)))
    out = np.zeros(1 << SLOT_BITS, bool)
    out[at[(ratio >= TELLING) & (a * m >= TIMES * b * n)]] = True
    return out


def _own_words(texts: list[bytes], telling: np.ndarray) -> list[bytes]:
    """Of each cleaned text the words that telling bytes cover by more than half, in order; texts without any go."""
    out = []
    for text in texts:
        at = np.flatnonzero(telling[_slots(text)])
        if len(at):
            turns = np.zeros(len(text) + 1, np.int64)
            turns[at] += 1
            turns[at + GRAM] -= 1
            covered = np.concatenate([[0], np.cumsum(np.cumsum(turns[:-1]) > 0)])
            blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            first, last = blanks[:-1] + 1, blanks[1:]
            words = np.flatnonzero(2 * (covered[last] - covered[first]) > last - first)
            if len(words):
                out.append(b" " + b" ".join(text[first[i] : last[i]] for i in words.tolist()) + b" ")
    return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + penalty * np.eye(len(w)), a.T @ (p - y) / len(y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[bytes], labels: list[int], share: float) -> Model:
    """Model from labelled texts; ``share`` is the share of label 1 among all training labels."""
    y, rng = np.array(labels), np.random.default_rng(0)
    rows = {k: rng.permutation(np.flatnonzero(y == k)) for k in (0, 1)}
    if min(map(len, rows.values())) < 2:
        return Model(b"", b"", [], [], [], share)
    held = {k: v[: max(1, len(v) // 3)] for k, v in rows.items()}
    seen = {k: _one_of_each([_plain(texts[i]) for i in v[len(held[k]) :]]) for k, v in rows.items()}
    base = _dictionary(_lines(seen[0]), BASE_BYTES)
    rest = np.concatenate([held[0], held[1]])
    sampled, best = y[rest].mean(), None
    counts = {k: _counts(v) for k, v in seen.items()}
    parts = {k: _own_words(v, _telling(counts[k], len(v), counts[1 - k], len(seen[1 - k]))) or _lines(v) for k, v in seen.items()}
    for size in OWN_BYTES:
        own = {k: (base[-size:] + _dictionary(part, size))[-size:] for k, part in parts.items()}
        room = min(map(len, own.values()))
        model = Model(*(own[k][len(own[k]) - room :] + base for k in (1, 0)), [], [], [], share)
        x = model.features([texts[i] for i in rest])
        model.mean, model.scale = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-9).tolist()
        x = (x - model.mean) / model.scale
        w = _logistic(x, y[rest].astype(float))
        z = w[0] + x @ w[1:]
        loss = np.logaddexp(0, np.where(y[rest] == 1, -z, z)).mean()
        w[0] += math.log(share / (1 - share)) - math.log(sampled / (1 - sampled))
        model.weights = w.tolist()
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, is_training, toxic_docs: int = TOXIC_DOCS, plain_docs: int = PLAIN_DOCS, toxic_bytes: int = TOXIC_BYTES, plain_bytes: int = PLAIN_BYTES) -> Model:
    """Train on a bounded sample of the labelled rows of ``docs``; ``is_training`` maps an id column to a condition."""
    import pyarrow as pa

    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(is_training(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    mix = F.xxhash64("doc_id")
    ids = marked.where("toxic = 1").orderBy(mix, "doc_id").limit(toxic_docs).unionByName(marked.where("toxic = 0").orderBy(mix, "doc_id").limit(plain_docs))
    ids = scratch.saved(ids, "op6-sample")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # at most toxic_docs + plain_docs ids
    sizes = own.groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("size"), F.min(F.xxhash64("text")).alias("version"))
    left, chosen = {1: toxic_bytes, 0: plain_bytes}, []
    for r in sizes.orderBy(mix, "doc_id").collect():  # a few numbers for each of those ids
        if r["size"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["size"]
            chosen.append((r["doc_id"], r["version"]))
    if not chosen:
        return train([], [], n.get(1, 0) / total if total else 0.0)
    chosen_ids, versions = (pa.array(x, pa.int64()) for x in zip(*chosen, strict=True))
    wanted = docs.sparkSession.createDataFrame(pa.table({"doc_id": chosen_ids, "version": versions}))  # of a list it would start Python workers, which stay
    rows = own.withColumn("version", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "version"]).dropDuplicates(["doc_id"]).orderBy(mix, "doc_id").collect()  # at most the bytes above
    return train([r["text"].encode() for r in rows], [r["toxic"] for r in rows], n.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: its score, 0 to 1."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the table has a column {name} already")
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def run(batches):
        import pyarrow as pa

        scratch.release()
        own = pickle.loads(sent.value)
        for batch in batches:
            for part in scratch.slices(batch):
                found = own.scores(text_bytes(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names)
        scratch.release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, scratch.table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
