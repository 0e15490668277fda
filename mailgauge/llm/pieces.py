"""Operator 4: SentencePiece encoding and decoding by suffix-array matching.

Texts are cut at blanks and at characters without a piece, across which no piece reaches
(checked when a model is loaded). For the distinct units a batch has and the worker does
not remember, the concatenated units get a suffix array (to the depth of the longest
piece), every piece of the vocabulary is binary-searched in it for its range of
occurrences, and the occurrences become edges sorted by end position. Relaxing the edges in that order,
longest first, keeps at each position the one edge that byte-pair merging would leave
there: a piece may follow the piece kept at its start exactly if no merge across their
boundary comes before the merges that form the two. Runs of blanks and unknown characters (byte pieces)
are put in afterwards. The result is the library's own segmentation.

Decoding joins piece bytes by table lookup.

The operator takes models of type BPE with byte fallback, identity normalisation and a
dummy prefix, and refuses others.

Defined results: null and empty texts have no ids; a null id and repeated rows are encoded one by
one; U+2581 counts as a blank, as in the library; an empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm import scratch
from mailgauge.llm.wordcoder import text_bytes

BLANK = "▁"
#: Units a worker remembers, and characters of new units that get one suffix array.
CACHE_UNITS, INDEX_CHARS = 400_000, 500_000
SLICE_ROWS = 1_000
_UNKNOWN, _PAD = 0xFFFE, 0xFFFF
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_NEVER = np.int64(1) << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _merged(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merging of a short list: the lowest rank first, the leftmost of equals; also the last merge."""
    symbols, last = list(symbols), None
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            return symbols, last
        i = best[1]
        last = (symbols[i], symbols[i + 1])
        symbols[i : i + 2] = ["".join(last)]


class PieceCoder:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != pb.TrainerSpec.BPE or not spec.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix")
        kinds = pb.ModelProto.SentencePiece
        self.size = len(model.pieces)
        self.byte_id, normal, self.surface = {}, {}, []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.NORMAL:
                normal[p.piece] = i
                self.surface.append(p.piece.replace(BLANK, " ").encode())
            elif p.type in (kinds.UNKNOWN, kinds.CONTROL):
                self.surface.append(b"")
            else:
                raise ValueError("models with user-defined or unused pieces are not taken")
        if any(re.search(f"[^{BLANK}]{BLANK}|{BLANK}{BLANK}[^{BLANK}]", p) for p in normal) or any(c not in normal for p in normal for c in p):
            raise ValueError("a piece reaches across a blank, or has a character that is no piece")
        self.ids = normal
        # No piece has a letter before another ASCII sign: texts can be cut there, and units repeat more often.
        self.edges = not any(re.search(f"[{_LETTERS}][!-@\\[-`{{-~]", p) for p in normal)
        score = {p: model.pieces[i].score for p, i in normal.items()}
        self.blank_runs = {p: score[p] for p in normal if set(p) == {BLANK}}
        words = [p for p in normal if set(p) != {BLANK} or p == BLANK]
        # Ranks: a piece of several characters by falling score; single characters come first.
        order = sorted((p for p in words if len(p) > 1), key=lambda p: -score[p])
        if len({score[p] for p in order}) != len(order) or any(len(p) > 1 and score[p] >= min((score[q] for q in order), default=0) for p in self.blank_runs):
            raise ValueError("merges of equal score")
        rank = {p: k for k, p in enumerate(order)}
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.letters = [p for p in words if len(p) == 1]
        usable = [p for p in words if len(p) == 1]
        for p in order:
            made, last = _merged(list(p), rank)
            if len(made) == 1:
                usable.append(p)
                i = normal[p]
                self.rank[i], self.left[i], self.right[i] = rank[p], normal[last[0]], normal[last[1]]
        pairs = [(normal[p[:k]] * self.size + normal[p[k:]], rank[p]) for p in order for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        pairs.sort()
        self.pair_keys, self.pair_ranks = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        code = {c: k + 1 for k, c in enumerate(sorted(self.letters))}
        self.code = np.full(0x110000, _UNKNOWN, np.uint16)
        self.code[[ord(c) for c in code]] = list(code.values())
        self.depth = -(-max(map(len, usable)) // 4) * 4
        self.piece_ids = np.array([normal[p] for p in usable], np.int64)
        self.piece_lens = np.array([len(p) for p in usable], np.int64)
        self.piece_low, self.piece_high = (self._keys(usable, [code[c] for p in usable for c in p], fill) for fill in (0, _PAD))
        self.blank = normal[BLANK]
        self.flat_surface = np.frombuffer(b"".join(self.surface), np.uint8)
        self.surface_lens = np.array([len(s) for s in self.surface], np.int64)
        self.surface_starts = np.cumsum(self.surface_lens) - self.surface_lens
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lens, self.used = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _keys(self, pieces: list[str], codes: list[int], fill: int) -> list[np.ndarray]:
        table = np.full((len(pieces), self.depth), fill, np.uint16)
        lens = np.array([len(p) for p in pieces])
        table[np.arange(self.depth) < lens[:, None]] = codes
        return _columns(table)

    # -- occurrences

    def _occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges of all pieces in the text: start, piece, length, by end position and then longest first."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.depth, np.uint16)])
        columns = _columns(np.lib.stride_tricks.sliding_window_view(padded, self.depth)[:n])
        order = np.lexsort(columns[::-1])
        ordered = [c[order] for c in columns]
        low, high = _search(ordered, self.piece_low), _search(ordered, self.piece_high)
        found = high - low
        which = np.repeat(np.arange(len(found)), found)
        start = order[np.arange(found.sum()) + np.repeat(low - (np.cumsum(found) - found), found)]
        length = self.piece_lens[which]
        by = np.lexsort((-length, start + length))
        return start[by], self.piece_ids[which][by], length[by]

    # -- which pieces may follow which

    def _may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves ``first`` and ``second`` as they are when they stand side by side.

        Going back in time, the later of the two pieces' last merges is undone; if the two
        symbols then at the boundary would have merged before that, the pair does not last.
        """
        lasts = np.ones(len(first), bool)
        rows, x, y = np.arange(len(first)), first.copy(), second.copy()
        limit = np.full(len(first), _NEVER)
        while len(rows):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            broken = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            lasts[rows[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~broken & (np.maximum(rx, ry) >= 0)
            undo_x = rx > ry
            # A merge on the right of the boundary comes after one across it that has the same rank.
            limit = np.where(undo_x, rx, ry + 1)[go]
            x, y, rows = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go], rows[go]
        return lasts

    # -- units

    def _segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after another, and their numbers. Units are not empty."""
        text = "\0".join(units) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        codes[points == 0] = 0
        sizes = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        if (codes == 0).sum() != len(units):
            raise ValueError("a unit holds U+0000")
        start, piece, length = self._occurrences(codes)
        unknown = np.flatnonzero(codes == _UNKNOWN)
        end = start + length
        # Kept at each position: the id of the piece that ends there, and its length.
        kept, back = np.full(len(codes) + 1, -2, np.int64), np.ones(len(codes) + 1, np.int64)
        kept[begin] = -1
        kept[unknown + 1] = -1  # a byte piece: nothing merges with it
        back[unknown + 1] = 1
        unit_of = np.repeat(np.arange(len(units)), sizes + 1)
        distance = end - begin[unit_of[start]]
        rank_in_end = np.arange(len(end)) - np.searchsorted(end, end)  # 0: the longest edge into a position
        by = np.lexsort((rank_in_end, distance))
        groups = np.flatnonzero(np.diff(distance[by] * 64 + rank_in_end[by], prepend=-1))
        for a, b in zip(groups.tolist(), np.append(groups[1:], len(by)).tolist(), strict=True):
            edges = by[a:b]
            edges = edges[kept[end[edges]] == -2]
            before = kept[start[edges]]
            good = before == -1
            test = np.flatnonzero(before >= 0)
            good[test] = self._may_follow(before[test], piece[edges[test]])
            won = edges[good]
            kept[end[won]], back[end[won]] = piece[won], length[won]
        if (kept[begin + sizes] == -2).any():
            raise ValueError("a unit has no segmentation")
        # Follow the kept pieces from each unit's end.
        units_at, at, out_unit, out_end, out_id = np.arange(len(units)), begin + sizes, [], [], []
        while len(units_at):
            out_unit.append(units_at)
            out_end.append(at)
            out_id.append(np.where(kept[at] >= 0, kept[at], -1 - points[at - 1].astype(np.int64)))
            at = at - back[at]
            more = at > begin[units_at]
            units_at, at = units_at[more], at[more]
        unit, stop, ids = np.concatenate(out_unit), np.concatenate(out_end), np.concatenate(out_id)
        ids = ids[np.lexsort((stop, unit))]
        unit = np.sort(unit)
        if (ids < 0).any():  # unknown characters become the byte pieces of their UTF-8 bytes
            parts = [[self.byte_id[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] if i < 0 else [i] for i in ids.tolist()]
            unit = np.repeat(unit, [len(p) for p in parts])
            ids = np.array([i for p in parts for i in p], np.int64)
        return ids.astype(np.int32), np.bincount(unit, minlength=len(units))

    def _learn(self, units: list[str]) -> None:
        at = 0
        while at < len(units):
            end, size = at, 0
            while end < len(units) and (end == at or size + len(units[end]) < INDEX_CHARS):
                size += len(units[end]) + 1
                end += 1
            ids, lens = self._segment(units[at:end])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.index.update(zip(units[at:end], range(len(self.index), len(self.index) + end - at), strict=True))
            self.used += len(ids)
            at = end

    @lru_cache(maxsize=1000)  # noqa: B019
    def _run(self, n: int) -> tuple[int, ...]:
        """Ids of n blanks in a row: merges of equal score, the leftmost first."""
        symbols, after, before = [BLANK] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            if i >= 0 and after[i] < n and symbols[i] + symbols[after[i]] in self.blank_runs:
                made = symbols[i] + symbols[after[i]]
                heapq.heappush(heap, (-self.blank_runs[made], i, made))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != made:
                continue
            symbols[i], symbols[j], after[i] = made, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return tuple(self.ids[s] for s in symbols if s)

    # -- texts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's bounds."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pa.array(texts, pa.binary()).cast(pa.string())
        marked = pc.replace_substring(pc.replace_substring(column, BLANK, " "), " ", f" {BLANK}")
        # The dummy prefix, but for empty texts; line ends and the like stand alone.
        marked = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(BLANK, marked, ""))
        marked = pc.replace_substring_regex(marked, r"([\x00-\x08\t\n\v\f\r])", r" \1 ")
        if self.edges:
            marked = pc.replace_substring_regex(marked, f"([{_LETTERS}])([!-@\\[-`{{-~])", r"\1 \2")
        split = pc.split_pattern(marked, " ")
        coded = pc.dictionary_encode(split.flatten())
        units = coded.dictionary.to_pylist()
        if len(self.index) > CACHE_UNITS:
            self._clear()
        new = [u for u in units if u and u != "\0" and u not in self.index]
        if new:
            self._learn(new)
        place = np.array([self.index.get(u, -1) for u in units], np.int64)
        lens = np.append(self.lens, 0)[place]  # the last entry: empty units
        nul, blank = (units.index(u) if u in units else -1 for u in ("\0", BLANK))
        at, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
        own = lens[at]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        starts = np.append(self.starts, 0)[place]
        ids = self.flat[np.arange(total) + np.repeat(starts[at] - (ends - own), own)]
        edge = np.concatenate([[0], ends])[bounds]
        # Texts with runs of blanks or with U+0000 are strung together unit by unit.
        odd = np.flatnonzero((at == blank) | (at == nul)) if max(nul, blank) >= 0 else []
        if not len(odd):
            return ids, edge
        parts, last = [], 0
        odd_texts = np.unique(np.searchsorted(bounds, odd, side="right") - 1)
        for k in odd_texts.tolist():
            parts += [ids[edge[last] : edge[k]], np.array(self._strung([units[i] for i in at[bounds[k] : bounds[k + 1]]]), np.int32)]
            last = k + 1
        sizes = np.diff(edge)
        sizes[odd_texts] = [len(p) for p in parts[1::2]]
        return np.concatenate([*parts, ids[edge[last] :]]), np.concatenate([[0], np.cumsum(sizes)])

    def _strung(self, units: list[str]) -> list[int]:
        out, blanks = [], 0
        for unit in units:
            if unit == BLANK:
                blanks += 1
            elif unit == "\0":
                out += [*self._run(blanks), self.byte_id[0]]
                blanks = 0
            elif unit:
                i = self.index[unit]
                own = self.flat[self.starts[i] : self.starts[i] + self.lens[i]].tolist()
                if own[0] == self.blank:
                    blanks, own = blanks + 1, own[1:]
                out += [*self._run(blanks), *own]
                blanks = 0
        return [*out, *self._run(blanks)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Texts of ids: piece bytes by table lookup, without the dummy prefix."""
        lens = self.surface_lens[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat_surface[np.arange(total) + np.repeat(self.surface_starts[ids] - (ends - lens), lens)].tobytes()
        edge = np.concatenate([[0], ends])[bounds]
        return [flat[a + (flat[a : a + 1] == b" ") : b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _columns(table: np.ndarray) -> list[np.ndarray]:
    """Rows of 16-bit codes as big-endian 64-bit columns, four codes each, that sort like the rows."""
    return [sum(table[:, k + j].astype(np.uint64) << np.uint64(48 - 16 * j) for j in range(4)) for k in range(0, table.shape[1], 4)]


def _search(ordered: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """For each wanted row the number of ordered rows below it, by one binary search for all."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(ordered[0]), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        probe = np.minimum(mid, len(ordered[0]) - 1)
        below, same = np.zeros(len(low), bool), np.ones(len(low), bool)
        for have, want in zip(ordered, wanted, strict=True):
            value = have[probe]
            below |= same & (value < want)
            same &= value == want
        low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
    return low


@lru_cache(maxsize=1)
def coder(path: str) -> PieceCoder:
    """One coder for a worker process."""
    return PieceCoder(path)


def _batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def encode_table(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids."""
    model = model or default_path()

    def run(batches):
        import pyarrow as pa

        code = coder(model)
        for batch in _batches(batches):
            ids, bounds = code.encode(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_table(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """One row per row of (doc_id, ids): doc_id, text. Null ids are no ids; bytes that are no UTF-8 become U+FFFD."""
    model = model or default_path()

    def run(batches):
        import pyarrow as pa

        code = coder(model)
        for batch in _batches(batches):
            rows = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            texts = code.decode(np.concatenate([*rows, np.zeros(0, np.int64)]), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts])], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of pieces, checksum of the ids (as unsigned 32-bit), and whether decoding gives the text back."""
    model = default_path()

    def run(batches):
        import pyarrow as pa

        code = coder(model)
        for batch in _batches(batches):
            texts = text_bytes(batch.column(1))
            ids, bounds = code.encode(texts)
            back = code.decode(ids, bounds)
            sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            same = [t.replace(BLANK.encode(), b" ") == b for t, b in zip(texts, back, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(sums, pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return scratch.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
