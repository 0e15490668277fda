"""Token ids of whole texts by the ``tokenizers`` library, with a word cache.

A tokenizer whose normaliser and pre-tokenizer never look across white space gives
the same ids for a text as for its white-space separated words one after another.
For such tokenizers the library encodes each distinct word once per worker (up to
``CACHE_WORDS`` words, then the cache starts anew) and numpy finds known words and strings
their ids together; any other tokenizer file goes to the library text by text, and so do texts that
spell an added token (in any case). Both give the library's ids for whole texts, as a
tokenizer just loaded gives them: an added token in a text is that token.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from mailgauge.llm import scratch

#: Words a worker remembers: about 40 MB.
CACHE_WORDS = 500_000
#: Bytes of text that are split at once.
SLICE_BYTES = 8_000_000
#: A token always ends between a letter (here a-z and the Latin-1 letters) and an ASCII sign other than the apostrophe.
_EDGE = r"([a-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
#: Stands between the words that are learnt in one call; the library gives it this one id.
_MARK, _JOINED = "<|startoftext|>", 500
#: Words that no normaliser changes, and a splitter that leaves words of letters whole.
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of a word that fit into its key, and the first 0 to 8 bytes of a 64-bit number.
_KEY_BYTES = 23
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _by_word(spec: dict) -> bool:
    """Whether words can be encoded apart: normaliser and splitter as described above."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm])
    parts = pre.get("pretokenizers", [])
    return (
        {s.get("type") for s in steps} == {"NFC", "Replace", "Lowercase"}
        and all(s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps if s["type"] == "Replace")
        and len(parts) == 2
        and parts[0].get("type") == "Split"
        and parts[0].get("behavior") == "Removed"
        and parts[0].get("invert") is True
        and r"[^\s\p{L}\p{N}]+" in parts[0].get("pattern", {}).get("Regex", "")
        and parts[1].get("type") == "ByteLevel"
        and not parts[1].get("add_prefix_space")
        and not spec.get("post_processor")
        and not any(a.get("lstrip") or a.get("rstrip") or re.search(r"\s", a["content"]) for a in spec.get("added_tokens", []))
    )


class _Words:
    """Numbers of words; an Arrow array of distinct words is looked up at once, with no Python object a word.

    A word of at most ``_KEY_BYTES`` bytes is its own key, its bytes and its length in three 64-bit numbers, in an
    open-addressed table that is at most half full. Longer words are in a dictionary.
    """

    def __init__(self):
        self.slots = np.full(1 << 15, -1, np.int32)
        self.keys = np.zeros((1 << 14, 3), np.uint64)
        self.long: dict[str, int] = {}
        self.n = 0

    @staticmethod
    def _keys(words) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all words, and the places of those that are too long for one."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, "<i4")[words.offset : words.offset + len(words) + 1]
        starts, lens = offsets[:-1], np.diff(offsets)
        padded = bytes(memoryview(data)[: offsets[-1]] if data else b"") + bytes(24)
        view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        keys = np.empty((len(words), 3), np.uint64)
        for j in range(3):
            keys[:, j] = view[starts + 8 * j] & _HEADS[np.clip(lens - 8 * j, 0, 8)]
        keys[:, 2] |= lens.astype(np.uint64) << np.uint64(56)
        return keys, np.flatnonzero(lens > _KEY_BYTES)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] * _MIX[0]) ^ (keys[:, 1] * _MIX[1]) ^ (keys[:, 2] * _MIX[2])
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[0]
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, words) -> np.ndarray:
        """The number of each word, -1 for unknown ones."""
        import pyarrow as pa

        found = np.full(len(words), -1, np.int64)
        if not len(words):
            return found
        keys, long = self._keys(words)
        left = np.delete(np.arange(len(words)), long)
        places = self._places(keys[left])
        while len(left):
            at = self.slots[places]
            there = at >= 0
            own, known = keys[left], self.keys[at]
            same = there & (own[:, 0] == known[:, 0]) & (own[:, 1] == known[:, 1]) & (own[:, 2] == known[:, 2])
            found[left[same]] = at[same]
            on = there & ~same
            left, places = left[on], (places[on] + 1) & (len(self.slots) - 1)
        if len(long):
            found[long] = [self.long.get(w, -1) for w in words.take(pa.array(long)).to_pylist()]
        return found

    def _put(self, numbers: np.ndarray) -> None:
        places = self._places(self.keys[numbers])
        while len(numbers):
            free = self.slots[places] < 0
            self.slots[places[free]] = numbers[free]
            on = self.slots[places] != numbers  # taken, or lost to another of these words
            numbers, places = numbers[on], (places[on] + 1) & (len(self.slots) - 1)

    def add(self, words, numbers: np.ndarray) -> None:
        """Take distinct unknown words; their numbers are the next ones in any order."""
        import pyarrow as pa

        self.n += len(words)
        while self.n > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        keys, long = self._keys(words)
        self.keys[numbers] = keys
        self.long.update(zip(words.take(pa.array(long)).to_pylist(), numbers[long].tolist(), strict=True))
        fresh = np.delete(numbers, long)
        if 2 * self.n > len(self.slots):
            while 2 * self.n > len(self.slots):
                self.slots = np.full(2 * len(self.slots), -1, np.int32)
            fresh = np.delete(np.arange(self.n), np.fromiter(self.long.values(), np.int64))
        self._put(fresh)


class WordCoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(_MARK)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hint = os.path.commonprefix(self.added)
        self.vocab_size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _by_word(spec)
        self.lean = None
        if self.by_word and self.mark is not None and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == _SPLITTER:
            self.lean = Tokenizer(self.tokenizer.model)  # the same model; words of letters need neither normaliser nor splitter
            self.lean.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.lean.add_special_tokens([_MARK])
        self.cache_words = cache_words
        self._clear()

    def _clear(self) -> None:
        self.words = _Words()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lens = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, words: list[str]) -> np.ndarray:
        """Encode new words; the number of each, which ``words`` does not know yet."""
        letters, plain, apart = [], [], []  # apart: those that may spell a special token
        for i, word in enumerate(words):
            (apart if self.mark is None or "<|" in word else letters if self.lean and _LETTERS(word) else plain).append(i)
        ids, lens = [], []
        for tokenizer, rows in ((self.lean, letters), (self.tokenizer, plain)):
            joined = [_MARK.join([words[i] for i in rows[k : k + _JOINED]]) for k in range(0, len(rows), _JOINED)]
            for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False) if joined else []:
                got = np.array(e.ids, np.uint32)
                ends = np.concatenate([np.flatnonzero(got == self.mark), [len(got)]])
                lens.append(np.diff(ends, prepend=-1) - 1)
                ids.append(got[got != self.mark])
        for e in self.tokenizer.encode_batch_fast([words[i] for i in apart], add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            lens.append(np.array([len(ids[-1])]))
        order = letters + plain + apart
        at, ids, lens = self.words.n, np.concatenate(ids), np.concatenate(lens)
        need = self.used + int(lens.sum())
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(words) > len(self.lens):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
        self.flat[self.used : need] = ids
        self.lens[at : at + len(words)] = lens
        self.starts[at : at + len(words)] = self.used + np.cumsum(lens) - lens
        self.used = need
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(at, at + len(words))
        return number

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        low = pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string()))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _EDGE, r"\1 \2"))
        coded = pc.dictionary_encode(split.flatten())
        if self.words.n > self.cache_words:
            self._clear()
        found = self.words.find(coded.dictionary)
        gaps = np.flatnonzero(found < 0)
        if len(gaps):
            new = coded.dictionary.take(pa.array(gaps))
            found[gaps] = self._learn(new.to_pylist())
            self.words.add(new, found[gaps])
        found = found[coded.indices.to_numpy()]
        lens = self.lens[found]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[found] - (ends - lens), lens)]
        return ids, np.concatenate([[0], ends])[split.offsets.to_numpy()]

    def _spells(self, text: bytes) -> bool:
        return bool(self.added) and self.hint in text.lower() and any(token in text.lower() for token in self.added)

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[bytes], slice_bytes: int = SLICE_BYTES):
        """Yield, for slices of the texts in order, (first text, flat ids uint32, offsets)."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= slice_bytes):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            if self.by_word:
                odd = [i for i, t in enumerate(part) if self._spells(t)]
                apart = set(odd)
                ids, offsets = self._slice([b"" if i in apart else t for i, t in enumerate(part)] if odd else part)
                if odd:
                    pieces, last, lens = [], 0, np.diff(offsets)
                    for i, own in zip(odd, self._whole([part[i] for i in odd]), strict=True):
                        pieces += [ids[offsets[last] : offsets[i]], own]
                        last, lens[i] = i, len(own)
                    ids, offsets = np.concatenate([*pieces, ids[offsets[last] :]]), np.concatenate([[0], np.cumsum(lens)])
            else:
                found = self._whole(part)
                ids = np.concatenate([*found, np.zeros(0, np.uint32)])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            yield at, ids, offsets
            at = end


@scratch.kept
def coder(path: str) -> WordCoder:
    """One coder for a worker process, so that its cache serves all its tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordCoder(path)


def forget() -> None:
    """Drop the worker's coder where no text is encoded any more, and give back what earlier tasks left."""
    coder.cache_clear()
    scratch.release()


def text_bytes(column) -> list[bytes]:
    """An Arrow text column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
