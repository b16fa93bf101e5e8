"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of all words of a batch lie in one flat array.  A round looks up
the rank of every adjacent pair by binary search over the sorted pair keys
``left << 32 | right``, takes each word's lowest rank, merges all of its
(non-overlapping, left to right) occurrences in every word at once, and leaves
words without a known pair behind.  A very long word (text without spaces) has
thousands of rounds, so there a round touches only the places where the lowest
rank stands: places are kept by rank, and symbols linked to their neighbours.
Texts are cut into words by the vocabulary file's pattern; distinct words are
encoded once and kept in a bounded store.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import strings, text_slices

#: The pattern of the ByteLevel pre-tokenizer (fixed value); white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct words a task keeps before it starts its store anew.
STORE_WORDS = 200_000
#: Bytes from which on a word is merged by places instead of by passes over all its symbols.
LONG_WORD = 4096
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, nxt = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], nxt = chr(nxt), nxt + 1
    return letters


def is_plain(spec: dict) -> bool:
    """Whether a tokenizers .json is byte-level BPE without normalizer, prefix space or shortcuts."""
    pre, model = spec["pre_tokenizer"], spec["model"]
    plain = model["type"] == "BPE" and pre and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
    return bool(plain and not spec["normalizer"] and not model.get("ignore_merges") and not model.get("dropout"))


class Vocabulary:
    """Ids, sorted pair keys and token bytes of a tokenizers .json file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not is_plain(spec):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        model = spec["model"]
        ids = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)  # by rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        top = max(tokens) + 1
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(top)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(top)), np.uint8)
        self.words = regex.compile(PATTERN)
        named = sorted(self.special, key=len, reverse=True)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, named)) + ")") if named else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the largest integer."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of each word's ids."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        if len(words) and lens.max() >= LONG_WORD:
            long = lens >= LONG_WORD
            parts: list = [None] * len(words)
            for k in np.flatnonzero(long):
                parts[k] = self.encode_long(words[k])
            short = np.flatnonzero(~long)
            flat, counts = self.encode_words([words[k] for k in short])
            for k, part in zip(short, np.split(flat, np.cumsum(counts)[:-1])):
                parts[k] = part
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        rank = np.full(len(sym), _NONE)
        fresh = np.flatnonzero(word[:-1] == word[1:]) if len(sym) else np.zeros(0, np.int64)
        rank[fresh] = self.rank(sym[fresh], sym[fresh + 1])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            still = low != _NONE
            if not still.all():
                done_sym.append(sym[~still])
                done_word.append(word[~still])
                sym, word, rank, low = sym[still], word[still], rank[still], low[still]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            # in a run of overlapping pairs every other one merges, from the left
            run = np.r_[True, np.diff(hit) > 1]
            nth = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[nth % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            new = np.zeros(len(sym), bool)
            new[hit] = True
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
            rank[new] = _NONE  # the last symbol of a word has no pair
            new[:-1] |= new[1:]
            at = np.flatnonzero(new[:-1])
            rank[at] = _NONE
            at = at[word[at] == word[at + 1]]
            rank[at] = self.rank(sym[at], sym[at + 1])
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        s, w = np.concatenate(done_sym), np.concatenate(done_word)
        return s[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(words))

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one word, in rounds that touch only the places of the lowest rank.

        The work of all rounds together grows with the places that ever hold a
        known pair, not with rounds times letters.
        """
        sym = self.byte_ids[np.frombuffer(word, np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # n: no symbol behind; before[n] is never read
        rank = np.full(n, _NONE)
        rank[: n - 1] = self.rank(sym[:-1], sym[1:])
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for group in np.split(at, cuts):
                r = int(rank[group[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(group)

        file(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            hit = np.unique(np.concatenate(places.pop(r)))
            hit = hit[rank[hit] == r]  # the others merged into a neighbour or hold another pair by now
            if not len(hit):
                continue
            # in a run of overlapping pairs every other one merges, from the left
            run = np.r_[True, after[hit[:-1]] != hit[1:]]
            nth = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[nth % 2 == 0]
            gone = after[hit]
            sym[hit] = self.merged[r]
            rank[gone] = _NONE
            after[hit] = after[gone]
            before[after[gone]] = hit
            sym[gone] = -1
            left = before[hit]
            fresh = np.unique(np.r_[left[left >= 0], hit])
            rank[fresh] = _NONE
            fresh = fresh[after[fresh] < n]
            rank[fresh] = self.rank(sym[fresh], sym[after[fresh]])
            file(fresh)
        return sym[sym >= 0]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        raw = self.bytes[at].tobytes()
        ends = np.r_[0, np.cumsum(n)][np.cumsum(counts)]
        out, last = [], 0
        for e in ends:
            out.append(raw[last:e].decode("utf-8", "replace"))
            last = e
        return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts with a store of the words met so far."""

    def __init__(self, vocab: Vocabulary, store_words: int = STORE_WORDS):
        self.vocab, self.store_words = vocab, store_words
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.specials = [(s, i) for s, i in self.vocab.special.items()]
        for s, i in self.specials:
            # a special string is one "word" of its own, never reached by the pattern
            self._add([("\0special", s)], np.array([i], np.int32), np.array([1]))

    def _add(self, words: list, ids: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.index)
        self.index.update(zip(words, range(n, n + len(words))))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.lens = np.concatenate([self.lens, lens])

    def cut(self, text: str) -> list:
        if self.vocab.splits is None or not any(s in text for s in self.vocab.special):
            return self.vocab.words.findall(text)
        out: list = []
        for k, part in enumerate(self.vocab.splits.split(text)):
            out += [("\0special", part)] if k % 2 else self.vocab.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids."""
        cut = [self.cut(t) for t in texts]
        if len(self.index) > self.store_words:
            self.reset()
        new = {w for words in cut for w in words} - self.index.keys()
        if new:
            new = list(new)
            self._add(new, *self.vocab.encode_words([w.encode() for w in new]))
        get = self.index.__getitem__
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter((get(w) for words in cut for w in words), np.int64, int(per_text.sum()))
        starts = np.cumsum(self.lens) - self.lens
        n = self.lens[at]
        total = np.cumsum(n)
        flat = np.repeat(starts[at] - (total - n), n) + np.arange(total[-1] if len(total) else 0)
        ends = np.r_[0, total][np.cumsum(per_text)]
        return self.ids[flat], np.diff(np.r_[0, ends])


def encode(docs: DataFrame, path: str, column: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with an array<int> column ``to``: the ids of the whole text in ``column``.

    No tokens are added; special strings inside a text get their own id.  Null
    and empty texts give an empty array.  An existing column ``to`` is replaced,
    all others (and repeated rows) stay; an empty table stays empty.
    """
    keep = [f for f in docs.schema.fields if f.name != to]
    schema = T.StructType([*keep, T.StructField(to, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(vocabulary(path))
        for whole in batches:
            for b in text_slices(whole, column=column):
                ids, counts = enc.encode(strings(b.column(b.schema.get_field_index(column))))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
                names = [f.name for f in keep]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), lists], [*names, to])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with a string column ``to``: the text of the ids in ``column`` (null: empty).

    Special ids give their strings; ids outside the vocabulary give nothing, as
    in the library.  Bytes that are no valid UTF-8 become U+FFFD.
    """
    keep = [f for f in rows.schema.fields if f.name != to]
    schema = T.StructType([*keep, T.StructField(to, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lists = b.column(b.schema.get_field_index(column))
                counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                known = (ids >= 0) & (ids < len(v.lengths))
                if not known.all():
                    counts = np.add.reduceat(np.r_[known, False].astype(np.int64), np.cumsum(counts) - counts) * (counts > 0)
                    ids = ids[known]
                names = [f.name for f in keep]
                out = pa.array(v.decode(ids, counts), pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), out], [*names, to])

    return rows.mapInArrow(run, schema)
