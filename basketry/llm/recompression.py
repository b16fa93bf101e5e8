"""Exact removal of repeated word windows by recompression.

Which words lie in a window of LENGTH words that starts somewhere else, too?
Texts are compressed in rounds (Jez's recompression).  A run round names every
maximal run of one symbol; a pair round halves the symbols into left and right
ones by a hash and names every pair of a left and a right symbol that meet.  A
name is a digest of what it is made of, so all tasks give equal runs and pairs
the same name, and a string has the same symbols wherever it stands, but for a
few at its two ends: those that may have merged with what stands around it.

A window is therefore described by its own words alone: each round takes off
the end symbols that may have merged outwards.  What was taken off, in order,
and the core of high-level symbols that is left after ROUNDS rounds name the
window (equal windows and no others have equal names).  All its copies share
the core's symbols; the least run of GRAM of them by hash, some ten words, is
the anchor.  (Where the core is used up before, as in long runs, the anchor is
the leftmost symbol of the last core.)

1. Consecutive windows with one anchor form a segment.  A Spark round counts
   anchors' names: segments whose anchor is nowhere else are done with.
2. The next round names the segments left by their first and last window.  A
   segment that occurs twice is repeated as a whole.
3. Where one anchor has different segments, a round names what stands within
   half a window before the anchor, and from it on: a window holds one of the
   two, so only segments that share one with another are looked at further.
4. Of those, one of each kind is cut into the windows that hold the shared
   half, and a last round counts the windows' names.

Symbols are 64 bits; a window is told by its name and its anchor's, 128 bits.
No window looks beyond itself, so texts can be cut anywhere with LENGTH - 1
words in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import text_slices, utf8, written
from .suffix_dedup import keyed

LENGTH = 35
#: Rounds; every RUN_EVERY-th names runs first.  Symbols so made that an anchor holds.
ROUNDS, RUN_EVERY, GRAM = 3, 4, 4
#: Words that are compressed at once (more are cut into overlapping pieces); bytes of texts taken together.
PIECE, PIECE_BYTES = 100_000, 400_000
#: Documents (ids) that are broadcast to pick out texts; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 2_000_000
WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64
_TOLD, _RUN, _PAIR = (_U(x) for x in (0x8F1BBCDCBFA53E0B, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
#: Low bits of a hash that give way to a place.
_PLACE = _U((1 << 20) - 1)


def _named(a: np.ndarray, b: np.ndarray, kind: np.uint64) -> np.ndarray:
    """Names of ordered pairs."""
    return flat.mix(flat.mix(a + kind) * kind + b)


def _runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with every run as one, run of each symbol, first symbol of each run, its length)."""
    new = np.r_[True, s[1:] != s[:-1]]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(s)])
    out = s[first].copy()
    long = size > 1
    out[long] = _named(out[long], size[long].astype(_U), _RUN)
    return out, np.cumsum(new) - 1, first, size


def _pairs(s: np.ndarray, nth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with every left-right pair as one, new place of each symbol, its first symbol, whether each old one is right)."""
    right = (flat.mix(s + _U(nth)) & _U(1)).astype(bool)
    second = np.r_[False, right[1:] & ~right[:-1]]
    first = np.flatnonzero(~second)
    out = s[first].copy()
    joined = np.r_[second[1:], False][first]
    out[joined] = _named(s[first[joined]], s[first[joined] + 1], _PAIR)
    return out, np.cumsum(~second) - 1, first, right


def _least(h: np.ndarray, left: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Place of the leftmost least of h[left : left + count] (count > 0), by least values of blocks of 1, 2, 4, ... places."""
    tables = [(h & ~_PLACE) | np.arange(len(h), dtype=_U)]
    while 2 ** len(tables) <= int(count.max(initial=1)):
        half = 2 ** (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    out = np.zeros(len(left), _U)
    power = np.frexp(count)[1] - 1
    for k, table in enumerate(tables):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(table[left[own]], table[left[own] + count[own] - 2**k])
    return (out & _PLACE).astype(np.int64)


def windows(s: np.ndarray, length: int = LENGTH, rounds: int = ROUNDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's name, anchor's place, window's name) of each window of ``length`` words, given the words' hashes."""
    n = max(len(s) - length + 1, 0)
    anchor, at, name = np.zeros(n, _U), np.zeros(n, np.int64), np.zeros(n, _U)
    live = np.arange(n)
    place = np.arange(len(s))  # of each symbol: its first word
    left, right, told = live.copy(), live + length, np.full(n, _U(length))  # cores are [left, right)

    def settled(over: np.ndarray, core: np.ndarray) -> None:
        """Windows whose core is used up early: their anchor is the leftmost symbol of the core before."""
        done = live[over]
        anchor[done], at[done], name[done] = s[core[over]], place[core[over]], told[over]

    for nth in range(rounds):
        if nth % RUN_EVERY == 0:
            t, to, first, size = _runs(s)
            i, j = to[left], to[right - 1]
            one = i == j
            head = np.minimum(first[i] + size[i], right) - left
            tail = np.where(one, 0, right - np.maximum(first[j], left))
            told = ((told * _TOLD + s[left]) * _TOLD + head.astype(_U)) * _TOLD
            told = (told + np.where(one, _U(0), s[right - 1])) * _TOLD + tail.astype(_U)
            over = i + 1 >= j
            left, right = _on(settled, over, left, i + 1, j)
            live, told, s, place = live[~over], told[~over], t, place[first]
        t, to, first, second = _pairs(s, nth)
        off_left, off_right = second[left], ~second[right - 1]
        told = told * _TOLD + np.where(off_left, s[left], _U(1))
        told = told * _TOLD + np.where(off_right, s[right - 1], _U(1))
        i, j = left + off_left, right - off_right
        over = i >= j
        left, right = _on(settled, over, left, i, j)
        left, right = to[left], to[right - 1] + 1
        live, told, s, place = live[~over], told[~over], t, place[first]
    if len(live):
        # what is left of the core, in order; its least run of ``gram`` symbols (or all) is the anchor
        p, inv = flat.powers(len(s))
        sums = np.r_[_U(0), np.cumsum(s * p)]
        told = told * _TOLD + flat.mix((sums[right] - sums[left]) * inv[left])
        own = np.minimum(right - left, gram)
        for k in range(1, gram + 1):
            m = len(s) - k + 1
            of = np.flatnonzero(own == k)
            if len(of):
                h = flat.mix((sums[k : k + m] - sums[:m]) * inv[:m])
                least = _least(h, left[of], right[of] - left[of] - k + 1)
                anchor[live[of]], at[live[of]] = h[least], place[least]
        name[live] = told
    return anchor, at, flat.mix(name)


def _on(settled, over: np.ndarray, core: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The new cores of the windows that go on."""
    if not over.any():
        return left, right
    settled(over, core)
    return left[~over], right[~over]


def _letters() -> np.ndarray:
    return flat.mix(np.arange(2001, 2257, dtype=_U))


def pieces(col: pa.Array, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """All windows of some texts, piece by piece: (words' hashes; text, first word, anchor's place, anchor's name, window's name; first word of the piece in its text).

    Places count from the start of the piece.
    """
    data, off = utf8(col)
    a, b, doc = flat.word_bounds(data, off)
    if len(a) < length:
        return
    p, inv = flat.prefix_sums(data, _letters()), flat.powers(len(data))[1]
    h = flat.mix((p[b] - p[a]) * inv[a])
    origin = np.searchsorted(doc, np.arange(len(off)))  # first word of each text
    for lo in range(0, len(h) - length + 1, PIECE):
        own = doc[lo : lo + PIECE + length - 1]
        s = h[lo : lo + PIECE + length - 1]
        anchor, at, name = windows(s, length)
        start = np.flatnonzero(own[: len(at)] == own[length - 1 :])
        text = own[start]
        yield s, text, start, at[start], anchor[start], name[start], lo - origin[text]


def _first(text: np.ndarray, start: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """First window of each segment."""
    new = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1]) | (anchor[1:] != anchor[:-1])
    return np.flatnonzero(np.r_[True, new])


SEGMENT = "id long, h long, gram long, digest long, prior long, later long, start int, n int, anchor int"


def half(length: int) -> int:
    """A window holds this many words before its anchor, or from it on."""
    return (length + 1) // 2


def segments(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All segments of all texts (rows of ``keyed``): anchor's name, digest, names of the half windows at the anchor (null: held by no window of the segment), first window, windows, anchor's place."""
    w = half(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, PIECE_BYTES):
                ids, hs = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for s, text, start, at, anchor, name, shift in pieces(b.column(2), length):
                    if not len(text):
                        continue
                    first = _first(text, start, at, anchor)
                    n = np.diff(np.r_[first, len(text)])
                    last = first + n - 1
                    a, i, j, x = at[first], start[first], start[last], anchor[first]
                    digest = flat.mix(_named(name[first], name[last], _PAIR) + flat.mix((a - i).astype(_U) * _U(length + 1) + n.astype(_U)))
                    p, inv = flat.powers(len(s))
                    sums = np.r_[_U(0), np.cumsum(s * p)]
                    has = (a - i >= w, a - j < w)
                    y, z = np.where(has[0], a - w, 0), np.where(has[1], a, 0)
                    sides = [flat.mix((sums[u + w] - sums[u]) * inv[u]).view(np.int64) for u in (y, z)]
                    t = text[first]
                    cols = [ids[t], hs[t], x.view(np.int64), digest.view(np.int64), *sides, *((v + shift[first]).astype(np.int32) for v in (i, a)), n.astype(np.int32)]
                    masks = [None] * 4 + [~m for m in has] + [None] * 3
                    arrays = [pa.array(c, mask=m) for c, m in zip(cols, masks)]
                    yield pa.RecordBatch.from_arrays([*arrays[:7], arrays[8], arrays[7]], ["id", "h", "gram", "digest", "prior", "later", "start", "n", "anchor"])

    return docs.select("id", "h", "text").mapInArrow(run, SEGMENT)


def _texts_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Texts of the named (id, h) with the columns of ``named``."""
    rows, ids = docs.select("id", "h", "text"), named.select("id", "h")
    if ids.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(ids), ["id", "h"], "left_semi")
    return rows.join(named, ["id", "h"])


WINDOW = "gram long, digest long, name long, back int"


def cut(docs: DataFrame, parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(gram, digest, name, back): windows ``least`` to ``most`` words before the anchor of each of ``parts`` (gram, digest, at, least, most)."""
    item = F.struct("gram", "digest", "at.anchor", "least", "most")
    lists = parts.groupBy(F.col("at.id").alias("id"), F.col("at.h").alias("h")).agg(F.collect_list(item).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                # every start of the text has a window, in order
                name = np.concatenate([x[5] for x in pieces(b.column(0).slice(k, 1), length)])
                items = pa.RecordBatch.from_struct_array(b.column(1)[k].values)
                gram, digest, anchor, least, most = (items.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                n = most - least + 1
                own = np.repeat(np.arange(len(n)), n)
                back = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + least[own]
                cols = [gram[own], digest[own], name[anchor[own] - back].view(np.int64), back.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "digest", "name", "back"])

    # rows that repeat id and text would give their windows twice
    texts = _texts_of(docs.dropDuplicates(["id", "h"]), written(lists, "items"))
    return texts.select("text", "items").mapInArrow(run, WINDOW)


def _shared_halves(classes: DataFrame, length: int) -> DataFrame:
    """(gram, digest, at, least, most) of the classes that share half a window at their anchor with another class: the windows that hold it."""
    w = half(length)
    most = F.col("at.anchor") - F.col("at.start")
    least = most - F.col("at.n") + 1
    side = lambda c, lo, hi: F.struct(F.lit(c).alias("side"), F.col(c).alias("name"), lo.alias("least"), hi.alias("most"))
    sides = F.explode(F.array(side("prior", F.greatest(least, F.lit(w)), most), side("later", least, F.least(most, F.lit(w - 1)))))
    rows = classes.select("gram", "digest", "at", sides.alias("s")).select("gram", "digest", "at", "s.*").where("name is not null")
    shared = written(rows.groupBy("gram", "side", "name").count().where("count > 1").drop("count"), "halves", large=True)
    return rows.join(shared, ["gram", "side", "name"]).select("gram", "digest", "at", "least", "most")


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, h, starts): runs (first, last) of the starts of repeated windows of each text that has any."""
    found = segments(docs, length)
    # written first: next to a plain exchange, the join can split a name with very many segments
    twice = written(found.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    found = written(found.join(twice, "gram"), "segments", large=True)
    at = F.struct("id", "h", "start", "n", "anchor")
    classes = found.groupBy("gram", "digest").agg(F.count("*").alias("copies"), F.min(at).alias("at"), F.any_value("prior").alias("prior"), F.any_value("later").alias("later"))
    classes = written(classes, "classes", large=True)
    most = F.col("at.anchor") - F.col("at.start")
    whole = classes.where("copies > 1").select("gram", "digest", most.alias("most"), (most - F.col("at.n") + 1).alias("least"))
    parts = written(cut(docs, written(_shared_halves(classes, length), "parts", large=True), length), "windows", large=True)
    common = written(parts.groupBy("gram", "name").count().where("count > 1").select("gram", "name"), "names", large=True)
    parts = parts.join(common, ["gram", "name"]).select("gram", "digest", F.col("back").alias("most"), F.col("back").alias("least"))
    # of classes that occur once only: the others are repeated as a whole
    parts = parts.join(whole.select("gram", "digest"), ["gram", "digest"], "left_anti")
    runs = written(whole.unionByName(parts), "repeats", large=True)
    hit = found.join(runs, ["gram", "digest"])
    run = F.struct((F.col("anchor") - F.col("most")).alias("first"), (F.col("anchor") - F.col("least")).alias("last"))
    return hit.select("id", "h", run.alias("run")).groupBy("id", "h").agg(F.collect_set("run").alias("starts"))


RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept string"


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept) of every row of ``docs`` (doc_id, text); kept words stand one space apart.

    Null text: no words.  Texts of fewer than ``length`` words keep all; rows
    that repeat a text of ``length`` words or more lose it whole (each is the
    other's repeat); a null doc_id is kept; an empty table gives no rows; other
    columns are left behind.
    """
    docs = keyed(docs)
    starts = written(repeated_starts(docs, length), "starts")
    if starts.count() <= BROADCAST_IDS:
        ids = F.broadcast(starts.select("id", "h"))
        cold = docs.join(ids, ["id", "h"], "left_anti")
        hot = docs.join(ids, ["id", "h"], "left_semi").join(starts, ["id", "h"])
    else:
        both = docs.join(starts, ["id", "h"], "left")
        cold, hot = both.where("starts is null").drop("starts"), both.where("starts is not null")
    zero = F.lit(0).cast("long")
    kept = F.regexp_replace(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", " ")
    whole = cold.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), zero.alias("n_removed"), zero.alias("n_spans"), kept.alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch):
                out: tuple[list, ...] = ([], [], [], [])
                for k in range(b.num_rows):
                    words = b.column(1)[k].as_py().encode().split()  # bytes split at the same six characters
                    own = pa.RecordBatch.from_struct_array(b.column(2)[k].values)
                    first, last = (own.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, last + length, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]).decode()
                    for o, v in zip(out, (len(words), int(gone.sum()), spans, text)):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_removed", "n_spans", "kept"])

    return whole.unionByName(hot.select("doc_id", "text", "starts").mapInArrow(run, RESULT))
