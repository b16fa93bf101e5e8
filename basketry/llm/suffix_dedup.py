"""Exact substring dedup by external induced sorting of sampled suffixes.

Which bytes lie in a string of LENGTH bytes that starts somewhere else, too?
Sorting every suffix of a large corpus is out of reach, so suffixes that may
repeat are singled out first, then sorted by induction from sampled ones (the
idea of eSAIS: sort a sample, then induce the other suffixes from the right).

1. Every window of LENGTH bytes has an anchor: its leftmost k-gram of least
   hash.  Equal windows have equal k-grams at equal places, so windows with
   one anchor form a segment, and only segments with one k-gram hash (a shard)
   can hold equal windows.  Segments whose k-gram occurs once are done with.
2. Equal segments of a shard form one class with a count.
3. In each shard the anchors' suffixes (what a window can hold of them) are
   sorted by Spark's external sort, and their common prefixes are measured.
   Induction then steps to the left: the order of the suffixes one byte earlier
   is that of pairs (preceding byte, rank), so each suffix tuple moves to the
   end of its byte's bucket, and its common prefix with the tuple before it
   there is one more than the least on the way.  Neighbours with LENGTH common
   bytes are repeats; tuples that can no longer become repeats leave the queue.
   A shard of more tuples than fit goes through a queue of byte buckets whose
   blocks are kept as files in the shared folder.
4. The repeated starts of each class are carried to all of its segments, and
   bytes they cover are removed.

Every decision is made by suffix order and common prefixes over the bytes;
hashes only bring together what is compared (a class is named by 128 bits).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import scratch_path, text_slices, utf8, written

LENGTH, GRAM = 200, 64
#: Suffix tuples that a task sorts at once; a larger shard goes through the queue on disk.
CHUNK = 32_768
#: Bytes of a text that are hashed at once (a longer text is cut into overlapping pieces).
PIECE = 400_000
#: Documents (ids) that are broadcast to pick out texts; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_U = np.uint64
_LOW = _U((1 << 24) - 1)


def anchors(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of a flat byte array: (hash of the anchor's k-gram, digest, first start, number of starts, anchor).

    ``valid`` marks the starts of windows that lie within one text.
    """
    none = tuple(np.zeros(0, t) for t in (_U, _U, np.int64, np.int64, np.int64))
    n, w = len(data), length - gram + 1
    if n < length or not valid.any():
        return none
    p = flat.prefix_sums(data, _bytes())
    inv = flat.powers(n)[1]
    h = (p[gram:] - p[:-gram]) * inv[: n - gram + 1]
    h ^= h >> _U(32)
    h *= _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    # least hash of each w k-grams, the place in the low bits: the leftmost of equal ones
    m = len(h)
    v = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, _U)
    v[:m] = (h & ~_LOW) | np.arange(m, dtype=_U)
    blocks = v.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(valid[: m - w + 1])
    at = (np.minimum(tail[starts], head[starts + w - 1]) & _LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    a, anchor = starts[new], at[new]
    count = np.diff(np.r_[new, len(starts)])
    end = a + count - 1 + length
    digest = (p[end] - p[a]) * inv[a]
    digest = flat.mix(flat.mix(digest + count.astype(_U)) + (anchor - a).astype(_U))
    return flat.mix(h[anchor]), digest, a, count, anchor


def _bytes() -> np.ndarray:
    return flat.mix(np.arange(1001, 1257, dtype=_U))


SEGMENT = "id long, h long, gram long, digest long, start int, n int, anchor int"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, h, text): id and h name a text among all rows (rows that repeat both are copies)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.xxhash64(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), h).alias("id"), h.alias("h"), text.alias("text"))


def segments(docs: DataFrame) -> DataFrame:
    """All segments of all texts (rows of ``keyed``)."""

    def rows(ids, hs, data, off):
        """Of the texts in data at off; of a long text piece by piece."""
        size = np.diff(off)
        if len(size) == 1 and size[0] > PIECE + LENGTH:
            for lo in range(0, size[0] - LENGTH + 1, PIECE):
                piece = data[lo : lo + PIECE + LENGTH - 1]
                yield _found(ids, hs, piece, np.array([0, len(piece)]), lo)
        else:
            yield _found(ids, hs, data, off, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, PIECE):
                data, off = utf8(b.column(2))
                yield from rows(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), data, off)

    return docs.select("id", "h", "text").mapInArrow(run, SEGMENT)


def _found(ids: np.ndarray, hs: np.ndarray, data: np.ndarray, off: np.ndarray, shift: int) -> pa.RecordBatch:
    valid = np.zeros(len(data) + 1, np.int32)
    some = np.diff(off) >= LENGTH
    valid[off[:-1][some]] += 1
    valid[off[1:][some] - LENGTH + 1] -= 1
    gram, digest, a, n, anchor = anchors(data, np.cumsum(valid[:-1]) > 0)
    doc = np.searchsorted(off, a, "right") - 1
    cols = [ids[doc], hs[doc], gram.view(np.int64), digest.view(np.int64), (a - off[doc] + shift).astype(np.int32), n.astype(np.int32), (anchor - off[doc] + shift).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "h", "gram", "digest", "start", "n", "anchor"])


def _texts_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Texts of the named (id, h) with the columns of ``named``."""
    texts = docs.select("id", "h", "text")
    ids = named.select("id", "h")
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), ["id", "h"], "left_semi")
    return texts.join(named, ["id", "h"])


TUPLE = "gram long, digest long, copies long, lo int, hi int, suffix binary, before binary"


def tuples(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Suffix tuples: of each class the anchor's suffix, the bytes before it (backwards), and its window starts.

    Windows start lo to hi bytes before the anchor; suffix holds what they need.
    """
    item = F.struct("gram", "digest", "copies", "at.start", "at.n", "at.anchor")
    lists = classes.groupBy(F.col("at.id").alias("id"), F.col("at.h").alias("h")).agg(F.collect_list(item).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = b.column(2)[k].as_buffer().to_pybytes()
                items = pa.RecordBatch.from_struct_array(b.column(3)[k].values)
                cols = [items.column(i) for i in range(3)]
                start, n, anchor = (items.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
                lo, hi = anchor - (start + n - 1), anchor - start
                suffix = [text[x : x - y + LENGTH] for x, y in zip(anchor.tolist(), lo.tolist())]
                before = [text[s:x][::-1] for s, x in zip(start.tolist(), anchor.tolist())]
                more = [pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(suffix, pa.binary()), pa.array(before, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *more], ["gram", "digest", "copies", "lo", "hi", "suffix", "before"])

    # rows that repeat id and text give their tuples twice: they are repeats of each other
    texts = _texts_of(docs, written(lists, "items"))
    return texts.select("id", "h", "text", "items").mapInArrow(run, TUPLE)


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)


def _prefixes(suffix: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it (0 for the first of a group)."""
    out = np.zeros(len(size), np.int64)
    for i in range(1, len(size), 4096):
        j = min(i + 4096, len(size))
        differ = suffix[i:j] != suffix[i - 1 : j - 1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), suffix.shape[1])
        out[i:j] = np.minimum(first, np.minimum(size[i:j], size[i - 1 : j - 1]))
    out[1:][group[1:] != group[:-1]] = 0
    return out


def _kept_prefixes(lcp: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Common prefixes among the kept: the least on the way from one to the next."""
    if not len(kept):
        return lcp[:0]
    return np.minimum.reduceat(lcp[: kept[-1] + 1], np.r_[0, kept[:-1] + 1])


def induce(group: np.ndarray, lcp: np.ndarray, before: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which starts repeat: marks[i, s] for the window s bytes before the anchor of tuple i.

    Tuples come in suffix order within their group; lcp holds the common prefix
    with the tuple before.
    """
    marks = np.zeros((len(group), LENGTH), bool)
    order = np.arange(len(group))
    for s in range(int(hi.max(initial=-1)) + 1):
        near = lcp >= LENGTH
        repeat = near | np.r_[near[1:], False]
        own = order[repeat & (lo[order] <= s)]
        marks[own, s] = True
        left = hi[order] - s
        reach = np.maximum(lcp, np.r_[lcp[1:], 0]) + left
        kept = np.flatnonzero((left > 0) & (reach >= LENGTH))
        lcp, order = _kept_prefixes(lcp, kept), order[kept]
        if not len(order):
            break
        key = group[order] * 256 + before[order, s]
        to = np.argsort(key, kind="stable")
        same = np.r_[False, key[to][1:] == key[to][:-1]]
        new = np.zeros(len(to), np.int64)
        at = np.flatnonzero(same)
        a, b = to[at - 1], to[at]
        step = b == a + 1
        new[at[step]] = lcp[b[step]] + 1
        a, b, at = a[~step], b[~step], at[~step]
        if len(at):
            pairs = np.column_stack([a + 1, b + 1]).ravel()
            new[at] = np.minimum.reduceat(np.r_[lcp, 0], pairs)[::2] + 1
        lcp, order = new, order[to]
    return marks


class DiskQueue:
    """A monotone priority queue of suffix tuples: one first-in-first-out bucket for each preceding byte.

    Tuples are pushed in rank order, so every bucket is sorted by rank, and
    the buckets in byte order are the order of the next step.  Blocks over
    ``limit`` tuples are written to ``folder`` (any file system that pyarrow
    knows); memory holds no more than that.
    """

    def __init__(self, folder: str, dtype: np.dtype, limit: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.dtype, self.limit, self.held = dtype, limit, 0
        self.buckets: list[list] = [[] for _ in range(256)]

    def push(self, byte: int, block: np.ndarray) -> None:
        self.buckets[byte].append(block)
        self.held += len(block)
        if self.held > self.limit:
            for bucket in self.buckets:
                new = [x for x in bucket if not isinstance(x, str)]
                if new:
                    path = f"{self.folder}/{uuid.uuid4().hex}"
                    with self.fs.open_output_stream(path) as f:
                        f.write(np.concatenate(new).tobytes())
                    bucket[:] = [*(x for x in bucket if isinstance(x, str)), path]
            self.held = 0

    def pop(self) -> Iterator[np.ndarray]:
        """All blocks in order; what has been read is removed."""
        for k, bucket in enumerate(self.buckets):
            self.buckets[k] = []
            for x in bucket:
                if not isinstance(x, str):
                    yield x
                    continue
                with self.fs.open_input_stream(x) as f:
                    while raw := f.read(self.dtype.itemsize * self.limit):
                        yield np.frombuffer(raw, self.dtype)
                self.fs.delete_file(x)

    def close(self) -> None:
        self.fs.delete_dir(self.folder)


def induce_on_disk(blocks: Iterator[np.ndarray], folder: str, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """As ``induce`` for one group of any size: yields (digests, s) of repeated starts.

    blocks: arrays of tuples in suffix order with fields digest, lcp, lo, hi, before.
    """
    dtype = None
    queue, s = None, 0
    while True:
        target = None
        last = None  # the tuple before the block, not yet decided
        carry = np.full(256, LENGTH * 4, np.int64)  # least common prefix since the bucket's last tuple
        met = np.zeros(256, bool)
        pushed = 0
        for block in blocks:
            if not len(block):
                continue
            if dtype is None:
                dtype = block.dtype
            if target is None:
                target = DiskQueue(f"{folder}/{uuid.uuid4().hex}", dtype, limit)
            joint = block if last is None else np.concatenate([last, block])
            # the last tuple waits for the one after it, unless it is the last of all
            last = joint[-1:]
            out, n = _step(joint[:-1], joint[-1]["lcp"], s, carry, met, target)
            pushed += n
            yield out, s
        if last is not None:
            out, n = _step(last, 0, s, carry, met, target)
            pushed += n
            yield out, s
        if queue is not None:
            queue.close()
        if target is None:
            return
        if not pushed:
            target.close()
            return
        queue, blocks, s = target, target.pop(), s + 1


def _step(x: np.ndarray, following: int, s: int, carry: np.ndarray, met: np.ndarray, queue: DiskQueue) -> tuple[np.ndarray, int]:
    """Decide the tuples of x and push those that go on; carry and met are brought up to date."""
    if not len(x):
        return x["digest"], 0
    lcp = x["lcp"].astype(np.int64)
    after = np.r_[lcp[1:], following]
    best = np.maximum(lcp, after)
    out = x["digest"][(best >= LENGTH) & (x["lo"] <= s)]
    left = x["hi"].astype(np.int64) - s
    go = (left > 0) & (best + left >= LENGTH)
    byte = x["before"][:, s].astype(np.int64) if x["before"].shape[1] > s else np.zeros(len(x), np.int64)
    for c in np.unique(byte[go]):
        at = np.flatnonzero(go & (byte == c))
        low = np.minimum.reduceat(lcp[: at[-1] + 1], np.r_[0, at[:-1] + 1])
        low[0] = min(low[0], carry[c])
        block = x[at].copy()
        block["lcp"] = low + 1
        if not met[c]:
            block["lcp"][0] = 0
        met[c] = True
        queue.push(int(c), block)
        carry[c] = lcp[at[-1] + 1 :].min(initial=LENGTH * 4)
    rest = np.ones(256, bool)
    rest[np.unique(byte[go])] = False
    carry[rest] = np.minimum(carry[rest], lcp.min())
    return out, int(go.sum())


REPEAT = "gram long, digest long, first int, last int"


def repeats(parts: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """(gram, digest, first, last): runs of repeated starts, in bytes before the anchor, of each class."""
    rows = parts.repartition("gram").sortWithinPartitions("gram", "suffix")
    width = LENGTH - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        batches = (b.slice(i, chunk) for b in batches for i in range(0, b.num_rows, chunk))
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= chunk:
                t = pa.Table.from_batches(held).combine_chunks()
                gram = t.column("gram").to_numpy()
                cut = int(np.searchsorted(gram == gram[-1], True)) if gram[0] != gram[-1] else 0
                if cut:
                    yield _in_memory(t.slice(0, cut), width)
                    held, n = t.slice(cut).combine_chunks().to_batches(), len(gram) - cut
                else:
                    # one shard fills the memory: its tuples go through the queue, up to the shard's end
                    rest: list[pa.RecordBatch] = []
                    yield from _on_disk(_shard(t.to_batches(), batches, int(gram[0]), rest), int(gram[0]), width, folder, chunk)
                    held, n = rest, sum(x.num_rows for x in rest)
        if n:
            yield _in_memory(pa.Table.from_batches(held).combine_chunks(), width)

    return rows.mapInArrow(run, REPEAT)


def _shard(held: list[pa.RecordBatch], more: Iterator[pa.RecordBatch], gram: int, rest: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one shard; the rows after it go to ``rest``."""
    yield from held
    for b in more:
        own = int((b.column(0).to_numpy(zero_copy_only=False) == gram).sum())
        if own:
            yield b.slice(0, own)
        if own < b.num_rows:
            rest.append(b.slice(own))
            return


def _in_memory(t: pa.Table, width: int) -> pa.RecordBatch:
    gram = t.column("gram").to_numpy()
    group = np.cumsum(np.r_[0, gram[1:] != gram[:-1]])
    copies, lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("copies", "lo", "hi"))
    suffix = t.column("suffix").to_pylist()
    size = np.array([len(x) for x in suffix])
    lcp = _prefixes(_matrix(suffix, LENGTH), size, group)
    marks = induce(group, lcp, _matrix(t.column("before").to_pylist(), width), lo, hi)
    s = np.arange(marks.shape[1])
    marks |= (copies > 1)[:, None] & (s >= lo[:, None]) & (s <= hi[:, None])
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (i, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    cols = [gram[i], t.column("digest").to_numpy()[i], first.astype(np.int32), (last - 1).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "digest", "first", "last"])


def _on_disk(shard: Iterator[pa.RecordBatch], gram: int, width: int, folder: str, chunk: int) -> Iterator[pa.RecordBatch]:
    dtype = np.dtype([("digest", np.int64), ("lcp", np.int16), ("lo", np.int16), ("hi", np.int16), ("before", np.uint8, (width,))])
    all_repeat: list[pa.RecordBatch] = []

    def blocks() -> Iterator[np.ndarray]:
        last = b""
        for b in shard:
            suffix = b.column(5).to_pylist()
            rows = [last, *suffix]
            x = np.zeros(len(suffix), dtype)
            size = np.array([len(r) for r in rows])
            x["lcp"] = _prefixes(_matrix(rows, LENGTH), size, np.zeros(len(rows)))[1:]
            last = suffix[-1]
            x["digest"], x["lo"], x["hi"] = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4))
            x["before"] = _matrix(b.column(6).to_pylist(), width)
            copies = b.column(2).to_numpy(zero_copy_only=False) > 1
            if copies.any():
                own = x[copies]
                all_repeat.append(_runs(gram, own["digest"], own["lo"].astype(np.int32), own["hi"].astype(np.int32)))
            yield x

    for digests, s in induce_on_disk(blocks(), f"{folder}/{uuid.uuid4().hex}", chunk):
        yield from all_repeat
        all_repeat.clear()
        yield _runs(gram, digests, np.full(len(digests), s, np.int32), np.full(len(digests), s, np.int32))


def _runs(gram: int, digests: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    cols = [np.full(len(digests), gram, np.int64), digests.astype(np.int64), first, last]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "digest", "first", "last"])


def repeated_starts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, h, starts): runs (first, last) of the starts of repeated windows of each text that has any."""
    found = segments(docs)
    # written first: next to a plain exchange, the join can split a k-gram with very many segments
    twice = written(found.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    found = written(found.join(twice, "gram"), "segments", large=True)
    at = F.struct("id", "h", "start", "n", "anchor")
    classes = written(found.groupBy("gram", "digest").agg(F.count("*").alias("copies"), F.min(at).alias("at")), "classes", large=True)
    folder = scratch_path(docs.sparkSession, "queue")
    runs = written(repeats(tuples(docs, classes), folder, chunk), "repeats")
    hit = found.join(runs, ["gram", "digest"])
    run = F.struct((F.col("anchor") - F.col("last")).alias("first"), (F.col("anchor") - F.col("first")).alias("last"))
    return hit.select("id", "h", run.alias("run")).groupBy("id", "h").agg(F.collect_set("run").alias("starts"))


def without_repeats(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row of ``docs`` (doc_id, text).

    Bytes are those of the text in UTF-8 (null: none); what is kept need not be
    valid UTF-8.  Texts shorter than LENGTH keep all; rows that repeat a text
    of LENGTH bytes or more lose it whole (each is the other's repeat); a null
    doc_id is kept; an empty table gives no rows; other columns are left behind.
    """
    docs = keyed(docs)
    starts = written(repeated_starts(docs, chunk), "starts")
    if starts.count() <= BROADCAST_IDS:
        ids = F.broadcast(starts.select("id", "h"))
        cold = docs.join(ids, ["id", "h"], "left_anti")
        hot = docs.join(ids, ["id", "h"], "left_semi").join(starts, ["id", "h"])
    else:
        both = docs.join(starts, ["id", "h"], "left")
        cold, hot = both.where("starts is null").drop("starts"), both.where("starts is not null")
    raw = F.col("text").cast("binary")
    whole = cold.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), raw.alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in text_slices(b):
                out: tuple[list, ...] = ([], [], [], [])
                for k in range(c.num_rows):
                    data = np.frombuffer(c.column(1)[k].as_buffer(), np.uint8)
                    own = pa.RecordBatch.from_struct_array(c.column(2)[k].values)
                    first, last = (own.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    cover = np.zeros(len(data) + 1, np.int64)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, last + LENGTH, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    for o, v in zip(out, (len(data), int(gone.sum()), spans, data[~gone].tobytes())):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([c.column(0), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    cut = hot.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return whole.unionByName(cut)


def sha256(kept: str = "kept"):
    return F.sha2(F.col(kept), 256)
