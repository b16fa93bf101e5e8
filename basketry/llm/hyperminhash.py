"""MinHash near-dedup with HyperMinHash registers.

A document's set of shingle hashes is dealt over 128 buckets by its top bits.
Each bucket keeps the smallest remaining hash as a 16-bit register: the number
of leading zeros (6 bits) and the 10 mantissa bits after the leading one.  An
empty bucket of a non-empty set is filled by a hash of its own over the whole
set (so that short texts have 128 informative registers too).

1. Documents with equal sets form one class; its smallest doc_id stands for it.
2. Registers are banded; the classes of a band bucket are paired with one
   pivot, so a bucket of m classes gives m - 1 pairs, not m * (m - 1) / 2.
3. Jaccard similarity is estimated from the registers, corrected for registers
   that collide by chance; pairs five standard errors below the threshold go.
   Where the classes of a bucket are not connected by that, its other pairs are
   estimated too (in blocks, inside the tasks).  What is likely forms groups.
4. Groups are verified on the full shingle sets: members against the group's
   root first; then, in groups that this leaves in several components, members
   of different components against each other, in blocks.  So all pairs that
   meet in any bucket are decided, and no task emits more than a spanning tree.

The chance that two sets at the threshold meet in no band is below 1e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .common import checkpointed, fewer_files, text_slices, texts, utf8, written
from .components import connected_components

BUCKET_BITS, ZERO_BITS, MANTISSA_BITS = 7, 6, 10
BUCKETS = 1 << BUCKET_BITS
#: Members of a bucket or group that are compared at once.
BLOCK = 512
#: Members of groups that are broadcast to the documents (ids and digests); beyond, the join is a shuffle.
BROADCAST_IDS = 2_000_000
_U = np.uint64


def registers(h: np.ndarray) -> np.ndarray:
    """The 128 registers (uint16) of a non-empty sorted set of 64-bit hashes."""
    bucket = (h >> _U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low = np.zeros(BUCKETS, _U)
    low[bucket[first]] = h[first] << _U(BUCKET_BITS)
    empty = np.ones(BUCKETS, bool)
    empty[bucket[first]] = False
    gaps = np.flatnonzero(empty)
    if len(gaps):
        salt = flat.mix(gaps.astype(_U) + _U(0x51ED2701))
        low[gaps] = flat.mix(h[:, None] ^ salt[None, :]).min(axis=0) << _U(BUCKET_BITS)
    # position of the leading one; 53 bits convert to float without rounding
    _, exp = np.frexp((low >> _U(11)).astype(np.float64))
    zeros = np.minimum(53 - exp, 64 - BUCKET_BITS).astype(_U)
    mantissa = (low << (zeros + _U(1))) >> _U(64 - MANTISSA_BITS)
    return ((zeros << _U(MANTISSA_BITS)) | mantissa).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of disjoint sets of n and m hashes are equal."""
    z = np.arange(0, 64 - BUCKET_BITS)
    hi, lo = 2.0 ** -(z + 1), 2.0**-z

    def mass(x: np.ndarray) -> np.ndarray:
        x = np.maximum(x, 1)[:, None] / BUCKETS
        return np.exp(-x * hi) - np.exp(-x * lo)

    return (mass(n) * mass(m)).sum(axis=1) / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity from rows of registers and set sizes."""
    share = (a == b).mean(axis=1)
    c = chance(n, m)
    return (share - c) / (1 - c)


def slack(threshold: float) -> float:
    """Estimates this far below the threshold are five standard errors off."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / BUCKETS)


def band_rows(threshold: float, miss: float = 1e-6) -> int:
    """The most registers a band can have with a chance under ``miss`` to lose a pair at the threshold."""
    ok = [r for r in range(1, 17) if (1 - threshold**r) ** (BUCKETS // r) < miss]
    return max(ok, default=1)


def _digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


SKETCH = "doc_id long, n_shingles long, set_digest binary, sketch binary"


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row: number of distinct shingles, digest of the set, registers (both null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole):
                sets = flat.shingle_sets(*utf8(b.column(1)), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_digest", "sketch"],
                )

    return texts(docs).mapInArrow(run, SKETCH)


def bands(reps: DataFrame, rows: int) -> DataFrame:
    """(bucket long, id long) of every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = BUCKETS // rows
        for b in batches:
            if not b.num_rows:
                continue
            r = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)[:, : n * rows]
            key = np.zeros((len(r), n), _U) + np.arange(1, n + 1, dtype=_U)
            for i in range(rows):
                key = flat.mix(key * _U(0x9E3779B97F4A7C15) + r[:, i::rows].astype(_U))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), n))], ["bucket", "id"]
            )

    return reps.select("id", "sketch").mapInArrow(run, "bucket long, id long")


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Of distinct pairs (a, b) those whose sizes and registers allow the threshold."""
    left = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "n", "m", "sa", "sb")
    cut = slack(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            n, m = (x.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            sa, sb = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (4, 5))
            ok = (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-6) & (estimate(sa, sb, n, m) >= cut)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``members`` (id, class_digest, ...) with the sorted shingle set of that class.

    Up to BROADCAST_IDS members the table goes to the documents, so that no
    text is moved; beyond, documents and members are shuffled by id.
    """
    keep = [f for f in members.schema.fields if f.name != "id"]
    if members.count() <= BROADCAST_IDS:
        members = F.broadcast(members)
    rows = texts(docs).join(members, F.col("doc_id") == F.col("id")).select("doc_id", "text", *[f.name for f in keep])
    schema = T.StructType([T.StructField("id", T.LongType()), *keep, T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole):
                sets = [s.tobytes() for s in flat.shingle_sets(*utf8(b.column(1)), words)]
                out = pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(sets, pa.binary())], schema.names)
                # a doc_id may repeat with other texts: only rows of the named class count
                own = [_digest(x) == y for x, y in zip(sets, b.column(2).to_pylist())]
                yield out.filter(pa.array(own, pa.bool_()))

    return rows.mapInArrow(run, schema)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _star_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) between each group's root and its members.

    members: (id, class_digest, root, salt, is_root); a root is in every salt of
    its group, so a large group is spread over many tasks.
    """
    part = _sets(docs, members, words).repartition("root", "salt").sortWithinPartitions("root", "salt", F.desc("is_root"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base = None, np.zeros(0, _U)
        for t in batches:
            a, b = [], []
            cols = (t.column(t.schema.get_field_index(c)) for c in ("id", "root", "salt", "is_root", "shingles"))
            for i, root, salt, is_root, s in zip(*(c.to_pylist() for c in cols)):
                s = np.frombuffer(s, _U)
                if is_root:
                    key, base = (root, salt), s
                elif key == (root, salt):
                    n = _common(base, s)
                    if 100 * n >= percent * (len(base) + len(s) - n):
                        a.append(root)
                        b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return part.mapInArrow(run, "a long, b long")


def _block_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) between different components of a group, enough of them to connect what is connected.

    members: (id, class_digest, root, component, own, i, j).  A block (root, i,
    j) compares the members of i with those of j; the shingles that two members
    share are numbered, each member's are bits, and intersections are counted
    by the bits two members have in common.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, comp, own = (t.column(c).to_numpy() for c in ("id", "component", "own"))
        sets = [np.frombuffer(x.as_buffer(), _U) for x in t.column("shingles")]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        size = np.array([len(x) for x in sets])
        value, number = np.unique(np.concatenate(sets), return_inverse=True)
        seen = np.bincount(number) > 1
        number = np.where(seen, np.cumsum(seen) - 1, -1)[number]
        owner = np.repeat(np.arange(len(sets)), size)
        owner, number = owner[number >= 0], number[number >= 0]
        common = np.zeros((len(left), len(right)), np.int32)
        width = 1 << 15  # shingles in a pass
        for lo in range(0, int(seen.sum()), width):
            part = (number >= lo) & (number < lo + width)
            bits = np.zeros((len(sets), width // 8), np.uint8)
            at = number[part] - lo
            np.bitwise_or.at(bits, (owner[part], at >> 3), (1 << (at & 7)).astype(np.uint8))
            bits = bits.view(_U)
            used = bits.any(axis=0)
            bits = bits[:, used]
            for k, x in enumerate(left):
                common[k] += np.bitwise_count(bits[right] & bits[x]).sum(axis=1, dtype=np.int32)
        a, b = [], []
        place = {c: c for c in set(comp.tolist())}

        def top(c: int) -> int:
            while place[c] != c:
                place[c] = c = place[place[c]]
            return c

        for k, x in enumerate(left):
            hit = 100 * common[k].astype(np.int64) >= percent * (size[x] + size[right] - common[k])
            for y in right[hit & (comp[right] != comp[x])]:
                u, v = top(comp[x]), top(comp[y])
                if u != v:  # the links of a block that join components, no others
                    place[max(u, v)] = min(u, v)
                    a.append(ids[x])
                    b.append(ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _sets(docs, members, words).groupBy("root", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their distinct shingles of ``words`` words; component_id is the smallest
    doc_id reachable over links.  Defined results: null text is empty; an empty
    set is linked with nothing; repeated rows are equal sets and so one
    component; a doc_id that repeats with other texts is one node holding
    several sets; a null doc_id gives a null component_id and kept = true.
    Extra columns are ignored; an empty table gives no rows.
    """
    threshold = percent / 100
    docs = docs.select("doc_id", "text")
    rows = written(sketches(docs, words), "sketches")
    full = rows.where("set_digest is not null and doc_id is not null")
    # a class is named by its smallest doc_id; written first, so that the join can split a class with very many copies
    classes = written(full.groupBy("set_digest").agg(F.min("doc_id").alias("id")), "names")
    full = full.join(classes, "set_digest")
    first = F.col("doc_id") == F.col("id")
    full = written(full.select("doc_id", "id", "n_shingles", "set_digest", F.when(first, F.col("sketch")).alias("sketch")), "classes")
    reps = full.where("sketch is not null").select("id", "n_shingles", F.col("set_digest").alias("class_digest"), "sketch")
    reps = reps.dropDuplicates(["id", "class_digest"])

    banded = bands(reps, band_rows(threshold))
    pivots = banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(pivots, "bucket").select("bucket", "id", "pivot"), "buckets")
    pairs = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = written(_likely(pairs, reps, threshold), "pairs")
    likely = checkpointed(connected_components(pairs))
    # groups: all pairs of classes that a bucket and their registers call likely lie within one group
    more = written(_unconnected(members, likely, reps, threshold), "pairs2")
    groups = connected_components(pairs.unionByName(more)).select(F.col("node").alias("id"), F.col("component").alias("root"))
    groups = written(groups.join(reps.select("id", "class_digest"), "id"), "groups")

    links = written(_star_links(docs, _salted(groups), words, percent), "links")
    found = connected_components(links).select(F.col("node").alias("id"), "component")
    blocks = written(_blocks(groups.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))), "blocks")
    links = links.unionByName(written(_block_links(docs, blocks, words, percent), "links2"))
    # classes only: copies take the component of their class
    final = connected_components(links.unionByName(_shared_ids(full))).select(F.col("node").alias("id"), "component")
    final = written(final, "components")
    component = F.coalesce("component", "id").alias("component")
    named = full.select("doc_id", "id", "n_shingles").join(final, "id", "left").select("doc_id", "n_shingles", component)
    empty = rows.where("set_digest is null or doc_id is null").select("doc_id", "n_shingles")
    # an empty set whose doc_id has other texts is of their component
    theirs = full.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "id").dropDuplicates(["doc_id"])
    theirs = theirs.join(final, "id", "left").select("doc_id", component)
    empty = empty.join(theirs, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    out = named.unionByName(empty)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept")
    return fewer_files(out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept))


def _shared_ids(full: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of a doc_id that repeats with other texts."""
    several = full.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("doc_id", "a")
    return full.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def _salted(groups: DataFrame) -> DataFrame:
    """Members of each group dealt over salts of about BLOCK members, with the root in all of them."""
    size = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    rows = groups.join(size, "root")
    root = F.col("id") == F.col("root")
    salts = F.when(root, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("g")).cast("int")))
    return rows.select("id", "class_digest", "root", F.explode(salts).alias("salt"), root.alias("is_root"))


def _blocks(groups: DataFrame) -> DataFrame:
    """Blocks of the groups that hold several components.

    Members of a group's largest component are compared with the others
    ("strays") only.  Strays are dealt to s parts, the largest component to m
    further parts; block (i, j) has i < s and i <= j.
    """
    sizes = groups.groupBy("root", "component").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("root").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top"))
    whole = whole.where("size > top.n").select("root", F.col("top.component").alias("top"), F.col("top.n").alias("n"), "size")
    s, m = F.ceil((F.col("size") - F.col("n")) / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    rows = groups.join(whole.select("root", "top", s.alias("s"), m.alias("m")), "root")
    h = F.xxhash64("id")
    own = F.when(F.col("component") == F.col("top"), F.col("s") + F.pmod(h, F.col("m"))).otherwise(F.pmod(h, F.col("s"))).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") + F.col("m") - 1)))
    i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    return rows.select("id", "class_digest", "root", "component", "own", i, j, "s").where("i < s").drop("s")


def _unconnected(members: DataFrame, found: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs (a, b) that share a bucket but no component yet.

    A bucket is dealt over g = ceil(size / BLOCK) groups by a hash of the id;
    each pair of groups is one block, whose registers are compared in a task.
    """
    named = members.join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    named = named.select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = (
        named.groupBy("bucket")
        .agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        # of two members the pivot's pair is decided already
        .where("lo <> hi and size > 2")
        .select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("g"))
    )
    row = named.join(mixed, "bucket").join(reps, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    row = row.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    row = row.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n_shingles", "sketch")
    cut = slack(threshold)

    def run(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        ids, comp, n, own = (t.column(c).to_numpy().copy() for c in ("id", "component", "n_shingles", "own"))
        s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for x in left:
            y = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) | (i != j))]
            y = y[np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x]) - 1e-6]
            if len(y):
                y = y[estimate(s[y], s[x][None, :], n[y], n[[x] * len(y)]) >= cut]
                # one pair to each component in reach, which then are one: a block gives fewer pairs than members
                for c in np.unique(comp[y]):
                    a.append(ids[x])
                    b.append(ids[y[comp[y] == c][0]])
                    comp[comp == c] = comp[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return row.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of the smallest doc_id.

    Columns and their order stay.  Of rows that repeat a doc_id the smallest
    (by all columns) stays; rows with a null doc_id all stay.
    """
    cols = docs.columns
    keep = near_duplicates(docs, words, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi")
    one = named.groupBy("doc_id").agg(F.min(F.struct(*[c for c in cols if c != "doc_id"])).alias("row")).select("doc_id", "row.*")
    return fewer_files(one.select(cols).unionByName(docs.where("doc_id is null")), 2)
