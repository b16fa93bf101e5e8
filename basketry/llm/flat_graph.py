"""Embedding near-dedup over a robust-pruned flat graph (after Vamana, Subramanya et al., 2019).

1. Equal vectors form one class; classes are dealt to overlapping cluster
   shards: k-means fitted on a bounded sample, each class going to its nearest
   clusters.  A shard with too many rows is split again; one that no split
   makes smaller (a ball of near copies) is cut into blocks, and each block is
   searched for the rows of one block at a time.
2. Each shard builds a graph of its members: candidates are the nearest members
   and some random ones, pruned by the robust rule (a candidate goes if a kept
   neighbour is alpha times nearer to it than the node is), with back edges.
3. The adjacency lists of all shards are united by node.
4. Each class is searched in its shards: greedily from the shard's medoid, and
   once in range, on through every node within the range and a margin around it.
5. Found pairs are verified by their cosine in double precision, counted once
   (in the first shard that both ends share), and joined to components.
6. An unbiased sample of the classes is compared with all classes.  Where the
   mean recall of a class, or that of all links, is under the target, the
   overlap is raised and the work done again.  At the last overlap every shard
   holds all rows of its parent; should the graphs still miss too much there,
   its pairs of blocks are compared in full.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fewer_files, written
from .components import connected_components

#: Rows that a shard may have; classes that k-means is fitted on, per shard that is split.
SHARD_ROWS, FIT_ROWS = 2500, 8192
#: The table of shard sizes is broadcast up to this number of shards.
BROADCAST_SHARDS = 100_000
#: Most clusters of one split.
MAX_CLUSTERS = 256
#: Clusters a class goes to at first; neighbours of a node; nearest and random candidates; robust factor.
OVERLAP, DEGREE, NEAREST, RANDOM, ALPHA = 4, 32, 48, 48, 1.2
#: Beam of the greedy search, and how far below the threshold the range expands.
BEAM, MARGIN = 12, 0.06
#: Classes of the audit, and the recall it must find.
AUDIT_ROWS, TARGET = 512, 0.98
#: The table of components with several classes is broadcast up to this number of rows.
BROADCAST_COMPONENTS = 1_000_000
#: Class ids of vec_ids that name several classes lie from here on.
EXTRA_IDS = 1 << 62


def units(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, v): unit vector (doubles) and its digest of each row; null where a row can have no links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, e in zip(b.column(0).to_pylist(), b.column(1)):
                x = None
                if i is not None and e.is_valid and len(e) and not e.values.null_count:
                    x = e.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    # scaled first: no overflow in the squares
                    x = x / top / np.sqrt(((x / top) ** 2).sum()) + 0.0 if np.isfinite(top) and top > 0 else None
                out.append(None if x is None else x.tobytes())
            keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["vec_id", "key", "v"])

    return vectors.mapInArrow(run, "vec_id long, key binary, v binary")


def classes(rows: DataFrame) -> DataFrame:
    """(key, id, least, copies) of each distinct unit vector: a number of its own, its smallest vec_id and its rows.

    The number is the smallest vec_id; where that is the smallest of several
    vectors (a vec_id that repeats), all but one have a number from EXTRA_IDS on.
    """
    per = written(rows.where("v is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")), "keys")
    several = written(per.groupBy("least").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-ids")
    extra = F.xxhash64("least", "key").bitwiseAND(F.lit(EXTRA_IDS - 1)) + F.lit(EXTRA_IDS)
    own = F.col("first").isNull() | (F.col("key") == F.col("first"))
    return per.join(several, "least", "left").select("key", F.when(own, F.col("least")).otherwise(extra).alias("id"), "least", "copies")


def _stack(values) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.float64).reshape(len(values), -1)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of the rows of ``x`` (unit vectors)."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def _seed(name: str) -> int:
    return zlib.crc32(name.encode())


def shards(rows: DataFrame, overlap: int, shard_rows: int = SHARD_ROWS, max_clusters: int = MAX_CLUSTERS) -> DataFrame:
    """(shard, g, id, copies, v): each class in all of its shards; g is the number of blocks the shard is cut into."""
    # vectors of different lengths have no cosine: each length is a shard to begin with
    now = written(rows.withColumn("shard", F.concat(F.lit("d"), F.length("v").cast("string"))).withColumn("was", F.lit(0).cast("long")), "shards")
    done = None
    while True:
        size = now.groupBy("shard").agg(F.count("*").alias("n"), F.max("was").alias("parent"))
        # a split that left nearly all rows together is not tried again
        stuck = (F.col("parent") > 0) & (F.col("n") > 0.8 * F.col("parent"))
        size = checkpointed(size.withColumn("split", (F.col("n") > shard_rows) & ~stuck))
        marks = size.select("shard", "n", "split")
        if size.count() <= BROADCAST_SHARDS:
            marks = F.broadcast(marks)
        now = now.drop("was").join(marks, "shard")
        leaf = now.where("not split").withColumn("g", F.ceil(F.col("n") / shard_rows).cast("int")).drop("n", "split")
        done = leaf if done is None else done.unionByName(leaf)
        big = size.where("split").count()
        if not big:
            return done
        now = written(_split(now.where("split").drop("split"), big, overlap, shard_rows, max_clusters), "shards")


def _split(rows: DataFrame, big: int, overlap: int, shard_rows: int, max_clusters: int) -> DataFrame:
    """Rows (shard, n, ...) of oversized shards, dealt to the nearest clusters of their shard."""
    part = rows.where((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < FIT_ROWS / F.col("n"))

    def fit(t: pa.Table) -> pa.Table:
        name, n = t.column("shard")[0].as_py(), t.column("n")[0].as_py()
        t = t.sort_by("id")
        x = _stack(t.column("v"))
        # clusters of about 2 / 5 of the rows a shard may have: few of them are too large
        k = min(max_clusters, max(2, -(-5 * n * overlap // (2 * shard_rows))), max(1, len(x) // 4))
        return pa.table({"shard": [name], "c": [kmeans(x, k, _seed(name)).tobytes()]})

    centres = checkpointed(part.select("shard", "n", "id", "v").groupBy("shard").applyInArrow(fit, "shard string, c binary"))
    # a row holds at most MAX_CLUSTERS vectors
    both = rows.join(F.broadcast(centres) if big <= 256 else centres, "shard")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in dict.fromkeys(b.column(0).to_pylist()):
                t = pa.Table.from_batches([b]).filter(pc.equal(b.column(0), name))
                x = _stack(t.column("v"))
                c = np.frombuffer(t.column("c")[0].as_py(), np.float64).reshape(-1, x.shape[1])
                p = min(overlap, len(c))
                near = np.argpartition(-(x @ c.T), p - 1, axis=1)[:, :p]
                at = np.repeat(np.arange(len(x)), p)
                names = pa.array([f"{name}.{i}" for i in near.ravel()])
                t = t.select(["id", "copies", "v", "n"]).take(at)
                yield from pa.table({"shard": names, "id": t["id"], "copies": t["copies"], "v": t["v"], "was": t["n"]}).to_batches()

    return both.select("shard", "id", "copies", "v", "n", "c").mapInArrow(deal, "shard string, id long, copies long, v binary, was long")


def pruned(v: np.ndarray, seed: int, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency of the robust-pruned graph over the rows of ``v``; every node can be reached from the medoid."""
    n = len(v)
    if n == 1:
        return [np.zeros(0, np.int64)]
    rng = np.random.default_rng(seed)
    near = min(NEAREST, n - 1)
    pool = np.empty((n, near + RANDOM), np.int64)
    for i in range(0, n, 512):
        s = v[i : i + 512] @ v.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        pool[i : i + 512, :near] = np.argpartition(-s, near - 1, axis=1)[:, :near]
    pool[:, near:] = rng.integers(0, n, (n, RANDOM))
    links = [np.unique(x) for x in _robust(v, np.arange(n), pool, degree, alpha)]
    back: list[list[int]] = [[] for _ in range(n)]
    for a, own in enumerate(links):
        for b in own:
            back[b].append(a)
    both = [np.union1d(own, np.array(more, np.int64)) for own, more in zip(links, back)]
    # nodes with many back edges are pruned again, those of like degree together
    over = sorted((a for a in range(n) if len(both[a]) > degree), key=lambda a: len(both[a]))
    for i in range(0, len(over), 128):
        some = over[i : i + 128]
        width = len(both[some[-1]])
        wide = np.array([np.r_[both[a], np.full(width - len(both[a]), a)] for a in some])
        for a, own in zip(some, _robust(v, np.array(some), wide, degree, alpha)):
            both[a] = np.unique(own)
    return _reachable(v, both)


def _robust(v: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Robust pruning of each node's candidate pool, in blocks of nodes (a pool entry equal to its node is void)."""
    out = []
    # pairs of candidates held at once: about 2 million
    block = max(1, min(128, 2_000_000 // pool.shape[1] ** 2))
    for i in range(0, len(nodes), block):
        a, c = nodes[i : i + block], pool[i : i + block]
        x = v[c]
        to = 1 - np.einsum("ijk,ik->ij", x, v[a])  # half the squared distance
        between = 1 - x @ x.transpose(0, 2, 1)
        alive = c != a[:, None]
        # repeats of a candidate are pruned by the first (distance 0)
        kept = [[] for _ in a]
        rows = np.arange(len(a))
        for _ in range(degree):
            best = np.argmin(np.where(alive, to, np.inf), axis=1)
            some = alive[rows, best]
            if not some.any():
                break
            for r in rows[some]:
                kept[r].append(c[r, best[r]])
            gone = alpha * alpha * between[rows, best] <= to
            alive &= ~gone & (c != c[rows, best][:, None]) & some[:, None]
        out += [np.array(k, np.int64) for k in kept]
    return out


def medoid(v: np.ndarray) -> int:
    return int(np.argmax(v @ v.mean(axis=0)))


def _reachable(v: np.ndarray, links: list[np.ndarray]) -> list[np.ndarray]:
    """Adds an edge from the most similar reached node to each part that the medoid does not reach."""
    seen = np.zeros(len(v), bool)
    wave = np.array([medoid(v)])
    while True:
        while len(wave):
            seen[wave] = True
            wave = np.unique(np.concatenate([links[a] for a in wave]))
            wave = wave[~seen[wave]]
        left = np.flatnonzero(~seen)
        if not len(left):
            return links
        a = left[0]
        reached = np.flatnonzero(seen)
        b = reached[np.argmax(v[reached] @ v[a])]
        links[b] = np.append(links[b], a)
        wave = np.array([a])


def search(v: np.ndarray, links: list[np.ndarray], start: int, q: np.ndarray, threshold: float) -> np.ndarray:
    """Nodes found with similarity of at least ``threshold`` to q, greedily from ``start``, then through the range."""
    sims = np.full(len(v), -np.inf)
    opened = np.zeros(len(v), bool)
    sims[start] = v[start] @ q
    seen = np.array([start])
    wide = threshold - MARGIN
    while True:
        s = sims[seen]
        front = seen[s >= wide]
        if len(seen) > BEAM:
            beam = seen[np.argpartition(-s, BEAM)[:BEAM]]
        else:
            beam = seen
        beam = beam[~opened[beam]]
        # of the beam the best few; of the range all
        if len(beam) > 4:
            beam = beam[np.argpartition(-sims[beam], 4)[:4]]
        front = np.concatenate([front[~opened[front]], beam])
        if not len(front):
            return seen[sims[seen] >= threshold]
        opened[front] = True
        new = np.unique(np.concatenate([links[a] for a in front]))
        new = new[sims[new] == -np.inf]
        if len(new):
            sims[new] = v[new] @ q
            seen = np.concatenate([seen, new])


def _graphs(rows: DataFrame) -> DataFrame:
    """(id, links): the united adjacency lists of all shards."""

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids = t.column("id").to_numpy()
        links = pruned(_stack(t.column("v")), _seed(t.column("shard")[0].as_py()))
        return pa.table({"id": ids, "links": pa.array([ids[x] for x in links], pa.list_(pa.int64()))})

    lists = rows.groupBy("shard", "block").applyInArrow(build, "id long, links array<long>")
    return lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))


def _found(rows: DataFrame, threshold: float, exact: bool = False) -> DataFrame:
    """(id, n, root): per class and search the links found there first, and the smallest id they join it to.

    ``exact``: each query is compared with all members instead of searched.

    rows: (shard, block, part, member, query, id, copies, v, shards, links).
    Every class comes as often as it is a query, and where it is joined to another.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        name = t.column("shard")[0].as_py()
        ids, copies, v = t.column("id").to_numpy(), t.column("copies").to_numpy(), _stack(t.column("v"))
        member = np.flatnonzero(t.column("member").to_numpy(zero_copy_only=False))
        place = {i: k for k, i in enumerate(ids[member])}
        lists = t.column("links").to_pylist()
        links = [np.array([place[x] for x in lists[m] or () if x in place], np.int64) for m in member]
        own = [sorted(s) for s in t.column("shards").to_pylist()]
        x = v[member]
        start = medoid(x)
        links = _reachable(x, links)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        query = t.column("query").to_numpy(zero_copy_only=False)
        for q in np.flatnonzero(query):
            hit = member[np.flatnonzero(x @ v[q] >= threshold) if exact else search(x, links, start, v[q], threshold)]
            hit = hit[hit != q]
            # a pair is counted in the first shard that both are in
            mine = own[q]
            if len(mine) > 1 and len(hit):
                hit = hit[[next(s for s in mine if s in own[h]) == name for h in hit]]
            a.append(np.full(len(hit), q))
            b.append(hit)
        a, b = np.concatenate(a), np.concatenate(b)
        root = np.arange(len(ids))
        while len(a):
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            if (low == root).all():
                break
            root = low
        out = pa.table({"id": ids, "n": np.bincount(a, copies[b], len(ids)).astype(np.int64), "root": ids[root]})
        return out.filter(pa.array(query | (root != np.arange(len(ids)))))

    return rows.groupBy("shard", "block", "part").applyInArrow(run, "id long, n long, root long")


def _audit(rows: DataFrame, found: DataFrame, threshold: float, audit_rows: int) -> float:
    """Recall over an unbiased sample of classes: the mean of a class's, or of all links together, whichever is less; 1 without links.

    A group of very many copies has one say in the mean, however many links it has.
    """
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(audit_rows)
    # at most audit_rows classes, on the driver and in the tasks
    sample = sample.join(found.select("id", "n"), "id").toArrow()
    if not sample.num_rows:
        return 1.0
    all_ids, values = sample.column("id").to_numpy(), sample.column("v").to_pylist()
    by_length = {}
    for size in {len(v) for v in values}:
        own = [k for k, v in enumerate(values) if len(v) == size]
        by_length[size] = (all_ids[own], np.frombuffer(b"".join(values[k] for k in own), np.float64).reshape(len(own), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {size: np.zeros(len(ids)) for size, (ids, _) in by_length.items()}
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                c = b.slice(i, 4096)
                size = pc.binary_length(c.column(2)).to_numpy(zero_copy_only=False)
                for d in set(size.tolist()) & by_length.keys():
                    t = c.take(pa.array(np.flatnonzero(size == d)))
                    ids, q = by_length[d]
                    hit = _stack(t.column(2)) @ q.T >= threshold
                    hit &= t.column(0).to_numpy(zero_copy_only=False)[:, None] != ids[None, :]
                    total[d] += hit.T @ t.column(1).to_numpy(zero_copy_only=False)
        for size, (ids, _) in by_length.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[size])], ["id", "n"])

    true = rows.select("id", "copies", "v").mapInArrow(run, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).collect()
    true = {r["id"]: r["n"] for r in true if r["n"]}
    if not true:
        return 1.0
    got = dict(zip(all_ids.tolist(), sample.column("n").to_pylist()))
    return min(sum(got[i] / n for i, n in true.items()) / len(true), sum(got[i] for i in true) / sum(true.values()))


def linked(vectors: DataFrame, threshold: float = 0.9, overlap: int = OVERLAP, shard_rows: int = SHARD_ROWS, target: float = TARGET) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row of ``vectors`` (vec_id, embedding).

    Links are pairs of rows with a cosine of at least ``threshold``; vectors of
    different lengths have none.  Defined results: vectors that are null, zero,
    or hold null or non-finite components have no links and are their own
    component; copies link with each other; rows that repeat a vec_id are
    vectors of their own, each with its own links; a null vec_id has no links,
    component null and is kept; an empty table gives no rows; other columns are
    left behind.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    own = written(units(vectors), "units")
    named = written(classes(own), "classes")
    heads = own.join(named, "key").where("vec_id = least").dropDuplicates(["key"])
    rows = written(heads.select("id", "copies", "v"), "heads")
    exact = False
    while True:
        found = written(_links(rows, threshold, overlap, shard_rows, exact), "found")
        sums = written(found.groupBy("id").agg(F.sum("n").alias("n")), "sums")
        recall = _audit(rows, sums, threshold, AUDIT_ROWS)
        if recall >= target or exact:
            break
        exact = overlap >= MAX_CLUSTERS
        overlap = min(2 * overlap, MAX_CLUSTERS)
    component = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    # classes only: their rows come by the class
    component = written(component.select(F.col("node").alias("id"), "component"), "components")
    parts = named.join(component, "id", "left").join(sums, "id", "left")
    least = written(parts.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
    least = F.broadcast(least) if least.count() <= BROADCAST_COMPONENTS else least
    parts = parts.join(least, "component", "left")
    n = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    parts = written(parts.select("key", n.alias("n_links"), F.coalesce("smallest", "least").alias("smallest")), "class-results")
    out = own.select("vec_id", "key").join(parts, "key", "left")
    top = F.coalesce("smallest", "vec_id")
    return fewer_files(out).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), F.coalesce(F.col("vec_id") == top, F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall")
    )


def _links(rows: DataFrame, threshold: float, overlap: int, shard_rows: int, exact: bool = False) -> DataFrame:
    """Graphs of all shards, united, and searched."""
    dealt = shards(rows, overlap, shard_rows)
    homes = dealt.groupBy("id").agg(F.collect_set("shard").alias("shards"))
    dealt = written(dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("g")).cast("int")), "dealt")
    lists = written(_graphs(dealt.select("shard", "block", "id", "v")), "graph")
    return _found(_searches(dealt.join(homes, "id").join(lists, "id")), threshold, exact)


def _searches(dealt: DataFrame) -> DataFrame:
    """The rows of each search: (shard, block, part) has the members of a block, and as queries the rows of block ``part``.

    A shard of g blocks has g * g searches of about two blocks each, so that no
    task holds more of it, whatever its size.  Queries come without links.
    """
    own, each = F.col("own"), F.sequence(F.lit(0), F.col("g") - 1)
    as_member = F.transform(each, lambda p: F.struct(F.col("own").alias("block"), p.alias("part"), F.lit(True).alias("member"), (p == own).alias("query")))
    as_query = F.transform(F.filter(each, lambda b: b != own), lambda b: F.struct(b.alias("block"), F.col("own").alias("part"), F.lit(False).alias("member"), F.lit(True).alias("query")))
    at = dealt.withColumnRenamed("block", "own").withColumn("at", F.explode(F.concat(as_member, as_query)))
    return at.select("shard", "at.*", "id", "copies", "v", "shards", F.when(F.col("at.member"), F.col("links")).alias("links"))
