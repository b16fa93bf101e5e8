"""Isolation forest (Liu, Ting & Zhou, ICDM 2008) in DataFrame functions.

* **Sample.** Each tree gets the ``psi`` rows of least hash.  A row's hashes for
  all trees come from one md5 of its key (a pairwise independent family); two
  gates on them keep about 3 * trees * psi rows and 3 * psi candidates a tree,
  so the ranking sorts a bounded number of rows whatever the input size.
* **Fit, level by level.** Nodes are numbered as in a heap (children 2i and
  2i + 1).  At each depth one aggregate over (tree, node) finds the size and the
  range of every feature; an md5 of (tree, node) picks one of the features with
  a range, and a cut in it.  The sample is dealt by tree once; the levels follow
  without another shuffle.
* **Score.** Rows walk down all trees by one broadcast lookup of (tree, node) per
  level; the model has at most ``trees * (2 ** (height + 1) - 1)`` nodes, a bound
  set by the parameters.  Path lengths are whole numbers (units of 2 ** -32, the
  mean path of an unfinished leaf by exact harmonic numbers), so sums do not
  depend on their order.

Every choice is an md5 of keys, so the forest depends on the rows only, and SQL
can state all of it.  Scores are published to nine places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Modulus of the hash family (a prime below 2**31); unit of path lengths; places of a score.
PRIME, UNIT, PLACES = 2_147_483_647, 1 << 32, 9
SEPARATOR = "\x01"


def _hex(digest: Column, first: int, digits: int) -> Column:
    """Some hex digits of a digest as a whole number."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("bigint")


def _md5(*parts) -> Column:
    return F.md5(F.concat_ws(SEPARATOR, *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def mean_path(n: int) -> int:
    """c(n) in units of 2**-32: mean path of an unsuccessful search among n points, 2 H(n - 1) - 2 (n - 1) / n."""
    return 2 * sum(UNIT // k for k in range(1, n)) - 2 * (n - 1) * UNIT // n if n > 1 else 0


def height_of(psi: int) -> int:
    """Levels that a tree of psi rows may have: log2, rounded up."""
    return max(psi - 1, 1).bit_length()


def tree_sample(feats: DataFrame, key: str, n: int, trees: int, psi: int, seed: int) -> DataFrame:
    """``feats`` of each tree's rows, with ``tree`` from 0."""
    wanted = 3 * trees * psi
    row_gate = min(UNIT, wanted * UNIT // max(n, 1))
    tree_gate = min(PRIME, 3 * psi * PRIME // max(min(n, wanted), 1))
    hashed = feats.withColumn("__d", _md5("row", seed, F.col(key).cast("string")))
    hashed = hashed.where(_hex(F.col("__d"), 17, 8) < row_gate)
    hashed = hashed.withColumns({"__a": _hex(F.col("__d"), 1, 8) % PRIME, "__b": _hex(F.col("__d"), 9, 8) % PRIME}).drop("__d")
    each = hashed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    each = each.withColumn("__h", (F.col("__a") * (F.col("tree") + 1) + F.col("__b")) % PRIME).where(F.col("__h") < tree_gate)
    # a number of its own: the rows are few, and adaptive coalescing would pack all trees in one task
    each = each.repartition(min(trees, feats.sparkSession.sparkContext.defaultParallelism), "tree")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("__h", key))
    return each.withColumn("__r", rank).where(F.col("__r") <= psi).drop("__r", "__h", "__a", "__b")


def _grown(rows: DataFrame, features: list[str], depth: int, seed: int) -> DataFrame:
    """One level: every row moves to a child of its node, unless the node has no range to cut."""
    n = range(len(features))
    at = "OVER (PARTITION BY tree, node)"
    node = f"md5(concat_ws('{SEPARATOR}', 'node', '{seed}', tree, node)) AS __d"
    out = rows.selectExpr(
        "*", f"count(1) {at} AS __size", node, f"array({', '.join(f'min(`{x}`) {at}' for x in features)}) AS __lo", f"array({', '.join(f'max(`{x}`) {at}' for x in features)}) AS __hi"
    )
    wide = f"filter(array({', '.join(map(str, n))}), i -> __hi[i] > __lo[i]) AS __wide"
    out = out.selectExpr("*", wide, f"array({', '.join(f'`{x}`' for x in features)}) AS __x")
    hexes = lambda first, digits: f"cast(conv(substring(__d, {first}, {digits}), 16, 10) AS bigint)"
    out = out.selectExpr("*", f"CASE WHEN size(__wide) > 0 THEN __wide[cast({hexes(1, 8)} % size(__wide) AS int)] END AS __f")
    raw = f"__lo[__f] + cast({hexes(9, 12)} AS double) / {float(1 << 48)!r}D * (__hi[__f] - __lo[__f])"
    # a cut at the largest value would leave one side empty
    out = out.selectExpr("*", f"CASE WHEN {raw} >= __hi[__f] THEN __lo[__f] ELSE {raw} END AS __cut")
    step = f"named_struct('node', node, 'feature', __f, 'threshold', __cut, 'size', __size, 'depth', {depth})"
    return out.selectExpr(
        "tree", *(f"`{x}`" for x in features),
        "CASE WHEN __f IS NULL THEN node WHEN __x[__f] <= __cut THEN node * 2 ELSE node * 2 + 1 END AS node",
        f"CASE WHEN __f IS NULL THEN path ELSE array_append(path, {step}) END AS path",
    )


def fit(feats: DataFrame, features: list[str], key: str, n: int, trees: int, psi: int, seed: int) -> DataFrame:
    """(tree, node, feature, threshold, size, depth): the forest's nodes; feature is -1 in leaves."""
    psi = min(psi, max(n, 1))
    rows = tree_sample(feats.select(key, *features), key, n, trees, psi, seed)
    step = "struct<node:bigint,feature:int,threshold:double,size:bigint,depth:int>"
    rows = rows.select("tree", *features, F.lit(1).cast("bigint").alias("node"), F.array().cast(f"array<{step}>").alias("path"))
    for depth in range(height_of(psi)):
        rows = _grown(rows, features, depth, seed)
    size = F.count(F.lit(1)).over(Window.partitionBy("tree", "node"))
    leaf = F.struct("node", F.lit(-1).alias("feature"), F.lit(0.0).alias("threshold"), size.alias("size"), F.size("path").alias("depth"))
    nodes = rows.withColumn("__leaf", leaf).select("tree", F.explode(F.array_append("path", F.col("__leaf").cast(step))).alias("n"))
    return nodes.select("tree", "n.*").distinct()


def scored(feats: DataFrame, nodes: DataFrame, features: list[str], key: str, trees: int, psi: int, score_col: str = "anomaly_score") -> DataFrame:
    """(key, score) of every row: 2 ** -(path lengths / mean path of the trees' sizes); higher is more isolated.

    ``nodes``: written or checkpointed rows of ``fit``.
    """
    mean = F.array(*[F.lit(mean_path(i)) for i in range(psi + 1)])
    c = F.element_at(mean, F.col("size").cast("int") + 1)
    total = nodes.where("node = 1").agg(F.greatest(F.sum(c), F.lit(1)).alias("__c"))
    # a node's slot, tree * width + node: one whole number to look up
    width = 2 << height_of(psi)
    length = F.when(F.col("feature") < 0, F.col("depth").cast("bigint") * UNIT + c)
    model = nodes.select((F.col("tree").cast("bigint") * width + F.col("node")).alias("slot"), "feature", "threshold", length.alias("__len"))
    model = F.broadcast(model)
    # dealt by key for the sum at the end, before the work: a few rows are much work, too
    spark = feats.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = feats.repartition(parts, key).select(key, *features, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("__t"))
    rows = rows.select(key, *features, (F.col("__t").cast("bigint") * width + 1).alias("slot"))
    x = F.element_at(F.array(*[F.col(f) for f in features]), F.col("feature") + 1)
    for _ in range(height_of(psi)):
        child = F.col("slot") + F.col("slot") % width + F.when(x <= F.col("threshold"), 0).otherwise(1)
        moved = F.when(F.col("feature") < 0, F.col("slot")).otherwise(child)
        rows = rows.join(model, "slot").select(key, *features, moved.alias("slot"))
    paths = rows.join(model, "slot").groupBy(key).agg(F.sum("__len").alias("__len"))
    raw = F.pow(F.lit(2.0), -(F.col("__len").cast("double") / F.col("__c").cast("double")))
    scale = float(10**PLACES)
    return paths.crossJoin(F.broadcast(total)).select(key, (F.floor(raw * scale + 0.5).cast("double") / scale).alias(score_col))
