"""Prefix trie of conversations, by digests of fixed-length blocks of turns.

A node of the trie is a distinct sequence of first turns.  Nodes are not
looked for turn by turn:

1. Every conversation is cut into blocks of BLOCK turns.  A block's key covers
   all turns up to its end (each turn's digest is bound to its place; keys are
   128 bits), so conversations with equal keys share the whole prefix, and one
   grouped aggregate over (conversation, block) rows finds all shared blocks
   with their number of members and smallest member.
2. Where a block is the only one that follows the block before it, its turns
   are nodes with its members: nothing more is compared.  Only where siblings
   diverge are the turn boundaries inside their blocks refined: the distinct
   blocks (not their members) are cut into prefixes and grouped once more.
3. Sums over subtrees need no walk up the tree.  The smallest member of a node
   owns it.  What a conversation owns is a suffix of its path, so it is described
   by one number, the words before its first owned turn (all its words, if it
   owns none): ``unowned``.  A node's saved words are the members' sum of
   ``unowned`` without the owner's, less (members - 1) times the words before
   the node; its leaves are the members that own a childless node.

A conversation of very many turns is numbered by the skew-safe sequence of the
library, and its block keys are running sums within runs of SPAN blocks plus
offsets per run, so no window holds more than that.  The list of a node's ends
is digested from pieces of at most 4096 ids, one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.windows import ordered_sequence

from .common import written

#: Turns of a block; blocks of a run.
BLOCK, SPAN = 4, 1024
#: Conversations are dealt by families of FAMILY ids; HEADS bounds the turns taken over from the first of a family.
FAMILY, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
NONE_SHA256 = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words, n): turns numbered from 1 by turn, nulls first (ties: by digest); n turns in all.

    Null role or text is empty; rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn")).alias("at"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    numbered = ordered_sequence(rows, "conv_id", "at", "digest", seq="pos", group_rows="n")
    return numbered.select("conv_id", "pos", "digest", "words", "n")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, words) of every rebuilt conversation; and all conv_ids.

    Conversation c takes the first h turns of the first of its family,
    c - c % 20, then its own turns after its first h; h = crc32(c) % 4.
    """
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    take = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    item = F.struct("pos", "digest", "words")
    heads = numbered.where((F.col("conv_id") == family) & (F.col("pos") < HEADS))
    heads = heads.groupBy(F.col("conv_id").alias("family")).agg(F.sort_array(F.collect_list(item)).alias("head"))
    heads = written(heads, "heads")
    convs = numbered.where("pos = 1").select("conv_id", family.alias("family"), take.alias("take"))
    taken = convs.join(heads, "family").select("conv_id", F.inline(F.expr("slice(head, 1, int(take))")))
    own = numbered.select("*", family.alias("family"), take.alias("take")).where("pos > take").join(heads, "family", "left")
    shift = F.least(F.col("take"), F.coalesce(F.size("head"), F.lit(0)).cast("long")) - F.col("take")
    shift = F.when(F.col("head").isNull(), -F.col("take")).otherwise(shift)
    own = own.select("conv_id", (F.col("pos") + shift).alias("pos"), "digest", "words")
    return taken.unionByName(own), convs.select("conv_id")


def _terms(t: Column) -> tuple[Column, Column]:
    """128 bits of a turn at its place."""
    return F.xxhash64(t["digest"], t["pos"]), F.xxhash64(F.lit("place"), t["pos"], t["digest"])


def _folded(items: Column, which: int) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(_terms(t)[which]))


def blocks(rows: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(conv_id, nth, items, p1, p2, before, k1, k2, upto): keys and words before (p, before) and after (k, upto) each block."""
    nth = F.floor((F.col("pos") - 1) / block).cast("long").alias("nth")
    cut = rows.groupBy("conv_id", nth).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("items"))
    cut = cut.select("conv_id", "nth", "items", F.floor(F.col("nth") / span).alias("run"), _folded(F.col("items"), 0).alias("x1"), _folded(F.col("items"), 1).alias("x2"), F.aggregate("items", F.lit(0).cast("long"), lambda acc, t: acc + t["words"]).alias("words"))
    inside = Window.partitionBy("conv_id", "run").orderBy("nth")
    cut = cut.select("*", F.bit_xor("x1").over(inside).alias("l1"), F.bit_xor("x2").over(inside).alias("l2"), F.sum("words").over(inside).alias("lw"))
    cut = written(cut, "blocks", large=True)
    runs = cut.groupBy("conv_id", "run").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("words").alias("words"))
    prior = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = runs.select("conv_id", "run", *(F.coalesce(f.over(prior), zero).alias(a) for f, a in ((F.bit_xor("x1"), "o1"), (F.bit_xor("x2"), "o2"), (F.sum("words"), "ow"))))
    both = cut.join(runs, ["conv_id", "run"])
    k1, k2, upto = F.col("l1").bitwiseXOR(F.col("o1")), F.col("l2").bitwiseXOR(F.col("o2")), F.col("lw") + F.col("ow")
    out = both.select("conv_id", "nth", "items", k1.bitwiseXOR(F.col("x1")).alias("p1"), k2.bitwiseXOR(F.col("x2")).alias("p2"), (upto - F.col("words")).alias("before"), k1.alias("k1"), k2.alias("k2"), upto.alias("upto"))
    return written(out, "keyed-blocks", large=True)


def groups(keyed: DataFrame) -> DataFrame:
    """Distinct block prefixes with members, smallest member and whether other blocks follow the same block."""
    same = [F.any_value(c).alias(c) for c in ("items", "p1", "p2", "before")]
    found = keyed.groupBy("k1", "k2", "nth").agg(*same, F.count("*").alias("n"), F.min("conv_id").alias("owner"))
    found = written(found, "groups", large=True)
    siblings = written(found.groupBy("p1", "p2", "nth").agg((F.count("*") > 1).alias("diverge")), "siblings", large=True)
    # both written: next to plain exchanges, the join can split a block that very many different blocks follow
    return written(found.join(siblings, ["p1", "p2", "nth"]), "marked-groups", large=True)


NODE = ["k1", "k2", "depth"]


def _turn_nodes(found: DataFrame) -> DataFrame:
    """One row for each turn of each distinct block: its node's key, depth, parent's key, last words and words before."""
    place = F.explode(F.sequence(F.lit(1), F.size("items"))).alias("t")
    rows = found.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}).select("*", place)
    upto, prior = F.expr("slice(items, 1, t)"), F.expr("slice(items, 1, t - 1)")
    rows = rows.withColumns({"_upto": upto, "_prior": prior, "_turn": F.expr("items[t - 1]")})
    key = lambda items, which: F.col(f"p{which + 1}").bitwiseXOR(_folded(F.col(items), which))
    return rows.select(
        *(c for c in found.columns if c not in ("items", "p1", "p2", "before", "k1", "k2", "nth")),
        key("_upto", 0).alias("k1"), key("_upto", 1).alias("k2"), F.col("_turn.pos").alias("depth"),
        key("_prior", 0).alias("u1"), key("_prior", 1).alias("u2"), F.col("_turn.words").alias("words"),
        (F.col("before") + F.aggregate("_prior", F.lit(0).cast("long"), lambda acc, t: acc + t["words"])).alias("before"),
    )


def refined(found: DataFrame, values: dict[str, Column], fixed: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of all distinct blocks: those of diverging siblings are grouped by turn prefix, the others are their block's own.

    ``values``: aggregates, named as the columns of ``found`` they stand for.
    """
    alone = _turn_nodes(found.where("not diverge")).select(*NODE, *fixed, *values)
    split = _turn_nodes(found.where("diverge"))
    split = split.groupBy(*NODE).agg(*(F.any_value(c).alias(c) for c in fixed), *(f.alias(c) for c, f in values.items()))
    return alone.unionByName(split)


def _digested(rows: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of the conv_ids that end at each node."""
    piece = F.shiftright("conv_id", 12).alias("piece")  # at most 4096 ids
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = rows.groupBy(*NODE, piece).agg(ids.alias("ids"))
    pieces = pieces.repartition("k1", "k2").sortWithinPartitions(*NODE, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done():
            return pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "depth": [key[2]], "ends_sha256": [state.hexdigest()]})

        for b in batches:
            out = []
            for *own, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if own != key:
                    if key is not None:
                        out.append(done())
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if key is not None:
            yield done()

    return pieces.select(*NODE, "ids").mapInArrow(run, "k1 long, k2 long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; and its key k1, k2.

    Rows without conv_id are left out; null role or text is empty; turns of
    one conversation with equal numbers come in the order of their digests;
    rows that repeat are turns of their own.  Without any conversation there
    are no nodes.  Other columns are left behind.
    """
    numbered = written(turns(conversations), "turns", large=True)
    rows, ids = rebuilt(numbered)
    keyed = blocks(rows, block, span)
    found = groups(keyed)
    zero = F.lit(0).cast("long")
    # the root stands beside the nodes of blocks: all conversations are its members
    ids = written(ids, "ids")
    root = ids.agg(F.count("*").alias("n"), F.min("conv_id").alias("owner")).where("n > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), F.lit(None).cast("long").alias("u1"), F.lit(None).cast("long").alias("u2"), zero.alias("before"), "n", "owner")
    fixed = ("u1", "u2", "before")
    nodes = refined(found, {"n": F.sum("n"), "owner": F.min("owner")}, fixed).unionByName(root)
    nodes = written(nodes, "nodes", large=True)
    children = nodes.where("depth > 0").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "nodes-with-children", large=True)

    # of each conversation: its end, the words before what it owns (all, if nothing), and whether it owns a leaf
    last = keyed.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2", F.element_at("items", -1)["pos"].alias("depth"), "upto"), "nth").alias("end"))
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("before").alias("unowned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    facts = ids.join(last, "conv_id", "left").join(owned, "conv_id", "left").select(
        "conv_id",
        *(F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in NODE),
        F.coalesce("unowned", "end.upto", zero).alias("unowned"), F.coalesce("leaf", zero).alias("leaf"),
    )
    facts = written(facts, "facts", large=True)

    member = keyed.select("conv_id", "k1", "k2", "nth").join(facts.select("conv_id", "unowned", "leaf"), "conv_id")
    first = F.min(F.struct("conv_id", "unowned"))
    sums = {"unowned": F.sum("unowned"), "leaf": F.sum("leaf"), "first": F.min("first")}
    per = member.groupBy("k1", "k2", "nth").agg(F.sum("unowned").alias("unowned"), F.sum("leaf").alias("leaf"), first.alias("first"))
    totals = refined(found.select("k1", "k2", "nth", "items", "p1", "p2", "before", "diverge").join(per, ["k1", "k2", "nth"]), sums)
    at_root = facts.agg(F.sum("unowned").alias("unowned"), F.sum("leaf").alias("leaf"), first.alias("first")).where("first is not null")
    totals = totals.unionByName(at_root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "unowned", "leaf", "first"))

    parents = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    out = nodes.join(totals, NODE).join(_digested(facts.select("conv_id", *NODE)), NODE, "left")
    out = written(out, "totals", large=True).join(written(parents, "parents", large=True), ["u1", "u2", "depth"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaf").alias("n_leaves"),
        (F.col("unowned") - F.col("first.unowned") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256"), "k1", "k2",
    )
