"""The prefix trie against a dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from basketry.llm import prefix_trie as X
from basketry.llm import queries

from .util import SF

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, depth string, owner long, n string, words string, pos string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def md5(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, md5(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])
        convs[c] = [*base[:h], *ts[h:]]
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def below(node):
        todo, leaves, saved = [node], 0, 0
        while todo:
            v = todo.pop()
            leaves += not children[v]
            saved += (len(members[v]) - 1) * (len(WORD.findall(v[-1][1])) if v else 0)
            todo += children[v]
        return leaves, saved

    for node, cs in members.items():
        leaves, saved = below(node)
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", "w", "p") for r in rows], SCHEMA)


def conversations(n=80, seed=0, first=0):
    """Conversations that share openings of many lengths; copies, missing firsts of a family, odd turn numbers."""
    r = random.Random(seed)
    lines = [f"{a} {b}" for a in ("hello", "go on", "why") for b in ("there", "now", "")]
    out = []
    for c in range(first, first + n):
        if c % 20 == 0 and r.random() < 0.3:
            continue
        path = [r.choice(lines[:2])] * r.randint(0, 7) + [r.choice(lines) for _ in range(r.randint(0, 6))]
        for i, text in enumerate(path):
            out.append((c, i * r.choice([1, 3]) if seed % 2 else i, "user" if i % 2 == 0 else "assistant", text))
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_prefix_trie(spark, SF)) == brute(rows)


@pytest.mark.parametrize(("seed", "block", "span"), [(0, 4, 1024), (1, 1, 2), (2, 3, 1), (3, 16, 3)])
def test_any_block_length(spark, seed, block, span):
    rows = conversations(70, seed, -30 if seed == 2 else 0)
    assert got(X.trie(frame(spark, rows), block, span)) == brute(rows)


def test_edge_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (None, None, None, None),
        (1, None, "user", "null first"), (1, 0, "user", "then zero"), (1, 0, "user", "tie"), (1, 0, "user", "tie"),
        (2, 0, None, None), (3, 0, "", ""), (4, 0, "user", ""), (5, 0, "", "user"), (6, 0, "us", "er"),
        (20, 5, "user", "a b c"), (21, 1, "user", "x " * 50_000), (22, 1, "user", "x " * 50_000), (23, 0, "user", "\t \n"),
        (45, 0, "user", "the first of its family is absent"), (-7, 0, "user", "below zero"), (-20, 0, "user", "family"), (2**62, 0, "user", "big"),
    ]
    assert got(X.trie(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert X.trie(frame(spark, [])).count() == 0
    assert X.trie(frame(spark, [(None, 0, "user", "x")])).count() == 0


def test_only_turnless_conversations(spark):
    """All turns of these ids are replaced by those of an absent conversation: the root is the only node."""
    ids = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "x") for c in ids]
    assert got(X.trie(frame(spark, rows))) == brute(rows) and len(brute(rows)) == 1


def test_hot_conversations(spark, skew_conf):
    """One conversation of very many turns, one copied very often, one very common first turn."""
    rows = [(7, i, "user", f"turn {i % 50}") for i in range(400)]
    rows += [(c, i, "user", f"same {i}") for c in range(100, 200) for i in range(6)]
    rows += [(c, i, "user", "hi" if i == 0 else f"{c} {i}") for c in range(300, 400) for i in range(3)]
    assert got(X.trie(frame(spark, rows), 4, 8)) == brute(rows)


def test_ends_are_digested_in_pieces(spark):
    """More ends of one node than a piece holds, ids on both sides of a piece's edge."""
    ids = [c for c in range(0, 20_000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 0]
    rows = [(c, 0, "user", "same") for c in ids]
    assert got(X.trie(frame(spark, rows))) == brute(rows)
