"""Secret scans against plain loops over the texts."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter
from itertools import groupby

from pyspark.sql import functions as F

from basketry.llm import queries
from basketry.llm import secrets as X

from .util import SCHEMA, SF, documents, edge_docs, edge_rows, empty_docs, row, sha, words


def brute_base(t):
    """Base spans by scanning from every place (no shared patterns but the fixed ones)."""
    out = []
    rules = [
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    for k, (name, p, ok) in enumerate(rules):
        p, at = re.compile(p), 0
        while m := p.search(t, at):
            if ok(m):
                out.append((m.start(), k, name, m.end()))
            at = m.end()
    return [f"{n}:{s}:{e}" for s, _, n, e in sorted(out)]


CASES = [
    "password=abcdef", "PassWord : 'abcde'", "api_key=\"abc.def-1\" apikey: zzzzzz", "token = secret=abcdef", "tOKen=short", "Key apıkey=abcdefgh paſſword=abcdefgh",
    "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "xAKIAAKIA" + "Z" * 20, "f" * 24, "f" * 23, "e" * 10 + "g" + "a" * 30, "é" * 5 + " secret: " + "0af" * 9, "passwd==abcdef=", "token:\x20\x20'AKIA" + "Q" * 20 + "'",
]


def test_base_spans_on_cases():
    for t in CASES:
        assert [f"{X.KINDS[k]}:{s}:{e}" for s, e, k in X.base_spans(t)] == brute_base(t), t


def test_entropy_by_steps_equals_counting_anew():
    r = random.Random(1)
    for _ in range(50):
        s = "".join(r.choices("abcdeABC123", k=r.randint(1, 60)))
        w = min(20, len(s))
        want = max(-sum(c / w * math.log2(c / w) for c in Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1))
        assert abs(X.window_entropy(s, 20) - want) < 1e-9
    assert X.window_entropy("", 20) == 0


def test_entropy_spans_and_allow_list():
    scan = X.Scanner()
    key = "q9Xv2LkP0mZr8TnB4sWc7YhJ"
    found = scan.spans(f"start {key} end")[1]
    assert found == [(6, 6 + len(key), 3)]
    allowed = ["Donaudampfschifffahrtsgesellschaft", "12345678901234567890123", "123e4567-e89b-12d3-a456-426614174000", "2024-01-02/some-long-path-of-words/and-more", "a" * 40 + "1"]
    for t in allowed:
        assert not [s for s in scan.spans(t)[1] if s[2] == 3], t
    # what a base span covers is not given twice
    assert [k for *_, k in scan.spans(f"password={key}")[1]] == [0]
    assert X.Scanner(X.EntropyRules(allow=(r"q9X.*",))).spans(key)[1] == []


def test_query_against_brute_force(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in queries.op5_secret_scan(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in docs.items():
        base = brute_base(t)
        assert got[i].base_sha256 == sha(",".join(base))
        n = Counter(b.split(":")[0] for b in base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (n["assign"], n["access"], n["hex"])
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("entropy")] == base


def brute_entropy(text: str, base: list[tuple[int, int]]) -> list[str]:
    """Entropy spans character by character: what taken spans leave of every candidate, each window counted anew."""
    rules, taken, found = X.EntropyRules(), [False] * len(text), []
    for a, b in base:
        taken[a:b] = [True] * (b - a)
    for c in rules.classes:
        new = []
        for m in re.finditer(c.candidates, text):
            a = m.start()
            for free, own in groupby(range(m.start(), m.end()), lambda i: not taken[i]):
                n = len(list(own))
                piece, a = text[a : a + n], a + n
                if not free or n < min(c.window, len(m[0])) or any(re.fullmatch(p, piece) for p in rules.allow):
                    continue
                w = min(c.window, n)
                best = max(-sum(v / w * math.log2(v / w) for v in Counter(piece[i : i + w]).values()) for i in range(n - w + 1))
                if best >= c.bits - 1e-9:
                    new.append((a - n, a, best - c.bits))
        for a, b, _ in new:
            taken[a:b] = [True] * (b - a)
        found += new
    assert all(abs(over) > 1e-7 for *_, over in found)  # no window at the threshold, where the last bit would decide
    return [f"entropy:{a}:{b}" for a, b, _ in sorted(found)]


def with_secrets(text: str, seed: int) -> str:
    """``text`` with keys, paths, hashes and base secrets between its words, some run together."""
    r = random.Random(seed)
    draw = lambda a, n: "".join(r.choices(a, k=n))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    words = text.split(" ")
    for _ in range(r.randint(0, 4)):
        piece = r.choice([
            draw(letters + letters.upper() + digits, r.randint(15, 45)), draw(digits + "ABCDEF", r.randint(18, 40)), draw(digits + "abcdefABCDEF", r.randint(20, 40)),
            "/" + draw(letters, 8) + "/" + draw(letters + digits + "+/_-", 30), "password=" + draw(letters + digits, 24) + "/" + draw(letters.upper() + digits, 22),
            draw("ab", 60), draw(letters, 40), "AKIA" + draw(letters.upper() + digits, 20) + "_" + draw(letters + digits, 25) + "==", "-" * 25, draw(digits + "abcdef", 30) + "/" + draw(letters + letters.upper() + digits, 24),
        ])
        words.insert(r.randint(0, len(words)), piece)
    return " ".join(words)


def test_all_spans_against_brute_force(spark):
    docs = {i: with_secrets(t, i) for i, t in documents(spark).items()}
    out = X.scan(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    out = out.select("doc_id", X.joined("spans").alias("spans"), F.size(F.filter("spans", lambda s: s["kind"] == "entropy")).alias("n_entropy"))
    got = {r.doc_id: r for r in out.collect()}
    entropy = 0
    for i, t in docs.items():
        base = brute_base(t)
        want = brute_entropy(t, [tuple(map(int, b.split(":")[1:])) for b in base])
        own = [s for s in got[i].spans.split(",") if s.startswith("entropy")]
        assert own == want and got[i].n_entropy == len(want), i
        order = [(int(s.split(":")[1]), X.KINDS.index(s.split(":")[0])) for s in got[i].spans.split(",") if s]
        assert order == sorted(order)
        entropy += len(want)
    assert entropy > 100


def test_edge_rows(spark):
    docs = edge_docs(spark)
    out = X.scan(docs)
    assert out.columns == [c for c in docs.columns if c != "spans"] + ["spans"]
    got = out.collect()
    # 5000 times "a" is a long hex string; nothing else is a secret
    assert len(got) == len(edge_rows()) and all((r.spans != []) == (r.doc_id == 14) for r in got)
    assert X.scan(empty_docs(spark)).count() == X.redacted(empty_docs(spark)).count() == 0
    docs = docs.where("doc_id is null or doc_id <> 14")
    same = X.redacted(docs)
    assert same.columns == docs.columns
    assert sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))


def test_redacted(spark):
    t = f"a password=abcdef0123456789abcdef01 b {'f' * 30} c"
    docs = spark.createDataFrame([row(1, t), row(2, "plain"), row(3, None)], SCHEMA)
    got = {r.doc_id: r for r in X.redacted(docs).collect()}
    assert got[1].text == "a [SECRET] b [SECRET] c" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "plain" and got[3].text is None and got[3].n_chars is None


def test_clean_documents_are_left_alone(spark):
    rows = [row(i, words(200, i)) for i in range(20)]
    out = X.scan(spark.createDataFrame(rows, SCHEMA))
    assert all(r.spans == [] for r in out.collect())


def test_allow_list_takes_linear_time():
    """Rulers and boundaries whose candidate matches no allow pattern in the end."""
    slug = re.compile(X.EntropyRules().allow[-1])
    for t in ("-" * 24 + "==", "-" * 25 + "7d81b51112482", "a-/_" * 6 + "=="):
        began = time.monotonic()
        assert not slug.fullmatch(t)
        assert time.monotonic() - began < 1, t
    scan = X.Scanner()
    began = time.monotonic()
    for t in ("-" * 40 + "==", "_/" * 20_000 + "+", "ab12-" * 10_000 + "12345="):
        scan.spans(t)
    assert time.monotonic() - began < 20


def test_slugs_are_the_same_as_before():
    old = re.compile(r"/?([A-Za-z]*[0-9]{0,4}[/_-]+)*[A-Za-z]*[0-9]{0,4}/?")
    new = re.compile(X.EntropyRules().allow[-1])
    r = random.Random(3)
    texts = ["".join(r.choices("aZ09/_-+=", weights=(4, 2, 4, 3, 2, 1, 2, 0.2, 0.2), k=r.randint(0, 14))) for _ in range(20_000)]
    same = [bool(old.fullmatch(t)) for t in texts]
    assert 2000 < sum(same) < 18_000
    assert [bool(new.fullmatch(t)) for t in texts] == same


def test_only_the_covered_part_of_a_candidate_is_left_out():
    sha, token, upper = "3f786850e387550fdab836ed7e6dc881de23001b", "Zx9Kq2LmT8vRw4Yp7NsB", "0A1B2C3D4E5F6A7B8C9D"
    scan = X.Scanner()

    def cut(t):
        return [(X.KINDS[k], t[a:b]) for a, b, k in scan.spans(t)[1]]

    assert cut(f"/download/{sha}/{token}") == [("hex", sha), ("entropy", f"/{token}")]
    # upper case: no base span, but an earlier candidate of the hex class
    assert cut(f"/download/{sha.upper()}/{token}") == [("entropy", sha.upper()), ("entropy", f"/{token}")]
    # a hex key of mixed case: the base span has its lower-case part
    assert cut(f"{upper}9F{sha}") == [("entropy", f"{upper}9F"), ("hex", sha)]
    assert cut(f"{token}/AKIA{'Q7' * 8}/{token}") == [("entropy", f"{token}/"), ("access", f"AKIA{'Q7' * 8}"), ("entropy", f"/{token}")]
    # what is left is allowed, or shorter than a window
    assert cut(f"/path/of/some/plain/words/{sha}/more/plain/words/here") == [("hex", sha)]
    assert cut(f"{token[:19]}/{sha}") != [] and cut(f"{token[:18]}/{sha}") == [("hex", sha)]
    assert X.replace(f"/download/{sha}/{token}", scan.spans(f"/download/{sha}/{token}")[1], "#") == "/download/##"


def test_pieces_against_marked_characters():
    r = random.Random(5)
    for _ in range(500):
        spans = [(a, a + r.randint(1, 8), 0) for a in r.choices(range(60), k=r.randint(0, 6))]
        a, b = sorted(r.sample(range(70), 2))
        free = "".join("." if any(x <= i < y for x, y, _ in spans) else "x" for i in range(a, b))
        want = [(a + m.start(), a + m.end()) for m in re.finditer("x+", free) if len(m[0]) >= 3]
        assert list(X._uncovered(a, b, X._merged(spans), 3)) == want
