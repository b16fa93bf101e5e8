"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Texts are lower-cased and folded (homoglyphs of other scripts, full-width
letters, digits and signs that stand for letters, invisible characters), then
all lexicon terms are found in one pass.  A term is a whole word or a word
beginning (``stem``); matches inside an exception phrase do not count.  The
weights of the distinct strings found are summed, set against the text's
length, and a logistic curve turns both into a score.

The lexicon is learned from labelled documents: a term's weight is the log
ratio of the shares of toxic and clean documents that hold it, kept if the
likelihood ratio says that chance does not explain it.  Two-word phrases with
a term that clean documents hold become exceptions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .common import checkpointed, fold, strings, text_slices, utf8

#: Bounds of the training sample (documents, taken by the order of a hash of their id).
MAX_TOXIC, MAX_CLEAN = 2000, 4000
#: Least likelihood ratio (G squared) of a term, and the least share of the toxic documents that hold it.  These
#: alone bound the lexicon: of at most MAX_TOXIC documents' terms at most one in 200 * (terms a document) passes.
MIN_EVIDENCE, MIN_SHARE = 15.0, 0.005
STEM_LENGTHS = (4, 5, 6, 7)
TOXIC = 0.7

#: Letters that look like Latin ones (Cyrillic, Greek), and signs that stand for letters.
_LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_FOLD = {ord(k): v for k, v in {**_LOOKALIKE, **_SIGNS}.items()}
_FOLD |= {0xFF41 + i: chr(ord("a") + i) for i in range(26)}  # full-width letters
_FOLD |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])  # invisible
_ANY = re.compile("[" + "".join(map(re.escape, map(chr, _FOLD))) + "]")
_WORD = re.compile(r"\w+")


def folded(text: str) -> str:
    text = text.lower()
    return text.translate(_FOLD) if _ANY.search(text) else text


@dataclass
class Lexicon:
    """terms: word -> weight; stems: word beginning -> weight; exceptions: phrases whose matches do not count."""

    terms: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    #: score = sigmoid(bias + total * log(1 + weight found) + density * sqrt(weight found per word))
    bias: float = -3.0
    total: float = 2.0
    density: float = 1.0


class Matcher:
    """The automaton over a lexicon's terms, stems and exceptions."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        kinds: dict[str, dict[str, float]] = {}
        for kind, entries in (("term", lexicon.terms), ("stem", lexicon.stems), ("except", dict.fromkeys(lexicon.exceptions, 0.0))):
            for s, w in entries.items():
                if s:
                    kinds.setdefault(folded(s), {})[kind] = w
        self.automaton = None
        if kinds:
            self.automaton = ahocorasick.Automaton()
            for s, k in kinds.items():
                self.automaton.add_word(s, (len(s), k))
            self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches that count, in the folded text; of matches at one start the heaviest."""
        if self.automaton is None:
            return []
        best: dict[int, tuple[int, float]] = {}
        shut: list[tuple[int, int]] = []
        n = len(text)
        for last, (size, kinds) in self.automaton.iter(text):
            a, b = last + 1 - size, last + 1
            if a and _letter(text[a - 1]):
                continue
            whole = b == n or not _letter(text[b])
            if "except" in kinds and whole:
                shut.append((a, b))
            w = max(kinds.get("stem", 0.0), kinds.get("term", 0.0) if whole else 0.0)
            if w > 0 and w > best.get(a, (0, 0.0))[1]:
                best[a] = (b, w)
        return [(a, b, w) for a, (b, w) in sorted(best.items()) if not any(x <= a and b <= y for x, y in shut)]

    def evidence(self, text: str) -> tuple[float, int]:
        """Sum of the weights of the distinct strings found, and number of words, of a raw text."""
        text = folded(text)
        found = {text[a:b]: w for a, b, w in self.found(text)}
        return (sum(found.values()), len(text.split())) if found else (0.0, 1)

    def score(self, text: str) -> float:
        w, n = self.evidence(text)
        x = self.lexicon
        z = x.bias + x.total * math.log1p(w) + x.density * math.sqrt(w / max(n, 1))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _letter(c: str) -> bool:
    return c.isalnum() or c == "_"


def _terms(text: str) -> tuple[set[str], set[str]]:
    """Distinct words and stems (marked by a trailing ``*``) of a folded text, and its phrases of two words."""
    words = _WORD.findall(text)
    own = set(words)
    stems = {w[:k] + "*" for w in own for k in STEM_LENGTHS if len(w) > k}
    return own | stems, set(map(" ".join, zip(words, words[1:])))


def _count(rows: DataFrame, of) -> DataFrame:
    """(term, toxic, clean): how many of the rows' texts hold each term; counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for whole in batches:
            for b in text_slices(whole):
                for t, y in zip(strings(b.column(0)), b.column(1).to_pylist()):
                    counts[0 if y else 1].update(of(folded(t)))
                if sum(map(len, counts)) > 500_000:
                    yield _counted(counts)
                    counts = (Counter(), Counter())
        yield _counted(counts)

    got = rows.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return got.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "toxic", "clean"]
    )


def _xlogx(x):
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def _evidence(n1: int, n0: int):
    """Log ratio of the shares, and G squared of the 2 x 2 table."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    cells = [a, b, F.lit(float(n1)) - a, F.lit(float(n0)) - b]
    rows, cols = [a + b, F.lit(float(n1 + n0)) - a - b], [F.lit(float(n1)), F.lit(float(n0))]
    g = 2 * (sum(map(_xlogx, cells), F.lit(0.0)) - sum(map(_xlogx, rows + cols), F.lit(0.0)) + _xlogx(F.lit(float(n1 + n0))))
    return F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1)), g


def learn(rows: DataFrame, n1: int, n0: int) -> Lexicon:
    """Lexicon from n1 toxic and n0 clean rows (text, toxic); both numbers are bounded by the sample."""
    if not n1 or not n0:
        return Lexicon({})
    weight, g = _evidence(n1, n0)
    terms = _count(rows, lambda t: _terms(t)[0])
    good = (weight >= math.log(5)) & (g >= MIN_EVIDENCE) & (F.col("toxic") >= MIN_SHARE * n1)
    top = terms.select("term", weight.alias("w"), g.alias("g"), F.lit(True).alias("x")).where(good)
    found = Lexicon({}, {})
    # shortest stems first: an entry stays only if it says clearly more than the stems it starts with
    for r in sorted(top.collect(), key=lambda r: (not r["term"].endswith("*"), len(r["term"]), r["term"])):
        own = r["term"].rstrip("*")
        covered = max((found.stems.get(own[:k], 0.0) for k in range(min(STEM_LENGTHS), len(own) + 1)), default=0.0)
        if r["w"] > covered + 0.3:
            (found.stems if r["term"].endswith("*") else found.terms)[own] = r["w"]
    found.exceptions = _exceptions(rows, found, n1, n0)
    found.bias, found.total, found.density = _curve(rows, found)
    return found


def _exceptions(rows: DataFrame, lexicon: Lexicon, n1: int, n0: int) -> tuple[str, ...]:
    """Phrases of two words with a term that clean documents hold far more often than toxic ones."""
    matcher = Matcher(lexicon)

    def of(text: str) -> set[str]:
        return {p for p in _terms(text)[1] if matcher.found(p)}

    _, g = _evidence(n1, n0)
    clean = F.col("clean") / n0 > 5 * F.col("toxic") / n1
    rows = _count(rows, of).where(clean & (F.col("clean") >= 2)).select("term", g.alias("g")).where(F.col("g") >= MIN_EVIDENCE / 3)
    return tuple(r["term"] for r in rows.orderBy(F.desc("g"), "term").collect())


def _curve(rows: DataFrame, lexicon: Lexicon, rounds: int = 400) -> tuple[float, float, float]:
    """Logistic fit of bias, total and density over the sample's evidence (two numbers a row)."""
    matcher = Matcher(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole):
                got = [matcher.evidence(t) for t in strings(b.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64()), b.column(1)], ["w", "n", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(run, "w double, n long, toxic int").toArrow()
    w, n, y = (got.column(c).to_numpy() for c in ("w", "n", "toxic"))
    x = np.c_[np.ones(len(w)), np.log1p(w), np.sqrt(w / np.maximum(n, 1))]
    x = x[np.lexsort((y, x[:, 2], x[:, 1]))]
    y = y[np.lexsort((y, np.sqrt(w / np.maximum(n, 1)), np.log1p(w)))]
    # more evidence never lowers the score
    c, penalty = np.array([-3.0, 2.0, 1.0]), np.array([0.0, 1e-3, 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(penalty + 1e-4)
        c = c - np.clip(np.linalg.solve(hess, x.T @ (p - y) / len(y) + penalty * c), -1, 1)
        c[1:] = np.maximum(c[1:], 0)
    return float(c[0]), float(c[1]), float(c[2])


def _without_near_copies(rows: DataFrame, bands: int = 5, width: int = 3) -> DataFrame:
    """Of the sample's rows (text, toxic) one of each set of copies and (by shared bands of least shingle hashes) near copies.

    Copies would count as evidence of their own.  Texts with three in four
    common shingles share one of five bands of three hashes with a chance of
    0.93, texts with a third in common with one of 0.17.
    """
    hashes = bands * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = flat.mix(np.arange(31, 31 + hashes, dtype=np.uint64))
        for whole in batches:
            for b in text_slices(whole):
                sets = flat.shingle_sets(*utf8(b.column(0)), 3)
                low = np.array([[flat.mix(s ^ x).min() if len(s) else 0 for x in salts] for s in sets], np.uint64).reshape(-1, bands, width)
                key = np.zeros(low.shape[:2], np.uint64)
                for i in range(width):
                    key = flat.mix(key + low[:, :, i])
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(key[:, i].view(np.int64)) for i in range(bands))], [*b.schema.names, *names])

    names = [f"m{i}" for i in range(bands)]
    rows = rows.select("text", "toxic").mapInArrow(run, "text string, toxic int, " + ", ".join(f"{n} long" for n in names))
    for n in names:
        rest = [c for c in rows.columns if c != n]
        rows = rows.groupBy(n).agg(F.min(F.struct(F.xxhash64("text").alias("k"), *rest)).alias("r")).select("r.*").drop("k")
    return rows


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Lexicon:
    """Learn from a bounded sample of the labelled documents outside the held-out fold, copies counted once."""
    ok = F.col("doc_id").isNotNull() & (fold("doc_id", mod) != held_out) & F.col("toxic").isin(0, 1)
    marked = labels.where(ok).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = docs.select("doc_id").distinct().join(marked, "doc_id")
    order = (F.xxhash64("doc_id"), "doc_id")
    sample = marked.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(marked.where("toxic = 0").orderBy(*order).limit(max_clean))
    # at most max_toxic + max_clean ids
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = checkpointed(_without_near_copies(rows.where("text is not null")))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return learn(rows, n.get(1, 0), n.get(0, 0))


def scored(docs: DataFrame, lexicon: Lexicon, to: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text (null: empty); all other columns stay."""
    keep = [f for f in docs.schema.fields if f.name != to]
    schema = T.StructType([*keep, T.StructField(to, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, names = Matcher(lexicon), [f.name for f in keep]
        for whole in batches:
            for b in text_slices(whole):
                s = pa.array([matcher.score(t) for t in strings(b.column(b.schema.get_field_index("text")))], pa.float64())
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), s], [*names, to])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts hold no evidence; rows with a null doc_id are scored,
    count as not held out and never train; repeated rows score alike; without
    labels of both kinds the lexicon is empty; an empty table gives no rows;
    other columns are left behind.
    """
    lexicon = train(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lexicon)
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
