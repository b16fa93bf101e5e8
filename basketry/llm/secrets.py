"""Secret scans: named patterns, and sliding-window entropy over candidate strings.

Base spans come from three patterns (assignments, access key ids, long hex
strings).  The entropy scan adds spans: candidates are runs of one character
class (hex digits; letters, digits and ``+/_-``), without what spans found
before cover; a window slides over each piece that is left, its Shannon entropy
kept up to date from the counts of the two characters that change, and a piece
with a window over its class's threshold is a secret unless the allow-list
knows it.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import strings, text_slices

#: Fixed patterns of the base kinds; letters in the first group of ``assign`` match in either (ASCII) case.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Candidates of one character class and when a window of them is a secret."""

    name: str
    candidates: str  # pattern of maximal runs, at least one window long
    window: int
    bits: float  # entropy per character that a window must reach


@dataclass(frozen=True)
class EntropyRules:
    """Parameters of the entropy scan."""

    classes: tuple[CharClass, ...] = (
        CharClass("hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])", 20, 3.0),
        CharClass("base64", r"[A-Za-z0-9+/_-]{20,}={0,2}", 20, 3.7),
    )
    #: Whole candidates that are no secrets: one kind of letters only (words), digits only (numbers), UUIDs, dates, paths and slugs of words.
    allow: tuple[str, ...] = field(
        default=(
            r"[A-Za-z]+",
            r"[0-9+/_-]+",
            r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
            # one way to match: each repeat starts with its separator, so a failure costs linear time
            r"[A-Za-z]*[0-9]{0,4}([/_-][A-Za-z]*[0-9]{0,4})*",
        )
    )


def window_entropy(s: str, window: int) -> float:
    """The largest Shannon entropy (bits per character) of any window of ``s``.

    With n characters, entropy = log2(n) - sum(c * log2(c)) / n over their
    counts; a step of the window changes two of the terms.
    """
    w = min(window, len(s))
    if not w:
        return 0.0
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c)

    def change(ch: str, by: int) -> float:
        c = counts.get(ch, 0)
        counts[ch] = c + by
        return _term(c + by) - _term(c)

    best = 0.0
    for i, ch in enumerate(s):
        total += change(ch, 1)
        if i >= w:
            total += change(s[i - w], -1)
        if i >= w - 1:
            best = max(best, math.log2(w) - total / w)
    return best


def _term(c: int) -> float:
    return c * math.log2(c) if c > 1 else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base kinds, by start, then kind."""
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 24] if _has_hex(text) else []
    return sorted(spans, key=lambda s: (s[0], s[2]))


_LONG_HEX = re.compile(r"[0-9a-f]{24}")


def _has_hex(text: str) -> bool:
    return _LONG_HEX.search(text) is not None


def _merged(spans: list[tuple]) -> list[tuple[int, int]]:
    """Disjoint (start, end) of what the spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b, *_ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _uncovered(a: int, b: int, covered: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
    """Pieces of [a, b) of at least ``least`` characters outside the disjoint, ordered spans ``covered``."""
    at = bisect.bisect_right(covered, a, key=lambda s: s[1])
    while at < len(covered) and covered[at][0] < b:
        if covered[at][0] - a >= least:
            yield a, covered[at][0]
        a = covered[at][1]
        at += 1
    if b - a >= least:
        yield a, b


class Scanner:
    """Finds the spans of one text."""

    def __init__(self, rules: EntropyRules = EntropyRules()):
        self.classes = [(c, re.compile(c.candidates)) for c in rules.classes]
        self.allow = [re.compile(p) for p in rules.allow]

    def entropy_spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates over their threshold, without what taken spans and earlier candidates cover."""
        covered, found = _merged(taken), []
        for c, pattern in self.classes:
            new = []
            for m in pattern.finditer(text):
                for a, b in _uncovered(m.start(), m.end(), covered, min(c.window, len(m[0]))):
                    if any(p.fullmatch(text[a:b]) for p in self.allow):
                        continue
                    if window_entropy(text[a:b], c.window) >= c.bits:
                        new.append((a, b, 3))
            found += new
            covered = _merged([*covered, *new])
        return found

    def spans(self, text: str) -> tuple[list, list]:
        """Base spans, and all spans, by start, then kind."""
        base = base_spans(text)
        return base, sorted(base + self.entropy_spans(text, base), key=lambda s: (s[0], s[2]))


SPAN = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, rules: EntropyRules = EntropyRules(), to: str = "spans") -> DataFrame:
    """``docs`` with a column ``to``: kind, start and end (code points, end exclusive) of every secret.

    Spans are ordered by start, then by kind as listed in KINDS.  Null and empty
    texts have no spans; repeated rows each get theirs; an existing column
    ``to`` is replaced, all others stay; an empty table stays empty.
    """
    keep = [f for f in docs.schema.fields if f.name != to]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*keep, T.StructField(to, T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        names = [f.name for f in keep]
        for whole in batches:
            for b in text_slices(whole):
                found = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in scanner.spans(t)[1]] for t in strings(b.column(b.schema.get_field_index("text")))]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(found, kind)], [*names, to])

    return docs.mapInArrow(run, schema)


def joined(spans: str = "spans", base_only: bool = False):
    """``kind:start:end`` of the spans, comma-joined."""
    c = F.filter(F.col(spans), lambda s: s["kind"] != "entropy") if base_only else F.col(spans)
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: EntropyRules = EntropyRules(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars`` set anew where it is a column.

    Spans that overlap are replaced by one mark.  Null texts stay null; rows
    without a secret stay as they are.
    """
    fields = docs.schema.fields
    numbers = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for whole in batches:
            for b in text_slices(whole):
                cols = {f.name: b.column(i) for i, f in enumerate(fields)}
                old = cols["text"].to_pylist()
                new = [replace(t, scanner.spans(t)[1], mark) if t else t for t in old]
                changed = [x is not y and x != y for x, y in zip(old, new)]
                if any(changed):
                    cols["text"] = pa.array(new, pa.string())
                    kind = next((f.dataType.simpleString() for f in fields if f.name == "n_chars"), "")
                    if kind in numbers:
                        sizes = [len(t) if c else n for t, c, n in zip(new, changed, cols["n_chars"].to_pylist())]
                        cols["n_chars"] = pa.array(sizes, numbers[kind])
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)


def replace(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, last, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= end:
            out += [text[last:a], mark]
        end = last = max(end, b)
    return "".join([*out, text[last:]])
