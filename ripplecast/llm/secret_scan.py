"""Secret scanning with trigram queries derived from the rules.

Each rule's regular expression is analysed into a Boolean query over trigrams of case-folded bytes that
every match must hold.  The documents are indexed a segment (a bounded batch) at a time: one pass marks
the positions of all trigrams that any rule asks for and yields their postings; a rule's query intersects
and unites postings, and only the documents left are searched with the expression.  A rule without
mandatory trigrams scans every document.  Segments need no shuffle, and a lost executor repeats its own.

Spans are leftmost and don't overlap within a kind; offsets are code points, ends exclusive.

Defined results: null texts are empty; repeated rows are scanned each; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import sliced, text_bytes


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: bytes
    flags: int = 0
    group: int = 0
    least: int = 0


#: The base kinds, in their listed order, then those that the method adds.
RULES = (
    Rule("assign", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 8),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 0, 16),
    Rule("hex", rb"[0-9a-f]{32,}"),
    Rule("private_key", rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", rb"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")

# --- Boolean trigram queries ---------------------------------------------------------------------
# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).
MOST_STRINGS, MOST_CLASS = 24, 6


def both(a, b):
    return combine("and", [a, b])


def combine(kind: str, parts: list):
    flat = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def needs(strings: set[bytes]):
    """At least one of the strings occurs."""
    if not strings or min(map(len, strings)) < 3:
        return True
    return combine("or", [combine("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


@dataclass
class Facts:
    """exact: all matches, if few; else starts and ends of matches; query: what any match must hold."""

    exact: set[bytes] | None
    starts: set[bytes]
    ends: set[bytes]
    query: object = True


ANY = Facts(None, {b""}, {b""})


def settle(f: Facts) -> Facts:
    """Gives up exactness where it grows too large, keeping its trigrams as a condition."""
    if f.exact is not None and len(f.exact) > MOST_STRINGS:
        return Facts(None, {s[:2] for s in f.exact}, {s[-2:] for s in f.exact}, both(f.query, needs(f.exact)))
    if f.exact is None:
        starts, ends, query = f.starts, f.ends, f.query
        if len(starts) > MOST_STRINGS:
            query, starts = both(query, needs(starts)), {s[:2] for s in starts}
        if len(ends) > MOST_STRINGS:
            query, ends = both(query, needs(ends)), {s[-2:] for s in ends}
        few = lambda x: {b""} if len(x) > MOST_STRINGS else x
        return Facts(None, few(starts), few(ends), query)
    return f


def follow(a: Facts, b: Facts) -> Facts:
    cross = lambda x, y: {p + q for p, q in product(x, y)}
    if a.exact is not None and b.exact is not None:
        return settle(Facts(cross(a.exact, b.exact), set(), set(), both(a.query, b.query)))
    a_starts, a_ends = (a.exact, a.exact) if a.exact is not None else (a.starts, a.ends)
    b_starts, b_ends = (b.exact, b.exact) if b.exact is not None else (b.starts, b.ends)
    query = combine("and", [a.query, b.query, needs(cross(a_ends, b_starts)), needs(a_starts) if a.exact is None else True, needs(b_ends) if b.exact is None else True])
    return settle(Facts(None, cross(a.exact, b_starts) if a.exact is not None else a_starts, cross(a_ends, b.exact) if b.exact is not None else b_ends, query))


def either(options: list[Facts]) -> Facts:
    if all(f.exact is not None for f in options):
        return settle(Facts(set().union(*[f.exact for f in options]), set(), set(), combine("or", [f.query for f in options])))
    own = lambda f: both(f.query, needs(f.exact)) if f.exact is not None else combine("and", [f.query, needs(f.starts), needs(f.ends)])
    pick = lambda f, side: f.exact if f.exact is not None else side
    return settle(Facts(None, set().union(*[pick(f, f.starts) for f in options]), set().union(*[pick(f, f.ends) for f in options]), combine("or", [own(f) for f in options])))


def analyse(tree) -> Facts:
    out = Facts({b""}, set(), set())
    for kind, arg in tree:
        if kind is op.LITERAL:
            f = Facts({bytes([arg]).lower()}, set(), set())
        elif kind is op.IN:
            chars: set[int] | None = set()
            for sort, x in arg:
                if sort is op.LITERAL:
                    chars.add(x)
                elif sort is op.RANGE:
                    chars |= set(range(x[0], x[1] + 1))
                else:
                    chars = None
                    break
            folded = {bytes([c]).lower() for c in chars} if chars is not None else set()
            f = Facts(folded, set(), set()) if 0 < len(folded) <= MOST_CLASS else ANY
        elif kind is op.SUBPATTERN:
            f = analyse(arg[3])
        elif kind is op.BRANCH:
            f = either([analyse(x) for x in arg[1]])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = arg
            one = analyse(inner)
            if low == 0:
                f = either([one, Facts({b""}, set(), set())]) if high == 1 else ANY
            else:
                f = one
                for _ in range(min(low, 8) - 1):
                    f = follow(f, one)
                if not low == high <= 8:
                    f = follow(f, ANY)
        elif kind is op.AT:
            continue
        else:
            f = ANY
        out = follow(out, f)
    return out


def trigram_query(pattern: bytes):
    f = analyse(parser.parse(pattern))
    own = needs(f.exact) if f.exact is not None else both(needs(f.starts), needs(f.ends))
    return both(f.query, own)


def trigrams_in(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_in, query[1]))


def answer(query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Which of n documents satisfy the query."""
    if query is True:
        return np.ones(n, bool)
    if isinstance(query, bytes):
        return postings[query]
    parts = [answer(q, postings, n) for q in query[1]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = sorted(set().union(*map(trigrams_in, self.queries)))
        self.search = [re.compile(r.pattern, r.flags) for r in rules]
        self.slot: np.ndarray | None = None

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        if self.slot is None:
            self.slot = np.zeros(1 << 24, np.uint8)
            for k, t in enumerate(self.wanted):
                self.slot[int.from_bytes(t, "big")] = k + 1
        marks = np.zeros((len(self.wanted), len(texts)), bool)
        data = np.frombuffer(b"\n\n".join(texts).lower() + b"\n\n\n", np.uint8)
        code = data[:-2].astype(np.int32) << 8
        code |= data[1:-1]
        code <<= 8
        code |= data[2:]
        which = self.slot[code]
        at = np.flatnonzero(which)
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        marks[which[at] - 1, np.searchsorted(starts, at, side="right") - 1] = True
        return dict(zip(self.wanted, marks))

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start byte, number of the rule, end byte), in order."""
        postings = self.postings(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, query, search) in enumerate(zip(self.rules, self.queries, self.search)):
            for k in np.flatnonzero(answer(query, postings, len(texts))).tolist():
                found[k] += [(m.start(), number, m.end()) for m in search.finditer(texts[k]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(x) for x in found]


def code_points(text: bytes, offsets: list[int]) -> dict[int, int]:
    out, last, count = {}, 0, 0
    for at in sorted(set(offsets)):
        count += len(text[last:at].decode("utf-8", "replace"))
        out[at], last = count, at
    return out


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), one row a document."""
    scanner = Scanner(rules)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, out = text_bytes(batch.column(1)), []
            for text, spans in zip(texts, scanner.scan(texts)):
                place = code_points(text, [x for s, _, e in spans for x in (s, e)])
                out.append([{"kind": scanner.rules[k].kind, "start": place[s], "end": place[e]} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kind))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def report(docs: DataFrame) -> DataFrame:
    found = scan_documents(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = line(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *map(count, BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))
