"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they stand. Weak parts (an account name, a random-looking string, a host)
mean little alone. Around each secret, weak or strong, lies a scope: ``reach`` characters either way within its
paragraph. An interval join of the scopes with the identifiers and endpoints, both sorted by place, finds the
parts that co-occur; weak parts are reported only from such joins. The join runs within a text, by bisection, so
its work follows the parts in reach and no pairs between documents arise.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import columns_for, rows_mapped

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the same as longer runs of [0-9a-f]+
_IDENTIFIER = re.compile(r"""(?:user(?:[_-]?name|[_-]?id)?|login|account(?:[_-]?(?:name|id))?|client[_-]?id|access[_-]?key(?:[_-]?id)?|key[_-]?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.A | re.I)  # also behind a prefix: DB_USER, dbUser, PGUSER
_ENDPOINT = re.compile(r"(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?)://[^\s\"'<>]+|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?(?![\w.]*\d)|(?<![\w.-])(?:[a-z0-9-]+\.)+(?:(?:com|net|org|io|dev|cloud|internal|local)(?::\d{2,5})?\b|[a-z][a-z0-9-]+:\d{2,5}\b)", re.A | re.I)  # other dotted names count as hosts with a port
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_PARAGRAPH = re.compile(r"\n\s*\n")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong patterns: leftmost matches per kind that don't overlap, too short ones dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def random_looking(s: str, bits: float = 3.5) -> bool:
    """Letters of either case or digits mixed, with at least ``bits`` of entropy a character."""
    kinds = bool(re.search("[a-z]", s)) + bool(re.search("[A-Z]", s)) + bool(re.search("[0-9]", s))
    n = len(s)
    return kinds >= 2 and bool(re.search("[0-9]", s)) and -sum(c / n * math.log2(c / n) for c in Counter(s).values()) >= bits


Span = tuple[str, int, int]


def linked(text: str, base: list[Span], reach: int) -> list[tuple[Span, Span]]:
    """(secret, complementary part) for each part in a secret's scope: the interval join of scopes and parts."""
    names = [("identifier", *m.span()) for m in _IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    hosts = [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)] if "." in text or "://" in text else []
    known = [(s, e) for k, s, e in base if k == "access"]
    if not (names or hosts or known):
        return []
    strong = sorted((s, e, k) for k, s, e in base if k != "access")
    heads, ends = [s for s, _, _ in strong], [e for _, e, _ in strong]
    top: list[int] = []  # furthest end so far: assignments and hex runs may overlap
    for e in ends:
        top.append(max(e, top[-1]) if top else e)
    covers = lambda s, e: (i := bisect_left(heads, e)) and top[i - 1] > s
    weak = [m.span() for m in _SECRET.finditer(text) if random_looking(m[0]) and not covers(*m.span())]
    taken = {(s, e) for s, e in known} | {(s, e) for _, s, e in names + hosts}
    weak = [x for x in weak if x not in taken]
    if not (strong or weak):
        return []
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)]
    # Parts of a kind don't overlap, so that both their starts and their ends ascend.
    apart = [(kind, [(s, e) for _, s, e in spans if not covers(s, e)]) for kind, spans in (("identifier", names), ("endpoint", hosts))] + [("access", sorted(known))]
    parts = [(kind, spans, [s for s, _ in spans], [e for _, e in spans]) for kind, spans in apart]
    found: list[tuple[Span, Span]] = []
    for s, e, of in [*strong, *((s, e, "secret") for s, e in weak)]:
        i = bisect_right(breaks, s)
        lo = max(s - reach, breaks[i - 1] if i else 0)
        hi = min(e + reach, breaks[i] if i < len(breaks) else len(text))
        for kind, places, starts, stops in parts:
            found += [((of, s, e), (kind, ps, pe)) for ps, pe in places[bisect_right(stops, lo) : bisect_left(starts, hi)] if not (ps < e and pe > s)]
    return found


def linked_spans(text: str, base: list[Span], reach: int) -> list[Span]:
    """Weak parts with a complementary part in scope."""
    return [x for x in {x for pair in linked(text, base, reach) for x in pair} if x[0] in ("identifier", "secret", "endpoint")]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def numbers(spans: list[Span], pairs: list[tuple[Span, Span]]) -> list[int]:
    """The number of each span's credential, counted from 1 by first place: parts that links connect are one
    credential; a span without links has 0."""
    up = {x: x for pair in pairs for x in pair}

    def top(x: Span) -> Span:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    seen: dict[Span, int] = {}
    return [seen.setdefault(top(x), len(seen) + 1) if x in up else 0 for x in spans]


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered(spans))


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, links string"


def scan(docs: DataFrame, reach: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and places of strong patterns, all spans with the linked weak parts, and ``links``,
    the number of each span's credential in the same order (0: linked with nothing).

    Places are code points, ends exclusive. Null and empty texts have no spans; repeated rows are each scanned,
    null keys kept, an empty table gives no rows, other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                t = value.as_py() or ""
                base = base_spans(t)
                pairs = linked(t, base, reach)
                more = {x for pair in pairs for x in pair} - set(base)
                every = ordered([*base, *more])
                n = Counter(k for k, _, _ in base)
                for o, v in zip(out, (n["assign"], n["access"], n["hex"], hashlib.sha256(digest_of(base).encode()).hexdigest(), digest_of(every), len(more), ",".join(map(str, numbers(every, pairs)))), strict=True):
                    o.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=[x.split()[0] for x in SCAN.split(", ")])

    return columns_for(docs, k=key, t=text).mapInArrow(run, SCAN)


def redacted(docs: DataFrame, reach: int = 200, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """The documents with every reported span replaced by ``mark`` (overlapping spans as one); all columns stay."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for value in batch.column(at):
                t = value.as_py()
                if t:
                    base = base_spans(t)
                    parts, end = [], 0
                    for s, e in sorted((s, e) for _, s, e in base + linked_spans(t, base, reach)):
                        if s >= end:
                            parts += [t[end:s], mark]
                        end = max(end, e)
                    t = "".join(parts) + t[end:]
                new.append(t)
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows_mapped(docs, run)
