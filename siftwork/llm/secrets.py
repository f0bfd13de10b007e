"""Secret scans through a trigram inverted index.

Every rule's regex gives a Boolean query over trigrams: what any match must contain. A segment of documents (an Arrow
batch of bounded size) gets an inverted index from the trigrams that queries ask for to its documents; a rule's query is
evaluated on the postings, and its regex verifies the documents that are left. A rule whose regex has no mandatory
trigram scans every document of the segment. Segments are independent, so there is no shuffle and no size limit.

Null and empty texts have no spans. Rows repeat as they come; offsets are code points, ends exclusive; other columns
are ignored by scan() and kept by redact(). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm._shared import _LOWER, buffer_of, mapped, only, sliced

ALL = ("all",)
#: A run of alternatives beyond this many strings is closed and started anew.
WIDEST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and what a match must also satisfy."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def spans(self, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}"),
    Rule("huggingface", r"hf_[A-Za-z0-9]{30,}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{50,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,12}://[A-Za-z0-9_.~%+-]{1,64}:[A-Za-z0-9_.~%+!-]{3,64}@"),
)


def conj(*qs):
    parts = {p for q in qs for p in (q[1] if q[0] == "and" else {q}) if p != ALL}
    return ALL if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def disj(*qs):
    parts = {p for q in qs for p in (q[1] if q[0] == "or" else {q})}
    return ALL if ALL in parts else next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _of_strings(strings: frozenset[str]):
    """What a text that contains one of these strings contains."""
    each = []
    for s in strings:
        b = s.encode()
        each.append(conj(*[("tri", b[i : i + 3]) for i in range(len(b) - 2)]))
    return disj(*each)


def _exact(op, arg) -> frozenset[str] | None:
    """The strings that a node matches, in lower case, if they are few."""
    if op is C.LITERAL:
        return frozenset({chr(arg).lower() if arg < 128 else chr(arg)})
    if op is C.IN:
        out = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower() if x < 128 else chr(x))
            elif kind is C.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() if c < 128 else chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return frozenset(out) if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])[0]
    if op is C.BRANCH:
        each = [_sequence(x)[0] for x in arg[1]]
        return None if None in each else frozenset().union(*each)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, item = arg
        one = _sequence(item)[0]
        if one is None or high is C.MAXREPEAT or int(high) > 3:
            return None
        out, run = set(), frozenset({""})
        for k in range(int(high) + 1):
            if k >= low:
                out |= run
            run = frozenset(a + b for a in run for b in one)
        return frozenset(out)
    return None


def _node(op, arg):
    """What any match of a node that isn't one of few strings contains."""
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])[1]
    if op is C.BRANCH:
        return disj(*[_sequence(x)[1] for x in arg[1]])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
        one = _sequence(arg[2])[0]
        return _sequence(arg[2])[1] if one is None else _of_strings(frozenset(s * arg[0] for s in one))
    return ALL


def _sequence(nodes):
    """The strings that a sequence matches, if few, and its query."""
    query, run, whole = ALL, frozenset({""}), True
    for op, arg in nodes:
        strings = _exact(op, arg)
        if strings is not None and len(run) * len(strings) <= WIDEST:
            run = frozenset(a + b for a in run for b in strings)
            continue
        query, whole = conj(query, _of_strings(run)), False
        if strings is not None:
            run = strings
        else:
            query, run = conj(query, _node(op, arg)), frozenset({""})
    return (run if whole else None), conj(query, _of_strings(run))


def trigram_query(pattern: str):
    """The Boolean query of a regex over lower-case trigrams: ("all",), ("tri", bytes), ("and", set) or ("or", set)."""
    return _sequence(_parser.parse(pattern, re.ASCII))[1]


def _trigrams(query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*map(_trigrams, query[1])) if len(query) > 1 else set()


class Index:
    """Postings of one segment for the trigrams asked for: sorted row numbers by trigram."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, asked: list[bytes]):
        self.rows = len(at) - 1
        self.postings = {t: np.zeros(0, np.int64) for t in asked}
        codes = np.array(sorted(int.from_bytes(t, "big") for t in asked), np.int64)
        if len(raw) < 3 or not len(codes):
            return
        low = _LOWER[raw]
        code = (low[:-2].astype(np.int32) << 16) | (low[1:-1].astype(np.int32) << 8) | low[2:]
        sieve = np.zeros(1 << 15, bool)
        sieve[codes % 32749] = True
        spot = np.flatnonzero(sieve[code % np.int32(32749)])
        found = np.searchsorted(codes, code[spot])
        hit = codes[np.minimum(found, len(codes) - 1)] == code[spot]
        spot, found = spot[hit], found[hit]
        row = np.searchsorted(at, spot, "right") - 1
        inside = spot + 3 <= at[row + 1]
        pairs = np.unique(found[inside] * np.int64(self.rows + 1) + row[inside])
        for k in range(len(codes)):
            a, b = np.searchsorted(pairs, [k * (self.rows + 1), (k + 1) * (self.rows + 1)])
            self.postings[int(codes[k]).to_bytes(3, "big")] = pairs[a:b] - k * (self.rows + 1)

    def rows_of(self, query) -> np.ndarray:
        if query[0] == "all":
            return np.arange(self.rows)
        if query[0] == "tri":
            return self.postings[query[1]]
        parts = sorted((self.rows_of(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def scanner(rules: tuple[Rule, ...]) -> Callable[[pa.Array], dict[int, list[tuple[int, int, int]]]]:
    """A function from a text column to the spans (start, number of the rule, end) of the rows that have any."""
    plans = [(k, r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for k, r in enumerate(rules)]
    asked = sorted(set().union(*[_trigrams(q) for _, _, _, q in plans]))

    def scan_column(texts: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
        raw, at = buffer_of(texts)
        index = Index(raw, at, asked)
        whole = raw.tobytes()
        out: dict[int, list[tuple[int, int, int]]] = {}
        for k, rule, regex, query in plans:
            for row in index.rows_of(query).tolist():
                text = whole[at[row] : at[row + 1]].decode()
                if spans := rule.spans(regex, text):
                    out.setdefault(row, []).extend((a, k, b) for a, b in spans)
        for spans in out.values():
            spans.sort()
        return out

    return scan_column


def scan(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: its id and spans, an array of (kind, start, end) by start, then by rule."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = scanner(rules)(b.column(1))
        spans = [[{"kind": rules[k].kind, "start": a, "end": e} for a, k, e in found.get(i, ())] for i in range(b.num_rows)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["id", "spans"])

    source = only(df, id_col, text_col, text=text_col)
    return mapped(source, run, f"id {source.schema[0].dataType.simpleString()}, spans array<struct<kind: string, start: int, end: int>>").withColumnRenamed("id", id_col)


def redact(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every secret's span replaced by mark; spans that overlap are replaced as one. Null texts stay null."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        k = b.schema.get_field_index(text_col)
        found = scanner(rules)(b.column(k))
        if not found:
            return b
        texts = b.column(k).to_pylist()
        for row, spans in found.items():
            text, out, last = texts[row], [], 0
            for a, _, e in spans:
                if a >= last:
                    out += [text[last:a], mark]
                last = max(last, e)
            texts[row] = "".join(out) + text[last:]
        return b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))

    return df.mapInArrow(lambda batches: (run(b) for b in sliced(batches)), df.schema)


def digest(df: DataFrame) -> DataFrame:
    """The columns of query op1."""
    kinds = [r.kind for r in BASE]
    of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(df).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(of(base), 256).alias("base_sha256"),
        of(F.col("spans")).alias("spans"),
    )


def brute(text: str | None, rules: tuple[Rule, ...] = BASE + MORE) -> tuple:
    """What digest() gives for one text, without an index."""
    spans = sorted((a, k, e) for k, r in enumerate(rules) for a, e in r.spans(re.compile(r.pattern, re.ASCII), text or ""))
    said = [(rules[k].kind, f"{rules[k].kind}:{a}:{e}") for a, k, e in spans]
    kinds = [r.kind for r in BASE]
    return (*[sum(k == x for k, _ in said) for x in kinds], hashlib.sha256(",".join(s for k, s in said if k in kinds).encode()).hexdigest(), ",".join(s for _, s in said))
