r"""Operator 3: secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what
any match must contain. Blocks of texts are indexed by trigram (ASCII letters
folded), postings are intersected and united as the query says, and only the
candidates are verified with the expression itself. A rule without mandatory
trigrams, as a run of hexadecimal digits, scans every text fully.

A kind's matches are leftmost and don't overlap; a match that fails the rule's
condition is dropped and not retried. Positions are code points, ends exclusive.

Results: null and empty texts have no spans; rows come back one for one, so repeated
rows and null ids stay; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_workers, slices, table, two_columns, worker_state


class Rule(NamedTuple):
    """A kind of secret: its expression, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _cases(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_cases, ("password", "passwd", "secret", "token"))) + f"|{_cases('api')}_?{_cases('key')}"
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Publicly documented credential formats (fixed values).
MORE = (
    Rule("github", r"gh[opusr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/=-]+", 0, 27),
)
RULES = BASE + MORE

Query = bool | str | tuple


# -- from a regular expression to a Boolean query -----------------------------------


def _both(a: Query, b: Query) -> Query:
    return b if a is True else a if b is True else ("and", a, b)


def _string(s: str) -> Query:
    """All trigrams of a string."""
    q: Query = True
    for k in range(len(s) - 2):
        q = _both(q, s[k : k + 3])
    return q


def _strings(found: set[str]) -> Query:
    """One of several strings."""
    each = [_string(s) for s in sorted(found)]
    return True if any(q is True for q in each) else each[0] if len(each) == 1 else ("or", *each)


#: Strings that a part is spelled out to, and characters of a class; beyond, a part isn't exact.
SPELL, CLASS = 64, 8
#: Escapes that match nothing but a place.
_PLACES = "bBAZ"


class _Parser:
    """Reads the part of regular expressions that rules use into nodes: a set of characters (None: any), ("seq", nodes), ("alt", nodes),
    ("repeat", least, most, node). What it doesn't know it takes for anything, which a query allows for."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def _next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def choice(self):
        branches = [[]]
        while (c := self._peek()) and c != ")":
            if c == "|":
                self.at += 1
                branches.append([])
            else:
                branches[-1].append(self._quantified(self._item()))
        each = [("seq", b) for b in branches]
        return each[0] if len(each) == 1 else ("alt", each)

    def _item(self):
        c = self._next()
        if c == "(":
            return self._group()
        if c == "[":
            return self._set()
        if c == "\\":
            return self._escape()
        if c in "^$":
            return ("seq", [])
        return None if c == "." else {c.lower()}

    def _group(self):
        known = True
        if self._peek() == "?":
            if self.text.startswith("?:", self.at):
                self.at += 2
            elif name := re.compile(r"\?P<\w+>").match(self.text, self.at):
                self.at = name.end()
            else:  # looks around, flags, references
                known = False
                self.at = re.compile(r"\?[^)]*?[:=!>)]|\?").match(self.text, self.at).end()
        inner = self.choice()
        self.at += 1
        return inner if known else None

    def _escape(self):
        c = self._next()
        if c == "x":
            self.at += 2
            return {chr(int(self.text[self.at - 2 : self.at], 16)).lower()}
        if c in _PLACES:
            return ("seq", [])
        return None if c.isalnum() else {c}

    def _set(self):
        found, known = set(), True
        if self._peek() == "^":
            known = False
            self.at += 1
        first = True
        while first or self._peek() != "]":
            c, first = self._next(), False
            own = self._escape() if c == "\\" else {c.lower()}
            if not isinstance(own, set):
                known = False
            elif self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                d = self._next()
                high = min(self._escape() or {"\uffff"}) if d == "\\" else d
                low = min(own) if c == "\\" else c
                found |= {chr(k).lower() for k in range(ord(low), min(ord(high), ord(low) + SPELL) + 1)}
                known &= ord(high) - ord(low) < SPELL
            else:
                found |= own
        self.at += 1
        return found if known and len(found) <= CLASS else None

    def _quantified(self, node):
        while m := re.compile(r"([*+?]|\{(\d*)(,?)(\d*)\})").match(self.text, self.at):
            self.at = m.end()
            if self._peek() and self._peek() in "?+":  # lazy or possessive
                self.at += 1
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(m[1], (0, None))
            if m[1][0] == "{":
                low = int(m[2] or 0)
                high = (int(m[4]) if m[4] else None) if m[3] else low
            node = ("repeat", low, high, node)
        return node


def _analyse(nodes) -> tuple[set[str] | None, Query]:
    """(the strings a sequence can be, if they are few; what any match contains)."""
    run, query, exact = {""}, True, True
    for node in nodes:
        own: set[str] | None = node if isinstance(node, set) else None
        inner: Query = True
        kind = node[0] if isinstance(node, tuple) else None
        if kind == "seq":
            own, inner = _analyse(node[1])
        elif kind == "alt":
            parts = [_analyse([x]) for x in node[1]]
            own = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
            queries = [q for _, q in parts]
            inner = True if any(q is True for q in queries) else ("or", *queries)
        elif kind == "repeat":
            low, high, body = node[1:]
            got, inner = _analyse([body])
            own = got | {""} if got is not None and (low, high) == (0, 1) else got if (low, high) == (1, 1) else None
            inner = inner if low else True
            if own is None and got is not None and low:
                inner = _strings(got)
        if own is not None and len(joined := {a + b for a, b in product(run, own)}) <= SPELL:
            run = joined
            continue
        query, exact, run = _both(_both(query, _strings(run)), inner if own is None else _strings(own)), False, {""}
    return (run, _strings(run)) if exact else (None, _both(query, _strings(run)))


def trigram_query(pattern: str) -> Query:
    """What any match of a pattern contains, in folded trigrams; True: nothing is mandatory."""
    return _analyse([_Parser(pattern).choice()])[1]


def _terms(q: Query) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(_terms, q[1:]))


# -- the index of a block of texts ---------------------------------------------------


class Index:
    """Postings of the wanted trigrams over a block of texts."""

    def __init__(self, texts: list[str], wanted: np.ndarray):
        blob = b"\0".join(raw := [t.encode() for t in texts]).lower() + b"\0\0"
        starts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
        at = np.frombuffer(blob, np.uint8).astype(np.uint32)
        code = (at[:-2] << 16) | (at[1:-1] << 8) | at[2:]
        hits = np.flatnonzero(wanted[code])
        pairs = np.unique(code[hits].astype(np.int64) << 32 | (np.searchsorted(starts, hits, "right") - 1))
        self.n, self.postings = len(texts), {}
        terms, first = np.unique(pairs >> 32, return_index=True)
        for term, docs in zip(terms.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:]), strict=False):
            self.postings[term] = docs

    def find(self, q: Query) -> np.ndarray:
        """The texts, by position, that a query admits."""
        if q is True:
            return np.arange(self.n)
        if isinstance(q, str):
            return self.postings.get(_code(q), np.empty(0, np.int64))
        each = [self.find(x) for x in q[1:]]
        if q[0] == "or":
            return np.unique(np.concatenate(each))
        found = each[0]
        for x in each[1:]:
            found = np.intersect1d(found, x, assume_unique=True)
        return found


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class Scanner:
    """Rules with their queries and compiled expressions."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[[_code(t) for q in self.queries for t in _terms(q)]] = True
        self.finders = [re.compile(self._verifier(r)).finditer for r in rules]

    @staticmethod
    def _verifier(r: Rule) -> str:
        """A run of one class takes all it can, so that of least length n is found by {n,} at once."""
        one = re.fullmatch(r"(\[[^\]]+\])\+", r.pattern)
        return f"{one[1]}{{{r.least},}}" if one and r.group == 0 and r.least else r.pattern

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end)."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return found
        index = Index(texts, self.wanted)
        for k, (rule, query, finder) in enumerate(zip(self.rules, self.queries, self.finders, strict=True)):
            for d in index.find(query).tolist():
                found[d] += [(m.start(), k, m.end()) for m in finder(texts[d]) if len(m[rule.group]) >= rule.least]
        for own in found:
            own.sort()
        return found


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return worker_state(("secrets", rules), lambda: Scanner(rules))


#: Texts that are indexed together.
BLOCK = 512


def scan_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (kind, start, end)) by start and order of the rules. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            for part in slices(batch, 1, BLOCK):
                found = scanner.spans([t or "" for t in part.column(1).to_pylist()])
                spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in own] for own in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return in_workers(two_columns(df, id_col, text_col), "secrets", run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


MASK = "[SECRET]"


def redact_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The same rows and columns; in their texts each stretch covered by spans becomes a mask, and the count of characters follows.

    Null texts stay null, texts without a secret stay as they are."""
    names = df.columns
    at, count = names.index(text_col), names.index(count_col) if count_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            for part in slices(batch, at, BLOCK):
                texts = part.column(at).to_pylist()
                found = scanner.spans([t or "" for t in texts])
                out = [_masked(t, own) if own else t for t, own in zip(texts, found, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(out, columns[at].type)
                if count is not None:
                    kept = columns[count].to_pylist()
                    columns[count] = pa.array([len(t) if own else n for t, own, n in zip(out, found, kept, strict=True)], columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return in_workers(df, "secrets", run, df.schema)


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]

    def text(found):
        return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, base), F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _sql() -> str:
    """Positions from the pieces between a kind's matches: DuckDB's expressions are leftmost and greedy in the same way."""
    made = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        made.append(
            f"SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0), 'w': length(m[i]), 'g': length(g[i])}})) AS x, {k} AS k, '{r.kind}' AS kind, {r.least} AS least"
            f" FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g FROM d WHERE regexp_matches(t, '{p}'))"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (" + " UNION ALL ".join(made) + "), "
        "f AS (SELECT doc_id, k, kind, CAST(x.s AS BIGINT) AS s, kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.w AS BIGINT) AS y FROM a WHERE x.g >= least), "
        "j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        "string_agg(y, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(y, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id) "
        "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)"
    )


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES = {"op3_secret_scan": _sql()}
