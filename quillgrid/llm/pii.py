r"""Operator 4 [native]: personal data by weak supervision.

Candidate spans come from the base kinds' expressions, matches that fail their condition included, and from
wider ones. Labelers vote on each: its kind's rule (regex), lists of domains, prefixes and codes
(gazetteer), words before it (context), and the characters around it (boundary). Expectation-maximisation over
the counts of all vote patterns estimates each labeler's reliability by class and each kind's share; the
posteriors then train a logistic span classifier on kind, votes and length. Base spans always stay; a
further candidate is added if the classifier takes it and it doesn't overlap a base span.

Only counts by pattern, a bounded table, reach the driver; texts aren't shuffled. Expressions are written
without backtracking or recursion over long runs, and match what the contract's plain ones match. Positions are
code points, ends exclusive; they are added up in runs, so that many matches in a text cost little more than few.

Results: null and empty texts have no spans; rows come back one for one, so repeated rows and null ids stay;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, two_columns


class Kind(NamedTuple):
    """A kind of candidate: its expression, the words that announce it, the expression of what its gazetteer knows, and
    what every text with a match holds (cheaper to look for)."""

    name: str
    pattern: str
    context: str
    known: str
    holds: str


_LOCAL = r"[A-Za-z0-9._%+-]"
#: Lists of labelers (fixed values): top-level domains, card prefixes, calling codes, country codes, titles and announcing words.
BASE = (
    # a run of the local part is entered at its start, or where the last match ended
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"e-?mail|contact|write to|courriel|correo", r"\.(com|org|net|edu|gov|io|de|fr|es|uk)$", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"\bip\b|host|server|address|adresse", r"^(?!0|127|22[4-9]|2[3-9])", r"[0-9]\.[0-9]+\."),
    # shorter runs would be dropped; from a run's start all of it is taken
    Kind("card", r"[0-9](?:[ -]?[0-9]){13,}+", r"card|visa|carte|karte|tarjeta|credit", r"^(4|5[1-5]|3[47]|6011|65)", r"[0-9](?:[ -]?[0-9]){13}"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"phone|call|tel|mobile|fax", r"^\+(1|33|34|44|49|39|7|81|86|91)", r"\+[0-9]"),
)
MORE = (
    Kind("local", r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"phone|call|tel|mobile|fax", r"^\(?[2-9]", r"[0-9]{3}[ .-][0-9]{4}"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"ssn|social|insurance", r"^(?!000|666|9)", r"[0-9]-[0-9]{2}-[0-9]"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])", r"iban|account|konto|compte|cuenta", r"^(DE|FR|ES|GB|IT|NL|BE|AT|CH|PT)", r"[A-Z]{2}[0-9]{2}"),
    Kind("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+", r"dear|name|contact|signed", r"^(Mr|Mrs|Ms|Dr|Prof)", r"(?:Mr|Mrs|Ms|Dr|Prof)\. "),
)
KINDS = BASE + MORE
LABELERS = ("rule", "gazetteer", "context", "boundary")
ABSTAIN = 2
#: Code points before a candidate that are read for context; steps of the fits.
BEFORE, EM_STEPS, FIT_STEPS = 40, 60, 300


#: Matches whose positions are added up in one run; of more, so many runs as each has matches.
RUN = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression that uses a value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(items: Column) -> Column:
    """An array cut into about as many runs as each is long; none is empty."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / size).cast("int")), lambda k: F.slice(items, k * size + 1, size))
    return F.filter(cut, lambda run: F.size(run) > 0)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, match, before, after>>: positions from the lengths of what lies between matches; before: the
    BEFORE code points ahead of a match, as far back as the match before; after: the one that follows."""
    kind = "array<struct<start: bigint, match: string, before: string, after: string>>"
    none = F.expr(f"cast(array() as {kind})")

    def step(state: Column, z: Column) -> Column:
        at = state["at"] + F.length(z["b"])
        one = F.struct(at.alias("start"), z["m"].alias("match"), F.lower(F.substring(z["b"], -BEFORE, BEFORE)).alias("before"), F.substring(z["a"], 1, 1).alias("after"))
        return F.struct((at + F.length(z["m"])).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def placed(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def width(run: Column) -> Column:
        return F.aggregate(run, F.lit(0).cast("long"), lambda n, z: n + F.length(z["b"]) + F.length(z["m"]))

    def begins(runs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(runs, start, lambda s, run: F.struct((s["at"] + width(run)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def positions(pairs: Column) -> Column:
        many = _let(_runs(pairs), lambda runs: F.flatten(F.zip_with(runs, begins(runs), placed)))
        return F.when(F.size(pairs) <= RUN, placed(pairs, F.lit(0).cast("long"))).otherwise(many)

    def paired(between: Column) -> Column:
        found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), between, lambda m, b: F.struct(m.alias("m"), b.alias("b")))
        return F.filter(F.zip_with(found, F.slice(between, 2, F.size(between)), lambda x, a: F.struct(x["m"].alias("m"), x["b"].alias("b"), a.alias("a"))), lambda x: x["m"].isNotNull())

    return _let(_let(F.split(text, pattern, -1), paired), positions)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is a multiple of ten."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, (n - k).cast("int"), F.lit(1)).cast("int")
        return total + F.when(k % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _rule(kind: str, match: Column) -> Column:
    """The condition of a base kind; of the others, a check of their own."""
    digits = _digits(match)
    if kind == "ip":
        part = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34)
    return F.lit(True)


def _vote(yes: Column, no: int) -> Column:
    return F.when(yes, 1).otherwise(no)


def _judge(k: int) -> Callable[[Column], Column]:
    """Makes of a match of kind k its struct<start, kind, end, base, code>."""
    kind = KINDS[k]

    def judged(c: Column) -> Column:
        match, start = c["match"], c["start"]
        ok = _rule(kind.name, match)
        around = F.concat(F.substring(c["before"], -1, 1), F.lit(" "), c["after"])
        votes = (_vote(ok, 0), _vote(match.rlike(kind.known), 0), _vote(c["before"].rlike(kind.context), ABSTAIN), _vote(~around.rlike("[A-Za-z0-9_@]"), 0))
        code = F.lit(k)
        for v in votes:
            code = code * 3 + v
        code = code * 4 + F.least(F.floor(F.length(match) / 8), F.lit(3)).cast("int")
        return F.struct(start.alias("start"), F.lit(k).alias("kind"), (start + F.length(match)).alias("end"), (ok & F.lit(k < len(BASE))).alias("base"), code.alias("code"))

    return judged


def _candidates(text: Column) -> Column:
    """array<struct<start, kind, end, base, code>>; code: the votes and the length's class as one number.

    A kind is looked for in texts that hold what its matches hold; those with digits, in texts with digits."""

    def found(k: int) -> Column:
        return F.when(text.rlike(KINDS[k].holds), F.transform(_matches(text, KINDS[k].pattern), _judge(k))).otherwise(none)

    none = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint, base: boolean, code: int>>)")
    plain = [k for k, kind in enumerate(KINDS) if kind.name in ("email", "name")]
    digits = [k for k in range(len(KINDS)) if k not in plain]
    return F.array_sort(F.concat(*map(found, plain), F.when(text.rlike("[0-9]"), F.concat(*map(found, digits))).otherwise(none)))


def _decode(code: int) -> tuple[int, tuple[int, ...], int]:
    """(kind, votes, class of length) of a code."""
    code, size = divmod(code, 4)
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v)
    return code, tuple(votes[::-1]), size


def reliabilities(counts: dict[int, int]) -> tuple[dict[int, float], dict[str, tuple[list[float], list[float]]], dict[int, float]]:
    """Expectation-maximisation over counts by pattern: (share of true candidates by kind; by labeler the chances of its
    votes for true and for false candidates; the posterior of each pattern). Votes are independent given the class."""
    rows = [(code, *_decode(code)[:2], n) for code, n in sorted(counts.items())]
    prior = {k: 0.7 for _, k, _, _ in rows}
    vote = {name: ([0.2, 0.6, 0.2], [0.6, 0.2, 0.2]) for name in LABELERS}
    posterior: dict[int, float] = {}
    for _ in range(EM_STEPS):
        for code, k, votes, _ in rows:
            yes, no = math.log(prior[k]), math.log(1 - prior[k])
            for name, v in zip(LABELERS, votes, strict=True):
                yes, no = yes + math.log(vote[name][0][v]), no + math.log(vote[name][1][v])
            posterior[code] = 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))
        # smoothed by a few candidates of each sort
        true, false, every = ({k: 3.0 for k in prior}, {n: [1.0, 3.0, 1.0] for n in LABELERS}, {k: 4.0 for k in prior})
        wrong = {n: [3.0, 1.0, 1.0] for n in LABELERS}
        for code, k, votes, n in rows:
            p = posterior[code]
            true[k] += n * p
            every[k] += n
            for name, v in zip(LABELERS, votes, strict=True):
                false[name][v] += n * p
                wrong[name][v] += n * (1 - p)
        prior = {k: min(0.999, max(0.001, true[k] / every[k])) for k in prior}
        vote = {name: ([x / sum(false[name]) for x in false[name]], [x / sum(wrong[name]) for x in wrong[name]]) for name in LABELERS}
    return prior, vote, posterior


def _features(code: int) -> list[int]:
    """Places of the features that are on: constant, kind, votes, length."""
    k, votes, size = _decode(code)
    return [0, 1 + k, *(1 + len(KINDS) + 3 * n + v for n, v in enumerate(votes)), 1 + len(KINDS) + 3 * len(LABELERS) + size]


def classifier(counts: dict[int, int], posterior: dict[int, float]) -> list[int]:
    """The patterns that a logistic span classifier, trained on the posteriors, takes for personal data."""
    size = 1 + len(KINDS) + 3 * len(LABELERS) + 4
    weights, total = [0.0] * size, sum(counts.values()) or 1
    on = {code: _features(code) for code in counts}
    for _ in range(FIT_STEPS):
        slope, bend = [1e-4 * w for w in weights], [1e-3] * size
        for code, n in counts.items():
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(weights[f] for f in on[code])))))
            for f in on[code]:
                slope[f] += n / total * (p - posterior[code])
                bend[f] += n / total * p * (1 - p) * len(on[code])
        weights = [w - s / b for w, s, b in zip(weights, slope, bend, strict=True)]
    return [code for code in sorted(counts) if sum(weights[f] for f in on[code]) >= 0]


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end, base>>) of every row, by start and order of kinds."""
    docs = two_columns(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    found = stored(docs.select("doc_id", _candidates(F.col("text")).alias("found")))
    patterns = found.select(F.explode("found.code").alias("code")).groupBy("code").count()  # kinds * 3^4 * 4 rows at most
    counts = {r[0]: r[1] for r in patterns.collect()}
    taken = classifier(counts, reliabilities(counts)[2])
    # base spans in runs with bounds, so that a candidate is held against few of them
    runs = F.transform(
        _let(F.filter("found", lambda c: c["base"]), _runs),
        lambda run: F.struct(F.get(run, F.lit(0))["start"].alias("low"), F.array_max(F.transform(run, lambda b: b["end"])).alias("high"), run.alias("spans")),
    )

    def meets(runs: Column, c: Column) -> Column:
        def overlaps(b: Column) -> Column:
            return (b["start"] < c["end"]) & (c["start"] < b["end"])

        return F.exists(runs, lambda r: (r["low"] < c["end"]) & (c["start"] < r["high"]) & F.exists(r["spans"], overlaps))

    def added(c: Column) -> Column:
        return c["code"].isin(*taken) if taken else F.lit(False)

    spans = _let(runs, lambda runs: F.filter("found", lambda c: c["base"] | (added(c) & ~meets(runs, c))))
    return found.select("doc_id", F.transform(spans, lambda c: F.struct(*(c[n].alias(n) for n in ("start", "kind", "end", "base")))).alias("spans"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k.name) for k in KINDS))

    def text(found: Column) -> Column:
        return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{BASE[k].name}")

    return spans.select("doc_id", *map(count, range(len(BASE))), F.sha2(text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


QUERIES = {"op4_personal_data": op4_personal_data}
ORACLES: dict[str, str] = {}
