"""Operator 2: n-gram Jaccard join with rare-first prefix filtering.

Shingles are ordered rare first, by how often a sketch of fixed size has counted them in all documents beyond the
noise of its counters (in half octaves), then by hash. Two sets with Jaccard similarity of 0.8 or more share one of their first
n - ceil(0.8 n) + 1 shingles, so only these are shuffled. Length and positional filters thin the
candidates out, a suffix filter precedes the exact verification, and a pair is verified once.

A shingle's documents are not expanded into all pairs. They are dealt into parts, more of a frequent shingle. In each
the one that has the shingle foremost leads: it is paired with each of the others, and the foremost leader with
the other parts' leaders. When these pairs have been verified and linked documents joined into components, only documents of a shingle that are still in different components are paired, in blocks, and held against
each other by digests of their sets first.
So no link between components is lost. Texts of equal sets are one node from the start.

Results: null and empty texts have 0 shingles and link with nothing; a null id links with nothing and its
component is null; rows that share an id are one node and all come back; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_workers, numbered, slices, stored, table, two_columns, worker_state
from .components import components
from .shingles import mixed, shingle_sets

#: Similarity of 80 hundredths, in whole numbers.
PER_CENT = 80
#: Counters of the sketch, and of one of its pieces; most bits of the filter of candidates.
SKETCH, PIECE, MOST_BITS = 1 << 21, 1 << 16, 1 << 28
#: Texts hashed together; rows of a part or a block of a shingle's documents.
TEXTS, ROWS = 128, 2048

_LONG = pa.int64()


def _signature(s: np.ndarray) -> tuple[int, int]:
    a, b = (int(mixed(s, k).sum(dtype=np.uint64)) for k in (3, 4))
    return a - (1 << 63), b - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, 1, TEXTS):
            yield from zip(part.column(0).to_pylist(), shingle_sets([t or "" for t in part.column(1).to_pylist()]), strict=True)


def _summary(docs: DataFrame) -> DataFrame:
    """One scan: a row per document with its set's size and signature, and a task's counts of shingles, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("near duplicates",), dict)  # other operators' state goes
        counts, held, size = np.zeros(SKETCH, np.int64), [], 0
        few = SKETCH // 4
        rows: list[tuple] = []

        def rows_out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (_LONG, _LONG, _LONG, _LONG)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*made, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=["doc_id", "n", "s1", "s2", "piece", "counts"])

        for doc_id, s in _sets(batches):
            rows.append((doc_id, len(s), *_signature(s)))
            held.append(s)
            size += len(s)
            if size > few:
                counts += np.bincount((np.concatenate(held) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                held, size = [], 0
            if len(rows) == 4096:
                yield rows_out()
                rows.clear()
        yield rows_out()
        if size:
            counts += np.bincount((np.concatenate(held) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        if counts.any():
            pieces = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(-1, PIECE)]
            n = len(pieces)
            empty = [pa.nulls(n, _LONG)] * 4
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(n), pa.int32()), pa.array(pieces, pa.binary())], names=["doc_id", "n", "s1", "s2", "piece", "counts"])

    return in_workers(docs, "near duplicates", run, "doc_id long, n long, s1 long, s2 long, piece int, counts binary")


def _ranks(summary: DataFrame) -> tuple[bytes, float]:
    """For each counter of the sketch its rank: SKETCH bytes, whatever the input; and how many documents a unit of rank stands for.

    What shingles that meet by chance add to a counter is about the same for all: the median. A rank is what a counter
    has beyond it, in half octaves of the deviation, so that frequent shingles stand out at any size of the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, piece = np.zeros(PIECE, np.int64), None
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, piece = total + np.frombuffer(zlib.decompress(raw), np.int64), k
        if piece is not None:
            noise = float(np.median(total))
            unit = max(1.0, noise**0.5)
            rank = np.floor(np.log2(1 + np.maximum(total - noise, 0) / unit) * 2).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(rank.tobytes(), 1)]), pa.array([unit])], names=["piece", "ranks", "unit"])

    pieces = summary.filter("piece IS NOT NULL").select("piece", "counts").groupBy("piece").applyInArrow(lambda t: pa.Table.from_batches(list(add(iter(t.to_batches())))), "piece int, ranks binary, unit double")
    ranks, unit = np.zeros(SKETCH, np.uint8), 1.0
    for row in pieces.collect():
        ranks[row[0] * PIECE : (row[0] + 1) * PIECE] = np.frombuffer(zlib.decompress(bytes(row[1])), np.uint8)
        unit = max(unit, row[2])
    return ranks.tobytes(), unit


def _prefixes(docs: DataFrame, ranks: bytes, unit: float) -> DataFrame:
    """(key, doc, n, at, part): the rarest shingles of each document; a key's upper byte is its rank. Documents of a shingle that is
    as frequent as several times ROWS go to numbered parts, others to part 0. Of texts with equal sets a task sends the first."""
    small, most = zlib.compress(ranks, 6), ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(zlib.decompress(small), np.uint8).astype(np.uint64) << np.uint64(55)
        seen: set[tuple[int, int]] = set()
        keys, ids, sizes, places, held = [], [], [], [], 0

        def rows() -> pa.RecordBatch:
            key, doc = np.concatenate(keys), np.concatenate(ids)
            parts = np.ceil(unit * (np.exp2((key >> 55) / 2.0) - 1) / most).astype(np.uint64)
            part = np.where(parts > 1, 1 + mixed(doc.view(np.uint64)) % np.maximum(parts, 1), 0).astype(np.int32)
            return pa.RecordBatch.from_arrays(list(map(pa.array, (key, doc, np.concatenate(sizes), np.concatenate(places), part))), names=["key", "doc", "n", "at", "part"])

        for doc_id, s in _sets(batches):
            n = len(s)
            if doc_id is None or not n or (own := _signature(s)) in seen:
                continue
            seen.add(own)
            p = n - -(-PER_CENT * n // 100) + 1
            key = (rank[(s % np.uint64(SKETCH)).astype(np.int64)] | (s >> np.uint64(9))).astype(np.int64)
            key = np.sort(np.partition(key, p - 1)[:p]) if p < n else np.sort(key)
            keys.append(key)
            ids.append(np.full(p, doc_id, np.int64))
            sizes.append(np.full(p, n, np.int32))
            places.append(np.arange(p, dtype=np.int32))
            held += p
            if held > 50_000:
                yield rows()
                keys, ids, sizes, places, held = [], [], [], [], 0
        if held:
            yield rows()

    return in_workers(docs, "near duplicates", run, "key long, doc long, n int, at int, part int")


MEMBERS = "key long, doc long, n int, at int, lead long, lead_n int, lead_at int, more boolean"


def _members(dealt: DataFrame) -> DataFrame:
    """(key, doc, n, at, lead, lead_n, lead_at, more): each document of a part of a shingle's documents with the one of them that has it foremost;
    more is false for one that is surely the only other of a shingle. Leaders of numbered parts come out with themselves, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, n, at, part = (c.to_numpy() for c in batch.columns)
            same, many = (key[1:] == key[:-1]) & (part[1:] == part[:-1]), part > 0
            new = np.concatenate([[carried is None or carried[3] != key[0] or carried[4] != part[0]], ~same])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            rest = np.flatnonzero(~new | many)
            own = lead[rest]
            found = [x[own] for x in (doc, n, at)]
            if carried is not None:
                for x, old in zip(found, carried, strict=False):
                    x[own < 0] = old
            keep = (found[0] != doc[rest]) | new[rest]
            if keep.any():
                follows = np.concatenate([same, [True]])  # the next batch may go on
                more = (own < 0) | (rest - own > 1) | follows[rest] | many[rest]
                columns = [x[rest][keep] for x in (key, doc, n, at)] + [x[keep] for x in found] + [more[keep]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "doc", "n", "at", "lead", "lead_n", "lead_at", "more"])
            if lead[-1] >= 0:
                carried = (doc[lead[-1]], n[lead[-1]], at[lead[-1]], key[-1], part[-1])

    return in_workers(dealt.repartition("key", "part").sortWithinPartitions("key", "part", "at", "n", "doc"), "near duplicates", run, MEMBERS)


def _can_link(n, at, m, to):
    """Length and positional filters for sets of n and m that share a shingle at places at and to. Holds for a linked pair's foremost shared shingle."""
    fewer = F.least(n - at, m - to).cast("long")
    return (100 * F.least(n, m) >= PER_CENT * F.greatest(n, m)) & ((100 + PER_CENT) * fewer >= PER_CENT * (n + m))


def _pairs(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    return _compared(docs, pairs, lambda s: s.tobytes(), lambda x, y: _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))


def _thinned(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that may link, by digests of a sixteenth of the sets' size: none that links is lost."""
    return _compared(docs, pairs, _digest, _may_link)


def _compared(docs: DataFrame, pairs: DataFrame, encode: Callable[[np.ndarray], bytes], accept: Callable[[object, object], bool]) -> DataFrame:
    """The pairs (a, b) whose encoded sets are accepted. Only texts that occur in a pair, by a filter sized by their number, are hashed again and shuffled."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    bits = min(MOST_BITS, 1 << max(20, (16 * ends.count()).bit_length()))

    def place(doc: str):
        return F.pmod(F.xxhash64(doc), F.lit(bits))

    maps = ends.groupBy(F.bitmap_bucket_number(place("doc")).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("doc"))).alias("bits")).collect()  # bits / 8 bytes at most
    size = 32768 // 8
    flags = bytearray(bits // 8 + 2 * size)
    for row in maps:
        flags[row["k"] * size : (row["k"] + 1) * size] = bytes(row["bits"])
    small = zlib.compress(bytes(flags), 6)
    marked = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.bitmap_bucket_number(place("doc_id")).alias("k"), F.bitmap_bit_position(place("doc_id")).alias("p"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag = np.frombuffer(zlib.decompress(small), np.uint8)
        for batch in batches:
            k, p = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.flatnonzero((flag[k * size + p // 8] >> (p % 8).astype(np.uint8)) & 1)
            for part in slices(batch.take(pa.array(keep)), 1, TEXTS):
                found = [encode(s) for s in shingle_sets([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["doc", "s"])

    # sets are dealt by document once, then go with a pair; at any size, so never as a broadcast
    known = in_workers(marked, "near duplicates", sets, "doc long, s binary")
    first, second = (known.select(F.col("doc").alias(x), F.col("s").alias(f"s{x}")).hint("merge") for x in "ab")
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = batch.columns
            ok = [accept(sa[k].as_buffer(), sb[k].as_buffer()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok, pa.bool_())), b.filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return in_workers(joined, "near duplicates", verify, "a long, b long")


#: A digest's counts stop here, and stand for any number from here on.
FULL = 15


def _digest(s: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of as many ranges as half of it, about: its size, then four bits a range."""
    bits = max(1, (len(s) // 2).bit_length())
    counts = np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), FULL).astype(np.uint8)
    return len(s).to_bytes(8, "little") + (counts[0::2] | counts[1::2] << 4).tobytes()


def _counts(raw: np.ndarray) -> np.ndarray:
    out = np.empty(2 * len(raw), np.int64)
    out[0::2], out[1::2] = raw & 15, raw >> 4
    out[out == FULL] = 1 << 40
    return out


def _may_link(x, y) -> bool:
    """The suffix filter on digests: in no range do two sets share more than the smaller count, and the sum must reach what a link needs."""
    n, m = (int.from_bytes(bytes(raw[:8]), "little") for raw in (x, y))
    p, q = (_counts(np.frombuffer(raw, np.uint8, offset=8)) for raw in (x, y))
    if len(p) < len(q):
        p, q = q, p
    p = p.reshape(len(q), -1).sum(axis=1)
    return (100 + PER_CENT) * int(np.minimum(p, q).sum()) >= PER_CENT * (n + m)


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact decision; before it the suffix filter: between pivots the sets share no more than the smaller part."""
    need = -(-PER_CENT * (len(x) + len(y)) // (100 + PER_CENT))
    if min(len(x), len(y)) < need or not need:
        return False
    cuts = np.linspace(0, len(x), 17).astype(int)
    inner = x[cuts[1:-1]]
    parts = np.diff(np.concatenate([[0], np.searchsorted(y, inner), [len(y)]]))
    if np.minimum(np.diff(cuts), parts).sum() < need:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= PER_CENT * (len(x) + len(y) - shared)


def _blocks(rest: DataFrame) -> DataFrame:
    """Pairs of a shingle's documents in different components that pass the filters.

    Up to ROWS rows of a shingle meet in one cell. Of more, those of its largest component need not meet each other: they and the others fall into
    blocks of about ROWS, each block of theirs meets each of the others' (lo, hi, from 0), and the others' blocks meet among
    themselves (lo and hi, below 0). So rows are copied once for each block of others, not for each of all."""
    counted = rest.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    met = rest.join(counted.select("key", "rows"), "key")
    none = F.lit(0).cast("long")
    cold = met.filter(F.col("rows") <= ROWS).select("key", "doc", "n", "at", "root", none.alias("side"), none.alias("k"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))
    hot = met.filter(F.col("rows") > ROWS)
    tops = hot.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"))
    hot = hot.join(tops, "key").withColumn("side", F.when(F.col("root") == F.col("top.root"), 1).otherwise(0).cast("long"))
    theirs, others = F.ceil(F.col("top.n") / ROWS), F.ceil((F.col("rows") - F.col("top.n")) / ROWS)
    hot = hot.withColumn("k", F.pmod(F.xxhash64("doc"), F.when(F.col("side") == 1, theirs).otherwise(others)))

    def cell(low, high):
        return F.struct(low.cast("long").alias("lo"), high.cast("long").alias("hi"))

    k = F.col("k")
    to_theirs = F.transform(F.sequence(none, theirs - 1), lambda t: cell(t, k))
    among = F.transform(F.sequence(none, others - 1), lambda o: cell(-1 - F.greatest(o, k), -1 - F.least(o, k)))
    cells = F.when(F.col("side") == 1, F.transform(F.sequence(none, others - 1), lambda o: cell(k, o))).otherwise(F.concat(to_theirs, among))
    hot = hot.select("key", "doc", "n", "at", "root", "side", "k", F.explode(cells).alias("cell")).select("key", "doc", "n", "at", "root", "side", "k", "cell.*")
    rows = cold.unionByName(hot)

    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last run, which the next batch may go on with
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            key, lo, hi = held[0], held[-2], held[-1]
            new = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            if len(new):
                yield from _met([c[: new[-1]] for c in held], np.concatenate([[0], new]))
                held = [c[new[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield from _met(held, np.array([0, len(held[0])]))

    return in_workers(dealt, "near duplicates", run, "a long, b long").distinct()


#: Pairs that are looked at together.
TOGETHER = 500_000


def _met(columns: list[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of whole runs of rows; runs of one size are taken together."""
    _, doc, n, at, root, side, k, lo, hi = columns
    sizes = np.diff(bounds)
    for size in np.unique(sizes[sizes > 1]).tolist():
        starts = bounds[:-1][sizes == size]
        for row in range(size - 1):  # each row of a run with all after it
            step = max(1, TOGETHER // (size - row))
            for part in range(0, len(starts), step):
                i = starts[part : part + step, None] + row
                j = i + np.arange(1, size - row)
                small, large = np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
                fewer = np.minimum(n[i] - at[i], n[j] - at[j]).astype(np.int64)
                ok = (root[i] != root[j]) & (100 * small >= PER_CENT * large) & ((100 + PER_CENT) * fewer >= PER_CENT * (small + large)) & (doc[i] != doc[j]) & np.where(lo[i] >= 0, side[i] != side[j], (lo[i] == hi[i]) | (k[i] != k[j]))
                if ok.any():
                    a, b = np.broadcast_to(doc[i], j.shape)[ok], doc[j][ok]
                    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = two_columns(df, id_col, text_col)
    summary = stored(_summary(docs))
    sizes = summary.filter("piece IS NULL").select("doc_id", "n", "s1", "s2")
    equal = sizes.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other")).filter("one <> other")
    same = sizes.join(equal.select("n", "s1", "s2", "one"), ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("one").alias("b")).filter("a <> b")
    ranks, unit = _ranks(summary)
    members = stored(_members(_prefixes(docs, ranks, unit)))
    # leaders of a shingle's parts meet once more
    leaders = _members(members.filter("doc = lead").select("key", "doc", "n", "at", F.lit(0).alias("part")))
    met = members.filter("doc <> lead").unionByName(leaders.filter("doc <> lead"))
    led = stored(met.filter(_can_link(F.col("n"), F.col("at"), F.col("lead_n"), F.col("lead_at"))).select(*_pairs("doc", "lead")).distinct())
    links = stored(same.union(_verified(docs, led)))
    roots = stored(components(links))
    # documents of a shingle, its leader apart, that are not in one component yet
    rooted = members.filter("more").select("key", "doc", "n", "at").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    more = stored(_blocks(rooted).join(led, ["a", "b"], "left_anti"))
    found = stored(_verified(docs, stored(_thinned(docs, more))))
    if not found.isEmpty():
        roots = components(links.union(found))
    joined = sizes.join(roots, F.col("doc_id") == F.col("node"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one of least id; rows without words all stay. Columns, of any name, as they are.

    Where ids are null or occur twice, rows are numbered by id (null last) and text's hash, and each
    goes by its own text."""
    rows = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), df[id_col].cast("long").alias("i"), df[text_col].cast("string").alias("t"))
    if not rows.groupBy("i").count().filter("count > 1 OR i IS NULL").isEmpty():
        rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))
        rows = stored(numbered(rows, F.col("i").asc_nulls_last(), F.xxhash64("t"), F.col("at")).drop("i", "at").withColumnRenamed("place", "i"))
    gone = near_duplicates(rows, "i", "t").filter("doc_id <> component_id").select("doc_id")
    return rows.join(gone, F.col("i") == F.col("doc_id"), "left_anti").select("row.*")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLES = {
    "op2_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN c USING (doc_id)"""
}
