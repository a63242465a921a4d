"""Near duplicates, fingerprints, sharding, mixing, top-k, toxicity, the pipeline against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import xxhash
from conftest import ODD, frame, prose
from pyspark.sql import functions as F

import corpus_pipeline
from quillgrid.llm import fingerprints, mixing, ngram_join, sharding, topk, toxicity
from quillgrid.llm.components import components
from quillgrid.llm.shingles import shingle_sets


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def edited(text, n, seed):
    w, r = text.split(" "), random.Random(seed)
    for _ in range(n):
        w[r.randrange(len(w))] = prose(r.random(), 1)
    return " ".join(w)


def plain_components(rows):
    sets = [(d, shingles(t)) for d, t, *_ in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def near_rows():
    rows, n = [], 0
    for group in range(12):
        base = prose(group, random.Random(group).choice([6, 12, 40, 150]))
        for k in range(14):
            rows.append((n := n + 1, edited(base, k % 7, (group, k).__hash__())))
    rows += [(n + k, prose(100 + k, 30)) for k in range(1, 20)]
    line = "a line that is found in very many texts of this table "
    rows += [(500 + k, line + prose(300 + k, 3)) for k in range(40)]
    random.Random(1).shuffle(rows)
    return rows


def test_shingles():
    found = shingle_sets(["A b  c\td e F", "a B c d e f", "x y", "", "É é a b c"])
    assert len(found[0]) == 2 and (found[0] == found[1]).all() and len(found[2]) == 1 and len(found[3]) == 0 and len(found[4]) == 1
    long = prose(1, 3000)
    assert len(shingle_sets([long])[0]) == len(shingles(long))


def test_near_duplicates(spark):
    rows = near_rows() + ODD
    got = ngram_join.near_duplicates(frame(spark, rows).repartition(5)).collect()
    want = plain_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    sizes = sorted(len(shingles(t)) for _, t in rows)
    assert sorted(r.n_shingles for r in got) == sizes


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Blocks smaller than a shingle's documents lose no pair."""
    monkeypatch.setattr(ngram_join, "ROWS", 4)
    rows = near_rows()
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_dropped(spark, odd, none):
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.drop_near_duplicates(none).count() == 0
    got = ngram_join.drop_near_duplicates(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]


def test_near_duplicates_dropped_by_row(spark):
    """Rows that share an id, or have none, go by their own texts."""
    one, two, three = prose(1, 30), prose(2, 30), prose(3, 30)
    rows = [(1, one), (1, two), (1, one), (None, two), (None, three), (None, three), (5, three), (6, None), (6, None)]
    got = Counter((r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(frame(spark, rows).repartition(3)).collect())
    assert got == Counter([(1, one), (1, two), (5, three), (6, None), (6, None)])
    plain = ngram_join.drop_near_duplicates(frame(spark, [(1, one), (2, one + " more"), (3, two)])).collect()
    assert sorted(r.doc_id for r in plain) == [1, 3]


def test_near_duplicates_hot(spark, monkeypatch):
    """A group far larger than a part, with strangers that share its passage; no link is lost."""
    monkeypatch.setattr(ngram_join, "ROWS", 8)
    base, r = prose(7, 60), random.Random(7)
    rows = [(k, edited(base, r.randint(0, 3), k)) for k in range(150)]
    rows += [(200 + k, " ".join(base.split(" ")[:25]) + " " + prose(900 + k, 40)) for k in range(40)]
    rows += [(300 + k, edited(rows[150 + k % 5][1], 2, k)) for k in range(30)]
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(frame(spark, rows).repartition(6)).collect()}
    assert got == plain_components(rows)


def test_digests_lose_no_link():
    """Pairs that link are never thinned out, at the edge of the similarity, at all sizes; most others are."""
    r, kept, far = np.random.default_rng(4), 0, 0
    for n in (1, 2, 3, 5, 9, 40, 41, 300, 1023, 1024, 5000):
        for _ in range(40):
            pool = np.unique(r.integers(0, 1 << 63, 4 * n + 4, dtype=np.uint64) * np.uint64(2))
            r.shuffle(pool)
            share = r.uniform(0.2, 1.0)
            x, extra = pool[:n], pool[n : 2 * n]
            y = np.concatenate([x[: max(1, int(share * n))], extra[: int(r.uniform(0, 0.3) * n)]])
            x, y = np.sort(x), np.sort(y)
            common = len(np.intersect1d(x, y))
            may = ngram_join._may_link(ngram_join._digest(x), ngram_join._digest(y))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                assert may and ngram_join._linked(x, y)
            elif n >= 40 and common < 0.6 * n:
                far += 1
                kept += may
    assert kept < 0.05 * far
    crowded = np.sort(np.concatenate([np.arange(1, 400, dtype=np.uint64), np.uint64(1 << 63) + np.arange(3, dtype=np.uint64)]))
    assert ngram_join._may_link(ngram_join._digest(crowded), ngram_join._digest(crowded[5:]))


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def generalised(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    both = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in both) / sum(max(a[w], b[w]) for w in both) if both else 1.0


def check_fingerprints(got, rows):
    """Edits and likeness in a table whose ids are distinct, against plain ones; the errors."""
    got, rows, errors = {r.doc_id: r for r in got}, sorted(rows), []
    for k, (d, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        errors += [got[d].near_edited - generalised(t, changed), got[d].near_next - generalised(t, following)]
    return got, errors


def test_fingerprints(spark):
    rows = [(3 * k + 1, " ".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=random.Random(k).randint(0, 90)))) for k in range(60)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (2000, None), (2001, "é😀 x y z"), (2002, "a " * 5000 + "b")]
    got, errors = check_fingerprints(fingerprints.edited_fingerprints(frame(spark, rows)).collect(), rows)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.5 / fingerprints.SAMPLES**0.5
    assert got[1000].fingerprint == got[1001].fingerprint and got[1000].near_next == 1.0
    assert got[2000].fingerprint == "f" * 6 * fingerprints.SAMPLES


def test_fingerprints_agree_as_often_as_counts(spark):
    """With many samples the share that agrees is the generalised Jaccard similarity of the exact counts, none of them a power of two."""
    rows = [(k, " ".join(["u"] * (3 * k + 5) + ["v"] * (40 - 3 * k) + ["w%d" % k] * 7)) for k in range(8)]
    _, errors = check_fingerprints(fingerprints.edited_fingerprints(frame(spark, rows), samples=256).collect(), rows)
    assert max(map(abs, errors)) < 4 * 0.5 / 16


def test_term_counts(spark):
    got = spark.createDataFrame([("b a  b\t b c a",), ("",), ("  ",)], "t string").select(fingerprints.term_counts(F.col("t")).alias("c")).collect()
    assert [sorted(x.n for x in r.c) for r in got] == [[1, 2, 3], [1], [2]]  # the empty word is dropped later


def test_fingerprints_odd(spark, odd, none):
    """All rows come back; those alike in id and text follow each other."""
    got = fingerprints.edited_fingerprints(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ODD)
    assert sorted(r.near_next for r in got if r.doc_id == 6) == [1.0, 1.0]  # its like, then 7, whose text is the same
    assert fingerprints.edited_fingerprints(none).count() == 0
    plain = Counter((r.doc_id, r.fingerprint) for r in fingerprints.fingerprint(odd).collect())
    assert plain == Counter((r.doc_id, r.fingerprint) for r in got)
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "a b c")]
    after = sorted((r.doc_id or 9, r.near_next) for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect())
    assert [n for d, n in after if d == 1].count(1.0) >= 1 and len(after) == 4
    single = fingerprints.edited_fingerprints(frame(spark, [(3, "a b c d")])).collect()
    assert single[0].near_next == 1.0 and single[0].edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()


def plain_shard(key, tree):
    while not isinstance(tree, int):
        draws = []
        for child in tree[1]:
            h = xxhash.xxh64_intdigest(f"{sharding._name(child)}:{key}".encode(), seed=42)
            draws.append((-math.log(((h >> 11) + 0.5) / (1 << 53)) / sharding.weight(child), child))
        tree = min(draws, key=lambda x: x[0])[1]
    return tree


def test_sharding(spark, none):
    rows = [(k * 7919, f"text {k % 50}") for k in range(3000)] + ODD
    got = sharding.assign_shards(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    tree = sharding.even_tree()
    slots = defaultdict(list)
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == plain_shard(key, tree) and r.grown_shard == plain_shard(key, sharding.grown_tree(tree))
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    sums = Counter((r.size, r.text_crc32) for r in got)
    assert sums == Counter((len((t or "").encode()) + 1, crc32((t or "").encode())) for _, t in rows)
    assert 100 < sum(r.grown_shard == 16 for r in got) < 300
    assert sharding.assign_shards(none).count() == 0


def test_sharding_confines_movement(spark):
    """More weight in one rack moves rows into its region, or within it."""
    tree = sharding.even_tree()
    heavier = (tree[0], [(tree[1][0][0], [(tree[1][0][1][0][0], [*tree[1][0][1][0][1], 16]), *tree[1][0][1][1:]]), *tree[1][1:]])
    for k in range(2000):
        a, b = plain_shard(str(k), tree), plain_shard(str(k), heavier)
        assert a == b or b in (0, 1, 2, 3, 16)


def plain_targets(sizes, weigh=(3, 1, 2), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weigh[k % 3] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        each = left / sum(w[s] for s in open_)
        over = {s for s in open_ if each * w[s] > most * sizes[s]}
        if not over:
            return target | {s: each * w[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, none):
    r = random.Random(2)
    rows = [(k, " ".join(["w"] * int(r.lognormvariate(3, 1))), "src%d" % min(6, int(r.expovariate(0.6)))) for k in range(1500)]
    rows += [(2000 + k, " ".join(["w"] * 20), None) for k in range(40)]
    rows += [(d, t, "src1") for d, t in [(5000, None), (5001, ""), (5002, " \n")]]
    df = frame(spark, rows).repartition(3)
    got = mixing.copy_counts(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.copies) for r in mixing.copy_counts(df.repartition(7)).collect()} == {(r.doc_id, r.copies) for r in got}
    source = {d: s for d, _, s in rows}
    sizes = Counter()
    for d, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = plain_targets(sizes), Counter()
    for x in got:
        assert math.isclose(x.target, want[source[x.doc_id]], rel_tol=1e-9, abs_tol=1e-9) and 0 <= x.copies <= 2
        assert x.source_size == sizes[source[x.doc_id]]
        taken[source[x.doc_id]] += x.copies * x.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.001 * t, 10)
    assert mixing.copy_counts(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_expectation(spark):
    """Over many equal sources each document's copies average its rate, whatever its size; a source's words miss its target by a document at most."""
    rows = [(100 * s + k, " ".join(["w"] * (1 + k)), "src%03d" % s) for s in range(80) for k in range(60)]
    got = mixing.copy_counts(frame(spark, rows), weights=(1,)).collect()
    copies, words_ = defaultdict(list), Counter()
    for r in got:
        copies[r.size].append(r.copies)
        words_[r.doc_id // 100] += r.copies * r.size
        assert r.copies in (1, 2) and math.isclose(r.target, 1.5 * 60 * 61 / 2)
    z = [(np.mean(c) - 1.5) / (0.5 / len(c) ** 0.5) for c in copies.values()]
    assert max(map(abs, z)) < 4.5 and np.mean(np.square(z)) < 1.6
    missed = [abs(w - 1.5 * 60 * 61 / 2) for w in words_.values()]
    assert max(missed) <= 30 and np.mean(missed) < 4


def plain_pair(a, b, u):
    """One step of pivotal rounding: words move between two fractions (size, x) until one is whole."""
    up, down = min((1 - a[1]) * a[0], b[1] * b[0]), min(a[1] * a[0], (1 - b[1]) * b[0])
    move = up if u * (up + down) < down else -down
    return (a[0], a[1] + move / a[0]), (b[0], b[1] - move / b[0])


def test_pivotal_pairs(spark):
    """The fold of two items is one plain step, in one of its two outcomes; expectations stay."""
    rows = [(k, 10 * (1 + k % 7), (k % 9 + 1) / 10, 3 * (1 + k % 5), (k % 4 + 1) / 5) for k in range(400)]
    kind = "struct<key:bigint,size:double,x:double>"
    df = spark.createDataFrame([(a, float(b), c, float(d), e) for a, b, c, d, e in rows], "k long, s double, x double, t double, y double")
    items = F.array(F.struct((F.col("k") * 2).alias("key"), F.col("s").alias("size"), "x"), F.struct((F.col("k") * 2 + 1).alias("key"), F.col("t").alias("size"), F.col("y").alias("x")))
    drift = []
    for r in df.select("*", mixing._fold(items, kind).alias("f")).collect():
        got = sorted([*((i.size, i.x) for i in r.f.done), *([(r.f.left.size, r.f.left.x)] if r.f.left else [])])
        both = [sorted(plain_pair((r.s, r.x), (r.t, r.y), u)) for u in (0.0, 1.0)]
        assert any(np.allclose(got, w) for w in both) and all(min(i.x, 1 - i.x) <= mixing.WHOLE for i in r.f.done) and r.f.done
        drift.append(got[-1][1] * got[-1][0] + got[0][1] * got[0][0] - r.s * r.x - r.t * r.y)
    assert np.abs(drift).max() < 1e-9


def test_mixed_rows(spark, odd):
    got = mixing.mix(frame(spark, [(k, prose(k, 20), "src%d" % (k % 3)) for k in range(60)]))
    assert got.columns == odd.columns
    assert max(Counter(r.doc_id for r in got.collect()).values()) <= 2
    assert mixing.copy_counts(odd).count() == odd.count()


def test_mixed_rows_repeated(spark):
    """Repeated rows and null ids: each row twice at most, sums as counted, other columns stay apart."""
    same, other = "a b c d e", "f g h"
    rows = [(1, same, "s")] * 7 + [(1, other, "s"), (None, same, "s"), (None, same, "s"), (None, other, None)] + [(10 + k, prose(k, 9), "s") for k in range(30)]
    df = frame(spark, rows).withColumn("n_chars", F.monotonically_increasing_id()).repartition(4)
    df.persist()
    got, counts = mixing.mix(df), mixing.copy_counts(df).collect()
    assert got.columns == df.columns and len(counts) == len(rows)
    taken = Counter(r.n_chars for r in got.collect())
    assert max(taken.values()) <= 2
    by_key = Counter((r.doc_id, len(words(r.text))) for r in got.collect())
    want = Counter()
    for r in counts:
        want[(r.doc_id, r.size)] += r.copies
    assert by_key == +want and by_key[(None, 5)] >= 2
    ones = Counter(r.doc_id for r in got.collect() if r.text == same and r.doc_id == 1)
    assert 7 <= ones[1] <= 14
    df.unpersist()


def test_targets_of_many_sources(spark, monkeypatch):
    """Sources numbered in several ranges have the targets of one."""
    from quillgrid.llm import common

    r = random.Random(9)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 2, 3, 50, 400])), "s%04d" % k if k else None) for k in range(300)]
    want = plain_targets({s: len(words(t)) for _, t, s in rows})
    monkeypatch.setattr(common, "TOGETHER", 40)
    for x, (d, _, s) in zip(sorted(mixing.copy_counts(frame(spark, rows)).collect(), key=lambda x: x.doc_id), rows, strict=True):
        assert x.doc_id == d and math.isclose(x.target, want[s], rel_tol=1e-9, abs_tol=1e-9)


def plain_top(vectors, queries, k):
    out = set()
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), d) for d, c in vectors if d != q and len(c) == len(v))[:k]
        out |= {(q, n + 1, d, -s) for n, (s, d) in enumerate(best)}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    r = np.random.default_rng(1)
    rows = [(k, r.normal(0, 0.1, 16).round(2).tolist()) for k in range(230)] + [(300 + k, [0.25] * 16) for k in range(30)] + [(400, [5.0] * 16), (460, [-1.0, 2.0])]
    bad = [(500, None), (520, [float("nan")] * 16), (540, [float("inf")] * 16), (560, [None] * 16), (None, [0.1] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("part", F.lit(2))
    got = {tuple(x) for x in topk.top_k(df, df.filter("vec_id % 20 = 0")).collect()}
    whole = [(d, [math.floor(64 * x) for x in v]) for d, v in rows]
    assert got == plain_top(whole, [w for w in whole if w[0] % 20 == 0], 20)
    huge = spark.createDataFrame([(k, [1e5 * k, -3e4, 7.0]) for k in range(30)], "vec_id long, embedding array<double>")
    whole = [(k, [math.floor(64 * x) for x in (1e5 * k, -3e4, 7.0)]) for k in range(30)]
    assert {tuple(x) for x in topk.top_k(huge, huge.filter("vec_id % 20 = 0")).collect()} == plain_top(whole, [whole[0], whole[20]], 20)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def labelled(seed=1, n=500):
    r, rows = random.Random(seed), []
    for k in range(n):
        w = prose(seed * 10_000 + k, r.randint(5, 80)).split(" ")
        toxic = k % 4 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(["idiot", "moron", "scumbag", "loserly"])
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark, none):
    rows = labelled()
    held = [x for x in rows if crc32(str(x[0]).encode()) % 5 == 0]
    model = toxicity.train([t for d, t, y in rows if (d, t, y) not in held], [y for d, t, y in rows if (d, t, y) not in held])
    p = model.scores([t for _, t, _ in held])
    assert np.mean([(q >= 0.5) == y for q, (_, _, y) in zip(p, held, strict=True)]) > 0.95
    calm, plain, gapped, spaced, put_in = model.scores(["a calm text", "you idiot", "you id-i.ot", "you i d i o t", "you idxiot"])
    assert calm < 0.5 < min(plain, gapped, spaced) and put_in > calm
    docs = frame(spark, [(d, t) for d, t, _ in rows] + [(1000 + (d or 0), t) for d, t in ODD])
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    raw = toxicity.fit(docs, labels)
    got = toxicity.score(docs, raw, name="_p")
    assert got.columns == [*docs.columns, "_p"] and got.count() == docs.count()
    assert got.filter("_p IS NULL OR _p < 0 OR _p > 1").count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.score(docs, None, name="_p").agg(F.max("_p")).first()[0] == 0.0
    assert toxicity.score(none, raw, name="_p").count() == 0


def plain_subsequences(window):
    """Every subsequence of LENGTH characters that begins in the window, with all gaps up to SPAN, by enumeration."""
    found = Counter()
    for at in range(toxicity.WINDOW):
        for rest in combinations(range(at + 1, at + toxicity.SPAN), toxicity.LENGTH - 1):
            letters = tuple(int(window[k]) for k in (at, *rest))
            if 0 not in letters:
                found[letters] += toxicity.DECAY ** (rest[-1] - at + 1)
    return found


def test_string_kernel():
    """The kernel and the sliding margins against enumerated subsequences."""
    codes, starts = toxicity.folded(["You are an id-iot, a b c d! haha hahaha", "", "Été 1diot"])
    assert len(starts) == 4 and not codes[starts[1] + 1 : starts[2]].any()
    places = np.flatnonzero(codes)
    windows = np.concatenate([codes, np.zeros(toxicity.Windows.WIDTH, np.uint8)])[places[:, None] + np.arange(toxicity.Windows.WIDTH)]
    own = toxicity.Windows(windows)
    plain = [plain_subsequences(w) for w in windows]
    norm = toxicity._SCALE**2
    want = np.array([[norm * sum(n * y[c] for c, n in x.items()) for y in plain] for x in plain])
    got = toxicity.kernel(own, own)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-6) and np.allclose(own.norms(), np.diag(want), rtol=1e-4)
    alpha = np.sin(np.arange(len(windows)))
    assert np.allclose(toxicity.margins(codes, own.table(alpha))[places], want @ alpha, rtol=1e-3, atol=1e-4)
    root = toxicity.nystroem(own)
    z = got @ root
    assert np.allclose(z @ z.T, want, atol=2e-2)  # with all windows as landmarks the space is exact


def test_machine_is_optimal():
    """Newton's solution has no slope: the squared hinge loss and the norm balance in every direction."""
    r = np.random.default_rng(3)
    z = np.hstack([r.normal(size=(300, 12)), np.ones((300, 1))])
    y = np.sign(z[:, 0] + 0.5 * r.normal(size=300))
    parts = [(z[y > 0], 1.0, 5.0), (z[y < 0], -1.0, 5.0)]
    w = toxicity.machine(parts)
    ridge = np.ones(13)
    ridge[-1] = 1e-3
    slack = np.maximum(0, 1 - y * (z @ w))
    assert np.abs(ridge * w - 5.0 * z.T @ (y * slack)).max() < 1e-6


def test_toxicity_across_words():
    """Insults of two words, and letters put in or set apart."""
    r, rows = random.Random(5), []
    for k in range(400):
        w = prose(50_000 + k, r.randint(20, 60)).split(" ")
        if k % 4 == 0:
            w.insert(r.randrange(len(w)), r.choice(["filthy vermin", "utter buffoon"]))
        rows.append((" ".join(w), int(k % 4 == 0)))
    model = toxicity.train(*map(list, zip(*rows[:300], strict=True)))
    p = np.array(model.scores([t for t, _ in rows[300:]]))
    y = np.array([y for _, y in rows[300:]])
    assert np.mean((p >= 0.5) == y) > 0.95
    assert min(model.scores(["oh, filthy vermin", "oh, f i l t h y vermin", "you filthy verrmin", "you filt.hy ver-min"])) > 0.5


def test_toxicity_copies(spark):
    """Drops toxic rows and keeps all columns, whatever their names; labels of no row reject nothing."""
    rows = labelled(4, 300)
    docs = frame(spark, [(d, t) for d, t, _ in rows])
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {d for d, _, y in rows if not y} - ids == set() and len({d for d, _, y in rows if y} & ids) < 8
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()


def test_pipeline(spark, tmp_path):
    rows = [(d, t, "src%d" % (d % 3)) for d, t, _ in labelled(2, 300)]
    rows += [(1000, rows[1][1], "src0"), (1001, rows[2][1] + " token=abcdefghijklmnopqrst", "src1"), (1002, None, "src2")]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, _, y in labelled(2, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert k == 4 or docs.columns == names
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    assert ids["toxicity"] >= {1000, 1001, 1002} and len([d for d in ids["toxicity"] if d < 300 and d % 4 == 0]) < 8
    assert 1000 not in ids["near duplicates"] and 1 in ids["near duplicates"]
    assert not any("abcdefghijklmnopqrst" in (r.text or "") for r in seen["secrets"]) and ids["secrets"] == ids["near duplicates"]
    assert ids["mixing"] <= ids["secrets"]
    copies = Counter(r.doc_id for r in seen["mixing"])
    assert sum(r.length for r in seen["packing"] if r.start == 0) > 0 and {r.doc_id for r in seen["packing"]} == set(copies)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_pipeline_odd(spark, tmp_path):
    """Nulls, empty and long texts, repeated and missing ids, columns of any name, no labels: each stage keeps rows and columns as it should."""
    rows = [*ODD, (6, prose(66, 12), "src1"), (None, prose(67, 12), "src2"), (None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert name == "packing" or docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    assert len(seen["toxicity"]) == len(rows)
    texts = Counter((r.doc_id, r.text) for r in seen["near duplicates"])
    assert texts[(6, ODD[5][1])] == 1 and texts[(6, prose(66, 12))] == 1 and (7, ODD[7][1]) not in texts and texts[(None, prose(67, 12))] == 1
    assert len(seen["secrets"]) == len(seen["near duplicates"])
    assert max(Counter((r.doc_id, r.text) for r in seen["mixing"]).values()) <= 2 and all(words(r.text) for r in seen["mixing"])
    assert sum(r.start == 0 for r in seen["packing"]) == len(seen["mixing"])


def test_pipeline_empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
