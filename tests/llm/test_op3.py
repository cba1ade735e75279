import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm.op3_order_minhash import PART, _chain, _common, aligned, near_duplicates

SCHEMA = "doc_id long, text string"


def norm(text):
    return "".join(c.lower() if c.isascii() and c.isupper() else c if not c.isascii() or c.isalnum() else " " for c in text or "").split()


def shingles(text):
    w = norm(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], max(row[j], row[j - 1], prev + 1 if x == y else 0)
    return row[-1]


def brute(rows):
    """Classes by comparing all pairs."""
    s = {d: shingles(t) for d, t in rows}
    up = {d: d for d in s}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = s[a], s[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(set(x) & set(y)) > 0.5 * max(len(set(x)), len(set(y))):
                m = lcs(x, y)
                if m / (len(x) + len(y) - m) >= 0.8:
                    lo, hi = sorted((root(a), root(b)))
                    up[hi] = lo
    return {d: root(d) for d in s}


def run(spark, rows):
    return {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_chains_order_and_copies(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    rows, doc = [], list(base)
    for i in range(12):  # each is close to the one before only
        rows.append((100 + i, " ".join(doc)))
        for _ in range(4):
            doc[rnd.randrange(len(doc))] = f"n{rnd.randrange(10**6)}"
    rows += [(200 + i, " ".join(base).upper() + "!" * i) for i in range(30)]
    blocks = [base[i : i + 20] for i in range(0, 400, 20)]
    rnd.shuffle(blocks)
    rows.append((300, " ".join(sum(blocks, []))))  # the same words in another order of passages
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[111] == 100 and got[229] == 100 and got[300] == 300


def test_nulls_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A, b."), (6, "b a"), (6, "b a"), (7, "a b c d e f g"), (None, "a b")]
    assert run(spark, rows) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "x y z"), (2, "x y z")], SCHEMA).withColumn("node", F.lit("q")).withColumn("n", F.lit(1)).withColumn("sig", F.lit(None))
    assert sorted((r.doc_id, r.class_id, r.kept) for r in near_duplicates(df).collect()) == [(1, 1, True), (2, 1, False)]


def test_alignment_of_repeats_is_exact():
    rnd = random.Random(3)
    reached = 0
    for case in range(300):
        a = [rnd.randrange(rnd.choice([2, 10, 300])) for _ in range(rnd.randrange(1, 120))]
        b = [s for s in a if rnd.random() > 0.06]
        for _ in range(rnd.randrange(6)):
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(10))
        m = lcs(a, b)
        where = {}
        for j, s in enumerate(b):
            where.setdefault(s, []).append(j)
        assert _chain(a, where, 1000) == _common(a, b, 1000) == m
        want, got = m / (len(a) + len(b) - m), aligned(np.array(a), np.array(b, int), 0.8)
        assert got == want if want >= 0.8 else got < 0.8
        reached += want >= 0.8
    assert 100 < reached < 300
    a = [rnd.randrange(3000) for _ in range(2 * PART + 500)]  # several parts, and a band narrower than the texts
    b = [s for s in a if rnd.random() > 0.02]
    where = {}
    for j, s in enumerate(b):
        where.setdefault(s, []).append(j)
    assert _common(a, b, 10**6) == _chain(a, where, 10**6) == _common(a, b, 400) > 0.95 * len(b)


def test_repeated_lines(spark):
    """An early repeat dropped, and a word changed near each end."""
    rnd, rows = random.Random(4), []
    for i in range(10):
        line = [f"r{i}x{k}" for k in range(12)]
        parts = [[f"w{rnd.randrange(10**6)}" for _ in range(20)] for _ in range(7)]
        whole = sum((p + line for p in parts[:6]), []) + parts[6]
        less = parts[0] + sum((p + line for p in parts[1:6]), []) + parts[6]
        less[2] = less[-3] = "changed"
        rows += [(2 * i, " ".join(whole)), (2 * i + 1, " ".join(less))]
    want = brute(rows)
    assert want == {d: d - d % 2 for d, _ in rows}
    assert run(spark, rows) == want


def test_near_copies_of_the_table_are_found_or_under_the_threshold(spark):
    """Every pair of the small table at 0.8 or more is of one class; the near copies that are not lie below it, word edits taking five shingles each."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    label = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    seen = {}
    for d, t in docs.collect():
        w = "".join(c.lower() if c.isascii() and c.isupper() else c if not c.isascii() or c.isalnum() else " " for c in t or "").split()
        if w:
            seen[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    where = {}
    for d, own in seen.items():
        for s in own:
            where.setdefault(s, []).append(d)
    pairs = {(a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    found = below = missed = 0
    for a, b in pairs:
        common = (seen[a] & seen[b]).total()
        similar = common / (seen[a].total() + seen[b].total() - common)
        if similar >= 0.8:
            found, missed = found + (label[a] == label[b]), missed + (label[a] != label[b])
        elif similar >= 0.4:
            below += label[a] != label[b]
    print(f"pairs at 0.8 or more: {found} found, {missed} missed; from 0.4 to 0.8, apart: {below}")
    assert missed == 0 and found > 20
