import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import op2_latent_decontam
from kinfold.llm.op2_latent_decontam import LCS_SHARE, common_subsequence, contaminated, omega_of, randomised_svd

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def norm(text):
    return "".join(c.lower() if c.isascii() and c.isupper() else c if not c.isascii() or c.isalnum() else " " for c in text or "").split()


def standing(docs, items):
    """Pairs of a document and an item whose words stand in it one after another."""
    found = set()
    words = [(d, " " + " ".join(norm(t)) + " ") for d, t in docs]
    for i, t in items:
        w = " ".join(norm(t))
        found |= {(d, i) for d, text in words if w and f" {w} " in text}
    return found


def run(spark, docs, items, **more):
    return contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more).collect()


def test_table_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    got = run(spark, docs, items)
    want = standing(docs, items)
    assert want and {(r.doc_id, r.item_id) for r in got} >= want
    assert {r.doc_id for r in got} == {d for d, _ in want}  # clean documents are left alone
    words, text = {i: norm(t) for i, t in items}, {d: norm(t) for d, t in docs}
    for r in got:
        assert common_subsequence(words[r.item_id], text[r.doc_id][r.first_word : r.last_word + 1])[0] >= LCS_SHARE * len(words[r.item_id])


def paraphrase(rnd, words, share):
    out = []
    for w in words:
        if rnd.random() < share:
            out += rnd.choice([[], [f"q{rnd.randrange(10**6)}"], [w, f"q{rnd.randrange(10**6)}"]])
        else:
            out.append(w)
    return out


def made(rnd, share, texts=200, items=100, words=40):
    """Clean texts with items planted in every other one, a share of the words replaced: (documents, items, pairs)."""
    common = [f"c{i}" for i in range(60)]
    text = lambda n: [rnd.choice(common) if rnd.random() < 0.5 else f"w{int(20000 * rnd.random() ** 2)}" for _ in range(n)]
    own = [(i, text(words)) for i in range(items)]
    docs, want = [], set()
    for d in range(texts):
        body = text(rnd.randrange(60, 500))
        if d % 2:
            i = rnd.randrange(items)
            at = rnd.randrange(len(body))
            swap = set(rnd.sample(range(words), round(share * words)))
            body[at:at] = [text(1)[0] if k in swap else w for k, w in enumerate(own[i][1])]
            want.add((d, i))
        docs.append((d, " ".join(body)))
    return docs, [(i, " ".join(w)) for i, w in own], want


@pytest.mark.parametrize("share", [0, 0.1, 0.2, 0.3])
def test_recall_of_paraphrases(spark, share):
    docs, items, want = made(random.Random(int(100 * share)), share)
    got = {(r.doc_id, r.item_id) for r in run(spark, docs, items)}
    assert got <= want  # no false row
    assert len(got) >= (0.9 if share else 1) * len(want)


def test_the_latent_space_decides(spark):
    """Candidates come from the cosine alone: what misses it is lost."""
    docs, items, want = made(random.Random(31), 0.2)
    full = {(r.doc_id, r.item_id) for r in run(spark, docs, items)}
    assert len(full) >= 0.9 * len(want)
    assert run(spark, docs, items, cosine=1.1) == []
    some = {(r.doc_id, r.item_id) for r in run(spark, docs, items, cosine=0.985)}
    assert some < full and len(some) < 0.9 * len(full)


def test_slices_change_no_row(spark):
    docs, items, _ = made(random.Random(32), 0.1, items=60)
    items += [(100 + i, t) for i, t in items[:20]] + [(7, items[0][1])] * 3  # repeated texts share a slice and are searched once
    rows = lambda **more: sorted(tuple(r) for r in run(spark, docs, items, **more))
    assert rows(slice_words=300) == rows(slice_words=1000) == rows()


def test_edits_long_items_and_long_texts(spark):
    rnd = random.Random(9)
    word = lambda: f"c{rnd.randrange(40)}" if rnd.random() < 0.5 else f"w{rnd.randrange(20000)}"
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(rnd.choice([15, 40, 60, 200])))) for i in range(30)]
    docs, want = [], set()
    for d in range(400):
        body = text(60_000 if d == 16 else rnd.randrange(20, 600))
        if d % 8 == 0:
            i = rnd.randrange(30)
            at = rnd.randrange(len(body))
            body[at:at] = paraphrase(rnd, items[i][1].split(), rnd.choice([0, 0.1]))
            want.add((d, i))
        docs.append((d, " ".join(body)))
    got = {(r.doc_id, r.item_id) for r in run(spark, docs, items)}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_common_subsequence_and_svd():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(1, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], max(row[j], row[j - 1], prev + 1 if x == y else 0)
        assert common_subsequence(a, b) == (row[-1], row.index(row[-1]) if row[-1] else 0)
    a = np.random.default_rng(0).standard_normal((300, 6)) @ np.random.default_rng(1).standard_normal((6, 50))
    omega = omega_of(50, 6).astype(float)
    v, value = randomised_svd(a.T @ (a @ omega), omega, 6)
    assert np.allclose(a @ v @ v.T, a, atol=1e-6) and np.allclose(np.sqrt(value), np.linalg.svd(a, compute_uv=False)[:6])


@pytest.mark.parametrize("chunk, side", [(1 << 16, 1024), (100, 7), (1, 1)])
def test_sums_by_row(monkeypatch, chunk, side):
    monkeypatch.setattr(op2_latent_decontam, "CHUNK", chunk)
    monkeypatch.setattr(op2_latent_decontam, "SIDE", side)
    rnd = np.random.default_rng(3)
    table = rnd.integers(-9, 9, (40, 5)).astype(np.float32)  # whole numbers: sums are exact in any order
    for sizes in ([], [1], [0, 3, 0, 33, 32, 1, 0], [2500, 0, 64, 1], rnd.integers(0, 40, 60).tolist()):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        index = rnd.integers(0, 40, len(rows))
        want = np.zeros((len(sizes), 5), np.float32)
        np.add.at(want, rows, table[index])
        assert np.array_equal(op2_latent_decontam._sums(table, index, rows, len(sizes)), want)


def test_sums_take_no_step_for_each_run():
    """numpy's reduceat walks through the columns of each short run by itself; most of the operator's time went there."""
    rows = np.repeat(np.arange(8000), 8)
    table, index = np.ones((4000, 144), np.float32), np.random.default_rng(0).integers(0, 4000, len(rows))

    def best(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            assert np.all(f() == 8)
            took.append(time.process_time() - began)
        return min(took)

    assert best(lambda: op2_latent_decontam._sums(table, index, rows, 8000)) < 0.6 * best(lambda: np.add.reduceat(table[index], np.arange(0, len(rows), 8), axis=0))


def test_nulls_empty_and_clashing_columns(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, None), (2, ""), (3, f"x {item.upper()}, y"), (3, f"x {item.upper()}, y"), (None, item), (5, "alpha beta"), (6, "one TWO three")]
    items = [(7, item), (8, None), (9, ""), (10, "two three"), (11, item)]
    got = sorted((r.doc_id or 0, r.item_id, r.first_word) for r in run(spark, docs, items))
    assert got == [(0, 7, 0), (0, 11, 0), (3, 7, 1), (3, 7, 1), (3, 11, 1), (3, 11, 1), (6, 10, 1)]
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    df = spark.createDataFrame(docs, DOCS).withColumn("codes", F.lit("x")).withColumn("item_id", F.lit(1)).withColumn("at", F.lit(None))
    assert contaminated(df, spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(4))).count() == 7
