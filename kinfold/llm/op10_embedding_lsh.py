"""Operator 10: near duplicates of embeddings by Euclidean p-stable hashing.

Vectors are normalised in double precision. A table's key is the PROJECTIONS values floor((a . x + b) / WIDTH) of Gaussian a
and uniform b, hashed with the label. Vectors that share a key of some table are compared exactly. For a pair at cosine
0.93 (distance 0.374) one projection agrees with probability 0.851, so 64 tables of 16 find it with 0.993 and closer
ones more surely; unrelated vectors share a key with 1e-5 a table.

Plan. Equal vectors become one class with a count first (partial aggregate), so copies cost no pairs. Tables whose buckets
hold the very same classes are compared once. A bucket of over BLOCK classes is cut into blocks, each pair of blocks being
one group, so a group never holds over two blocks. Groups stand one after another in sorted partitions: the many small ones are
compared together, and only their links leave; of a large one only each class's sum of links and a spanning star. A pair that shares several buckets counts in the first table alone: a group leaves out the products within
the largest set of its members that met in an earlier table, so a tight cluster is multiplied out about once, not once a
table. Exact counts of links need each pair of a cluster of different vectors once; that is the work that stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import U64, components, keep, mixed

COSINE = 0.93
TABLES = 64
PROJECTIONS = 16
WIDTH = 2.0
BLOCK = 1024
SMALL = 16  # buckets of no more rows are compared many at once


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None if it is null, empty, zero or holds null or non-finite components."""
    offsets = column.offsets.to_numpy()
    values = column.values
    holes = values.is_null().to_numpy(zero_copy_only=False)
    x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    fine = np.isfinite(x) & ~holes
    null = column.is_null().to_numpy(zero_copy_only=False)
    rows = []
    for i in range(len(column)):
        a, b = offsets[i], offsets[i + 1]
        rows.append(x[a:b] if not null[i] and b > a and fine[a:b].all() and x[a:b].any() else None)
    return rows


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keys_of(x: np.ndarray, labels: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """An integer for each row and table."""
    dim = x.shape[1]
    rng = np.random.default_rng([20240229, dim])
    a = rng.standard_normal((dim, tables * projections))
    b = rng.uniform(0, width, tables * projections)
    cells = np.floor((_unit(x) @ a + b) / width).astype(np.int64).astype(U64).reshape(len(x), tables, projections)
    spread = mixed(np.arange(1, projections + 1, dtype=U64)) | U64(1)
    out = mixed(np.arange(tables, dtype=U64) + U64(1 << 20))[None, :] + mixed(labels.astype(np.int64).astype(U64))[:, None]
    for k in range(projections):
        out = out + cells[:, :, k] * spread[k]
        out ^= out >> U64(29)
    return mixed(out).view(np.int64)


def _hashed(tables: int, projections: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _vectors(batch.column("embedding"))
            labels, ids = batch.column("label").to_pylist(), batch.column("vec_id").to_pylist()
            good = [i for i, r in enumerate(rows) if r is not None and labels[i] is not None and ids[i] is not None]
            names: list = [None] * len(rows)
            keys: list = [None] * len(rows)
            for dim in {len(rows[i]) for i in good}:
                some = [i for i in good if len(rows[i]) == dim]
                for at in range(0, len(some), 2048):
                    part = some[at : at + 2048]
                    k = keys_of(np.stack([rows[i] for i in part]), np.array([labels[i] for i in part]), tables, projections, width)
                    for i, own in zip(part, k, strict=True):
                        names[i] = xxhash.xxh3_128_hexdigest(rows[i].tobytes(), seed=int(labels[i]) % (1 << 64))
                        keys[i] = own.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(names, pa.string()), pa.array(keys, pa.binary()), batch.column("embedding"), batch.column("label")], names=["vec_id", "same", "hashes", "embedding", "label"]
            )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(x, "<i8") for x in batch.column("hashes").to_pylist()]
        n = [len(r) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("class").to_numpy(), n)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])), pa.array(np.concatenate(rows))],
            names=["class", "tab", "key"],
        )


def _least_reachable(near: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest label each of all reaches by links between ``rows`` (near's rows) and all (its columns)."""
    a, b = np.nonzero(near)
    a = rows[a]
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new


def _not_met(keys: np.ndarray) -> np.ndarray:
    """All rows but those of the largest set that met in one of the earlier tables (a column each): every new pair has one of these."""
    most, rest = 0, np.arange(len(keys))
    for column in keys.T:
        value, code, count = np.unique(column, return_inverse=True, return_counts=True)
        if count.max() > max(1, most):
            most = int(count.max())
            rest = np.flatnonzero(code != count.argmax())
    return rest


def _new(i: np.ndarray, j: np.ndarray, keys: np.ndarray, tab: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows share no key in a table before ``tab``."""
    out = np.empty(len(i), bool)
    earlier = np.arange(keys.shape[1])[None, :]
    for s in range(0, len(i), 50_000):
        part = slice(s, s + 50_000)
        out[part] = ~((keys[i[part]] == keys[j[part]]) & (earlier < tab[part, None])).any(axis=1)
    return out


@dataclass
class Buckets:
    """Whole buckets, one after another: columns of their rows, and where each begins."""

    own: np.ndarray
    node: np.ndarray
    copies: np.ndarray
    block: np.ndarray
    split: np.ndarray  # whether the bucket's pairs are those of two blocks only
    tab: np.ndarray
    keys: np.ndarray
    kind: np.ndarray  # label and length of the vector, as a number
    vectors: list[np.ndarray]
    begin: np.ndarray


def _buckets(batches: list[pa.RecordBatch]) -> Buckets:
    table = pa.Table.from_batches(batches).combine_chunks()
    own, node, copies, block, tab, key, lo, hi = (table.column(c).to_numpy() for c in ("class", "node", "copies", "block", "tab", "key", "lo", "hi"))
    x = _vectors(table.column("embedding").chunk(0))
    pair = np.stack([table.column("label").to_numpy(), np.array([len(v) for v in x])])
    new = np.ones(len(own), bool)
    new[1:] = (tab[1:] != tab[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    keys = np.stack([np.frombuffer(k, "<i8") for k in table.column("hashes").to_pylist()])
    kind = np.unique(pair, axis=1, return_inverse=True)[1].reshape(-1)
    return Buckets(own, node, copies, block, lo != hi, tab, keys, kind, x, np.append(np.flatnonzero(new), len(own)))


def _lots(x: np.ndarray, step: int) -> list[np.ndarray]:
    return [x[s : s + step] for s in range(0, len(x), step)]


def _small(b: Buckets, first: np.ndarray, size: np.ndarray, cosine: float) -> list[np.ndarray]:
    """Links within buckets of a few rows, all pairs of all of them at once: a row for each link and direction."""
    out = []
    for n in np.unique(size):
        i, j = np.triu_indices(n, 1)
        at = first[size == n]
        lot = max(1, 100_000 // len(i))
        for s in range(0, len(at), lot):
            x, y = (at[s : s + lot, None] + i[None, :]).reshape(-1), (at[s : s + lot, None] + j[None, :]).reshape(-1)
            fine = (b.kind[x] == b.kind[y]) & (~b.split[x] | (b.block[x] != b.block[y]))
            x, y = x[fine], y[fine]
            for kind in np.unique(b.kind[x]):
                u, v = x[b.kind[x] == kind], y[b.kind[x] == kind]
                row, code = np.unique(np.concatenate([u, v]), return_inverse=True)
                unit = _unit(np.stack([b.vectors[r] for r in row]))
                step = max(1, 4_000_000 // unit.shape[1])
                near = [np.einsum("ij,ij->i", unit[p], unit[q]) for p, q in zip(_lots(code[: len(u)], step), _lots(code[len(u) :], step), strict=True)]
                hit = np.flatnonzero(np.concatenate(near) >= cosine)
                u, v = u[hit], v[hit]
                good = _new(u, v, b.keys, b.tab[u])
                u, v = u[good], v[good]
                out += [np.stack([b.own[u], b.node[u], b.node[v], b.copies[v]]), np.stack([b.own[v], b.node[v], b.node[u], b.copies[u]])]
    return out


def _large(b: Buckets, lo: int, hi: int, cosine: float) -> list[np.ndarray]:
    """Links within one bucket: each row's sum of links and a star."""
    out = []
    tab, split = int(b.tab[lo]), bool(b.split[lo])
    for kind in np.unique(b.kind[lo:hi]):
        at = lo + np.flatnonzero(b.kind[lo:hi] == kind)
        keys = b.keys[at][:, :tab]
        rows = _not_met(keys) if len(at) >= 128 else np.arange(len(at))
        if not len(rows):
            continue
        unit = _unit(np.stack([b.vectors[r] for r in at]))
        first = np.empty((len(rows), len(at)), bool)
        for s in range(0, len(rows), 256):
            some = rows[s : s + 256]
            near = unit[some] @ unit.T >= cosine
            near &= some[:, None] != np.arange(len(at))[None, :]
            if split:  # pairs within a block are another bucket's
                near &= b.block[at][some][:, None] != b.block[at][None, :]
            if near.sum() * 16 < near.size:  # few links: one by one
                i, j = np.nonzero(near)
                near[i, j] = _new(some[i], j, keys, np.full(len(i), tab))
            else:  # many: a table at a time for all
                for column in keys.T:
                    near &= column[some][:, None] != column[None, :]
            first[s : s + 256] = near
        root = _least_reachable(first, rows, b.node[at].copy())
        many = b.copies[at]
        weight = np.zeros(len(at), np.int64)
        own = np.zeros(len(rows), np.int64)
        for s in range(0, len(rows), 256):  # links between two of rows are in both sums
            part = first[s : s + 256].astype(np.float64)
            weight += (many[rows[s : s + 256]].astype(np.float64) @ part).astype(np.int64)
            own[s : s + 256] = (part @ many.astype(np.float64)).astype(np.int64)
        weight[rows] = own
        some = np.flatnonzero(weight)
        out.append(np.stack([b.own[at][some], b.node[at][some], root[some], weight[some]]))
    return out


def _compare(cosine: float):
    """Links of the buckets of one partition, whose rows stand bucket by bucket."""
    names = ("tab", "key", "lo", "hi")

    def done(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = _buckets(batches)
        size = np.diff(b.begin)
        found = _small(b, b.begin[:-1][(size > 1) & (size <= SMALL)], size[(size > 1) & (size <= SMALL)], cosine)
        for k in np.flatnonzero(size > SMALL):
            found += _large(b, int(b.begin[k]), int(b.begin[k + 1]), cosine)
        rows = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], names=["class", "a", "b", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in names])
            last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            begin = int(last[-1]) + 1 if len(last) else 0  # of the batch's last bucket, which may go on
            if open_ and (begin or [open_[-1].column(c)[-1].as_py() for c in names] != keys[:, 0].tolist()):
                yield done([*open_, batch.slice(0, begin)] if begin else open_)
                open_ = []
            elif begin:
                yield done([batch.slice(0, begin)])
            open_.append(batch.slice(begin))
        if open_:
            yield done(open_)

    return run


def linked(embeddings: DataFrame, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of embeddings (columns vec_id, embedding, label; others are ignored).

    Rows are linked if their labels are equal and not null and their cosine is at least ``cosine`` (which the key width is
    chosen for). Rows whose vector is null, empty, zero or holds null or non-finite components, or whose label is null, have
    no links and are their own component; so have rows with a null vec_id, which is also their component. Vectors of
    different lengths are never linked. Equal rows are two vectors that are linked. Rows that share a vec_id each have their
    own vector's links; they are one node of the components, an invalid one among them included. A vector of any length is
    compared whole. A cosine that rounds to the threshold counts as reaching it. The order of rows changes nothing.
    """
    data = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    hashed = keep(data.mapInArrow(_hashed(tables, projections, width), "vec_id long, same string, hashes binary, embedding array<double>, label long"), "hashed")
    # The least row of a class by a partial aggregate: no task gets the copies of one vector.
    some = hashed.where("same IS NOT NULL")
    classes = some.groupBy("same").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("hashes", "embedding", "label"), "vec_id").alias("row"))
    nodes = classes.select("same", "node", "copies", "row.hashes", "row.embedding", "row.label")
    nodes = keep(nodes.withColumn("class", F.monotonically_increasing_id()), "nodes")  # one vec_id may be the least of several classes
    entries = nodes.select("class", "hashes").mapInArrow(_keys, "class long, tab int, key long")
    buckets = entries.groupBy("tab", "key").agg(
        F.count(F.lit(1)).alias("size"), F.min("class").alias("least"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")
    )
    buckets = buckets.where("size > 1").groupBy("size", "least", "x", "y").agg(F.min(F.struct("tab", "key")).alias("at"))
    buckets = buckets.select("at.tab", "at.key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    inside = entries.join(buckets, ["tab", "key"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    inside = inside.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    inside = inside.select("tab", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "class")
    order = ("tab", "key", "lo", "hi")
    inside = inside.join(nodes.drop("same"), "class").repartition(*order).sortWithinPartitions(*order)
    found = keep(inside.mapInArrow(_compare(cosine), "class long, a long, b long, weight long"), "found")
    shared = hashed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.count("same").alias("fine"), F.min("same").alias("lo"), F.max("same").alias("hi"))
    shared = shared.where("n > 1 AND (fine < n OR lo < hi)").select("vec_id")  # ids of different rows
    tied = some.select("vec_id", "same").join(shared, "vec_id", "left_semi").join(nodes.select("same", "node"), "same").where("vec_id != node")
    label = components(found.select("a", "b").unionByName(tied.select(F.col("vec_id").alias("a"), F.col("node").alias("b"))), "vectors")
    # Results of a class first and written, its copies joined to them after: that join has a shuffle of its own, which adaptive execution can split.
    results = nodes.select("class", "same", "node", "copies").join(found.groupBy("class").agg(F.sum("weight").alias("links")), "class", "left").join(label, "node", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    results = keep(results.select("same", n_links, F.coalesce("component", "node").alias("component_id")), "results")
    out = some.select("vec_id", "same").join(results, "same").select("vec_id", "n_links", "component_id")
    alone = hashed.where("same IS NULL").select("vec_id").join(label, F.col("vec_id") == F.col("node"), "left")
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
