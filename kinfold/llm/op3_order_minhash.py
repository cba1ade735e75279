"""Operator 3: near duplicates by Order MinHash.

A text is the sequence of its five-word shingles, each labelled with the number of its occurrence in the text. Each of
TABLES hash functions picks the SAMPLE least labelled shingles; the picked ones *in text order* are the table's signature,
so a signature survives edits but not a new order. Texts that share a signature are candidates, and the longest common
subsequence of the two shingle sequences, within a band, decides.

Plan. Texts with equal words become one class first (a partial aggregate on a 128-bit hash), so copies cost a row each and
no pair. Each bucket then pairs its members with one hub only, the member that shares most signatures with others: a number of
pairs linear in the members. Links that such a star can't show are looked for in a second round, in each bucket that still
spans several components (buckets of the same members once): blocks of at most BLOCK members meet in a task each, which
compares members of different components by their numbers of shared shingles and aligns those that share enough. No pair
leaves a task unless it is a link. Only ids and signatures are shuffled for candidates; the text is shuffled by doc_id for
the alignments.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import LOWER_ALNUM, U64, components, hashes_of, keep, mixed, pieces, rolled, within, words_of

WORDS = 5
SIMILARITY = 0.8
TABLES = 24
SAMPLE = 4
BLOCK = 256
PART = 4096

_SEEDS = mixed(np.arange(1, 4097, dtype=U64))


def _shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and where each text's begin; shingle hashes and where each text's begin.

    A text of fewer words than a shingle has one shingle of all its words.
    """
    flat, starts = words_of(texts, LOWER_ALNUM)
    h = hashes_of(flat)
    size = np.diff(starts)
    text, place = within(starts)
    whole = rolled(h, width)
    valid = np.flatnonzero(place + width <= size[text])
    count = np.maximum(size - width + 1, (size > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begin[-1], U64)
    short = np.flatnonzero((size > 0) & (size < width))
    at = np.ones(begin[-1], bool)
    at[begin[short]] = False
    out[at] = whole[valid]
    for i in short:
        out[begin[i]] = rolled(h[starts[i] : starts[i + 1]], int(size[i]))[0]
    return h, starts, out, begin


def labelled(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The shingles with the number of their occurrence in the text mixed in."""
    text, _ = within(begin)
    order = np.lexsort((shingles, text))
    new = np.ones(len(order), bool)
    new[1:] = (shingles[order[1:]] != shingles[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    at = np.arange(len(order))
    times = np.empty(len(order), U64)
    times[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(U64)
    return mixed(shingles + times * U64(0x9E3779B97F4A7C15))


def signatures(k: np.ndarray, tables: int, sample: int) -> np.ndarray:
    """The Order MinHash of one text's labelled shingles: a number a table."""
    seeds, spread = _SEEDS[:tables], _SEEDS[2048 : 2048 + tables] | U64(1)
    if len(k) <= sample:
        picked = np.broadcast_to(np.arange(len(k)), (tables, len(k)))
    elif len(k) > 100_000:  # a table at a time: memory stays a few times the text's
        picked = np.stack([np.sort(np.argpartition(_scatter(k, s, m), sample - 1)[:sample]) for s, m in zip(seeds, spread, strict=True)])
    else:
        v = _scatter(k[None, :], seeds[:, None], spread[:, None])
        picked = np.sort(np.argpartition(v, sample - 1, axis=1)[:, :sample], axis=1)
    out = seeds.copy()
    for j in range(picked.shape[1]):
        out = out * U64(0x100000001B3) + k[picked[:, j]]
        out ^= out >> U64(31)
    return mixed(out).view(np.int64)


def _scatter(k, seed, spread):
    v = (k ^ seed) * spread
    v ^= v >> U64(32)
    v *= spread
    return v


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Matched shingles in common order over all shingles of the two, by a longest common subsequence; 0 or any lower number if ``similarity`` isn't reached.

    Equal ends are matched first. Between them all equal shingles within the widest band that can reach ``similarity`` may be
    matched, whatever their number of occurrence: by a longest increasing chain, or bit-parallel if repeats make too many pairs.
    """
    if not len(a) or not len(b) or min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return 0.0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    left = n - head
    differ = np.flatnonzero(a[len(a) - left :][::-1] != b[len(b) - left :][::-1]) if left else np.empty(0, int)
    tail = int(differ[0]) if len(differ) else left
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    matched = head + tail
    if len(x) and len(y):
        band = int((len(a) + len(b)) * (1 - similarity) / (1 + similarity)) + 1
        where: dict[int, list[int]] = {}
        for j, s in enumerate(y):
            where.setdefault(s, []).append(j)
        both = [(n, len(where[s])) for s, n in Counter(x).items() if s in where]
        most = matched + sum(min(p) for p in both)
        if most < similarity * (len(a) + len(b) - most):
            return 0.0
        if sum(n * m for n, m in both) <= len(x) * (2 + len(y) / 2048):
            matched += _chain(x, where, band)
        else:
            matched += _common(x, y, band)
    return matched / (len(a) + len(b) - matched)


def _chain(x: list[int], where: dict[int, list[int]], band: int) -> int:
    """Length of the longest common subsequence, all pairs of equal shingles within the band a step each."""
    chain: list[int] = []
    for i, s in enumerate(x):
        for j in reversed(where.get(s, ())):  # falling, so that a place of x is matched once
            if abs(i - j) <= band:
                at = bisect_left(chain, j)
                chain[at : at + 1] = [j]
    return len(chain)


def _common(x: list[int], y: list[int], band: int) -> int:
    """The same bit-parallel, so many places of y at a time: memory doesn't follow the texts' length."""
    found, carry = 0, bytearray(len(x))
    for at in range(0, len(y), PART):
        part = y[at : at + PART]
        masks: dict[int, int] = {}
        for j, s in enumerate(part):
            masks[s] = masks.get(s, 0) | 1 << j
        row = full = (1 << len(part)) - 1
        # Before these places of x the part has no match and hands the carry on; after them nothing to the left has one.
        for i in range(max(0, at - band), min(len(x), at + len(part) + band)):
            m = masks.get(x[i], 0)
            if m or carry[i]:
                u = row & m
                total = row + u + carry[i]
                carry[i] = total >> len(part)
                row = (total & full) | (row - u)
        found += len(part) - row.bit_count()
    return found


def _sketch(width: int, tables: int, sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            h, starts, shingles, begin = _shingles(piece.column("text"), width)
            k = labelled(shingles, begin)
            rows = [k[begin[i] : begin[i + 1]] for i in range(piece.num_rows)]
            sketch = [signatures(r, tables, sample) if len(r) else np.empty(0, np.int64) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array([xxhash.xxh3_128_hexdigest(h[starts[i] : starts[i + 1]].tobytes()) for i in range(len(rows))], pa.string()),
                    pa.array(np.diff(begin), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sketch])]), pa.int32()), pa.array(np.concatenate(sketch), pa.int64())),
                ],
                names=["doc_id", "words", "n", "sketch"],
            )

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose texts reach the similarity, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(pieces(batches, "text_a"), "text_b"):
            _, _, x, bx = _shingles(piece.column("text_a"), width)
            _, _, y, by = _shingles(piece.column("text_b"), width)
            sim = np.array([aligned(x[bx[i] : bx[i + 1]], y[by[i] : by[i + 1]], similarity) for i in range(piece.num_rows)])
            out = pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(sim)], names=["a", "b", "similarity"])
            yield out.filter(pc.greater_equal(out.column(2), similarity))

    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """For each two of x and y, how many labelled shingles they share: no fewer than an alignment can match."""
    every, code = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    size = np.cumsum([0, *(len(s) for s in x), *(len(s) for s in y)])
    codes = [np.sort(code[a:b]) for a, b in zip(size[:-1], size[1:], strict=True)]
    out = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(every), 4096):  # so many shingles at a time: memory doesn't follow the texts' length
        part = np.zeros((len(codes), 4096), np.float32)
        for i, c in enumerate(codes):
            part[i, c[slice(*np.searchsorted(c, [at, at + 4096]))] - at] = 1
        out += part[: len(x)] @ part[len(x) :].T
    return out


def _across(width: int, similarity: float):
    """Links between members of different components of one bucket (or of two of its blocks)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        split = table.column("first")[0].as_py() != table.column("second")[0].as_py()
        node, component, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        _, _, shingles, begin = _shingles(table.column("text").chunk(0), width)
        k = labelled(shingles, begin)
        rows = [(shingles[begin[i] : begin[i + 1]], k[begin[i] : begin[i + 1]]) for i in range(len(node))]
        main = np.unique(component, return_counts=True)
        largest = main[0][main[1].argmax()]
        rest = np.flatnonzero(component != largest)  # every pair across components has a member of these
        out = []
        if len(rest):
            shared = _shared([rows[i][1] for i in rest], [r[1] for r in rows])
            size = np.array([len(r[1]) for r in rows])
            enough = shared >= similarity / (1 + similarity) * (size[rest][:, None] + size[None, :]) - 1e-6
            enough &= component[rest][:, None] != component[None, :]
            if split:
                enough &= block[rest][:, None] != block[None, :]
            enough &= ~((component[None, :] != largest) & (node[rest][:, None] > node[None, :]))  # pairs of the rest, once
            for i, j in zip(*np.nonzero(enough), strict=True):
                i = rest[i]
                if (sim := aligned(rows[i][0], rows[j][0], similarity)) >= similarity:
                    out.append((min(node[i], node[j]), max(node[i], node[j]), sim))
        return pa.table({c: pa.array([o[n] for o in out], pa.int64() if n < 2 else pa.float64()) for n, c in enumerate(("a", "b", "similarity"))})

    return run


def links_and_members(documents: DataFrame, width: int = WORDS, similarity: float = SIMILARITY, tables: int = TABLES, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between representatives of texts with equal words, and members (doc_id, exact_id).

    The links connect all representatives that are connected by pairs of the given similarity which share a signature. Null
    and empty texts are members of a class of their own.
    """
    texts = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    sketched = keep(texts.mapInArrow(_sketch(width, tables, sample), "doc_id long, words string, n long, sketch array<long>"), "sketches")
    # Sums of a class first and written, its copies joined to it after: that join has a shuffle of its own, which adaptive execution can split.
    first = sketched.where("n > 0").groupBy("words").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("f"))
    first = keep(first.select("words", F.col("f.doc_id").alias("exact_id"), "f.n", "f.sketch"), "classes")
    member = sketched.select("doc_id", "words").join(first.select("words", "exact_id"), "words", "left")
    member = keep(member.select("doc_id", F.coalesce("exact_id", "doc_id").alias("exact_id")), "members")
    entries = first.select(F.col("exact_id").alias("node"), "n", F.posexplode("sketch").alias("tab", "sig"))
    hubs = entries.groupBy("tab", "sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = keep(entries.select("tab", "sig", "node").join(hubs, ["tab", "sig"]), "buckets")
    central = sized.groupBy("node").agg(F.sum("size").alias("score"))  # members that share most signatures make the best hubs
    hubs = sized.join(central, "node").groupBy("tab", "sig").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("hub"))
    star = sized.join(hubs, ["tab", "sig"]).where("node != hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    shared = sized.select(F.col("node").alias("doc_id")).distinct()
    # All later joins need these only. One plan at every size: a broadcast of the ids could not grow with the corpus.
    texts = keep(texts.join(shared.hint("merge"), "doc_id", "left_semi"), "texts")
    links = keep(_verified(keep(star, "star"), texts, width, similarity), "links")

    label = components(links.select("a", "b"), "first")
    open_ = sized.where("size > 2").select("tab", "sig", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sets = open_.groupBy("tab", "sig").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.min("node").alias("least"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where("lo < hi")
    once = sets.groupBy("size", "least", "x", "y").agg(F.min(F.struct("tab", "sig")).alias("at"))
    once = once.select("at.tab", "at.sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    inside = open_.join(once, ["tab", "sig"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    inside = inside.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    inside = keep(inside.select("tab", "sig", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "component"), "open")
    more = inside.join(texts.withColumnRenamed("doc_id", "node"), "node").groupBy("tab", "sig", "first", "second").applyInArrow(_across(width, similarity), "a long, b long, similarity double")
    return links.unionByName(keep(more.distinct(), "more")), member.select("doc_id", "exact_id")


def near_duplicates(documents: DataFrame, width: int = WORDS, similarity: float = SIMILARITY, tables: int = TABLES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, exact_id, class_id, kept of each document (columns doc_id, text; others are ignored).

    exact_id is the smallest doc_id with the same words (lower case of ASCII, split at ASCII other than letters and digits);
    class_id the smallest doc_id reachable by links of ``similarity`` or more; kept is true for it alone. Null, empty and
    wordless texts are like no other text. Rows that share a doc_id are one document: it gets one row, with the smallest class of
    theirs. Rows with a null doc_id are left out.
    """
    links, member = links_and_members(documents, width, similarity, tables, sample)
    label = components(links.select("a", "b"), "classes")
    out = member.join(label, F.col("exact_id") == F.col("node"), "left")
    out = out.groupBy("doc_id").agg(F.min("exact_id").alias("exact_id"), F.min(F.coalesce("component", "exact_id")).alias("class_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
