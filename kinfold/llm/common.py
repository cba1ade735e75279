"""What several operators share: words of Arrow columns, hashes, tables kept between steps, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.runtime import keep, shared_folder  # noqa: F401

U64 = np.uint64

#: Bytes to bytes. LOWER_ALNUM lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
LOWER_ALNUM = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32
    for b in range(256)
)


# ---------------------------------------------------------------- tables between steps


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prime_from(n: int) -> int:
    """The smallest odd prime of at least n: ids with a common stride still spread over so many groups."""
    n = max(3, n | 1)
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


# ---------------------------------------------------------------- words


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of one piece have about ``most`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def words_of(texts: pa.Array, table: bytes | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after another, and where each text's words begin (one more entry at the end).

    Words are runs of bytes other than \\x20 and \\x09-\\x0D, after ``table`` (which keeps lengths) is applied. Null: none.
    """
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if table is not None:
        offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        data = arr.buffers()[2]
        raw = (data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b"").translate(table)
        arr = pa.LargeStringArray.from_buffers(len(arr), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(raw))
    lists = pc.ascii_split_whitespace(arr)
    flat = lists.flatten()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # white space at an end of a text leaves an empty piece
        flat = flat.filter(pa.array(full))
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
    return flat, starts


def codes_of(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each word's number among the distinct words, and these."""
    coded = flat.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def hashes_of(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    codes, distinct = codes_of(flat)
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), U64, len(distinct))[codes] if len(distinct) else np.empty(0, U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on every bit (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def rolled(h: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """At i the hash of the sequence h[i : i + width]; one entry for each i where that lies within h."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out, have, power, span = np.zeros(len(h), U64), 0, pow(base, 0, 1 << 64), h
    block, size, left = h.copy(), 1, width
    while left:  # by doubling: block[i] covers h[i : i + size]
        if left & 1:
            part = np.zeros(len(h), U64)
            part[: len(h) - have] = block[have:]
            out += part * U64(power)
            have += size
            power = pow(base, have, 1 << 64)
        left >>= 1
        if left:
            up = block.copy()
            up[: len(h) - size] += block[size:] * U64(pow(base, size, 1 << 64))
            block, size = up, size * 2
    return mixed(out[:n])


def within(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its text and its place in it."""
    counts = np.diff(starts)
    text = np.repeat(np.arange(len(counts)), counts)
    return text, np.arange(starts[-1]) - np.repeat(starts[:-1], counts)


def packed(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def unpacked(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=kind)


# ---------------------------------------------------------------- connected components


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Columns node, component of every node of links (columns a, b): the smallest node it is connected with.

    Alternates the large-star and small-star steps, which turn every component into a star around its smallest node.
    Nodes and links stay in the cluster; only two numbers a round come to the driver. A round's shuffles are on a node with
    the neighbours' minimum as partial aggregate, so a hub needs no more memory than another node.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = keep(large, f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = keep(small.where("u != v").distinct(), f"{name}-small")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if (now.n, now.s) == before:
            break
        before = (now.n, now.s)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
