"""Exact cosine neighbours in blocks, and their merge with key candidates.

The corpus is dealt into blocks of bounded size by a hash, as are the queries; a task multiplies one block of each and keeps the
best k of its queries, so no side is broadcast, no task holds more than two blocks and the rows that leave it are queries x k. A
top-k by entity then joins the blocks' results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.blocking import top_candidates

BLOCK = 4096
ROWS = 256  # queries multiplied at a time


def _units(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the numbers of the rows with finite components only, and their vectors of length 1 (a zero vector stays as it is)."""
    groups: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v and np.isfinite(x := np.array(v, np.float64)).all():
            groups.setdefault(len(x), []).append((i, x))
    out = {}
    for dim, rows in groups.items():
        x = np.stack([v for _, v in rows])
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[dim] = np.array([i for i, _ in rows]), x / np.where(length == 0, 1.0, length)
    return out


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row; of equal ones the first columns."""
    if scores.shape[1] <= k:
        return np.divmod(np.arange(scores.size), scores.shape[1])
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    rows, cols = np.nonzero(scores >= least[:, None])  # ties at the border included
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def neighbours(queries: DataFrame, corpus: DataFrame, k: int = 20, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """entity_id, candidate_id, embedding_score: for each query the k corpus rows of highest cosine (rounded to 6 digits), ties by id.

    Both have columns id and embedding (and ``by``: only equal values meet). A k above the corpus gives all of it, an empty
    corpus nothing; a row that is in both tables is its own first neighbour. Vectors that are null, empty or hold null or non-finite
    components take no part, and only vectors of one length meet. This is the exact path: queries times corpus products.
    """
    part = F.col(by) if by else F.lit(0)
    side = lambda df: df.where("embedding IS NOT NULL").select("id", part.alias("part"), "embedding")
    q, c = side(queries), side(corpus)
    counts = [max(1, math.ceil(df.count() / block)) for df in (q, c)]
    dealt = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    q = dealt(q, counts[0]).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))))
    c = dealt(c, counts[1]).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))))
    q = q.select("part", F.col("block").alias("a"), F.col("other").alias("b"), "id", "embedding")
    c = c.select(F.col("part").alias("part_c"), F.col("other").alias("a_c"), F.col("block").alias("b_c"), F.col("id").alias("id_c"), F.col("embedding").alias("embedding_c"))
    kind = queries.schema["id"].dataType.simpleString()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = left.schema.field("id").type
        empty = pa.table({"entity_id": pa.array([], kinds), "candidate_id": pa.array([], kinds), "embedding_score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        right_id = right.column("id_c").combine_chunks()
        at = np.argsort(right_id.to_numpy(zero_copy_only=False), kind="stable")
        right = right.take(pa.array(at))
        one, other = _units(left.column("embedding")), _units(right.column("embedding_c"))
        parts = [empty]
        for dim in sorted(set(one) & set(other)):
            (i, x), (j, y) = one[dim], other[dim]
            for s in range(0, len(i), ROWS):
                scores = np.round(x[s : s + ROWS] @ y.T, 6)
                rows, cols = _best(scores, k)
                ids = left.column("id").combine_chunks().take(pa.array(i[s : s + ROWS][rows])), right.column("id_c").combine_chunks().take(pa.array(j[cols]))
                parts.append(pa.table({"entity_id": ids[0], "candidate_id": ids[1], "embedding_score": pa.array(scores[rows, cols])}))
        return pa.concat_tables(parts)

    found = q.groupBy("part", "a", "b").cogroup(c.groupBy("part_c", "a_c", "b_c")).applyInArrow(best, f"entity_id {kind}, candidate_id {kind}, embedding_score double")
    return top_candidates(found, k, F.desc("embedding_score"))


def encoder_text(records: DataFrame) -> DataFrame:
    """entity_id and the text an encoder gets, name and address; its vectors come back as a column embedding."""
    return records.select("entity_id", F.trim(F.concat_ws(" ", "business_name", "business_address")).alias("text"))


def embedding_candidates(norm_ids: DataFrame, embedded: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest records of the other sources of each source-1 record of its country, from records (entity_id, source, country) and vectors (entity_id, embedding)."""
    rows = norm_ids.select("entity_id", "source", "country").join(embedded.select("entity_id", "embedding"), "entity_id").withColumnRenamed("entity_id", "id")
    return neighbours(rows.where("source = 1"), rows.where("source <> 1"), k, by="country")


def merged(keys: DataFrame, embedded: DataFrame) -> DataFrame:
    """Key candidates and embedding candidates: embedding counts as one more key; its score is null for pairs found by keys only."""
    rows = keys.join(embedded, ["entity_id", "candidate_id"], "full")
    near = F.col("embedding_score").isNotNull()
    return rows.select(
        "entity_id", "candidate_id",
        F.when(F.col("match_keys").isNull(), F.lit("embedding")).when(near, F.concat("match_keys", F.lit(",embedding"))).otherwise(F.col("match_keys")).alias("match_keys"),
        (F.coalesce("n_keys", F.lit(0)) + near.cast("int")).alias("n_keys"), "embedding_score",
    )
