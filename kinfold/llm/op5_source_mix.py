"""Operator 5: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into BLOCKS blocks by a hash. A source's target buys it a quota of blocks: every block once for
each whole copy of the source, then blocks in a permuted order up to the rest; the last of these gives its documents in a permuted
order, and the last document its leading words, so the taken words meet the target. The quotas of all sources are the
colours of an urn that a binary tree deals to the output shards: each node draws half of its blocks without replacement for its left
child (which makes the sources' counts multivariate hypergeometric) and leaves the rest to the right one. A source's shards then draw
disjoint runs of its permuted blocks, and every shard is shuffled locally.

DataFrame functions only. Documents are never sorted or windowed as a whole: the windows run over blocks (sources times blocks, a power
of two that follows the number of documents within bounds) and over the one block of a source that is cut, without its texts. A hot source
costs no more rows there than any other. The urn's first level stands in one window: narrow rows, two for each block at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import keep, partitions

BLOCKS, MOST_BLOCKS, BLOCK_DOCUMENTS = 256, 1 << 14, 4096  # blocks of a source: a power of two that follows the documents, so the cut one stays small
LEVELS, MOST_LEVELS, SHARD_DOCUMENTS = 5, 14, 1 << 16  # output shards: 2 to the power of the levels, which follow the documents
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
SEED = 17

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _power(documents: int, each: int, least: int, most: int) -> int:
    """The least power of two, within bounds, of parts of ``each`` documents."""
    return min(most, max(least, 1 << max(0, (max(1, documents) - 1) // each).bit_length()))


def _sized(documents: DataFrame, options: dict) -> dict:
    """The options, blocks and levels by the number of documents where they are not given."""
    n = None if {"blocks", "levels"} <= set(options) else documents.count()
    return {"blocks": n and _power(n, BLOCK_DOCUMENTS, BLOCKS, MOST_BLOCKS), "levels": n and _power(n, SHARD_DOCUMENTS, 1 << LEVELS, 1 << MOST_LEVELS).bit_length() - 1} | options


def _source_key(source: Column) -> Column:
    """Equal for equal sources, null included."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source))


def _block(doc_id: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(blocks)).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """key, source_size, target from key, source, source_size: shares of the total by weight, capped, the excess reshared by weight.

    With the sources in order of cap / weight, those below some place are capped and the others get their weight times one level.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    whole = Window.partitionBy()
    rows = rows.withColumn("total", share * F.sum("source_size").over(whole))
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("total") - below) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("at"))).over(whole))
    return rows.select("key", "source_size", F.least("cap", F.greatest(F.lit(0.0), F.coalesce("level", F.lit(0.0))) * F.col("w")).alias("target"))


def plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES, blocks: int = BLOCKS, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """For each source (key) and block: source_size, target, whole (shards of its whole draws), rest (words of a draw in part), rest_shard."""
    sized = documents.select("source", _block(F.col("doc_id"), blocks, seed).alias("block"), size_of(F.col("text")).alias("size"))
    block = keep(sized.groupBy("source", "block").agg(F.sum("size").alias("block_size")).withColumn("key", _source_key(F.col("source"))), "blocks")
    source = targets(block.groupBy("key", "source").agg(F.sum("block_size").alias("source_size")), weights, share, most)
    source = source.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)).cast("int"))
    source = source.withColumn("left", F.round("target").cast("long") - F.col("copies") * F.col("source_size"))

    draw = block.select("key", "block", "block_size").join(source, "key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies"))))
    turn = Window.partitionBy("key", "epoch").orderBy(F.xxhash64("key", "epoch", "block", F.lit(seed + 1)), "block")
    draw = draw.withColumn("turn", F.row_number().over(turn)).withColumn("before", F.coalesce(F.sum("block_size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    draw = draw.where((F.col("epoch") < F.col("copies")) | (F.col("before") < F.col("left")))
    draw = draw.withColumn("take", F.when(F.col("epoch") < F.col("copies"), F.col("block_size")).otherwise(F.least("block_size", F.col("left") - F.col("before"))))
    draw = draw.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("epoch", "turn")))
    draw = keep(draw.select("key", "block", "block_size", "epoch", "take", "pos"), "draws")

    urn = draw.groupBy("key").agg(F.max("pos").alias("quota")).select("key", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("ball"), F.lit(0).alias("node"))
    for level in range(levels):
        node = Window.partitionBy("node")
        drawn = F.row_number().over(node.orderBy(F.xxhash64("key", "ball", F.lit(seed + 2 + level)), "key", "ball"))
        urn = urn.withColumn("node", 2 * F.col("node") + (2 * drawn > F.count(F.lit(1)).over(node) + F.col("node") % 2).cast("int"))
    dealt = urn.select("key", F.col("node").alias("shard"), F.row_number().over(Window.partitionBy("key").orderBy("node", "ball")).alias("pos"))

    drawn = draw.join(dealt, ["key", "pos"]).withColumn("part", F.col("take") < F.col("block_size"))
    per_block = drawn.groupBy("key", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("part"), F.struct("epoch", "shard")))), lambda d: d["shard"]).alias("whole"),
        F.max(F.when(F.col("part"), F.col("take"))).alias("rest"),
        F.max(F.when(F.col("part"), F.col("shard"))).alias("rest_shard"),
    )
    out = block.select("key", "block").join(source.select("key", "source_size", "target"), "key").join(per_block, ["key", "block"], "left")
    return keep(out.withColumn("whole", F.coalesce("whole", F.array().cast("array<int>"))), "plan")


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents (all columns; doc_id, text and source are used) as a column ``doc``, with what the mix takes of each.

    size is the number of words (runs of anything but ASCII white space; 0 for null and empty texts); source_size and target
    are those of the source (null is a source, the last in order); whole has the shard of each whole copy, rest the leading
    words taken besides and rest_shard their shard (null if none); taken = size * size(whole) + rest. No document gives
    more than ``most`` copies; the taken words of a source are its target, rounded. A source without words has target 0. Repeated rows
    and rows with null ids are drawn like others, so the result depends on the rows alone, not on their order.
    """
    options = _sized(documents, options)
    blocks, seed = options["blocks"], options.get("seed", SEED)
    table = plan(documents, **options)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    rows = rows.select("doc", size_of(F.col("doc.text")).alias("size"), _source_key(F.col("doc.source")).alias("key"), _block(F.col("doc.doc_id"), blocks, seed).alias("block"))
    rows = rows.join(table, ["key", "block"])
    uncut = rows.where("rest IS NULL")
    # The cut block's order is found on hashes and sizes; the texts only meet what they give.
    same = ["key", "id", "size", "text"]
    cut = rows.where("rest IS NOT NULL").withColumns({"id": F.struct(F.xxhash64("doc.doc_id", F.lit(seed + 100)), "doc.doc_id"), "text": F.xxhash64("doc.text")})
    narrow = keep(cut.groupBy(*same).agg(F.max("rest").alias("rest"), F.count(F.lit(1)).alias("equal")), "cut")
    turn = Window.partitionBy("key").orderBy("id", "size", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("equal")).over(turn), F.lit(0))
    narrow = narrow.select(*[F.col(c).alias(f"n_{c}") for c in same], "equal", (F.col("rest") - before).alias("left"))
    cut = cut.join(narrow, F.expr(" AND ".join(f"{c} <=> n_{c}" for c in same))).withColumn("rest", F.col("left"))
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))) - 1  # equal rows give one after another
    cut = cut.where("equal = 1").unionByName(cut.where("equal > 1").withColumn("rest", F.col("left") - nth * F.col("size")))
    cut = cut.withColumn("rest", F.greatest(F.lit(0), F.least("size", "rest")))
    rows = uncut.unionByName(cut.select(uncut.columns))
    return rows.select("doc", "size", "source_size", "target", "whole", "rest", "rest_shard", (F.col("size") * F.size("whole") + F.coalesce("rest", F.lit(0))).alias("taken"))


def shuffled(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: documents' columns, a row for each copy taken, shard by shard and in a permuted order within each.

    A document taken in part keeps its leading words, joined by single spaces; one taken whole keeps its text as it is. Documents of
    which no word is taken are left out, those without words stay with their block.
    """
    options = _sized(documents, options)
    seed = options.get("seed", SEED)
    rows = mixed(documents, **options)
    copies = F.transform("whole", lambda s: F.struct(s.alias("shard"), F.lit(None).cast("long").alias("words")))
    rest = F.when(F.col("rest") > 0, F.array(F.struct(F.col("rest_shard").alias("shard"), F.when(F.col("rest") < F.col("size"), F.col("rest")).alias("words")))).otherwise(F.array())
    rows = rows.select("doc", F.posexplode(F.concat(copies, rest)).alias("nth", "copy"))
    leading = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), 1, F.col("copy.words").cast("int")), " ")
    columns = [F.when(F.col("copy.words").isNull(), F.col("doc.text")).otherwise(leading).alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in documents.columns]
    order = F.xxhash64("doc.doc_id", "nth", F.lit(seed + 200))
    spread = F.pmod(order, F.lit(8))  # a shard is written by several tasks
    rows = rows.select("copy", order.alias("order"), spread.alias("spread"), F.struct(*columns).alias("doc"))
    rows = rows.repartition(max(partitions(documents.sparkSession), 2 << options["levels"]), F.col("copy.shard"), F.col("spread")).sortWithinPartitions("copy.shard", "order")
    return rows.select(*[F.col(f"doc.`{c}`") for c in documents.columns])
