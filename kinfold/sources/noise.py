"""Noisy copies of clean records, for tests of the whole flow.

Everything that is random is a hash of the record's id, the copy's number and a seed, so the table is the same at any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SINGLETONS = 0.054
NO_ADDRESS = 0.08
MOST_COPIES = 4
LANDMARKS = (" near station", " opp. market", " behind school")
FORMS = (" LLC", " Inc", " Pvt Ltd", " Group", " SARL")


def _u(seed: int, step: int) -> Column:
    return F.pmod(F.xxhash64("entity_id", "copy", F.lit(seed), F.lit(step)), F.lit(1_000_000)) / 1_000_000


def _typo(text: Column, seed: int, step: int) -> Column:
    """One character left out, doubled or exchanged with the next."""
    at = (F.floor(_u(seed, step) * F.greatest(F.length(text) - 1, F.lit(1))) + 1).cast("int")
    head, one, two, rest = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1)), F.substring(text, at + 2, F.length(text))
    kind = _u(seed, step + 100)
    changed = F.when(kind < 0.34, F.concat(head, two, rest)).when(kind < 0.67, F.concat(head, one, one, two, rest)).otherwise(F.concat(head, two, one, rest))
    return F.when(F.length(text) > 3, changed).otherwise(text)


def _shuffled(address: Column, seed: int) -> Column:
    """The comma-separated parts in another order."""
    parts = F.transform(F.split(address, r",\s*"), lambda p, i: F.struct(F.xxhash64(p, i, F.col("entity_id"), F.col("copy"), F.lit(seed)).alias("k"), p.alias("p")))
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["p"]), ", ")


def _dropped(address: Column, seed: int) -> Column:
    """Without one of several comma-separated parts."""
    parts = F.split(address, r",\s*")
    gone = (_u(seed, 16) * F.size(parts)).cast("int")
    return F.when(F.size(parts) > 1, F.array_join(F.filter(parts, lambda p, i: i != gone), ", ")).otherwise(address)


def noisy_copies(clean: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Records of sources 2 and 3 for the records of source 1 in clean, and the truth (entity_id, candidate_id).

    A share of the entities has no copy, the others one to four. Names get typing errors, legal forms at either end, ampersands, another case or a trailer;
    addresses abbreviations, their parts in another order or one less, a landmark more, or are missing.
    """
    one = clean.where("source = 1").withColumn("copy", F.lit(0))
    many = F.when(_u(seed, 0) < SINGLETONS, F.lit(0)).otherwise(F.floor(_u(seed, 1) * MOST_COPIES) + 1).cast("int")
    rows = one.withColumn("n", many).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    name, address = F.col("business_name"), F.col("business_address")
    name = F.when(_u(seed, 2) < 0.4, _typo(name, seed, 3)).otherwise(name)
    name = F.when(_u(seed, 4) < 0.3, F.replace(name, F.lit(" and "), F.lit(" & "))).otherwise(name)
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.floor(_u(seed, 5) * len(FORMS)) + 1).cast("int"))
    name = F.when(_u(seed, 6) < 0.4, F.concat(name, form)).otherwise(name)
    name = F.when(_u(seed, 12) < 0.1, F.concat(F.lit("M/s "), name)).otherwise(name)
    name = F.when(_u(seed, 7) < 0.2, F.upper(name)).when(_u(seed, 7) < 0.4, F.lower(name)).otherwise(name)
    name = F.when(_u(seed, 8) < 0.15, F.concat(name, F.lit(" | www.example.com"))).otherwise(name)
    address = F.when(_u(seed, 9) < NO_ADDRESS, F.lit("")).when(_u(seed, 10) < 0.4, F.regexp_replace(address, r"\broad\b", "rd.")).otherwise(address)
    address = F.when(_u(seed, 13) < 0.15, _shuffled(address, seed)).when(_u(seed, 13) < 0.3, _dropped(address, seed)).otherwise(address)
    mark = F.element_at(F.array(*[F.lit(m) for m in LANDMARKS]), (F.floor(_u(seed, 14) * len(LANDMARKS)) + 1).cast("int"))
    address = F.when((_u(seed, 15) < 0.15) & (address != ""), F.concat(address, mark)).otherwise(address)
    source = (F.pmod(F.xxhash64("entity_id", "copy", F.lit(seed)), F.lit(2)) + 2).cast("int")
    rows = rows.withColumn("business_name", name).withColumn("business_address", address).withColumn("of", F.col("entity_id"))
    rows = rows.withColumn("source", source).withColumn("entity_id", F.concat(F.lit("S"), source, F.lit("-"), F.substring("of", 4, 100), F.lit("x"), F.col("copy")))
    return rows.select(*clean.columns), rows.select(F.col("of").alias("entity_id"), F.col("entity_id").alias("candidate_id"))
