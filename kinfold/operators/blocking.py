"""Candidate pairs by shared keys.

All four kinds of key are exploded into one relation (source, country, kind, key, entity_id), so that one count, one
anti-join and one join serve them all. A key that too many records of one source share is no key: the count that decides is
aggregated partially, and the cap bounds what any key can join to. The kinds a pair agrees on are bits of one integer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import text as T

#: Kinds of key; their order is that of the bits, and alphabetical.
KINDS = ("addr_number", "name_ngram", "name_prefix", "name_token")

MOST_BROADCAST = 500_000  # keys over the cap that a broadcast may hold


@dataclass(frozen=True)
class Blocking:
    most_candidates: int | None = 150
    least_token: int = 3
    least_digits: int = 2
    kinds: tuple[str, ...] = KINDS
    ngram: int = 4
    cap: int = 400
    number_cap: int = 100


def normalised(records: DataFrame, ngram: int = 4, normalise: bool = True) -> DataFrame:
    """source, entity_id, country and every normalised form of name and address. ``normalise`` False skips Unicode normal forms (no Python then)."""
    name, address = F.col("business_name"), F.col("business_address")
    rows = records.select(
        "source", "entity_id", "country", T.clean_name(name, normalise).alias("name_clean"), T.clean_address(address, normalise).alias("addr_clean"),
        T.numbers(address).alias("addr_numbers"), T.script_flags(F.concat_ws(" ", T.present(name), T.present(address))).alias("scripts"),
    )
    clean, addr = F.col("name_clean"), F.col("addr_clean")
    rows = rows.select(
        "*", T.core_name(clean).alias("name_core"), T.legal_forms(clean).alias("name_suffix"), T.words(clean).alias("name_tokens"),
        T.address_words(addr).alias("addr_tokens"), T.landmark(addr).alias("landmark"), (T.ascii_fold(clean) if normalise else clean).alias("name_ascii"),
    )
    return rows.select("*", T.char_ngrams(F.col("name_core"), ngram).alias("name_ngrams"))


def _long(keys: Column, least: int) -> Column:
    return F.filter(keys, lambda k: F.length(k) >= least)


def postings(norm: DataFrame, cfg: Blocking = Blocking()) -> DataFrame:
    """source, country, kind, key, entity_id: a row for each key of a record."""
    keys = {
        "addr_number": _long(F.col("addr_numbers"), cfg.least_digits),
        "name_ngram": F.col("name_ngrams"),
        "name_prefix": F.array_compact(F.array(T.prefix(F.col("name_core")))),
        "name_token": _long(F.col("name_tokens"), cfg.least_token),
    }
    marked = lambda k: F.transform(_long(keys[k], 1), lambda x: F.struct(F.lit(KINDS.index(k)).alias("kind"), x.alias("key")))
    every = [marked(k) for k in cfg.kinds]
    return norm.select("source", "country", "entity_id", F.explode(F.concat(*every)).alias("k")).select("source", "country", "k.kind", "k.key", "entity_id")


def capped(rows: DataFrame, cfg: Blocking = Blocking()) -> DataFrame:
    """Postings without the keys that more records of their source and country share than the cap of their kind.

    The keys over the cap are few (their number is checked), so the postings, the hot ones above all, are not shuffled to drop them.
    """
    by = ["source", "country", "kind", "key"]
    over = over_cap(rows, cfg)
    few = over.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(over) if few else over, by, "left_anti")


def over_cap(rows: DataFrame, cfg: Blocking = Blocking()) -> DataFrame:
    """source, country, kind, key of the keys that too many records share: at most rows / cap of them, counted by a partial aggregate."""
    cap = F.when(F.col("kind") == KINDS.index("addr_number"), cfg.number_cap).otherwise(cfg.cap)
    return rows.groupBy("source", "country", "kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).drop("n")


def key_pairs(rows: DataFrame) -> DataFrame:
    """entity_id, candidate_id, kinds (a bit for each kind of key that agrees) of source 1 against the others."""
    one = rows.where("source = 1").select("country", "kind", "key", "entity_id")
    other = rows.where("source <> 1").select("country", "kind", "key", F.col("entity_id").alias("candidate_id"))
    pairs = one.join(other, ["country", "kind", "key"])
    return pairs.groupBy("entity_id", "candidate_id").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))


def found_of(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of the truth that share a key of these (capped) postings, found from the truth: no other candidate pair is made."""
    by = ["country", "kind", "key"]
    one = truth.join(rows.where("source = 1").select("entity_id", *by), "entity_id")
    other = rows.where("source <> 1").select(F.col("entity_id").alias("candidate_id"), *by)
    return one.join(other, ["candidate_id", *by], "left_semi").select("entity_id", "candidate_id").distinct()


def true_pairs(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``key_pairs`` that are pairs of the truth, found from the truth as well."""
    by = ["country", "kind", "key"]
    one = truth.select("entity_id", "candidate_id").distinct().join(rows.where("source = 1").select("entity_id", *by), "entity_id")
    other = rows.where("source <> 1").select(F.col("entity_id").alias("candidate_id"), *by)
    return one.join(other, ["candidate_id", *by]).groupBy("entity_id", "candidate_id").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))


def any_pair(rows: DataFrame, entities: DataFrame) -> bool:
    """Whether these entities have any candidate."""
    by = ["country", "kind", "key"]
    one = rows.where("source = 1").join(entities.select("entity_id"), "entity_id", "left_semi")
    return not one.join(rows.where("source <> 1").select(*by), by, "left_semi").isEmpty()


def rendered(pairs: DataFrame) -> DataFrame:
    """match_keys (names of the kinds, comma-joined) and n_keys instead of kinds."""
    names = [F.when(F.col("kinds").bitwiseAND(1 << b) != 0, F.lit(k)) for b, k in enumerate(KINDS)]
    rest = [c for c in pairs.columns if c != "kinds"]
    return pairs.select(*rest, F.concat_ws(",", *names).alias("match_keys"), F.bit_count("kinds").cast("int").alias("n_keys"))


def candidates(norm: DataFrame, cfg: Blocking = Blocking()) -> DataFrame:
    """All candidate pairs: entity_id, candidate_id, match_keys, n_keys."""
    return rendered(key_pairs(capped(postings(norm, cfg), cfg)))


def top_candidates(pairs: DataFrame, most: int | None, *order: Column) -> DataFrame:
    """The best pairs of each entity, by n_keys unless an order is given; ties by candidate_id. None keeps all."""
    if most is None:
        return pairs
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(*(order or (F.desc("n_keys"),)), "candidate_id"))
    return pairs.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def ranked(pairs: DataFrame, *order: Column) -> DataFrame:
    """With each pair's place among its entity's as rank, from 1."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(*(order or (F.desc("n_keys"),)), "candidate_id")))
