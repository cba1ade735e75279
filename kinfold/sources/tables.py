"""Records and truth derived from the test tables: names and truth come from whole texts, addresses from the other columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"  # ASCII letters and everything beyond ASCII
LONGEST_WORD = 20
NAME_WORDS, TRUTH_WORDS = 3, 12
INDIC = "कमल"  # every seventh record's name has a word of another script


_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))  # WORD over bytes: what else is ASCII becomes a space


def longest(words: set, n: int) -> list:
    """The n longest of at most LONGEST_WORD letters, by length and then alphabet."""
    return sorted(sorted(w for w in words if len(w) <= LONGEST_WORD), key=len, reverse=True)[:n]


def _longest_words(n: int):
    def run(text: pa.Array) -> pa.Array:
        text = text.cast(pa.large_string())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1].tolist()
        data = text.buffers()[2]
        data, first = (data.to_pybytes()[at[0] : at[-1]] if data is not None else b"").translate(_LETTERS), at[0]
        out = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            own = data[lo - first : hi - first]
            if own.isascii():  # words of bytes: as long as their letters
                out.append(b" ".join(longest({*own.split()}, n)).decode())
            else:
                out.append(" ".join(longest({w.decode("utf-8", "replace") for w in {*own.split()}}, n)))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")


def longest_words(text: Column, n: int) -> Column:
    """The n longest distinct words of a whole text (none of over LONGEST_WORD letters), by length and then alphabet, joined by spaces.

    In Python: as expressions of regular words, arrays and their order it took twelve times the time.
    """
    return _longest_words(n)(F.coalesce(text, F.lit("")))


def _id(number: Column) -> Column:
    return F.concat(F.lit("S"), number, F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))


def records(spark: SparkSession, folder: str, noisy: bool = False) -> DataFrame:
    """documents as records of three sources; ``noisy`` changes the names of sources 2 and 3."""
    d = spark.read.parquet(f"{folder}/documents.parquet")
    number = (F.col("doc_id") % 3 + 1).cast("int")
    name = longest_words(F.col("text"), NAME_WORDS)
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(name, F.lit(f" {INDIC}"))).otherwise(name)
    if noisy:
        kind = F.col("doc_id") % 5
        changed = (
            F.when(kind == 0, F.concat(name, F.lit(" LLC"))).when(kind == 1, F.concat(F.lit("Inc "), name)).when(kind == 2, F.concat(name, F.lit(" | www.x.com")))
            .when(kind == 3, F.regexp_replace(name, r"^(\S+) ", "$1 & ")).otherwise(name)
        )
        name = F.when(number == 1, name).otherwise(changed)
    return d.select(
        number.alias("source"),
        _id(number).alias("entity_id"),
        name.alias("business_name"),
        F.concat(F.col("n_chars").cast("string"), F.lit(" "), "source", F.lit(" rd, near "), "lang").alias("business_address"),
        F.col("lang").alias("country"),
    )


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs (entity_id, candidate_id): records of source 1 and of the others of one country whose texts have the same longest words in lower case."""
    d = spark.read.parquet(f"{folder}/documents.parquet")
    number = (F.col("doc_id") % 3 + 1).cast("int")
    rows = d.select(number.alias("source"), _id(number).alias("id"), "lang", longest_words(F.lower("text"), TRUTH_WORDS).alias("words")).where("words <> ''")
    one = rows.where("source = 1").select(F.col("id").alias("entity_id"), "lang", "words")
    other = rows.where("source > 1").select(F.col("id").alias("candidate_id"), "lang", "words")
    return one.join(other, ["lang", "words"]).select("entity_id", "candidate_id")


def record_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """entity_id and embedding of the records whose doc_id is a vec_id."""
    v = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id")
    return d.join(v, "doc_id").select(_id((F.col("doc_id") % 3 + 1).cast("int")).alias("entity_id"), "embedding")
