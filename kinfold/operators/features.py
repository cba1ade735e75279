"""Features of candidate pairs: one projection over two joins, and one Arrow UDF for the string ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import similarity as S
from kinfold.functions import text as T

PRE_RANK = (
    "n_keys", "matched_by_token", "matched_by_prefix", "matched_by_number", "matched_by_ngram", "name_exact_clean", "name_exact_core",
    "name_exact_ascii", "name_token_jaccard", "name_char_jaccard", "addr_number_any_shared",
)
RATIOS = ("name_levenshtein_ratio", "name_token_sort_ratio", "name_partial_ratio", "addr_levenshtein_ratio", "addr_token_sort_ratio")
NATIVE = (
    *PRE_RANK, "name_first_token_match", "name_len_ratio", "name_len_diff", "has_suffix_s1", "has_suffix_cand", "suffix_equal",
    "addr_token_jaccard", "addr_number_jaccard", "addr_len_ratio", "both_have_address", "both_indic_script", "script_mismatch",
    "embedding_score", "has_embedding_score",
)
ALL = (*NATIVE, *RATIOS)

_FORMS = ("name_clean", "name_core", "name_suffix", "name_ascii", "name_tokens", "name_ngrams", "addr_clean", "addr_tokens", "addr_numbers")


def joined(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """Pairs with the forms of the entity (…_a) and the candidate (…_b)."""
    side = lambda key, s: norm.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{s}") for c in _FORMS])
    return pairs.join(side("entity_id", "a"), "entity_id").join(side("candidate_id", "b"), "candidate_id")


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def native(columns: list[str]) -> dict[str, Column]:
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    same = lambda c: _flag((a(c) == b(c)) & (a(c) != ""))
    by = lambda k: _flag(F.contains(F.col("match_keys"), F.lit(k)))
    word = lambda c: F.split(c, " ")[0]
    score = F.col("embedding_score") if "embedding_score" in columns else F.lit(None).cast("double")
    score = F.when(~F.isnan(score), score)
    indic_a = T.has_indic(a("name_clean")) & (F.size(a("name_tokens")) > 0)
    indic_b = T.has_indic(b("name_clean"))
    return {
        "n_keys": F.col("n_keys"),
        "matched_by_token": by("name_token"), "matched_by_prefix": by("name_prefix"), "matched_by_number": by("addr_number"), "matched_by_ngram": by("name_ngram"),
        "name_exact_clean": same("name_clean"), "name_exact_core": same("name_core"), "name_exact_ascii": same("name_ascii"),
        "name_token_jaccard": S.jaccard(a("name_tokens"), b("name_tokens")), "name_char_jaccard": S.jaccard(a("name_ngrams"), b("name_ngrams")),
        "addr_number_any_shared": _flag(F.arrays_overlap(a("addr_numbers"), b("addr_numbers"))),
        "name_first_token_match": _flag((a("name_core") != "") & (word(a("name_core")) == word(b("name_core")))),
        "name_len_ratio": S.length_ratio(a("name_core"), b("name_core")), "name_len_diff": F.abs(F.length(a("name_core")) - F.length(b("name_core"))),
        "has_suffix_s1": _flag(a("name_suffix") != ""), "has_suffix_cand": _flag(b("name_suffix") != ""), "suffix_equal": same("name_suffix"),
        "addr_token_jaccard": S.jaccard(a("addr_tokens"), b("addr_tokens")), "addr_number_jaccard": S.jaccard(a("addr_numbers"), b("addr_numbers")),
        "addr_len_ratio": S.length_ratio(a("addr_clean"), b("addr_clean")), "both_have_address": _flag((a("addr_clean") != "") & (b("addr_clean") != "")),
        "both_indic_script": _flag(indic_a & indic_b), "script_mismatch": _flag(indic_a != indic_b),
        "embedding_score": score, "has_embedding_score": _flag(score.isNotNull()),
    }


def features(pairs: DataFrame, norm: DataFrame, wanted: tuple[str, ...] = ALL) -> DataFrame:
    """entity_id, candidate_id, label (if there) and the wanted features. Without ratios among them no Python runs."""
    rows, exprs = joined(pairs, norm), native(pairs.columns)
    ids = [c for c in ("entity_id", "candidate_id", "label") if c in pairs.columns]
    if set(wanted) & set(RATIOS):
        rows = rows.withColumn("_r", S.string_ratios("name_core_a", "name_core_b", "addr_clean_a", "addr_clean_b"))
        exprs |= {c: F.col(f"_r.{c}") for c in RATIOS}
    return rows.select(*ids, *[exprs[c].alias(c) for c in wanted])


#: The weights of three linear rankings by hand.
HAND_WEIGHTS = {
    "exact_name_address": {
        "name_exact_clean": 1000.0, "name_exact_core": 900.0, "name_exact_ascii": 800.0, "name_token_jaccard": 100.0, "name_char_jaccard": 100.0,
        "name_levenshtein_ratio": 50.0, "addr_token_jaccard": 40.0, "addr_number_jaccard": 30.0, "addr_number_any_shared": 20.0, "n_keys": 10.0,
    },
    "keys_and_names": {
        "n_keys": 100.0, "name_exact_clean": 40.0, "name_exact_core": 35.0, "name_exact_ascii": 30.0, "name_token_jaccard": 25.0, "name_char_jaccard": 25.0,
        "name_levenshtein_ratio": 20.0, "name_token_sort_ratio": 15.0, "name_partial_ratio": 10.0, "addr_token_jaccard": 10.0, "addr_number_jaccard": 10.0,
        "addr_number_any_shared": 5.0,
    },
    "precise_exact_address": {
        "n_keys": 100.0, "name_exact_clean": 150.0, "name_exact_core": 140.0, "name_exact_ascii": 130.0, "addr_number_any_shared": 40.0, "addr_number_jaccard": 35.0,
        "name_token_jaccard": 30.0, "name_char_jaccard": 30.0, "addr_token_jaccard": 25.0, "name_levenshtein_ratio": 20.0,
    },
}


def weighted(rows: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """With a linear score of features."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * F.lit(w)
    return rows.withColumn(name, total)
