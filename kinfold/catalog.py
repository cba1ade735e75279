"""Named queries over a data folder, and the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import similarity as S
from kinfold.functions import text as T
from kinfold.operators import blocking, blockwise, features, metric, outputs, pairs, vectors
from kinfold.operators.blocking import Blocking
from kinfold.plans import diagnostics, linkage
from kinfold.runtime import keep
from kinfold.sources.tables import INDIC, LONGEST_WORD, NAME_WORDS, TRUTH_WORDS, WORD, record_vectors, records, truth

TIGHT = Blocking(cap=20, number_cap=10)  # the default caps don't bind on the small test tables
WIDE = Blocking()
SWEEP = (5, 10, 20, 60, 150, 300)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL building blocks

_PUNCT = T.PUNCTUATION
_LEGAL = "(^|\\x01)(" + "|".join(sorted(T.LEGAL_FORMS, key=len, reverse=True)).replace(" ", "\\x01 \\x01") + ")(\\x01|$)"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ABBREVIATIONS.items()) + "}"


def _longest_sql(text: str, n: int) -> str:
    words = f"list_filter(list_distinct(regexp_extract_all(coalesce({text}, ''), '{WORD}')), lambda w: length(w) <= {LONGEST_WORD})"
    return f"array_to_string(list_transform(list_sort(list_transform({words}, lambda w: {{'n': -length(w), 'w': w}}))[1:{n}], lambda x: x.w), ' ')"


_NAME = f"(CASE WHEN doc_id % 7 = 0 THEN name0 || ' {INDIC}' ELSE name0 END)"
_ID = "'S' || (doc_id % 3 + 1) || '-' || lpad(doc_id::VARCHAR, 8, '0')"


def _records_sql(noisy: bool) -> str:
    name = _NAME
    if noisy:
        name = (
            f"CASE WHEN doc_id % 3 = 0 THEN {_NAME} WHEN doc_id % 5 = 0 THEN {_NAME} || ' LLC' WHEN doc_id % 5 = 1 THEN 'Inc ' || {_NAME} "
            f"WHEN doc_id % 5 = 2 THEN {_NAME} || ' | www.x.com' WHEN doc_id % 5 = 3 THEN regexp_replace({_NAME}, '^(\\S+) ', '\\1 & ') ELSE {_NAME} END"
        )
    return (
        f"r AS (SELECT (doc_id % 3 + 1)::INT AS source, {_ID} AS entity_id, {name} AS business_name, "
        f"n_chars || ' ' || d0.source || ' rd, near ' || lang AS business_address, lang AS country FROM (SELECT *, {_longest_sql('text', NAME_WORDS)} AS name0 FROM documents) d0)"
    )


def _norm_sql(noisy: bool = False) -> str:
    web = r"(?i)https?://\S+|\bwww\.\S+|[\p{L}\p{N}_][\p{L}\p{N}_-]*\.(?:com|net|org|in|co|fr|io)\b"
    blank = " " * len(_PUNCT)
    return f"""{_records_sql(noisy)},
n1 AS (SELECT *, regexp_replace(business_name, '(?s)\\s*\\|.*', '') AS t0 FROM r),
n2 AS (SELECT *, regexp_replace(t0, '{web}', ' ', 'g') AS bare FROM n1),
n3 AS (SELECT *, CASE WHEN regexp_matches(bare, '\\S') THEN bare ELSE t0 END AS t2 FROM n2),
n4 AS (SELECT *, regexp_replace(regexp_replace(t2, '#([\\p{{L}}\\p{{N}}_]+)', '\\1', 'g'), '\\s*&\\s*', ' and ', 'g') AS t4 FROM n3),
n5 AS (SELECT source, entity_id, country, business_address,
  lower(trim(regexp_replace(translate(t4, '{_PUNCT}', '{blank}'), '\\s+', ' ', 'g'))) AS name_clean,
  list_filter(string_split(trim(regexp_replace(translate(lower(business_address), '{_PUNCT}', '{blank}'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS aw FROM n4),
n6 AS (SELECT *, regexp_replace(name_clean, '([^\\p{{L}}\\p{{N}}_])', '\x01\\1\x01', 'g') AS m,
  array_to_string(list_transform(aw, lambda w: coalesce({_MAP}[w], w)), ' ') AS addr_clean FROM n5),
n7 AS (SELECT *, list_transform(regexp_extract_all(m, '{_LEGAL}', 2), lambda x: replace(x, '\x01', '')) AS forms,
  regexp_replace(trim(regexp_replace(replace(regexp_replace(m, '{_LEGAL}', '\\1 \\3', 'g'), '\x01', ''), '\\s+', ' ', 'g')), '^[\\s''-]+|[\\s''-]+$', '', 'g') AS core0 FROM n6),
n8 AS (SELECT *, CASE WHEN len(forms) > 0 AND core0 <> '' THEN core0 ELSE name_clean END AS name_core,
  array_to_string(list_filter(forms, lambda x, i: list_position(forms, x) = i), ',') AS name_suffix FROM n7),
norm AS (SELECT source, entity_id, country, name_clean, name_core, name_suffix, strip_accents(name_clean) AS name_ascii,
  list_distinct(list_filter(string_split(name_clean, ' '), lambda w: length(w) >= 2)) AS name_tokens,
  list_distinct([substr('  ' || name_core || '  ', i, 4) for i in range(1, length(name_core) + 2)]) AS name_ngrams, addr_clean,
  list_distinct(list_filter(string_split(addr_clean, ' '), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '\\d+'))) AS addr_tokens,
  list_distinct(regexp_extract_all(business_address, '\\d+')) AS addr_numbers,
  regexp_extract(addr_clean, '(?i)\\b(near|opp|opposite|behind|next to|beside|adjacent to)\\b\\s+[^,]+', 0) AS landmark FROM n8)"""


def _pairs_sql(cfg: Blocking, kinds: tuple[str, ...] = blocking.KINDS, noisy: bool = False) -> str:
    key = {
        "addr_number": f"list_filter(addr_numbers, lambda x: length(x) >= {cfg.least_digits})", "name_ngram": "name_ngrams",
        "name_prefix": "CASE WHEN length(substr(name_core, 1, 4)) >= 3 THEN [substr(name_core, 1, 4)] ELSE [] END",
        "name_token": f"list_filter(name_tokens, lambda x: length(x) >= {cfg.least_token})",
    }
    every = " UNION ALL ".join(f"SELECT source, country, entity_id, {blocking.KINDS.index(k)} AS kind, unnest({key[k]}) AS key FROM norm" for k in kinds)
    return f"""{_norm_sql(noisy)},
k0 AS ({every}),
k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY source, country, kind, key) AS n FROM k0) WHERE n <= CASE WHEN kind = 0 THEN {cfg.number_cap} ELSE {cfg.cap} END),
p0 AS (SELECT a.entity_id, b.entity_id AS candidate_id, bit_or(1 << a.kind) AS kinds FROM k a JOIN k b ON a.country = b.country AND a.kind = b.kind AND a.key = b.key
  WHERE a.source = 1 AND b.source <> 1 GROUP BY ALL),
p AS (SELECT entity_id, candidate_id, concat_ws(',', CASE WHEN kinds & 1 > 0 THEN 'addr_number' END, CASE WHEN kinds & 2 > 0 THEN 'name_ngram' END,
  CASE WHEN kinds & 4 > 0 THEN 'name_prefix' END, CASE WHEN kinds & 8 > 0 THEN 'name_token' END) AS match_keys, bit_count(kinds)::INT AS n_keys FROM p0)"""


_TRUTH_SQL = f"""d AS (SELECT doc_id, {_ID} AS id, lang, {_longest_sql('lower(text)', TRUTH_WORDS)} AS words FROM documents),
gt AS (SELECT DISTINCT a.id AS entity_id, b.id AS candidate_id, a.lang AS country FROM d a JOIN d b ON a.lang = b.lang AND a.words = b.words WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0 AND a.words <> '')"""

_ENTITIES_SQL = f"e AS (SELECT {_ID} AS entity_id, lang AS country FROM documents WHERE doc_id % 3 = 0)"
_JACCARD = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def _jaccard_sql(c: str) -> str:
    return _JACCARD.format(a=f"a.{c}", b=f"b.{c}")


_LABELLED_SQL = f"{_pairs_sql(WIDE)},\n{_TRUTH_SQL},\n{_ENTITIES_SQL},\nlab AS (SELECT p.*, (gt.entity_id IS NOT NULL)::INT AS label FROM p LEFT JOIN gt USING (entity_id, candidate_id))"
_SCORES_SQL = f"""{_pairs_sql(WIDE)},\n{_TRUTH_SQL},\n{_ENTITIES_SQL},
top AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n_keys DESC, candidate_id) <= 150),
s AS (SELECT top.entity_id, top.candidate_id, round({_jaccard_sql('name_tokens')}, 6) AS score FROM top JOIN norm a ON a.entity_id = top.entity_id JOIN norm b ON b.entity_id = top.candidate_id)"""


# ---------------------------------------------------------------- shared steps


def _norm(spark, folder, noisy=False):
    """Written once: counts, joins and features all read it, each the columns it needs."""
    return keep(blocking.normalised(records(spark, folder, noisy)), "norm")


def _raw(spark, folder, cfg=WIDE):
    return blocking.candidates(_norm(spark, folder), cfg)


def _labelled(spark, folder):
    return pairs.labelled(_raw(spark, folder), truth(spark, folder))


def _found(spark, folder):
    """The true pairs among the candidates, label 1."""
    rows = blocking.capped(blocking.postings(_norm(spark, folder), WIDE), WIDE)
    return blocking.found_of(truth(spark, folder), rows).withColumn("label", F.lit(1))


def _entities(spark, folder):
    return records(spark, folder).where("source = 1").select("entity_id")


def _scores(spark, folder):
    norm = _norm(spark, folder)
    top = keep(blocking.top_candidates(blocking.candidates(norm, WIDE), WIDE.most_candidates), "top")
    rows = features.features(top, norm, ("n_keys", "name_token_jaccard"))
    return top, rows.select("entity_id", "candidate_id", "n_keys", F.round("name_token_jaccard", 6).alias("score"))


# ---------------------------------------------------------------- text


@query(f"WITH {_norm_sql(True)} SELECT entity_id, name_clean, name_core, name_suffix FROM norm")
def norm_names(spark, folder):
    return _norm(spark, folder, noisy=True).select("entity_id", "name_clean", "name_core", "name_suffix")


@query(f"WITH {_norm_sql()} SELECT entity_id, addr_clean, array_to_string(list_sort(addr_tokens), ' ') AS addr_tokens, array_to_string(list_sort(addr_numbers), ' ') AS addr_numbers, landmark FROM norm")
def norm_addresses(spark, folder):
    return _norm(spark, folder).select("entity_id", "addr_clean", F.array_join("addr_tokens", " ").alias("addr_tokens"), F.array_join("addr_numbers", " ").alias("addr_numbers"), "landmark")


@query(f"WITH {_norm_sql()} SELECT entity_id, unnest(name_ngrams) AS gram FROM norm")
def char_ngrams(spark, folder):
    return _norm(spark, folder).select("entity_id", F.explode("name_ngrams").alias("gram"))


@query(
    f"WITH {_records_sql(False)}, t AS (SELECT entity_id, business_name || ' ' || business_address AS x FROM r) SELECT entity_id, "
    + ", ".join(f"regexp_matches(x, '[\\x{{{lo:04x}}}-\\x{{{hi:04x}}}]') AS {n}" for n, (lo, hi) in T.SCRIPTS.items())
    + ", regexp_matches(regexp_replace(x, '[\\x00-\\x7F" + "".join(f"\\x{{{lo:04x}}}-\\x{{{hi:04x}}}" for lo, hi in T.SCRIPTS.values()) + "]', '', 'g'), '\\p{L}') AS non_latin_other, regexp_matches(x, '[\\x{0900}-\\x{0D7F}]') AS any_indic FROM t"
)
def script_flags(spark, folder):
    return _norm(spark, folder).select("entity_id", "scripts.*")


# ---------------------------------------------------------------- blocking


def _block(kind: str, cfg: Blocking, name: str):
    one = Blocking(cap=cfg.cap, number_cap=cfg.number_cap, kinds=(kind,))

    def run(spark, folder):
        return _raw(spark, folder, one).select("entity_id", "candidate_id")

    run.__name__ = name
    query(f"WITH {_pairs_sql(one, (kind,))} SELECT entity_id, candidate_id FROM p")(run)


for _kind in blocking.KINDS:
    _block(_kind, TIGHT, f"block_{_kind}")
    _block(_kind, WIDE, f"block_{_kind}_wide")


@query(f"WITH {_pairs_sql(WIDE)} SELECT * FROM p")
def candidates_union(spark, folder):
    return _raw(spark, folder)


@query(f"WITH {_pairs_sql(TIGHT, noisy=True)} SELECT * FROM p")
def candidates_union_tight(spark, folder):
    return blocking.candidates(_norm(spark, folder, noisy=True), TIGHT)


@query(f"WITH {_pairs_sql(TIGHT)} SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n_keys DESC, candidate_id) <= 10")
def candidates_capped(spark, folder):
    return blocking.top_candidates(_raw(spark, folder, TIGHT), 10)


@query(f"WITH {_pairs_sql(WIDE)} SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n_keys DESC, candidate_id) <= 10")
def candidates_capped_wide(spark, folder):
    return blocking.top_candidates(_raw(spark, folder), 10)


# ---------------------------------------------------------------- labels and recall

_RECALL = """SELECT {by} sum(n_true)::BIGINT AS total_true_matches, coalesce(sum(found), 0)::BIGINT AS matches_found_in_candidates, count(*) AS entities_with_matches,
 sum((found >= n_true)::INT)::BIGINT AS entities_fully_recalled, round(sum(found) / sum(n_true), 6) AS pair_level_recall, round(sum((found >= n_true)::INT) / count(*), 6) AS entity_level_full_recall
 FROM (SELECT g.entity_id, any_value(g.country) AS country, count(*) AS n_true, coalesce(any_value(f.found), 0) AS found FROM gt g LEFT JOIN (SELECT entity_id, sum(label) AS found FROM {lab} GROUP BY 1) f ON f.entity_id = g.entity_id GROUP BY 1)"""


@query(f"WITH {_LABELLED_SQL} SELECT * FROM lab")
def labels(spark, folder):
    return _labelled(spark, folder)


@query(f"WITH {_LABELLED_SQL} {_RECALL.format(by='', lab='lab')}")
def blocking_recall(spark, folder):
    return pairs.recall(_found(spark, folder), truth(spark, folder))


@query(f"WITH {_LABELLED_SQL} {_RECALL.format(by='country,', lab='lab')} GROUP BY ROLLUP (country)")
def recall_by_country(spark, folder):
    true = truth(spark, folder).join(records(spark, folder).select("entity_id", "country"), "entity_id")
    found = keep(_found(spark, folder), "found")
    total = pairs.recall(found, true.select("entity_id", "candidate_id")).withColumn("country", F.lit(None).cast("string"))
    return pairs.recall(found, true, "country").unionByName(total)


@query(
    f"WITH {_LABELLED_SQL}, capped AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n_keys DESC, candidate_id) <= 20) "
    f"SELECT *, 'pre_cap' AS stage FROM ({_RECALL.format(by='', lab='lab')}) UNION ALL SELECT *, 'post_cap' FROM ({_RECALL.format(by='', lab='capped')})"
)
def recall_before_and_after_cap(spark, folder):
    return diagnostics.before_and_after_cap(keep(_labelled(spark, folder), "labels"), truth(spark, folder), 20)


@query(
    f"WITH {_LABELLED_SQL}, capped AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n_keys DESC, candidate_id) <= 20) "
    f"SELECT *, 'pre_cap' AS stage FROM ({_RECALL.format(by='country,', lab='lab')} GROUP BY country) UNION ALL SELECT *, 'post_cap' FROM ({_RECALL.format(by='country,', lab='capped')} GROUP BY country)"
)
def cap_report_by_country(spark, folder):
    true = truth(spark, folder).join(records(spark, folder).select("entity_id", "country"), "entity_id")
    return diagnostics.before_and_after_cap(keep(_labelled(spark, folder), "labels"), true, 20, "country")


@query(f"WITH {_LABELLED_SQL}, en AS (SELECT {_ID} AS entity_id, lang AS country FROM documents) SELECT country, count(DISTINCT lab.entity_id) AS entities_with_candidates, count(*) AS candidates FROM lab JOIN en USING (entity_id) GROUP BY country")
def candidate_coverage(spark, folder):
    return diagnostics.candidate_coverage(_raw(spark, folder), records(spark, folder))


_RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {order} candidate_id) AS rank FROM lab), caps AS (SELECT unnest([" + ", ".join(map(str, SWEEP)) + "])::INT AS cap)"


@query(
    f"WITH {_LABELLED_SQL}, {_RANKED.format(order='n_keys DESC,')} SELECT cap, count(*) AS candidates, round(count(*) / (SELECT count(*) FROM e), 6) AS mean_candidates, sum(label)::BIGINT AS found, "
    "(SELECT count(*) FROM gt) AS total_true, round(sum(label) / (SELECT count(*) FROM gt), 6) AS recall FROM rk JOIN caps ON rank <= cap GROUP BY cap"
)
def cap_sweep(spark, folder):
    return diagnostics.cap_sweep(_labelled(spark, folder), truth(spark, folder), _entities(spark, folder), SWEEP)


@query(
    f"WITH {_LABELLED_SQL}, {_RANKED.format(order='n_keys DESC,')} SELECT count(*) AS true_pairs, round(avg(rank), 6) AS rank_mean, round(stddev_samp(rank), 6) AS rank_std, min(rank)::INT AS rank_min, max(rank)::INT AS rank_max, "
    + ", ".join(f"round(quantile_cont(rank, {q}), 6) AS rank_p{round(q * 100)}" for q in (0.25, *diagnostics.QUANTILES))
    + ", sum((n_keys = 1)::INT)::BIGINT AS single_key, sum((n_keys >= 2)::INT)::BIGINT AS multi_key FROM rk WHERE label = 1"
)
def rank_analysis(spark, folder):
    return diagnostics.rank_analysis(_labelled(spark, folder))


@query(
    f"WITH {_LABELLED_SQL}, {_RANKED.format(order='n_keys DESC,')} SELECT cap, sum(label)::BIGINT AS found, (SELECT sum(label)::BIGINT FROM lab) AS found_by_blocking, "
    "round(sum(label) / (SELECT sum(label) FROM lab), 6) AS recall FROM rk JOIN caps ON rank <= cap GROUP BY cap"
)
def recall_of_found(spark, folder):
    return diagnostics.recall_of_found(keep(_labelled(spark, folder), "labels"), SWEEP)


@query(f"WITH {_LABELLED_SQL} SELECT n_keys, count(*) AS true_pairs FROM lab WHERE label = 1 GROUP BY 1")
def keys_histogram(spark, folder):
    return diagnostics.keys_histogram(_labelled(spark, folder))


@query(
    f"WITH {_LABELLED_SQL}, t AS (SELECT *, count(*) OVER (PARTITION BY entity_id, n_keys) AS size, row_number() OVER (PARTITION BY entity_id, n_keys ORDER BY candidate_id) AS place FROM lab) "
    "SELECT n_keys, count(*) AS true_pairs, round(quantile_cont(size, 0.5), 6) AS tie_size_median, round(quantile_cont(place, 0.5), 6) AS tie_place_median, round(quantile_cont(place, 0.9), 6) AS tie_place_p90 FROM t WHERE label = 1 GROUP BY 1"
)
def tie_groups(spark, folder):
    return diagnostics.tie_groups(_labelled(spark, folder))


@query(f"WITH {_LABELLED_SQL}, {_RANKED.format(order='n_keys DESC, label DESC,')} SELECT cap, sum(label)::BIGINT AS found, round(sum(label) / (SELECT count(*) FROM gt), 6) AS recall FROM rk JOIN caps ON rank <= cap GROUP BY cap")
def tie_upper_bound(spark, folder):
    return diagnostics.tie_upper_bound(_labelled(spark, folder), truth(spark, folder), SWEEP)


@query(
    f"WITH {_TRUTH_SQL}, ids AS (SELECT DISTINCT candidate_id, substr(candidate_id, 2, 1)::INT AS source FROM gt) "
    "SELECT source, count(*) AS referenced, count(d.id) AS found, count(*) - count(d.id) AS missing FROM ids LEFT JOIN d ON d.id = candidate_id GROUP BY source"
)
def gt_coverage(spark, folder):
    return pairs.coverage(records(spark, folder), truth(spark, folder))


# ---------------------------------------------------------------- features and ranking


def _same(c: str) -> str:
    return f"(a.{c} = b.{c} AND a.{c} <> '')::INT"


_INDIC_B = "regexp_matches(b.name_clean, '[\\x{0901}-\\x{0D7E}]')"
_INDIC_A = "(regexp_matches(a.name_clean, '[\\x{0901}-\\x{0D7E}]') AND len(a.name_tokens) > 0)"

_FEATURE_SQL = {
    "n_keys": "p.n_keys", "matched_by_token": "contains(match_keys, 'name_token')::INT", "matched_by_prefix": "contains(match_keys, 'name_prefix')::INT",
    "matched_by_number": "contains(match_keys, 'addr_number')::INT", "matched_by_ngram": "contains(match_keys, 'name_ngram')::INT",
    "name_exact_clean": _same("name_clean"), "name_exact_core": _same("name_core"), "name_exact_ascii": _same("name_ascii"),
    "name_token_jaccard": f"round({_jaccard_sql('name_tokens')}, 6)", "name_char_jaccard": f"round({_jaccard_sql('name_ngrams')}, 6)",
    "addr_number_any_shared": "list_has_any(a.addr_numbers, b.addr_numbers)::INT",
    "name_first_token_match": "(a.name_core <> '' AND split_part(a.name_core, ' ', 1) = split_part(b.name_core, ' ', 1))::INT",
    "name_len_ratio": "round(least(length(a.name_core), length(b.name_core)) / greatest(length(a.name_core), length(b.name_core), 1), 6)",
    "name_len_diff": "abs(length(a.name_core) - length(b.name_core))::INT", "has_suffix_s1": "(a.name_suffix <> '')::INT", "has_suffix_cand": "(b.name_suffix <> '')::INT",
    "suffix_equal": _same("name_suffix"), "addr_token_jaccard": f"round({_jaccard_sql('addr_tokens')}, 6)", "addr_number_jaccard": f"round({_jaccard_sql('addr_numbers')}, 6)",
    "addr_len_ratio": "round(least(length(a.addr_clean), length(b.addr_clean)) / greatest(length(a.addr_clean), length(b.addr_clean), 1), 6)",
    "both_have_address": "(a.addr_clean <> '' AND b.addr_clean <> '')::INT", "both_indic_script": f"({_INDIC_A} AND {_INDIC_B})::INT", "script_mismatch": f"({_INDIC_A} <> {_INDIC_B})::INT", "embedding_score": "NULL::DOUBLE", "has_embedding_score": "0",
}
_JOINED_SQL = "FROM p JOIN norm a ON a.entity_id = p.entity_id JOIN norm b ON b.entity_id = p.candidate_id"
_ROUNDED = ("name_token_jaccard", "name_char_jaccard", "name_len_ratio", "addr_token_jaccard", "addr_number_jaccard", "addr_len_ratio", *features.RATIOS)


def _features(spark, folder, wanted, cfg=WIDE):
    norm = _norm(spark, folder, noisy=True)
    out = blockwise.candidate_features(norm, cfg, wanted)
    return out.select("entity_id", "candidate_id", *[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in wanted])


def _feature_query(wanted, cfg: Blocking) -> str:
    return f"WITH {_pairs_sql(cfg, noisy=True)} SELECT p.entity_id, p.candidate_id, " + ", ".join(f"{_FEATURE_SQL[c]} AS {c}" for c in wanted) + f" {_JOINED_SQL}"


@query(_feature_query(features.PRE_RANK, TIGHT))
def pre_rank_features(spark, folder):
    return _features(spark, folder, features.PRE_RANK, TIGHT)


@query(_feature_query(features.PRE_RANK, WIDE))
def pre_rank_features_wide(spark, folder):
    return _features(spark, folder, features.PRE_RANK)


@query(_feature_query(features.NATIVE, TIGHT))
def pair_features(spark, folder):
    return _features(spark, folder, features.NATIVE, TIGHT)


@query(_feature_query(features.NATIVE, WIDE))
def pair_features_wide(spark, folder):
    return _features(spark, folder, features.NATIVE)


# The ratios of strings of at most 126 characters: a subsequence's bits in one integer, a step for each character of b.
def _reduced(masks: str) -> str:
    return f"list_reduce(list_concat([ones], {masks}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & ones)"


def _common_sql(table: str, keep: str) -> str:
    """Rows (a, b) with a's length n, all its bits set (ones), and for each character of b its places in a as bits (masks)."""
    return f"""(SELECT *, list_transform(string_split(b, ''), lambda c: list_sum(list_transform(string_split(a, ''), lambda x, i: CASE WHEN x = c THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END))::HUGEINT) AS masks
  FROM (SELECT *, length(a) AS n, (1::HUGEINT << length(a)) - 1 AS ones FROM {table}) WHERE {keep})"""


_SORTED = "array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda w: w <> '')), ' ')"
_FUZZ_SQL = f"""fp AS MATERIALIZED (SELECT p.entity_id, p.candidate_id, a.name_core AS ca, b.name_core AS cb, {_SORTED.format(x='a.name_core')} AS sa, {_SORTED.format(x='b.name_core')} AS sb,
  a.addr_clean AS aa, b.addr_clean AS ab, {_SORTED.format(x='a.addr_clean')} AS ta, {_SORTED.format(x='b.addr_clean')} AS tb, p.match_keys, p.n_keys {_JOINED_SQL}),
st AS MATERIALIZED (SELECT ca AS a, cb AS b FROM fp UNION SELECT sa, sb FROM fp UNION SELECT aa, ab FROM fp UNION SELECT ta, tb FROM fp),
rt AS MATERIALIZED (SELECT a, b, 2 * (n - bit_count({_reduced('masks')})) / (n + length(b))::DOUBLE AS v FROM {_common_sql('st', "a <> '' AND b <> ''")}),
pp AS MATERIALIZED (SELECT DISTINCT ca AS x, cb AS y FROM fp WHERE ca <> '' AND cb <> ''),
pq AS MATERIALIZED (SELECT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS a, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS b FROM pp
  UNION ALL SELECT x, y, y, x FROM pp WHERE length(x) = length(y)),
pr AS MATERIALIZED (SELECT x, y, max(v) AS v FROM (SELECT x, y, 1.0::DOUBLE AS v FROM pq WHERE contains(b, a) UNION ALL
  SELECT x, y, list_max(list_transform(range(1 - n, length(b)), lambda i: 2 * (n - bit_count({_reduced('masks[(greatest(i, 0) + 1):(least(i + n, length(b)))]')})) / (n + least(i + n, length(b)) - greatest(i, 0))::DOUBLE)) FROM {_common_sql('pq', 'NOT contains(b, a)')})
  GROUP BY x, y),
fz AS (SELECT fp.entity_id, fp.candidate_id, round(coalesce(r1.v, 0), 6) AS name_levenshtein_ratio, round(coalesce(r2.v, 0), 6) AS name_token_sort_ratio, round(coalesce(pr.v, 0), 6) AS name_partial_ratio,
  round(coalesce(r3.v, 0), 6) AS addr_levenshtein_ratio, round(coalesce(r4.v, 0), 6) AS addr_token_sort_ratio FROM fp LEFT JOIN rt r1 ON r1.a = ca AND r1.b = cb LEFT JOIN rt r2 ON r2.a = sa AND r2.b = sb
  LEFT JOIN rt r3 ON r3.a = aa AND r3.b = ab LEFT JOIN rt r4 ON r4.a = ta AND r4.b = tb LEFT JOIN pr ON pr.x = ca AND pr.y = cb)"""


@query(f"WITH {_pairs_sql(WIDE, noisy=True)},\n{_FUZZ_SQL} SELECT * FROM fz")
def fuzz_features(spark, folder):
    return _features(spark, folder, features.RATIOS)


def _native_weights(name: str) -> dict[str, float]:
    return {c: w for c, w in features.HAND_WEIGHTS[name].items() if c in features.NATIVE}


def _weighted_sql(cfg: Blocking) -> str:
    each = {n: " + ".join(f"{w} * {_FEATURE_SQL[c]}" for c, w in _native_weights(n).items()) for n in features.HAND_WEIGHTS}
    return f"WITH {_pairs_sql(cfg, noisy=True)} SELECT p.entity_id, p.candidate_id, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in each.items()) + f" {_JOINED_SQL}"


def _weighted(spark, folder, cfg):
    return blockwise.candidate_scores(_norm(spark, folder, noisy=True), cfg, {name: _native_weights(name) for name in features.HAND_WEIGHTS})


@query(
    f"WITH {_pairs_sql(TIGHT, noisy=True)}, ev AS (SELECT {_ID} AS entity_id, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id), "
    f"sc AS (SELECT p.entity_id, p.candidate_id, {_INDIC_A} AS ia, {_INDIC_B} AS ib, round(list_cosine_similarity(x.v, y.v), 6) AS c {_JOINED_SQL} LEFT JOIN ev x ON x.entity_id = p.entity_id LEFT JOIN ev y ON y.entity_id = p.candidate_id) "
    "SELECT entity_id, candidate_id, (ia AND ib)::INT AS both_indic_script, (ia <> ib)::INT AS script_mismatch, c AS embedding_score, (c IS NOT NULL)::INT AS has_embedding_score FROM sc"
)
def embedding_features(spark, folder):
    """Features of scripts and of vectors, which only some records have."""
    norm, v = _norm(spark, folder, noisy=True), record_vectors(spark, folder)
    rows = blocking.candidates(norm, TIGHT).join(v.withColumnRenamed("embedding", "va"), "entity_id", "left")
    rows = rows.join(v.select(F.col("entity_id").alias("candidate_id"), F.col("embedding").alias("vb")), "candidate_id", "left")
    rows = rows.withColumn("embedding_score", F.round(S.cosine(F.col("va"), F.col("vb")), 6)).drop("va", "vb")
    return features.features(rows, norm, ("both_indic_script", "script_mismatch", "embedding_score", "has_embedding_score"))


@query(_weighted_sql(TIGHT))
def weighted_rankings_native(spark, folder):
    """The hand-weighted scores without the string ratios, which SQL can't say."""
    return _weighted(spark, folder, TIGHT)


@query(_weighted_sql(WIDE))
def weighted_rankings_native_wide(spark, folder):
    return _weighted(spark, folder, WIDE)


RANKING_CAPS = (60, 100, 150)


def _rankings_sql() -> str:
    value = {n: " + ".join(["0.0::DOUBLE", *(f"{w} * {'fz.' + c if c in features.RATIOS else _FEATURE_SQL[c]}" for c, w in own.items())]) for n, own in features.HAND_WEIGHTS.items()}
    each = " UNION ALL ".join(f"SELECT '{n}' AS ranking, entity_id, candidate_id, label, {n} AS value FROM wv" for n in value)
    return (
        f"WITH {_LABELLED_SQL},\n{_FUZZ_SQL}, wv AS MATERIALIZED (SELECT p.entity_id, p.candidate_id, p.label, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in value.items())
        + f" FROM lab p JOIN norm a ON a.entity_id = p.entity_id JOIN norm b ON b.entity_id = p.candidate_id JOIN fz ON fz.entity_id = p.entity_id AND fz.candidate_id = p.candidate_id), "
        f"rk AS (SELECT ranking, label, row_number() OVER (PARTITION BY ranking, entity_id ORDER BY value DESC, candidate_id) AS rank FROM ({each})), caps AS (SELECT unnest({list(RANKING_CAPS)})::INT AS cap) "
        "SELECT cap, sum(label)::BIGINT AS found, round(sum(label) / (SELECT count(*) FROM gt), 6) AS recall, ranking FROM rk JOIN caps ON rank <= cap GROUP BY cap, ranking"
    )


@query(_rankings_sql())
def weighted_rankings(spark, folder):
    """Recall at three caps of the hand-weighted scores. Entities without a true candidate add nothing to the sums; of the others the cells that find the candidates count those ahead of each true one."""
    norm, true = _norm(spark, folder), keep(truth(spark, folder), "truth")
    rows = keep(blocking.capped(blocking.postings(norm, WIDE), WIDE), "postings")
    found, names = keep(blocking.rendered(blocking.true_pairs(true, rows)), "found"), list(features.HAND_WEIGHTS)
    rankings = blockwise.Weights([features.HAND_WEIGHTS[n] for n in names])
    each = blockwise.features(found, norm, rankings.columns).withColumn("ranking", F.explode(F.array(*map(F.lit, range(len(names))))))
    marked = keep(blockwise.marks(each, rankings), "marks")
    ranked = blockwise.ranks(norm, rows, marked, rankings, len(names))
    same = Window.partitionBy("ranking", "entity_id", "candidate_id", "score").orderBy("row")  # rows of a repeated id
    ranked = keep(ranked.withColumn("rank", F.col("rank") + F.row_number().over(same) - 1), "ranks")
    out = None
    for k, name in enumerate(names):
        one = diagnostics.recall_of_ranks(ranked.where(F.col("ranking") == k), true, RANKING_CAPS).withColumn("ranking", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if marked.isEmpty() and not blocking.any_pair(rows, _entities(spark, folder)):
        return out.limit(0)
    return out


@query(
    f"WITH {_SCORES_SQL} SELECT s.entity_id, s.candidate_id, s.score AS pre_rank_score, top.n_keys FROM s JOIN top USING (entity_id, candidate_id) "
    "QUALIFY row_number() OVER (PARTITION BY s.entity_id ORDER BY s.score DESC, top.n_keys DESC, s.candidate_id) <= 20"
)
def rerank_topk(spark, folder):
    return linkage.reranked(_scores(spark, folder)[1].withColumnRenamed("score", "pre_rank_score"), 20)


# ---------------------------------------------------------------- vectors

_KNN = """q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
nn AS (SELECT q.vec_id AS entity_id, c.vec_id AS candidate_id, round(list_cosine_similarity(q.v, c.v), 6) AS embedding_score FROM q, c
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, c.v), 6) DESC, c.vec_id) <= 20)"""


@query(f"WITH {_KNN} SELECT * FROM nn")
def knn_cosine(spark, folder):
    """The queries are every twentieth vector, searched in all."""
    v = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.neighbours(v.where("id % 20 = 0"), v, 20)


_VECTORS_SQL = f"ev AS (SELECT {_ID} AS entity_id, (doc_id % 3 + 1)::INT AS source, lang AS country, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id)"
_NEAR_SQL = f"""{_VECTORS_SQL}, nn AS (SELECT q.entity_id, c.entity_id AS candidate_id, round(list_cosine_similarity(q.v, c.v), 6) AS embedding_score FROM ev q JOIN ev c ON q.country = c.country AND q.source = 1 AND c.source <> 1
  QUALIFY row_number() OVER (PARTITION BY q.entity_id ORDER BY round(list_cosine_similarity(q.v, c.v), 6) DESC, c.entity_id) <= 20)"""


@query(f"WITH {_NEAR_SQL} SELECT * FROM nn")
def embedding_candidates(spark, folder):
    return vectors.embedding_candidates(records(spark, folder), record_vectors(spark, folder), 20)


@query(
    f"WITH {_pairs_sql(TIGHT)}, {_NEAR_SQL} SELECT coalesce(p.entity_id, nn.entity_id) AS entity_id, coalesce(p.candidate_id, nn.candidate_id) AS candidate_id, "
    "CASE WHEN p.match_keys IS NULL THEN 'embedding' WHEN embedding_score IS NULL THEN match_keys ELSE match_keys || ',embedding' END AS match_keys, "
    "(coalesce(n_keys, 0) + (embedding_score IS NOT NULL)::INT)::INT AS n_keys, embedding_score FROM p FULL JOIN nn ON p.entity_id = nn.entity_id AND p.candidate_id = nn.candidate_id"
)
def merge_embedding(spark, folder):
    return vectors.merged(_raw(spark, folder, TIGHT), embedding_candidates(spark, folder))


# ---------------------------------------------------------------- metric

_F = "CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN n_pred = 0 OR hits = 0 THEN 0.0 ELSE 1.25 * (hits / n_pred) * (hits / n_true) / (0.25 * (hits / n_pred) + hits / n_true) END"


def _entity_sql(threshold: str, more: str = "") -> str:
    return (
        f"SELECT e.entity_id{more}, count(DISTINCT gt.candidate_id) AS n_true, count(DISTINCT s.candidate_id) AS n_pred, count(DISTINCT CASE WHEN gt.candidate_id = s.candidate_id THEN s.candidate_id END) AS hits "
        f"FROM e LEFT JOIN gt ON gt.entity_id = e.entity_id LEFT JOIN s ON s.entity_id = e.entity_id AND s.score >= {threshold} GROUP BY ALL"
    )


_GRID_SQL = "grid AS (SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in metric.GRID) + "]) AS threshold)"
_CURVE_SQL = f"""{_SCORES_SQL}, {_GRID_SQL}, tn AS (SELECT e.entity_id, count(gt.candidate_id) AS n_true FROM e LEFT JOIN gt ON gt.entity_id = e.entity_id GROUP BY 1),
pn AS (SELECT threshold, s.entity_id, count(*) AS n_pred, count(gt.candidate_id) AS hits FROM grid JOIN s ON s.score >= threshold LEFT JOIN gt ON gt.entity_id = s.entity_id AND gt.candidate_id = s.candidate_id GROUP BY 1, 2),
cv AS (SELECT threshold, avg({_F}) AS v FROM (SELECT grid.threshold, tn.entity_id, n_true, coalesce(n_pred, 0) AS n_pred, coalesce(hits, 0) AS hits FROM tn CROSS JOIN grid LEFT JOIN pn ON pn.entity_id = tn.entity_id AND pn.threshold = grid.threshold) GROUP BY 1)"""


@query(f"WITH {_SCORES_SQL} SELECT entity_id, n_true, n_pred, hits, round({_F}, 6) AS f_beta FROM ({_entity_sql('0.5')})")
def entity_f_beta(spark, folder):
    rows = metric.entity_scores(_entities(spark, folder), truth(spark, folder), metric.predictions(_scores(spark, folder)[1], 0.5))
    return rows.withColumn("f_beta", F.round("f_beta", 6))


@query(f"WITH {_SCORES_SQL} SELECT count(*) AS entities, round(avg({_F}), 6) AS macro_f_beta FROM ({_entity_sql('0.5')})")
def macro_f_beta(spark, folder):
    out = metric.macro_f_beta(_entities(spark, folder), truth(spark, folder), metric.predictions(_scores(spark, folder)[1], 0.5))
    return out.withColumn("macro_f_beta", F.round("macro_f_beta", 6))


@query(f"WITH {_CURVE_SQL} SELECT threshold, round(v, 6) AS macro_f_beta FROM cv")
def threshold_curve(spark, folder):
    curve = metric.threshold_curve(_entities(spark, folder), truth(spark, folder), _scores(spark, folder)[1])
    return curve.select("threshold", F.round("macro_f_beta", 6).alias("macro_f_beta"))


@query(f"WITH {_CURVE_SQL} SELECT threshold, round(v, 6) AS macro_f_beta FROM cv ORDER BY round(v, 9) DESC, threshold LIMIT 1")
def best_threshold(spark, folder):
    curve = metric.threshold_curve(_entities(spark, folder), truth(spark, folder), _scores(spark, folder)[1])
    return metric.best_threshold(curve).withColumn("macro_f_beta", F.round("macro_f_beta", 6))


# ---------------------------------------------------------------- outputs


@query(f"WITH {_SCORES_SQL} SELECT e.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT top.candidate_id, ',' ORDER BY top.candidate_id), '') AS candidate_entity_ids FROM e LEFT JOIN top ON top.entity_id = e.entity_id GROUP BY 1")
def candidate_lists(spark, folder):
    return outputs.candidate_lists(_entities(spark, folder), _scores(spark, folder)[0])


_MATCHES = "SELECT e.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT s.candidate_id, ',' ORDER BY s.candidate_id), '') AS matched_entity_ids FROM e LEFT JOIN s ON s.entity_id = e.entity_id AND s.score >= 0.5 GROUP BY 1"


@query(f"WITH {_SCORES_SQL} {_MATCHES}")
def match_lists(spark, folder):
    return outputs.match_lists(_entities(spark, folder), _scores(spark, folder)[1], 0.5)


@query(f"WITH {_SCORES_SQL} SELECT count(*) AS entities, round(avg((matched_entity_ids <> '')::INT), 6) AS match_rate FROM ({_MATCHES})")
def match_rate(spark, folder):
    return outputs.match_rate(match_lists(spark, folder)).withColumn("match_rate", F.round("match_rate", 6))


@query(
    f"WITH {_SCORES_SQL}, m AS (SELECT DISTINCT entity_id, candidate_id FROM s WHERE score >= 0.5) SELECT (SELECT count(*) FROM (SELECT entity_id FROM e GROUP BY 1 HAVING count(*) > 1)) AS repeated_entities, "
    "(SELECT count(*) FROM m WHERE candidate_id NOT IN (SELECT entity_id FROM r WHERE source IN (2, 3))) AS unknown_matches, (SELECT count(*) FROM m ANTI JOIN top USING (entity_id, candidate_id)) AS matches_not_candidates"
)
def output_violations(spark, folder):
    top, scores = _scores(spark, folder)
    return outputs.violations(_entities(spark, folder), top, scores, records(spark, folder), 0.5)


# ---------------------------------------------------------------- samples


@query(
    f"WITH {_ENTITIES_SQL} SELECT entity_id, country, CASE WHEN row_number() OVER (PARTITION BY country ORDER BY md5('42|' || entity_id), entity_id) <= floor(count(*) OVER (PARTITION BY country) * 0.15) THEN 'val' ELSE 'train' END AS split FROM e"
)
def entity_split(spark, folder):
    return pairs.split(records(spark, folder).where("source = 1"))


_U = "(('0x' || substr(md5('42|' || entity_id || '|' || candidate_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


@query(
    f"WITH {_LABELLED_SQL}, np AS (SELECT entity_id, sum(label) AS n_pos FROM lab GROUP BY 1), neg AS (SELECT lab.*, row_number() OVER (PARTITION BY entity_id ORDER BY round(-ln({_U}) / (n_keys + 1), 9), candidate_id) AS rn FROM lab WHERE label = 0) "
    "SELECT entity_id, candidate_id, match_keys, n_keys, label FROM lab WHERE label = 1 UNION ALL SELECT entity_id, candidate_id, match_keys, n_keys, label FROM neg JOIN np USING (entity_id) WHERE rn <= CASE WHEN n_pos > 0 THEN 6 * n_pos ELSE 6 END"
)
def negative_sample(spark, folder):
    return pairs.sampled(keep(_labelled(spark, folder), "labels"))


@query(
    f"WITH {_records_sql(False)}, {_TRUTH_SQL}, one AS (SELECT entity_id FROM r WHERE source = 1 ORDER BY md5('12345|' || entity_id), entity_id LIMIT 100), "
    "need AS (SELECT DISTINCT gt.candidate_id AS entity_id FROM gt SEMI JOIN one ON one.entity_id = gt.entity_id), "
    "rest AS (SELECT entity_id, source, row_number() OVER (PARTITION BY source ORDER BY md5((12345 + source) || '|' || entity_id), entity_id) AS rn FROM r WHERE source <> 1 AND entity_id NOT IN (SELECT entity_id FROM need)) "
    "SELECT entity_id, 'entity' AS role FROM one UNION ALL SELECT entity_id, 'match' FROM need UNION ALL SELECT entity_id, 'distractor' FROM rest WHERE rn <= 50"
)
def aligned_sample(spark, folder):
    return pairs.aligned_sample(records(spark, folder), truth(spark, folder), 100, 50).select("entity_id", "role")


@query()
def learned_pre_ranker(spark, folder):
    """Recall at caps of held-out entities in the order of a learnt pre-ranker."""
    return linkage.pre_rank_recall(records(spark, folder), truth(spark, folder), WIDE, SWEEP)


@query()
def pre_ranker_by_country(spark, folder):
    """The same with a pre-ranker for each country, up to the best 150."""
    return linkage.pre_rank_recall(records(spark, folder), truth(spark, folder), WIDE, (60, 100, 150), each_country=True)


@query()
def two_stage_light(spark, folder):
    """Threshold curve of a matcher behind a pre-ranker on cheap features."""
    return linkage.two_stage(records(spark, folder), truth(spark, folder), WIDE, light=True)


@query()
def two_stage(spark, folder):
    """Threshold curve of a matcher behind a pre-ranker on all features."""
    return linkage.two_stage(records(spark, folder), truth(spark, folder), WIDE, light=False)
