"""Features of whole candidate sets: the pairs of a block of entities and a block of candidates meet in one task, with each form once.

A join would carry the forms of two records through a shuffle for each pair. Here the ids of both sides are dealt into blocks by a hash; a
cell is a block of entities and one of candidates. A record goes once to each cell in which it has a pair (never to more cells than it has
pairs), a pair travels as its ids. Sets are compared through a table of the block's members, texts by numbers. The values are those of
``features.features``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import json
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinfold.functions import similarity as S
from kinfold.functions import text as T
from kinfold.operators import blocking
from kinfold.operators import features as E

BLOCK = 2048  # records of a side that are compared at a time; a cell has as many of a side on average, or more
MOST_BLOCK = 16384  # where cells are large, as a record then goes to fewer of them
LEAST_CELLS = 48
TABLE = 1 << 26  # most entries of a table of members; larger ones are searched
STEP = 1 << 20  # members of sets that are looked up at a time
MOST_TASKS = 20_000
STRIP = 4  # cells of a block of entities that one task takes in turn, where the best of each entity are kept
MOST_CODES = 1 << 22  # combinations of bins for which a forest's scores are looked up

_OWN = ("n_keys", "matched_by_token", "matched_by_prefix", "matched_by_number", "matched_by_ngram", "embedding_score", "has_embedding_score")  # known without the records
_SAME = {"name_exact_clean": "name_clean", "name_exact_core": "name_core", "name_exact_ascii": "name_ascii", "suffix_equal": "name_suffix"}
_SETS = {"name_token_jaccard": "name_tokens", "name_char_jaccard": "name_ngrams", "addr_token_jaccard": "addr_tokens", "addr_number_jaccard": "addr_numbers", "addr_number_any_shared": "addr_numbers"}
_NEEDS = {
    **{c: (f,) for c, f in (_SAME | _SETS).items()}, "name_first_token_match": ("name_core", "first"), "name_len_ratio": ("name_length",), "name_len_diff": ("name_length",),
    "has_suffix_s1": ("name_suffix",), "has_suffix_cand": ("name_suffix",), "addr_len_ratio": ("addr_length",), "both_have_address": ("addr_length",),
    "both_indic_script": ("indic", "named"), "script_mismatch": ("indic", "named"),
    **dict.fromkeys(E.RATIOS[:3], ("name_core",)), **dict.fromkeys(E.RATIOS[3:], ("addr_clean",)),
}

_MARKS = {"mark_row": pa.list_(pa.int64()), "mark_ranking": pa.list_(pa.int32()), "mark_id": pa.list_(pa.string()), "mark_keys": pa.list_(pa.int32()), "mark_score": pa.list_(pa.float64())}
_PLAIN = {**_MARKS, "most": pa.int32(), "name_length": pa.int32(), "addr_length": pa.int32(), "indic": pa.bool_(), "named": pa.bool_()}


def _forms(needs: list[str]):
    """The forms as one text: what nests is sized anew for each row on its way to Python, pairs included."""
    own = {
        "first": F.split("name_core", " ")[0], "name_length": F.length("name_core"), "addr_length": F.length("addr_clean"), "indic": T.has_indic(F.col("name_clean")),
        "named": F.size("name_tokens") > 0, **{c: F.array_distinct(c) for c in _SETS.values()},
    }
    return F.to_json(F.struct(*[own.get(c, F.col(c)).alias(c) for c in needs]))


def _row_kind(c: str) -> pa.DataType:
    return pa.list_(pa.string()) if c == "keys" or c in _SETS.values() else _PLAIN.get(c, pa.string())


def _read(forms: pa.ChunkedArray, needs: list[str]) -> pa.Table:
    text = "\n".join(forms.to_pylist()).encode()
    return json.read_json(pa.BufferReader(text), json.ReadOptions(use_threads=False, block_size=len(text) + 1), json.ParseOptions(explicit_schema=pa.schema([(c, _row_kind(c)) for c in needs])))


class _Cell:
    """The forms of a cell's records, a and b by row."""

    def __init__(self, a: pa.Table, b: pa.Table, needs: list[str]) -> None:
        self.ids, self.rows, self.n = [], [], []
        for side in (a, b):
            ids = side["id"].combine_chunks()
            codes = ids.dictionary_encode()
            code = codes.indices.to_numpy()
            self.ids.append((ids, codes.dictionary))
            self.rows.append(np.argsort(code, kind="stable"))  # a repeated id has several rows
            self.n.append(np.bincount(code, minlength=len(codes.dictionary)))
        forms = [_read(t["forms"], needs) for t in (a, b)]
        self.columns = {c: tuple(t[c].combine_chunks() for t in forms) for c in needs}
        self.made: dict[str, tuple] = {}

    def places(self, a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair whose records are there: its number, and the rows of its records."""
        at = [pc.index_in(x, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False) for x, (_, known) in zip((a, b), self.ids, strict=True)]
        pair = np.flatnonzero((at[0] >= 0) & (at[1] >= 0))
        at = [x[pair] for x in at]
        for k in (0, 1):
            n = self.n[k]
            begin, times = (np.cumsum(n) - n)[at[k]], n[at[k]]
            if (times != 1).any():
                inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                begin, pair, at = np.repeat(begin, times) + inside, np.repeat(pair, times), [np.repeat(x, times) for x in at]
                if k:
                    first = np.repeat(first, times)
            rows = self.rows[k][begin]
            if k == 0:
                first = rows
        return pair, first, rows

    def texts(self, c: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of a's and of b's texts, equal for equal ones, and which of a's are not empty."""
        if c not in self.made:
            a, b = self.columns[c]
            code = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy()
            self.made[c] = code[: len(a)], code[len(a) :], pc.not_equal(a, "").to_numpy(zero_copy_only=False)
        return self.made[c]

    def values(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        if c not in self.made:
            self.made[c] = tuple(x.to_numpy(zero_copy_only=False) for x in self.columns[c])
        return self.made[c]

    def strings(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array(x.to_pylist() + [None], dtype=object)[:-1] for x in self.columns[c])

    def sizes(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        return tuple(pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in self.columns[c])

    def _members(self, c: str) -> tuple:
        if ("set", c) not in self.made:
            a, b = self.columns[c]
            size_a, size_b = self.sizes(c)
            codes = b.flatten().dictionary_encode()
            width = len(codes.dictionary) + 1  # one more for what no b has
            own = pc.index_in(a.flatten(), value_set=codes.dictionary).fill_null(width - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.repeat(np.arange(len(b)) * width, size_b) + codes.indices.to_numpy().astype(np.int64)
            if len(b) * width <= TABLE:
                table = np.zeros(len(b) * width, bool)
                table[keys] = True
                there = table.__getitem__
            else:
                keys.sort()
                there = lambda k: keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k if len(keys) else np.zeros(len(k), bool)
            self.made["set", c] = own, np.cumsum(size_a) - size_a, size_a, size_b, width, there
        return self.made["set", c]

    def shared(self, c: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many members the two sets of each pair share, and have together."""
        own, begin, size_a, size_b, width, there = self._members(c)
        times = size_a[a]
        ends = np.cumsum(times)
        out = np.zeros(len(a), np.int64)
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
            n, e = times[at:to], ends[at:to] - (ends[at - 1] if at else 0)
            member = own[np.arange(e[-1]) + np.repeat(begin[a[at:to]] - (e - n), n)]
            hits = np.concatenate([[0], np.cumsum(there(member + np.repeat(b[at:to] * width, n)), dtype=np.int64)])
            out[at:to] = hits[e] - hits[e - n]
            at = to
        return out, times + size_b[b] - out


def _jaccard(shared: np.ndarray, both: np.ndarray) -> np.ndarray:
    return np.where(both == 0, 0.0, shared / np.maximum(both, 1))


def _column(cell: _Cell, c: str, a: np.ndarray, b: np.ndarray, seen: dict):
    """The values of a feature, as features.native has them."""
    if c in _SAME:
        x, y, some = cell.texts(_SAME[c])
        return (x[a] == y[b]) & some[a]
    if c in _SETS:
        if _SETS[c] not in seen:
            seen[_SETS[c]] = cell.shared(_SETS[c], a, b)
        return seen[_SETS[c]][0] > 0 if c == "addr_number_any_shared" else _jaccard(*seen[_SETS[c]])
    if c == "name_first_token_match":
        x, y, _ = cell.texts("first")
        return (x[a] == y[b]) & cell.texts("name_core")[2][a]
    if c in ("name_len_ratio", "name_len_diff", "addr_len_ratio", "both_have_address"):
        x, y = cell.values("addr_length" if c in ("addr_len_ratio", "both_have_address") else "name_length")
        x, y = x[a], y[b]
        return np.abs(x - y) if c == "name_len_diff" else (x > 0) & (y > 0) if c == "both_have_address" else np.minimum(x, y) / np.maximum(np.maximum(x, y), 1)
    if c in ("has_suffix_s1", "has_suffix_cand"):
        if c not in cell.made:
            cell.made[c] = pc.not_equal(cell.columns["name_suffix"][int(c == "has_suffix_cand")], "").to_numpy(zero_copy_only=False)
        return cell.made[c][a if c == "has_suffix_s1" else b]
    if c in ("both_indic_script", "script_mismatch"):
        (x, y), (named, _) = cell.values("indic"), cell.values("named")
        x = (x & named)[a]
        return x & y[b] if c == "both_indic_script" else x != y[b]
    form = "name_core" if c.startswith("name") else "addr_clean"
    kind = c.split("_", 1)[1]
    if form not in seen:
        seen[form] = tuple(t[i].tolist() for t, i in zip(cell.strings(form), (a, b), strict=True))
    x, y = seen[form]
    if kind == "token_sort_ratio":
        x, y = ([" ".join(sorted(s.split())) for s in t] for t in (x, y))
    return S.partial_ratios(x, y) if kind == "partial_ratio" else S.ratios(x, y)


def _compare(wanted: tuple[str, ...], needs: list[str], label: bool, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, cell = None, ([], []), None
        for batch in batches:
            key = batch["cell"].to_numpy() * 4 + batch["part"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                where, part = divmod(int(key[lo]), 4)
                if where != at:
                    at, sides, cell = where, ([], []), None
                rows = batch.slice(lo, hi - lo)
                if part < 2:
                    sides[part].append(rows.select(["id", "forms"]))
                    continue
                if cell is None:
                    if not (sides[0] and sides[1]):
                        continue
                    cell = _Cell(*map(pa.Table.from_batches, sides), needs)
                pair, a, b = cell.places(rows["id"], rows["other"])
                taken, seen = pa.array(pair), {}
                out = [cell.ids[0][0].take(pa.array(a)), cell.ids[1][0].take(pa.array(b))]
                out += [rows[c].take(taken) if c in _OWN or c == "label" else pa.array(_column(cell, c, a, b, seen)) for c in (("label",) if label else ()) + wanted]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, kinds, strict=True)], schema=kinds)

    return run


def features(pairs: DataFrame, norm: DataFrame, wanted: tuple[str, ...] = E.ALL, block: int = BLOCK) -> DataFrame:
    """As features.features. The pairs are read three times: pass a kept table."""
    wanted = tuple(wanted)
    needs = list(dict.fromkeys(f for c in wanted for f in _NEEDS.get(c, ()))) or ["name_length"]
    label, exprs = "label" in pairs.columns, E.native(pairs.columns)
    own = [F.col("label")] * label + [exprs[c].alias(c) for c in _OWN if c in wanted]
    n = max(1, math.ceil(norm.count() / (2 * block)))  # blocks of a side
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    rows = pairs.where("entity_id IS NOT NULL AND candidate_id IS NOT NULL").withColumn("cell", part("entity_id") * n + part("candidate_id"))
    rows = rows.select("cell", F.lit(2).alias("part"), F.col("entity_id").alias("id"), F.col("candidate_id").alias("other"), *own)
    forms = norm.select("entity_id", _forms(needs).alias("forms"))
    every = rows.withColumn("forms", F.lit(None).cast("string"))
    for k, c in enumerate(("id", "other")):
        there = rows.select("cell", F.col(c).alias("entity_id")).distinct().join(forms, "entity_id")
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema[4:]]
        every = every.unionByName(there.select("cell", F.lit(k).alias("part"), F.col("entity_id").alias("id"), F.lit(None).cast("string").alias("other"), *nothing, "forms"))
    types = {**{f.name: f.dataType for f in rows.schema[4:]}, **{c: "string" for c in ("entity_id", "candidate_id")}}
    simple = lambda c: types[c] if isinstance(types.get(c), str) else types[c].simpleString() if c in types else "double" if c.endswith(("jaccard", "ratio")) else "int"
    names = ("entity_id", "candidate_id", *(("label",) if label else ()), *wanted)
    schema = ", ".join(f"{c} {simple(c)}" for c in names)
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    dealt = every.repartition(min(n * n, MOST_TASKS), "cell").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(_compare(wanted, needs, label, kinds), schema)


def _agreeing(cell: _Cell) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a's and b's that share a key, and the kinds of key they share as bits; about STEP agreements at a time."""
    a, b = cell.columns["keys"]
    size_a, size_b = cell.sizes("keys")
    codes = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
    kind = np.array([int(k[0]) for k in codes.dictionary.to_pylist()], np.uint8)
    code = codes.indices.to_numpy().astype(np.int64)
    own, theirs = code[: size_a.sum()], code[size_a.sum() :]
    owner, holder = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
    holder = holder[np.argsort(theirs, kind="stable")]
    n = np.bincount(theirs, minlength=len(kind))
    begin = np.cumsum(n) - n
    sums = np.cumsum(np.bincount(owner, weights=n[own], minlength=len(a))).astype(np.int64)  # agreements up to each a
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + STEP // 2, side="right")))
        lo, hi = np.searchsorted(owner, (at, to))
        times = n[own[lo:hi]]
        if times.sum():
            ends = np.cumsum(times)
            place = np.arange(ends[-1]) + np.repeat(begin[own[lo:hi]] - (ends - times), times)
            pair, kinds = np.repeat((owner[lo:hi] - at) * len(b), times) + holder[place], np.repeat(kind[own[lo:hi]], times)
            bits = np.zeros((to - at) * len(b), np.uint8)
            for k in range(len(blocking.KINDS)):
                bits[pair[kinds == k]] |= np.uint8(1 << k)
            found = np.flatnonzero(bits)
            yield at + found // len(b), found % len(b), bits[found]
        at = to


def _own(c: str, bits: np.ndarray) -> pa.Array:
    """What a candidate pair's kinds of key say."""
    if c == "embedding_score":
        return pa.nulls(len(bits), pa.float64())
    if c == "has_embedding_score":
        return pa.array(np.zeros(len(bits), np.int32))
    if c == "n_keys":
        return pa.array(np.bitwise_count(bits).astype(np.int32))
    kind = {"matched_by_token": "name_token", "matched_by_prefix": "name_prefix", "matched_by_number": "addr_number", "matched_by_ngram": "name_ngram"}[c]
    return pa.array((bits >> blocking.KINDS.index(kind)) & 1)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[list, list]]]:
    """The number of each cell, and the rows of its two sides."""
    at, sides = None, ([], [])
    for batch in batches:
        key = batch["cell"].to_numpy() * 4 + batch["part"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            where, part = divmod(int(key[lo]), 4)
            if where != at:
                yield from _parts(at, sides)
                at, sides = where, ([], [])
            sides[part].append(batch.slice(lo, hi - lo).select(["id", "forms"]))
    yield from _parts(at, sides)


def _parts(at: int, sides: tuple[list, list]) -> Iterator[tuple[int, tuple[list, list]]]:
    """A large cell's second side is taken BLOCK records at a time, unless ids are repeated there."""
    if sides[0] and sides[1]:
        b = pa.Table.from_batches(sides[1])
        step = BLOCK if pc.count_distinct(b["id"]).as_py() == len(b) else len(b)
        for lo in range(0, len(b), step):
            yield at, (sides[0], b.slice(lo, step).to_batches())


def _find(wanted: tuple[str, ...], needs: list[str], kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sides in _cells(batches):
            cell = _Cell(*map(pa.Table.from_batches, sides), needs)
            for a, b, bits in _agreeing(cell):
                seen: dict = {}
                out = [cell.ids[0][0].take(pa.array(a)), cell.ids[1][0].take(pa.array(b))]
                out += [_own(c, bits) if c in _OWN else pa.array(_column(cell, c, a, b, seen)) for c in wanted]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, kinds, strict=True)], schema=kinds)

    return run


def _blocks(norm: DataFrame, block: int | None, only: DataFrame | None = None) -> tuple[int, int]:
    """Blocks of entities (of these ``only``) and of candidates. None: as large as leaves LEAST_CELLS cells, from BLOCK to MOST_BLOCK records."""
    a, b = norm.agg(F.expr("count_if(source = 1)"), F.expr("count_if(source <> 1)")).first()
    a = a if only is None else only.count()
    block = block or min(MOST_BLOCK, max(BLOCK, math.isqrt(a * b // LEAST_CELLS)))
    return max(1, math.ceil(a / block)), max(1, math.ceil(b / block))


def _lists(rows: DataFrame, n: tuple[int, int], only: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The keys of capped postings with their records' blocks, and each record's keys as a list. ``only``: the entity_id of the entities that are wanted."""
    named = F.concat(F.col("kind").cast("string"), F.length("country").cast("string"), F.lit(":"), "country", "key").alias("key")
    keys = rows.where("country IS NOT NULL AND entity_id IS NOT NULL")
    keys = keys.select("entity_id", (F.col("source") == 1).alias("one"), named, F.pmod(F.xxhash64("entity_id"), F.when(F.col("source") == 1, n[0]).otherwise(n[1])).alias("block")).where("one IS NOT NULL")
    if only is not None:
        keys = keys.where("one").join(only.select("entity_id").distinct(), "entity_id", "left_semi").unionByName(keys.where("NOT one"))
    return keys, keys.groupBy("entity_id", "one").agg(F.collect_set("key").alias("keys"))


def _met(keys: DataFrame, forms: DataFrame, n: tuple[int, int]) -> DataFrame:
    """cell, part, id, forms: a record goes once to each cell where a key of its own is."""
    every = None
    for k, one in enumerate((True, False)):
        mine, other = (keys.where(F.col("one") == x) for x in (one, not one))
        met = mine.join(other.select("key", F.col("block").alias("met")).distinct(), "key")
        cell = (F.col("block") * n[1] + F.col("met")) if one else (F.col("met") * n[1] + F.col("block"))
        side = met.select("entity_id", cell.alias("cell")).distinct().join(forms.where(F.col("one") == one), "entity_id")
        side = side.select("cell", F.lit(k).alias("part"), F.col("entity_id").alias("id"), "forms")
        every = side if every is None else every.unionByName(side)
    return every


def _formed(norm: DataFrame, lists: DataFrame, needs: list[str]) -> DataFrame:
    forms = norm.select("entity_id", (F.col("source") == 1).alias("one"), *[c for c in norm.columns if c not in ("entity_id", "source", "country", "scripts")])
    return forms.join(lists, ["entity_id", "one"]).select("entity_id", "one", _forms(needs).alias("forms"))


def _needs(wanted: tuple[str, ...]) -> list[str]:
    return [*dict.fromkeys(f for c in wanted for f in _NEEDS.get(c, ())), "keys"]


def candidate_features(norm: DataFrame, cfg: blocking.Blocking, wanted: tuple[str, ...] = E.ALL, block: int | None = None, rows: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The features of all candidate pairs of ``blocking.candidates``, which are found in the cells as well: no pair is shuffled.

    A record goes once to each cell where a key of its own is; these are found from the keys' blocks, never more than its pairs.
    ``rows``: the capped postings, if they are there already. ``only``: the entity_id of the entities whose pairs are wanted; all if it is None.
    """
    wanted = tuple(wanted)
    needs, n = _needs(wanted), _blocks(norm, block, only)
    keys, lists = _lists(blocking.capped(blocking.postings(norm, cfg), cfg) if rows is None else rows, n, only)
    kind = lambda c: "double" if c == "embedding_score" or c not in _OWN and c.endswith(("jaccard", "ratio")) else "int"
    schema = ", ".join(["entity_id string", "candidate_id string", *(f"{c} {kind(c)}" for c in wanted)])
    dealt = _met(keys, _formed(norm, lists, needs), n).repartition(min(n[0] * n[1], MOST_TASKS), "cell").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(_find(wanted, needs, to_arrow_schema(StructType.fromDDL(schema))), schema)


def six_digits(x: np.ndarray) -> np.ndarray:
    """Rounded as SQL does, halves away from zero; a quotient's half may lie below itself in binary."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + (0.5 + 1e-9)) / 1e6, x)


def _totals(rankings: dict[str, dict[str, float]], needs: list[str], kinds: pa.Schema):
    used = dict.fromkeys(c for weights in rankings.values() for c in weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sides in _cells(batches):
            cell = _Cell(*map(pa.Table.from_batches, sides), needs)
            for a, b, bits in _agreeing(cell):
                seen: dict = {}
                value = {c: _own(c, bits).to_numpy(zero_copy_only=False) if c in _OWN else np.asarray(_column(cell, c, a, b, seen)) for c in used}
                value = {c: six_digits(x) if x.dtype.kind == "f" else x for c, x in value.items()}
                out = [cell.ids[0][0].take(pa.array(a)), cell.ids[1][0].take(pa.array(b))]
                for weights in rankings.values():
                    total = np.zeros(len(a))
                    for c, w in weights.items():
                        total += value[c] * w
                    out.append(pa.array(six_digits(total)))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, kinds, strict=True)], schema=kinds)

    return run


def candidate_scores(norm: DataFrame, cfg: blocking.Blocking, rankings: dict[str, dict[str, float]], block: int | None = None) -> DataFrame:
    """entity_id, candidate_id of all candidate pairs and by name of each ranking its sum of weighted features, which are rounded to six digits, as is the sum.

    Pairs are found as in ``candidate_features``; no feature leaves its cell. A feature that no candidate has (``embedding_score``) can't be in a sum.
    """
    if any("embedding_score" in weights for weights in rankings.values()):
        raise ValueError("candidates have no embedding_score")
    schema = ", ".join(["entity_id string", "candidate_id string", *(f"`{name}` double" for name in rankings)])
    needs, n = _needs(tuple(dict.fromkeys(c for weights in rankings.values() for c in weights))), _blocks(norm, block)
    keys, lists = _lists(blocking.capped(blocking.postings(norm, cfg), cfg), n, None)
    dealt = _met(keys, _formed(norm, lists, needs), n).repartition(min(n[0] * n[1], MOST_TASKS), "cell").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(_totals(rankings, needs, to_arrow_schema(StructType.fromDDL(schema))), schema)


_DRAWN = "entity_id string, candidate_id string, kinds int"


class _Drawn:
    """The pairs of the entities of a strip that have the least keys so far, as many of each as it may need."""

    def __init__(self) -> None:
        self.number, self.most, self.last = {}, np.zeros(0, np.int64), np.zeros(0)
        self.rows: list[tuple] = []

    def add(self, cell: _Cell, seed: int) -> None:
        ids, other = (cell.ids[k][0] for k in (0, 1))
        number = np.array([self.number.setdefault(x, len(self.number)) for x in ids.to_pylist()])
        new = len(self.number) - len(self.most)
        self.most, self.last = np.concatenate([self.most, np.zeros(new, np.int64)]), np.concatenate([self.last, np.full(new, np.inf)])
        self.most[number] = cell.values("most")[0]
        front, back = ([f"{seed}|{x}|".encode() for x in ids.to_pylist()], [x.encode() for x in other.to_pylist()])
        for a, b, bits in _agreeing(cell):
            digits = b"".join([md5(front[i] + back[j]).digest() for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            u = ((np.frombuffer(digits, ">u8")[::2] >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
            key = -np.log(u) / (np.bitwise_count(bits) + 1)
            some = np.flatnonzero(key <= self.last[number[a]] + 1e-8)  # the ranking rounds to nine digits
            self.rows.append((number[a[some]], other.take(pa.array(b[some])), bits[some], key[some]))
            if sum(len(r[0]) for r in self.rows) > STEP:
                self._trim()
        self._trim()

    def _trim(self) -> None:
        if not self.rows:
            return
        number, bits, key = (np.concatenate([r[k] for r in self.rows]) for k in (0, 2, 3))
        ids = pa.concat_arrays([r[1] for r in self.rows])
        order = np.lexsort((key, number))
        if not len(order):
            return
        of = number[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
        n, most = np.diff(np.append(first, len(of))), self.most[of[first]]
        full = n >= most
        self.last[of[first[full]]] = key[order[first[full] + most[full] - 1]]
        order = order[key[order] <= self.last[of] + 1e-8]
        self.rows = [(number[order], ids.take(pa.array(order)), bits[order], key[order])]

    def out(self, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(self.number), pa.string())
        for number, ids, bits, _ in self.rows:
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip((names.take(pa.array(number)), ids, pa.array(bits)), kinds, strict=True)], schema=kinds)


def _draw(seed: int, n: int, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, drawn = None, _Drawn()
        for number, sides in _cells(batches):
            if (strip := (number // n, number % n // STRIP)) != at:
                yield from drawn.out(kinds)
                at, drawn = strip, _Drawn()
            drawn.add(_Cell(*map(pa.Table.from_batches, sides), ["keys", "most"]), seed)
        yield from drawn.out(kinds)

    return run


def _strips(dealt: DataFrame, n: tuple[int, int]) -> DataFrame:
    """Cells dealt so that a task takes STRIP cells of a block of entities in turn."""
    strip = (F.floor(F.col("cell") / n[1]) * n[1] + F.floor(F.col("cell") % n[1] / STRIP)).alias("strip")
    return dealt.repartition(min(n[0] * math.ceil(n[1] / STRIP), MOST_TASKS), strip).sortWithinPartitions("cell", "part")


def drawn(norm: DataFrame, rows: DataFrame, most: DataFrame, least: int, seed: int = 42, block: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """entity_id, candidate_id, kinds of the candidate pairs that come first in the order of ``pairs.sampled``: no pair is shuffled.

    Of each entity those are as many as ``most`` (entity_id, most) says, ``least`` where it says nothing; each strip of cells gives as many, so there are more of them.
    """
    n = _blocks(norm, block, only)
    keys, lists = _lists(rows, n, only)
    forms = lists.join(most, "entity_id", "left").withColumn("most", F.coalesce(F.col("most").cast("int"), F.lit(least)))
    forms = forms.select("entity_id", "one", _forms(["keys", "most"]).alias("forms"))
    return _strips(_met(keys, forms, n), n).mapInArrow(_draw(seed, n[1], to_arrow_schema(StructType.fromDDL(_DRAWN))), _DRAWN)


class Forest:
    """Boosted trees on features, scored by numpy as Spark scores them.

    trees: for each its nodes (feature, threshold, left, right, value), a leaf's feature is -1; the first is the root.
    """

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], weights: list[float], columns: tuple[str, ...]) -> None:
        used = sorted({x[0] for t in trees for x in t if x[0] >= 0})
        self.columns = tuple(columns[f] for f in used)
        self.cuts = [np.unique([x[1] for t in trees for x in t if x[0] == f]) for f in used]
        self.trees, self.weights = [], weights
        for t in trees:
            place = [used.index(f) if f >= 0 else -1 for f, *_ in t]
            bins = [int(np.searchsorted(self.cuts[p], x[1])) if p >= 0 else 0 for p, x in zip(place, t, strict=True)]
            self.trees.append((np.array(place), np.array(bins), np.array([x[2:4] for x in t]), np.array([x[4] for x in t])))
        self.shape = [len(c) + 1 for c in self.cuts]
        self.table = np.full(math.prod(self.shape), np.nan) if math.prod(self.shape) <= MOST_CODES else None

    def _scores(self, bins: np.ndarray) -> np.ndarray:
        """Of rows of bins: x is at most the k-th cut where its bin is at most k."""
        margin, each = np.zeros(len(bins)), np.arange(len(bins))
        for (feature, cut, child, value), w in zip(self.trees, self.weights, strict=True):
            node = np.zeros(len(bins), np.int64)
            while (inner := feature[node] >= 0).any():
                node = np.where(inner, child[node, (bins[each, feature[node]] > cut[node]).astype(np.int64)], node)
            margin += w * value[node]
        return 1 / (1 + np.exp(-2 * margin))

    def scores(self, values: list[np.ndarray], n: int) -> np.ndarray:
        """Of n rows, whose values are those of ``columns``."""
        bins = [(v > c[0]).astype(np.int64) if len(c) == 1 else np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, values, strict=True)]
        if self.table is None:
            return np.concatenate([self._scores(np.stack([b[at : at + 65536] for b in bins], axis=1)) for at in range(0, n, 65536)]) if n else np.zeros(0)
        code = np.ravel_multi_index(bins, self.shape) if bins else np.zeros(n, np.int64)
        out = self.table[code]
        if (new := np.isnan(out)).any():
            codes = np.unique(code[new])
            self.table[codes] = self._scores(np.stack(np.unravel_index(codes, self.shape), axis=1) if bins else np.zeros((len(codes), 0), np.int64))
            out = self.table[code]
        return out


_BEST = "entity_id string, candidate_id string, kinds int, pre_rank_score double"


class _Best:
    """The best pairs of the entities of a strip so far: by score, number of keys and candidate's id."""

    def __init__(self, most: int) -> None:
        self.most, self.number, self.least = most, {}, np.zeros(0)
        self.rows: list[tuple] = []

    def add(self, cell: _Cell, forest: Forest) -> None:
        ids = cell.ids[0][0].to_pylist()
        number = np.array([self.number.setdefault(x, len(self.number)) for x in ids])
        self.least = np.concatenate([self.least, np.full(len(self.number) - len(self.least), -1.0)])
        repeated = any((n > 1).any() for n in cell.n)
        for a, b, bits in _agreeing(cell):
            seen: dict = {}
            own = lambda c: np.full(len(bits), -1.0) if c == "embedding_score" else _own(c, bits).to_numpy(zero_copy_only=False)
            score = forest.scores([own(c) if c in _OWN else _column(cell, c, a, b, seen) for c in forest.columns], len(a))
            some = np.flatnonzero(score >= self.least[number[a]])
            self.rows.append((number[a[some]], cell.ids[1][0].take(pa.array(b[some])), bits[some], score[some]))
            if sum(len(r[0]) for r in self.rows) > STEP:
                self._trim(repeated)
        self._trim(repeated)

    def _trim(self, repeated: bool) -> None:
        if not self.rows:
            return
        number, bits, score = (np.concatenate([r[k] for r in self.rows]) for k in (0, 2, 3))
        ids = pa.concat_arrays([r[1] for r in self.rows])
        codes = ids.dictionary_encode()
        place = np.empty(len(codes.dictionary), np.int64)
        place[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(place))
        place = place[codes.indices.to_numpy()]
        order = np.lexsort((place, -np.bitwise_count(bits).astype(np.int64), -score, number))
        if repeated:  # an id with several rows: its best one counts
            _, one = np.unique(number[order] * (len(codes.dictionary) + 1) + place[order], return_index=True)
            order = order[np.sort(one)]
        sorted_ = number[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1])
        n = np.diff(np.append(first, len(sorted_)))
        rank = np.arange(len(order)) - np.repeat(first, n)
        full = n >= self.most
        self.least[sorted_[first[full]]] = score[order[first[full] + self.most - 1]]
        order = order[rank < self.most]
        self.rows = [(number[order], ids.take(pa.array(order)), bits[order], score[order])]

    def out(self, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(self.number), pa.string())
        for number, ids, bits, score in self.rows:
            columns = [names.take(pa.array(number)), ids, pa.array(bits), pa.array(score)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, kinds, strict=True)], schema=kinds)


def _keep_best(forest: Forest, needs: list[str], most: int, n: int, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, _Best(most)
        for number, sides in _cells(batches):
            if (strip := (number // n, number % n // STRIP)) != at:
                yield from best.out(kinds)
                at, best = strip, _Best(most)
            best.add(_Cell(*map(pa.Table.from_batches, sides), needs), forest)
        yield from best.out(kinds)

    return run


def best(norm: DataFrame, rows: DataFrame, forest: Forest, most: int, block: int | None = None) -> DataFrame:
    """entity_id, candidate_id, kinds, pre_rank_score of the best ``most`` candidate pairs of each entity and strip of cells, the entity's best among them."""
    needs, n = _needs(forest.columns), _blocks(norm, block)
    keys, lists = _lists(rows, n, None)
    dealt = _strips(_met(keys, _formed(norm, lists, needs), n), n)
    return dealt.mapInArrow(_keep_best(forest, needs, most, n[1], to_arrow_schema(StructType.fromDDL(_BEST))), _BEST)


def _value(cell: _Cell, c: str, a: np.ndarray, b: np.ndarray, bits: np.ndarray, seen: dict) -> np.ndarray:
    if c == "embedding_score":
        return np.full(len(bits), -1.0)
    return _own(c, bits).to_numpy(zero_copy_only=False) if c in _OWN else np.asarray(_column(cell, c, a, b, seen))


class Forests:
    """Rankings by a forest each, then by the number of keys."""

    by_keys = True

    def __init__(self, forests: list[Forest]) -> None:
        self.forests = forests
        self.columns = tuple(dict.fromkeys(c for f in forests for c in f.columns))

    def of_columns(self, ranking: int, values: dict[str, np.ndarray], n: int) -> np.ndarray:
        return self.forests[ranking].scores([values[c] for c in self.forests[ranking].columns], n)

    def ahead(self, cell: _Cell, a: np.ndarray, b: np.ndarray, bits: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each ranking the pairs that have at least the score ``least`` of their entity, and their scores."""
        for k, forest in enumerate(self.forests):
            at = np.flatnonzero(np.isfinite(least[k][a]))
            if len(at):
                x, y, kinds, seen = a[at], b[at], bits[at], {}
                score = self.of_columns(k, {c: _value(cell, c, x, y, kinds, seen) for c in forest.columns}, len(at))
                some = np.flatnonzero(score >= least[k][x])
                yield k, at[some], score[some]


class Weights:
    """Rankings by sums of weighted features, rounded to six digits as are the features. String ratios are made only of pairs that could reach ``least`` with them."""

    by_keys = False

    def __init__(self, rankings: list[dict[str, float]]) -> None:
        self.rankings = rankings
        self.columns = tuple(dict.fromkeys(c for weights in rankings for c in weights))

    def of_columns(self, ranking: int, values: dict[str, np.ndarray], n: int) -> np.ndarray:
        total = np.zeros(n)
        for c, w in self.rankings[ranking].items():
            x = values[c]
            total += (six_digits(x) if x.dtype.kind == "f" else x) * w
        return six_digits(total)

    def ahead(self, cell: _Cell, a: np.ndarray, b: np.ndarray, bits: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        seen: dict = {}
        value = {c: _value(cell, c, a, b, bits, seen) for c in self.columns if c not in E.RATIOS}
        could = []
        for k, weights in enumerate(self.rankings):
            bound = np.full(len(a), 1e-3)
            for c, w in weights.items():
                bound += max(w, 0.0) if c in E.RATIOS else value[c] * w  # a ratio is at most 1
            could.append(bound >= least[k][a])
        at = np.flatnonzero(np.logical_or.reduce(could))
        if not len(at):
            return
        x, y, kinds, seen = a[at], b[at], bits[at], {}
        value = {c: v[at] for c, v in value.items()} | {c: _value(cell, c, x, y, kinds, seen) for c in self.columns if c in E.RATIOS}
        for k in range(len(self.rankings)):
            own = np.flatnonzero(could[k][at])
            score = self.of_columns(k, {c: value[c][own] for c in self.rankings[k]}, len(own))
            some = np.flatnonzero(score >= least[k][x[own]])
            yield k, at[own[some]], score[some]


def marks(true: DataFrame, rankings: Forests | Weights) -> DataFrame:
    """row, entity_id, candidate_id, n_keys, ranking and its score of each of these pairs, which come with the features and the number of their ranking."""
    names = [f"f_{c}" for c in rankings.columns]
    rows = true.select(F.monotonically_increasing_id().alias("row"), "entity_id", "candidate_id", F.col("n_keys").cast("int"), F.col("ranking").cast("int"), *[F.col(c).alias(f"f_{c}") for c in rankings.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, score = batch["ranking"].to_numpy(), np.zeros(len(batch))
            value = {c: batch[n].to_numpy(zero_copy_only=False) for c, n in zip(rankings.columns, names, strict=True)}
            for k in np.unique(which):
                at = np.flatnonzero(which == k)
                score[at] = rankings.of_columns(int(k), {c: v[at] for c, v in value.items()}, len(at))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in batch.schema.names[:5]], pa.array(score)], names=[*batch.schema.names[:5], "score"])

    return rows.mapInArrow(run, "row long, entity_id string, candidate_id string, n_keys int, ranking int, score double")


def _count_ahead(rankings: Forests | Weights, many: int, needs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sides in _cells(batches):
            cell = _Cell(*map(pa.Table.from_batches, sides), needs)
            size = cell.sizes("mark_row")[0]
            row, which, id_, keys, score = (cell.columns[c][0].flatten() for c in _MARKS)
            row, which, keys, score = (x.to_numpy(zero_copy_only=False) for x in (row, which, keys, score))
            owner = np.repeat(np.arange(len(size)), size)
            codes = pa.concat_arrays([cell.ids[1][0], id_]).dictionary_encode()
            place = np.empty(len(codes.dictionary), np.int64)
            place[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(place))
            place = place[codes.indices.to_numpy()]
            theirs, own_place = place[: len(cell.ids[1][0])], place[len(cell.ids[1][0]) :]
            least, n = np.full((many, len(size)), np.inf), np.zeros(len(row), np.int64)
            np.minimum.at(least, (which, owner), score)
            for a, b, bits in _agreeing(cell):
                for k, at, value in rankings.ahead(cell, a, b, bits, least):
                    if not len(at):
                        continue
                    lo, hi = np.searchsorted(owner, (a[at].min(), a[at].max() + 1))
                    mark = lo + np.flatnonzero(which[lo:hi] == k)
                    many_keys = np.bitwise_count(bits[at]).astype(np.int64) * rankings.by_keys
                    whose = np.concatenate([owner[mark], a[at]])
                    late = np.repeat([0, 1], [len(mark), len(at)])  # a pair is not ahead of itself
                    order = np.lexsort((late, np.concatenate([own_place[mark], theirs[b[at]]]), -np.concatenate([keys[mark] * rankings.by_keys, many_keys]), -np.concatenate([score[mark], value]), whose))
                    before = np.concatenate([[0], np.cumsum(late[order])])
                    there = np.flatnonzero(late[order] == 0)
                    n[mark[order[there]]] += before[there] - before[np.searchsorted(whose[order], whose[order[there]])]
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(n[some])], names=["row", "n"])

    return run


def ranks(norm: DataFrame, rows: DataFrame, marked: DataFrame, rankings: Forests | Weights, many: int, block: int | None = None) -> DataFrame:
    """The ``marks`` (a kept table) with each pair's rank, from 1, among all candidates of its entity: cells count the pairs ahead of it, no other pair leaves them."""
    needs = [*_needs(rankings.columns), *_MARKS]
    only = marked.select("entity_id").distinct()
    n = _blocks(norm, block, only)
    keys, lists = _lists(rows, n, only)
    each = F.struct("row", "ranking", F.col("candidate_id").alias("id"), F.col("n_keys").alias("keys"), "score")
    each = marked.groupBy("entity_id").agg(F.collect_list(each).alias("m")).select("entity_id", F.lit(True).alias("one"), *[F.col(f"m.{c[5:]}").alias(c) for c in _MARKS])
    dealt = _met(keys, _formed(norm, lists.join(each, ["entity_id", "one"], "left"), needs), n).repartition(min(n[0] * n[1], MOST_TASKS), "cell").sortWithinPartitions("cell", "part")
    ahead = dealt.mapInArrow(_count_ahead(rankings, many, needs), "row long, n long").groupBy("row").agg(F.sum("n").alias("n"))
    return marked.join(ahead, "row", "left").withColumn("rank", F.coalesce("n", F.lit(0)) + 1).drop("n")
