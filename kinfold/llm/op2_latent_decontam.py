"""Operator 2: benchmark decontamination by latent semantic retrieval.

Documents and benchmark texts are cut into passages, weighted by TF-IDF over the benchmark's words. A distributed randomised SVD of all
passages gives a latent space; the benchmark's passages weigh as much in it as the documents', so that it spans both. Every window of
a document whose latent cosine with a passage reaches COSINE is a candidate of the passage's item, by a product of all windows with
all passages, and there is no other way to become one. A candidate counts if the longest common subsequence of words with the
whole item is long enough (so edits and paraphrases in order are found), the item's rarer words stand in it too, and so does enough
of its answer, its last words.

Plan. The text is read once: only two bytes a word are kept (in the shared folder), the word's feature, a hash, if the benchmark has it;
two words count as equal if their features are. The passes over them (document frequencies, SVD, search) shuffle nothing but sums. The SVD takes one pass: each task adds up A^T (A Omega) over its passages, a
matrix of FEATURES hashed words at most by rank, and two levels of sums add these. Frequencies, weights and space are those of the
whole benchmark; only the search takes it in slices of about SLICE_WORDS words, a pass each. So nothing that is broadcast or collected
grows with documents or benchmark, and the slices change no row. The search costs windows times passages, as a matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import LOWER_ALNUM, U64, hashes_of, keep, pieces, within, words_of

BLOCK = 32  # words; a window is two blocks, and so holds every run of BLOCK words somewhere
FEATURES = (1 << 16) - 1  # words are columns of A by a hash; the number itself stands for words the benchmark has not
RANK = 128  # at least, and an eighth of the benchmark's passages,
MOST_RANK = 512  # at most
OVERSAMPLE = 16
MOST_COMMON = 0.03  # words in more passages than this are no terms (but each passage of the benchmark keeps its LEAST_TERMS rarest)
LEAST_PASSAGES = 16  # words in no more passages than this are terms in any case
LEAST_TERMS = 8
LEAST_VALUE = 1e-3  # directions of a smaller part of the largest eigenvalue are noise
COSINE = 0.4
SHORT = 16  # an item of fewer words can't fill a window: its cosine is scaled
LCS_SHARE = 0.55
TERM_SHARE = 0.4
LEAST_WORDS = 8
ANSWER_WORDS = 8
ANSWER_SHARE = 0.375
SLICE_WORDS = 200_000
CHUNK = 1 << 16
LAYERS = 32  # most rows that one run of a sum has
SIDE = 1024  # runs that are added up side by side, few enough for a cache

FOUND = "doc_id long, key long, cosine double, lcs_share double, answer_share double, first_word long, last_word long"
SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long, last_word long"


@dataclass
class Space:
    """The latent space of the whole benchmark."""

    column: np.ndarray  # of each feature; -1: not of the benchmark (so that of FEATURES itself)
    weight: np.ndarray  # of each column; 0: no term
    vectors: np.ndarray  # columns by rank, weights included, scaled to equal spread in every direction

    def columns(self, codes: np.ndarray) -> np.ndarray:
        return self.column[codes]

    def terms(self, codes: np.ndarray) -> np.ndarray:
        """Whether each word is a term."""
        at = self.columns(codes)
        return (at >= 0) & (self.weight[at] > 0)


@dataclass
class Items:
    """A slice of the benchmark's texts and their passages in the latent space."""

    keys: list[int]
    bodies: list[list[int]]
    terms: list[list[int]]
    owner: np.ndarray  # of each passage, the text
    latent: np.ndarray  # passages by rank, of length 1
    least: np.ndarray  # the cosine each passage asks for


def passages_of(body: np.ndarray) -> list[np.ndarray]:
    """Runs of BLOCK words, the last one ending where the text does."""
    begins = [*range(0, max(1, len(body) - BLOCK + 1), BLOCK)]
    if len(body) > BLOCK and begins[-1] + BLOCK < len(body):
        begins.append(len(body) - BLOCK)
    return [body[b : b + BLOCK] for b in begins] if len(body) else []


def items_of(rows: list[tuple[int, bytes]], space: Space, cosine: float) -> Items:
    bodies = [np.frombuffer(c, "<u2") for _, c in rows]
    owner, latent, least = [], [], []
    for i, body in enumerate(bodies):
        for own in passages_of(body):
            at = space.columns(own)
            owner.append(i)
            latent.append(space.vectors[at].sum(axis=0))
            least.append(cosine * math.sqrt(min(1.0, len(body) / SHORT)) if cosine < 1 else cosine)
    latent = np.stack(latent)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Items([k for k, _ in rows], [b.tolist() for b in bodies], [b[space.terms(b)].tolist() for b in bodies], np.array(owner, np.int64), latent.astype(np.float32), np.array(least, np.float32))


def randomised_svd(y: np.ndarray, omega: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of A and the squares of its singular values, from one pass's Y = A^T A Omega."""
    q, _ = np.linalg.qr(y)
    b = (q.T @ y) @ np.linalg.pinv(q.T @ omega)
    value, vector = np.linalg.eigh((b + b.T) / 2)
    order = np.argsort(-value)[:rank]
    return q @ vector[:, order], value[order]


def omega_of(columns: int, rank: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((columns, min(columns, rank + OVERSAMPLE))).astype(np.float32)


def _sums(table: np.ndarray, index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of table[index] by row number, which must not fall; CHUNK at a time, so memory doesn't follow a text's length.

    Runs of equal rows, LAYERS long at most, are added up side by side, the longest first: their k-th members in one step.
    """
    out = np.zeros((n, table.shape[1]), np.float32)
    for s in range(0, len(rows), CHUNK):
        at, own = rows[s : s + CHUNK], index[s : s + CHUNK]
        run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        first = np.flatnonzero((np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % LAYERS == 0)
        size = np.diff(np.append(first, len(at)))
        order = np.argsort(-size, kind="stable")
        whole = len(first) == len(run)
        parts = None if whole else np.empty((len(first), table.shape[1]), np.float32)
        for lo in range(0, len(order), SIDE):
            these = order[lo : lo + SIDE]
            begin, longer = first[these], -size[these]
            sums = table[own[begin]]
            for k in range(1, -int(longer[0])):
                m = int(np.searchsorted(longer, -k))  # runs of more than k
                sums[:m] += table[own[begin[:m] + k]]
            if whole:
                out[at[begin]] += sums
            else:
                parts[these] = sums
        if not whole:
            out[at[run]] += _sums(parts, np.arange(len(first)), np.searchsorted(run, first, side="right") - 1, len(run))
    return out


def _coded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of each text, and where each text's begin."""
    column = batch.column("codes")
    size = pc.binary_length(column).to_numpy() // 2
    return np.frombuffer(b"".join(column.to_pylist()), "<u2"), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _blocks(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its block, and where each document's blocks begin."""
    begin = np.concatenate([[0], np.cumsum(-(-np.diff(starts) // BLOCK))])
    text, at = within(starts)
    return begin[text] + at // BLOCK, begin


def common_subsequence(item: list[int], text: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence, and after how many words of text it is reached first. Bit-parallel."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    s, best, at = full, 0, 0
    for k, w in enumerate(text):
        if m := masks.get(w, 0):
            u = s & m
            s = ((s + u) | (s - u)) & full
            if (n := len(item) - s.bit_count()) > best:
                best, at = n, k + 1
    return best, at


def checked(item: list[int], terms: list[int], text: np.ndarray, is_term, lo: int, hi: int, lcs_share: float, answer_share: float) -> tuple[float, float, int, int] | None:
    """Whether the item stands around words lo..hi of a text: LCS share, answer share, first and last word; None if not."""
    n = len(item)
    lo, hi = max(0, lo - n), min(len(text), hi + n)
    need = max(math.ceil(lcs_share * n), min(n, LEAST_WORDS))
    near = text[lo:hi].tolist()
    distinct = set(item)
    if len(distinct.intersection(near)) + n - len(distinct) < need:  # no subsequence can be longer than this
        return None
    found, end = common_subsequence(item, near)
    if found < need:
        return None
    begin = max(lo, lo + end - n - n // 2)
    found, back = common_subsequence(item[::-1], text[begin : lo + end][::-1].tolist())
    if found < need:
        return None
    first = lo + end - back
    around = text[first : min(len(text), lo + end + ANSWER_WORDS)]
    if common_subsequence(terms, around[is_term(around)].tolist())[0] < TERM_SHARE * len(terms):
        return None
    answer = item[-ANSWER_WORDS:]
    got = common_subsequence(answer, around.tolist())[0] / len(answer)
    return (found / n, got, first, lo + end - 1) if got >= answer_share else None


def _search(space, items, lcs_share: float, answer_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = space.value, items.value
        step = max(64, 8_000_000 // len(own.owner))  # windows of one product
        for piece in pieces(batches, "codes", 1_000_000):
            codes, starts = _coded(piece)
            block, begin = _blocks(starts)
            column = at.columns(codes)
            term = np.flatnonzero(column >= 0)
            term = term[at.weight[column[term]] > 0]
            n_blocks = int(begin[-1])
            window = _sums(at.vectors, column[term], block[term], n_blocks)
            last = np.zeros(n_blocks, bool)
            last[begin[1:][np.diff(begin) > 0] - 1] = True
            after = np.flatnonzero(~last)
            window[after] += window[after + 1]  # the right side is read before it is written: a block and the next of its document
            window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-12)
            doc_of = np.searchsorted(begin, np.arange(n_blocks), side="right") - 1
            best: dict[tuple[int, int], tuple] = {}
            for s in range(0, n_blocks, step):
                near = window[s : s + step] @ own.latent.T
                w, passage = np.nonzero(near >= own.least[None, :])
                seen = set()
                for k, item, cosine in zip((w + s).tolist(), own.owner[passage].tolist(), near[w, passage].tolist(), strict=True):
                    if (k, item) in seen:  # of another passage of the same item
                        continue
                    seen.add((k, item))
                    doc = int(doc_of[k])
                    lo = (k - int(begin[doc])) * BLOCK
                    found = checked(own.bodies[item], own.terms[item], codes[starts[doc] : starts[doc + 1]], at.terms, lo, lo + 2 * BLOCK, lcs_share, answer_share)
                    if found and ((doc, item) not in best or found[0] > best[doc, item][1]):
                        best[doc, item] = (round(cosine, 3), *found)
            ids = piece.column("doc_id").to_pylist()
            rows = [(ids[d], own.keys[i], *v) for (d, i), v in sorted(best.items())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64() if k in (0, 1, 5, 6) else pa.float64()) for k in range(7)],
                names=["doc_id", "key", "cosine", "lcs_share", "answer_share", "first_word", "last_word"],
            )

    return run


def _codes(used: np.ndarray | None = None):
    """Features of the words of each text; of those that are not used FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            flat, starts = words_of(piece.column("text"), LOWER_ALNUM)
            codes = (hashes_of(flat) % U64(FEATURES)).astype("<u2")
            if used is not None:
                codes = np.where(used[codes], codes, FEATURES).astype("<u2")
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([codes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())], names=["doc_id", "codes"])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the benchmark's words, and under -1 its number of passages."""
    used, passages = np.zeros(FEATURES, bool), 0
    for piece in pieces(batches, "codes", 2_000_000):
        codes, starts = _coded(piece)
        used[codes] = True
        passages += sum(max(1, -(-int(n) // BLOCK)) for n in np.diff(starts))
    at = np.flatnonzero(used)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int64)), pa.array(np.append(np.ones(len(at), np.int64), passages))], names=["i", "n"])


def _summed(df: DataFrame) -> dict[int, int]:
    """Sums by number of the rows (i, n); their numbers are FEATURES + 1 at most."""
    return {r.i: r.n for r in df.groupBy("i").agg(F.sum("n").alias("n")).collect()}


def _frequencies(coded: DataFrame, column: np.ndarray, columns: int) -> tuple[np.ndarray, int]:
    """In how many passages of the documents each column's words are, and how many passages there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(columns + 1, np.int64)
        for piece in pieces(batches, "codes", 2_000_000):
            codes, starts = _coded(piece)
            block, begin = _blocks(starts)
            at = column[codes]
            known = np.flatnonzero(at >= 0)
            cell = np.sort(block[known] * np.int64(columns) + at[known])
            total[:columns] += np.bincount(cell[np.concatenate([[True], cell[1:] != cell[:-1]])] % columns if len(cell) else cell, minlength=columns)
            total[columns] += begin[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(columns + 1)), pa.array(total)], names=["i", "n"])

    sums = _summed(coded.mapInArrow(count, "i long, n long"))
    return np.array([sums.get(i, 0) for i in range(columns)], np.float64), sums.get(columns, 0)


def _rarest(coded: DataFrame, column: np.ndarray, with_word: np.ndarray) -> np.ndarray:
    """The columns of the LEAST_TERMS rarest words of each passage of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = np.zeros(len(with_word), bool)
        for piece in pieces(batches, "codes", 2_000_000):
            codes, starts = _coded(piece)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                for own in passages_of(codes[a:b]):
                    distinct = np.unique(column[own])
                    term[distinct[np.argsort(with_word[distinct], kind="stable")[:LEAST_TERMS]]] = True
        at = np.flatnonzero(term)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.ones(len(at), np.int64))], names=["i", "n"])

    return np.array(sorted(_summed(coded.mapInArrow(run, "i long, n long"))), np.int64)


def _sketch(coded: DataFrame, column: np.ndarray, weight: np.ndarray, rank: int) -> np.ndarray:
    """A^T A Omega over the number of rows of A: the passages of the coded texts, each of length 1."""
    columns = len(weight)
    width = min(columns, rank + OVERSAMPLE)
    rows = max(1, 32_768 // width)  # columns in one row of partial sums
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast((column, weight))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, weight = shared.value
        y = np.zeros((columns, width), np.float32)
        scaled = omega_of(columns, rank) * weight[:, None]
        passages = 0
        for piece in pieces(batches, "codes", 1_000_000):
            codes, starts = _coded(piece)
            block, begin = _blocks(starts)
            at = column[codes]
            term = np.flatnonzero(at >= 0)
            term = term[weight[at[term]] > 0]
            of, word = block[term], at[term]
            norm = np.bincount(of, weights=weight[word].astype(np.float64) ** 2, minlength=int(begin[-1]))
            passages += int((norm > 0).sum())
            a = _sums(scaled, word, of, int(begin[-1])) / np.maximum(norm, 1e-12)[:, None].astype(np.float32)
            order = np.argsort(word, kind="stable")
            y += _sums(a, of[order], word[order], columns) * weight[:, None]
        at = [*range(0, columns, rows), -1]  # -1: the number of passages
        body = [*(y[i : i + rows].tobytes() for i in at[:-1]), np.array([passages], "<f4").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(body, pa.binary())], names=["part", "at", "y"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in table.column("y").to_pylist())
        return pa.table({"part": pa.array([0], pa.int32()), "at": table.column("at").slice(0, 1).cast(pa.int32()), "y": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    kinds = "part int, at int, y binary"
    parts = max(1, math.isqrt(coded.rdd.getNumPartitions()))
    partial = coded.mapInArrow(sketch, kinds).withColumn("part", F.pmod("part", F.lit(parts))).groupBy("part", "at").applyInArrow(add, kinds)
    y, passages = np.zeros((columns, width)), 0.0
    for r in partial.groupBy("at").applyInArrow(add, kinds).collect():
        if r.at < 0:
            passages = float(np.frombuffer(r.y, "<f4")[0])
        else:
            y[r.at : r.at + rows] = np.frombuffer(r.y, "<f4").reshape(-1, width)
    return y / max(passages, 1.0)


def latent_space(coded: DataFrame, bench: DataFrame, used: list[int], passages: int, rank: int, most_common: float) -> Space:
    """The space of all passages of documents and benchmark (of the features and passages given), both weighing the same."""
    column = np.full(FEATURES + 1, -1, np.int32)
    column[used] = np.arange(len(used))
    with_word, blocks = _frequencies(coded, column, len(used))
    term = with_word <= max(most_common * blocks, LEAST_PASSAGES)
    term[_rarest(bench, column, with_word)] = True
    weight = np.where(term, np.log((blocks + 1) / (with_word + 1)) + 1e-3, 0.0).astype(np.float32)
    rank = min(MOST_RANK, max(rank, passages // 8))
    y = _sketch(coded, column, weight, rank) + _sketch(bench, column, weight, rank)
    vectors, value = randomised_svd(y, omega_of(len(used), rank).astype(np.float64), rank)
    good = value > LEAST_VALUE * value[0]
    return Space(column, weight, (vectors[:, good] * weight[:, None] / np.sqrt(value[good])).astype(np.float32))


def _slices(bench: DataFrame, slice_words: int) -> list[list[tuple[int, bytes]]] | Iterator[list[tuple[int, bytes]]]:
    """The benchmark's texts with words, a slice at a time: at most twice slice_words words, or one text."""
    sized = bench.select(F.col("doc_id").alias("key"), "codes", (F.length("codes") / 2).cast("long").alias("n")).where("n > 0")
    many = max(1, math.ceil((sized.agg(F.sum("n").alias("n")).first().n or 0) / slice_words))
    while True:
        part = F.pmod(F.xxhash64("key"), F.lit(many))
        worst = sized.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).where(f"texts > 1 AND n > {2 * slice_words}").limit(1).count()
        if not worst:
            break
        many *= 2
    for k in range(many):
        if rows := [(r.key, bytes(r.codes)) for r in sized.where(part == k).orderBy("key").collect()]:
            yield rows


def contaminated(
    documents: DataFrame, benchmark: DataFrame, rank: int = RANK, most_common: float = MOST_COMMON, cosine: float = COSINE, lcs_share: float = LCS_SHARE, answer_share: float = ANSWER_SHARE, slice_words: int = SLICE_WORDS
) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, first_word, last_word: a row for each document (columns doc_id, text) and item (item_id, text) that stands in it.

    Words are runs of ASCII letters, digits and non-ASCII in lower case. Of the item's places in a document the one of the largest lcs_share is given, words from
    0. Items of under LEAST_WORDS words count only if all stand there in order; of others LCS_SHARE of the words must, so a shorter part of a long item is no hit.
    Null and empty texts hold nothing and stand nowhere; rows with a null id are like others; repeated rows of either table give repeated rows; of equally good
    places the first counts. An empty table on either side gives none. Texts of any length are read whole. slice_words changes the work and no row.
    """
    spark = documents.sparkSession
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    distinct = keep(texts.select("text").distinct().withColumn("doc_id", F.monotonically_increasing_id()), "texts")
    bench = keep(distinct.mapInArrow(_codes(), "doc_id long, codes binary"), "items")
    used = _summed(bench.mapInArrow(_features, "i long, n long"))
    passages = used.pop(-1, 0)
    if not used:
        return spark.createDataFrame([], SCHEMA)
    mask = np.zeros(FEATURES + 1, bool)
    mask[list(used)] = True
    coded = keep(documents.select("doc_id", "text").mapInArrow(_codes(mask), "doc_id long, codes binary"), "codes")
    space = latent_space(coded, bench, sorted(used), passages, rank, most_common)
    shared = spark.sparkContext.broadcast(space)
    found = None
    for rows in _slices(bench, slice_words):
        items = spark.sparkContext.broadcast(items_of(rows, space, cosine))
        part = coded.mapInArrow(_search(shared, items, lcs_share, answer_share), FOUND)
        found = part if found is None else found.unionByName(part)
    ids = texts.join(distinct, "text").select("item_id", F.col("doc_id").alias("key"))
    return found.join(ids, "key").select("doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word", "last_word")
