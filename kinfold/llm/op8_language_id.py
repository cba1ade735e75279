"""Operator 8: language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's likelihood is the sum, over all ways to
cut it into pieces, of the product of their probabilities, by a forward algorithm over the word; a text's is the product over its words.
The probabilities are learnt by expectation maximisation (forward and backward sums) on a bounded, documented sample of labelled texts.

Plan. No shuffle of text: scoring is one pass, vectorised over the distinct words of a batch, with a bounded memory of
words that came before. The fit reads words of at most about FIT_DOCUMENTS texts a language (chosen by a hash of doc_id,
so the same at every run); the vocabulary and the probabilities have a fixed size and are broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import U64, codes_of, keep, partitions, pieces, within, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 4, 2
FIT_DOCUMENTS = 600
ROUNDS = 3
LONGEST = 16
UNKNOWN = 1e-7
REMEMBERED = 300_000
MOST_LANGUAGES = 500

_BASE = U64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """The lower-case pieces of letters of a vocabulary file: a sentencepiece model or tiktoken ranks."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            raw = [base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in f if line.strip()]
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    found = {p.replace("▁", "").strip().lower() for p in raw}
    return sorted(p for p in found if p and p.isalpha() and len(p) <= LONGEST)


def letters(word: str) -> list[str]:
    """The runs of letters of a word, in lower case."""
    word = word.lower()
    if word.isalpha():
        return [word]
    return "".join(c if c.isalpha() else " " for c in word).split()


class Lattice:
    """Finds the pieces at each place of words."""

    def __init__(self, known: list[str]):
        self.size = len(known)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p in known}):
            ids = np.array([i for i, p in enumerate(known) if len(p) == n])
            h = np.zeros(len(ids), U64)
            for column in self._points([known[i] for i in ids], n).T:
                h = self._next(h, column)
            order = np.argsort(h)
            self.tables[n] = h[order], ids[order]

    @staticmethod
    def _points(words: list[str], n: int) -> np.ndarray:
        return np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n).astype(U64)

    @staticmethod
    def _next(h: np.ndarray, points: np.ndarray) -> np.ndarray:
        h = (h + points + U64(1)) * _BASE
        return h ^ (h >> U64(29))

    def pieces(self, words: list[str], n: int) -> dict[int, np.ndarray]:
        """For words of n characters: by length, the piece that begins at each place; the number of pieces if there is none."""
        points = self._points(words, n)
        h, out = np.zeros((len(words), n), U64), {}
        for size in range(1, min(n, max(self.tables, default=1)) + 1):
            h = self._next(h[:, : n - size + 1], points[:, size - 1 :])
            if size in self.tables:
                keys, ids = self.tables[size]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out[size] = np.where(keys[at] == h, ids[at], self.size)
            elif size == 1:
                out[size] = np.full(h.shape, self.size)
        return out

    def forward(self, words: list[str], n: int, p: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray]:
        """Log likelihood of each word (all of n characters) for each column of p, and what a backward pass needs.

        p has a row a piece, then a row of zeros. A single character is always a piece, of UNKNOWN probability at least.
        Sums are scaled at each place, so words of any length neither overflow nor vanish.
        """
        found, many = self.pieces(words, n), p.shape[1]
        alpha, log = np.zeros((n + 1, len(words), many)), np.zeros((n + 1, len(words)))
        alpha[0] = 1.0
        for i in range(1, n + 1):  # alpha[i] stands for alpha[i] * exp(log[i])
            total = np.zeros((len(words), many))
            for size, ids in found.items():
                if size <= i:
                    q = p[ids[:, i - size]] + UNKNOWN if size == 1 else p[ids[:, i - size]]
                    total += alpha[i - size] * q * np.exp(log[i - size] - log[i - 1])[:, None]
            top = total.max(axis=1)
            alpha[i] = total / top[:, None]
            log[i] = log[i - 1] + np.log(top)
        return np.log(alpha[n]) + log[n][:, None], found, alpha, log


def by_length(words: list[str], many: int = 4, most: int = 20_000) -> Iterator[tuple[int, list[int]]]:
    """Numbers of the words of each length, in lots whose places times languages are bounded."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, own in sorted(groups.items()):
        lot = max(1, most * 32 // (n * max(4, many)))
        for at in range(0, len(own), lot):
            yield n, own[at : at + lot]


def expected(lattice: Lattice, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How often each piece (and, last, no piece) stands in words of which each language has so many, over all segmentations by p."""
    many, size = counts.shape[1], lattice.size
    out = np.zeros((size + 1) * many)
    for n, own in by_length(words, many):
        weight = counts[own]
        total, found, alpha, log = lattice.forward([words[i] for i in own], n, p)
        beta, tail = np.zeros((n + 1, len(own), many)), np.zeros((n + 1, len(own)))
        beta[n] = 1.0
        for i in range(n - 1, -1, -1):
            s = np.zeros((len(own), many))
            for k, ids in found.items():
                if i + k <= n:
                    q = p[ids[:, i]] + UNKNOWN if k == 1 else p[ids[:, i]]
                    part = q * beta[i + k] * np.exp(tail[i + k] - tail[i + 1])[:, None]
                    s += part
                    share = alpha[i] * part * np.exp(log[i][:, None] + tail[i + 1][:, None] - total)
                    at = ids[:, i][:, None] * many + np.arange(many)
                    out += np.bincount(at.reshape(-1), weights=(share * weight).reshape(-1), minlength=len(out))
            top = np.maximum(s.max(axis=1), 1e-300)
            beta[i], tail[i] = s / top[:, None], tail[i + 1] + np.log(top)
    return out.reshape(size + 1, many)


def even(size: int, many: int) -> np.ndarray:
    """The probabilities a fit begins with."""
    p = np.full((size + 1, many), 1.0 / max(size, 1))
    p[size] = 0.0
    return p


def likeliest(counted: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts, drawn towards those of all languages together."""
    c = counted.copy()
    c[-1] = 0.0
    pooled = c.sum(axis=1, keepdims=True) + 0.01
    pooled[-1] = 0.0
    return (c + 20.0 * pooled / pooled.sum()) / (c.sum(axis=0, keepdims=True) + 20.0)


def fit(words: DataFrame, known: list[str], many: int, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities (pieces and a row of zeros, by language) from rows word, langs (numbers), n (how often each has it).

    Each round's expectation runs where the words are; pieces x languages sums come together in two steps, a slice of pieces a row.
    """
    spark, size = words.sparkSession, len(known)
    p, step = even(size, many), max(1, 32_768 // many)
    parts = max(1, int(words.rdd.getNumPartitions() ** 0.5))
    kinds = "part int, at int, y binary"

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f8") for x in table.column("y").to_pylist())
        return pa.table({"part": pa.array([0], pa.int32()), "at": table.column("at").slice(0, 1).cast(pa.int32()), "y": pa.array([total.tobytes()], pa.binary())})

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((known, p))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, p = shared.value
            lattice, total = Lattice(known), np.zeros((size + 1, many))
            for batch in batches:
                own = batch.column("word").to_pylist()
                counts = np.zeros((len(own), many))
                for i, (langs, n) in enumerate(zip(batch.column("langs").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                    counts[i, langs] = n
                total += expected(lattice, own, counts, p)
            at = range(0, size + 1, step)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % parts] * len(at), pa.int32()), pa.array(list(at), pa.int32()), pa.array([total[i : i + step].tobytes() for i in at], pa.binary())], names=["part", "at", "y"]
            )

        sums = words.mapInArrow(count, kinds).groupBy("part", "at").applyInArrow(add, kinds).groupBy("at").applyInArrow(add, kinds)
        total = np.zeros((size + 1, many))
        for r in sums.collect():
            total[r.at : r.at + step] = np.frombuffer(r.y, "<f8").reshape(-1, many)
        p = likeliest(total)
    return p


def _crc(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def identified(documents: DataFrame, path: str = VOCABULARY, fit_documents: int = FIT_DOCUMENTS, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row (columns doc_id, text, lang; others are ignored).

    Learns from about ``fit_documents`` texts a language (their whole words), of rows whose lang is not null and whose crc32(doc_id) mod
    ``folds`` is not ``held_out``; the expectation runs in the cluster, so neither long texts nor many words of the sample meet in one place.
    Over MOST_LANGUAGES languages raise an error: the model is pieces x languages numbers. lang_pred is the likeliest language; score its posterior probability with equal priors. Texts that are null or
    have no letter are ``und`` with score 0, and so is every text when nothing could be learnt. Ties go to the first
    language by code point. Rows with a null doc_id are scored and not learnt from; repeated rows are rows like others.
    """
    spark = documents.sparkSession
    held = F.coalesce(_crc(folds) == held_out, F.lit(False)).alias("held_out")
    labelled = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (_crc(folds) != held_out)).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r.lang, F.lit(fit_documents / r["count"])).otherwise(share)
    sample = labelled.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(8)), 11) < share * float(1 << 53))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            langs = piece.column("lang").to_pylist()
            flat, starts = words_of(piece.column("text"))
            codes, distinct = codes_of(flat)
            text, _ = within(starts)
            names = sorted(set(langs))
            lang = np.array([names.index(x) for x in langs])
            value, count = np.unique(lang[text] * np.int64(max(1, len(distinct))) + codes, return_counts=True)
            rows = [(names[v // len(distinct)], run, c) for v, c in zip(value.tolist(), count.tolist(), strict=True) for run in letters(distinct[v % len(distinct)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    known = vocabulary(path)
    rows = keep(sample.select("text", "lang").mapInArrow(spread, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")), "counts")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())  # of those counted above
    if langs:
        number = {x: i for i, x in enumerate(langs)}
        rows = rows.withColumn("lang", F.create_map(*[F.lit(v) for pair in number.items() for v in pair])[F.col("lang")])
        rows = rows.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("r")).select("word", F.col("r.lang").alias("langs"), F.col("r.n").alias("n"))
        p = fit(keep(rows.repartition(partitions(spark), "word"), "words"), known, len(langs))
    else:
        p = np.zeros((len(known) + 1, 1))
    lattice = Lattice(known)
    shared = spark.sparkContext.broadcast((lattice, p, langs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, p, langs = shared.value
        seen: dict[str, np.ndarray | None] = {}
        many = max(1, len(langs))
        for piece in pieces(batches, "text", 8_000_000):
            flat, starts = words_of(piece.column("text"))
            codes, distinct = codes_of(flat)
            if len(seen) > REMEMBERED:
                seen.clear()
            new = [w for w in distinct if w not in seen]
            runs = {w: letters(w) for w in new}
            plain = sorted({r for own in runs.values() for r in own})
            value = np.zeros((len(plain), many))
            for n, own in by_length(plain, many):
                value[own] = lattice.forward([plain[i] for i in own], n, p)[0] if langs else 0.0
            at = {r: i for i, r in enumerate(plain)}
            for w, own in runs.items():
                seen[w] = value[[at[r] for r in own]].sum(axis=0) if own else None
            spelt = np.array([seen[w] is not None for w in distinct], bool)
            table = np.stack([seen[w] if seen[w] is not None else np.zeros(many) for w in distinct]) if distinct else np.zeros((0, many))
            text, _ = within(starts)
            n = piece.num_rows
            total = np.stack([np.bincount(text, weights=table[codes, k] if len(codes) else None, minlength=n) for k in range(many)], axis=1)
            with_letter = np.bincount(text, weights=spelt[codes] if len(codes) else None, minlength=n) > 0
            best = total.argmax(axis=1)
            top = 1 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700)).sum(axis=1)
            named = with_letter & bool(langs)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([langs[b] if ok else "und" for b, ok in zip(best, named, strict=True)], pa.string()), pa.array(np.where(named, top, 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    out = documents.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held, "lang_pred", "score")
