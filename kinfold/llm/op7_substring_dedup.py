"""Operator 7: removal of repeated word windows, found by difference-cover anchors.

Of every text the runs of WIDTH - PERIOD + 1 words that begin at a cover position (modulo PERIOD) are hashed. For any
two starts there is a shift below PERIOD that takes both to cover positions, so two equal windows of WIDTH words share an
equal, aligned anchor. A window none of whose anchors occurs twice is therefore unique; the others (the extensions of
repeated anchors) are hashed whole and compared by their first place.

Plan. Anchors go to buckets of their hash, places back to groups of documents, whole windows to buckets again and the
repeated starts back to the documents: the text is shuffled once (both uses read one exchange). Places travel packed and compressed, as
arrays of one row for each source chunk and bucket. Of equal hashes of one chunk only the first place goes to the bucket of
the hash, for all of them; the others are known to repeat and pass through the buckets of their documents. So a passage that
a third of all documents share gives its bucket an entry a chunk. Group counts follow spark.sql.shuffle.partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import hashes_of, packed, partitions, pieces, prime_from, rolled, unpacked, within, words_of

WIDTH = 20
GROUP_BYTES = 32 << 20  # of text that one group of documents has on average at most
NULL_IDS = 1 << 40  # the largest ids stand for null ones
PERIOD = 13
COVER = (0, 1, 3, 9)  # every residue modulo 13 is a difference of two of these

_PACK = "bucket int, keys binary, checks binary, docs binary, places binary, known binary"
_PLACES = "grp long, docs binary, places binary"
#: known: 0, not yet seen twice; 1, seen twice in its chunk, and stands for its hash; 2, a further one of its chunk.


def _squeezed(a: np.ndarray, kind: str) -> bytes:
    """Differences, compressed: ids and places in order take a byte or two."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(a.astype(kind), prepend=np.zeros(1, kind)).tobytes())


def _stretched(column, kind: str) -> np.ndarray:
    own = zstandard.ZstdDecompressor()
    parts = [np.cumsum(np.frombuffer(own.decompress(x), kind), dtype=kind) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _bucket(keys: np.ndarray, docs: np.ndarray, known: np.ndarray, n: int) -> np.ndarray:
    """By hash; the further places of a chunk are settled there and only pass through a bucket: by document, so no hash is hot."""
    return np.where(known == 2, docs % n, ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int64))


def _rows(buckets: np.ndarray, n: int, keys, checks, docs, places, known) -> pa.RecordBatch:
    """One row a bucket with entries, by document and place: these columns then compress well."""
    order = np.lexsort((places, docs, buckets))
    ends = np.searchsorted(buckets[order], np.arange(n + 1))
    full = np.flatnonzero(np.diff(ends))
    cut = lambda a, kind, pack=packed: pa.array([pack(a[order[ends[b] : ends[b + 1]]], kind) for b in full], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), cut(keys, "<u8"), cut(checks, "<u4"), cut(docs, "<i8", _squeezed), cut(places, "<i4", _squeezed), cut(known, "u1")],
        names=["bucket", "keys", "checks", "docs", "places", "known"],
    )


def _places(docs: np.ndarray, places: np.ndarray, groups: int) -> pa.Table:
    """One row a group of documents with entries."""
    grp = docs % groups
    order = np.lexsort((places, docs, grp))
    full, begin = np.unique(grp[order], return_index=True)
    ends = [*begin, len(order)]
    cut = lambda a, kind: pa.array([_squeezed(a[order[ends[i] : ends[i + 1]]], kind) for i in range(len(full))], pa.binary())
    return pa.table({"grp": pa.array(full, pa.int64()), "docs": cut(docs, "<i8"), "places": cut(places, "<i4")})


def _merged(keys, checks, docs, places) -> tuple[np.ndarray, np.ndarray]:
    """An order of the entries by hash, document and place, and how each is known (see above), in that order."""
    order = np.lexsort((places, docs, checks, keys))
    k, c = keys[order], checks[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    before = np.append(same[1:], False)[: len(k)]
    return order, np.where(same, 2, np.where(before, 1, 0)).astype(np.uint8)


def removed(documents: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row of documents (columns doc_id, text; others are ignored).

    Each word is removed that a window of ``width`` words covers whose words also start earlier: at a smaller doc_id, or in
    the same document before. Words are runs of bytes other than white space of ASCII, unchanged. Null and empty texts have
    no words and keep an empty text; texts of under ``width`` words lose none. Rows that share a doc_id count as one
    document: equal rows don't remove each other, and a start that one of them loses the others lose too. Rows with a null
    doc_id come after all others, by a hash of their texts, so equal ones count as one document as well. Two different windows are taken for equal only if 96 bits
    of their hashes agree.
    """
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or width < period:
        raise ValueError("cover must be a difference cover of period, and width at least period")
    spark, core = documents.sparkSession, width - period + 1
    bytes_ = documents.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = prime_from(max(2 * partitions(spark), bytes_ // GROUP_BYTES))  # a chunk gives a row a bucket: few, larger rows, but no group over the bytes
    last = np.iinfo(np.int64).max - NULL_IDS
    null_id = F.pmod(F.xxhash64("text"), F.lit(NULL_IDS)) + F.lit(last)
    texts = documents.select(F.coalesce("doc_id", null_id).alias("doc_id"), "text")
    texts = texts.withColumn("grp", F.pmod("doc_id", F.lit(n).cast("long")))
    at = np.zeros(period, bool)
    at[list(cover)] = True

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            flat, starts = words_of(piece.column("text"))
            if len(flat) < width:
                continue
            h = rolled(hashes_of(flat), core)
            text, place = within(starts)
            size = np.diff(starts)[text]
            take = np.flatnonzero(at[place % period] & (place + core <= size) & (size >= width))
            keys, docs, places = h[take], piece.column("doc_id").to_numpy()[text[take]], place[take]
            checks = np.zeros(len(keys), "<u4")
            order, known = _merged(keys, checks, docs, places)
            yield _rows(_bucket(keys[order], docs[order], known, n), n, keys[order], checks, docs[order], places[order], known)

    def repeated(table: pa.Table) -> pa.Table:
        keys, known = unpacked(table.column("keys"), "<u8"), unpacked(table.column("known"), "u1")
        docs, places = _stretched(table.column("docs"), "<i8"), _stretched(table.column("places"), "<i4")
        hit = known > 0
        own = np.flatnonzero(known < 2)
        order = own[np.argsort(keys[own], kind="stable")]
        same = keys[order[1:]] == keys[order[:-1]]
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        return _places(docs[hit], places[hit], n)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({k: pa.array([], t) for k, t in (("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "checks", "docs", "places", "known")))})
        if not left.num_rows or not right.num_rows:
            return empty
        docs, places = _stretched(right.column("docs"), "<i8"), _stretched(right.column("places"), "<i4")
        order = np.argsort(docs, kind="stable")
        docs, places = docs[order], places[order]
        found = []
        for piece in pieces(iter(left.combine_chunks().to_batches()), "text"):
            flat, starts = words_of(piece.column("text"))
            h = hashes_of(flat)
            whole = rolled(h, width)
            if not len(whole):
                continue
            mark = np.zeros(len(h) + 1, np.int32)
            ids = piece.column("doc_id").to_numpy()
            lo, hi = np.searchsorted(docs, ids), np.searchsorted(docs, ids, side="right")
            for i in np.flatnonzero(hi > lo):
                first, end = starts[i], starts[i + 1] - width  # the last window of the text begins at end
                if end < first:
                    continue
                a = places[lo[i] : hi[i]].astype(np.int64) + first
                np.add.at(mark, np.clip(a - period + 1, first, end + 1), 1)
                np.add.at(mark, np.clip(a + 1, first, end + 1), -1)
            take = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            text, place = within(starts)
            check = rolled(h, width, 0xC2B2AE3D27D4EB4F)[take]
            found.append((whole[take], (check >> np.uint64(32)).astype("<u4"), ids[text[take]], place[take]))
        if not found or not sum(len(f[0]) for f in found):
            return empty
        keys, checks, ids, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order, known = _merged(keys, checks, ids, place)
        keys, checks, ids, place = keys[order], checks[order], ids[order], place[order]
        twin = np.zeros(len(ids), bool)  # a place of rows that share a doc_id is no earlier one
        twin[1:] = (ids[1:] == ids[:-1]) & (place[1:] == place[:-1]) & (known[1:] == 2)
        keys, checks, ids, place, known = (x[~twin] for x in (keys, checks, ids, place, known))
        return pa.Table.from_batches([_rows(_bucket(keys, ids, known, n), n, keys, checks, ids, place, known)])

    def later(table: pa.Table) -> pa.Table:
        keys, checks, known = (unpacked(table.column(c), k) for c, k in (("keys", "<u8"), ("checks", "<u4"), ("known", "u1")))
        docs, places = _stretched(table.column("docs"), "<i8"), _stretched(table.column("places"), "<i4")
        hit = known == 2
        own = np.flatnonzero(known < 2)
        order = own[np.lexsort((places[own], docs[own], checks[own], keys[own]))]
        hit[order[1:][(keys[order[1:]] == keys[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])]] = True
        return _places(docs[hit], places[hit], n)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": []}
        docs, places = _stretched(right.column("docs"), "<i8"), _stretched(right.column("places"), "<i4")
        order = np.argsort(docs, kind="stable")
        docs, places = docs[order], places[order]
        for piece in pieces(iter(left.combine_chunks().to_batches()), "text") if left.num_rows else ():
            ids = piece.column("doc_id").to_numpy()
            lo, hi = np.searchsorted(docs, ids), np.searchsorted(docs, ids, side="right")
            for i, raw in enumerate(piece.column("text").to_pylist()):
                w = (raw or "").encode().split()
                gone = 0
                if hi[i] > lo[i]:
                    s = places[lo[i] : hi[i]]
                    mark = np.zeros(len(w) + 1, np.int32)
                    s = s[s + width <= len(w)]
                    np.add.at(mark, s, 1)
                    np.add.at(mark, s + width, -1)
                    dead = np.cumsum(mark)[:-1] > 0
                    gone = int(dead.sum())
                    kept = b" ".join(x for x, d in zip(w, dead.tolist(), strict=True) if not d)
                else:
                    kept = b" ".join(w)
                out["doc_id"].append(None if ids[i] >= last else int(ids[i]))
                out["n_words"].append(len(w))
                out["n_removed"].append(gone)
                out["kept_text"].append(kept.decode())
        return pa.table({k: pa.array(v, pa.string() if k == "kept_text" else pa.int64()) for k, v in out.items()})

    found = texts.drop("grp").mapInArrow(anchors, _PACK).groupBy("bucket").applyInArrow(repeated, _PLACES)
    whole = texts.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(windows, _PACK)
    starts = whole.groupBy("bucket").applyInArrow(later, _PLACES)
    return texts.groupBy("grp").cogroup(starts.groupBy("grp")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
