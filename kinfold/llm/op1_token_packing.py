"""Operator 1: packed token ids by best-fit decreasing.

Texts are encoded with a public byte-level vocabulary (a file whose path is a parameter) and laid into rows of CONTEXT ids. A text
longer than a row gives whole rows and a remainder, nothing being lost. In each lot the pieces go in order of falling length into
the fullest row that has room, which a segment tree over the free room of open rows finds in logarithmic time.

Plan. One pass over the input without a shuffle: a task packs the texts of its partition in lots of at most LOT ids, so its memory is
bounded, and a lost task is run again to the same rows. The vocabulary (fixed size) is broadcast. Words are cut out for a whole batch
at once and each distinct word of a batch is encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinfold.llm.common import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CONTEXT = 2048
LOT = 2_000_000
PADDING = 50256
REMEMBERED = 150_000

#: Fixed value: how this vocabulary's encoder cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "pack_id long, n_tokens int, doc_ids array<long>, doc_offsets array<int>, cu_seqlens array<int>, ids binary, position_ids binary"

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_kinds: np.ndarray | None = None


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _kind_table() -> np.ndarray:
    """The kind of every code point, made once a process."""
    global _kinds
    if _kinds is None:
        import unicodedata

        kinds = np.full(0x110000, _OTHER, np.uint8)
        first = np.fromiter(("LN".find(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.int8, 0x110000)
        kinds[first == 0], kinds[first == 1] = _LETTER, _NUMBER
        kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _kinds = kinds
    return _kinds


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of PATTERN of all texts (together they are the texts), and where each text's begin."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b""
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    size = len(points)
    begin = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if not size:
        return pa.array([], pa.large_string()), np.zeros(n + 1, np.int64)
    kind = _kind_table()[points]
    edge = np.zeros(size + 1, bool)  # where a text begins, and the end
    edge[begin] = True
    start = edge.copy()
    start[1:size] |= kind[1:] != kind[:-1]
    # The last space of white space before a word belongs to the word; other white space there stands alone.
    after = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~edge[1:size]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # An apostrophe that begins a word and the ending it belongs to.
    quote = np.flatnonzero((points == 39) & start[:size])
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        ends = np.concatenate([edge, [True, True]])
        one = np.isin(padded[quote + 1], [115, 116, 109, 100]) & ~ends[quote + 1]
        pair = padded[quote + 1] * np.uint64(1 << 32) + padded[quote + 2]
        two = np.isin(pair, [(a << 32) + b for a, b in ((114, 101), (118, 101), (108, 108))]) & ~ends[quote + 1] & ~ends[quote + 2]
        for q, k in ((quote[one], 1), (quote[two & ~one], 2)):
            start[q + 1] = False
            start[q + 1 + k] = True
    start = np.flatnonzero(start[:size])
    width = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
    place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    at = np.concatenate([place[start], [len(raw)]])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(raw))
    return words, np.searchsorted(start, begin)


class Encoder:
    """Ids of texts; remembers a bounded number of words."""

    def __init__(self, table: dict[bytes, int]):
        import tiktoken

        self.own = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.seen: dict[str, list[int]] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin."""
        words, begin = cut(texts)
        if not len(words):
            return np.empty(0, "<i4"), begin
        coded = words.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen, encode = self.seen, self.own.encode_ordinary
        for w in distinct:
            if w not in seen:
                seen[w] = encode(w)
        lists = [seen[w] for w in distinct]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for own in lists for i in own), "<i4", int(length.sum()))
        first = np.cumsum(length) - length
        per = length[codes]
        ends = np.cumsum(per)
        ids = flat[np.repeat(first[codes] - (ends - per), per) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[begin]


class Rooms:
    """Open rows by their free room, in a segment tree over the possible rooms 0..most: each node counts the rows below it."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least need, taken out, and its room."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until there are rows to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:  # down to the leftmost
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, most: int) -> list[list[int]]:
    """The numbers of the pieces of each row; every length is at most ``most``. Ties go in order of number."""
    rooms, rows = Rooms(most), []
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need = int(lengths[i])
        found = rooms.take(need)
        if found is None:
            found = len(rows), most
            rows.append([])
        row, room = found
        rows[row].append(i)
        rooms.add(room - need, row)
    return rows


def packed(documents: DataFrame, path: str = VOCABULARY, context: int = CONTEXT, lot: int = LOT, padding: int = PADDING) -> DataFrame:
    """Rows of ``context`` ids: pack_id, n_tokens, doc_ids, doc_offsets, cu_seqlens, ids, position_ids (columns doc_id, text; others are ignored).

    A row holds pieces of texts: the i-th is that of doc_ids[i] from its doc_offsets[i]-th id on and fills ids[cu_seqlens[i] :
    cu_seqlens[i + 1]]; after n_tokens ids comes padding. ids is a little-endian matrix row, of 16 bits while the vocabulary and padding
    allow, else of 32; position_ids (32 bits if context needs it, else 16) begins again at 0 with each piece, and in the padding. Null and empty texts are
    pieces without ids. A null doc_id stays null; repeated rows are packed as often as they occur. An empty table has no rows.
    """
    table = ranks(path)
    kind = "<u2" if max(max(table.values(), default=0), padding) < 1 << 16 else "<u4"
    place = "<u2" if context <= 1 << 16 else "<u4"
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def rows(doc: list, at: np.ndarray, length: np.ndarray, begin: np.ndarray, ids: np.ndarray, first: int) -> pa.RecordBatch:
        """Pieces (document, offset in it, length, place in ids), packed."""
        lots = best_fit_decreasing(length, context)
        matrix = np.full((len(lots), context), padding, kind)
        positions = np.zeros((len(lots), context), place)
        ends, doc_ids, offsets, used = [], [], [], []
        for r, own in enumerate(lots):
            to = 0
            cu = [0]
            for i in own:
                n = int(length[i])
                matrix[r, to : to + n] = ids[begin[i] : begin[i] + n]
                positions[r, to : to + n] = np.arange(n)
                to += n
                cu.append(to)
            positions[r, to:] = np.arange(context - to)
            ends.append(cu)
            doc_ids.append([doc[i] for i in own])
            offsets.append([int(at[i]) for i in own])
            used.append(to)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(first, first + len(lots))), pa.array(used, pa.int32()), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int32())),
                pa.array(ends, pa.list_(pa.int32())), pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array([p.tobytes() for p in positions], pa.binary()),
            ],
            names=["pack_id", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "ids", "position_ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        first = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        have = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, have
            if held:
                doc = [d for h in held for d in h[0]]
                base = np.cumsum([0, *(len(h[4]) for h in held[:-1])])
                at, length = (np.concatenate([h[k] for h in held]) for k in (1, 2))
                begin = np.concatenate([h[3] + b for h, b in zip(held, base, strict=True)])
                ids = np.concatenate([h[4] for h in held])
                held, have = [], 0
                out = rows(doc, at, length, begin, ids, first)
                first += out.num_rows
                for s in range(0, out.num_rows, 512):
                    yield out.slice(s, 512)

        for piece in pieces(batches, "text", 2_000_000):
            ids, begin = encoder.encode(piece.column("text"))
            size = np.diff(begin)
            count = np.maximum(1, -(-size // context))
            owner = np.repeat(np.arange(len(size)), count)
            at = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * context
            doc = piece.column("doc_id").to_pylist()
            held.append(([doc[i] for i in owner], at, np.minimum(context, size[owner] - at), begin[:-1][owner] + at, ids))
            have += len(ids)
            if have >= lot:
                yield from flush()
        yield from flush()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def unpacked_pieces(row, context: int = CONTEXT, kind: str = "<u2") -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, offset, ids) of the pieces of one packed row."""
    ids = np.frombuffer(row.ids, kind)
    assert len(ids) == context
    for i, doc in enumerate(row.doc_ids):
        yield doc, row.doc_offsets[i], ids[row.cu_seqlens[i] : row.cu_seqlens[i + 1]]
