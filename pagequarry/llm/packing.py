"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

The cost of a piece of l tokens is estimated as l + l * l / (6 * width): one share for what a model of
that width does with each token, one for attention within the piece.  Of a long document pieces of the
full length become sequences of their own.  All other pieces of a group of documents are taken by falling
length, so by falling cost, and each goes to the lowest-cost sequence that has room for it (of equal
ones the first).  There are just as many sequences as the group's tokens fill, so that costs are
levelled from the start.  What finds no room whole is cut: parts fill up the lowest-cost sequences.  Hence every
sequence is full.  The tokens over go on to the next group; after a task's last group they are laid into
sequences whose lengths are powers of two, which need no padding either.

Every task packs what it reads, in groups of bounded size: nothing is shuffled.  Sequence ids hold the
partition's number in the bits above 33, as Spark's own monotonic ids do; they are the same each time the
rows of a partition come in the same order, as they do from a table.

Defined cases: null counts as empty; the empty text has the end id alone; a null doc_id stays null; rows
that repeat a doc_id are packed each; equal lengths are taken in the order of the rows; an empty table
gives an empty result; further columns are ignored, whatever their names.  A very long text is held whole
in its task, as text and as ids.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .repetition import groups
from .word_bpe import word_bpe

#: Tokens that are packed together, and bytes of a row batch of the result.
GROUP_TOKENS, OUT_BYTES = 4 << 20, 8 << 20
#: Bytes of text whose words are encoded together.
TEXT_BYTES = 8 << 20


def cost(length: int, width: int = 1024) -> float:
    return length + length * length / (6 * width)


def balance(lengths: list[int], room: int, width: int = 1024) -> tuple[list[tuple[int, int, int, int]], int, list[tuple[int, int, int]]]:
    """Rows (piece, start, length, sequence) that fill whole sequences of ``room``, how many these are, and the parts left (piece, start, length).

    No piece is longer than ``room``; the rows of a sequence are in the order in which they lie in it.
    """
    n = sum(lengths) // room
    free = [room] * n
    by_cost = [(0.0, s) for s in range(n)]  # in heap order
    full: list[tuple[int, float, int]] = []  # sequences that had no room at their turn, the freest first
    rows, over = [], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = lengths[k]
        while full and -full[0][0] >= need:
            _, c, s = heapq.heappop(full)
            heapq.heappush(by_cost, (c, s))
        while by_cost and free[by_cost[0][1]] < need:
            c, s = heapq.heappop(by_cost)
            if free[s]:
                heapq.heappush(full, (-free[s], c, s))
        if not by_cost:
            over.append(k)
            continue
        c, s = by_cost[0]
        rows.append((k, 0, need, s))
        free[s] -= need
        heapq.heapreplace(by_cost, (c + cost(need, width), s))
    left = [(c, s) for c, s in by_cost if free[s]] + [(c, s) for _, c, s in full]
    heapq.heapify(left)
    parts = []
    for k in over:
        start, need = 0, lengths[k]
        while need and left:
            c, s = left[0]
            take = min(need, free[s])
            rows.append((k, start, take, s))
            start, need, free[s] = start + take, need - take, free[s] - take
            if free[s]:
                heapq.heapreplace(left, (c + cost(take, width), s))
            else:
                heapq.heappop(left)
        if need:
            parts.append((k, start, need))
    return rows, n, parts


class _Packer:
    """Packs the documents of one task, group by group."""

    def __init__(self, room: int, width: int, first_sequence: int, group_tokens: int):
        self.room, self.width, self.sequence, self.group_tokens = room, width, first_sequence, group_tokens
        self.pieces: list[tuple] = []  # (doc_id, start, ids, tokens of the document), shorter than a sequence
        self.tokens = 0
        self.out: list[tuple] = []  # the result's rows

    def _emit(self, piece: tuple, start: int, length: int, sequence: int, offset: int) -> None:
        doc_id, before, ids, tokens = piece
        self.out.append((doc_id, before + start, length, tokens, sequence, offset, ids[4 * start : 4 * (start + length)]))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens = len(ids) // 4
        whole = tokens - tokens % self.room
        for start in range(0, whole, self.room):
            self._emit((doc_id, 0, ids, tokens), start, self.room, self.sequence, 0)
            self.sequence += 1
        if whole < tokens:
            self.pieces.append((doc_id, whole, ids[4 * whole :], tokens))
            self.tokens += tokens - whole
        if self.tokens >= self.group_tokens:
            self.pack()

    def pack(self) -> None:
        """Fill as many sequences as the held pieces can; the rest stays held."""
        rows, n, parts = balance([len(p[2]) // 4 for p in self.pieces], self.room, self.width)
        used = [0] * n
        for k, start, length, s in rows:
            self._emit(self.pieces[k], start, length, self.sequence + s, used[s])
            used[s] += length
        self.sequence += n
        self.pieces = [(p[0], p[1] + start, p[2][4 * start : 4 * (start + length)], p[3]) for k, start, length in parts for p in [self.pieces[k]]]
        self.tokens = sum(len(p[2]) // 4 for p in self.pieces)

    def finish(self) -> None:
        """Pack what is held; the tokens over go into sequences of falling powers of two."""
        self.pack()
        sizes = [1 << b for b in range(self.tokens.bit_length() - 1, -1, -1) if self.tokens >> b & 1]
        at = 0  # in the sequence sizes[0]
        for piece in self.pieces:
            start, need = 0, len(piece[2]) // 4
            while need:
                take = min(need, sizes[0] - at)
                self._emit(piece, start, take, self.sequence, at)
                start, need, at = start + take, need - take, at + take
                if at == sizes[0]:
                    self.sequence, at = self.sequence + 1, 0
                    sizes.pop(0)
        self.pieces, self.tokens = [], 0

    def batches(self):
        """The rows so far, in row batches of bounded size."""
        rows, self.out = self.out, []
        at = 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and size < OUT_BYTES:
                size += len(rows[end][6]) + 48
                end += 1
            columns = list(zip(*rows[at:end]))
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            at = end


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 1, length: int = 2048, width: int = 1024, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit integers).

    A document is its tokenizer's ids and ``end_id``; ``length``, a power of two, is that of a full sequence;
    about ``group_tokens`` are held and packed together.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    end = struct.pack("<I", end_id)

    def run(batches):
        packer = _Packer(length, width, TaskContext.get().partitionId() << 33, group_tokens)
        bpe = word_bpe(tokenizer_file)
        for batch in batches:
            for part in groups(batch, 1, TEXT_BYTES):
                for doc_id, ids in zip(part.column(0).to_pylist(), bpe.encode(part.column(1))):
                    packer.add(doc_id, ids + end)
                yield from packer.batches()
        packer.finish()
        yield from packer.batches()

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def padding(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """One row: sequences, tokens, and the padding of sequences that are neither full nor a power of two long."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    exact = F.bit_count(F.col("filled")) == 1
    pad = F.when(exact, F.lit(0)).otherwise(F.lit(length) - F.col("filled"))
    return each.agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("filled"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(pad), F.lit(0)).alias("padding"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces): the ids of each sequence, joined; a sequence is short, so is its group."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    hexed = F.array_join(F.transform(held, lambda x: F.hex(x["ids"])), "")
    return pieces.groupBy("sequence_id").agg(F.unhex(hexed).alias("ids"), F.count(F.lit(1)).alias("n_pieces"))
