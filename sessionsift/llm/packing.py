"""Packing tokenised documents into sequences of at most ``capacity`` tokens.

A document that is longer than a sequence is cut into full pieces, of which the first may be shorter; every
other document is one piece.  Pieces are packed by linear grouping:

1. pieces longer than ``small`` are grouped by length into groups of equal cardinality, and every length is
   rounded up to the longest of its group;
2. configurations (how many pieces of each of the few rounded sizes a sequence takes) are optimised by
   column generation: a linear programme whose columns come from an unbounded knapsack; the optimum is
   rounded down to whole sequences;
3. the actual pieces take the places of the rounded ones, longest first, which leaves more room;
4. all remaining pieces, long to short, go to the sequence with the least sufficient room (best fit).

All of this works on the histogram of lengths, which has at most ``capacity`` entries however many documents
there are, so the plan is made on the driver: it consists of runs of sequences with equal contents and is
tried for several numbers of groups; the best is kept.  The pieces themselves never leave the executors: each
gets a rank among the pieces of its length (in windows of about ``rows_per_block`` rows) and finds its
sequence and offset by a binary search in the plan.

Defined cases: a null or empty text is one piece, the end id alone; equal rows are pieces of their own;
pieces of the capacity fill a sequence each; an empty table gives an empty result.  Columns other than the
id and the text aren't touched.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionsift.llm.common import staged

CAPACITY = 1024
END_ID = 2
#: Documents that are tokenised at once, and the most bytes of them.
DOCS, BYTES = 512, 4_000_000


def vocabulary() -> tuple[str, str]:
    """Paths of the vocabulary file and of the same vocabulary's ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each row of ``docs`` (doc_id, text)."""
    own = files or vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sessionsift.llm.tokens import cached_tokenizer
        tokenizer = cached_tokenizer(*own)
        for batch in batches:
            size = batch.column(1).nbytes / max(1, len(batch))
            step = int(max(1, min(DOCS, BYTES / max(1, size))))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                rows = [[] for _ in range(6)]
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
                        for col, value in zip(rows, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None)):
                            col.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][:5 + with_ids]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenise, schema)


# --- the plan -----------------------------------------------------------------------------------------

@dataclass
class Run:
    """``count`` sequences, each holding pieces of these lengths."""

    count: int
    lengths: list[int]


def linear_groups(hist: np.ndarray, small: int, groups: int) -> list[list[tuple[int, int]]]:
    """Lengths above ``small``, longest first, in groups of equal cardinality: [(length, count), ...]."""
    total = int(hist[small + 1:].sum())
    out: list[list[tuple[int, int]]] = []
    share, room = -(-total // groups) if total else 0, 0
    for length in range(len(hist) - 1, small, -1):
        n = int(hist[length])
        while n:
            if room == 0:
                out.append([])
                room = share
            take = min(n, room)
            out[-1].append((length, take))
            n -= take
            room -= take
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable numbers of each size that fit."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    lo = int(sizes.min())
    for room in range(lo, capacity + 1):
        fits = sizes <= room
        gain = np.where(fits, best[np.maximum(room - sizes, 0)] + values, -1.0)
        k = int(gain.argmax())
        best[room] = best[room - 1]
        if gain[k] > best[room] + 1e-12:
            best[room], last[room] = gain[k], k
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room >= lo:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Column generation (revised simplex): configurations with their optimal numbers of sequences."""
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        value, counts = best_configuration(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ counts
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * direction
        x[out] = step
        columns[:, out] = counts
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
    return [(columns[:, k].astype(np.int64), float(v)) for k, v in enumerate(np.maximum(x, 0))]


def substitute(groups: list[list[tuple[int, int]]], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Whole sequences of the optimal configurations, filled with actual lengths; the pieces left over."""
    sizes = np.array([g[0][0] for g in groups])
    demand = np.array([float(sum(n for _, n in g)) for g in groups])
    queues = [[list(x) for x in g] for g in groups]
    runs: list[Run] = []
    for counts, number in sorted(configurations(sizes, demand, capacity), key=lambda c: -c[1]):
        m = int(number + 1e-6)
        for k in np.flatnonzero(counts):  # what rounding errors may lack
            m = min(m, sum(n for _, n in queues[k]) // int(counts[k]))
        if m <= 0:
            continue
        slots = []
        for k in np.flatnonzero(counts):
            for _ in range(int(counts[k])):
                slot, need = [], m
                while need:
                    length, n = queues[k][0]
                    take = min(n, need)
                    slot.append((length, take))
                    need -= take
                    queues[k][0][1] -= take
                    if not queues[k][0][1]:
                        queues[k].pop(0)
                slots.append(slot)
        cuts = sorted({c for slot in slots for c in np.cumsum([n for _, n in slot]).tolist()})
        ends = [np.cumsum([n for _, n in slot]).tolist() for slot in slots]
        begin = 0
        for cut in cuts:
            runs.append(Run(cut - begin, [slot[bisect_left(e, cut)][0] for slot, e in zip(slots, ends)]))
            begin = cut
    rest: dict[int, int] = {}
    for q in queues:
        for length, n in q:
            rest[length] = rest.get(length, 0) + n
    return runs, rest


def best_fit(runs: list[Run], rest: dict[int, int], capacity: int) -> list[Run]:
    """Remaining pieces, long to short, into the least sufficient room; new sequences where none has it."""
    by_room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for r in runs:
        by_room[capacity - sum(r.lengths)].append(r)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            room = next((k for k in range(length, capacity + 1) if by_room[k]), None)
            if room is None:
                each = capacity // length
                by_room[capacity].append(Run(max(1, n // each), []))
                continue
            r = by_room[room].pop()
            each = 1
            while each < n and room - (each + 1) * length >= 0 and r.count * (each + 1) <= n and not any(by_room[k] for k in range(length, room - each * length)):
                each += 1  # the room that is left stays the least
            take = min(r.count, n)
            if take < r.count:
                by_room[room].append(Run(r.count - take, r.lengths))
                each = 1
            by_room[room - each * length].append(Run(take, r.lengths + [length] * each))
            n -= take * each
    return [r for rs in by_room for r in rs if r.lengths]


def plan(hist: np.ndarray, capacity: int = CAPACITY, tries: tuple[tuple[int, int], ...] = ((448, 64), (512, 64), (256, 64))) -> list[Run]:
    """Runs that hold exactly hist[k] pieces of each length k <= capacity; the fewest sequences of the tries
    (longest small piece, groups), which end when one is within 0.1 % of the least possible number."""
    full = int(hist[capacity])
    below = hist.copy()
    below[capacity] = 0
    least = -(-int((below * np.arange(capacity + 1)).sum()) // capacity)
    best: list[Run] | None = None
    for small, groups in tries:
        small = small * capacity // 1024
        runs, rest = substitute(grouped, capacity) if (grouped := linear_groups(below, small, groups)) else ([], {})
        for length in np.flatnonzero(below[:small + 1]).tolist():
            rest[length] = rest.get(length, 0) + int(below[length])
        found = best_fit(runs, rest, capacity)
        if best is None or sum(r.count for r in found) < sum(r.count for r in best):
            best = found
        if sum(r.count for r in best) <= least * 1.001:
            break
    return best + ([Run(full, [capacity])] if full else [])


# --- pieces to sequences ------------------------------------------------------------------------------

def _places(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 44 | first rank), and for each the first sequence and the offset."""
    used: dict[int, int] = {}
    keys, sequences, offsets = [], [], []
    at = 0
    for r in runs:
        offset = 0
        for length in r.lengths:
            rank = used.get(length, 0)
            keys.append(length << 44 | rank)
            sequences.append(at - rank)
            offsets.append(offset)
            used[length] = rank + r.count
            offset += length
        at += r.count
    order = np.argsort(np.array(keys, dtype=np.int64))
    return tuple(np.array(x, dtype=np.int64)[order] for x in (keys, sequences, offsets))


def packed(pieces: DataFrame, capacity: int = CAPACITY, rows_per_block: int = 1_000_000) -> DataFrame:
    """``pieces`` (staged) with sequence_id and offset added."""
    blocks = max(1, -(-pieces.count() // rows_per_block))
    marked = pieces.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    counts = staged(marked.groupBy("length", "__block").count(), "packing-counts")
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``capacity`` rows
        hist[row["length"]] = row["n"]
    keys, sequences, offsets = _places(plan(hist, capacity))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = np.asarray(length), np.asarray(rank)
        k = np.searchsorted(keys, length << 44 | rank, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequences[k] + rank), pa.array(offsets[k])], names=["sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "__block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = marked.withColumn("__rank", F.row_number().over(within)).join(before, ["length", "__block"])
    out = ranked.withColumn("__place", place("length", F.col("__before") + F.col("__rank") - 1))
    return out.select(*pieces.columns, "__place.sequence_id", "__place.offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Each piece of ``docs`` with its sequence and its place there."""
    return packed(staged(pieces_of(docs, capacity, end_id, files, with_ids), "packing-pieces"), capacity)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces that carry ids; a group holds at most one sequence's tokens."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda p: p["ids"])).alias("ids"))
