"""Bulk-synchronous best-fit packing of token sequences.

Pieces are put in size order by a distributed counting sort: each task numbers its pieces of a size, the tasks' counts give
each piece its rank among all of its size. Documents of one size, and gaps of one size, are then runs of the range-sorted
order, at most a few for each size up to the capacity, however many documents there are. A superstep is one job:

* the runs of documents left and of gaps are dealt out by ranges of size, and each range is swept: in order of size, the
  largest first, documents take their successors, the smallest gaps that hold them. Of documents that want the same gap the
  one of the higher rank gets it, and what a gap has left is a gap again;
* what the ranges leave over, documents without a gap in their range and gaps without a document, meets in one more sweep;
* for documents that no gap holds, sequences are opened: as many as those of more than half of the largest size left need at
  least. The smaller ones wait, as they may fit what those leave.

Supersteps are repeated until no document is left: about as often as the largest size can be halved. What they decide is a
table of rules over ranks, which every piece then looks up. There are as many sequences as sequential best-fit decreasing
has, in all cases that were tried.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from porelake.llm.common import gathered, owned, small_batches, staged
from porelake.llm.tokens import BATCH_CHARS, encoder

CAPACITY, END_ID = 2048, 0
#: Ranges of size that are swept side by side.
RANGES = 4

_PIECE = "doc_id long, piece int, start long, length long, ids binary, part int, place long"


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, place): documents as pieces of at most `capacity` ids, written once.

    ids are little-endian unsigned 32-bit, end_id last in each document; a null text has that only. part and place number
    the pieces of a size: place within the task, part the task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in gathered(batches, BATCH_CHARS):
            flat, edges = tokens.encode_batch(batch.column(1), end_id)
            ids_of, doc, piece, start, length, ids, place = batch.column(0).to_pylist(), [], [], [], [], [], []

            def out() -> pa.RecordBatch:
                n = len(doc)
                got = pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * n, pa.int32()), pa.array(place, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids", "part", "place"],
                )
                for column in (doc, piece, start, length, ids, place):
                    column.clear()
                return got

            for doc_id, a, b in zip(ids_of, edges[:-1].tolist(), edges[1:].tolist()):
                stream = flat[a:b].tobytes()
                for k, at in enumerate(range(0, len(stream), 4 * capacity)):
                    own = stream[at : at + 4 * capacity]
                    n = len(own) // 4
                    doc.append(doc_id), piece.append(k), start.append(at // 4), length.append(n), ids.append(own), place.append(int(seen[n]))
                    seen[n] += 1
                if len(doc) >= 1024:
                    yield out()
            yield out()

    small_batches(docs.sparkSession)
    return staged(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(owned("tokens", rows), _PIECE), by_task=True)


class Gaps:
    """Runs of sequences (first, number) by the room they have left."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.runs:
                self.runs[room] = []
                bisect.insort(self.rooms, room)
            self.runs[room].append((first, n))

    def successor(self, length: int) -> tuple[int, int, int] | None:
        """Takes a run of the smallest room that holds length."""
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, n = self.runs[room].pop(0)
        if not self.runs[room]:
            del self.runs[room], self.rooms[at]
        return room, first, n


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int) -> tuple[list[tuple], list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Matches runs of documents (length, low, high: ranks) with runs of gaps (room, low, high: sequences).

    Returns rules (length, low, high, sequence, per, offset), documents and gaps left. By a rule the documents of that length
    with ranks low..high-1 go, `per` after each other, to sequences from `sequence` on, from place `offset` on.
    """
    free, rules, left = Gaps(), [], []
    for room, low, high in sorted(gaps):
        free.add(room, low, high - low)
    for length, low, high in sorted(docs, key=lambda x: (-x[0], x[1])):
        while low < high:
            if (found := free.successor(length)) is None:
                left.append((length, low, high))
                break
            room, first, n = found
            per = room // length
            taken = min(high - low, n * per)
            rules.append((length, low, low + taken, first, per, capacity - room))
            full, rest = divmod(taken, per)
            free.add(room - per * length, first, full)
            free.add(room - rest * length, first + full, int(rest > 0))
            free.add(room, first + full + int(rest > 0), n - full - int(rest > 0))
            low += taken
    return rules, left, [(room, first, first + n) for room in free.rooms for first, n in free.runs[room]]


def opened(left: list[tuple[int, int, int]], capacity: int) -> int:
    """How many sequences the documents of more than half of the largest size left need at least."""
    most = max(x[0] for x in left)
    band = [x for x in left if 2 * x[0] > most]
    return sum(high - low for n, low, high in band if 2 * n > capacity) + -(-sum(n * (high - low) for n, low, high in band if 2 * n <= capacity) // capacity)


_RUNS = "kind string, size long, low long, high long, sequence long, per long, base_offset long"


def _swept(capacity: int, ranges: int, first_new: int | None = None):
    """Runs -> their rules, and the documents and gaps left, range by range; with first_new sequences are opened from there on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[list[tuple]]] = {"doc": [[] for _ in range(ranges)], "gap": [[] for _ in range(ranges)]}
        rules: list[tuple] = []
        left, gaps = [], []
        for batch in batches:
            for kind, *run in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if kind == "rule":
                    rules.append(tuple(run))
                else:
                    held[kind][(run[0] - 1) * ranges // capacity].append(tuple(run[:3]))
        for docs, free in zip(held["doc"], held["gap"]):
            found = sweep(docs, free, capacity)
            rules += found[0]
            left += found[1]
            gaps += found[2]
        if left and first_new is not None:
            gaps.append((capacity, first_new, first_new + opened(left, capacity)))
        out = [("rule", *x) for x in rules] + [(kind, *x, None, None, None) for kind, found in (("doc", left), ("gap", gaps)) for x in found]
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, x)) for x in out], _ARROW)

    return rows


_NAMES = [c.split()[0] for c in _RUNS.split(", ")]
_ARROW = pa.schema([pa.field(n, pa.string() if n == "kind" else pa.int64()) for n in _NAMES])


def best_fit(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sizes (length long, n long; lengths distinct) -> rules (size, low, high, sequence, per, base_offset), as in sweep()."""
    state = staged(sizes.where("n > 0").selectExpr("'doc' as kind", "cast(length as long) as size", "0L as low", "cast(n as long) as high", "cast(null as long) as sequence", "cast(null as long) as per", "cast(null as long) as base_offset"))
    rules, used = state.where("kind = 'rule'"), 0
    of_range = F.expr(f"(size - 1) * {RANGES} div {capacity}")
    while (found := state.agg(F.count(F.when(F.col("kind") == "doc", 1)).alias("docs"), F.max(F.when(F.col("kind") == "gap", F.col("high"))).alias("high")).first()).docs:
        used = max(used, found.high or 0)
        ranged = state.where("kind != 'rule'").repartition(RANGES, of_range).mapInArrow(owned("packing", _swept(capacity, RANGES)), _RUNS)
        state = staged(ranged.repartition(1).mapInArrow(owned("packing", _swept(capacity, 1, used)), _RUNS))  # runs, not documents: their number is bounded
        rules = rules.unionByName(state.where("kind = 'rule'"))
    return rules.drop("kind")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (length, part, place and any others but sequence_id and offset) with sequence_id and offset, without part and place.

    Lengths are from 1 to capacity. Ties are resolved by part and place, that is by the order in which the table was read;
    repeated rows are packed as often. No pieces: no rows.
    """
    counts = staged(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rules = best_fit(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    # base has up to a row for each task and size, so it is never broadcast
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place")).drop("base")
    k = F.col("rank") - F.col("low")
    placed = ranked.join(rules, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    out = placed.withColumn("sequence_id", F.col("sequence") + F.expr("(rank - low) div per")).withColumn("offset", F.col("base_offset") + (k % F.col("per")) * F.col("length"))
    return out.drop("part", "place", "rank", "size", "low", "high", "sequence", "per", "base_offset")


def packed(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all pieces of all docs with their places.

    Null and empty texts are the end id alone; strings of special tokens in a text are ordinary text, as the vocabulary's
    README has it (encode_special_tokens). Null ids stay null, repeated rows are packed as often, ties go by the order of
    reading; very long texts are cut to pieces. An empty table gives no rows; other columns are not looked at.
    """
    pieces = cut(docs, tokenizer_path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
