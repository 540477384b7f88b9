"""Benchmark decontamination: a Wu-Manber search for every window of the benchmark in every document.

The symbols are words, as numbers from a dictionary of the benchmark's. A block of two words ends each window; a table of
shifts by the block's hash says how far the search may move on past it, a zero shift leads to the bucket of the test strings
whose suffix has that hash and which begin with the word at hand, and a direct comparison of all words confirms an occurrence. Tables are numpy arrays over the
benchmark's words in a row: test strings are places in it. A worker builds them once for each broadcast.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from porelake.llm.common import KEPT, owned, small_batches, staged

#: Consecutive words of a window.
WINDOW = 10
#: Bytes of benchmark text whose tables one worker holds, about twelve times as large; a larger benchmark is searched in as
#: many passes as it needs.
TABLE_BYTES = 16 << 20

#: Other bytes than digits, letters and those of non-ASCII characters end a word; A-Z are lower-cased.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a whole text; none if it is null."""
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []


#: Odd, so that the numbers of a word times it are spread over the table.
_MIX = 0x9E3779B1


class WuManber:
    """Windows of one length, which start at `starts` of `stream` (numbers of words from 1 on); items has each one's number."""

    def __init__(self, length: int, stream: np.ndarray, starts: np.ndarray, items: np.ndarray) -> None:
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.bits = max(8, (16 * len(starts)).bit_length())
        self.shift = np.full(1 << self.bits, min(self.far, 255), np.uint8)
        for end in range(self.block, length + 1):  # nearer ends come later and are smaller
            self.shift[self.hashes(stream[starts + end - self.block], stream[starts + end - 1])] = min(length - end, 255)
        suffix = self.hashes(stream[starts + length - self.block], stream[starts + length - 1])
        bucket = suffix << 32 | stream[starts].astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.starts, self.items, self.stream = bucket[order], starts[order], items[order], stream

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each block in the table; a block of one word is that word twice."""
        return (a.astype(np.int64) * _MIX ^ b) & ((1 << self.bits) - 1)

    def search(self, text: list[bytes], numbers: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
        """The start of each occurrence and the numbers of its window's items; words that are skipped aren't looked up."""
        m, n, back, far, number = self.length, len(text), self.block - 1, self.far, numbers.get
        mask, shift, bucket = (1 << self.bits) - 1, memoryview(self.shift), memoryview(self.bucket)
        end = m - 1
        while end < n:
            b = number(text[end])
            if b is None:  # no block with such a word: the next has it not
                end += m
                continue
            if (a := number(text[end - back])) is None:
                end += far
                continue
            code = (a * _MIX ^ b) & mask
            if step := shift[code]:
                end += step
                continue
            at = end + 1 - m
            key = code << 32 | number(text[at], 0)
            low = bisect_left(bucket, key)
            if low < len(bucket) and bucket[low] == key:
                high = bisect_right(bucket, key, low)
                own = [number(w, 0) for w in text[at : end + 1]]
                same = (self.stream[self.starts[low:high, None] + np.arange(m)] == own).all(axis=1)
                if same.any():
                    yield at, self.items[low:high][same]
            end += 1


class Matcher:
    """The tables of some items: a dictionary of their words and a WuManber for each length of window that occurs."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.ids = [item_id for item_id, _ in items]
        self.numbers: dict[bytes, int] = {}
        parts = [np.fromiter((self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)), np.int32) for _, text in items]
        stream = np.concatenate([np.zeros(0, np.int32), *parts])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begins, least = np.cumsum(sizes) - sizes, np.minimum(window, sizes)
        self.searches = []
        for length in np.unique(least[least > 0]).tolist():
            own = np.flatnonzero(least == length)
            counts = sizes[own] - length + 1
            number = np.repeat(own, counts)
            starts = np.repeat(begins[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            self.searches.append(WuManber(length, stream, starts, number))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, hit spans [start, end) merged and in order, ids of the items found, sorted; null ids are not listed."""
        seq = words(text)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for search in self.searches:
            for at, items in search.search(seq, self.numbers):
                spans.append((at, at + search.length))
                found.update(items.tolist())
        return len(seq), merge(spans), sorted({self.ids[i] for i in found} - {None})


#: A worker's tables by the name of their broadcast; the last one only, as passes follow each other.
_BUILT: dict[str, Matcher] = KEPT.setdefault("decontaminate", {})


def _matcher(name: str, shared, window: int) -> Matcher:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(shared.value, window)
    return _BUILT[name]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "doc_id long, text_hash long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int) -> DataFrame:
    """One search of all documents for the windows of some items."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matcher = _matcher(name, shared, window)
            found = [matcher.scan(t.as_py()) for t in batch.column(2)]
            spans = [[{"start": a, "end": b} for a, b in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array(spans, _SPAN), pa.array([x[2] for x in found], pa.list_(pa.string()))],
                ["doc_id", "text_hash", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(owned("decontaminate", rows), _FOUND)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): for each row of docs the word spans that benchmark windows cover, and their items.

    The benchmark is broadcast only up to table_bytes of text at once, measured first; a larger one is dealt into blocks
    by item, each searched in a pass of its own, and the passes' spans are merged by document. Null texts have no words and
    items without words no windows; a null item_id hits words but isn't listed; items that share an item_id count once.
    Repeated documents each give a row; empty tables give no rows or no hits. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first().b
    passes = max(1, -(-size // table_bytes))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0).cast("long") if passes == 1 else F.xxhash64("text")).alias("text_hash"), "text")
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes).cast("long"))
    found: DataFrame | None = None
    for k in range(passes):
        own = [(r.item_id, r.text) for r in items.where(block == k).toLocalIterator()]
        one = _pass(keyed, sorted(own, key=lambda x: (x[0] is None, x)), window)
        if passes > 1:
            one = staged(one)
        found = one if found is None else found.unionByName(one)
    if passes == 1:
        return found.drop("text_hash")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            spans = [[{"start": a, "end": b} for a, b in merge([(s["start"], s["end"]) for s in x])] for x in cols["spans"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPAN), pa.array([sorted(set(x)) for x in cols["items"]], pa.list_(pa.string())), batch.column(4)], ["doc_id", "n_words", "spans", "items", "copies"])

    # rows with equal id and text are alike: their spans are kept once, their number comes back at the end
    hits = found.where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash", "n_words", "spans", "items"])
    hits = hits.groupBy("doc_id", "text_hash", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    copies = found.groupBy("doc_id", "text_hash", "n_words").agg((F.count(F.lit(1)) / passes).cast("int").alias("copies"))
    same = copies.doc_id.eqNullSafe(hits.doc_id) & (copies.text_hash == hits.text_hash) & (copies.n_words == hits.n_words)
    both = copies.join(hits, same, "left").select(copies.doc_id, copies.n_words, F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "copies")
    out = both.mapInArrow(merged, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, copies int")
    return out.select("doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def report(found: DataFrame) -> DataFrame:
    """The digest of find_contamination(): counts, the hash of the sorted item ids, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with one more column, `_porelake_contaminated`: whether any window of the benchmark occurs in the whole text.

    In a single pass if the benchmark's tables fit one worker. Null and empty texts are clean, as is all if the benchmark is
    empty; repeated rows are flagged alike; ids are not looked at; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first().b
    passes = max(1, -(-size // TABLE_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes).cast("long"))
    out = docs.withColumn("_porelake_contaminated", F.lit(False))
    for k in range(passes):
        shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.where(block == k).toLocalIterator()])
        out = _flag(out, shared, window)
        if passes > 1:
            out = staged(out)
    return out


def _flag(docs: DataFrame, shared, window: int) -> DataFrame:
    names, name = docs.columns, uuid.uuid4().hex
    text, flag = names.index("text"), names.index("_porelake_contaminated")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matcher = _matcher(name, shared, window)
            hit = [old or bool(matcher.scan(t.as_py())[1]) for t, old in zip(batch.column(text), batch.column(flag).to_pylist())]
            yield batch.set_column(flag, batch.schema.field(flag), pa.array(hit, pa.bool_()))

    return docs.mapInArrow(owned("decontaminate", rows), docs.schema)


#: DuckDB: windows as strings, found by equality with the documents' runs of as many words.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT doc_id,
    regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00]', ' ', 'g'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
b AS (SELECT row_number() OVER () AS r, item_id, w FROM (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark)),
p AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM
    (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM p),
t AS (SELECT r, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM
    (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN s WHERE len(w) >= size)),
hit AS (SELECT t.r, t.i, t.size, p.item_id FROM t JOIN p ON t.size = p.size AND t.win = p.win),
n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN i ON d.r = i.r
"""
