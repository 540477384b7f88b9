"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming radius by BK-trees over shards.

Two fingerprints within the radius agree wholly in at least `spare` of `radius + spare` bit blocks, so every choice of
`spare` blocks makes a table of shards (equal bits in those blocks) and each link lies within some shard. A shard of more
than `tree_size` fingerprints is dealt into parts, and each pair of parts meets in a group of its own: the tree of the one
part is sent to the members of the other. So no group is unbounded and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from porelake.llm.common import runs, small_batches, staged
from porelake.llm.graph import Forest, components

#: Words of a shingle, differing bits of a link, fingerprints in one tree.
SHINGLE, RADIUS, TREE_SIZE = 4, 4, 4096
#: Fewest blocks that must agree, and fingerprints that a shard would have if all were spread evenly.
SPARE, SHARD = 2, 64
SEED, BITS = 42, 64
_SUM_ROWS = 60_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text. Lower-cases A-Z; null and texts without words give 0."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 of none."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, _SUM_ROWS):
        part = np.unpackbits(hashes[at : at + _SUM_ROWS].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += np.add.reduce(part, axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): a row for each row of docs, the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.view(np.int64))], ["doc_id", "text_hash", "fp"])

    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(rows, "doc_id long, text_hash long, fp long")


class BKTree:
    """Codes by Hamming distance: a node has at most one child for each distance to it."""

    def __init__(self, radius: int) -> None:
        self.radius, self.codes, self.children, self.parent = radius, [], [], []

    def walk(self, code: int) -> Iterator[tuple[int, int]]:
        """The nodes on the way to where code belongs, with its distance to each."""
        at = 0 if self.codes else None
        while at is not None:
            d = (self.codes[at] ^ code).bit_count()
            yield at, d
            at = self.children[at].get(d)

    def add(self, code: int) -> list[int]:
        """Inserts a code; the nodes on its way that are within the radius."""
        near, last = [], None
        for last in self.walk(code):
            if last[1] <= self.radius:
                near.append(last[0])
        if last is not None:
            self.children[last[0]][last[1]] = len(self.codes)
        self.parent.append(last[0] if last else -1)
        self.codes.append(code)
        self.children.append({})
        return near

    def uniform(self, label: list[int], mixed: int | None = -1) -> list[int | None]:
        """For each node the label that all of its subtree has, or `mixed`, which is no label."""
        same = list(label)
        for i in range(len(same) - 1, 0, -1):
            if same[i] != same[p := self.parent[i]]:
                same[p] = mixed
        return same

    def search(self, code: int, skip) -> Iterator[int]:
        """Nodes within the radius of code: follows only edges within the radius of the distance; skip(node) cuts off a subtree."""
        r, codes, children = self.radius, self.codes, self.children
        todo = [0] if codes else []
        while todo:
            at = todo.pop()
            if skip(at):
                continue
            d = (codes[at] ^ code).bit_count()
            if d <= r:
                yield at
            kids = children[at]
            if len(kids) <= 2 * r + 1:
                todo.extend(k for e, k in kids.items() if -r <= e - d <= r)
            else:
                todo.extend(kids[e] for e in range(d - r, d + r + 1) if e in kids)


def tree_links(members: list[int], others: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among members, or of those between members' tree and others (links within members or others that come up are valid too).

    Subtrees whose nodes are all connected with the code at hand already are cut off, so a shard of many near copies
    costs about its size, not the square of it.
    """
    forest, tree, links = Forest(), BKTree(radius), []

    def join(a: int, b: int) -> None:
        if forest.union(a, b):
            links.append((a, b))

    for code in members:
        for near in tree.add(code):
            join(code, tree.codes[near])
    if others is not None:
        for code in others:
            for near, d in tree.walk(code):
                if d <= radius:
                    join(code, tree.codes[near])
    label = [forest.find(c) for c in tree.codes]
    index: dict[int, int] = {}
    same = tree.uniform([index.setdefault(x, len(index)) for x in label])
    roots = list(index)
    for code in members if others is None else others:
        for near in list(tree.search(code, lambda at: same[at] >= 0 and forest.find(roots[same[at]]) == forest.find(code))):
            if tree.codes[near] != code:
                join(code, tree.codes[near])
    return links


def shard_keys(fp: Column, radius: int, spare: int) -> Column:
    """An array with a key for each table of shards: the table's number and the fingerprint's bits in its blocks."""
    blocks = radius + spare
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), spare)):
        key = F.lit(number).cast("long")
        for b in chosen:
            width = cuts[b + 1] - cuts[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, cuts[b]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def spare_for(n: int, radius: int) -> int:
    """The fewest blocks that keep shards of n fingerprints at SHARD or fewer, were they spread evenly: keys grow with n."""
    return next(k for k in range(SPARE, BITS - radius) if n >> (BITS * k // (radius + k)) <= SHARD or k == 6)


def links(codes: DataFrame, radius: int = RADIUS, spare: int | None = None, tree_size: int = TREE_SIZE) -> DataFrame:
    """codes (fp long, distinct, written) -> (a, b): links that connect just the fingerprints that links within the radius connect.

    spare is how many blocks make a key; by default as many as the number of fingerprints asks for. Any gives all links.
    """
    spare = spare or spare_for(codes.count(), radius)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

        for run in runs(batches, ["key", "low", "high"]):
            fp = run["fp"].view(np.uint64)
            if run["low"][0] == run["high"][0]:
                found = tree_links(fp.tolist(), None, radius) if len(fp) > 1 else []
            else:
                found = tree_links(fp[~run["probe"].astype(bool)].tolist(), fp[run["probe"].astype(bool)].tolist(), radius)
            for x, y in found:
                a.append(x)
                b.append(y)
            if len(a) > 50_000:
                yield out()
                a.clear(), b.clear()
        yield out()

    keyed = codes.select("fp", F.explode(shard_keys(F.col("fp"), radius, spare)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tree_size).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), parts.cast("long")).cast("int")
    dealt = (
        keyed.join(sizes, "key")
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("probe"), "fp")
    )
    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(groups, "a long, b long")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, spare: int | None, tree_size: int) -> DataFrame:
    """(doc_id, text_hash, fp, first): first is the (no_id, doc_id, text_hash) of the component's first row, by id, nulls last, then text hash."""
    fps = staged(fingerprints(docs, id_col, text_col, shingle))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = staged(fps.groupBy("fp").agg(F.min(row).alias("first")))
    # written before the components' own Python stage: two of them in one task would keep twice the workers on an executor
    roots = components(staged(links(nodes.select("fp"), radius, spare, tree_size)))
    labelled = nodes.join(roots, nodes.fp == roots.vertex, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = labelled.join(roots.select("root").distinct(), "root", "left_semi")
    smallest = linked.groupBy("root").agg(F.min("first").alias("of_all"))
    named = staged(labelled.join(smallest, "root", "left").select("fp", F.coalesce("of_all", "first").alias("first")))
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, spare: int | None = None, tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs, whatever other columns docs has.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits. A null or wordless text has
    fingerprint zero and is linked like any other. A null doc_id takes part but is never the smallest; a component of null
    ids only has a null component_id. Repeated rows come back as often. An empty table gives no rows.
    """
    out = grouped(docs, id_col, text_col, shingle, radius, spare, tree_size)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def only_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (doc_id, text_hash, first) of docs, staged -> the rows of docs that are their groups' first; of repeated ones, one."""
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gone = rows.where(~same).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hashed = docs.withColumn("_porelake_text_hash", F.xxhash64(F.col("text").cast("string")))
    kept = hashed.join(gone, hashed["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (hashed["_porelake_text_hash"] == gone["_hash"]), "left_anti")
    if rows.where(same).groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "_porelake_text_hash"])
    return kept.drop("_porelake_text_hash")


def first_of_each_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, spare: int | None = None, tree_size: int = TREE_SIZE) -> DataFrame:
    """The rows of docs with all their columns, one for each component: that of the smallest doc_id, nulls last, ties by text.

    Of repeated rows of that one id and text, one stays.
    """
    return only_first(docs, staged(grouped(docs, "doc_id", "text", shingle, radius, spare, tree_size).select("doc_id", "text_hash", "first")))
