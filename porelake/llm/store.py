"""A content-addressed store of token ids: chunks cut by a rolling hash, each stored once; recipes and Merkle roots verify.

Layout below the store's folder: packs/ holds files of compressed chunks, one after another behind a magic word; index/ says
for each chunk's digest its pack, offset and length; recipes/ has, in ascending order of doc_id, each document's chunks and
the Merkle root over their digests. A chunk's digest is the address of its content: little-endian unsigned 32-bit ids.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from porelake.llm.common import gathered, remove, shared_dir, small_batches, staged
from porelake.llm.tokens import encoder

END_ID = 2
MAGIC = b"PLCHUNK1"
DIGEST = 16
#: Ids that the rolling hash sees; a cut falls where its top CUT_BITS bits are zero, between LEAST and MOST ids apart.
REACH, CUT_BITS, LEAST, MOST = 16, 9, 128, 4096
#: Words that a writing worker remembers, and bytes of text that it encodes at once.
CACHE_WORDS, BATCH_CHARS = 500_000, 12 << 20
#: Ids that are hashed at once.
BLOCK = 1 << 15
#: A reading worker reads ranges of so many bytes and remembers so many of them, and so many open packs.
RANGE, KEPT_RANGES, KEPT_FILES = 1 << 18, 64, 32


@dataclass
class Store:
    path: str


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit number for each id."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_ends(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash over the last REACH ids has its top bits zero; worked out a block at a time."""
    out = []
    for at in range(0, len(ids), BLOCK):
        start = max(0, at - REACH)
        mixed = _mixed(ids[start : at + BLOCK])
        rolled = mixed.copy()
        for j in range(1, min(REACH, len(mixed))):
            rolled[j:] += mixed[:-j] << np.uint64(4 * j % 61)
        found = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + 1 + start
        out.append(found[found > at])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cuts(n: int, ends: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids whose rolling hash offers `ends`, ascending. Equal passages share chunks.

    A stream's first REACH ids may be hashed with what comes before it: no chunk is that short.
    """
    out, last = [], 0
    for end in [*ends, n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST and end < n:
            out.append(end)
            last = end
    if last < n:
        out.append(n)
    return out


def digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Over the digests in order, pair by pair; a single one is hashed too, none gives the digest of nothing."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _encoded_chunk(content: bytes) -> bytes:
    """Width (2 or 4 bytes an id) and the compressed ids."""
    ids = np.frombuffer(content, "<u4")
    small = not len(ids) or ids.max() < 1 << 16
    return (b"\2" if small else b"\4") + _COMPRESS.compress(ids.astype("<u2").tobytes() if small else content)


def _decoded_chunk(stored: bytes) -> bytes:
    raw = _DECOMPRESS.decompress(stored[1:])
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if stored[:1] == b"\2" else raw


class PackReader:
    """Range reads from packs; what was read lately is kept, as neighbouring chunks tend to be asked for next."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.files: OrderedDict[str, tuple[pa.NativeFile, int]] = OrderedDict()
        self.ranges: OrderedDict[tuple[str, int], bytes] = OrderedDict()

    def _range(self, pack: str, number: int) -> bytes:
        key = (pack, number)
        if (got := self.ranges.get(key)) is None:
            if pack not in self.files:
                if len(self.files) >= KEPT_FILES:
                    self.files.popitem(last=False)[1][0].close()
                fs, path = _filesystem(f"{self.folder}/{pack}")
                file = fs.open_input_file(path)
                self.files[pack] = file, file.size()
            file, size = self.files[pack]
            got = file.read_at(min(RANGE, size - number * RANGE), number * RANGE)
            if len(self.ranges) >= KEPT_RANGES:
                self.ranges.popitem(last=False)
            self.ranges[key] = got
        return got

    def read(self, pack: str, offset: int, length: int) -> bytes:
        number, at = divmod(offset, RANGE)
        got = self._range(pack, number)[at : at + length]
        while len(got) < length:
            number += 1
            got += self._range(pack, number)[: length - len(got)]
        return got


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class PackWriter:
    """A task's pack file; its name is new on every attempt, so a repeated task never meets an earlier one's file."""

    def __init__(self, folder: str) -> None:
        self.name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.pack"
        fs, path = _filesystem(f"{folder}/{self.name}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.at = fs.open_output_stream(path, compression=None), len(MAGIC)
        self.file.write(MAGIC)

    def add(self, stored: bytes) -> int:
        self.file.write(stored)
        self.at += len(stored)
        return self.at - len(stored)

    def close(self) -> None:
        self.file.close()


_ENCODED = "doc_id long, part int, place long, n_tokens long, root binary, digests array<binary>, own array<struct<digest:binary,offset:long,length:int>>, pack string"


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> Store:
    """Encodes every whole text, ends it with end_id and stores all in a new folder of the shared directory.

    1. Each task chunks its documents and writes a pack of the chunks that are new to it. 2. For each digest the first pack
    is elected, over digests and addresses only. 3. Packs are rewritten with elected chunks only, so each is stored once.
    4. Recipes are resolved to addresses and written in ascending doc_id order. A null text has end_id only; null ids come
    first; rows that share an id keep the order in which they were read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = shared_dir(spark)
    loose = f"{path}/loose"

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path, CACHE_WORDS, BATCH_CHARS)
        part, place, writer, seen = TaskContext.get().partitionId(), 0, PackWriter(loose), set()
        for batch in gathered(batches, BATCH_CHARS):
            n_tokens, roots, recipes, news, offsets, lengths, own_ends = [], [], [], [], [], [], [0]
            flat, edges = tokens.encode_batch(batch.column(1), end_id)
            offered = rolling_ends(flat)
            spans = np.searchsorted(offered, edges, "right").tolist()
            edges = edges.tolist()
            for k, (first, stop) in enumerate(zip(edges, edges[1:])):
                stream = flat[first:stop].tobytes()
                ends = cuts(stop - first, (offered[spans[k] : spans[k + 1]] - first).tolist())
                recipe = []
                for a, b in zip([0, *ends], ends):
                    content = stream[4 * a : 4 * b]
                    name = digest(content)
                    recipe.append(name)
                    if name not in seen:
                        seen.add(name)
                        stored = _encoded_chunk(content)
                        news.append(name), offsets.append(writer.add(stored)), lengths.append(len(stored))
                n_tokens.append(len(stream) // 4), roots.append(merkle_root(recipe)), recipes.append(recipe), own_ends.append(len(news))
            n = batch.num_rows
            new = pa.StructArray.from_arrays([pa.array(news, pa.binary()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int32())], ["digest", "offset", "length"])
            own = pa.ListArray.from_arrays(pa.array(own_ends, pa.int32()), new)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(roots, pa.binary()), pa.array(recipes, pa.list_(pa.binary())), own, pa.array([writer.name] * n)],
                ["doc_id", "part", "place", "n_tokens", "root", "digests", "own", "pack"],
            )
            place += n
        writer.close()

    def compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, source = None, None, None
        for batch in batches:
            offsets = []
            for pack, offset, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if writer is None:
                    writer = PackWriter(f"{path}/packs")
                if pack != name:
                    fs, file = _filesystem(f"{loose}/{pack}")
                    name, source = pack, fs.open_input_file(file)
                offsets.append(writer.add(source.read_at(length, offset)))
            if offsets:
                yield pa.RecordBatch.from_arrays([batch.column(3), pa.array([writer.name] * len(offsets)), pa.array(offsets, pa.int64()), batch.column(2)], ["digest", "pack", "offset", "length"])
        if writer is not None:
            writer.close()

    encoded = staged(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(chunked, _ENCODED), by_task=True)
    elected = encoded.select("pack", F.explode("own").alias("c")).groupBy("c.digest").agg(F.min(F.struct("pack", "c.offset", "c.length")).alias("at"))
    owned = elected.select("at.pack", "at.offset", "at.length", "digest").repartition("pack").sortWithinPartitions("pack", "offset")
    owned.mapInArrow(compacted, "digest binary, pack string, offset long, length int").write.parquet(f"{path}/index")
    remove(spark, loose)
    index = spark.read.parquet(f"{path}/index")
    used = encoded.select("part", "place", F.posexplode("digests").alias("seq", "digest"))
    chunks = used.join(index, "digest").groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("seq", "pack", "offset", "length", "digest"))).alias("chunks"))
    recipes = encoded.select("doc_id", "part", "place", "n_tokens", "root").join(chunks, ["part", "place"])
    recipes.repartitionByRange("doc_id", "part", "place").sortWithinPartitions("doc_id", "part", "place").write.parquet(f"{path}/recipes")
    return Store(path)


def read_store(spark: SparkSession, store: Store, crc_only: bool = False) -> DataFrame:
    """(doc_id, part, place, n_tokens, ids): every document rebuilt from its recipe; each chunk and root is verified.

    With crc_only ids_crc32 stands for ids, so that the rebuilt ids needn't leave the worker. A chunk whose content isn't that of its digest, or a recipe whose digests don't give its root, ends the job.
    """
    small_batches(spark)
    packs = f"{store.path}/packs"

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = PackReader(packs)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("chunks"))
            refs = lists.flatten()
            pack, offset, length, names = (refs.field(k).to_pylist() for k in ("pack", "offset", "length", "digest"))
            contents = []
            for k, name in enumerate(names):
                content = _decoded_chunk(source.read(pack[k], offset[k], length[k]))
                if digest(content) != name:
                    raise ValueError(f"chunk {name.hex()} in {pack[k]} at {offset[k]} is damaged")
                contents.append(content)
            streams, ends = [], np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
            for a, b, root in zip(ends, ends[1:], batch.column(batch.schema.get_field_index("root")).to_pylist()):
                if merkle_root(names[a:b]) != root:
                    raise ValueError("a recipe doesn't give its Merkle root")
                streams.append(b"".join(contents[a:b]))
            counts = pa.array([len(s) // 4 for s in streams], pa.int64())
            keys = [batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "part", "place")]
            last = pa.array([zlib.crc32(s) for s in streams], pa.int64()) if crc_only else pa.array(streams, pa.binary())
            yield pa.RecordBatch.from_arrays([*keys, counts, last], ["doc_id", "part", "place", "n_tokens", name_of_last])

    name_of_last = "ids_crc32" if crc_only else "ids"
    return spark.read.parquet(f"{store.path}/recipes").mapInArrow(rebuilt, f"doc_id long, part int, place long, n_tokens long, {name_of_last} {'long' if crc_only else 'binary'}")


def with_starts(read: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before each in ascending doc_id order: sums within ranges, then over the ranges' totals."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            sums = np.cumsum(n) + total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(n), pa.int32()), pa.array(sums - n)], [*batch.schema.names, "range", "local_start"])
            total = int(sums[-1]) if len(n) else total

    flat = read.repartitionByRange("doc_id", "part", "place").sortWithinPartitions("doc_id", "part", "place")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields)
    ranged = staged(flat.mapInArrow(local, f"{schema}, range int, local_start long"), by_task=True)
    totals = ranged.groupBy("range").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range partition
    bases = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return ranged.join(bases, "range").withColumn("start", F.col("base") + F.col("local_start")).drop("range", "base", "local_start")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): writes docs to a store and reports each document as read back.

    Null and empty texts are the end id alone; strings of special tokens in a text are ordinary text, as the vocabulary's
    README has it (encode_special_tokens). Null ids come first; rows that share an id keep the order of reading, repeated
    rows too; texts of any length are stored whole. An empty table gives no rows; other columns are not looked at.
    """
    store = write_store(docs, tokenizer_path)
    return with_starts(staged(read_store(docs.sparkSession, store, crc_only=True))).select("doc_id", "start", "n_tokens", "ids_crc32")
