"""Quality rules: counts of a document's own words, and how often its lines occur in other documents of its host.

A line's normal form has A-Z lowered, digits as 0 and single blanks. A line that more than `line_docs` distinct documents
of one host hold is removed from all of them. A document that keeps less than `least_kept` of its words, or fewer than the
base rules ask for, is depleted and rejected. Documents are told apart by content, so exact copies count once; a group of
more than line_docs near copies on one host counts as that many documents, as pages of one template do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from porelake.llm.common import owned, small_batches, staged

#: Documents of a host that may share a line; share of words to be kept.
LINE_DOCS, LEAST_KEPT = 20, 0.2
#: Base rules: fewest words, largest share of words in repeated three-word windows in per cent.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"

_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, covered = 0, 0
    for at, window in enumerate(windows):
        if window in often:
            total += at + 3 - max(at, covered)
            covered = at + 3
    return total


def measure(text: str | None) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words in each line by the hash of its normal form."""
    if not text:
        return 0, 0, 0, 0, 0, {}
    data = text.encode("utf-8", "replace")
    words: list[bytes] = []
    seen: set[bytes] = set()
    repeated_lines = 0
    lines: dict[int, int] = {}
    for line, normal in zip(data.split(b"\n"), data.translate(_NORMAL).split(b"\n")):
        if own := line.split():
            words += own
            if line in seen:
                repeated_lines += 1
            seen.add(line)
            key = xxhash.xxh64_intdigest(b" ".join(normal.split())) - (1 << 63)
            lines[key] = lines.get(key, 0) + len(own)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeated_lines, repeated_words(words), lines


_MEASURED = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>"
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))


def measured(docs: DataFrame) -> DataFrame:
    """A row for each row of docs, from its whole text, with its host and lines; written once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            found = [measure(t) for t in texts]
            hashes = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "replace"), 1) - (1 << 63) for t in texts]
            lines = [[{"line": k, "words": n} for k, n in x[5].items()] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.int64()), *(pa.array([x[i] for x in found], pa.int64()) for i in range(5)), pa.array(lines, _LINES)], ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    small_batches(docs.sparkSession)
    return staged(docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(cast(source as string), '') as host", "cast(text as string) as text").mapInArrow(owned("quality", rows), _MEASURED))


def removed_words(found: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """measured() -> (host, text_hash, n_removed_words) for the documents that lose lines.

    Lines are made distinct by document before they are counted, and counted partially before the shuffle: a line of very
    many documents makes no large task. What is joined is written first, so that each side of a join is a plain shuffle,
    whose hot keys AQE splits.
    """
    lines = found.select("host", "text_hash", F.explode("lines").alias("l")).select("host", "text_hash", "l.line", "l.words")
    lines = lines.groupBy("host", "line", "text_hash").agg(F.max("words").alias("words"))
    often = staged(lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs).select("host", "line"))
    return staged(lines.join(often, ["host", "line"]).groupBy("host", "text_hash").agg(F.sum("words").alias("n_removed_words")))


def judged(docs: DataFrame, line_docs: int = LINE_DOCS, least_kept: float = LEAST_KEPT) -> DataFrame:
    """(doc_id, host, text_hash, counts, n_removed_words, base_failed, kept): one row for each row of docs.

    Null and empty texts have no words and fail; a null source counts as the empty host; repeated rows count once and are
    judged alike; null ids are no obstacle; very long texts are read whole; a line just at the limit stays. An empty table
    gives no rows. Other columns are not looked at.
    """
    found = measured(docs)
    gone = removed_words(found, line_docs)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = found.drop("lines").join(gone, ["host", "text_hash"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_removed_words")
    kept = ~base & (left >= LEAST_WORDS) & (left >= least_kept * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", kept)


def quality(docs: DataFrame) -> DataFrame:
    """The digest of judged()."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; repeated rows stay or go together, empty tables stay empty."""
    bad = judged(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_hash").alias("_hash")).distinct()
    return without(docs, bad)


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs less the rows whose id, host and text hash are in bad (_id, _host, _hash)."""
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [xxhash.xxh64_intdigest((t.as_py() or "").encode("utf-8", "replace"), 1) - (1 << 63) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.int64())], [*batch.schema.names, "_porelake_text_hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    hashed = docs.mapInArrow(owned("quality", rows), f"{schema}, _porelake_text_hash long")
    same = hashed["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.coalesce(hashed["source"].cast("string"), F.lit("")) == bad["_host"]) & (hashed["_porelake_text_hash"] == bad["_hash"])
    return hashed.join(bad, same, "left_anti").drop("_porelake_text_hash")


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT r, host, text, len(w) AS n_words, line, pos FROM (SELECT r, host, text, w, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
    WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 0),
dup AS (SELECT r, sum(n - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM l GROUP BY r, line) GROUP BY r),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
o AS (SELECT r, win FROM g GROUP BY r, win HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT g.r, unnest(range(g.i, g.i + 3)) AS pos FROM g JOIN o ON g.r = o.r AND g.win = o.win) GROUP BY r),
n AS (SELECT host, text, array_to_string(regexp_extract_all(translate(line, {_LOWER}), '[^\\x20\\x09-\\x0D]+'), ' ') AS normal, n_words, sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS words
    FROM l WHERE r IN (SELECT min(r) FROM d GROUP BY host, text) GROUP BY ALL),
f AS (SELECT host, normal FROM n GROUP BY host, normal HAVING count(*) > {LINE_DOCS}),
gone AS (SELECT n.host, n.text, sum(n.words) AS n_removed_words FROM n JOIN f ON n.host = f.host AND n.normal = f.normal GROUP BY n.host, n.text),
m AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(array_to_string(d.w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n_removed_words, 0) AS BIGINT) AS n_removed_words
    FROM d LEFT JOIN dup ON d.r = dup.r LEFT JOIN rep ON d.r = rep.r LEFT JOIN gone ON d.host = gone.host AND d.text = gone.text)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {LEAST_KEPT} * n_words AND n_words - n_removed_words >= 50 AS kept FROM m
"""
