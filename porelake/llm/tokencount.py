"""Token counts of a unigram model by dynamic programming over a trie of the corpus's distinct pre-tokens.

A pre-token is a white-space-delimited word behind a word mark. The distinct pre-tokens of all documents are counted once,
dealt out by ranges and sorted, so each range holds them as a trie in depth-first order: a node's forward score, the best sum
of piece scores over all segmentations of its prefix, is computed once from the nodes above it however many pre-tokens share
the prefix, and only the path to the current node is kept. What a terminal node has, the tokens of its best segmentation, is
stored by pre-token; a document's count is the sum over its pre-tokens. The most frequent of them, a bounded number, are
broadcast with their counts; the rest are joined.

Scores are the model's own. A character that no piece covers costs `UNKNOWN` more than the worst piece and is as many tokens
as it has bytes. The only normalisation is that white space separates words, which is less than the model's own normaliser
does; these are counts of a unigram segmentation with the model's pieces and scores, not of its own merges.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from porelake.llm.common import gathered, small_batches, staged

MARK = "▁"
#: What a character that no piece covers costs more than the worst piece.
UNKNOWN = 10.0
#: Pre-tokens that are broadcast at most, and bytes that each of them may have.
SHARED_WORDS, SHARED_BYTES = 400_000, 64
#: Bytes of text that a worker splits at once.
BATCH_BYTES = 4 << 20

#: White space to Python that isn't to Arrow.
_MORE_BLANKS = "[\x1c-\x1f\\x{85}]"


def unigram_scores(model_path: str) -> dict[str, float]:
    """piece -> the model's score, of its ordinary pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class ForwardTrie:
    """Forward scores on the path of the trie to the last pre-token. Equal scores go to fewer tokens."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        by_end: dict[str, set[int]] = {}
        for piece in scores:
            by_end.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {end: sorted(found, reverse=True) for end, found in by_end.items()}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.path, self.best, self.tokens = "", [0.0], [0]

    def count(self, text: str) -> int:
        """The tokens of text; nodes that it shares with the text before it aren't worked out again."""
        scores, best, tokens, path = self.scores, self.best, self.tokens, self.path
        shared, most = 0, min(len(path), len(text))
        while shared < most and path[shared] == text[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            char = text[end - 1]
            if char in scores:
                top, n = -np.inf, 0
            else:
                top, n = best[end - 1] + self.unknown, tokens[end - 1] + len(char.encode("utf-8", "replace"))
            for length in self.lengths.get(char, ()):
                if length <= end and (score := scores.get(text[end - length : end])) is not None:
                    score += best[end - length]
                    if score > top or (score == top and tokens[end - length] + 1 < n):
                        top, n = score, tokens[end - length] + 1
            best.append(top), tokens.append(n)
        self.path = text
        return tokens[-1]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text and the number in `words` of each word of all texts, and the distinct words; null has none."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, _MORE_BLANKS)).as_py():
        texts = pc.replace_substring_regex(texts, _MORE_BLANKS, " ")
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[index] if len(words) else np.zeros(0, bool)
    return row[real], index[real], words


def distinct_words(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of all texts, counted in each batch before they are shuffled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BATCH_BYTES):
            _, index, words = split_words(batch.column(0))
            n = np.bincount(index, minlength=len(words))
            yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"]).filter(pa.array(n > 0))

    return docs.selectExpr("cast(text as string) as text").mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def terminal_counts(words: DataFrame, model_path: str) -> DataFrame:
    """words (word, n) -> (word, n, tokens), written: each range of sorted words is walked as a trie."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ForwardTrie(_scores(model_path))
        for batch in batches:
            yield batch.append_column("tokens", pa.array([trie.count(MARK + w) for w in batch.column(0).to_pylist()], pa.int64()))

    return staged(words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(rows, "word string, n long, tokens long"))


_SCORES: dict[str, dict[str, float]] = {}
#: A worker's broadcast counts by the name of their broadcast; the last one only.
_SHARED: dict[str, dict[str, int]] = {}


def _scores(model_path: str) -> dict[str, float]:
    if model_path not in _SCORES:
        _SCORES[model_path] = unigram_scores(model_path)
    return _SCORES[model_path]


def most_frequent(counted: DataFrame, most: int) -> pa.Table:
    """(word, tokens) of short words, the most frequent ones as far as whole powers of two of n give at most `most`."""
    short = counted.where(F.octet_length("word") <= SHARED_BYTES).withColumn("power", F.floor(F.log2("n")).cast("int"))
    least, total = 64, 0
    for r in sorted(short.groupBy("power").count().collect(), reverse=True):  # a row for each power of two at most
        total += r["count"]
        if total > most:
            break
        least = r["power"]
    return short.where(F.col("power") >= least).select("word", "tokens").toArrow()


_COUNTED = "doc_id long, part int, place long, n_words long, n_tokens long, rare array<struct<word:string,times:long>>"


def count_tokens(docs: DataFrame, model_path: str, shared_words: int = SHARED_WORDS) -> DataFrame:
    """(doc_id, n_words, n_tokens): one row for each row of docs, over whole texts.

    Null and empty texts have none; repeated rows give equal rows; null ids stay null; words of any length are counted; an
    empty table gives no rows; other columns are not looked at. Ties of scores go to fewer tokens.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counted = terminal_counts(distinct_words(docs), model_path)
    shared, name = spark.sparkContext.broadcast(most_frequent(counted, shared_words)), uuid.uuid4().hex

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, BATCH_BYTES):
            if name not in _SHARED:
                _SHARED.clear()
                _SHARED[name] = dict(zip(*(shared.value.column(k).to_pylist() for k in (0, 1))))
            known, size = _SHARED[name], batch.num_rows
            row, index, words = split_words(batch.column(1))
            tokens = np.fromiter((known.get(w, -1) for w in words.to_pylist()), np.int64, len(words))
            of_word = tokens[index]
            n_tokens = np.bincount(row, np.where(of_word < 0, 0, of_word), size).astype(np.int64)
            at = of_word < 0
            pair, times = np.unique(row[at] * max(1, len(words)) + index[at], return_counts=True)
            rare_row, rare_word = np.divmod(pair, max(1, len(words)))
            ends = np.searchsorted(rare_row, np.arange(size + 1))
            rare = pa.StructArray.from_arrays([words.take(pa.array(rare_word)), pa.array(times, pa.int64())], ["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(size, part, np.int32)), pa.array(np.arange(place, place + size)), pa.array(np.bincount(row, minlength=size).astype(np.int64)), pa.array(n_tokens), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)],
                ["doc_id", "part", "place", "n_words", "n_tokens", "rare"],
            )
            place += size

    found = staged(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(rows, _COUNTED), by_task=True)
    rest = found.select("part", "place", F.explode("rare").alias("r")).select("part", "place", "r.word", "r.times").join(counted.select("word", "tokens"), "word")
    rest = rest.groupBy("part", "place").agg(F.sum(F.col("times") * F.col("tokens")).alias("more"))
    return found.join(rest, ["part", "place"], "left").select("doc_id", "n_words", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
