"""Language identification by a bidirectional gated recurrent network over bytes, written and trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, each read once forwards and once backwards from a zero state.
Every position gets a probability for each language from both states; a document's are the mean over all its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from porelake.llm.common import owned, small_batches

#: Bytes of a window; hidden units a direction; windows that run side by side.
WINDOW, HIDDEN, LANES = 96, 8, 4096
#: The fit: labelled documents a language (their expected number), windows from each, steps, windows a step, step size. The bound on what
#: reaches the driver: DOCS_PER_LANG * WINDOWS_PER_DOC * WINDOW bytes for each of at most MAX_LANGS languages.
DOCS_PER_LANG, WINDOWS_PER_DOC, MAX_LANGS = 400, 6, 256
STEPS, BATCH, RATE = 260, 192, 0.02
PAD = 256
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class BiGRU:
    """Parameters: for each direction inputs x (257, 3H), recurrences uzr (H, 2H) and uc (H, H), outputs o (H, K); bias b (K)."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> BiGRU:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"b": np.zeros(len(langs), np.float32)}
        for way in "fb":
            p[f"x{way}"] = normal(257, 3 * hidden, scale=0.3)
            p[f"uzr{way}"] = normal(hidden, 2 * hidden, scale=hidden**-0.5)
            p[f"uc{way}"] = normal(hidden, hidden, scale=hidden**-0.5)
            p[f"o{way}"] = normal(hidden, len(langs), scale=hidden**-0.5)
        return BiGRU(langs, p)

    def states(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """x: (T, B) byte numbers, in reading order -> (T, B, H) states; keep gets what the backward pass needs."""
        table, uzr, uc = (self.p[k + way] for k in ("x", "uzr", "uc"))
        size = uc.shape[0]
        h = np.zeros((x.shape[1], size), np.float32)
        out = np.empty((*x.shape, size), np.float32)
        for t in range(len(x)):
            g = table.take(x[t], axis=0)
            zr = h @ uzr
            zr += g[:, : 2 * size]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :size], zr[:, size:]
            c = (r * h) @ uc
            c += g[:, 2 * size :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, c))
            d = c - h
            d *= z
            h = np.add(h, d, out=out[t])
        return out

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, B) byte numbers -> (T, B, K) probabilities of each language at each position."""
        logits = self.states(x, "f") @ self.p["of"]
        logits += self.states(x[::-1], "b")[::-1] @ self.p["ob"]
        logits += self.p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all unpadded positions and its gradients, by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        hs = {"f": self.states(x, "f", kept["f"]), "b": self.states(x[::-1], "b", kept["b"])}
        logits = hs["f"] @ self.p["of"] + hs["b"][::-1] @ self.p["ob"] + self.p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        real = (x != PAD).astype(np.float32)
        weight = real / real.sum()
        lanes = np.arange(x.shape[1])
        loss = float(-(np.log(prob[:, lanes, y] + 1e-9) * weight).sum())
        prob[:, lanes, y] -= 1
        prob *= weight[:, :, None]
        grads = {"b": prob.sum(axis=(0, 1))}
        for way in "fb":
            order = x if way == "f" else x[::-1]
            dlogit = prob if way == "f" else prob[::-1]
            table, uzr, uc, o = (self.p[k + way] for k in ("x", "uzr", "uc", "o"))
            size = uc.shape[0]
            grads["o" + way] = np.tensordot(hs[way], dlogit, ((0, 1), (0, 1)))
            dtable, duzr, duc = np.zeros_like(table), np.zeros_like(uzr), np.zeros_like(uc)
            dnext = np.zeros((x.shape[1], size), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h, z, r, c = kept[way][t]
                dh = dlogit[t] @ o.T + dnext
                dc = dh * z * (1 - c * c)
                drh = dc @ uc.T
                dzr = np.concatenate([dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
                duc += (r * h).T @ dc
                duzr += h.T @ dzr
                np.add.at(dtable, order[t], np.concatenate([dzr, dc], axis=1))
                dnext = dh * (1 - z) + drh * r + dzr @ uzr.T
            grads["x" + way], grads["uzr" + way], grads["uc" + way] = dtable, duzr, duc
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> BiGRU:
        """x: (N, WINDOW) byte numbers, y: (N,) language numbers; Adam with a falling step, languages drawn evenly."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            drawn = rng.integers(0, len(groups), batch)
            rows = np.array([groups[k][rng.integers(len(groups[k]))] for k in drawn])
            _, grads = self.gradients(np.ascontiguousarray(x[rows].T), y[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(N, K): the mean over every position of each whole text; rows of empty texts are zero. Lanes bound the memory."""
        total = np.zeros((len(texts), len(self.langs)), np.float64)
        lane: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            x = np.full((WINDOW, len(lane)), PAD, np.int16)
            for i, (_, part) in enumerate(lane):
                x[: len(part), i] = part
            prob = self.position_probabilities(x)
            prob *= (x != PAD)[:, :, None]
            np.add.at(total, [i for i, _ in lane], prob.sum(axis=0))
            lane.clear()

        for i, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            for at in range(0, len(data), WINDOW):
                lane.append((i, data[at : at + WINDOW]))
                if len(lane) == LANES:
                    flush()
        if lane:
            flush()
        return total / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]


def held_out(doc_id) -> object:
    """Column: the documents that are never learned from, by crc32 of the id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> BiGRU:
    """Fits a network on text and lang of labelled documents that aren't held out, about docs_per_lang a language.

    Two reads: languages are counted (an aggregate), then about as many documents of each as the bound allows are drawn by a
    hash of their id and text, so that an id that many rows share, or none, is no obstacle, and only distinct windows of them, spaced evenly over the whole text, reach the driver. At most MAX_LANGS
    languages, the most frequent, are learned. No labelled text: a network that knows no language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return BiGRU.fresh([])
    langs = sorted(r["lang"] for r in counts)
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, docs_per_lang / r["count"])))))
    drawn = rows.select("lang", "text", (F.pmod(F.xxhash64("doc_id", "text", F.lit("draw")), F.lit(1 << 30)) / (1 << 30)).alias("u")).where(F.col("u") < share[F.col("lang")])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, part, place = [], [], []
            for name, text, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode("utf-8", "replace")
                last = max(0, len(data) - WINDOW)
                for at in sorted({last * k // max(1, WINDOWS_PER_DOC - 1) for k in range(WINDOWS_PER_DOC)}):
                    lang.append(name), part.append(data[at : at + WINDOW]), place.append(u + at)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(part, pa.binary()), pa.array(place, pa.float64())], ["lang", "part", "place"])

    got = sorted((r.lang, r.place, bytes(r.part)) for r in drawn.mapInArrow(owned("langid", windows), "lang string, part binary, place double").distinct().collect())
    x = np.full((len(got), WINDOW), PAD, np.int16)
    for i, (_, _, part) in enumerate(got):
        x[i, : len(part)] = np.frombuffer(part, np.uint8)
    present = sorted({g[0] for g in got})
    y = np.array([present.index(g[0]) for g in got], np.int64)
    return BiGRU.fresh(present or langs[:1]).fit(x, y) if got else BiGRU.fresh([])


def predict(docs: DataFrame, model: BiGRU, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns (those of the same names in docs are replaced): every row, from its whole text alone.

    Null texts and texts without a letter (Unicode L) are `und` with score 0, as is everything if no language was learned.
    Equal texts get equal answers; ties go to the first language by name.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    at, kept = docs.columns.index("text"), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if net.langs and t and _LETTER.search(t)]
            prob = net.document_probabilities([texts[i].encode("utf-8", "replace") for i in known])
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, p in zip(known, prob):
                k = int(p.argmax())
                lang[i], score[i] = net.langs[k], float(min(1.0, max(0.0, p[k])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(owned("langid", rows), f"{schema}{', ' * bool(schema)}{names[0]} string, {names[1]} double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by a network learned from the rest of the same table."""
    model = learn(docs)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told; those answered `und` go: null texts and texts without a letter.

    A learned language is an answer however low its score: the network knows no other languages that it could reject.
    Repeated rows stay or go together; very long texts are read whole; an empty table stays empty.
    """
    return predict(docs, learn(docs), ("_porelake_lang", "_porelake_score")).where(F.col("_porelake_lang") != UNKNOWN).drop("_porelake_lang", "_porelake_score")
