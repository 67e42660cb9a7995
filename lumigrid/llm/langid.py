"""Language identification: the nearest of several centroids per language in TF-IDF n-gram space.

Texts become counts of 1-, 2- and 3-grams of letters, hashed to DIMENSIONS; counts are damped, weighted by inverse
document frequency and normalised. The centroids of a language come from spherical k-means over its part of a bounded
sample. A text goes to the language of the centroid with the largest cosine, and is rejected where that is too small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumigrid.llm.sampling import held_out, learnable
from lumigrid.session import table

DIMENSIONS = 4096
CENTROIDS = 3
#: Rows of each language, and of all languages, that the centroids are fitted on.
ROWS_PER_LANGUAGE, ROWS = 750, 3000
#: A text is rejected below this share of the cosine that all but one in a thousand fitted texts reach.
REJECT = 0.5
UNDETERMINED = "und"
_BATCH = 128
_BMP = 1 << 16


def _tables() -> np.ndarray:
    """By code point: the lower-case letter, 0 for what is no letter."""
    out = np.zeros(_BMP, np.uint32)
    for c in range(_BMP):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


_LETTER: np.ndarray | None = None


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters as code points, one 0 for each run of anything else."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _tables()
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.size and points.max() >= _BMP:
        high = np.nonzero(points >= _BMP)[0]
        own = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in points[high].tolist()], np.uint32)
        points = _LETTER[np.where(points < _BMP, points, 0)]
        points[high] = own
    else:
        points = _LETTER[points]
    kept = np.concatenate((points[:1] > 0, (points[1:] > 0) | (points[:-1] > 0)))
    return points[kept]


def gram_counts(text: str | None) -> np.ndarray:
    """Hashed n-gram counts; all 0 without a letter."""
    own = letters(text)
    if not own.any():
        return np.zeros(DIMENSIONS, np.float32)
    own = np.concatenate((np.zeros(1, np.uint32), own, np.zeros(1, np.uint32)))
    total, run = np.zeros(DIMENSIONS, np.int64), np.zeros(len(own), np.uint32)
    for n in (1, 2, 3):
        run = run[: len(own) - n + 1] * np.uint32(0x01000193) + own[n - 1 :] + np.uint32(n)
        mixed = run * np.uint32(0x9E3779B1)
        total += np.bincount(mixed >> np.uint32(20), minlength=DIMENSIONS)
    return total.astype(np.float32)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Centroids:
    """The fitted model: at most CENTROIDS * languages vectors."""

    def __init__(self, languages: list[str], idf: np.ndarray, centres: np.ndarray, owner: np.ndarray, least: float):
        self.languages, self.idf, self.centres, self.owner, self.least = languages, idf, centres, owner, least

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _normal(np.log1p(counts) * self.idf)

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        return self.vectors(counts) @ self.centres.T


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out rows; the rows must be normalised."""
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    centres = x[chosen]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        centres = _normal(np.stack([x[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def fit(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, rows: int = ROWS, centroids: int = CENTROIDS) -> Centroids | None:
    """Centroids from the learnable rows of docs (doc_id, text, lang); None if there are none.

    The first rows of each language by the doc_id's hash are taken, at most per_language and at least one. A bound of
    the hash that lets more than these through spares the rest the ranking.
    """
    known = docs.select("doc_id", "text", "lang").where(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)))
    counts = {r["lang"]: (r["n"], r["least"]) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return None
    each = max(1, min(per_language, rows // len(counts)))
    enough = each + 6 * math.sqrt(each) + 20  # expected below the bound; fewer than each are out of the question
    bounds = {lang: max(least + 1, int(min(1.0, enough / n) * (1 << 40))) for lang, (n, least) in counts.items()}
    bound = F.element_at(F.create_map(*(x for lang, b in bounds.items() for x in (F.lit(lang), F.lit(b).cast("long")))), F.col("lang"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text"))
    chosen = known.where(F.col("place") < bound).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [gram_counts(t.as_py()) for t in batch.column(1)]
            at = [np.nonzero(v)[0].astype(np.int16) for v in made]
            yield pa.RecordBatch.from_pylist([{"lang": g.as_py(), "at": a.tobytes(), "n": v[a].tobytes()} for g, v, a in zip(batch.column(0), made, at)], schema=pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())]))

    got = chosen.select("lang", "text").mapInArrow(sparse, "lang string, at binary, n binary").collect()
    got = [r for r in got if r["at"]]
    if not got:
        return None
    x = np.zeros((len(got), DIMENSIONS), np.float32)
    for row, r in zip(x, got):
        row[np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["n"], np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.2).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    langs = np.array([r["lang"] for r in got])
    languages = sorted(set(langs.tolist()))
    groups = [_k_means(x[langs == g], centroids) for g in languages]
    own = np.concatenate([(x[langs == g] @ c.T).max(1) for g, c in zip(languages, groups)])
    return Centroids(languages, idf, np.concatenate(groups), np.repeat(np.arange(len(groups)), [len(c) for c in groups]), REJECT * float(np.quantile(own, 0.001)))


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def judge(texts: list[str | None], fitted: Centroids | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """For each text the language, the cosine and whether it is rejected."""
    counts = np.stack([gram_counts(t) for t in texts])
    some = counts.any(1)
    if fitted is None:
        return [UNDETERMINED] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
    cosines = fitted.cosines(counts)
    names = [fitted.languages[fitted.owner[k]] if s else UNDETERMINED for k, s in zip(cosines.argmax(1), some)]
    best = np.where(some, np.clip(cosines.max(1), 0, 1), 0).astype(np.float64)
    return names, best, ~some | (best < fitted.least)


def predict(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine) and rejected of each row of docs (doc_id, text).

    A text that is null or has no letter is `und` with score 0 and rejected; so is every text without a model.
    Repeated rows each give a row; no rows give no rows; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                ids, held, texts = (batch.column(k).slice(at, _BATCH) for k in range(3))
                names, best, refused = judge(texts.to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(names, pa.string()), pa.array(best), pa.array(refused)], schema=_RESULT)

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """The rows of docs (text, more columns) that predict does not reject, each judged by itself and passed on whole."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                piece = batch.slice(at, _BATCH)
                yield piece.filter(pa.array(~judge(piece.column(column).to_pylist(), shared.value)[2]))

    return docs.mapInArrow(keep, docs.schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by centroids of the documents."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
