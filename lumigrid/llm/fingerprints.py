"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction of the hash range.

Sketches merge by union and compare on the hashes that both would keep, so the containment of a short document in a long
one can be estimated. Nothing else is kept: a document with few shingles has few hashes, perhaps none. A scale of 1 keeps
all, so that estimates are exact; sketches of different scales compare at the coarser one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigrid.session import table

SHINGLE_WORDS = 5
#: One hash of so many is kept.
SCALE = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20200101)).integers(0, 1 << 63, 256, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FULL = 1 << 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of each word of UTF-8 bytes, A-Z lower-cased: a polynomial in the byte's place, by prefix sums, mixed."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    within = np.arange(len(raw)) - np.repeat(np.concatenate(([0], starts[1:])), np.diff(np.concatenate(([0], starts[1:], [len(raw)]))))
    within[: starts[0]], within[starts[0] : ends[0]] = 0, np.arange(length[0])
    powers = np.cumprod(np.full(int(length.max()) + 1, _ODD), dtype=np.uint64)
    terms = _BYTE[_FOLD[raw]] * powers[np.minimum(within, length.max())]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return _mix(sums[ends] - sums[starts])


def all_shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The hash of each run of shingle_words words; of all words where there are fewer; none without words."""
    own = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(own):
        return own
    size = min(shingle_words, len(own))
    total = np.zeros(len(own) - size + 1, np.uint64)
    for k in range(size):
        total = total * _ODD + own[k : len(own) - size + 1 + k]
    return _mix(total)


def shingle_set(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes, ascending."""
    return np.unique(all_shingles(text, shingle_words))


def bound(scale: int = SCALE) -> np.uint64:
    """The largest hash that a sketch keeps."""
    return np.uint64(_FULL // scale - 1)


def sketch(text: str, shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes, within the fraction, of the runs of shingle_words words.

    Fewer words are one shingle; without words the sketch is empty.
    """
    hashes = all_shingles(text, shingle_words)
    return np.unique(hashes[hashes <= bound(scale)])


def _shared(a: np.ndarray, b: np.ndarray, scale: int, other: int) -> tuple[int, int, int]:
    a, b = (x[: np.searchsorted(x, bound(max(scale, other)), "right")] for x in (a, b))
    return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE, other: int = SCALE) -> float:
    """Estimated Jaccard likeness of two documents, from sketches of these scales: 1 for two empty ones, 0 for one."""
    both, n, m = _shared(a, b, scale, other)
    return both / (n + m - both) if n + m else 1.0


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE, other: int = SCALE) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty sketch a."""
    both, n, _ = _shared(a, b, scale, other)
    return both / n if n else 1.0


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two documents' shingles together, from their sketches of one scale."""
    return np.union1d(a, b)


def to_text(own: np.ndarray) -> str:
    """16 hexadecimal digits for each hash, ascending."""
    return own.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of documents within a bucket, its first look-ahead row last."""
    last = None  # bucket, doc_id, text, sketch of the row before
    for batch in batches:
        out = []
        for bucket, ahead, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if last and last[0] != bucket:
                last = None  # the bucket's look-ahead row has been taken already
            if ahead and last is None:
                continue  # a second look-ahead row, or one of a bucket without rows
            text = text or ""
            own = sketch(text)
            if last:
                before = last[2]
                half = len(before) // 2
                edited = before[: len(before) - half] + text[:half]
                changed = sketch(edited)
                out.append({"doc_id": last[1], "n_chars": len(before), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": to_text(last[3]), "edited_fingerprint": to_text(changed), "near_edited": likeness(last[3], changed), "near_next": likeness(last[3], own)})
            last = None if ahead else (bucket, doc_id, text, own)
        yield pa.RecordBatch.from_pylist(out, schema=_RESULT)


def compare_with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness and that of the next document.

    Documents are ordered by doc_id, null first, then text; after the last comes the first. The edited text has the
    last floor(n_chars / 2) code points replaced by the first as many of the next document. A null text is empty. Rows
    are dealt into ranges of doc_id, and the first row of a range is also given to the range before; bounds and first
    ids, one for each range, are all that the driver sees. Rows of one doc_id stay in one range. A single row follows
    itself. No rows give no rows. Further columns are not read.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("text").rdd.getNumPartitions())
    at = [k / buckets for k in range(1, buckets)]
    bounds = sorted({int(x) for x in keyed.agg(F.percentile_approx("key", at, 20 * buckets)).first()[0] or []}) if at else []

    def bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for batch in batches:
            bucket = pa.array(np.searchsorted(edges, batch.column(0).to_numpy(), "left").astype(np.int32))
            yield pa.RecordBatch.from_arrays([bucket, *batch.columns], names=["bucket", *batch.schema.names])

    firsts = sorted((r["first"], r.bucket) for r in keyed.select("key").mapInArrow(bucket_of, "bucket int, key long").groupBy("bucket").agg(F.min("key").alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], _schema())
    before = {first: firsts[k - 1][1] for k, (first, _) in enumerate(firsts)}
    # one row for each range
    heads = F.broadcast(spark.createDataFrame(list(before.items()), "key long, given int"))
    dealt = keyed.mapInArrow(bucket_of, "bucket int, key long, doc_id long, text string").join(heads, "key", "left")
    own = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead")))
    more = F.array(F.struct(F.col("given").alias("bucket"), F.lit(1).alias("ahead")))
    copies = dealt.select(F.explode(F.when(F.col("given").isNull(), own).otherwise(F.concat(own, more))).alias("to"), "key", "doc_id", "text").select("to.bucket", "to.ahead", "key", "doc_id", "text")
    swept = copies.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "key", "text")
    return swept.select("bucket", "ahead", "doc_id", "text").mapInArrow(_compare, _schema())


def _schema() -> str:
    return "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return compare_with_next(table(spark, sf_dir, "documents"))
