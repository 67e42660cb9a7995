"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are dealt into parts of correlated bits. Two fingerprints within the limit must, for every choice of
thresholds that sum to limit - parts + 1, be within its threshold in some part. Each fingerprint picks its own
thresholds by dynamic programming on estimated candidate counts, probes the parts' index with all values within them,
and candidates are verified on all bits. A fingerprint whose probes would meet more than DENSE candidates lies in a
crowd; crowds are linked among themselves by values one bit away, of which two fingerprints within two bits share one.
So no bucket is ever expanded into its pairs, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigrid.llm.text import shingle_hashes
from lumigrid.plans.components import connected_components
from lumigrid.session import materialize, table

BITS = 64
#: Candidates of one fingerprint beyond which it is linked as part of a crowd.
DENSE = 64
#: Bits of a part that its histogram covers: at most 65,536 counts for each part reach the driver.
HISTOGRAM_BITS = 16
#: Fingerprints beyond which two wide parts are used instead of three.
WIDE = 1 << 24


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id and fingerprint (long) of each row of docs."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_signed(majority(shingle_hashes(t.as_py(), shingle_words))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(prints, f"doc_id {kind}, fp long")


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        bits = _bits(batch).astype(np.float32)
        n += len(bits)
        total += (bits.T @ bits).astype(np.int64)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])


def bit_parts(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits (0 is the highest) in parts of nearly equal size, correlated bits together; both: how often two are set."""
    p = np.diag(both) / max(n, 1)
    deviation = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    strength = np.abs(both / max(n, 1) - np.outer(p, p)) / deviation
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [max(free, key=lambda b: strength[b, free].sum())]
        free.remove(own[0])
        while len(own) < size:
            best = max(free, key=lambda b: strength[b, own].sum())
            own.append(best)
            free.remove(best)
        out.append(own)
    return out


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds that sum to total at least cost, by dynamic programming over the parts.

    costs[row, part, e] is the cost of threshold e - 1, so e = 0 means that the part is not probed.
    """
    rows, parts, choices = costs.shape
    states = total + parts + 1  # sum of e so far
    best = np.full((rows, states), np.inf)
    best[:, 0] = 0
    picked = []
    for k in range(parts):
        new, pick = np.full((rows, states), np.inf), np.zeros((rows, states), np.int8)
        for e in range(min(choices, states)):
            with_e = best[:, : states - e] + costs[:, k, e : e + 1]
            better = with_e < new[:, e:]
            new[:, e:][better] = with_e[better]
            pick[:, e:][better] = e
        best = new
        picked.append(pick)
    out, state, at = np.zeros((rows, parts), np.int64), np.full(rows, states - 1), np.arange(rows)
    for k in reversed(range(parts)):
        out[:, k] = picked[k][at, state] - 1
        state = state - out[:, k] - 1
    return out


class Pigeonhole:
    """Parts, their histograms, and the probes of a fingerprint."""

    def __init__(self, parts: list[list[int]], counts: np.ndarray, limit: int):
        self.parts, self.limit = parts, limit
        radius = []  # counts within 0, 1, 2, ... bits
        for e in range(limit + 1):
            layer = np.zeros_like(counts)
            for flips in combinations(range(HISTOGRAM_BITS), e):
                layer += counts[:, np.arange(counts.shape[1]) ^ sum(1 << b for b in flips)]
            radius.append(layer + (radius[-1] if e else 0))
        self.within = np.stack(radius)
        self.masks = [[np.array([sum(1 << b for b in f) for f in combinations(range(len(p)), e)], np.int64) for e in range(limit + 1)] for p in parts]

    @staticmethod
    def values(bits: np.ndarray, part: list[int], most: int = BITS) -> np.ndarray:
        own = bits[:, part[:most]].astype(np.int64)
        return own @ (1 << np.arange(own.shape[1], dtype=np.int64))

    def keys(self, bits: np.ndarray) -> np.ndarray:
        return np.stack([self.values(bits, p) * len(self.parts) + k for k, p in enumerate(self.parts)], axis=1)

    def probes(self, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, keys) of all probes."""
        m = len(self.parts)
        costs = np.zeros((len(bits), m, self.limit + 2))
        for k, part in enumerate(self.parts):
            coarse = self.values(bits, part, HISTOGRAM_BITS)
            for e in range(self.limit + 1):
                ball = sum(len(x) for x in self.masks[k][: e + 1])
                costs[:, k, e + 1] = ball + self.within[e, k, coarse] / 2.0 ** max(0, len(part) - HISTOGRAM_BITS)
        thresholds = allocate(costs, self.limit - m + 1)
        for k, part in enumerate(self.parts):
            own = self.values(bits, part)
            for e in range(self.limit + 1):
                rows = np.nonzero(thresholds[:, k] >= e)[0]
                keys = (own[rows, None] ^ self.masks[k][e][None, :]) * m + k
                yield np.repeat(rows, keys.shape[1]), keys.ravel()


def _histogram(parts: list[list[int]]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << HISTOGRAM_BITS
        total = np.zeros(size * len(parts), np.int64)
        for batch in batches:
            bits = _bits(batch)
            for k, part in enumerate(parts):
                total[k * size : (k + 1) * size] += np.bincount(Pigeonhole.values(bits, part, HISTOGRAM_BITS), minlength=size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return count


def _expand(shared, probing: bool):
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hole = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                values, bits = piece.column(0).to_numpy(zero_copy_only=False), _bits(piece)
                made = hole.probes(bits) if probing else [(np.arange(len(bits)), k) for k in hole.keys(bits).T]
                for rows, keys in made:
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], names=["key", "fp"])

    return expand


def close_pairs(prints: DataFrame, limit: int = 2, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) that connect just those distinct values of column fp that chains of at most limit bits connect.

    All pairs within the limit are there except that crowds, of values with over dense candidates, are linked in stars.
    Crowds need a limit of 2 at most. prints must not change between reads. No rows give no edges.
    """
    if not 0 <= limit <= 2:
        raise ValueError("limit must be 0, 1 or 2")
    spark = prints.sparkSession
    own = prints.select("fp")
    cells = {r.cell: r.n for r in own.mapInArrow(_correlated, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = cells.get(BITS * BITS, 0)
    both = np.array([cells.get(k, 0) for k in range(BITS * BITS)]).reshape(BITS, BITS)
    parts = bit_parts(both, n, 3 if n < WIDE else 2)
    counted = own.mapInArrow(_histogram(parts), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(parts) << HISTOGRAM_BITS, np.int64)
    counts[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    shared = spark.sparkContext.broadcast(Pigeonhole(parts, counts.reshape(len(parts), -1), limit))  # 1 MB for each part
    index = own.mapInArrow(_expand(shared, False), "key long, fp long")
    probes = own.mapInArrow(_expand(shared, True), "key long, fp long")
    held = index.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    # a bucket of one holds the probing value itself or a value that probes for its part; only its size is left out
    met = probes.join(held, "key").groupBy("fp").agg(F.sum("held").alias("met")).where(F.col("met") > dense)
    crowd = materialize(met.select("fp"), "crowd")
    sparse = probes.join(crowd, "fp", "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit
    pairs = sparse.withColumnRenamed("fp", "a").join(index.withColumnRenamed("fp", "b"), "key").where(F.col("a") != F.col("b")).where(near)
    verified = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    reach = [0, *(1 << b for b in range(BITS))] if limit == 2 else [0]
    if limit == 1:  # the value with each bit cleared: two values one bit apart share one
        shared_values = F.transform(F.array(*(F.lit(_signed(1 << b)) for b in range(BITS))), lambda bit: F.struct(F.col("fp").bitwiseAND(F.bitwise_not(bit)).alias("v"), bit.alias("b")))
    else:
        shared_values = F.transform(F.array(*(F.lit(_signed(b)) for b in reach)), lambda bit: F.struct(F.col("fp").bitwiseXOR(bit).alias("v"), F.lit(0).cast("long").alias("b")))
    grouped = crowd.select("fp", F.explode(shared_values).alias("at")).groupBy("at").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    stars = grouped.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    return verified.union(stars.distinct())


def simhash_components(docs: DataFrame, shingle_words: int = 3, limit: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of docs (doc_id, text).

    component_id: the smallest doc_id that links of at most limit differing bits reach. A null or empty text has no
    words and the fingerprint zero. A null doc_id is no component_id unless its component has no other. Repeated rows
    each give a row. No rows give no rows. Further columns are not read.
    """
    prints = materialize(fingerprints(docs, shingle_words), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = connected_components(close_pairs(distinct, limit))
    member = distinct.join(linked.withColumnRenamed("node", "fp"), "fp").select("fp", "least", "component")
    roots = member.groupBy("component").agg(F.min("least").alias("root"))
    moved = member.join(roots, "component").select("fp", "root")
    known = distinct.join(moved, "fp", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(known, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 3-word shingles, links at 2 or fewer differing bits."""
    return simhash_components(table(spark, sf_dir, "documents"))
