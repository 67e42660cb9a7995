"""Near-duplicate groups: SimHash links, then an exact join of shingle sets by prefixes for what lies beyond them.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles reaches the limit. Candidates come
from three searches, and every candidate is verified on the whole sets:

1. texts whose SimHash fingerprints the generalised pigeonhole search of operator 2 links;
2. texts of a shared prefix shingle with the most central of them, which joins a large group of near copies in as many
   pairs as texts;
3. all pairs of a prefix shingle's texts that no chain of links joins yet.

Most candidates of the last search are not similar, and their number grows faster than the texts. So before any set is
moved, candidates are tried on sketches, which count a set's shingles by ranges of their hashes: what two sets share is
at most the sum of the lesser counts. Only pairs that this bound allows are verified.

Shingles have one fixed order, frequent ones last. Two sets of similarity t or more share one of the first
n - ceil(t n) + 1 shingles of either, so the last two searches lose no pair. The first shingle that two sets share
bounds what they can share in all, by its places in both, so most other pairs are never verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumigrid.llm.fingerprints import shingle_set
from lumigrid.llm.simhash import close_pairs, fingerprints
from lumigrid.plans.components import connected_components
from lumigrid.session import Scratch, materialize, settings

SIMILARITY, SHINGLE_WORDS, BITS = 0.8, 5, 2
#: Frequent shingles that are kept: 1 MB.
FREQUENT = 1 << 17
#: A shingle is frequent if so many texts of a task hold it; shingles that a task counts before rare ones are let go.
HELD, COUNTED = 3, 1 << 21
#: Texts of a prefix shingle from which on it goes last too, and how often the prefixes are made anew for such ones.
CROWDED, ROUNDS = 1000, 4
#: Rows that a task takes from Spark at once: texts and sets of shingles are large, and several tasks share a machine.
BATCH = 512
#: Texts of candidate pairs up to which their names are broadcast, so that no other text is moved.
NAMED = 500_000
#: A sketch counts so many shingles in a range of hashes at most, on average, and half as many at least.
RANGED = 4
#: Shuffle files of a step go when it has ended, not when the driver happens to collect its garbage.
CLEANED = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
#: Texts of a shingle that meet in one block of a join; results do not depend on it.
BLOCK = 2000


def text_digest() -> Column:
    return F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) for shingles that several of a task's distinct texts hold; where too many are held, rare ones go."""
    seen: set[str] = set()
    keys, n, waiting, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        """keys and n with what waits; only that is sorted."""
        own, times = np.unique(np.concatenate((np.empty(0, np.uint64), *waiting)), return_counts=True)
        at = np.searchsorted(keys, own)
        known = at < len(keys)
        known[known] = keys[at[known]] == own[known]
        n[at[known]] += times[known]
        at, known = at[~known], ~known
        return np.insert(keys, at, own[known]), np.insert(n, at, times[known])

    for batch in batches:
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if digest not in seen:
                seen.add(digest)
                waiting.append(shingle_set(text.as_py(), SHINGLE_WORDS))
                size += len(waiting[-1])
                if size > COUNTED:
                    keys, n = merged()
                    if len(keys) > COUNTED:
                        keys, n = keys[n > 1], n[n > 1] - 1
                    waiting, size = [], 0
    keys, n = merged()
    often = n >= HELD
    yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(n[often])], names=["key", "n"])


def frequent_shingles(keyed: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles of keyed (digest, text) that most texts hold, over all texts.

    They only go last in the order of shingles, so results do not depend on them. Shingles that no single task holds
    often are not met here; _shared_prefixes adds those that crowd the prefixes.
    """
    counts = keyed.select("digest", "text").mapInArrow(_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()["key"].to_numpy().view(np.uint64))


def _sketch(own: np.ndarray) -> bytes:
    """Counts of own's hashes in 2 ** k equal ranges, a byte each; nothing where there are no hashes or a count is too large."""
    bits = max(0, (-(-len(own) // RANGED) - 1).bit_length())
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(own)])
    return counts.astype(np.uint8).tobytes() if len(own) and counts.max() < 256 else b""


def _most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """At most so many shingles are in both sets of sketches x and y; the finer one is summed to the ranges of the other."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())


def _prefixes(shared, limit: float):
    """Of each text the size of its set, its sketch and the first shingles in the fixed order; [0] for a text without words."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            made, sizes, sketches = [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), SHINGLE_WORDS)
                late = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own if len(frequent) else np.zeros(len(own), bool)
                first = len(own) - int(np.ceil(limit * len(own) - 1e-9)) + 1
                made.append(np.concatenate((own[~late], own[late]))[:first].view(np.int64) if len(own) else np.zeros(1, np.int64))
                sizes.append(len(own))
                sketches.append(_sketch(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(made, pa.list_(pa.int64()))], names=["digest", "n", "sketch", "keys"])

    return prefixes


def _shared_prefixes(texts: DataFrame, keyed: DataFrame, limit: float, scratch: Scratch) -> DataFrame:
    """(key, id, n, p, held) of prefix shingles that held > 1 texts share, written; key is at place p of n shingles."""
    return _prefixes_and_sketches(texts, keyed, limit, scratch)[0]


def _prefixes_and_sketches(texts: DataFrame, keyed: DataFrame, limit: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What _shared_prefixes gives, and (id, sketch) of all texts, written.

    The number of texts of each prefix shingle is exact and over all tasks. Where one has too many and does not yet go
    last, it does from then on, and prefixes are made anew. What is still crowded after some rounds is joined in blocks.
    """
    spark = keyed.sparkSession
    frequent = frequent_shingles(keyed)
    for left in reversed(range(ROUNDS)):
        own = Scratch(spark)
        shared = spark.sparkContext.broadcast(frequent)
        made = keyed.select("digest", "text").mapInArrow(_prefixes(shared, limit), "digest string, n int, sketch binary, keys array<long>").dropDuplicates(["digest"])
        made = own.table(made.join(texts, "digest").select("id", "n", "sketch", "keys"), "prefixes")
        shared.destroy()
        rows = made.select("id", "n", F.posexplode("keys").alias("p", "key"))
        held = made.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
        found = Scratch(spark)
        rows = found.table(rows.join(held, "key"), "shared")
        crowded = rows.where(F.col("held") >= CROWDED).groupBy("key").agg(F.max("held").alias("held"))
        keys = crowded.orderBy(F.desc("held"), "key").limit(FREQUENT).toArrow()["key"].to_numpy().view(np.uint64)
        added = np.setdiff1d(keys, frequent)[: 2 * FREQUENT - len(frequent)]
        if not left or not len(added):
            sketches = scratch.table(made.select("id", "sketch"), "sketches")
            own.clear()
            scratch.paths += found.paths
            return rows, sketches
        own.clear()
        found.clear()
        frequent = np.union1d(frequent, added)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [shingle_set(t.as_py(), SHINGLE_WORDS).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "set"])


def _similar(limit: float):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= limit * max(len(a), len(b)) - 1e-9 else 0
                kept.append(both >= limit * (len(a) + len(b) - both) - 1e-9 if len(a) + len(b) else True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return similar


def _allowed(limit: float):
    """Pairs whose sketches do not exclude the limit; empty ones exclude nothing."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint8).astype(np.int64) for v in (x, y))
                n, m = int(x.sum()), int(y.sum())
                kept.append(not (n and m) or min(n, m) >= limit * max(n, m) - 1e-9 and _most_shared(x, y) >= limit / (1 + limit) * (n + m) - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return allowed


def _possible(limit: float) -> Column:
    """Sets of n and m shingles that meet at places p and q of the order can reach the limit, if they meet there first."""
    least = F.lit(limit / (1 + limit)) * (F.col("n") + F.col("m")) - 1e-6
    return (F.lit(1) + F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) - 1 >= least) & (F.least("n", "m") >= limit * F.greatest("n", "m") - 1e-6)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _simhash_pairs(texts: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Operator 2 over five-word shingles: texts with the least of their fingerprint, and those of linked fingerprints."""
    prints = fingerprints(docs.select(F.col("digest").alias("doc_id"), "text"), SHINGLE_WORDS).dropDuplicates(["doc_id"])
    prints = scratch.table(prints.join(texts, F.col("doc_id") == F.col("digest")).select("id", "fp"), "prints")
    heads = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    near = close_pairs(heads, BITS)
    left, right = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    across = near.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return prints.join(heads, "fp").select(F.col("id").alias("a"), F.col("head").alias("b")).where("a <> b").union(across)


def _central_pairs(rows: DataFrame, limit: float) -> DataFrame:
    """Each text of a key with the one whose keys have most texts, from rows (key, id, n, p, held)."""
    score = rows.groupBy("id").agg(F.sum("held").alias("score"))
    heads = rows.join(score, "id").groupBy("key").agg(F.max_by(F.struct("id", "n", "p"), F.struct("score", "id")).alias("head"))
    both = rows.join(heads, "key").select(F.col("id").alias("a"), "n", "p", F.col("head.id").alias("b"), F.col("head.n").alias("m"), F.col("head.p").alias("q"))
    return both.where("a <> b").where(_possible(limit)).select("a", "b")


def _open_pairs(rows: DataFrame, linked: DataFrame, limit: float, scratch: Scratch) -> DataFrame:
    """All pairs that share a key and that no chain of links joins yet; linked: (node, component)."""
    placed = rows.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    # the texts of a key lie in blocks, each of which meets all texts of the key in tasks of its own
    placed = scratch.table(placed.join(several, "key").withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")), "open")
    left = placed.select("key", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("id").alias("a"), "n", "p", F.col("component").alias("ca"))
    right = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("component").alias("cb"))
    return left.join(right, ["key", "block"]).where("ca < cb").where(_possible(limit)).select("a", "b")


def _ends(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """(a, b, x, y): the pairs with column name of values (id, name) for either end."""
    left, right = values.select(F.col("id").alias("a"), F.col(name).alias("x")), values.select(F.col("id").alias("b"), F.col(name).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, docs: DataFrame, limit: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of ids whose sets reach the limit, written."""
    own = Scratch(docs.sparkSession)
    pairs = own.table(_ends(_ordered(pairs).distinct(), sketches, "sketch").mapInArrow(_allowed(limit), "a long, b long"), "pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    named = own.table(ends.join(texts, "id").select("id", "digest"), "named")
    # one row of docs for each text; each task keeps one of its equal texts before any is moved
    if named.count() <= NAMED:
        one = docs.select("digest", "text").join(F.broadcast(named), "digest").dropDuplicates(["digest"]).select("id", "text")
    else:
        one = docs.select("digest", "text").dropDuplicates(["digest"]).join(named, "digest").select("id", "text")
    sets = own.table(one.mapInArrow(_sets, "id long, set binary"), "sets")
    found = scratch.table(_ends(pairs, sets, "set").mapInArrow(_similar(limit), "a long, b long"), "links")
    own.clear()
    return found


def near_duplicate_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(digest, least, component) of the distinct texts of docs (doc_id, text): the least doc_id and the group's number.

    Groups: chains of texts that are similar. Texts without words, null ones included, are one group.
    """
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH), **CLEANED):
        return _groups(docs, similarity)


def _groups(docs: DataFrame, similarity: float) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keyed = docs.select("doc_id", "text", text_digest().alias("digest"))
    texts = materialize(keyed.groupBy("digest").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "texts")
    rows, sketches = _prefixes_and_sketches(texts, keyed, similarity, scratch)
    near = _central_pairs(rows, similarity).union(_simhash_pairs(texts.select("digest", "id"), keyed, scratch))
    links = _verified(near, texts, sketches, keyed, similarity, scratch)
    rest = _verified(_open_pairs(rows, connected_components(links), similarity, scratch), texts, sketches, keyed, similarity, scratch)
    linked = materialize(connected_components(links.union(rest)), "linked")
    scratch.clear()
    joined = texts.join(linked.withColumnRenamed("node", "id"), "id", "left")
    return joined.select("digest", "least", F.coalesce("component", "id").alias("component"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text, more columns) without all but one document of each group: that with the smallest doc_id.

    Groups: equal texts, and chains of texts whose sets of five-word shingles (of all words where they are fewer) have
    a Jaccard similarity of at least similarity. Texts without words, null ones included, are one group. A null doc_id
    goes before a document with one only if its group has none. Rows that repeat doc_id and text leave one. No rows
    give no rows. Further columns go through as they are, whatever their names.
    """
    groups = near_duplicate_groups(docs, similarity)
    kept = groups.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "digest")).alias("one"))
    kept = kept.select("one.least", "one.digest")
    # one column names a row's id, null or not, and its text, so that rows move once for both steps; digests are of one length
    name = lambda digest, least: F.concat(digest, F.coalesce(F.concat(F.lit("="), F.col(least).cast("string")), F.lit(""))).alias("name")
    # whole rows in one column, so that no name can clash
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), name(text_digest(), "doc_id"))
    return whole.join(kept.select(name(F.col("digest"), "least")), "name", "left_semi").dropDuplicates(["name"]).select("row.*")
