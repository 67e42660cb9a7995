"""Benchmark decontamination by spaced seeds.

A mask over a window of words looks at some places and ignores the others, so a window hashes alike after words at
ignored places were replaced. Hashes of benchmark items and of documents are joined; around each hit the item is laid
over the document without gaps, and a run of words that agrees well enough is an overlap. A bitmap of fixed size over
the items' hashes keeps most other windows of the documents out of the join, whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigrid.llm.fingerprints import _BYTE, _FOLD, _ODD, _mix
from lumigrid.session import Scratch, materialize, table

#: Places that each mask looks at; fixed values. Some mask fits every RUN words of which two differ.
MASKS = ((0, 1, 2, 4, 7, 9), (0, 1, 4, 6, 7, 9), (0, 2, 3, 7, 8, 9), (0, 1, 2, 3, 5, 6))
#: Further masks for items of SPAN to RUN - 1 words, which may differ in two words as well.
SHORT_MASKS = ((0, 1, 3, 4, 5, 7), (0, 2, 5, 6, 7, 8), (0, 1, 2, 3, 4, 8))
SPAN = 10
#: Items of fewer words must be equal in each. Items of SHORTEST to SPAN - 1 words may differ in one, so a half is equal.
SHORTEST = 5
#: Words of an overlap (all of a shorter item), and the share of them that agree.
RUN, AGREE = 13, 0.8
#: The bitmap has 2 ** BITMAP_BITS bits: 8 MB.
BITMAP_BITS = 26
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[:128] = [chr(c).isalnum() for c in range(128)]


def token_hashes(text: str | None) -> np.ndarray:
    """A hash for each run of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(np.concatenate(([False], _WORD_BYTE[raw], [False])).astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(starts):
        return np.empty(0, np.uint64)
    bounds = np.append(starts[1:], len(raw))
    within = np.arange(starts[0], len(raw)) - np.repeat(starts, bounds - starts)
    longest = int((ends - starts).max())
    powers = np.cumprod(np.full(longest + 1, _ODD), dtype=np.uint64)
    terms = _BYTE[_FOLD[raw[starts[0] :]]] * powers[np.minimum(within, longest)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return _mix(sums[ends - starts[0]] - sums[starts - starts[0]])


def seeds(tokens: np.ndarray, lengths: list[int], short: bool = False, masked: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of the windows under each mask, if any, short ones if asked, and of all runs of the given lengths."""
    masks = () if not masked else MASKS + SHORT_MASKS if short else MASKS
    forms = [(k, mask, mask[-1] + 1) for k, mask in enumerate(masks)] + [(100 + n, range(n), n) for n in lengths]
    for form, mask, span in forms:
        n = len(tokens) - span + 1
        if n > 0:
            total = np.full(n, np.uint64(form + 1), np.uint64)
            for at in mask:
                total = total * _ODD + tokens[at : at + n]
            yield _mix(total), np.arange(n)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - BITMAP_BITS)


_ITEM = pa.schema([("item_id", pa.int64()), ("tokens", pa.binary()), ("n", pa.int64()), ("runs", pa.list_(pa.int32())), ("hash", pa.list_(pa.int64()))])


def item_runs(n: int) -> list[tuple[int, int]]:
    """(place, words) of the runs that are looked up for an item of n words, fewer than SPAN: it as a whole, or its halves."""
    return [(0, n)] if n < SHORTEST else [(0, n // 2), (n // 2, n - n // 2)]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = token_hashes(text)
            n = len(tokens)
            if n >= SPAN:
                runs, made = [], [h for h, _ in seeds(tokens, [], n < RUN)]
            else:
                runs = item_runs(n) if n else []
                made = [h for at, k in runs for h, _ in seeds(tokens[at : at + k], [k], masked=False)]
            if n:
                out.append({"item_id": item_id, "tokens": tokens.tobytes(), "n": n, "runs": [k for _, k in runs], "hash": np.unique(np.concatenate(made)).view(np.int64).tolist()})
        yield pa.RecordBatch.from_pylist(out, schema=_ITEM)


def _regions(shared, lengths: list[int], margin: int, short: bool):
    """Stretches of documents around windows that the bitmap knows, margin words to either side."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            out = []
            for at, text in enumerate(batch.column(1)):
                tokens = token_hashes(text.as_py())
                hits = []
                for hashes, places in seeds(tokens, lengths, short):
                    cells = _cells(hashes)
                    known = (bitmap[cells >> np.uint64(6)] >> (cells & np.uint64(63))) & np.uint64(1) > 0
                    hits.append((hashes[known], places[known]))
                if not hits or not sum(len(h) for h, _ in hits):
                    continue
                hashes, places = (np.concatenate(x) for x in zip(*hits))
                order = np.argsort(places, kind="stable")
                hashes, places = hashes[order], places[order]
                for own in np.split(np.arange(len(places)), np.nonzero(np.diff(places) > margin)[0] + 1):
                    first = max(0, int(places[own[0]]) - margin)
                    out.append((at, first, tokens[first : int(places[own[-1]]) + SPAN + margin].tobytes(), np.unique(hashes[own]).view(np.int64)))
            rows, firsts, data, own = ([o[k] for o in out] for k in range(4))
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(firsts, pa.int64()), pa.array(data, pa.binary()), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "region", "tokens", "hash"])

    return find


def best_overlap(doc: np.ndarray, item: np.ndarray, run: int, agree: float) -> tuple[int, int, float] | None:
    """(first word, words, share that agrees) of the longest overlap of an item with a document, over all ways to lay it."""
    width = min(run, len(item))
    least = width if len(item) < SHORTEST else int(np.ceil(agree * width - 1e-9))
    agreed = np.zeros(len(doc) + len(item), np.int32)  # by shift + len(item)
    for k, word in enumerate(item):
        agreed[np.nonzero(doc == word)[0] - k + len(item)] += 1
    best = None
    for shift in (np.nonzero(agreed >= least)[0] - len(item)).tolist():
        first, end = max(0, shift), min(len(doc), shift + len(item))
        if end - first < width:
            continue
        same = doc[first:end] == item[first - shift : end - shift]
        sums = np.concatenate(([0], np.cumsum(same)))
        good = np.nonzero(sums[width:] - sums[:-width] >= least)[0]
        if len(good):
            covered = same[good[0] : good[-1] + width]
            found = (len(covered), float(covered.mean()), -(first + int(good[0])))
            best = found if best is None else max(best, found)
    return best and (-best[2], best[0], best[1])


def _verify(run: int, agree: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, (region, doc, item) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4))):
                best = best_overlap(np.frombuffer(doc.as_py(), np.uint64), np.frombuffer(item.as_py(), np.uint64), run, agree)
                if best:
                    found.append((k, region + best[0], best[1], best[2]))
            rows, first, words, share = ([f[k] for f in found] for k in range(4))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int64()), pa.array(words, pa.int64()), pa.array(share, pa.float64())],
                names=["doc_id", "item_id", "first_word", "overlap_words", "similarity"],
            )

    return verify


def _check(run: int, agree: float) -> None:
    """The masks meet every RUN words of which two differ; a longer run has such a part if its differences allow it."""
    differ = lambda n: n - int(np.ceil(agree * n - 1e-9))
    # items shorter than a run must agree as a whole
    if run < RUN or not 0 < agree <= 1 or any(differ(n) // (n // RUN) > 2 for n in range(RUN, run + 1)):
        raise ValueError(f"the masks are complete for runs of {RUN} words or more, of which no more than 2 in {RUN} differ")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, run: int = RUN, agree: float = AGREE) -> DataFrame:
    """(doc_id, item_id, first_word, overlap_words, similarity) for each document that overlaps an item, longest overlap first seen.

    docs: doc_id of any type, text; benchmark: item_id, text. At least run words in a row, of which the share agree are
    equal, count; all of an item with fewer words. Items of fewer than SHORTEST words must be equal in each word, and
    items without words match nothing. Null and empty texts overlap nothing. Rows of docs with one doc_id count as one
    document, null doc_id included; repeated items count once. Empty tables give no rows. Further columns are not read.
    """
    _check(run, agree)
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = materialize(benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct().mapInArrow(_items, "item_id long, tokens binary, n long, runs array<int>, hash array<long>"), "items")
    sized = items.agg(F.max("n").alias("most"), F.collect_set(F.when(F.col("n") < SPAN, F.col("runs"))).alias("runs"), F.max(F.col("n").between(SPAN, RUN - 1)).alias("masked")).first()
    margin, lengths = sized["most"] or 0, sorted({k for runs in sized["runs"] for k in runs})
    seeded = items.select("item_id", F.explode("hash").alias("hash")).distinct()
    cell = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    bits = seeded.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    shared, kind = spark.sparkContext.broadcast(bitmap), docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").where("text is not null").mapInArrow(_regions(shared, lengths, margin, bool(sized["masked"])), f"doc_id {kind}, region long, tokens binary, hash array<long>")
    regions = scratch.table(found.withColumn("key", F.monotonically_increasing_id()), "regions")
    shared.destroy()
    # a window counts once for a stretch and once for an item, however often it occurs in them
    both = regions.select("key", F.explode("hash").alias("hash")).join(seeded, "hash").select("key", "item_id").distinct()
    laid = both.join(regions.select("key", "doc_id", "region", F.col("tokens").alias("doc")), "key").join(items.select("item_id", F.col("tokens").alias("item")), "item_id")
    seen = laid.select("doc_id", "item_id", "region", "doc", "item").mapInArrow(_verify(run, agree), f"doc_id {kind}, item_id long, first_word long, overlap_words long, similarity double")
    best = F.max_by(F.struct("first_word", "overlap_words", "similarity"), F.struct("overlap_words", "similarity", -F.col("first_word"))).alias("best")
    result = materialize(seen.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.first_word", "best.overlap_words", "best.similarity"), "overlaps")
    scratch.clear()
    return result


def drop_overlapping(docs: DataFrame, benchmark: DataFrame, run: int = RUN, agree: float = AGREE) -> DataFrame:
    """The rows of docs (text, more columns) whose text overlaps no item; each row is judged by its own text."""
    digest = F.md5(F.encode("text", "utf-8"))
    bad = find_overlaps(docs.select(digest.alias("doc_id"), "text"), benchmark, run, agree).select(F.col("doc_id").alias("digest")).distinct()
    # whole rows in one column, so that no name can clash
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest.alias("row_digest"))
    return whole.join(bad, whole["row_digest"] == bad["digest"], "left_anti").select("row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items; one row per document and item that overlap."""
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
