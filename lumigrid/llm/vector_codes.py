"""Vector compression by product codes, learned on distinct values.

Vectors are rounded down to integers and cut into parts. Equal integer parts of a position become one row with a weight;
Lloyd's iterations run over these rows, and codes and errors are joined back to the vectors by the parts' values. The
codebooks, a bounded number of integers, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigrid.session import Scratch, materialize, table

DIMS = 64
PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integers lie within this, so that squared distances of 64 components fit into a long.
_MOST = 1 << 27
#: A value in more than one of so many rows is joined by broadcast; there are at most so many of a position.
_HOT = 1024
#: Groups of labels up to which their sums are broadcast.
_LABELS = 100_000


def integer_vectors(rows: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows whose embedding has dims components, all finite; v is floor(scale * x).

    Components beyond 2**27 after scaling are held at that bound.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), c.cast("double") * scale))))).cast("int"))
    return rows.select("vec_id", "label", "embedding").where(x.isNotNull() & (F.size(x) == dims) & finite).select("vec_id", "label", whole.alias("v"))


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors of smallest vec_id; fewer entries where there are fewer vectors."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    v = np.array([r["v"] for r in first], np.int64)
    return v.reshape(len(v), parts, -1).transpose(1, 0, 2) if len(v) else np.empty((parts, 0, 0), np.int64)


def nearest(values: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each value; of equal distances the lower index."""
    codes, errors = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    for at in range(0, len(values), 2048):
        some = values[at : at + 2048]
        distance = ((some[:, None] - codebook[None]) ** 2).sum(2)
        codes[at : at + 2048] = distance.argmin(1)
        errors[at : at + 2048] = distance.min(1)
    return codes, errors


def _values(batch: pa.RecordBatch, name: str = "value") -> np.ndarray:
    """A list column whose rows are equally long, as a matrix."""
    lists = batch.column(batch.schema.names.index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(position, its rows) of a batch with column part."""
    part = batch.column(batch.schema.names.index("part")).to_numpy()
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
        if len(own):
            yield int(part[own[0]]), own


def distinct_parts(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(part, value, weight): each distinct value of each position and the number of vectors that have it."""
    return _long(vectors, parts).groupBy("part", "value").agg(F.count("*").alias("weight"))


def _long(vectors: DataFrame, parts: int, *keys: str) -> DataFrame:
    width = (F.size("v") / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("v", k * width + 1, width))
    return vectors.select(*keys, F.posexplode(cut).alias("part", "value"))


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over weighted distinct values: floors of the means of what each entry is nearest to.

    Tasks hand on a sum and a weight for each entry; the driver gets one row for each entry.
    """
    width = books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            values, weights = _values(batch), batch.column(batch.schema.names.index("weight")).to_numpy()
            for k, own in _by_position(batch):
                code, _ = nearest(values[own], books[k])
                np.add.at(total[k], code, values[own] * weights[own, None])
                np.add.at(weight[k], code, weights[own])
        k, e = np.nonzero(weight)
        own = total[k, e]
        columns = [pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(weight[k, e], pa.int64()), *(pa.array(own[:, j], pa.int64()) for j in range(width))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "weight", *(f"s{j}" for j in range(width))])

    names = [f"s{j}" for j in range(width)]
    partial = distinct.mapInArrow(sums, "part int, entry int, weight long, " + ", ".join(f"{n} long" for n in names))
    summed = partial.groupBy("part", "entry").agg(F.sum("weight").alias("weight"), *(F.sum(n).alias(n) for n in names))
    out = books.copy()
    for r in summed.collect():  # at most parts * entries rows
        out[r["part"], r["entry"]] = [r[n] // r["weight"] for n in names]
    return out


def assign(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, value, weight, code, err) of each distinct value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(batch)
            codes, errors = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
            for k, own in _by_position(batch):
                codes[own], errors[own] = nearest(values[own], books[k])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("part", "value", "weight")), pa.array(codes.astype(np.int32)), pa.array(errors)], names=["part", "value", "weight", "code", "err"])

    return distinct.select("part", "value", "weight").mapInArrow(run, "part int, value array<int>, weight long, code int, err long")


def train(distinct: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after rounds of lloyd_round; an entry that no value is nearest to stays."""
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    return books


def _joined_back(vectors: DataFrame, coded: DataFrame, total: int, parts: int) -> DataFrame:
    """(row, code, error): codes of the parts of each vector (row, v) in order, as hex, and their errors' sum.

    Values that many vectors share come by broadcast, at most _HOT of each position; only the other parts are moved to
    meet their codes.
    """
    often = F.col("weight") > total / _HOT
    long = _long(vectors, parts, "row")
    hot = coded.where(often).select("part", "value", F.struct("code", "err").alias("hot"))
    marked = long.join(F.broadcast(hot), ["part", "value"], "left")
    rare = coded.where(~often).select("part", "value", F.struct("code", "err").alias("cold"))
    met = marked.where("hot is not null").select("row", "part", F.col("hot").alias("c"))
    cold = marked.where("hot is null").select("row", "part", "value").join(rare, ["part", "value"]).select("row", "part", F.col("cold").alias("c"))
    whole = met.unionByName(cold).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "c"))).alias("own"))
    codes = F.array_join(F.transform("own", lambda p: F.lower(F.lpad(F.hex(p["c"]["code"]), 2, "0"))), "")
    return whole.select("row", codes.alias("code"), F.aggregate("own", F.lit(0).cast("long"), lambda s, p: s + p["c"]["err"]).alias("error"))


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, dims: int = DIMS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each kept row of rows (vec_id, embedding, label), and the codebooks.

    Rows go whose embedding is null, has not dims components, or holds a null or a number that is not finite. Repeated
    rows and repeated ids are each coded; a null vec_id comes last among the first entries; a null label is a label;
    equal entries of a codebook give the lower index. No rows give no rows. Further columns are not read.
    """
    if dims % parts or not 0 < entries <= 256:
        raise ValueError("dims must be a multiple of parts, and entries within 1 to 256")
    scratch = Scratch(rows.sparkSession)
    # the row number is stored, so it stays if a task runs again
    vectors = scratch.table(integer_vectors(rows, dims).withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = vectors.count()
    if not total:
        return materialize(vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), "codes"), np.empty((parts, 0, dims // parts), np.int64)
    distinct = scratch.table(distinct_parts(vectors, parts), "distinct-parts")
    books = train(distinct, first_codebooks(vectors, parts, entries), rounds)
    coded = scratch.table(assign(distinct, books), "coded-parts")
    joined = vectors.select("row", "vec_id", "label").join(_joined_back(vectors, coded, total, parts), "row")
    out = materialize(joined.select("vec_id", "label", "code", "error"), "codes")
    scratch.clear()
    return out, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over rows of its label; nulls are one label."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    few = sums.limit(_LABELS + 1).count() <= _LABELS
    return coded.join(F.broadcast(sums) if few else sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")


def reconstruct(code: str, books: np.ndarray) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([books[k, int(code[2 * k : 2 * k + 2], 16)] for k in range(len(books))])


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of 16 parts, two rounds, with errors and the codebooks' digest."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _assigned(k: int) -> str:
    """Nearest entries of book k, for each distinct value."""
    return f"""near{k} as (
  select v.part, v.value, v.weight, min({{'d': list_sum(list_transform(list_zip(v.value, b.value), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.entry}}) as best
  from distincts v join book{k} b using (part) group by all
)"""


def _renewed(k: int) -> str:
    return f"""mean{k} as (
  select part, best.e as entry, {", ".join(f"cast(floor(sum(weight * value[{j + 1}]) / sum(weight)) as bigint) as m{j}" for j in range(DIMS // PARTS))} from near{k} group by all
), book{k + 1} as (
  select b.part, b.entry, case when m.part is null then b.value else [{", ".join(f"m.m{j}" for j in range(DIMS // PARTS))}] end as value
  from book{k} b left join mean{k} m on b.part = m.part and b.entry = m.entry
)"""


ORACLE_SQL = f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v, row_number() over (order by vec_id, embedding) - 1 as row
  from embeddings where embedding is not null and len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), long as materialized (
  select row, vec_id, label, part, v[part * {DIMS // PARTS} + 1 : part * {DIMS // PARTS} + {DIMS // PARTS}] as value from kept, (select unnest(range({PARTS})) as part)
), distincts as materialized (
  select part, value, count(*) as weight from long group by all
), book0 as (
  select part, row as entry, value from long where row < {ENTRIES}
), {_assigned(0)}, {_renewed(0)}, {_assigned(1)}, {_renewed(1)}, {_assigned(2)},
coded as (
  select l.row, any_value(l.vec_id) as vec_id, any_value(l.label) as label, string_agg(printf('%02x', n.best.e), '' order by l.part) as code, cast(sum(n.best.d) as bigint) as error
  from long l join near2 n on l.part = n.part and l.value = n.value group by l.row
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(value, ','), ',' order by part, entry)) from book2) as codebooks_sha256
from coded
"""
