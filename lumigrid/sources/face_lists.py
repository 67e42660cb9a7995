"""Face lists whose lines mean what the lines before say, parsed in parallel.

A text is cut into pieces of lines. What a line means depends on the state that the lines before leave: a path is
expected, a count, the placeholder of an empty entry, or so many faces. Each piece is first read from every such state at
once, which gives a table of states it ends in. These tables are composed, piece after piece and group after group, so
that the state at the start of every piece is known; then each piece is read once more and gives its faces. The text
itself stays where it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumigrid.session import Scratch, materialize

#: Numbers of a face line, in order.
FACE_FIELDS = ("x", "y", "w", "h", "blur", "expression", "illumination", "occlusion", "pose", "invalid")
#: Bytes of text in a piece.
PIECE = 4 << 20
#: Pieces whose tables one task composes.
GROUP = 64
#: Numbers of all groups' tables up to which they are taken to the driver at once; else one by one.
_TABLES = 1 << 24
#: States: faces that are left, 0 for none, so a path follows; or a count follows; or a placeholder.
COUNT, PLACEHOLDER = -1, -2
_NUMBER = re.compile(r"[+-]?[0-9]{1,9}")
#: In place of the count of a line that is no number.
NONE = -1
#: The same for Arrow: lines that are a number, and face lines of just ten numbers between spaces and tabs.
_COUNT_LINE = r"\A[ \t\n\x0b\x0c\r]*[+-]?[0-9]{1,9}[ \t\n\x0b\x0c\r]*\z"
_FACE_LINE = r"\A[ \t]*" + r"[ \t]+".join([r"[+-]?[0-9]{1,9}"] * len(FACE_FIELDS)) + r"[ \t]*\z"
_KEY = ["file", "start", "part"]


def number(text: str) -> int | None:
    """A number of up to nine digits with white space around, or None."""
    return int(t) if _NUMBER.fullmatch(t := text.strip(" \t\n\v\f\r")) else None


def lines_of(text: str) -> list[str]:
    """Lines that end with a line feed, a carriage return or both."""
    lines = re.split(r"\r\n|\n|\r", text)
    return lines[:-1] if not lines[-1] else lines


def ends(counts: Sequence[int | None]) -> tuple[np.ndarray, int, int]:
    """For the numbers of a piece's lines: the states it ends in when its line k is a path, a count or placeholder comes first.

    Each line names the one that is a path next if it is one; these steps are doubled until all lead out of the piece.
    """
    n = len(counts)
    if not n:
        return np.zeros(0, np.int64), COUNT, PLACEHOLDER
    own = counts if isinstance(counts, np.ndarray) else np.array([NONE if c is None else c for c in counts], np.int64)
    # where a path follows if line k is a count; from n on it is beyond the piece, below 0 a state at its end
    after = np.arange(1, n + 1) + np.where(own == 0, 1, np.maximum(own, 0))
    if own[-1] == 0:
        after[-1] = PLACEHOLDER
    to = np.append(after[1:], COUNT)
    while (inside := np.flatnonzero((to >= 0) & (to < n))).size:
        to[inside] = to[to[inside]]
    out = np.where(to >= n, to - n, to)
    at = lambda k: int(k) if k < 0 else int(out[k]) if k < n else int(k) - n
    return out, at(after[0]), at(1)


def step(states: np.ndarray, size: int, table: np.ndarray, count: int, placeholder: int) -> np.ndarray:
    """The states after a piece of size lines, from many states before it; table has the ends from its first lines on."""
    inside = (states >= 0) & (states < size)
    out = np.where(states >= size, states - size, states)
    out[inside] = table[states[inside]]
    out[states == COUNT] = count
    out[states == PLACEHOLDER] = placeholder
    return out


def faces(lines: Sequence[str], state: int, path: str | None) -> tuple[list[tuple], int, str | None]:
    """((path, numbers) of the face lines, the state at the end, the path then) from a state and path at the start."""
    out = []
    for line in lines:
        if state > 0:
            state -= 1
            values = [number(x) for x in line.split()[:10]]
            if len(values) == 10 and None not in values:
                out.append((path, *values))
        elif state == PLACEHOLDER:
            state = 0
        elif state == COUNT:
            n = number(line)
            state = PLACEHOLDER if n == 0 else max(0, n or 0)
        else:
            path, state = line.strip(), COUNT
    return out, state, path


def line_numbers(lines: pa.Array) -> np.ndarray:
    """number of each line, NONE where it is none."""
    out = np.full(len(lines), NONE, np.int64)
    at = np.flatnonzero(pc.fill_null(pc.match_substring_regex(lines, _COUNT_LINE), False).to_numpy(zero_copy_only=False))
    out[at] = [number(x) for x in lines.take(pa.array(at)).to_pylist()]
    return out


def face_rows(lines: pa.Array, state: int) -> tuple[pa.Array, pa.Array, list[pa.Array], str | None]:
    """As faces gives for many lines at once: (numbers of the face lines' paths, paths, columns of FACE_FIELDS, the last path).

    Paths and counts are followed from entry to entry; the face lines between are read together. Path 0 is that from
    before, None here. Lines that are not plainly ten numbers are read as faces does.
    """
    n, counts, paths = len(lines), line_numbers(lines), [None]
    spans, k = [], 0  # first face line, one after the last, path
    if state == COUNT and n:
        state, k = (PLACEHOLDER if counts[0] == 0 else max(0, int(counts[0]))), 1
    if state == PLACEHOLDER and k < n:
        state, k = 0, k + 1
    while k < n:
        if state > 0:
            spans.append((k, min(n, k + state), len(paths) - 1))
            k += state
        if k < n:
            paths.append(lines[k].as_py().strip())
            count = int(counts[k + 1]) if k + 1 < n else NONE
            k, state = k + 2 + (count == 0), max(0, count)
    at = np.concatenate([np.arange(a, b) for a, b, _ in spans]) if spans else np.zeros(0, np.int64)
    of = np.repeat([p for *_, p in spans], [b - a for a, b, _ in spans]).astype(np.int64) if spans else np.zeros(0, np.int64)
    text = lines.take(pa.array(at, pa.int64()))
    plain = pc.fill_null(pc.match_substring_regex(text, _FACE_LINE), False).to_numpy(zero_copy_only=False)
    values = np.zeros((len(at), len(FACE_FIELDS)), np.int32)
    values[plain] = np.fromstring(" ".join(text.filter(pa.array(plain)).to_pylist()), np.int32, sep=" ").reshape(-1, len(FACE_FIELDS))
    kept = plain.copy()
    for j in np.flatnonzero(~plain):
        if got := faces([text[int(j)].as_py()], 1, None)[0]:
            kept[j], values[j] = True, got[0][1:]
    return pa.array(of[kept]), pa.array(paths, pa.string()), [pa.array(c) for c in values[kept].T], paths[-1]


def _pack(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, used = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            columns = [pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([part], pa.int32()), pa.array([held], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=[*_KEY, "lines"])

        for batch in batches:
            for file, start, line in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, start) != now or used >= size:
                    if held:
                        yield piece()
                    part, now = (part + 1 if (file, start) == now else 0), (file, start)
                    held, used = [], 0
                held.append(line)
                used += len(line) + 1
        if held:
            yield piece()

    return pack


def read_pieces(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """Text files as stored pieces (file, start, part, lines): start is the byte where Spark's split of the file begins."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), "value")
    return materialize(lines.mapInArrow(_pack(size), "file string, start long, part int, lines array<string>"), "pieces")


def _tables(most: int):
    """Tables of a piece; a state of more faces than any count in the text cannot occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lines = batch.column(3)[k].values
                table, count, placeholder = ends(line_numbers(lines))
                columns = [*(batch.column(n).slice(k, 1) for n in range(3)), pa.array([len(lines)], pa.int64()), pa.array([count], pa.int64()), pa.array([placeholder], pa.int64()), pa.array([table[: most + 1]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*_KEY, "size", "count", "placeholder", "table"])

    return run


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest number of a batch's lines."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(line_numbers(batch.column(0).flatten()).max(initial=0))], pa.int64())], names=["n"])


def _compose(pieces: pd.DataFrame, most: int) -> tuple[int, int, int, np.ndarray]:
    """The table of a group of pieces, as that of one piece."""
    pieces = pieces.sort_values("at")
    total = int(pieces["size"].sum())
    states = np.concatenate(([COUNT, PLACEHOLDER], np.arange(min(total, most + 1))))
    for size, count, placeholder, table in zip(pieces["size"], pieces["count"], pieces["placeholder"], pieces["table"]):
        states = step(states, size, np.asarray(table), count, placeholder)
    return total, int(states[0]), int(states[1]), states[2:]


def parse_pieces(pieces: DataFrame, group: int = GROUP) -> DataFrame:
    """One row (file, img_rel_path, and FACE_FIELDS) for each face line of pieces (file, start, part, lines).

    The pieces of a file follow each other by start and part, whole lines each. An entry is a path line, a count line and
    as many face lines; a count of 0 has one placeholder line; a count that is no number is passed over with its path; a
    face line with fewer than ten numbers, or other text among them, is left out. Further columns are not read.
    """
    spark, scratch = pieces.sparkSession, Scratch(pieces.sparkSession)
    most = pieces.select("lines").mapInArrow(_largest, "n long").agg(F.max("n")).first()[0] or 0
    tables = scratch.table(pieces.select(*_KEY, "lines").mapInArrow(_tables(most), "file string, start long, part int, size long, count long, placeholder long, table array<long>"), "piece-tables")
    order = F.row_number().over(Window.partitionBy("file").orderBy("start", "part")) - 1
    numbers = tables.select(*_KEY).withColumn("at", order).withColumn("group", F.floor(F.col("at") / group).cast("int"))
    placed = scratch.table(tables.join(numbers, _KEY), "placed-tables")

    def compose(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        total, count, placeholder, table = _compose(own, most)
        return pd.DataFrame({"file": [key[0]], "group": [key[1]], "size": [total], "count": [count], "placeholder": [placeholder], "table": [table]})

    grouped = scratch.table(placed.groupBy("file", "group").applyInPandas(compose, "file string, group int, size long, count long, placeholder long, table array<long>"), "group-tables")
    starts = spark.createDataFrame(list(_walk(grouped)), "file string, group int, state long")

    def unroll(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own, state, out = own.sort_values("at"), np.array([own["state"].iloc[0]]), []
        for size, count, placeholder, table in zip(own["size"], own["count"], own["placeholder"], own["table"]):
            out.append(int(state[0]))
            state = step(state, size, np.asarray(table), count, placeholder)
        return own[_KEY].assign(state=out)

    states = scratch.table(placed.join(starts, ["file", "group"]).groupBy("file", "group").applyInPandas(unroll, "file string, start long, part int, state long"), "piece-states")
    kinds = ", ".join(f"{f} int" for f in FACE_FIELDS)
    found = scratch.table(pieces.select(*_KEY, "lines").join(states, _KEY).select(*_KEY, "lines", "state").mapInArrow(_emit, f"file string, start long, part int, last boolean, img_rel_path string, {kinds}"), "faces")
    # a piece that begins within an entry has its path from a piece before
    before = F.last("img_rel_path", ignorenulls=True).over(Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1))
    paths = found.where("last").select(*_KEY, before.alias("_path"))
    own = found.where("not last")
    whole = own.where("img_rel_path is not null").select("file", "img_rel_path", *FACE_FIELDS)
    carried = own.where("img_rel_path is null").join(paths, _KEY).select("file", F.col("_path").alias("img_rel_path"), *FACE_FIELDS)
    out = materialize(whole.unionByName(carried), "face-lists")
    scratch.clear()
    return out


def _walk(grouped: DataFrame) -> Iterator[tuple[str, int, int]]:
    """(file, group, state at its start); tables come to the driver together if they are small, else one number at a time."""
    sizes = grouped.select("file", "group", "size").orderBy("file", "group").collect()
    together = (grouped.agg(F.sum(F.size("table"))).first()[0] or 0) <= _TABLES
    held = {(r["file"], r["group"]): r for r in grouped.collect()} if together else {}
    file, state = None, 0
    for f, g, size in sizes:
        file, state = f, (state if f == file else 0)
        yield f, g, state
        if state >= size:
            state -= size
            continue
        row = held.get((f, g)) or grouped.where((F.col("file") == f) & (F.col("group") == g)).select("count", "placeholder", F.slice("table", max(state, 0) + 1, 1).alias("table")).first()
        state = row["count"] if state == COUNT else row["placeholder"] if state == PLACEHOLDER else row["table"][state if together else 0]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), *[pa.int32()] * len(FACE_FIELDS)]
    names = [*_KEY, "last", "img_rel_path", *FACE_FIELDS]
    for batch in batches:
        for k, (file, start, part, state) in enumerate(zip(*(batch.column(n).to_pylist() for n in (0, 1, 2, 4)))):
            of, paths, columns, path = face_rows(batch.column(3)[k].values, state)
            n = len(of)
            own = [pa.repeat(pa.scalar(x, kind), n) for x, kind in zip((file, start, part, False), types)]
            yield pa.RecordBatch.from_arrays([*own, paths.take(of), *columns], names=names)
            last = (file, start, part, True, path, *[None] * len(FACE_FIELDS))
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(last, types)], names=names)


def parse_face_lists(files: DataFrame) -> DataFrame:
    """The same for files (file, text) of which each text is whole or cut at entries; a text is read by one task."""
    schema = pa.schema([("file", pa.string()), ("img_rel_path", pa.string()), *((f, pa.int32()) for f in FACE_FIELDS)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                of, paths, columns, _ = face_rows(pa.array(lines_of(text.as_py() or ""), pa.string()), 0)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), len(of)), paths.take(of), *columns], schema=schema)

    return files.select("file", "text").mapInArrow(parse, "file string, img_rel_path string, " + ", ".join(f"{f} int" for f in FACE_FIELDS))
