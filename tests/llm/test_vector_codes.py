import hashlib
import math

import duckdb
import numpy as np
import pytest

from lumigrid.llm import vector_codes

DATA = "/root/testdata/sf0.001"


def brute(rows, dims=64, parts=16, entries=64, rounds=2):
    """Row by row: (vec_id, label, code, error) and the codebooks."""
    kept = [(i, lab, [math.floor(256 * x) for x in e]) for i, e, lab in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = dims // parts
    out = [["", 0] for _ in kept]
    books = []
    for p in range(parts):
        cut = [tuple(v[p * width : (p + 1) * width]) for _, _, v in kept]
        book = [list(c) for c in cut[:entries]]
        near = lambda c: min((sum((a - b) ** 2 for a, b in zip(c, e)), k) for k, e in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            met = [near(c)[1] for c in cut]
            for k in range(len(book)):
                own = [c for c, m in zip(cut, met) if m == k]
                if own:
                    book[k] = [sum(x) // len(own) for x in zip(*own)]
        for row, c in zip(out, cut):
            d, k = near(c)
            row[0] += f"{k:02x}"
            row[1] += d
        books.append(book)
    return sorted((repr(i), repr(lab), code, err) for (i, lab, _), (code, err) in zip(kept, out)), books


def sorted_rows(frame):
    return sorted((repr(r.vec_id), repr(r.label), r.code, r.error) for r in frame.collect())


@pytest.mark.parametrize("hot", [vector_codes._HOT, 4, 10**9])
def test_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(vector_codes, "_HOT", hot)
    rng = np.random.default_rng(2)
    rows = [(k, [round(float(x), 2) for x in rng.normal(0, 0.02, 8)], k % 3) for k in range(90)]
    rows += [(k, [0.0] * 8, None) for k in range(100, 140)]  # a third of all rows
    rows += [(5, [0.25] * 8, 1), (5, [0.25] * 8, 1), (None, [0.5] * 8, None), (None, None, 4)]
    rows += [(200, None, 1), (201, [float("nan")] + [0.0] * 7, 1), (202, [0.0] * 7 + [None], 1), (203, [float("-inf")] * 8, 1), (204, [], 1), (205, [0.0] * 9, 1), (206, [1e30] + [0.0] * 7, 2)]
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], "vec_id long, embedding array<double>, label int, row string, part int").repartition(4)
    coded, books = vector_codes.compress(frame, 8, 4, 8, 3)
    want, want_books = brute([(i, [min(x, (1 << 27) / 256) for x in e] if i == 206 else e, lab) for i, e, lab in rows], 8, 4, 8, 3)
    assert books.tolist() == want_books and sorted_rows(coded) == want
    sums = {}
    for r in coded.collect():
        sums[r.label] = sums.get(r.label, 0) + r.error
    labelled = vector_codes.with_label_errors(coded).collect()
    assert len(labelled) == len(want) and all(r.label_error == sums[r.label] for r in labelled)
    monkeypatch.setattr(vector_codes, "_LABELS", 1)
    assert sorted(map(repr, vector_codes.with_label_errors(coded).collect())) == sorted(map(repr, labelled))
    r = next(r for r in coded.collect() if r.vec_id == 7)
    exact = np.floor(256 * np.array(rows[7][1])).astype(int)
    assert ((vector_codes.reconstruct(r.code, books) - exact) ** 2).sum() == r.error


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(1, [0.5] * 64, 1), (2, [0.5] * 64, 2)], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(frame)
    assert books.shape == (16, 2, 4) and [(r.code, r.error) for r in coded.collect()] == [("00" * 16, 0)] * 2
    coded, books = vector_codes.compress(frame.where("false"))
    assert coded.collect() == [] and vector_codes.with_label_errors(coded).collect() == [] and books.shape[:2] == (16, 0)


def test_bounds_are_checked(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for bad in ({"parts": 7}, {"entries": 257}, {"entries": 0}):
        with pytest.raises(ValueError):
            vector_codes.compress(frame, **bad)


def test_query_matches_sql_and_brute_force(spark):
    got = vector_codes.op12_vector_codes(spark, DATA)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = con.sql(vector_codes.ORACLE_SQL)
    assert got.columns == want.columns
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(want.fetchall())
    rows, books = brute(con.sql("select vec_id, embedding, label from embeddings").fetchall())
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert {r[-1] for r in found} == {digest}
    assert sorted((repr(r[0]), r[1], r[2]) for r in found) == sorted((i, code, err) for i, _, code, err in rows)
