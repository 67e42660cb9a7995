import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lumigrid.llm import manifest
from lumigrid.session import Scratch

DATA = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def lowered(row):
    if row["doc_id"] is None or row["text"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 5:
        return row
    return row | {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])}


def tree(hashes, fan):
    """(root, for each leaf its runs of siblings as (those before, those after))."""
    at, proofs = list(range(len(hashes))), [[] for _ in hashes]
    while len(hashes) > 1:
        for k, own in enumerate(proofs):
            start = at[k] - at[k] % fan
            own.append((hashes[start : at[k]], hashes[at[k] + 1 : start + fan]))
            at[k] //= fan
        hashes = [digest("".join(hashes[k : k + fan])) for k in range(0, len(hashes), fan)]
    return hashes[0], proofs


def brute(rows, fan=16):
    sources = {}
    for row in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        sources.setdefault(row["source"], []).append(row)
    ordered = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([leaf(r) for r in sources[s]], fan) for s in ordered}
    root, top = tree([built[s][0] for s in ordered], fan) if ordered else (None, [])
    out = []
    for s, above in zip(ordered, top):
        subroot, proofs = built[s]
        for row, own in zip(sources[s], proofs):
            folded = leaf(lowered(row))
            for before, after in own + above:
                folded = digest("".join(before) + folded + "".join(after))
            proof = digest("".join("".join(b) + "".join(a) for b, a in own + above))
            out.append((row["doc_id"], leaf(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def found(spark, docs, fan=16):
    scratch = Scratch(spark)
    p = manifest.manifest(docs, scratch, fan)
    at = [F.col(c) for c in ("path", "place", "top_path", "top_place")]
    proof = F.sha2(F.concat(manifest.siblings(*at[:2], fan), manifest.siblings(*at[2:], fan)), 256)
    folded = manifest.fold(manifest.fold(F.col("changed"), *at[:2], fan), *at[2:], fan)
    cols = p.select("doc_id", "leaf", "subroot", "root", proof, folded.alias("f")).collect()
    scratch.clear()
    return sorted([(*tuple(r), r.f == r.root) for r in cols], key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*(r[f] for f in FIELDS), 1, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int, tree string")


def make(n, source):
    return [{"doc_id": k, "source": source, "lang": "en", "n_chars": k % 7, "text": f"Text Nr {k} É"} for k in range(n)]


@pytest.mark.parametrize("fan", [2, 16])
def test_odd_rows(spark, fan):
    rows = make(150, "hot") + make(17, "b") + make(16, "a") + make(1, "lone") + make(3, None) + make(2, "") + make(2, "é") + make(2, "Z")
    rows += [{"doc_id": None, "source": "b", "lang": None, "n_chars": None, "text": None}] * 2 + [{"doc_id": 3, "source": "b", "lang": None, "n_chars": -5, "text": ""}] * 2
    rows += [{"doc_id": -9, "source": "b", "lang": "", "n_chars": 0, "text": "ABC" * 100_000}]
    got = found(spark, frame(spark, rows).repartition(6), fan)
    assert got == brute(rows, fan)
    assert len({r[3] for r in got}) == 1 and 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = make(n, "only")
    assert found(spark, frame(spark, rows)) == brute(rows)


def test_many_sources(spark):
    rows = [r for k in range(40) for r in make(k % 3 + 1, f"s{k}")]
    assert found(spark, frame(spark, rows), 4) == brute(rows, 4)


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(manifest, "_BROADCAST", 0)
    rows = make(40, "a") + make(5, None)
    assert found(spark, frame(spark, rows), 3) == brute(rows, 3)


def test_query_matches_sql_and_brute_force(spark):
    got = manifest.op13_manifest(spark, DATA)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(manifest.ORACLE_SQL)
    assert got.columns == want.columns
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == sorted(want.fetchall(), key=repr)
    rows = con.sql("select doc_id, source, lang, n_chars, text from documents").fetchall()
    assert found == brute([dict(zip(FIELDS, r)) for r in rows])
