import random
import time
import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumigrid.llm import neardup
from lumigrid.session import Scratch


def shingles(text):
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def brute(rows, limit=0.8):
    """The least doc_id of each group, nulls last."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        same = (rows[i][1] or "") == (rows[j][1] or "") or not sets[i] | sets[j]
        if same or sets[i] and len(sets[i] & sets[j]) >= limit * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=repr)


@pytest.mark.parametrize("named", [neardup.NAMED, 0])
def test_groups(spark, monkeypatch, named):
    monkeypatch.setattr(neardup, "NAMED", named)
    rng = random.Random(6)
    words = [f"w{k}é" for k in range(2000)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 300]))]
        for n in range(rng.choice([1, 2, 4])):
            own = list(base)
            for _ in range(n and len(own) // 150):  # far above or far below the limit
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (None, ""), (902, rows[3][1].upper()), (None, rows[5][1]), (7, rows[7][1]), (None, "alone with a null id here"), (903, " \n ")]
    docs = spark.createDataFrame([(*r, k, "d") for k, r in enumerate(rows)], "doc_id long, text string, component int, row_digest string")
    got = neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == brute(rows)
    assert neardup.drop_near_duplicates(docs.where("false")).count() == 0


def test_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 50)
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(400)] = f"x{k}"
        rows.append((k, " ".join(own)))
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]


def edited(base, rng, places, tag):
    own = list(base)
    for at in places:
        own[at] = f"{tag}x{rng.randrange(10**9)}"
    return own


def similarity(a, b):
    a, b = shingles(" ".join(a)), shingles(" ".join(b))
    return len(a & b) / len(a | b)


def test_copies_nearer_to_the_original_than_to_each_other(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    copies = [edited(base, rng, [60 * j + rng.randrange(50) for j in range(6)], f"c{k}") for k in range(100)]
    assert min(similarity(base, c) for c in copies) > 0.84 and similarity(copies[0], copies[1]) < 0.8
    rows = [(k, " ".join(t)) for k, t in enumerate(copies + [base])]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]


def test_groups_do_not_depend_on_the_size_of_blocks(spark, monkeypatch):
    """Many texts share a passage; most are alike in nothing else, some by chains whose ends are not similar."""
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = shared + [f"t{k}w{j}" for j in range(60)]
        for step in range(rng.choice([1, 1, 4])):
            own = own[4:] + [f"t{k}s{step}w{j}" for j in range(4)]
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2000, 7):
        monkeypatch.setattr(neardup, "BLOCK", hot)
        assert sorted((r.doc_id for r in neardup.drop_near_duplicates(docs).collect()), key=repr) == brute(rows)


def test_appended_text(spark):
    """Isolated pairs of a text and itself with a fifth of other words appended."""
    rng = random.Random(5)
    rows = []
    for k in range(200):
        base = [f"a{k}w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [f"b{k}w{j}" for j in range(46)]))]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 400, 2))


def test_many_near_copies(spark):
    """5,000 copies, each at 0.85 to the original and most below 0.8 to each other, are one group; other texts stay."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 5000):
        rows.append((k, " ".join(edited(base, rng, [40 * j + rng.randrange(35) for j in range(3)], f"c{k}"))))
    rows += [(10_000 + k, " ".join(f"o{rng.randrange(10**6)}" for _ in range(60))) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in neardup.drop_near_duplicates(docs).collect())
    assert kept == [0, *range(10_000, 10_500)]


def test_shingles_that_no_task_holds_often(spark, monkeypatch):
    """Two texts of each of many tasks share a passage; no task knows it as frequent, yet it does not fill the prefixes."""
    monkeypatch.setattr(neardup, "CROWDED", 20)
    passage = [f"s{k}" for k in range(40)]
    rows = [(k, " ".join(passage + [f"t{k}w{j}" for j in range(60)])) for k in range(60)] + [(60, " ".join(passage + [f"t7w{j}" for j in range(59)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(31, "doc_id")
    keyed = docs.select("doc_id", "text", neardup.text_digest().alias("digest"))
    texts = keyed.groupBy("digest").agg(F.min("doc_id").alias("least")).withColumn("id", F.col("least"))
    assert len(neardup.frequent_shingles(keyed)) == 0
    scratch = Scratch(spark)
    most = [neardup._shared_prefixes(texts, keyed, 0.8, scratch).agg(F.max("held")).first()[0]]
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    most.append(neardup._shared_prefixes(texts, keyed, 0.8, scratch).agg(F.max("held")).first()[0])
    scratch.clear()
    assert most[0] < 20 < most[1]
    for rounds in (4, 1):
        monkeypatch.setattr(neardup, "ROUNDS", rounds)
        kept = sorted((r.doc_id for r in neardup.drop_near_duplicates(docs).collect()), key=repr)
        assert kept == brute(rows) and set(kept) == set(range(60))


def test_recall_on_documents(spark):
    """Against brute force over all pairs that share a shingle, on the documents of sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id for r in neardup.drop_near_duplicates(docs).collect()), key=repr) == brute(rows)


def test_counting_shingles_holds_little(monkeypatch):
    r, counted = np.random.Generator(np.random.PCG64(3)), 1 << 18
    sets = [np.unique(r.integers(0, 1 << 20, 5000, np.uint64)) for _ in range(300)]
    monkeypatch.setattr(neardup, "shingle_set", lambda text, _: sets[int(text)])
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(300)])] * 2, names=["digest", "text"])
    monkeypatch.setattr(neardup, "COUNTED", 1 << 30)
    whole = next(neardup._counts(iter([batch])))
    own = Counter(np.concatenate(sets).view(np.int64).tolist())
    assert dict(zip(whole["key"].to_pylist(), whole["n"].to_pylist())) == {k: n for k, n in own.items() if n >= neardup.HELD}
    monkeypatch.setattr(neardup, "COUNTED", counted)
    tracemalloc.start()
    part = next(neardup._counts(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * 8 * counted and len(part)
    assert all(n <= own[k] for k, n in zip(part["key"].to_pylist(), part["n"].to_pylist()))


def test_sketches_bound_what_sets_share(monkeypatch):
    r = np.random.Generator(np.random.PCG64(4))
    for n in (1, 3, 4, 5, 17, 64, 65, 300, 5000):
        base = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        for kept in (0.0, 0.5, 0.85, 1.0):
            other = np.unique(np.concatenate((base[: int(kept * len(base))], r.integers(0, 1 << 64, max(1, int((1 - kept) * n)), np.uint64))))
            x, y = (np.frombuffer(neardup._sketch(s), np.uint8).astype(np.int64) for s in (base, other))
            assert x.sum() == len(base) and y.sum() == len(other) and len(x) <= max(1, n)
            assert neardup._most_shared(x, y) == neardup._most_shared(y, x) >= len(np.intersect1d(base, other))
            if n >= 64 and not kept:
                assert neardup._most_shared(x, y) < 0.85 * n
    assert neardup._sketch(np.empty(0, np.uint64)) == b"" == neardup._sketch(np.arange(300, dtype=np.uint64))  # these exclude nothing


def test_only_likely_pairs_are_verified(spark, monkeypatch):
    """Two texts each share half their words, in prefixes too, and are not similar; one more text is."""
    rng = random.Random(9)
    own = lambda tag, n: [f"{tag}w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [own(f"s{k}", 150) for k in range(20)]
    rows = [(k, " ".join(shared[k % 20] + own(f"t{k}", 150))) for k in range(40)]
    rows.append((40, rows[7][1] + " and one more"))
    moved, table = [], Scratch.table

    def counted(self, df, what):
        made = table(self, df, what)
        moved.extend([made.count()] if what == "sets" else [])
        return made

    monkeypatch.setattr(Scratch, "table", counted)
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
    assert moved == [2, 0]


def test_shuffle_files_go_and_rows_move_once(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(1 for k in range(blocks.getAllBlocks().size()) if blocks.getAllBlocks().apply(k).isShuffle())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spark._jvm.System.gc()
    time.sleep(3)
    before = shuffled()
    kept = neardup.drop_near_duplicates(docs)
    time.sleep(3)
    assert shuffled() <= before
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(name") == 2  # the rows, and the names of those that stay
