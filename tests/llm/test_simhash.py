import random

import numpy as np
import pytest
import xxhash

from lumigrid.llm import simhash


def brute(rows, limit=2):
    out = {}
    fps = [simhash_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                parent[find(i)] = find(j)
    for i, (d, _) in enumerate(rows):
        ids = [e for j, (e, _) in enumerate(rows) if find(i) == find(j) and e is not None]
        out.setdefault((d, f"{fps[i]:016x}", min(ids) if ids else None), 0)
        out[d, f"{fps[i]:016x}", min(ids) if ids else None] += 1
    return out


def simhash_of(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in folded.replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}é" for k in range(400)]
    rows = []
    for k in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        for _ in range(rng.choice([1, 1, 4])):
            own = list(base)
            if rng.random() < 0.7:
                own[rng.randrange(len(own))] = rng.choice(vocabulary).upper()
            rows.append((len(rows), " ".join(own)))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t "), (None, rows[0][1]), (7, rows[7][1]), (None, "quite alone here today")]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, fp string")
    got = simhash.simhash_components(docs).collect()
    found = {}
    for r in got:
        found[tuple(r)] = found.get(tuple(r), 0) + 1
    assert found == brute(rows)


@pytest.mark.parametrize("dense", [0, 3, 10**9])
@pytest.mark.parametrize("limit", [1, 2])
def test_crowds_lose_no_link(spark, dense, limit):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    values = [v - (1 << 64) if v >> 63 else v for v in {v % (1 << 64) for v in values}]
    edges = simhash.close_pairs(spark.createDataFrame([(v,) for v in values], "fp long"), limit, dense).collect()

    def labels(pairs):
        parent = {v: v for v in values}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return {v: find(v) for v in values}

    truth = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= limit]
    assert labels(truth) == labels([(r.a, r.b) for r in edges])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0


def test_allocation_is_least():
    rng = np.random.default_rng(1)
    costs = rng.random((50, 4, 4))
    costs[:, :, 0] = 0
    got = simhash.allocate(costs, -1)
    assert (got.sum(1) == -1).all()
    from itertools import product

    for row, own in zip(costs, got):
        least = min(sum(row[k, t + 1] for k, t in enumerate(ts)) for ts in product(range(-1, 3), repeat=4) if sum(ts) == -1)
        assert sum(row[k, t + 1] for k, t in enumerate(own)) == pytest.approx(least)
