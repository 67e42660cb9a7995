"""Patches out of images, resizing and the face pre-filter against slow loops."""

import hashlib
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import cascade, images, mining, windows
from lumigrid.operators.cascade import DetectorConfig, Stage, Weak
from lumigrid.plans.training import CascadeTrainConfig, detection_stages, patch_miner, patch_samples, train_cascade
from lumigrid.session import new_folder

MODEL = [Stage((Weak(0, 0, 0, 6, 3, 5.0, 1, 1.0), Weak(2, 1, 0, 4, 2, -2.0, -1, 0.6)), 0.6), Stage((Weak(3, 0, 1, 2, 5, 1.0, 1, 0.5),), 0.5)]


def image_set(n=14, seed=3):
    rng = np.random.default_rng(seed)
    return {k: rng.integers(0, 256, (rng.integers(5, 20), rng.integers(5, 24))) for k in range(n)}


def frame(spark, pictures, extra=()):
    rows = [(k, *p.shape, p.ravel().tolist(), 1, "clash") for k, p in pictures.items()] + list(extra)
    return spark.createDataFrame(rows, "img_id long, h int, w int, px array<int>, r int, z string").repartition(3)


def feature(patch, w):
    s = lambda down, across: patch[w.r + down * w.h : w.r + (down + 1) * w.h, w.c + across * w.w : w.c + (across + 1) * w.w].sum()
    return [s(0, 1) - s(0, 0), s(1, 0) - s(0, 0), s(0, 1) - s(0, 0) - s(0, 2), s(1, 0) - s(0, 0) - s(2, 0), s(0, 0) + s(1, 1) - s(0, 1) - s(1, 0)][w.ftype]


def is_face(patch, stages):
    return all(sum(w.alpha for w in s.weak if w.polarity * feature(patch, w) < w.polarity * w.threshold) >= s.threshold for s in stages)


def ordered(pictures, seed=42):
    return sorted(pictures, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


def slow_scan(pictures, most, size, step, accept):
    out = []
    for k in ordered(pictures):
        p = pictures[k].astype(float)
        for r in range(0, p.shape[0] - size + 1, step):
            for c in range(0, p.shape[1] - size + 1, step):
                cut = p[r : r + size, c : c + size]
                if len(out) < most and cut.var() >= 1e-4 and accept((cut - cut.mean()) / cut.std()):
                    out.append((k, r, c))
    return out


def rows_of(found):
    got = sorted(found.collect(), key=lambda r: r.k)
    assert [r.k for r in got] == list(range(len(got)))
    return [(r.img_id, r.r, r.c) for r in got], got


@pytest.mark.parametrize("most,first", [(7, 1), (25, 2), (10_000, 256)])
def test_scan_fills_the_quota_in_the_order_of_images(spark, most, first):
    pictures = image_set() | {50: np.full((12, 12), 9)}  # flat
    odd = [(60, 3, 3, [1] * 9, 0, ""), (61, None, None, None, 0, "")]
    data = frame(spark, pictures, odd)
    want = slow_scan(pictures, most, 6, 2, lambda z: is_face(z, MODEL))
    got, rows = rows_of(mining.mine_negatives(data, MODEL, most, size=6, step=2, first=first))
    assert got == want and 0 < len(want) <= most
    for r in rows:
        cut = pictures[r.img_id][r.r : r.r + 6, r.c : r.c + 6]
        assert np.allclose(np.array(r.z).reshape(6, 6), (cut - cut.mean()) / cut.std())
    stored = new_folder(spark, "shuffled")
    mining.store_shuffled(data, stored)
    parts = spark.read.parquet(stored)
    assert rows_of(mining.mine_negatives(parts, MODEL, most, size=6, step=2, first=first))[0] == want
    assert "PartitionFilters: [isnotnull(bucket" in parts.where("bucket < 3")._jdf.queryExecution().executedPlan().toString()


def test_a_condition_and_a_function_accept_the_same(spark):
    data = frame(spark, image_set())
    total = lambda z: F.aggregate(F.slice(z, 1, 18), F.lit(0.0), lambda s, v: s + v)
    by_column = mining.collect_patches(data, 30, "scan", (total(F.col("z")) < 2.5) & (F.col("var") > 4000) & (F.col("r") > 0), 6, 2)
    by_function = mining.collect_patches(data, 30, "scan", lambda w: (w.patches().reshape(len(w), -1)[:, :18].sum(1) < 2.5) & (w.std**2 > 4000) & (w.r > 0), 6, 2)
    one, other = rows_of(by_column), rows_of(by_function)
    assert one[0] == other[0] and len(one[0]) == 30 and all(np.allclose(a.z, b.z) for a, b in zip(one[1], other[1]))


@pytest.mark.parametrize("most,one", [(40, False), (5, True)])
def test_random_patches_spread_over_images(spark, most, one):
    pictures = image_set() | {50: np.full((12, 12), 9), 51: np.arange(36).reshape(6, 6)}
    got, _ = rows_of(mining.collect_patches(frame(spark, pictures), most, "random", size=6, one_per_image=one))
    per_image = 1 if one else max(1, most // (len(pictures) // 2))
    want = []
    for k in ordered(pictures):
        p, own = pictures[k].astype(float), []
        at = [(r, c) for r in range(p.shape[0] - 5) for c in range(p.shape[1] - 5)]
        key = lambda j: ((j + 1 + k * 7919 + 42) * 48271 % 2147483647) ** 2 % 2147483647  # noqa: B023, E731
        for j in sorted(range(len(at)), key=lambda j: (key(j), j)):
            r, c = at[j]
            if len(own) < per_image and p[r : r + 6, c : c + 6].var() >= 1e-4:
                own.append((k, r, c))
        want += own
    assert got == want[:most]


def test_mining_refuses_and_finds_nothing(spark):
    data = frame(spark, image_set(3))
    for bad in ({"mode": "all"}, {"mode": "random", "accept": lambda w: w}, {"step": 0}):
        with pytest.raises(ValueError):
            mining.collect_patches(data, 5, **bad)
    assert mining.collect_patches(data.where("false"), 5).collect() == []
    assert mining.collect_patches(data, 5, "scan", lambda w: np.zeros(len(w), bool), 6).collect() == []
    with pytest.raises(Exception, match="outside of image"):
        mining.patches_at(data, spark.createDataFrame([(0, 0, 900)], "img_id long, r int, c int"), 6).collect()


def test_training_on_mined_patches_is_resumed(spark):
    rng = np.random.default_rng(1)
    features = windows.enumerate_features(spark, 6, 2)
    faces = {k: np.hstack([np.full((6, 3), 200), np.full((6, 3), 60)]) + rng.integers(0, 40, (6, 6)) for k in range(30)}
    free = {k: rng.integers(0, 256, (16, 16)) for k in range(20)}
    free_frame = frame(spark, free)
    around = mining.patches_at(frame(spark, faces), spark.createDataFrame([(k, 0, 0) for k in faces], "img_id long, r int, c int"), 6)
    positives = patch_samples(around, features, 1, 6).persist()
    negatives = patch_samples(mining.collect_patches(free_frame, 40, "random", size=6), features, 0, 6).persist()
    asked = []

    def mine(stages):
        asked.append(len(stages))
        return patch_miner(free_frame, features, 60, 6, 2)(stages)

    cfg = CascadeTrainConfig(target_fpr=0.0, stage_fpr=0.9, stage_dr=0.9, most_stumps=5, most_stages=2)
    validation = positives.unionByName(negatives)
    whole = train_cascade(positives, negatives, validation, cfg, mine=mine)
    assert asked and len(whole) >= 1
    resumed = train_cascade(positives, negatives, validation, cfg, mine=mine, done=whole[:1])
    assert resumed == whole
    stages = detection_stages(whole, features)
    hard = mining.mine_negatives(free_frame, stages[:1], 60, size=6, step=2)
    want = slow_scan(free, 60, 6, 2, lambda z: is_face(z, stages[:1]))
    assert rows_of(hard)[0] == want
    ids = [r.sample_id for r in positives.unionByName(patch_samples(hard, features, 0, 6)).select("sample_id").collect()]
    assert len(ids) == len(set(ids))


def slow_resize(p, height, width, method):
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            if method == "area":
                y0, y1, x0, x1 = i * p.shape[0] / height, (i + 1) * p.shape[0] / height, j * p.shape[1] / width, (j + 1) * p.shape[1] / width
                wy = [max(0.0, min(y1, r + 1) - max(y0, r)) for r in range(p.shape[0])]
                wx = [max(0.0, min(x1, c + 1) - max(x0, c)) for c in range(p.shape[1])]
            else:
                y, x = (min(max((k + 0.5) * a / b - 0.5, 0), a - 1) for k, a, b in ((i, p.shape[0], height), (j, p.shape[1], width)))
                wy = [max(0.0, 1 - abs(y - r)) for r in range(p.shape[0])]
                wx = [max(0.0, 1 - abs(x - c)) for c in range(p.shape[1])]
            weight = np.outer(wy, wx)
            out[i, j] = (weight * p).sum() / weight.sum()
    return out


@pytest.mark.parametrize("method", ["area", "bilinear"])
@pytest.mark.parametrize("size", [(4, 4), (3, 7), (13, 11), (1, 1)])
def test_resize_to_any_size(spark, method, size):
    pictures = image_set(6)
    got = images.resize(frame(spark, pictures, [(99, None, None, None, 0, "")]), *size, method, rounded=False).collect()
    assert len(got) == 7
    for r in got:
        assert (r.h, r.w, r.z if r.img_id < 99 else "clash") == (*size, "clash")
        if r.img_id == 99:
            assert r.px is None
        else:
            assert np.allclose(np.array(r.px).reshape(size), slow_resize(pictures[r.img_id], *size, method))
    whole = images.resize(frame(spark, pictures), *size, method).first()
    assert whole.px == [int(np.rint(round(v, 9))) for v in slow_resize(pictures[whole.img_id], *size, method).ravel()]
    with pytest.raises(ValueError):
        images.resize(frame(spark, pictures), 0, 1)


def test_large_images_are_made_smaller_for_detection(spark):
    rng = np.random.default_rng(5)
    picture = np.kron(rng.integers(0, 256, (6, 9)), np.ones((20, 20))).astype(int)
    stages = [Stage((Weak(0, 0, 0, 24, 12, -10.0, 1, 1.0),), 1.0)]
    cfg = DetectorConfig(min_votes=1, max_dim=100, step_factor=1.0)
    data = frame(spark, {0: picture})
    factor = 100 / 180
    small = np.rint(slow_resize(picture, int(120 * factor), int(180 * factor), "area").round(9)).astype(int)
    direct = cascade.detect(frame(spark, {0: small}), stages, replace(cfg, max_dim=0)).collect()
    got = cascade.detect(data, stages, cfg).collect()
    assert sorted(map(tuple, got)) == sorted((r.img_id, r.group_id, *(int(v / factor) for v in (r.x, r.y, r.w, r.h)), r.n) for r in direct) and got
    plan = cascade.detect(data, stages, cfg)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("RoundRobinPartitioning") == 1  # that of the fixture


@pytest.mark.parametrize("mode", [0, 1])
def test_detection_merges_as_the_box_operators(spark, mode):
    from lumigrid.operators import boxes

    rng = np.random.default_rng(6)
    data = frame(spark, {k: rng.integers(0, 256, (50, 60)) for k in range(3)} | {7: np.full((50, 50), 3)})
    stages = [Stage((Weak(0, 0, 0, 24, 12, -4.0, 1, 1.0),), 1.0)]
    cfg = DetectorConfig(min_votes=2, mode=mode, step_factor=1.0)
    want = boxes.post_process(cascade.accepted_windows(data, stages, cfg), mode, cfg.threshold, cfg.min_votes).collect()
    assert sorted(map(tuple, cascade.detect(data, stages, cfg).collect())) == sorted(map(tuple, want)) and want


def test_live_settings_are_held_within_bounds():
    cfg = cascade.adjusted(DetectorConfig(), threshold=7, min_face=1, max_face=9, min_votes=900, scale_factor=1, step_delta=9, step_factor=0)
    assert (cfg.threshold, cfg.min_face, cfg.max_face, cfg.min_votes, cfg.scale_factor, cfg.step_delta, cfg.step_factor) == (1.0, 10, 50, 300, 1.01, 2.0, 0.5)
    assert cascade.adjusted(cfg, max_face=None).max_face is None
    for bad in ({"max_face": 3000}, {"step_delta": 0}, {"mode": 2}, {"min_face": 501}):
        with pytest.raises(ValueError):
            DetectorConfig(**bad)


def test_groups_count_similar_boxes():
    rng = random.Random(2)
    for _ in range(30):
        groups, added = mining._Groups(0.2), []
        for _ in range(40):
            box = (rng.randrange(30), rng.randrange(30), rng.choice([8, 9, 10, 20]))
            got = groups.add(*box)
            added.append(box)
            reach, todo = {len(added) - 1}, [len(added) - 1]
            while todo:
                a, b, w = added[todo.pop()]
                for j, (x, y, v) in enumerate(added):
                    near = 0.2 * min(w, v)
                    if j not in reach and all(abs(d) <= near for d in (a - x, b - y, a + w - x - v, b + w - y - v)):
                        reach.add(j)
                        todo.append(j)
            assert got == len(reach)


def test_images_with_a_face_go(spark):
    rng = np.random.default_rng(8)
    half = np.kron(rng.integers(0, 256, (3, 3)), np.ones((20, 20))).astype(int)
    pictures = {0: half, 1: rng.integers(0, 256, (60, 60)), 2: np.full((60, 60), 5), 3: np.full((40, 90), 5)}
    odd = [(8, None, None, None, 0, ""), (9, 60, 60, [1, 2], 0, "")]
    stages = [Stage((Weak(0, 0, 0, 24, 12, -60.0, 1, 1.0),), 1.0)]
    cfg = cascade.adjusted(DetectorConfig(), scale_factor=1.05, min_face=20, step_factor=1.0)
    data = frame(spark, pictures, odd)
    got = mining.without_faces(data, stages, cfg)
    want = set()
    for k, p in pictures.items():
        hits = cascade.scan_image(mining.equalised(p.astype(float)), stages, cfg)
        groups = mining._Groups(0.2)
        if min(p.shape) >= 50 and max((groups.add(c, r, w) for r, c, w in hits), default=0) <= 2:
            want.add(k)
    assert {r.img_id for r in got.collect()} == want and 2 in want and 0 not in want
    assert got.columns == data.columns and mining.without_faces(data.where("false"), stages, cfg).collect() == []
