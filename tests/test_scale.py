"""Boosting and suppression beyond what one row, window or comparison of all pairs can hold."""

import random
import time

import numpy as np
import pytest

from lumigrid.operators import boost, boxes


def samples(spark, n=60, features=5, seed=1, repeats=0):
    rng = np.random.default_rng(seed)
    rows = [(int(k), int(k % 3 == 0), [round(float(v), 1) for v in rng.normal(k % 3 == 0, 1, features)]) for k in rng.permutation(n)]
    rows += rows[:repeats]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "sample_id long, y int, x array<double>, part string, position int").repartition(3)


def slow_stump(rows, weights, feature):
    """(error, cut, threshold, polarity) of the first cut of least error, values in order."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][2][feature], rows[k][0]))
    tp, tn = (sum(w for w, r in zip(weights, rows) if r[1] == y) for y in (1, 0))
    best, sp, sn = None, 0.0, 0.0
    for at, k in enumerate(order):
        sp, sn = sp + weights[k] * (rows[k][1] == 1), sn + weights[k] * (rows[k][1] == 0)
        e1, e2 = round(sp + tn - sn, 12), round(sn + tp - sp, 12)
        v = rows[k][2][feature]
        threshold = 0.5 * (v + rows[order[at + 1]][2][feature]) if at + 1 < len(order) else v + 0.5
        if best is None or min(e1, e2) < best[0]:
            best = (min(e1, e2), at, threshold, -1 if e1 < e2 else 1)
    return best


@pytest.mark.parametrize("chunk,few_rows", [(1 << 16, 200_000), (7, 200_000), (7, 1), (1, 200_000)])
def test_sorted_features_give_the_best_cuts(spark, monkeypatch, chunk, few_rows):
    monkeypatch.setattr(boost, "_CHUNK", chunk)
    monkeypatch.setattr(boost, "_ROWS", few_rows)
    rows, frame = samples(spark)
    store = boost.SortedFeatures(frame)
    try:
        assert store.cut == (chunk < len(rows))
        w = store.first_weights()
        by_class = {1: 0.5 / sum(r[1] for r in rows), 0: 0.5 / sum(1 - r[1] for r in rows)}
        assert np.allclose(sorted(w), sorted(by_class[r[1]] for r in rows))
        got = {r.feature_id: r for r in store.stumps(w).collect()}
        for f in range(5):
            error, _, threshold, polarity = slow_stump(rows, [by_class[r[1]] for r in rows], f)
            assert (round(got[f].error, 9), round(got[f].threshold, 9), got[f].polarity) == (round(error, 9), round(threshold, 9), polarity)
    finally:
        store.clear()


@pytest.mark.parametrize("chunk", [1 << 16, 9])
def test_training_is_the_same_by_store_and_by_sorting(spark, monkeypatch, chunk):
    monkeypatch.setattr(boost, "_CHUNK", chunk)
    _, frame = samples(spark, 50, repeats=4)
    stored = boost.train(frame, 4)
    resumed = boost.train(frame, 4, stored.stumps[:2])
    monkeypatch.setattr(boost, "_SAMPLES", 10)
    by_sorting = boost.train(frame, 4)
    for other in (resumed, by_sorting):
        assert [(s.feature_id, s.polarity) for s in other.stumps] == [(s.feature_id, s.polarity) for s in stored.stumps]
        assert np.allclose([(s.threshold, s.alpha, s.error) for s in other.stumps], [(s.threshold, s.alpha, s.error) for s in stored.stumps])
    assert boost.train(frame.where("false"), 3).stumps == ()


@pytest.mark.parametrize("chunk", [1 << 16, 9])
def test_a_round_moves_no_values(spark, monkeypatch, chunk):
    monkeypatch.setattr(boost, "_CHUNK", chunk)
    _, frame = samples(spark)
    store = boost.SortedFeatures(frame)
    plan = store.judged(store.first_weights())._jdf.queryExecution().executedPlan().toString()
    # what precedes a range comes by broadcast; the stored values are neither dealt nor sorted
    values = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert all("range-sums" in plan for _ in values) and "rangepartitioning" not in plan
    below = plan.split("BroadcastExchange")[0]
    assert "hashpartitioning" not in below and "SortMergeJoin" not in plan
    store.clear()


def test_a_feature_without_a_value_is_an_error(spark):
    frame = spark.createDataFrame([(1, 1, [1.0, None]), (2, 0, [1.0, 2.0])], "sample_id long, y int, x array<double>")
    with pytest.raises(Exception, match="without a value"):
        boost.train(frame, 1)


def slow_threshold(rows, target):
    best = None
    for s in sorted({s for y, s in rows if y == 1}, reverse=True):
        dr, fpr = (sum(t >= s for y, t in rows if y == k) / max(1, sum(y == k for y, _ in rows)) for k in (1, 0))
        best = best or (s, dr, fpr)
        if dr >= target:
            return s, dr, fpr
    return best


@pytest.mark.parametrize("target", [0.0, 0.5, 0.93, 1.0])
def test_threshold_over_ranges_of_scores(spark, target):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.4), rng.randrange(60) / 10) for _ in range(400)]
    frame = spark.createDataFrame([*rows, (1, None)], "y int, score double").repartition(4)
    got = boost.tune_threshold(frame, target).first()
    assert np.allclose(tuple(got), slow_threshold(rows, target))


def test_threshold_of_odd_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "y int, score double")
    assert boost.tune_threshold(make([])).collect() == [] == boost.tune_threshold(make([(0, 0.5)])).collect()
    assert tuple(boost.tune_threshold(make([(1, 0.5), (1, 0.5)])).first()) == (0.5, 1.0, 0.0)


def test_threshold_has_no_window_without_keys(spark):
    """Nothing but the one row of each task's result meets in one partition."""
    import inspect

    assert "Window.orderBy" not in inspect.getsource(boost.tune_threshold)


def boxes_frame(spark, rows):
    return spark.createDataFrame(rows, "img_id long, box_id long, x long, y long, w long, h long, score double").repartition(2)


def test_a_hundred_thousand_boxes_of_one_image(spark):
    rng = np.random.default_rng(3)
    n = 100_000
    x, y, w, h = rng.integers(0, 6000, n), rng.integers(0, 6000, n), rng.integers(20, 60, n), rng.integers(20, 60, n)
    rows = [(1, k, *map(int, b), float(s)) for k, (*b, s) in enumerate(zip(x, y, w, h, rng.random(n)))]
    frame = boxes_frame(spark, rows).cache()
    frame.count()
    for solve in (lambda f: boxes.vote_merge(f, 0.5, 2), lambda f: boxes.suppress_by_score(f, 0.4), lambda f: boxes.group_similar(f, 2, 0.2)):
        began = time.time()
        found = solve(frame).count()
        assert 0 < found < n and time.time() - began < 60
    frame.unpersist()


@pytest.mark.parametrize("few", [0, 10_000])
def test_grid_and_comparison_of_all_give_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(boxes, "_FEW", few)
    monkeypatch.setattr(boxes, "_CELLS", 64)
    rng = random.Random(6)
    for _ in range(12):
        n = rng.randrange(1, 60)
        b = np.array([(rng.randrange(-20, 60), rng.randrange(-20, 60), rng.choice([0, 1, 5, 12, 30, 90]), rng.choice([1, 5, 12, 30])) for _ in range(n)])
        for measure, thr in ((boxes._of_smaller, 0.3), (boxes._of_union, 0.2), (boxes._of_smaller, 1.0), (boxes._of_smaller, 0.0)):
            full = measure(b[:, None], b[None]) > thr
            leaders, owner = [], []
            for k in range(n):
                met = [j for j, lead in enumerate(leaders) if full[k, lead]]
                owner.append(met[0] if met else len(leaders))
                if not met:
                    leaders.append(k)
            got = boxes._leading(b, measure, thr)
            assert got[0] == leaders and got[1].tolist() == owner
        place = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
        want = [sum(place[j] == place[k] and bool(boxes._of_smaller(b[k], b[j]) > 0.3) for j in range(n)) for k in range(n)]
        assert boxes._counted(place, b, 0.3).tolist() == want
        pairs = sorted(tuple(sorted(p)) for i, j in boxes._near(place, b[:, :2], b[:, :2] + b[:, 2:]) for p in zip(i.tolist(), j.tolist()))
        assert len(pairs) == len(set(pairs)) and {(i, j) for i in range(n) for j in range(i + 1, n) if place[i] == place[j] and boxes._overlap(b[i], b[j]) > 0} <= set(pairs)


def test_rows_with_nulls_are_left_out(spark):
    rows = [(1, k, 10, 10, 20, 20, 0.5) for k in range(4)]
    odd = [(None, 9, 1, 1, 5, 5, 0.9), (1, 10, None, 1, 5, 5, 0.9), (1, 11, 1, 1, 5, None, 0.9), (2, 12, 1, None, 5, 5, None), (3, 13, 7, 7, 5, 5, None)]
    plain, mixed = boxes_frame(spark, [*rows, odd[-1]]), boxes_frame(spark, rows + odd)
    for solve in (boxes.vote_merge, boxes.suppress_by_score, lambda f: boxes.group_similar(f, 1), boxes.merge_overlapping):
        assert sorted(map(tuple, solve(mixed).collect())) == sorted(map(tuple, solve(plain).collect()))
        assert solve(mixed.where("false")).collect() == []


def test_marks_are_not_dealt_by_category(spark):
    from lumigrid.operators import dataset

    marks = spark.createDataFrame([(k, 1 + (k % 3 == 0)) for k in range(30)] + [(None, 2), (1, None)], "image_id long, category_id int")
    categories = spark.createDataFrame([(1, "cat"), (2, "person"), (4, "person"), (None, "person")], "id int, name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dataset.images_without(spark.range(30), marks, categories, "person")
        assert "hashpartitioning(category_id" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in kept.collect()) == [k for k in range(30) if k % 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
