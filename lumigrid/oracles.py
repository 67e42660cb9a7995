"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from dataclasses import replace

_PX = """px AS (SELECT vec_id AS img_id, ((i - 1) // 8)::INT AS r, ((i - 1) % 8)::INT AS c,
    greatest(0, least(255, floor((embedding[i]::DOUBLE + 1) * 127.5)))::BIGINT AS v FROM embeddings, range(1, 65) t(i))"""
_II = """ii AS (SELECT g.img_id, g.r, g.c, coalesce((SELECT sum(v) FROM px WHERE px.img_id = g.img_id AND px.r < g.r AND px.c < g.c), 0)::BIGINT AS ii,
    coalesce((SELECT sum(v * v) FROM px WHERE px.img_id = g.img_id AND px.r < g.r AND px.c < g.c), 0)::BIGINT AS ii_sq
    FROM (SELECT DISTINCT img_id, r, c FROM (SELECT img_id FROM px GROUP BY 1), range(0, 9) a(r), range(0, 9) b(c)) g)"""
_IIW = """ii AS (SELECT img_id, r, c, sum(a) OVER (PARTITION BY img_id, c ORDER BY r)::BIGINT AS ii, sum(b) OVER (PARTITION BY img_id, c ORDER BY r)::BIGINT AS ii_sq FROM (
    SELECT img_id, r, c, sum(v) OVER (PARTITION BY img_id, r ORDER BY c) AS a, sum(v * v) OVER (PARTITION BY img_id, r ORDER BY c) AS b FROM (
        SELECT img_id, r + 1 AS r, c + 1 AS c, v FROM px UNION ALL SELECT img_id, x.r::INT, x.c::INT, 0 FROM (SELECT DISTINCT img_id FROM px),
            (SELECT 0 AS r, i AS c FROM range(0, 9) t(i) UNION ALL SELECT i, 0 FROM range(1, 9) t(i)) x)))"""
_SAMPLES = "s AS (SELECT vec_id AS sample_id, (label = 3)::INT AS y, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
_BOXES = """boxes AS (SELECT l_orderkey // 10 AS img_id, row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box_id,
    l_partkey * 37 % 160 AS x, l_suppkey * 53 % 160 AS y, (24 + l_linenumber % 5 * 6)::BIGINT AS w, (24 + l_linenumber % 5 * 6)::BIGINT AS h, l_extendedprice AS score FROM lineitem)"""
_ANNOTATIONS = """annotations AS (SELECT (l_orderkey % 7) || '/img_' || (l_orderkey // 10) || '.jpg' AS img_rel_path, l_partkey * 37 % 160 AS x, l_suppkey * 53 % 160 AS y,
    20 + l_partkey % 60 AS w, 20 + l_suppkey % 70 AS h, (l_returnflag = 'R')::INT AS blur, (l_linenumber = 7)::INT AS occlusion, (l_linenumber = 6)::INT AS pose, (l_discount > 0.09)::INT AS invalid FROM lineitem)"""

_BOXES_ONCE = _BOXES.replace("boxes AS (", "boxes AS MATERIALIZED (", 1)


def _inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))::DOUBLE"


def _iom(a: str, b: str) -> str:
    return f"({_inter(a, b)} / nullif(least({a}.w * {a}.h, {b}.w * {b}.h), 0)::DOUBLE)"


def _iou(a: str, b: str) -> str:
    return f"(CASE WHEN {_inter(a, b)} = 0 THEN 0.0 ELSE {_inter(a, b)} / (({a}.w * {a}.h + {b}.w * {b}.h)::DOUBLE - {_inter(a, b)}) END)"


def _merge(boxes: str, threshold: float, votes: int) -> str:
    """CTEs that end in merged(img_id, group_id, x, y, w, h, n)."""
    b = "STRUCT_PACK(x := o.x, y := o.y, w := o.w, h := o.h)"
    return f"""voted AS (SELECT a.img_id, a.box_id, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.w) AS w, any_value(a.h) AS h, count(*) AS votes
    FROM {boxes} a JOIN {boxes} b ON a.img_id = b.img_id AND {_iom("a", "b")} > {threshold} GROUP BY a.img_id, a.box_id HAVING count(*) >= {votes}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY votes DESC, box_id DESC) AS k FROM voted),
led(img_id, k, leaders) AS (
    SELECT img_id, k, [{b}] FROM ordered o WHERE k = 1
    UNION ALL
    SELECT o.img_id, o.k, CASE WHEN len(list_filter(led.leaders, lambda q: {_iom("q", "o")} > {threshold})) > 0 THEN led.leaders ELSE list_append(led.leaders, {b}) END
    FROM led JOIN ordered o ON o.img_id = led.img_id AND o.k = led.k + 1),
final AS (SELECT img_id, arg_max(leaders, k) AS leaders FROM led GROUP BY img_id),
member AS (SELECT o.*, list_filter(range(1, len(leaders) + 1), lambda i: {_iom("leaders[i]", "o")} > {threshold})[1] - 1 AS group_id FROM ordered o JOIN final USING (img_id)),
merged AS (SELECT img_id, group_id::INT AS group_id, trunc(avg(x))::INT AS x, trunc(avg(y))::INT AS y, trunc(avg(w))::INT AS w, trunc(avg(h))::INT AS h, count(*) AS n FROM member GROUP BY img_id, group_id)"""


def _features(win: int, stride: int) -> str:
    kinds = "(VALUES (0, 2, 1), (1, 1, 2), (2, 3, 1), (3, 1, 3), (4, 2, 2)) k(ftype, across, down)"
    return f"""features AS (SELECT (row_number() OVER (ORDER BY ftype, r, c, h, w) - 1)::INT AS feature_id, ftype::INT AS ftype, r::INT AS r, c::INT AS c, h::INT AS h, w::INT AS w
    FROM {kinds}, range(0, {win}, {stride}) a(r), range(0, {win}, {stride}) b(c), range(1, {win} + 1, {stride}) e(h), range(1, {win} + 1, {stride}) f(w)
    WHERE h <= ({win} - r) // down AND w <= ({win} - c) // across)"""


def _rect(r: str, c: str, h: str, w: str, side: int, table: str = "t") -> str:
    at = lambda y, x: f"{table}.ii[(({y}) * {side + 1} + ({x}) + 1)::INT]"
    return f"({at(f'{r} + {h}', f'{c} + {w}')} + {at(r, c)} - {at(r, f'{c} + {w}')} - {at(f'{r} + {h}', c)})"


def _contrast(ftype: str, r: str, c: str, h: str, w: str, side: int) -> str:
    s = lambda y, x: _rect(y, x, h, w, side)
    return (
        f"CASE {ftype} WHEN 0 THEN {s(r, f'{c} + {w}')} - {s(r, c)} WHEN 1 THEN {s(f'{r} + {h}', c)} - {s(r, c)} "
        f"WHEN 2 THEN {s(r, f'{c} + {w}')} - {s(r, c)} - {s(r, f'{c} + 2 * {w}')} WHEN 3 THEN {s(f'{r} + {h}', c)} - {s(r, c)} - {s(f'{r} + 2 * {h}', c)} "
        f"ELSE {s(r, c)} + {s(f'{r} + {h}', f'{c} + {w}')} - {s(r, f'{c} + {w}')} - {s(f'{r} + {h}', c)} END"
    )


_TABLES = f"{_PX}, {_IIW}, t AS (SELECT img_id, list(ii ORDER BY r, c) AS ii, list(ii_sq ORDER BY r, c) AS ii_sq FROM ii GROUP BY img_id)"
_PIXELS = """fp AS MATERIALIZED (SELECT vec_id // 64 AS img_id, ((vec_id % 64) // 8 * 8 + (i - 1) // 8)::INT AS r, ((vec_id % 64) % 8 * 8 + (i - 1) % 8)::INT AS c,
    greatest(0, least(255, floor((embedding[i]::DOUBLE + 1) * 127.5)))::BIGINT AS v FROM embeddings, range(1, 65) q(i)
    UNION ALL SELECT f.img_id, (k.tile // 8 * 8 + i // 8)::INT, (k.tile % 8 * 8 + i % 8)::INT, 0 FROM (SELECT DISTINCT vec_id // 64 AS img_id FROM embeddings) f, range(0, 64) k(tile), range(0, 64) q(i)
    WHERE f.img_id * 64 + k.tile NOT IN (SELECT vec_id FROM embeddings))"""
_FRAME_TABLES = """fi AS (SELECT img_id, r, c, sum(a) OVER (PARTITION BY img_id, c ORDER BY r)::BIGINT AS ii, sum(b) OVER (PARTITION BY img_id, c ORDER BY r)::BIGINT AS ii_sq FROM (
    SELECT img_id, r, c, sum(v) OVER (PARTITION BY img_id, r ORDER BY c) AS a, sum(v * v) OVER (PARTITION BY img_id, r ORDER BY c) AS b FROM (
        SELECT img_id, r + 1 AS r, c + 1 AS c, v FROM fp UNION ALL SELECT img_id, e.r::INT, e.c::INT, 0 FROM (SELECT DISTINCT img_id FROM fp),
            (SELECT 0 AS r, i AS c FROM range(0, 65) q(i) UNION ALL SELECT i, 0 FROM range(1, 65) q(i)) e))),
t AS (SELECT img_id, list(ii ORDER BY r, c) AS ii, list(ii_sq ORDER BY r, c) AS ii_sq FROM fi GROUP BY img_id)"""
_FRAMES = f"{_PIXELS}, {_FRAME_TABLES}"


def _ladder(height: int, width: int, least: int = 24, most: int | None = None, factor: float = 1.25) -> str:
    top = min(x for x in (height, width, most) if x)
    return f"""ladder(scale_idx, scale, win) AS (
    SELECT 0, {least} / 24.0::DOUBLE, round_even(24 * ({least} / 24.0::DOUBLE), 0)::INT
    UNION ALL SELECT scale_idx + 1, scale * {factor}::DOUBLE, round_even(24 * (scale * {factor}::DOUBLE), 0)::INT FROM ladder WHERE round_even(24 * (scale * {factor}::DOUBLE), 0) <= {top})"""


def _grid(height: int, width: int, delta: float) -> str:
    return f"""stepped AS (SELECT *, greatest(1, round_even(scale * {delta}::DOUBLE, 0)::INT)::INT AS step FROM ladder),
grid AS (SELECT scale_idx, scale, win, step, r::INT AS r, c::INT AS c FROM stepped, LATERAL (SELECT unnest(range(0, {height} - win + 1, step)) AS r), LATERAL (SELECT unnest(range(0, {width} - win + 1, step)) AS c))"""


def _stage(stage, x: str = "x") -> str:
    return "(" + " + ".join(f"CASE WHEN {s.polarity} * {x}[{s.feature_id + 1}] < {s.polarity} * {s.threshold}::DOUBLE THEN {s.alpha}::DOUBLE ELSE 0 END" for s in stage.stumps) + ")"


def _stumps(weighted: str, out: str) -> str:
    return f"""{out}_long AS (SELECT sample_id, y, weight, i - 1 AS feature_id, x[i] AS v FROM {weighted}, range(1, 65) q(i)),
{out}_cut AS (SELECT feature_id, v, lead(v) OVER o AS nxt, row_number() OVER o AS pos, sum(CASE WHEN y = 1 THEN weight ELSE 0 END) OVER u AS sp, sum(CASE WHEN y = 1 THEN 0 ELSE weight END) OVER u AS sn,
    sum(CASE WHEN y = 1 THEN weight ELSE 0 END) OVER a AS tp, sum(CASE WHEN y = 1 THEN 0 ELSE weight END) OVER a AS tn FROM {out}_long
    WINDOW o AS (PARTITION BY feature_id ORDER BY v, sample_id), u AS (PARTITION BY feature_id ORDER BY v, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY feature_id)),
{out}_both AS (SELECT *, round(sp + (tn - sn), 12) AS e1, round(sn + (tp - sp), 12) AS e2 FROM {out}_cut),
{out} AS (SELECT feature_id::INT AS feature_id, arg_min(CASE WHEN nxt IS NULL THEN v + 0.5 ELSE 0.5 * (v + nxt) END, (least(e1, e2), pos)) AS threshold,
    arg_min(CASE WHEN e1 < e2 THEN -1 ELSE 1 END, (least(e1, e2), pos))::INT AS polarity, min(least(e1, e2)) AS error FROM {out}_both GROUP BY feature_id)"""


_WEIGHTED = f"{_SAMPLES}, weighted AS (SELECT *, 1.0::DOUBLE / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)) AS weight FROM s)"


def _boosted(rounds: int) -> str:
    parts, weight = [f"{_SAMPLES}, w0 AS (SELECT *, 1.0::DOUBLE / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)) AS weight FROM s)"], "w0"
    for k in range(1, rounds + 1):
        parts.append(f"n{k} AS (SELECT sample_id, y, x, weight / (SELECT sum(weight) FROM {weight}) AS weight FROM {weight})")
        parts.append(_stumps(f"n{k}", f"f{k}"))
        parts.append(f"b{k} AS (SELECT *, least(greatest(error, 1e-10), 1 - 1e-10) AS eps FROM f{k} ORDER BY error, feature_id LIMIT 1)")
        parts.append(f"w{k} AS (SELECT sample_id, y, x, {weight}.weight * CASE WHEN (polarity * x[feature_id + 1] < polarity * threshold) = (y = 1) THEN eps / (1 - eps) ELSE 1 END AS weight FROM {weight}, b{k})")
        weight = f"w{k}"
    rows = " UNION ALL ".join(f"SELECT {k} AS round, feature_id, round(threshold, 9) AS threshold, polarity, round(eps, 9) AS error, round(ln((1 - eps) / eps), 6) AS alpha FROM b{k}" for k in range(1, rounds + 1))
    return f"WITH {', '.join(parts)} {rows}"


def _accepted(model, cfg, frames: str = _FRAMES) -> str:
    """CTEs that end in accepted(img_id, box_id, x, y, w, h)."""
    n = lambda d, s="scale": f"round_even({d} * {s}, 0)::INT"
    place = lambda k: (f"(g.r + {n(k.r)})", f"(g.c + {n(k.c)})", f"greatest(1, {n(k.h)})", f"greatest(1, {n(k.w)})")
    accepted = _judged(model, place, lambda k, value: f"({value}) * norm")
    mean, sq = _window_means("win")
    return f"""{frames}, {_ladder(64, 64, cfg.min_face, factor=cfg.scale_factor)}, {_grid(64, 64, cfg.step_factor)},
rated AS (SELECT t.img_id, t.ii, scale, win, g.r, g.c, greatest(0, {sq} - {mean} * {mean}) AS var FROM t, grid g WHERE g.r + win + 3 < 64 AND g.c + win + 3 < 64),
g AS (SELECT *, 1.0::DOUBLE / (scale * scale * sqrt(var)) AS norm FROM rated WHERE var >= {cfg.flat_variance}),
accepted AS (SELECT img_id, row_number() OVER (PARTITION BY img_id ORDER BY scale, r, c) AS box_id, c AS x, r AS y, win AS w, win AS h FROM g WHERE {accepted})"""


def _window_means(win: str) -> tuple[str, str]:
    """Means of values and of squares of the window at g.r, g.c of table t."""
    s = _rect("g.r", "g.c", win, win, 64)
    area = f"({win} * {win})::DOUBLE"
    return f"({s}::DOUBLE / {area})", f"({s.replace('t.ii[', 't.ii_sq[')}::DOUBLE / {area})"


def _judged(model, place, measure) -> str:
    """Whether all stages of model accept; place gives r, c, h, w of a feature's rectangle, measure its value as compared."""
    conditions = []
    for stage in model:
        terms = [f"CASE WHEN {k.polarity} * ({measure(k, _contrast(str(k.ftype), *place(k), 64))}) < {k.polarity} * {k.threshold}::DOUBLE THEN {k.alpha}::DOUBLE ELSE 0 END" for k in stage.weak]
        conditions.append("(" + " + ".join(terms) + f") >= {stage.threshold}::DOUBLE")
    return " AND ".join(conditions).replace("t.ii[", "g.ii[")


def _mined(model, most: int) -> str:
    """Patches of the frames that model accepts, by hash of the frame, row and column."""
    net = {2: -1, 3: -1}
    place = lambda k: (f"(g.r + {k.r})", f"(g.c + {k.c})", str(k.h), str(k.w))
    accepted = _judged(model, place, lambda k, value: f"(({value}) - {net.get(k.ftype, 0) * k.h * k.w} * mean) / std")
    mean, sq = _window_means("24")
    return f"""WITH {_FRAMES}, places AS (SELECT a.r::INT AS r, b.c::INT AS c FROM range(0, 41, 4) a(r), range(0, 41, 4) b(c)),
rated AS (SELECT t.img_id, t.ii, g.r, g.c, {mean} AS mean, greatest(0, {sq} - {mean} * {mean}) AS var FROM t, places g),
g AS (SELECT *, sqrt(var) AS std FROM rated WHERE var >= 1e-4),
found AS (SELECT img_id, r, c, mean, std, (row_number() OVER (ORDER BY md5('42:' || img_id), img_id, r, c) - 1)::INT AS k FROM g WHERE {accepted}){_PATCH_ENDS.format(most=most)}"""


_PATCH_ENDS = """ SELECT k, img_id, r, c, round((a.v - mean) / std, 6) AS z_first, round((b.v - mean) / std, 6) AS z_last
FROM (SELECT * FROM found WHERE k < {most}) f JOIN fp a USING (img_id, r, c) JOIN fp b ON b.img_id = f.img_id AND b.r = f.r + 23 AND b.c = f.c + 23"""


def _drawn(most: int) -> str:
    """Patches of the frames in mode random."""
    mean, sq = _window_means("24")
    return f"""WITH {_FRAMES}, places AS (SELECT a.r::INT AS r, b.c::INT AS c, a.r * 41 + b.c AS pos FROM range(0, 41) a(r), range(0, 41) b(c)),
rated AS (SELECT t.img_id, g.r, g.c, pos, {mean} AS mean, greatest(0, {sq} - {mean} * {mean}) AS var FROM t, places g),
keyed AS (SELECT *, sqrt(var) AS std, (pos + 1 + t0.img_id % 2147483647 * 7919 % 2147483647 + 42) % 2147483647 * 48271 % 2147483647 AS x FROM rated t0 WHERE var >= 1e-4),
each AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY x * x % 2147483647, pos) AS nth FROM keyed),
found AS (SELECT *, (row_number() OVER (ORDER BY md5('42:' || img_id), img_id, nth) - 1)::INT AS k FROM each
    WHERE nth <= greatest(1, {most} // greatest(1, (SELECT count(*) FROM t) // 2))){_PATCH_ENDS.format(most=most)}"""


def _resized(height: int, width: int, method: str) -> str:
    """The frames in another size, by the weight of each source pixel in each target pixel."""
    if method == "area":
        weight = lambda at, into: f"greatest(0, least((i + 1) * 64 / {into}::DOUBLE, {at} + 1) - greatest(i * 64 / {into}::DOUBLE, {at}))"
    else:
        centre = lambda into: f"greatest(0, least(63, (i + 0.5::DOUBLE) * 64 / {into}::DOUBLE - 0.5::DOUBLE))"
        weight = lambda at, into: f"greatest(0, 1 - abs({centre(into)} - {at}))"
    side = lambda name, into: f"{name} AS (SELECT i::INT AS i, pos::INT AS pos, {weight('pos', into)} AS share FROM range(0, {into}) x(i), range(0, 64) y(pos) WHERE {weight('pos', into)} > 0)"
    return f"""WITH {_PIXELS}, {side("down", height)}, {side("across", width)}
SELECT img_id, d.i AS r, a.i AS c, round(sum(v * d.share * a.share) / sum(d.share * a.share), 6) AS v FROM fp JOIN down d ON fp.r = d.pos JOIN across a ON fp.c = a.pos GROUP BY img_id, d.i, a.i"""


_EQUALISED = f"""{_PIXELS.replace("fp AS MATERIALIZED (", "raw AS MATERIALIZED (", 1)}, counted AS (SELECT img_id, v, count(*) AS n FROM raw GROUP BY ALL),
below AS (SELECT img_id, v, sum(n) OVER (PARTITION BY img_id ORDER BY v) AS below, sum(n) OVER (PARTITION BY img_id) AS total FROM counted),
lut AS (SELECT *, min(below) OVER (PARTITION BY img_id) AS first FROM below),
fp AS MATERIALIZED (SELECT img_id, r, c, CASE WHEN total = first THEN v ELSE round_even((below - first) * 255.0::DOUBLE / (total - first)::DOUBLE, 0)::BIGINT END AS v FROM raw JOIN lut USING (img_id, v)), {_FRAME_TABLES}"""


def _faceless(model, cfg, neighbours: int) -> str:
    """Frames without a group of more than neighbours similar accepted windows."""
    return f"""WITH RECURSIVE {_accepted(model, cfg, _EQUALISED)},
hits AS MATERIALIZED (SELECT * FROM accepted), e AS MATERIALIZED (SELECT a.img_id, a.box_id AS a, b.box_id AS b FROM hits a JOIN hits b ON a.img_id = b.img_id AND {_similar("a", "b", 0.2)}),
reach(img_id, a, b) AS (SELECT * FROM e UNION SELECT r.img_id, r.a, e.b FROM reach r JOIN e ON e.img_id = r.img_id AND e.a = r.b),
found AS (SELECT img_id FROM reach GROUP BY img_id, a HAVING count(*) > {neighbours})
SELECT DISTINCT img_id FROM fp WHERE img_id NOT IN (SELECT img_id FROM found)"""


_KEYPOINTS = """points AS (SELECT 'img_' || (l_orderkey // 4) || '.gif' AS filename, (l_partkey % 97)::DOUBLE AS lx, (l_suppkey % 89)::DOUBLE + 0.5 AS ly, (l_suppkey % 83)::DOUBLE AS rx, (l_partkey % 79)::DOUBLE + 0.25 AS ry
    FROM lineitem WHERE l_linenumber > 3)"""


def _similar(a: str, b: str, eps: float) -> str:
    edges = [("x", "w", ""), ("y", "h", ""), ("x", "w", "w"), ("y", "h", "h")]
    return " AND ".join(f"abs({a}.{p}{f' + {a}.{q}' if q else ''} - {b}.{p}{f' - {b}.{q}' if q else ''}) <= {eps}::DOUBLE * least({a}.{s}, {b}.{s})" for p, s, q in edges)


def _oracles() -> dict[str, str]:
    from lumigrid.operators.boost import Strong, Stump
    from lumigrid.operators.cascade import DetectorConfig, Stage, Weak

    model = [
        Stage((Weak(0, 0, 0, 24, 12, 150.0, 1, 1.0), Weak(1, 0, 0, 12, 24, -40.0, -1, 0.8)), 0.8),
        Stage((Weak(2, 4, 0, 12, 8, 30.0, -1, 0.9), Weak(4, 0, 0, 12, 12, 60.0, 1, 0.7), Weak(3, 0, 4, 8, 12, 0.0, 1, 0.4)), 0.9),
    ]
    cfg = DetectorConfig(threshold=0.3, min_votes=2)
    one = Strong((Stump(5, 0.05, 1, 0.7), Stump(17, -0.02, -1, 0.5)), 0.5)
    two = Strong((Stump(40, 0.01, 1, 0.6), Stump(2, 0.0, -1, 0.6), Stump(61, 0.03, 1, 0.3)), 0.6)
    passed = f"{_SAMPLES}, passed AS (SELECT sample_id, y, CASE WHEN {_stage(one)} < {one.threshold} THEN 0 WHEN {_stage(two)} < {two.threshold} THEN 1 ELSE 2 END AS passed FROM s)"
    moments = f"{_PX}, m AS (SELECT *, sum(v) OVER w / count(*) OVER w AS mean, greatest(0, sum(v * v) OVER w / count(*) OVER w - (sum(v) OVER w / count(*) OVER w) * (sum(v) OVER w / count(*) OVER w)) AS var FROM px WINDOW w AS (PARTITION BY img_id))"
    variance = f"""{_TABLES}, var AS (SELECT img_id, r::INT AS r, c::INT AS c, greatest(0, {_rect("r", "c", "4", "4", 8).replace("t.ii[", "t.ii_sq[")}::DOUBLE / 16 - ({_rect("r", "c", "4", "4", 8)}::DOUBLE / 16) * ({_rect("r", "c", "4", "4", 8)}::DOUBLE / 16)) AS var
        FROM t, range(0, 5, 2) a(r), range(0, 5, 2) b(c))"""
    rects = ", ".join(f"({k}, {r}, {c}, {h}, {w})" for k, (r, c, h, w) in enumerate([(0, 0, 8, 8), (0, 0, 4, 4), (2, 3, 3, 4), (7, 7, 1, 1), (1, 0, 1, 8)]))
    scored = f"{_SAMPLES}, scored AS (SELECT sample_id, y, round({_stage(one)}, 9) AS score FROM s)"
    refill = f"""{passed}, hard AS (SELECT sample_id FROM passed WHERE y = 0 AND passed = 2),
        drawn AS (SELECT sample_id, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) AS k FROM s WHERE y = 0)"""
    numbered = "SELECT {key}, row_number() OVER (ORDER BY md5('42:' || {key}), {key}) - 1 AS position FROM {rows}"
    edge = lambda lo, size, sign: f"round_even({lo} + {size} / 2.0::DOUBLE {sign} {size} * 1.5::DOUBLE / 2.0::DOUBLE, 0)::INT"
    strides = "strides AS (SELECT label, CASE WHEN count(*) * 21 <= 1000 THEN 3 WHEN count(*) * 21 <= 3000 THEN 2 ELSE 1 END AS stride FROM embeddings GROUP BY label)"
    sized = "sized AS (SELECT p_partkey AS img_id, (20 + p_size * 2)::INT AS h, (24 + p_partkey % 41 * 3)::INT AS w FROM part)"
    return {
        "gray_pixels": f"WITH {_PX} SELECT img_id, r, c, round_even((114 * v + 587 * coalesce(lead(v, 1) OVER w, 0) + 299 * coalesce(lead(v, 2) OVER w, 0)) / 1000.0::DOUBLE, 0)::BIGINT AS gray FROM px WINDOW w AS (PARTITION BY img_id, r ORDER BY c)",
        "variance_normalize": f"WITH {moments} SELECT img_id, r, c, round(CASE WHEN sqrt(var) < 1e-6 THEN 0 ELSE (v - mean) / nullif(sqrt(var), 0) END, 6) AS za, CASE WHEN var >= 1e-4 THEN round((v - mean) / sqrt(var), 6) END AS zb FROM m",
        "minmax_quantize": f"WITH {_PX}, m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY img_id)) SELECT img_id, r, c, CASE WHEN hi - lo < 1e-6 THEN 0 ELSE trunc((v - lo) / (hi - lo)::DOUBLE * 255)::INT END AS q FROM m",
        "area_downscale": f"WITH {_PX} SELECT img_id, (r // 2)::INT AS r, (c // 2)::INT AS c, avg(v) AS v FROM px GROUP BY ALL",
        "histogram_equalize": f"""WITH {_PX}, n AS (SELECT img_id, v, count(*) AS n FROM px GROUP BY ALL), b AS (SELECT img_id, v, sum(n) OVER (PARTITION BY img_id ORDER BY v) AS below, sum(n) OVER (PARTITION BY img_id) AS total FROM n),
            f AS (SELECT *, min(below) OVER (PARTITION BY img_id) AS first FROM b)
            SELECT px.img_id, px.r, px.c, CASE WHEN total = first THEN px.v ELSE round_even((below - first) * 255.0::DOUBLE / (total - first)::DOUBLE, 0)::BIGINT END AS e FROM px JOIN f ON px.img_id = f.img_id AND px.v = f.v""",
        "integral_image": f"WITH {_PX}, {_IIW} SELECT img_id, r, c, ii FROM ii",
        "integral_image_sq": f"WITH {_PX}, {_IIW} SELECT img_id, r, c, ii_sq FROM ii",
        "rect_sum": f"WITH {_PX}, rects(rect_id, r, c, h, w) AS (VALUES {rects}) SELECT img_id, rect_id, sum(v)::BIGINT AS total, sum(v * v)::BIGINT AS total_sq FROM px JOIN rects q ON px.r >= q.r AND px.r < q.r + q.h AND px.c >= q.c AND px.c < q.c + q.w GROUP BY img_id, rect_id",
        "window_variance": f"WITH {variance} SELECT img_id, r, c, round(var, 6) AS var FROM var",
        "flat_patch_filter": f"WITH {variance} SELECT img_id, count(*) FILTER (round(var, 6) / 100 >= 50) AS texture, count(*) FILTER (round(var, 6) / 100 >= 10) AS detector, count(*) FILTER (round(var, 6) / 100 >= 1e-4) AS cascade FROM var GROUP BY img_id",
        "haar_enumerate": f"WITH {strides} " + " UNION ALL ".join(f"(WITH {_features(12, s)} SELECT label, stride, features.* FROM strides, features WHERE stride = {s})" for s in (1, 2, 3)),
        "haar_type_counts": f"WITH {strides} " + " UNION ALL ".join(f"(WITH {_features(24, s)} SELECT label, stride, ftype, count(*) AS n FROM strides, features WHERE stride = {s} GROUP BY ALL)" for s in (1, 2, 3)),
        "haar_stride_adaptive": "SELECT label, n_pos, CASE WHEN n_pos <= 1000 THEN 3 WHEN n_pos <= 3000 THEN 2 ELSE 1 END AS stride FROM (SELECT label, count(*) * 21 AS n_pos FROM embeddings GROUP BY label)",
        "scale_ladder": f"WITH RECURSIVE {sized}, {_ladder(200, 200)} SELECT * FROM sized JOIN ladder ON win <= least(h, w)",
        "window_grid": f"""WITH RECURSIVE {sized}, {_ladder(200, 200)}, s AS (SELECT *, greatest(1, round_even(scale * 1.5::DOUBLE, 0)::INT)::INT AS step FROM sized JOIN ladder ON win <= least(h, w))
            SELECT img_id, scale_idx, win, step, ((h - win) // step + 1) * ((w - win) // step + 1)::BIGINT AS n, ((h - win) // step * step)::INT AS last_r, ((w - win) // step * step)::INT AS last_c FROM s""",
        "detector_windows": f"""WITH RECURSIVE {sized}, {_ladder(200, 200, 60, 90)}, s AS (SELECT *, greatest(1, round_even(scale * 3.0::DOUBLE, 0)::INT)::INT AS step FROM sized JOIN ladder ON win <= least(h, w, 90))
            SELECT img_id, scale_idx, win, step, r::INT AS r, c::INT AS c FROM s, LATERAL (SELECT unnest(range(0, h - win + 1, step)) AS r), LATERAL (SELECT unnest(range(0, w - win + 1, step)) AS c) WHERE r + win + 3 < h AND c + win + 3 < w""",
        "haar_feature_values": f"WITH {_TABLES}, {_features(8, 3)} SELECT img_id, feature_id, ({_contrast('ftype', 'f.r', 'f.c', 'f.h', 'f.w', 8)})::FLOAT AS val FROM t, features f",
        "haar_feature_at_scale": f"WITH {_FRAMES}, {_features(8, 3)}, f AS (SELECT feature_id, ftype, 7 + round_even(r * 2.5, 0)::INT AS r, 11 + round_even(c * 2.5, 0)::INT AS c, greatest(1, round_even(h * 2.5, 0)::INT) AS h, greatest(1, round_even(w * 2.5, 0)::INT) AS w FROM features) SELECT img_id, feature_id, ({_contrast('ftype', 'f.r', 'f.c', 'f.h', 'f.w', 64)})::DOUBLE AS val FROM t, f",
        "weights_init": f"WITH {_WEIGHTED} SELECT sample_id, y, round(weight, 12) AS weight FROM weighted",
        "stump_best_threshold": f"WITH {_WEIGHTED}, {_stumps('weighted', 'f')} SELECT feature_id, round(threshold, 9) AS threshold, polarity, round(error, 9) AS error FROM f",
        "stump_best_feature": f"WITH {_WEIGHTED}, {_stumps('weighted', 'f')} SELECT feature_id, round(threshold, 9) AS threshold, polarity, round(error, 9) AS error FROM f ORDER BY f.error, feature_id LIMIT 1",
        "adaboost_rounds": _boosted(3),
        "strong_score": f"WITH {scored} SELECT * FROM scored",
        "strong_classify": f"WITH {_SAMPLES} SELECT sample_id, y, ({_stage(one)} >= {one.threshold})::INT AS predicted FROM s",
        "confusion_metrics": f"""WITH {_SAMPLES}, p AS (SELECT y, ({_stage(one)} >= {one.threshold})::INT AS p FROM s),
            c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM p)
            SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS dr, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c""",
        "threshold_for_dr": f"""WITH {scored}, c AS (SELECT a.score AS threshold, count(*) FILTER (b.y = 1) / (SELECT count(*) FROM scored WHERE y = 1) AS dr, count(*) FILTER (b.y = 0) / (SELECT count(*) FROM scored WHERE y = 0) AS fpr
            FROM (SELECT DISTINCT score FROM scored WHERE y = 1) a JOIN scored b ON b.score >= a.score GROUP BY a.score) SELECT * FROM c ORDER BY dr >= 0.8 DESC, threshold DESC LIMIT 1""",
        "cascade_predict": f"WITH {passed} SELECT sample_id, y, (passed = 2)::INT AS predicted FROM passed",
        "cascade_stage_survivors": f"WITH {passed} SELECT y, q.stage::INT AS stage, count(*) AS n FROM passed, range(0, 3) q(stage) WHERE q.stage <= passed GROUP BY ALL",
        "cascade_growth_schedule": """WITH RECURSIVE g(attempt, n) AS (SELECT 0, 2 UNION ALL SELECT attempt + 1, CASE WHEN n < 10 THEN n * 2 WHEN n < 30 THEN trunc(n * 1.5)::INT WHEN n < 100 THEN n + 25 ELSE n + 50 END FROM g WHERE n < 2000)
            SELECT p_partkey, (p_size * 9)::INT AS most, attempt, n FROM part JOIN g ON n < p_size * 9""",
        "hard_negatives": f"WITH {passed} SELECT sample_id FROM passed WHERE y = 0 AND passed = 2",
        "hnm_fallback": f"WITH {refill} SELECT sample_id, 'hard' AS origin FROM hard UNION ALL SELECT sample_id, 'refill' FROM drawn WHERE (SELECT count(*) FROM hard) < 400 AND k <= 450 - (SELECT count(*) FROM hard)",
        "box_iou": f"WITH {_BOXES_ONCE}, pairs AS MATERIALIZED (SELECT a.img_id, a, b FROM boxes a JOIN boxes b ON a.img_id = b.img_id) SELECT img_id, a.box_id AS a_id, b.box_id AS b_id, round({_iou('a', 'b')}, 9) AS iou FROM pairs WHERE a.box_id < b.box_id AND {_inter('a', 'b')} > 0",
        "box_iom_votes": f"WITH {_BOXES} SELECT a.img_id, a.box_id, count(*) FILTER ({_iom('a', 'b')} > 0.3) AS votes FROM boxes a JOIN boxes b ON a.img_id = b.img_id GROUP BY a.img_id, a.box_id",
        "nms_vote_merge": f"WITH RECURSIVE {_BOXES}, {_merge('boxes', 0.3, 3)} SELECT * FROM merged",
        "nms_scored": f"""WITH RECURSIVE {_BOXES}, ordered AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY score DESC, box_id) AS k FROM boxes),
            led(img_id, k, leaders) AS (SELECT img_id, k, [STRUCT_PACK(box_id := box_id, x := x, y := y, w := w, h := h, score := score)] FROM ordered WHERE k = 1
            UNION ALL SELECT o.img_id, o.k, CASE WHEN len(list_filter(led.leaders, lambda q: {_iou('q', 'o')} > 0.3)) > 0 THEN led.leaders ELSE list_append(led.leaders, STRUCT_PACK(box_id := o.box_id, x := o.x, y := o.y, w := o.w, h := o.h, score := o.score)) END
            FROM led JOIN ordered o ON o.img_id = led.img_id AND o.k = led.k + 1), final AS (SELECT img_id, unnest(arg_max(leaders, k)) AS b FROM led GROUP BY img_id)
            SELECT img_id, b.box_id, b.x, b.y, b.w, b.h, b.score FROM final""",
        "group_rectangles": f"""WITH RECURSIVE {_BOXES}, e AS MATERIALIZED (SELECT a.img_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.img_id = b.img_id AND {_similar('a', 'b', 0.3)}),
            reach(img_id, a, b) AS (SELECT * FROM e UNION SELECT r.img_id, r.a, e.b FROM reach r JOIN e ON e.img_id = r.img_id AND e.a = r.b),
            c AS (SELECT img_id, a AS box_id, min(b) AS group_id FROM reach GROUP BY img_id, a)
            SELECT img_id, group_id, round_even(avg(x), 0)::INT AS x, round_even(avg(y), 0)::INT AS y, round_even(avg(w), 0)::INT AS w, round_even(avg(h), 0)::INT AS h, count(*) AS n FROM c JOIN boxes USING (img_id, box_id) GROUP BY img_id, group_id HAVING count(*) >= 2""",
        "merge_overlapping": f"""WITH RECURSIVE {_BOXES}, part_of AS (SELECT *, count(*) OVER (PARTITION BY img_id) AS c FROM boxes), many AS (SELECT * FROM part_of WHERE c > 1), {_merge('many', 0.5, 3)}
            SELECT * FROM merged UNION ALL SELECT img_id, 0, x::INT, y::INT, w::INT, h::INT, 1 FROM part_of WHERE c = 1""",
        "box_expand_clip": f"""WITH {_BOXES}, g AS (SELECT img_id, box_id, greatest(0, {edge('x', 'w', '-')}) AS x1, greatest(0, {edge('y', 'h', '-')}) AS y1, least(190, {edge('x', 'w', '+')}) AS x2, least(180, {edge('y', 'h', '+')}) AS y2 FROM boxes)
            SELECT * FROM g WHERE x2 - x1 >= 4 AND y2 - y1 >= 4""",
        "box_restore_coords": f"WITH {_BOXES} SELECT img_id, box_id, trunc(x * (640.0::DOUBLE / 480))::INT AS x, trunc(y * 1.7::DOUBLE)::INT AS y, trunc(w * (640.0::DOUBLE / 480))::INT AS w, trunc(h * 1.7::DOUBLE)::INT AS h FROM boxes",
        "eye_midpoint_match": f"WITH {_BOXES_ONCE}, pairs AS MATERIALIZED (SELECT p.img_id, p.box_id AS point_id, (p.x * 7 + 20) % 180 AS px, (p.y * 5 + 10) % 180 AS py, b FROM boxes p JOIN boxes b ON p.img_id = b.img_id) SELECT img_id, point_id, b.box_id AS box_id FROM pairs WHERE px BETWEEN b.x AND b.x + b.w AND py BETWEEN b.y AND b.y + b.h",
        "annotation_waterfall": f"WITH {_ANNOTATIONS} SELECT CASE WHEN pose <> 0 THEN 'pose' WHEN occlusion <> 0 THEN 'occlusion' WHEN blur <> 0 THEN 'blur' WHEN invalid <> 0 THEN 'invalid' WHEN w < 40 OR h < 40 THEN 'size' ELSE 'kept' END AS reason, count(*) AS n FROM annotations GROUP BY 1",
        "anti_join_category": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
        "keypoint_parse": f"WITH {_KEYPOINTS} SELECT *, (lx + rx) / 2 AS cx, (ly + ry) / 2 AS cy FROM points",
        "annotation_reconcile": f"WITH {_KEYPOINTS} SELECT 'img_' || o_orderkey || '.jpg' AS image, count(filename)::INT AS n_faces FROM orders LEFT JOIN points ON filename = 'img_' || o_orderkey || '.gif' GROUP BY o_orderkey",
        "annotation_json_summary": f"WITH {_KEYPOINTS} SELECT count(DISTINCT filename) AS total_images, count(*) AS total_faces FROM points",
        "grouped_text_parse": f"WITH {_ANNOTATIONS} SELECT split_part(img_rel_path, '/', 1) AS file, img_rel_path, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h, blur, 0 AS expression, 1 AS illumination, occlusion, pose, invalid FROM annotations",
        "annotation_envelopes": f"""WITH {_KEYPOINTS} SELECT filename, 'test/' || filename AS image_path, count(*) AS n_faces, round(sum((lx + rx) / 2), 6) AS sum_x,
            (SELECT count(DISTINCT filename) FROM points) AS total_images, (SELECT count(*) FROM points) AS total_faces FROM points GROUP BY filename""",
        "category_scan": """SELECT path, split, category, row_number() OVER (ORDER BY md5('42:' || path), path) - 1 AS position FROM (
            SELECT DISTINCT 'data/' || l_linestatus || '/' || l_returnflag || '/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || CASE l_linenumber WHEN 5 THEN '.JPEG' ELSE '.jpg' END AS path,
            l_linestatus AS split, l_returnflag AS category FROM lineitem WHERE l_linenumber <> 6)""",
        "face_list_pieces": f"WITH {_ANNOTATIONS} SELECT split_part(img_rel_path, '/', 1) AS file, img_rel_path, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h, blur, 0 AS expression, 1 AS illumination, occlusion, pose, invalid FROM annotations",
        "appended_names": " UNION ALL ".join(
            f"SELECT '{rows}' AS origin, {key} AS id, 'neg_' || lpad((position + {before})::VARCHAR, 5, '0') AS name FROM ({numbered.format(key=key, rows=rows)})"
            for rows, key, before in (("supplier", "s_suppkey", "0"), ("customer", "c_custkey", "(SELECT count(*) FROM supplier)"))
        ),
        "integral_mosaic": f"""WITH {_PX}, p AS (SELECT img_id // 64 AS tr, img_id % 64 AS tc, img_id // 64 * 8 + r AS y, img_id % 64 * 8 + c AS x, r, c, v FROM px),
            a AS (SELECT *, sum(v) OVER (PARTITION BY y ORDER BY x) AS s, sum(v * v) OVER (PARTITION BY y ORDER BY x) AS q FROM p),
            l AS (SELECT DISTINCT y, last_value(s) OVER w AS s, last_value(q) OVER w AS q, max(x) OVER w AS x FROM a WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
            i AS (SELECT tr, tc, r, c, sum(s) OVER w AS ii, sum(q) OVER w AS ii_sq FROM a WINDOW w AS (PARTITION BY x ORDER BY y))
            SELECT tr::INT AS tr, tc::INT AS tc, max(CASE WHEN r = 0 AND c = 0 THEN ii END)::BIGINT AS ii_first, max(CASE WHEN r = 7 AND c = 7 THEN ii END)::BIGINT AS ii_last, max(CASE WHEN r = 1 AND c = 4 THEN ii_sq END)::BIGINT AS ii_sq_13 FROM i GROUP BY tr, tc""",
        "seeded_split": f"SELECT p_partkey, CASE WHEN position < 900 THEN 'train' ELSE 'val' END AS split, 'face_' || lpad((CASE WHEN position < 900 THEN position ELSE position - 900 END)::VARCHAR, 5, '0') AS name FROM ({numbered.format(key='p_partkey', rows='part')}) WHERE position < 1300",
        "index_continuation": f"SELECT c_custkey, 'neg_' || lpad((position + 1 + (SELECT max(s_suppkey) FROM supplier))::VARCHAR, 5, '0') || '.jpg' AS name FROM ({numbered.format(key='c_custkey', rows='customer')})",
        "category_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        "union_training_set": f"WITH {_SAMPLES} SELECT sample_id, y FROM s",
        "topk_paths": "SELECT 'page_' || page_id || '.png' AS path FROM pages ORDER BY path LIMIT 20",
        "image_stats": f"WITH {_PX} SELECT img_id, min(v) AS lo, max(v) AS hi, round(avg(v), 9) AS mean, round(stddev_pop(v), 6) AS std FROM px GROUP BY img_id",
        "frame_decimation": """WITH f AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events)
            SELECT user_id, event_id, frame::INT AS frame, frame % 2 = 0 AS taken, last_value(CASE WHEN frame % 2 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown FROM f""",
        "rate_window": "SELECT date_trunc('second', ts) AS start, count(*) AS frames, count(*) / 1.0::DOUBLE AS fps FROM events GROUP BY 1",
        "accepted_windows": f"WITH RECURSIVE {_accepted(model, cfg)} SELECT * FROM accepted",
        "resize_area": _resized(24, 24, "area"),
        "resize_bilinear": _resized(36, 48, "bilinear"),
        "mined_patches": _mined(model, 60),
        "mined_by_column": f"SELECT k, img_id, r, c, z_first, z_last FROM ({_mined([Stage((Weak(0, 0, 0, 24, 12, 60.0, 1, 1.0),), 1.0)], 50)})",
        "random_patches": _drawn(30),
        "faceless_frames": _faceless([Stage((Weak(0, 0, 0, 24, 12, -60.0, 1, 1.0),), 1.0)], replace(cfg, scale_factor=1.05, min_face=20), 2),
        "detect_frames": f"WITH RECURSIVE {_accepted(model, cfg)}, {_merge('accepted', cfg.threshold, cfg.min_votes)} SELECT * FROM merged",
    }


ORACLES = _oracles()
