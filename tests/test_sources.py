"""Face lists in pieces, numbered appends, the frame source, tiled tables, and files of annotations."""

import json
import os
import random
import struct
import threading

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumigrid.operators import cascade, dataset, images, tiled
from lumigrid.operators.cascade import DetectorConfig, Stage, Weak
from lumigrid.session import new_folder
from lumigrid.sources import appends, face_lists, models, parsers
from lumigrid.streaming import video

FACE = "{} 2 30 40 0 1 0 0 0 0"
TEXT = "\n".join(["a/one.jpg", "2", FACE.format(1), FACE.format(-2) + " 99 x", "b/none.jpg", "0", "0 0 0 0 0 0 0 0 0 0", "c/odd.jpg", "many", "d/short.jpg", " 3 ", "1 2 3", FACE.format("x"), FACE.format(7), "e/less.jpg", "-4", "f/five.jpg", "5", *(FACE.format(k) for k in range(5)), "g/cut.jpg", "9", FACE.format(8), FACE.format(9)])


def serial(text):
    """Line by line, as the format is described."""
    lines, at, out = text.split("\n"), 0, []
    while at < len(lines):
        path, at = lines[at].strip(), at + 1
        if at >= len(lines):
            break
        try:
            n = int(lines[at].strip())
        except ValueError:
            at += 1
            continue
        at += 1
        if n == 0:
            at += 1
            continue
        for _ in range(n):
            if at >= len(lines):
                break
            parts, at = lines[at].split(), at + 1
            if len(parts) >= 10:
                try:
                    out.append((path, *map(int, parts[:10])))
                except ValueError:
                    continue
    return out


def test_pieces_cut_anywhere_compose_to_the_serial_parse():
    """Without Spark: every cut in two, and random cuts in many, by the tables of states."""
    rng = random.Random(1)
    texts = [TEXT] + ["\n".join(rng.choice(["p.jpg", "0", "1", "2", "3", "12", "-1", "x", FACE.format(4), "1 2"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    for text in texts:
        lines, want = text.split("\n"), serial(text)
        assert face_lists.faces(lines, 0, None)[0] == want
        cuts = [[k] for k in range(len(lines) + 1)] + [sorted(rng.randrange(len(lines) + 1) for _ in range(rng.randrange(1, 8))) for _ in range(5)]
        for cut in cuts:
            parts = [lines[a:b] for a, b in zip([0, *cut], [*cut, len(lines)])]
            state, path, got = np.array([0]), None, []
            for part in parts:
                table, count, placeholder = face_lists.ends([face_lists.number(x) for x in part])
                found, end, now = face_lists.faces(part, int(state[0]), None)
                got += [(path if row[0] is None else row[0], *row[1:]) for row in found]
                path = now or path
                state = face_lists.step(state, len(part), table, count, placeholder)
                assert state[0] == end
            assert got == want


@pytest.mark.parametrize("group,together", [(64, 1 << 24), (2, 1 << 24), (3, 0)])
def test_face_lists_over_many_tasks(spark, monkeypatch, group, together):
    monkeypatch.setattr(face_lists, "_TABLES", together)
    rng = random.Random(group)
    texts = {"f": TEXT, "g": "\n".join([TEXT] * 3), "lone": "only.jpg", "huge": "p.jpg\n999999999\n" + FACE.format(1)}
    rows = []
    for file, text in texts.items():
        lines = text.split("\n")
        cut = sorted(rng.sample(range(1, len(lines)), min(len(lines) - 1, 9)))
        rows += [(file, a // 5, a % 5, lines[a:b], "clash", 7) for a, b in zip([0, *cut], [*cut, len(lines)])]
    pieces = spark.createDataFrame(rows, "file string, start long, part int, lines array<string>, state string, size int").repartition(6)
    got = sorted(map(tuple, face_lists.parse_pieces(pieces, group).collect()))
    assert got == sorted((file, *row) for file, text in texts.items() for row in serial(text))
    assert face_lists.parse_pieces(pieces.where("false")).collect() == []


def test_one_file_is_read_by_several_tasks(spark):
    text = "\n".join(f"{k}/{TEXT}" for k in range(400))
    folder = new_folder(spark, "lists").removeprefix("file://")
    os.makedirs(folder)
    with open(f"{folder}/all.txt", "w") as f:
        f.write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(text) // 5))
    try:
        pieces = face_lists.read_pieces(spark, f"file://{folder}/all.txt", 3000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pieces.select("start").distinct().count() >= 5
    got = sorted(tuple(r)[1:] for r in face_lists.parse_pieces(pieces, 8).collect())
    assert got == sorted(serial(text))


def names_of(spark, folder):
    return sorted((r.name, r.origin, r.id) for r in appends.read_rows(spark, folder).collect())


def test_writers_leave_no_gap_and_no_overwrite(spark):
    folder = new_folder(spark, "numbered")
    rows = lambda origin, n: spark.range(n).withColumn("origin", F.lit(origin))
    with pytest.raises(ValueError):
        appends.read_rows(spark, folder)
    assert appends.append_rows(rows("first", 7), folder, "id") == (0, 7)
    failing = rows("bad", 5).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("copy failed")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="copy failed"):
        appends.append_rows(failing, folder, "id")
    assert appends.next_number(spark, folder) == 7
    claimed, errors = [], []

    def add(origin, n):
        try:
            claimed.append((origin, *appends.append_rows(rows(origin, n), folder, "id")))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    writers = [threading.Thread(target=add, args=(f"w{k}", k + 1)) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors and appends.append_rows(rows("none", 0), folder, "id") == (17, 0)
    got = names_of(spark, folder)
    assert [n for n, _, _ in got] == [f"neg_{k:05d}" for k in range(17)]
    by_origin = {o: sorted(int(n[4:]) for n, origin, _ in got if origin == o) for o in {g[1] for g in got}}
    assert all(by_origin[o] == list(range(first, first + n)) for o, first, n in claimed) and by_origin["first"] == list(range(7))
    left = [n for n in os.listdir(folder.removeprefix("file://")) if n.startswith("data-")]
    assert len(left) == 5


def test_a_slower_writer_claims_again(spark, monkeypatch):
    folder = new_folder(spark, "numbered")
    appends.append_rows(spark.range(3), folder, "id")
    seen, real = [], appends.entries

    def late(s, f):
        found = real(s, f)
        seen.append(len(found))
        if len(seen) == 1:  # another writer is faster between reading and claiming
            monkeypatch.setattr(appends, "entries", real)
            appends.append_rows(spark.range(2), folder, "id")
            monkeypatch.setattr(appends, "entries", late)
        return found

    monkeypatch.setattr(appends, "entries", late)
    assert appends.append_rows(spark.range(4), folder, "id") == (5, 4) and seen == [1, 2]
    monkeypatch.setattr(appends, "entries", real)
    assert sorted(r.number for r in appends.read_rows(spark, folder).collect()) == list(range(9))


MODEL = [Stage((Weak(0, 0, 0, 24, 12, -5.0, 1, 1.0),), 1.0)]


def test_detection_over_the_frame_source_restarts(spark):
    """Frames of a camera, the first read of each failing, one lost for good; settings change while it runs."""
    folder = new_folder(spark, "camera").removeprefix("file://")
    os.makedirs(folder)
    rng = np.random.default_rng(3)
    pictures = {k: np.kron(rng.integers(0, 256, (4, 5)), np.ones((12, 12))).astype(int) for k in range(9)}

    def shoot(*numbers):
        for k in numbers:
            with open(f"{folder}/{k}.json", "w") as f:
                json.dump(pictures[k].tolist(), f)

    def grab(k):
        if k == 6:
            raise OSError("lost")
        marker = f"{folder}/{k}.tried"
        if not os.path.exists(marker):
            open(marker, "w").close()
            raise OSError("not yet")
        with open(f"{folder}/{k}.json") as f:
            rows = json.load(f)
        return len(rows), len(rows[0]), [v for row in rows for v in row]

    count = lambda: sum(n.endswith(".json") for n in os.listdir(folder))
    spark.dataSource.register(video.frame_source("test_camera", count, grab, frames_per_task=2, tries=3, wait=0.01))
    checkpoint, seen, settings, faces = new_folder(spark, "progress"), [], {"min_votes": 1}, []

    def sink(found, batch_id):
        seen.extend((batch_id, *r) for r in found.collect())

    def detector(batch, **live):
        faces.extend(map(tuple, video.stats(batch, cascade.detect(batch, MODEL, DetectorConfig())).collect()))
        return cascade.detect(batch, MODEL, cascade.adjusted(DetectorConfig(), **live))

    def run():
        frames = spark.readStream.format("test_camera").load()
        q = video.detect_stream(frames, detector, sink, checkpoint, lambda: settings)
        q.processAllAvailable()
        q.stop()

    shoot(*range(4))
    run()
    settings["min_votes"] = 4
    shoot(*range(4, 9))
    run()
    assert sorted({b for b, *_ in seen}) == [0, 1]
    for batch_id, numbers, votes in ((0, range(4), 1), (1, [4, 5, 7, 8], 4)):
        data = spark.createDataFrame([(k, *pictures[k].shape, pictures[k].ravel().tolist()) for k in numbers], video.FRAME)
        want = cascade.detect(data, MODEL, DetectorConfig(min_votes=votes)).collect()
        assert sorted(row[1:] for row in seen if row[0] == batch_id) == sorted(map(tuple, want)) and want
    assert sorted(f[0] for f in faces) == list(range(9)) and (6, 0, 0, 0) in faces


def test_tiled_tables_are_those_of_the_whole_image(spark):
    rng = np.random.default_rng(2)
    heights, widths, rows, pictures = (3, 5, 2), (4, 1, 6, 2), [], {}
    for img in (1, 2):
        v = pictures[img] = rng.integers(0, 256, (sum(heights), sum(widths)))
        for a, h in enumerate(heights):
            for b, w in enumerate(widths):
                r, c = sum(heights[:a]), sum(widths[:b])
                rows.append((img, a, b, h, w, v[r : r + h, c : c + w].ravel().tolist(), "clash"))
    frame = spark.createDataFrame(rows, "img_id long, tr int, tc int, h int, w int, px array<int>, rows string").repartition(5)
    for r in tiled.integral_tiles(frame).collect():
        v, y, x = pictures[r.img_id].astype(float), sum(heights[: r.tr]), sum(widths[: r.tc])
        for got, whole in ((r.ii, v.cumsum(0).cumsum(1)), (r.ii_sq, (v * v).cumsum(0).cumsum(1))):
            assert np.allclose(got, whole[y : y + r.h, x : x + r.w].ravel())
    assert tiled.integral_tiles(frame.where("false")).collect() == []


def test_envelopes_have_totals(spark):
    rows = [(f"f{k}.gif", [([1.0 * k, 2.0], [3.0, 4.0], [2.0 * k, 3.0])] * (k % 3)) for k in range(25)]
    kind = "filename string, faces array<struct<left_eye:array<double>,right_eye:array<double>,eye_midpoint:array<double>>>"
    folder = new_folder(spark, "envelopes")
    models.envelopes(spark.createDataFrame(rows, kind), "test", "point in box", per=4).write.text(folder)
    read = parsers.read_summary(spark, spark.read.text(folder))
    assert {(r.total_images, r.total_faces, r.eval_criterion) for r in read.collect()} == {(25, sum(k % 3 for k in range(25)), "point in box")} and read.count() > 3
    flat = parsers.flatten_summary(read).collect()
    assert sorted((r.filename, r.image_path, r.face_idx, r.face.left_eye[0]) for r in flat) == sorted((f"f{k}.gif", f"test/f{k}.gif", i, 1.0 * k) for k in range(25) for i in range(k % 3))
    empty = models.envelopes(spark.createDataFrame([], kind), "test", "none")
    assert [(r.total_images, r.annotations) for r in parsers.read_summary(spark, empty).collect()] == [(0, {})]


def test_detection_set_tables(spark):
    folder = new_folder(spark, "coco")
    document = {"categories": [{"id": 1, "name": "person"}, {"id": 2, "name": "cat"}], "annotations": [{"image_id": 10, "category_id": 1}, {"image_id": 11, "category_id": 2}], "images": [{"id": 10, "file_name": "a.jpg"}, {"id": 11, "file_name": "b.jpg"}, {"id": 12, "file_name": "c.jpg"}]}
    os.makedirs(folder.removeprefix("file://"))
    with open(f"{folder.removeprefix('file://')}/instances.json", "w") as f:
        json.dump(document, f, indent=1)
    tables = parsers.coco_tables(spark, folder)
    kept = dataset.images_without(tables["images"], tables["annotations"], tables["categories"], "person")
    assert sorted(r.file_name for r in kept.collect()) == ["b.jpg", "c.jpg"]


def test_feature_cache_is_kept_by_configuration(spark):
    root, asked = new_folder(spark, "cache"), []

    def compute(n):
        def run():
            asked.append(n)
            return spark.range(n).selectExpr("id", "'train' split", "cast(id % 2 as int) y")

        return run

    assert models.cached_features(spark, root, {"stride": 2}, compute(4)).count() == 4
    assert models.cached_features(spark, root, {"stride": 2}, compute(9)).count() == 4
    assert models.cached_features(spark, root, {"stride": 1}, compute(6)).count() == 6 and asked == [4, 6]
    os.remove(f"{models.cache_path(root, {'stride': 1}).removeprefix('file://')}/_SUCCESS")
    assert models.cached_features(spark, root, {"stride": 1}, compute(5)).count() == 5  # an unfinished one is computed again


def test_pairs_and_first_images(spark):
    folder = new_folder(spark, "pgm").removeprefix("file://")
    os.makedirs(folder)
    for k in range(6):
        with open(f"{folder}/img_{k}.png", "wb") as f:
            f.write(b"P5 3 2 255\n" + bytes(range(k, k + 6)) if k != 1 else b"broken")
    read = parsers.read_images(spark, f"file://{folder}", parsers.decode_pgm, first=3)
    assert sorted((r.path[-5], r.px[0]) for r in read.collect()) == [("0", 0), ("2", 2)]
    assert parsers.read_images(spark, f"file://{folder}", parsers.decode_pgm, least=3).collect() == []
    for name, n in (("pos", 9), ("neg", 7)):
        rows = spark.range(n).selectExpr("id", f"'{name}' kind", "if(id < 5, 'train', 'val') split", "format_string('%05d', id) name")
        assert models.write_split(rows, f"file://{folder}/{name}", {"train": 5}) and not models.write_split(rows, f"file://{folder}/{name}", {"train": 5})
    positive, negative = models.load_pair(spark, f"file://{folder}/pos", f"file://{folder}/neg", "val", 3)
    assert sorted(r.id for r in positive.collect()) == [5, 6, 7] and {r.kind for r in negative.collect()} == {"neg"} and negative.count() == 2
    with pytest.raises(ValueError):
        models.load_pair(spark, folder, folder, "test")


def test_categories_by_path(spark):
    paths = ["d/train/sea/1.jpg", "d/train/sea/2.PNG", "d/val/ice/3.bmp", "d/val/ice/4.gif", "5.jpg", None]
    got = dataset.categorised(spark.createDataFrame([(p, 1) for p in paths], "path string, split int").drop("split")).collect()
    assert {(r.path, r.split, r.category) for r in got} == {("d/train/sea/1.jpg", "train", "sea"), ("d/train/sea/2.PNG", "train", "sea"), ("d/val/ice/3.bmp", "val", "ice")}
    assert sorted(r.position for r in got) == [0, 1, 2]


def test_random_places_by_hash(spark):
    rng = np.random.default_rng(4)
    pictures = {k: rng.integers(0, 256, (20, 30)) if k % 3 else np.full((20, 30), 7) for k in range(6)}
    frame = images.integral_arrays(spark.createDataFrame([(k, 20, 30, p.ravel().tolist()) for k, p in pictures.items()], "img_id long, h int, w int, px array<int>"))
    got = {(r.img_id, r.r, r.c): r["var"] for r in dataset.random_patches(frame, 20, 30, 8, most=3, least_var=50.0).collect()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    want = {}
    for k, p in pictures.items():
        tried = []
        for n in range(15):
            h = 42
            for part in (struct.pack("<q", k), struct.pack("<i", n), struct.pack("<i", 42)):
                h = xxhash.xxh64_intdigest(part, h)
            at = signed(h) % (13 * 23)
            if at not in tried:
                tried.append(at)
        places = [(at // 23, at % 23) for at in tried]
        kept = [(r, c) for r, c in places if p[r : r + 8, c : c + 8].var() >= 50][:3]
        want |= {(k, r, c): p[r : r + 8, c : c + 8].var() for r, c in kept}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got) and len(got) == 12


def test_lines_read_together_give_the_same_faces():
    rng = random.Random(1)
    kinds = ["a.jpg", " b.jpg\t", "0", "1", "2", "3", " +2 ", "-1", "9999999999", "", "1 2 3", "1 2 3 4 5 6 7 8 9 10", "+1 -2 3 4 5 6 7 8 9 10 11 x", "1\x0b2 3 4 5 6 7 8 9 10", "1 2 3 4 5 6 7 8 9 10x", "0\n", "\u0661", "1 2 3 4 5 6 7 8 9 1234567890"]
    for _ in range(3000):
        lines = [rng.choice(kinds) for _ in range(rng.randrange(14))]
        state = rng.choice([0, face_lists.COUNT, face_lists.PLACEHOLDER, 1, 2, 5, 40])
        of, paths, columns, last = face_lists.face_rows(pa.array(lines, pa.string()), state)
        want, _, path = face_lists.faces(lines, state, None)
        assert list(zip(paths.take(of).to_pylist(), *(c.to_pylist() for c in columns))) == want and last == path
        assert [None if n == face_lists.NONE else n for n in face_lists.line_numbers(pa.array(lines, pa.string()))] == [None if n == -1 else n for n in map(face_lists.number, lines)]
