import base64
import hashlib
import io
import random
import time
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from lumigrid.llm import warc
from lumigrid.session import new_folder


def member(raw):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def records(n):
    return [warc.record(k, f"http://a/{k}", (b"text %d " % k) * (k * 50), None, False) for k in range(n)]


def read(data):
    return list(warc.salvage(io.BytesIO(data)))


@pytest.mark.parametrize("pack", [member, lambda raw: raw])
def test_sound_file(pack):
    got = read(b"".join(map(pack, records(5))))
    assert [x[0] for x in got] == ["record"] * 5
    assert [x[3]["x-page-id"] for x in got] == list("01234")


@pytest.mark.parametrize("pack", [member, lambda raw: raw])
@pytest.mark.parametrize("where", [0.5, 0.7, 0.9])
def test_damaged_record_is_a_gap(pack, where):
    parts = list(map(pack, records(5)))
    hit = bytearray(parts[2])
    for k in range(4):
        hit[int(len(hit) * where) + k] ^= 0x55
    got = read(b"".join([*parts[:2], bytes(hit), *parts[3:]]))
    assert [x[3]["x-page-id"] for x in got if x[0] == "record"] == ["0", "1", "3", "4"]
    gap = next(x for x in got if x[0] == "gap")
    assert gap[1] == len(parts[0]) + len(parts[1]) and gap[2] == gap[1] + len(parts[2])


def test_bytes_lost_and_noise_between():
    parts = list(map(member, records(6)))
    data = b"noise" + parts[0] + parts[1][:-9] + parts[2] + b"\x1f\x8b\x08junk" + parts[3] + parts[4] + parts[5][:20]
    got = read(data)
    # of the second only the end of the packing is lost
    assert [x[3]["x-page-id"] for x in got if x[0] == "record"] == ["0", "1", "2", "3", "4"]
    covered = sorted((x[1], x[2]) for x in got)
    assert covered[0][0] == 0 and covered[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_small_reads(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    parts = list(map(member, records(4)))
    got = read(parts[0] + parts[1] + b"xx" + parts[2] + parts[3])
    assert [x[0] for x in got] == ["record", "record", "gap", "record", "record"]


def test_member_of_several_records():
    some, more = records(5), records(8)[5:]
    broken = some[2][:-30] + b"#" * 4 + some[2][-26:]
    data = member(b"".join([*some[:2], broken, *some[3:]])) + b"noise" + member(b"".join(more))
    got = read(data)
    assert [x[3]["x-page-id"] for x in got if x[0] == "record"] == ["0", "1", "3", "4", "5", "6", "7"]
    inner, outer = (x for x in got if x[0] == "gap")
    assert "digest" in inner[3] and outer[2] - outer[1] == len(b"noise") and inner[2] == outer[1]
    assert read(member(b"no record here"))[0][0] == "gap"


@pytest.mark.parametrize("pieces", [1 << 14, 5])
def test_members_that_break_off_give_what_came_before(monkeypatch, pieces):
    """Fifty records in one member: the end cut off, or a byte flipped in the middle, and a sound member behind."""
    monkeypatch.setattr(warc, "PIECE_BYTES", pieces)
    rng = random.Random(2)
    some = [warc.record(k, f"http://a/{k}", bytes(rng.randrange(32, 127) for _ in range(300)), None, False) for k in range(50)]
    whole, behind = member(b"".join(some)), member(records(52)[51])
    ids = lambda got: [int(x[3]["x-page-id"]) for x in got if x[0] == "record"]
    assert ids(read(whole + behind)) == [*range(50), 51]
    cut = read(whole[:-200] + behind)
    assert ids(cut) == [*range(len(ids(cut)) - 1), 51] and 48 <= len(ids(cut)) - 1 <= 50
    assert [x for x in cut if x[0] == "gap"][-1][2] == len(whole) - 200
    for at in (0.3, 0.5, 0.9):
        hit = bytearray(whole)
        hit[int(len(whole) * at)] ^= 0x10
        got = ids(read(bytes(hit) + behind))
        assert got[-1] == 51 and set(range(int(50 * at) - 2)) <= set(got)
    assert ids(read(whole[:-3])) == list(range(50))  # the checksum is cut, but the digests hold


def test_records_without_digest_wait_for_the_checksum():
    bare = lambda k: b"WARC/1.1\r\nWARC-Type: resource\r\nX-Page-ID: %d\r\nContent-Length: 6\r\n\r\nbare %d\r\n\r\n" % (k, k)
    raw = member(bare(0) + bare(1) + bare(2))
    assert [x[0] for x in read(raw)] == ["record"] * 3
    hit = bytearray(raw)
    hit[-6] ^= 1  # the checksum
    assert [x[0] for x in read(bytes(hit) + member(bare(7)))] == ["gap", "record"]


def test_a_large_record_is_read_in_linear_time():
    big = warc.record(1, "u", b"x" * (200 << 20), None, False)
    for data in (big, member(big)):
        began = time.time()
        assert [x[0] for x in read(data)] == ["record"]
        assert time.time() - began < 20


def test_a_member_larger_than_its_records(monkeypatch):
    """A member of many records is not held; a record beyond the limit is a gap within it."""
    monkeypatch.setattr(warc, "READ_BYTES", 1 << 12)
    parts = records(40)
    parts[20] = warc.record(99, "u", b"y" * 100_000, None, False)
    got = list(warc.salvage(io.BytesIO(member(b"".join(parts))), 60_000))
    assert [x[3]["x-page-id"] for x in got if x[0] == "record"] == [str(k) for k in range(40) if k != 20]
    assert [x[0] for x in got].count("gap") == 1


def test_stores_are_named_as_tasks_open_them(spark):
    from lumigrid.llm import shared

    assert shared.qualified(spark, "/tmp/x").startswith("file:///")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own.link./in", "file:///tmp")
    assert shared.qualified(spark, "viewfs://own/in/lumigrid-view").startswith("file:///tmp/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _refused(shared, spark)


def _refused(shared, spark):
    def unknown(uri):
        raise pa.ArrowInvalid(f"Unrecognized filesystem type in URI: {uri}")

    known, shared.file_system = shared.file_system, unknown
    try:
        shared.qualified(spark, "/tmp/x")
    finally:
        shared.file_system = known


@pytest.mark.parametrize("repeated", [1_000_000, 0])
def test_one_payload_on_half_of_the_rows(spark, monkeypatch, repeated):
    monkeypatch.setattr(warc, "REPEATED", repeated)
    rows = [(k, f"u{k}", "same" if k % 2 else f"own {k}") for k in range(400)] + [(None, "n", "same"), (None, "m", "lone")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, salt int, owner string")
    back = warc.read_archives(warc.write_archives(pages, new_folder(spark, "warc"))).collect()
    got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in back)
    want = [(False, k, "revisit" if k % 2 and k > 1 else "response", 1 if k % 2 and k > 1 else None) for k in range(400)]
    assert [g for g in got if not g[0]] == want and sorted(g[2:] for g in got if g[0]) == [("response", None), ("revisit", 1)]


def test_archives_lie_where_the_uri_says(monkeypatch, tmp_path):
    """A store that only its URI reaches: a bare path is an error."""
    def store(uri):
        assert uri.startswith("store://bucket/")
        return pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem()), uri.removeprefix("store://bucket/")

    monkeypatch.setattr(warc, "file_system", store)
    rows = pa.RecordBatch.from_pylist([{"page_id": k, "url": "u", "html": b"page %d" % k, "refers_to": None, "revisit": False} for k in range(9)])
    (written,) = warc._write("store://bucket/a/b", 200)(iter([rows]))
    assert all(p.startswith("store://bucket/a/b/") for p in written["path"].to_pylist()) and written.num_rows > 1
    back = [r for batch in warc._read(True)(iter([written])) for r in batch.to_pylist()]
    assert sorted(r["payload"] for r in back) == [b"page %d" % k for k in range(9)]


def test_contract_by_brute_force(spark):
    """Digests, owners and kinds by plain Python over the smallest pages."""
    d = "/root/testdata/sf0.001"
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html").collect()]
    own = {}
    for k, html in pages:
        data = (html or "").encode()
        own[data] = min(k, own.get(data, k))
    want = []
    for k, html in pages:
        data = (html or "").encode()
        first = own[data] == k
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else own[data]))
    got = warc.op3_warc(spark, d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=lambda x: x[0]) == sorted(want)


def test_null_paths_name_no_file(spark):
    assert warc.read_archives(spark.createDataFrame([(None, 1)], "path string, bytes long")).count() == 0


def test_empty_stream():
    assert read(b"") == []


def test_round_trip(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "v", ""), (None, "w", "a"), (5, "x", "ä" * 100000), (1, "u", "a"), (None, "y", "only")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    back = warc.read_archives(warc.write_archives(pages, new_folder(spark, "warc"))).collect()
    got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in back)
    assert got == [
        (False, 1, "response", 0, 1), (False, 1, "response", 0, 1), (False, 2, "revisit", 1, 1), (False, 3, "response", 0, 0), (False, 4, "revisit", 3, 0),
        (False, 5, "response", 0, 200000), (True, 0, "response", 0, 4), (True, 0, "revisit", 1, 1),
    ]
    assert all(r.payload.decode() == "ä" * 100000 for r in back if r.page_id == 5)
    assert {r.payload_digest for r in back if r.payload_bytes == 0} == {warc.sha1_base32(b"")}
    assert warc.read_archives(warc.write_archives(pages.where("false"), new_folder(spark, "warc"))).count() == 0


def test_damaged_archive_in_spark(spark):
    folder = new_folder(spark, "warc")
    pages = spark.range(20).selectExpr("id page_id", "'u' url", "concat('page ', id) html").coalesce(1)
    archives = warc.write_archives(pages, folder)
    path = archives.first().path
    fs, path = pafs.FileSystem.from_uri(path)
    data = bytearray(fs.open_input_stream(path, compression=None).read())
    data[len(data) // 2] ^= 0xFF
    with fs.open_output_stream(path, compression=None) as out:
        out.write(bytes(data))
    kinds = [r.kind for r in warc.read_archives(archives).collect()]
    assert kinds.count("record") in (19, 20) and kinds.count("gap") == 1  # all where only a member's checksum is hit
