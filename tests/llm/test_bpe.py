import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from lumigrid.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "Hello  world\n\n  it's 12345 don't!!", " lead", "trail ", "  ", "", "\n \n", "a\tb \t c", "x y   z", "a　 b", "éàü ñ 漢字かな 🙂🙂", "\x1c\x1d a\x1c b",
    "<|endoftext|>", "one two three", "A\r\n B", "\x85 \x85x", "aaaaaaaaaaaaaaaaaaaaaaaaaaa " * 5,
]


def ids_of(data):
    return [int.from_bytes(data[k : k + 4], "little") for k in range(0, len(data), 4)]


@pytest.mark.parametrize("text", TEXTS)
def test_encoder(text):
    assert ids_of(bpe.Encoder(RANKS, P.PATTERN).encode(text)) == TIKTOKEN.encode_ordinary(text)


ENCODER = bpe.Encoder(RANKS, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t \x85abcXY1'.s!é漢\x1c"), st.characters(blacklist_categories=["Cs", "Cn"], max_codepoint=0x2FFF)), max_size=40))
def test_encoder_on_any_text(text):
    assert ids_of(ENCODER.encode(text)) == TIKTOKEN.encode_ordinary(text)


def test_long_word():
    rng = random.Random(1)
    word = "".join(rng.choice("abcde") for _ in range(20000))
    assert bpe.merge_word(word.encode(), RANKS) == TIKTOKEN.encode_ordinary(word)


@pytest.mark.parametrize("block_bytes", [8, 1 << 24])
def test_operator(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block_bytes)  # the tasks' functions are made here and carry it only on the driver
    rows = [*enumerate(TEXTS), (100, None), (None, "no id"), (0, TEXTS[0]), (101, "z" * 5000)]
    docs = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, ids array<int>")
    got = bpe.round_trip(docs, PATH, P.PATTERN, helped=False).collect()
    want = []
    for d, t in rows:
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_every_word_is_folded(spark):
    """Each of many texts is encoded from folded words alone, in several tasks, and decodes to itself."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(" etaoin,.éß漢\n") for _ in range(rng.randrange(300))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    encoded = bpe.encode(docs, PATH, P.PATTERN, helped=False)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {k: TIKTOKEN.encode_ordinary(t) for k, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(encoded, PATH).collect()} == dict(enumerate(texts))


def test_decode_refuses_unknown_ids():
    pieces = [b"a", None, b"c"]
    assert bpe.decode_ids([0, 2], pieces) == b"ac" and bpe.decode_ids([], pieces) == b"" and bpe.decode_ids(None, pieces) is None
    for bad in ([1], [3]):
        with pytest.raises(ValueError):
            bpe.decode_ids(bad, pieces)


def test_fold_is_the_merge(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice(" etaoinsrhldüé") for _ in range(rng.randrange(1, 14))) for _ in range(300)} | {" the", "a", " Leasonther", "é" * 60}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    from pyspark.sql import functions as F

    for r in df.select("w", bpe.fold_merges(F.col("w"), RANKS).alias("ids")).collect():
        assert r.ids == TIKTOKEN.encode_ordinary(r.w) or r.w.encode() in RANKS


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs, PATH, P.PATTERN).count() == 0


@pytest.mark.parametrize("files", [8, 16, 200])
def test_blocks_spread_over_files(spark, files):
    """Block numbers of 64 tasks of 50 blocks each: tasks look where the words were put, and no file gets many."""
    from collections import Counter

    from pyspark.sql import functions as F

    blocks = [p << 20 | k for p in range(64) for k in range(50)]
    rows = spark.createDataFrame([(b,) for b in blocks], "block long").select("block", F.pmod(F.xxhash64("block"), F.lit(files)).alias("file")).collect()
    assert all(bpe.file_of(r.block, files) == r.file for r in rows)
    counts = Counter(r.file for r in rows)
    assert len(counts) == files and max(counts.values()) <= 2.5 * len(blocks) / files


def test_folded_words_reach_all_files(spark):
    """Forty tasks of one block each."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(" etaoinshrdlu") for _ in range(80)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    shared = spark.sparkContext.broadcast(RANKS)
    with bpe.settings(spark, spark__sql__shuffle__partitions="8"):
        folder, files = bpe.fold_words(docs, RANKS, P.PATTERN, shared)
    assert files == 8
    by_file = [r["count"] for r in spark.read.parquet(folder).selectExpr("input_file_name() f").groupBy("f").count().collect()]
    assert len(by_file) == 8 and max(by_file) < 3 * sum(by_file) / 8
