import hashlib
from pathlib import Path

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lumigrid.llm import bpe, decontaminate, langid, toxicity
from lumigrid.session import materialize, settings, shared_dir

DATA = "/root/testdata/sf0.01"


def test_stages_in_order_and_effect(spark):
    assert [name for name, _ in cp.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    sizes, now = [docs.count()], docs
    for name, stage in cp.STAGES[:-1]:
        after = materialize(stage(spark, now, DATA), name)
        assert after.columns == docs.columns
        kept, before = {r.doc_id for r in after.collect()}, {r.doc_id for r in now.select("doc_id").collect()}
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(now, toxicity.fit(now, labels)).collect() if r.predicted}
        elif name == "language":
            bad = {r.doc_id for r in langid.predict(now, langid.fit(now)).collect() if r.rejected}
        elif name == "decontamination":
            bad = {r.doc_id for r in decontaminate.find_overlaps(now, items).collect()}
        else:
            texts = [r.text for r in after.collect()]
            assert len(set(texts)) == len(texts)
            bad = before - kept
        assert kept == before - bad
        sizes.append(len(kept))
        now = after
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > sizes[4] > 0.7 * sizes[0]
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in now.collect()}
    for r in cp.STAGES[-1][1](spark, now, DATA).collect():
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_leaves_the_last_stage_only(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    rows = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len({r.doc_id for r in rows}) == len(rows)
    left = {p.name.split("-")[1] for p in set(folder.iterdir()) - before}
    assert "decontamination" in left and not left & {"toxicity", "language", "near_duplicates"}


def test_nulls_and_empty(spark):
    rows = [(1, None, "en", None), (None, "The plain words of a text", None, "s"), (None, "The plain words of a text", None, "s"), (2, "", None, None), (3, "one two three", "en", "s")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("false")):
        for name, stage in cp.STAGES:
            out = stage(spark, table, DATA)
            assert name == "tokens" or out.columns == docs.columns
            assert out.count() <= len(rows)


def test_rows_of_one_id_are_judged_by_themselves(spark):
    """Bad and good rows share a null or a repeated doc_id; the good ones stay through all stages."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    good = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en' and n_chars > 300").orderBy("doc_id").limit(40).collect()]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(good)], "doc_id long, text string, lang string, source string, n_chars long")
    more = spark.createDataFrame([(None, "...", None, "bad", 3), (None, f"before {item} after", "en", "bad", 9), (None, good[0] + " end of it", "en", "copy", 9), (1, "?!", None, "bad", 2)], docs.schema)
    out = docs.union(more)
    for name, stage in cp.STAGES[1:4]:
        out = materialize(stage(spark, out, DATA), name)
    left = out.collect()
    assert not any(r.source in ("bad", "copy") for r in left)
    clean = cp.STAGES[3][1](spark, docs, DATA).count()
    assert len(left) >= 0.9 * clean


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_batches_of_long_texts_are_small(spark, name, stage):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    with settings(spark, spark__sql__parquet__columnarReaderBatchSize="4096", spark__sql__execution__arrow__maxBytesPerBatch="64m"):
        docs = spark.createDataFrame([(1, "some plain words", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
        stage(spark, docs, DATA)
        long = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("word "), 20_000).alias("text"))
        made = long.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in made) == 300 and max(r.bytes for r in made) < 5 << 20
