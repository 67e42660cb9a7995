import random
import zlib

import numpy as np
import pytest

from lumigrid.llm import langid, toxicity

DATA = "/root/testdata/sf0.01"


def held(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(lang) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    rest = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rest) > 0.97 * len(rest)
    assert sum(r.rejected for r in rest) < 0.01 * len(rest)


def test_language_edge_cases(spark):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(k, make("abcdé") if k % 2 else make("wxyzü"), "A" if k % 2 else "B") for k in range(60)]
    rows += [(100, None, "A"), (101, "", "A"), (102, "12 !?", "B"), (103, make("abcd"), None), (None, make("abcd"), "B"), (104, "a", None), (105, make("漢字仮名") * 50, None), (106, "𝒳 " * 10, None), (1, rows[1][1], "A")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == ("A" if k % 2 else "B") for k in range(60))
    assert [by[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "A", "A"] and by[100].rejected and by[100].score == 0
    assert by[105].rejected and by[105].lang_pred in "AB" and not by[103].rejected and by[106].lang_pred in "AB"
    none = langid.predict(docs, langid.fit(docs.where("lang is null"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.fit(docs.where("false")) is None and langid.predict(docs.where("false"), None).count() == 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    rest = [r for r in got if r.held_out and r.doc_id in truth]
    hits = sum(r.predicted and truth[r.doc_id] for r in rest)
    assert hits > 0.85 * sum(truth[r.doc_id] for r in rest) and hits > 0.93 * sum(r.predicted for r in rest)


def test_toxicity_edge_cases(spark):
    rng = random.Random(2)
    plain = [f"p{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(200)]
    words = lambda n: [rng.choice(plain) for _ in range(n)]
    rows, marks = [], []
    for k in range(600):
        toxic = k % 5 == 0
        rows.append((k, " ".join(words(40) + (["vile"] * 2 + ["nastyone", "nastytwo"][: 1 + k % 2] if toxic else []))))
        marks.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "VILE! " * 3000), (None, "vile nastyone vile"), (3, rows[3][1])]
    marks += [(0, 1), (5, None), (None, 1), (9, 7)]
    docs, labels = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert sum(by[k].predicted == (k % 5 == 0) for k in range(600)) > 590
    assert by[1000].predicted == by[1001].predicted == 0 and by[1002].predicted == 1 and by[None].predicted == 1
    none = toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect()
    assert not any(r.predicted for r in none) and toxicity.score(docs.where("false"), toxicity._none()).count() == 0


def test_label_model_finds_accuracies_and_dependence():
    """From votes alone: two thirds of the texts are clean, voters are right to known degrees, and one repeats another."""
    rng = np.random.default_rng(3)
    y = rng.random(20000) < 0.3
    fire = lambda p, q: (rng.random(20000) < np.where(y, p, q)).astype(int)
    right = [(0.7, 0.02), (0.5, 0.05), (0.6, 0.02), (0.4, 0.01)]
    own = [fire(p, q) for p, q in right]
    v = np.stack([*own, own[2]], axis=1).astype(np.int8)
    model = toxicity.label_model(v)
    posterior = model.posterior(v)
    assert ((posterior > 0.5) == y).mean() > 0.9 and abs(1 - model.shares[0] - 0.3) < 0.1
    assert len(set(model.groups)) == 1
    for k, (p, q) in enumerate(right):
        assert abs(model.accuracies()[k] - 0.3 * p / (0.3 * p + 0.7 * q)) < 0.1


def test_label_model_knows_kinds_of_toxic_texts():
    """Two languages with voters of their own: the silence of the other language's voters says nothing."""
    rng = np.random.default_rng(4)
    n = 20000
    toxic, second = rng.random(n) < 0.2, rng.random(n) < 0.5
    rate = lambda own: np.where(toxic & own, 0.6, 0.003)
    v = np.stack([rng.random(n) < rate(second if k >= 4 else ~second) for k in range(8)], axis=1).astype(np.int8)
    model = toxicity.label_model(v)
    assert model.groups.tolist() == [0] * 4 + [1] * 4
    assert ((model.posterior(v) > 0.7) == toxic).mean() > 0.95


def test_rows_are_dropped_in_place(spark):
    model = toxicity.Classifier(["vile "], np.append([0.01], np.full(len(toxicity.PATTERNS), np.inf)), np.array([9.0, 0.0, *[0] * len(toxicity.PATTERNS), -4]))
    rows = [(None, "vile vile words"), (None, "good text"), (5, "so vile"), (5, "other words"), (6, None), (6, None)]
    docs = spark.createDataFrame([(*r, 0.5, [1]) for r in rows], "doc_id long, text string, score double, predicted array<int>")
    got = toxicity.drop_toxic(docs, model)
    assert got.schema == docs.schema and [(r.doc_id, r.text) for r in got.collect()] == [rows[1], rows[3], rows[4], rows[5]]
    fitted = langid.fit(spark.createDataFrame([(k, "plain words of a text", "en") for k in range(9)], "doc_id long, text string, lang string"))
    kept = langid.keep_known(docs.where("score > 0"), fitted)
    assert kept.schema == docs.schema and all(r.text for r in kept.collect())
    assert toxicity.drop_toxic(docs.where("false"), model).count() == langid.keep_known(docs.where("false"), fitted).count() == langid.keep_known(docs, None).count() == 0


def test_language_rows_are_bounded_and_none_is_left_out(spark, monkeypatch):
    rows = [(k, f"die katze {k} und der hund", "de") for k in range(6000)] + [(k, f"the cat {k} and the dog", "en") for k in range(10000, 16000)]
    rows += [(7, f"le chat {k} et le chien", "fr") for k in range(3000)] + [(40000, "il gatto e il cane", "it")]
    seen = []
    k_means = langid._k_means
    monkeypatch.setattr(langid, "_k_means", lambda x, k: seen.append(len(x)) or k_means(x, k))
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert model.languages == ["de", "en", "fr", "it"] and seen == [50, 50, 50, 1]
