import random
from itertools import combinations

import pytest

from lumigrid.llm import decontaminate as dc


def brute(docs, items):
    """Every shift of every item over every document."""
    out = set()
    toks = lambda t: list(dc.token_hashes(t))
    for d, text in docs:
        a = toks(text)
        for i, item in items:
            b = toks(item)
            if not b:
                continue
            width = min(dc.RUN, len(b))
            need = width if len(b) < dc.SHORTEST else -(-width * 8 // 10)
            for shift in range(-len(b), len(a)):
                same = [a[k] == b[k - shift] for k in range(max(0, shift), min(len(a), shift + len(b)))]
                if any(sum(same[k : k + width]) >= need for k in range(len(same) - width + 1)):
                    out.add((d, i))
    return out


def test_tokens():
    a = list(dc.token_hashes("One, two:THREE-é 4"))
    assert a == [*dc.token_hashes("one two"), *dc.token_hashes("three é 4")] and len(set(a)) == 5
    assert len(dc.token_hashes(None)) == len(dc.token_hashes(" .,")) == 0


def test_overlaps(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, prose(n)) for k, n in enumerate([40, 25, 13, 9, 6, 4, 60, 12])] + [(8, prose(30))]
    docs, expect = [], set()
    for i, item in items:
        for every, shared in ((None, None), (9, None), (None, 20)):
            own = list(item[: shared or None])
            if every:
                own = [f"x{k}" if k % every == every - 1 else w for k, w in enumerate(own)]
            docs.append((len(docs), " ".join(prose(50) + [w.upper() + "," for w in own] + prose(30))))
    docs += [(100 + k, " ".join(prose(400))) for k in range(10)] + [(200, None), (201, ""), (202, " ".join(items[2][1])), (203, " ".join(prose(20000) + items[0][1]))]
    rows = [(i, " ".join(t)) for i, t in items] + [(0, " ".join(items[0][1])), (50, None), (51, "")]
    got = dc.find_overlaps(spark.createDataFrame([(*d, "e") for d in docs], "doc_id long, text string, hash string"), spark.createDataFrame(rows, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    truth = brute([d for d in docs if d[0] != 203], [r for r in rows if r[1]][:9]) | {(203, 0)}
    assert found == truth and len(got) == len(found)
    assert all(r.similarity >= 0.8 for r in got) and not any(100 <= r.doc_id < 202 for r in got)


def test_empty(spark):
    docs, none = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.find_overlaps(docs, none).count() == 0
    items = docs.select(docs.doc_id.alias("item_id"), "text")
    assert dc.find_overlaps(docs.where("false"), items).count() == 0
    assert dc.find_overlaps(docs, items).count() == 1


def test_all_patterns_of_substitutions(spark):
    docs, items, expect = [], [], set()
    for n in range(1, 14):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for pattern in combinations(range(n), 2 if n >= 10 else 1 if n >= 5 else 0):
            expect.add((len(docs), n))
            own = [f"x{len(docs)}y{k}" if k in pattern else w for k, w in enumerate(item)]
            docs.append((len(docs), " ".join(["before", *own, "after"])))
    for rows in ([r for r in items if r[0] == 13], items):  # items of 13 words alone have fewer masks
        own = {(d, i) for d, i in expect if (i, dict(items)[i]) in rows}
        got = dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got} == own


def test_windows_that_repeat(spark):
    """A window that stands often in a document and in many items is no product of rows, and the best overlap is found."""
    line = "the same nine words stand here again and again"
    docs = [(k, " ".join([line] * 300)) for k in range(20)]
    items = [(k, " ".join([line] * 20 + [f"end{k}"])) for k in range(100)]
    got = dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == 2000 and {r.overlap_words for r in got} == {181}


def test_rows_are_judged_by_their_texts(spark):
    rows = [(None, "a b c d e f g h"), (None, "good text"), (5, "x a b c d e f g h"), (5, "other words"), (6, None)]
    docs = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, row_digest string")
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    got = dc.drop_overlapping(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.where("text is null or text in ('good text', 'other words')").collect()))


@pytest.mark.parametrize("run,agree,fits", [(13, 0.8, True), (13, 0.75, False), (16, 0.75, False), (16, 0.88, True), (26, 0.85, False), (26, 0.93, True), (12, 1.0, False), (13, 0.0, False), (13, 1.0, True)])
def test_arguments_that_the_masks_do_not_cover_are_refused(run, agree, fits):
    if fits:
        return dc._check(run, agree)
    with pytest.raises(ValueError):
        dc._check(run, agree)
