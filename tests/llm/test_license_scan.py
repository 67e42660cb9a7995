import re

import pytest

from lumigrid.llm import license_scan as ls

TEXTS = [
    None, "", " \n ", "under the mit license", "Released Under the MIT License. Under the mit-license!", "xunder the mit license", "apache license, version 2.0\nCC BY-NC",
    "License Version\nlicensed under the apache 2 0", "this work is licensed under the gnu general public license version 3",
    "this work is licensed under gnu general public license version 3 or any later", "permission is hereby granted free of charge to any person obtaining a copy of this software and documentation files",
    "é under the mit license é" * 2, "word " * 5000 + "cc by nc", "a\x00b cc by nc", "licensed under cc by 4.0",
    "This wor\u212a is licensed under the GNU general public license version 3", "under the M\u0130T license",
    "permission is hereby granted, free\nof charge, to any person obtaining a copy\n * of this software and associated\n\tdocumentation files",
    "filler " * 37 + "this source code form\nis subject to the terms of\nthe mozilla public license, v. 2.0" + " filler" * 37,
    "license " + "mit " * 3 + "far " * 40 + "released under the",
]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in ls.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    more, best = set(), 0.0
    for label, template in ls.TEMPLATES:
        t, step = set(template.split()), -(-len(template.split()) // 8) * 8
        for start in range(0, max(1, len(words)), step):
            own = len(set(words[start : start + 2 * step]) & t)
            if own >= 0.8 * len(t) - 1e-9 and (start == 0 or start + step < len(words)):
                more.add(label)
                best = max(best, own / len(t))
    base = {label for _, label in found}
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), pytest.approx(1.0 if found else best)


def test_matches_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[4]), (4, TEXTS[4])]
    got = ls.scan_licenses(spark.createDataFrame([(*r, ["x"]) for r in rows], "doc_id long, text string, words array<string>")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[4] if r.doc_id is None else TEXTS[r.doc_id]
        assert tuple(r)[1:] == brute(text), text


def test_wrapped_notices_are_met(spark):
    text = "x " * 11 + "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software\nand associated documentation files" + " y" * 5
    got = ls.scan_licenses(spark.createDataFrame([(k, "z " * k + text) for k in range(50)], "doc_id long, text string")).collect()
    assert {r.labels for r in got} == {"mit"} and {r.score for r in got} == {1.0}
    with pytest.raises(ValueError):
        ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string"), [("x", "w " * 200_000)])


def test_empty(spark):
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
