import hashlib
import random
import re

import numpy as np
import pytest

from lumigrid.llm import fingerprints as fp


def shingles(text):
    own = text.lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def true_likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}é" for _ in range(n))


def test_word_hashes_do_not_depend_on_place():
    a, b = fp.word_hashes(b"one two  THREE"), fp.word_hashes(b" \n three two one\t")
    assert len(a) == 3 and list(a) == list(b)[::-1] and len(set(a)) == 3
    assert len(fp.word_hashes(b"")) == 0 and len(fp.word_hashes(b"  ")) == 0


@pytest.mark.parametrize("n", [3, 12, 60, 400, 5000])
def test_estimates(n):
    rng = random.Random(n)
    text = prose(rng, n)
    changed = " ".join([*text.split()[: n // 2], *prose(rng, n - n // 2).split()])
    true = true_likeness(text, changed)
    assert fp.likeness(fp.sketch(text, scale=1), fp.sketch(changed, scale=1), 1, 1) == pytest.approx(true)
    if n >= 60:
        assert abs(fp.likeness(fp.sketch(text), fp.sketch(changed)) - true) < (0.25 if n == 60 else 0.08)
        coarse = fp.likeness(fp.sketch(text, scale=8), fp.sketch(changed), 8, fp.SCALE)
        assert coarse == fp.likeness(fp.sketch(text, scale=8), fp.sketch(changed, scale=8), 8, 8)


MASK = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_sketch(text, scale=fp.SCALE):
    """Word by word with Python's numbers: hashes below the fraction, whatever their number."""
    odd, words = int(fp._ODD), []
    for word in re.findall(rb"[^ \t-\r]+", text.encode()):
        lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        words.append(plain_mix(sum(int(fp._BYTE[b]) * odd ** (k + 1) for k, b in enumerate(lowered)) & MASK))
    hashes = set()
    for k in range(max(1, len(words) - 4) if words else 0):
        total = 0
        for w in words[k : k + 5]:
            total = total * odd + w & MASK
        hashes.add(plain_mix(total))
    return sorted(h for h in hashes if h < (1 << 64) // scale)


def plain_likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("text", ["", "One", "a b C d É", "x " * 40, "The quick\x0bbrown\u00a0fox JUMPS over\tthe lazy dog again and again"])
def test_sketch_is_the_plain_fraction(text):
    for scale in (1, 2, 8):
        assert fp.sketch(text, scale=scale).tolist() == plain_sketch(text, scale)


def test_containment_of_unequal_documents_and_merge():
    rng = random.Random(2)
    part, rest = prose(rng, 400), prose(rng, 20000)
    whole = part + " " + rest
    assert fp.containment(fp.sketch(part), fp.sketch(whole)) > 0.9
    assert fp.containment(fp.sketch(whole), fp.sketch(part)) < 0.05
    assert list(fp.merge(fp.sketch(part), fp.sketch(rest))) == sorted({*fp.sketch(part), *fp.sketch(rest)})
    assert list(fp.from_text(fp.to_text(fp.sketch(part)))) == list(fp.sketch(part))


def test_fraction_is_kept_whole():
    text = prose(random.Random(4), 3000)
    full = fp.sketch(text, scale=1)
    assert list(fp.sketch(text)) == [h for h in full if h < np.uint64((1 << 64) // fp.SCALE)]


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_document(spark, buckets):
    rng = random.Random(9)
    rows = [(k * 7 - 50, prose(rng, rng.choice([0, 1, 5, 50, 300]))) for k in range(60)]
    rows += [(10**12, None), (10**12 + 1, "a"), (None, "no id here"), (3, rows[4][1]), (3, rows[4][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(5)
    got = sorted(fp.compare_with_next(docs, buckets).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = []
    for k, (d, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        expected.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:016x}" for h in plain_sketch(t)), plain_likeness(plain_sketch(t), plain_sketch(edited)), plain_likeness(plain_sketch(t), plain_sketch(after))))
    expected.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got] == expected


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert fp.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    got = fp.compare_with_next(spark.createDataFrame([(5, "ab cd")], schema)).first()
    assert got.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and got.near_next == 1.0
