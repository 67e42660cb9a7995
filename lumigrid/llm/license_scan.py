"""License notices by an exact set-similarity join of text blocks with templates.

A template is the set of words of a license notice. A block is a run of words, whatever the line ends between them: for
templates of up to STEP words, or a multiple of it, runs of twice as many words begin at every such multiple, so each
notice lies whole in a block. A block meets a template if it holds at least CONTAINMENT of the template's words. The words that occur in templates are ordered by how many blocks of the
corpus hold them, rarest first; a block that meets a template must hold a word of its prefix, the rarest words, and
enough words in all (length filter) and after the first common word (positional filter). Survivors are verified.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F, Window

from lumigrid.session import materialize, table

CONTAINMENT = 0.8
#: Fixed phrases whose places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, notice); few and short by nature, so they are broadcast.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
]
#: Lengths of templates are rounded up to a multiple of this.
STEP = 8
#: Words of all templates, which stand in the plan; more are refused.
_MOST_WORDS = 100_000
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing


def _needed(template: str, containment: float) -> int:
    return math.ceil(containment * len(set(template.split())) - 1e-9)


def _class(template: str) -> int:
    """The template's length in words, rounded up."""
    return -(-len(template.split()) // STEP) * STEP


def _words(padded: Column) -> Column:
    """Words in a text with one space before, between and after them."""
    return F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit(""))) - 1


def _blocks(words: Column, n: Column, templates: list[tuple[str, str]], containment: float) -> Column:
    """(length, words) of the blocks that hold enough words of some template of their length: the length filter."""
    out = []
    for size in sorted({_class(t) for _, t in templates}):
        own = [t for _, t in templates if _class(t) == size]
        vocabulary = F.array(*map(F.lit, sorted({w for t in own for w in t.split()})))
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - 2 * size) / size)).cast("int"))
        held = F.transform(starts, lambda k: F.array_intersect(F.slice(words, k * size + 1, 2 * size), vocabulary))  # noqa: B023
        least = min(_needed(t, containment) for t in own)
        kept = F.filter(held, lambda b: F.size(b) >= least)  # noqa: B023
        out.append(F.transform(kept, lambda b: F.struct(F.lit(size).alias("length"), b.alias("words"))))  # noqa: B023
    return F.concat(*out)


def _scan(docs: DataFrame, templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """One pass over the texts: words, places of phrases, and the template words of the blocks."""
    lowered = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    padded = docs.select("doc_id", F.concat(F.lit(" "), F.regexp_replace(lowered, _SEPARATOR, " "), F.lit(" ")).alias("padded"))
    flat = padded.select("doc_id", F.regexp_replace("padded", " +", " ").alias("flat"))
    found = flat.withColumn("n_words", _words(F.col("flat")).cast("long"))
    for k, phrase in enumerate(PHRASES):
        parts = F.split("flat", f"(?<= ){phrase}(?= )")
        found = found.withColumn(f"p{k}", F.when(F.contains("flat", F.lit(f" {phrase} ")), F.struct(
            (F.size(parts) - 1).cast("long").alias("n"),
            _words(F.get(parts, F.lit(0))).cast("long").alias("first"),
            (F.col("n_words") - len(phrase.split()) - _words(F.element_at(parts, -1))).cast("long").alias("last"),
        )))
    places = [f"p{k}" for k in range(len(PHRASES))]
    return found.select(
        "doc_id",
        "n_words",
        sum((F.coalesce(f"{p}.n", F.lit(0)) for p in places), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(f"{p}.first" for p in places)).alias("first_word"),
        F.greatest(*(f"{p}.last" for p in places)).alias("last_word"),
        F.array_compact(F.array(*(F.when(F.col(p).isNotNull(), F.lit(label)) for p, label in zip(places, PHRASES.values())))).alias("base"),
        # bound by a lambda, the words of a text are split once for all blocks
        F.get(F.transform(F.array(F.split(F.trim("flat"), " ")), lambda words: _blocks(words, F.size(words), templates, containment)), F.lit(0)).alias("held"),
    )


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Places of PHRASES and blocks that meet templates, one row per row of docs (doc_id, text).

    score: the largest containment of a template that is met, 1 where a phrase stands, else 0. A null text is empty;
    an empty text has no words, null first_word and last_word, empty labels. Repeated rows each give a row. No rows
    give no rows. Further columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.split()) for _, t in templates) > _MOST_WORDS:
        raise ValueError(f"templates of more than {_MOST_WORDS} words")
    spark = docs.sparkSession
    scanned = materialize(_scan(docs, templates, containment).withColumn("row", F.monotonically_increasing_id()), "licenses")
    blocks = scanned.select("row", F.posexplode("held").alias("block", "held")).select("row", "block", "held.length", "held.words")
    frequency = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("held_by"))
    listed = spark.createDataFrame([(k, label, w, _class(t), len(set(t.split())), _needed(t, containment)) for k, (label, t) in enumerate(templates) for w in sorted(set(t.split()))], "template int, label string, word string, length int, size int, needed int")
    ordered = listed.join(frequency, "word", "left").na.fill({"held_by": 0}).withColumn("at", F.row_number().over(Window.partitionBy("template").orderBy("held_by", "word")))
    # as many rows as the templates have words
    prefix = F.broadcast(ordered.where("at <= size - needed + 1").select("template", "word", "length", "at", "size", "needed"))
    # the global order: at most as many words as the templates have
    order = F.array(*(F.lit(r["word"]) for r in frequency.orderBy("held_by", "word").collect())).cast("array<string>")
    ranked = blocks.withColumn("ranks", F.array_sort(F.transform("words", lambda w: F.array_position(order, w))))
    probes = ranked.select("row", "block", "length", "words", "ranks", F.explode("words").alias("word")).withColumn("of_block", F.array_position("ranks", F.array_position(order, F.col("word"))))
    first = probes.join(prefix, ["word", "length"]).where(F.least(F.col("size") - F.col("at"), F.size("words") - F.col("of_block")) + F.col("at") >= F.col("needed"))
    candidates = first.select("row", "block", "words", "template", "size", "needed").dropDuplicates(["row", "block", "template"])
    full = F.broadcast(listed.groupBy("template", "label").agg(F.collect_set("word").alias("all")))
    verified = candidates.join(full, "template").withColumn("common", F.size(F.array_intersect("words", "all"))).where("common >= needed")
    met = verified.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("size")).alias("best"))
    joined = scanned.join(met, "row", "left")
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """All documents against PHRASES and TEMPLATES."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    word = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
    places = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_transform(list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {same}), lambda i: struct_pack(at := i - 1, label := '{label}'))")
    sets = ", ".join(f"({k}, '{label}', {_class(t)}, {sorted(set(t.split()))}, {_needed(t, CONTAINMENT)})" for k, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
p AS (SELECT k, doc_id, len(w) AS n_words, list_concat({places[0]}, list_concat({places[1]}, {places[2]})) AS found FROM w),
templates(template, label, length, words, needed) AS (VALUES {sets}),
sized AS (SELECT k, length, w, unnest(range(0, greatest(0, ceil((len(w) - 2 * length) / length)::BIGINT) + 1)) AS i FROM w, (SELECT DISTINCT length FROM templates)),
blocks AS (SELECT k, length, list_distinct(w[i * length + 1 : i * length + 2 * length]) AS words FROM sized),
met AS (
    SELECT k, list(DISTINCT label) AS more, max(len(list_intersect(blocks.words, templates.words)) / len(templates.words)) AS best
    FROM blocks JOIN templates ON blocks.length = templates.length AND len(blocks.words) >= needed AND len(list_intersect(blocks.words, templates.words)) >= needed GROUP BY k)
SELECT doc_id, n_words::BIGINT AS n_words, len(found)::BIGINT AS n_base,
    list_min(list_transform(found, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(found, lambda x: x.at))::BIGINT AS last_word,
    array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(list_transform(found, lambda x: x.label), coalesce(more, [])))), ',') AS labels,
    CASE WHEN len(found) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM p LEFT JOIN met USING (k)
"""


ORACLE_SQL = _oracle()
