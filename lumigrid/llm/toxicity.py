"""Toxicity by weak supervision.

Voters are words and word beginnings that toxic rows of a bounded labelled sample use far more than clean rows, and
patterns of writing. Labels choose the voters and their floors, and say which class is toxic; they do no more. A
generative label model takes the votes over a second bounded sample, whose labels it never sees. By expectation
maximisation it estimates the share of the classes, how often each voter is right, and which voters correlate;
these stand for one kind of toxic texts. A linear classifier learns the posterior labels and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from string import ascii_uppercase, digits

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigrid.llm.sampling import bounded, held_out, learnable
from lumigrid.session import Scratch, table

#: Labelled rows that choose the voters, and rows without labels that the label model and the classifier are fitted on.
LABELLED_ROWS, UNLABELLED_ROWS = 8000, 8000
#: Entries of the lexicon.
ENTRIES = 64
THRESHOLD = 0.7
#: An entry's words must be so many times as frequent in toxic rows, and be in so large a share of them.
LIFT, TOXIC_SHARE = 6.0, 0.02
#: A voter must find so many toxic sample rows more than it costs; a clean row that it hits costs as much as so many.
GAIN, CLEAN_COST = 4, 3
#: First guesses: how likely a text with a vote is toxic, and one without is clean.
PRIOR_ACCURACY, PRIOR_SILENT = 0.9, 0.98
#: Rows that are added to each kind of texts, and how often voters vote in them.
PRIOR_VOTES, PRIOR_RATE = 5, 0.002
#: Voters that correlate so much are one group; those that correlate so much more repeat each other.
DEPENDENT, SAME = 0.25, 0.9
#: Patterns of writing, as shares of the text's characters or words.
PATTERNS = ("capitals", "shouted words", "exclamations", "questions", "stars and signs", "digits", "runs of marks", "repeated words", "long words", "line ends")
_RUNS = ("!!", "??", "**", "##", "$$", "%%", "&&")
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = range(4, 9)


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word beginnings and, with a closing space, words, by label; entry '' counts all words and rows."""
    uses: tuple[Counter, Counter] = (Counter(), Counter())
    docs: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = Counter(_WORD.findall((text or "").lower()))
            found: Counter = Counter()
            for word, n in own.items():
                found[word + " "] += n
                for k in _PREFIXES:
                    if len(word) > k:
                        found[word[:k]] += n
            found[""] = sum(own.values())
            uses[toxic].update(found)
            docs[toxic].update(found.keys())
    rows = [{"entry": e, "toxic": uses[1][e], "clean": uses[0][e], "toxic_docs": docs[1][e], "clean_docs": docs[0][e]} for e in uses[0].keys() | uses[1].keys()]
    for k in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_pylist(rows[k : k + 50_000])


def mine_lexicon(labelled: DataFrame, entries: int = ENTRIES) -> list[str]:
    """Words (with a closing space) and word beginnings that mark toxic rows of labelled (text, toxic), best first."""
    names = ["toxic", "clean", "toxic_docs", "clean_docs"]
    counted = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(_mine, "entry string, toxic long, clean long, toxic_docs long, clean_docs long")
    summed = counted.groupBy("entry").agg(*(F.sum(c).alias(c) for c in names))
    total = summed.where("entry = ''").first()
    if total is None or not total["toxic"]:
        return []
    lift = (F.col("toxic") + 0.5) / total["toxic"] / ((F.col("clean") + 0.5) / max(total["clean"], 1))
    doc_lift = (F.col("toxic_docs") + 0.5) / total["toxic_docs"] / ((F.col("clean_docs") + 0.5) / max(total["clean_docs"], 1))
    often = (F.col("entry") != "") & (F.col("toxic_docs") >= max(GAIN, TOXIC_SHARE * total["toxic_docs"]))
    ranked = summed.where(often & (lift >= LIFT) & (doc_lift >= LIFT / 2)).select("entry", (F.col("toxic_docs") * F.log(lift)).alias("weight"))
    out: list[str] = []
    for r in ranked.orderBy(F.desc("weight"), F.desc(F.length("entry")), "entry").limit(40 * entries).collect():
        if not any(r["entry"].startswith(e) or e.startswith(r["entry"].strip()) for e in out):
            out.append(r["entry"])
        if len(out) == entries:
            break
    return out


class Lexicon:
    """Finds entries in texts; small, made once for each task."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.machine = ahocorasick.Automaton()
        for k, e in enumerate(entries):
            self.machine.add_word(e.strip(), (k, len(e.strip()), e.endswith(" ")))
        if entries:
            self.machine.make_automaton()

    def densities(self, text: str | None) -> np.ndarray:
        """For each entry its share of the words; then the PATTERNS."""
        text = text or ""
        low = text.lower()
        own = low.split()
        out = np.zeros(len(self.entries) + len(PATTERNS))
        n, size = max(1, len(own)), max(1, len(text))
        if self.entries and own:
            for end, (k, length, whole) in self.machine.iter(low):
                begin = end - length + 1
                if (begin == 0 or not low[begin - 1].isalpha()) and not (whole and end + 1 < len(low) and low[end + 1].isalpha()):
                    out[k] += 1
        out[: len(self.entries)] /= n
        count = text.count
        out[len(self.entries) :] = (
            sum(map(count, ascii_uppercase)) / size,
            sum(w.isupper() and len(w) > 1 for w in text.split()) / n,
            count("!") / size,
            count("?") / size,
            sum(map(count, "*#$%&@")) / size,
            sum(map(count, digits)) / size,
            sum(map(count, _RUNS)) / n,
            1 - len(set(own)) / n,
            sum(len(w) > 20 for w in own) / n,
            count("\n") / size,
        )
        return out


def choose_floors(x: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column the floor above which its voter gains most, and that gain: toxic rows less the cost of clean ones."""
    floors, gains = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k, column in enumerate(x.T):
        order = np.argsort(-column, kind="stable")
        values, gain = column[order], np.cumsum(np.where(toxic[order] == 1, 1.0, -CLEAN_COST))
        ends = np.nonzero((np.append(values[1:], -1) < values) & (values > 0))[0]  # a floor cuts between unequal values
        if len(ends):
            best = ends[gain[ends].argmax()]
            below = values[best + 1] if best + 1 < len(values) else 0.0
            floors[k], gains[k] = (values[best] + below) / 2, gain[best]
        else:
            floors[k] = np.inf
    return floors, gains


def votes(x: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """1 where a voter, one for each column, says toxic; 0 where it says nothing."""
    return (x > floors[None, :]).astype(np.int8)


def correlations(v: np.ndarray) -> np.ndarray:
    """Correlation of each two voters over rows of votes."""
    own = v.mean(0)
    spread = np.sqrt(np.maximum(own * (1 - own), 1e-12))
    return (v.T @ v / len(v) - np.outer(own, own)) / np.outer(spread, spread)


def voter_groups(strength: np.ndarray, least: float) -> np.ndarray:
    """A number for each voter; voters that chains of correlations of at least least connect share it."""
    group = np.arange(len(strength))
    for j, k in zip(*np.nonzero(np.triu(strength >= least, 1))):
        group[group == group[k]] = group[j]
    return np.unique(group, return_inverse=True)[1]


class LabelModel:
    """How often each voter votes in clean texts and in each kind of toxic texts, and the shares of these kinds.

    A kind of toxic texts stands for each group of correlated voters, so voters that go together are not counted as
    if they said something anew. rates[0] and shares[0] are those of clean texts.
    """

    def __init__(self, shares: np.ndarray, rates: np.ndarray, groups: np.ndarray, counted: np.ndarray):
        self.shares, self.rates, self.groups, self.counted = shares, rates, groups, counted

    def kinds(self, v: np.ndarray) -> np.ndarray:
        """For each row of votes how likely it is of each kind."""
        spoken, silent = np.log(self.rates) * self.counted, np.log(1 - self.rates) * self.counted
        logs = v @ (spoken - silent).T + (silent.sum(1) + np.log(self.shares))[None, :]
        likely = np.exp(logs - logs.max(1, keepdims=True))
        return likely / likely.sum(1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """How likely each row is toxic."""
        return 1 - self.kinds(v.astype(float))[:, 0]

    def accuracies(self) -> np.ndarray:
        """For each voter the share of its votes that meet toxic texts."""
        voting = self.shares[:, None] * self.rates
        return voting[1:].sum(0) / voting.sum(0)


def label_model(v: np.ndarray, rounds: int = 100) -> LabelModel:
    """Fitted to rows of votes by expectation maximisation, from the belief that a text with a vote is toxic."""
    v = v.astype(float)
    strength = correlations(v)
    groups = voter_groups(strength, DEPENDENT)
    counted = ~(np.triu(strength, 1) >= SAME).any(0)  # of voters that repeat each other the first counts
    members = np.eye(groups.max() + 1)[groups]
    named = v @ members
    held = np.zeros((len(v), 1 + members.shape[1]))
    silent = named.sum(1) == 0
    held[:, 0] = np.where(silent, PRIOR_SILENT, 1 - PRIOR_ACCURACY)
    held[silent, 1:] = (1 - PRIOR_SILENT) / members.shape[1]
    held[~silent, 1:] = PRIOR_ACCURACY * named[~silent] / named[~silent].sum(1, keepdims=True)
    model = None
    for _ in range(rounds):
        weight = held.sum(0)
        shares = (weight + 0.1) / (weight.sum() + 0.1 * len(weight))
        rates = np.clip((held.T @ v + PRIOR_VOTES * PRIOR_RATE) / (weight[:, None] + PRIOR_VOTES), 1e-5, 1 - 1e-3)
        model = LabelModel(shares, rates, groups, counted)
        new = model.kinds(v)
        moved, held = np.abs(new - held).max(), new
        if moved < 1e-4:
            break
    return model


class Classifier:
    """Lexicon, floors of the voters, and weights of the linear model."""

    def __init__(self, entries: list[str], floors: np.ndarray, weights: np.ndarray):
        self.entries, self.floors, self.weights = entries, floors, weights

    def features(self, x: np.ndarray) -> np.ndarray:
        k = len(self.entries)
        own = np.minimum(x[:, :k] / (self.floors[None, :k] + 1e-4), 2.0)
        some = np.minimum(own.sum(1), 2.0)[:, None]
        return np.concatenate((own, some, x[:, k:], np.ones((len(x), 1))), axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(x) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Weights for soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(x) + ridge * w / 10
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge / 10 + 1e-6)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _none() -> Classifier:
    """Where there is nothing to learn from: every score is low."""
    return Classifier([], np.full(len(PATTERNS), np.inf), np.array([0.0] * (1 + len(PATTERNS)) + [-4]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, unlabelled: int = UNLABELLED_ROWS) -> Classifier:
    """From learnable rows of docs (doc_id, text), and for the voters from those that labels (doc_id, toxic) marks.

    Both samples are the first rows by hash, rows and unlabelled at most. Of several labels of a doc_id the largest counts.
    """
    marked = labels.select(F.col("doc_id"), "toxic").where(learnable() & F.col("toxic").isin(0, 1))
    chosen = bounded(marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), rows)
    known = docs.select("doc_id", "text").where("text is not null")
    order = (F.xxhash64("doc_id", F.lit(12)), "doc_id", F.xxhash64("text"))
    # at most rows ids, and at most rows of them
    sample = known.join(F.broadcast(chosen), "doc_id").orderBy(*order).limit(rows).select("text", F.col("toxic").cast("int").alias("toxic"))
    scratch = Scratch(docs.sparkSession)
    sample = scratch.table(sample, "labelled")
    entries = mine_lexicon(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in batches:
            x = [lexicon.densities(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    def measured(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = texts.mapInArrow(measure, "x array<double>, toxic int").toArrow()
        x = got["x"].combine_chunks()
        return np.asarray(x.values).reshape(len(x), -1) if len(x) else np.zeros((0, len(entries) + len(PATTERNS))), got["toxic"].to_numpy()

    x, toxic = measured(sample) if entries else (np.zeros((0, 0)), np.zeros(0))
    scratch.clear()
    if not len(x):
        return _none()
    floors, gains = choose_floors(x, toxic)
    kept = gains >= GAIN
    if not kept[: len(entries)].any():
        return _none()
    floors[~kept] = np.inf
    x_free, _ = measured(known.where(learnable()).orderBy(*order).limit(unlabelled).select("text", F.lit(-1).alias("toxic")))
    model = label_model(votes(x_free, floors)[:, kept])
    believed = model.posterior(votes(x, floors)[:, kept])
    if believed[toxic == 1].mean() < believed[toxic == 0].mean():
        return _none()  # the voters do not tell the classes apart
    own = kept.copy()
    own[len(entries) :] = True
    made = Classifier([e for e, k in zip(entries, kept) if k], floors[own], np.zeros(0))
    made.weights = _logistic(made.features(x_free[:, own]), model.posterior(votes(x_free, floors)[:, kept]))
    return made


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text); a null text is empty.

    Without labels to learn from every score is low. Repeated rows each give a row; no rows give no rows; further
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lexicon = Lexicon(own.entries)
        for batch in batches:
            if batch.num_rows:
                got = own.scores(np.stack([lexicon.densities(t.as_py()) for t in batch.column(2)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], schema=_RESULT)

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (text, more columns) whose score is below threshold, each judged by itself and passed on whole."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lexicon = Lexicon(own.entries)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([lexicon.densities(t.as_py()) for t in batch.column(at)])
                yield batch.filter(pa.array(own.scores(x) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by labels of the learnable ones."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
