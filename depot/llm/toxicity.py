"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: look-alike letters and digits written for letters become the
letters they stand for. The lexicon has whole words and beginnings of words, weighed by how
much more often they occur in toxic training documents; phrases around them that occur in
harmless documents are exceptions. Matches are taken from left to right, the longest first,
so an exception takes its words out of the count. The weights found, by length of the text,
give the score through a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depot.llm.texts import field_rows, rows, whole
from depot.operators.durable import materialize

#: Labelled training documents the lexicon and the curve are fitted on, at most; those with
#: the lowest hash of their id are taken, one text of an id. It bounds what the fit costs at
#: any corpus size, and what the lexicon can hold; nothing else does.
SAMPLE = 20_000
#: A term is an entry if it is so many standard deviations commoner in toxic documents, and
#: its smoothed logarithmic weight is at least this; a phrase with one is an exception below
#: that weight; and an entry must be worth so much where it is the longest match.
SIGNAL, TERM_WEIGHT, EXCEPTION_WEIGHT, MATCH_WEIGHT = 3.0, 0.7, 0.5, 1.0
#: Beginnings of words have these lengths.
SHORTEST, LONGEST = 3, 9

#: Letters of other scripts that look like Latin ones, digits and signs written
#: for letters, and characters that do not show.
_ALIKE = dict(
    zip(
        "аеорсухікнмтвгѕјԁӏαεορτυνικ" "013457@$" "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ",
        "aeopcyxikhmtbrsjdlaeoptuvik" "oieastas" "abcdefghijklmnopqrstuvwxyz",
        strict=True,
    )
)
_FOLD = str.maketrans(_ALIKE | dict.fromkeys("­​‌‍⁠﻿", None))
_WORD = re.compile(r"[^\W_]+")
#: Marks of the beginning and the end of a word.
_OPEN, _CLOSE = "\x02", "\x03"


def folded_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower().translate(_FOLD))


def marked(words: list[str]) -> str:
    return f"{_OPEN}{f'{_CLOSE}{_OPEN}'.join(words)}{_CLOSE}" if words else ""


def terms(word: str) -> list[str]:
    """The whole word and its beginnings, with their marks."""
    starts = [_OPEN + word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]
    return [marked([word]), *starts]


class Lexicon:
    """Weights of terms; exceptions weigh nothing."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term, weight in (weights | dict.fromkeys(exceptions, 0.0)).items():
            self.machine.add_word(term, (len(term), weight, term))
        self.machine.make_automaton()
        self.empty = not len(self.machine)

    def matches(self, text: str) -> list[tuple[int, int, float, str]]:
        """Start, end, weight and term: leftmost first, then longest, without overlap."""
        if self.empty or not text:
            return []
        found = sorted(
            (end + 1 - size, -size, weight, term)
            for end, (size, weight, term) in self.machine.iter(text)
        )
        out, free = [], 0
        for start, size, weight, term in found:
            if start >= free:
                free = start - size
                out.append((start, free, weight, term))
        return out

    def features(self, words: list[str]) -> list[float]:
        """What the curve looks at: all normalised by, or damped against, the length."""
        hits = [(w, t) for _, _, w, t in self.matches(marked(words)) if w > 0]
        total = sum(w for w, _ in hits)
        density = 100 * total / max(len(words), 1)
        kinds = len({t for _, t in hits})
        return [1.0, math.log1p(density), math.log1p(total), math.log1p(kinds), float(bool(hits))]


def _sample(docs: DataFrame, labels: DataFrame, train: list[int], folds: int) -> DataFrame:
    """Texts and labels of a bounded number of training documents, in the shared folder."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = known.where((F.crc32(F.col("doc_id").cast("string")) % folds).isin(train))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # at most SAMPLE rows of 12 bytes; the documents' texts stay where they are
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # rows may share an id, a third of all even: tasks reduce them to one text each
    one = texts.groupBy("doc_id").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic")
    )
    half = (F.xxhash64("doc_id", F.lit("half")) % 2 == 0).alias("half")
    return materialize(one.select("text", (F.col("toxic") > 0).alias("toxic"), half), "toxicity-sample")


def _counts(sample: DataFrame, of_text) -> DataFrame:
    """term, toxic and harmless documents with it, `of_text` giving the terms of a text."""

    def count(batches):
        bad, good = Counter(), Counter()
        for texts, toxic in rows(batches, "text", "toxic"):
            for text, label in zip(texts, toxic, strict=True):
                (bad if label else good).update(of_text(text))
        keys = list(bad | good)
        for start in range(0, len(keys), 100_000):
            part = keys[start : start + 100_000]
            yield pa.RecordBatch.from_pydict(
                {"term": part, "bad": [bad[k] for k in part], "good": [good[k] for k in part]}
            )

    return (
        sample.mapInArrow(count, "term string, bad long, good long")
        .groupBy("term")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, slightly damped."""
    theta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - y) + ridge @ theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
        theta = theta - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return theta


def _lexicon(sample: DataFrame) -> tuple[dict[str, float], list[str]]:
    """Weights of terms and exception phrases of a sample; both empty if it has one kind of label."""
    sizes = {bool(r.toxic): r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(True, 0), sizes.get(False, 0)
    rate_bad = (F.col("bad") + 0.5) / (n_bad + 1)
    rate_good = (F.col("good") + 0.5) / (n_good + 1)
    weight = F.log(rate_bad / rate_good)

    def all_terms(text: str | None) -> set[str]:
        return {t for w in set(folded_words(text)) for t in terms(w)}

    # signal: how surely the term is commoner in toxic documents, in standard deviations. The
    # smoothed rates keep terms of a few documents below it, whatever the sample's size.
    signal = (rate_bad - rate_good) / F.sqrt(
        rate_bad * (1 - rate_bad) / (n_bad + 1) + rate_good * (1 - rate_good) / (n_good + 1)
    )
    best = _counts(sample, all_terms).where((weight >= TERM_WEIGHT) & (signal >= SIGNAL))
    weights = {r.term: float(r.weight) for r in best.select("term", weight.alias("weight")).collect()}
    words_only = Lexicon(weights, [])

    def around(text: str | None) -> set[str]:
        """Whole words and two- and three-word phrases with a match in them."""
        words = folded_words(text)
        whole, places = marked(words), {}
        at = 0
        for i, w in enumerate(words):
            places[at] = i
            at += len(w) + 2
        out = set()
        for start, *_ in words_only.matches(whole):
            i = places[start]
            for a, b in ((i, i + 1), (i - 1, i + 1), (i, i + 2), (i - 1, i + 2)):
                if a >= 0 and b <= len(words):
                    out.add(marked(words[a:b]))
        return out

    harmless = _counts(sample, around).where(weight < EXCEPTION_WEIGHT).select("term").collect()
    exceptions = sorted(r.term for r in harmless if r.term not in weights)
    # what a term is worth where it is the longest match and no exception takes it
    lexicon = Lexicon(weights, exceptions)
    matched = _counts(
        sample, lambda text: {t for *_, t in lexicon.matches(marked(folded_words(text))) if t in weights}
    )
    weighed = matched.where(weight >= MATCH_WEIGHT).select("term", weight.alias("weight"))
    return {r.term: float(r.weight) for r in weighed.collect()}, exceptions


def _features(rows_of: DataFrame, found: tuple[dict, list]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a part of the sample, by a lexicon that was not learnt from it."""
    lexicon = Lexicon(*found)

    def features(batches):
        for texts, toxic in rows(batches, "text", "toxic"):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lexicon.features(folded_words(t)) for t in texts], pa.list_(pa.float64())),
                    pa.array(toxic, pa.bool_()),
                ],
                names=["x", "y"],
            )

    seen = rows_of.select("text", "toxic").mapInArrow(features, "x array<double>, y boolean")
    seen = sorted(seen.collect())  # SAMPLE rows at most
    return np.array([r.x for r in seen], float).reshape(-1, 5), np.array([r.y for r in seen], float)


def fit(docs: DataFrame, labels: DataFrame, train: list[int], folds: int) -> tuple[dict, list, list]:
    """Weights of terms, exception phrases and the curve, from labelled training documents.

    The lexicon is learnt from the whole sample. The curve is fitted on what lexicons of each
    half find in the other one, since texts a lexicon was learnt from have more matches than
    others. What the driver takes is bounded by SAMPLE. Without toxic or without harmless rows
    every score is about the share of toxic rows; without any labelled rows it is 0.
    """
    sample = _sample(docs, labels, train, folds)
    weights, exceptions = _lexicon(sample)
    parts = []
    for mine in (F.col("half"), ~F.col("half")):
        parts.append(_features(sample.where(~mine), _lexicon(sample.where(mine))))
    x, y = (np.concatenate(p) for p in zip(*parts, strict=True))
    theta = _curve(x, y) if len(x) else np.array([-30.0] + [0.0] * 4)
    return weights, exceptions, theta.tolist()


def score(docs: DataFrame, fitted: tuple[dict, list, list]) -> DataFrame:
    """The rows as `doc` and their `toxicity`, 0 to 1; null texts count as empty."""
    held = docs.sparkSession.sparkContext.broadcast(fitted)
    docs = whole(docs)
    schema = docs.withColumn("toxicity", F.lit(0.0)).schema

    def run(batches):
        weights, exceptions, theta = held.value
        lexicon = Lexicon(weights, exceptions)
        for part, texts in field_rows(batches):
            scores = []
            for t in texts:
                z = sum(a * b for a, b in zip(lexicon.features(folded_words(t)), theta, strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(scores, pa.float64())], names=schema.names
            )

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Learns from labelled rows whose crc32 of the id is not divisible by `folds`; the others
    are held out. Null labels are ignored; of several labels of a document the highest counts.
    """
    fitted = fit(docs, labels, list(range(1, folds)), folds)
    held_out = F.crc32(F.col("doc.doc_id").cast("string")) % folds == 0
    return score(docs.select("doc_id", "text"), fitted).select(
        "doc.doc_id",
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
