"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback is laid over every document: characters a token say
how well it knows the words, the share of byte tokens how foreign the characters are, the
entropy of the tokens how varied the text is. Documents whose figures lie far outside those
of their language (of their script, where the language is unknown) are rejected. The bands
are quartiles over all documents of the language, drawn towards those of the script and of
all documents the more, the fewer it has, so they follow the corpus without a step.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depot.llm.texts import Memo, rows, space_words, spread, window_hashes
from depot.llm.texts import hashes as hashed
from depot.operators.durable import materialize

#: The symbols that count, and the sizes of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: A band reaches this many quartile distances beyond the quartiles.
REACH = 6.0
#: Texts of so many tokens at least are of one length class, shorter ones of one each.
LEAST_TOKENS = (50, 25, 13)
#: Quartiles of a group count as many documents as it has against so many of the wider group.
PRIOR = 30
#: Decimals of the figures that quartiles are taken of: few different values, counted exactly.
DECIMALS = {"chars_per_token": 2, "byte_share": 3, "entropy": 3}
#: Rows of bands up to which they are broadcast.
FEW_BANDS = 10_000

METRICS = tuple(DECIMALS)
_SCHEMA = (
    "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"
)

_models: dict[str, tuple] = {}


def _model(path: str) -> tuple:
    """Ids of a word by this vocabulary, and which ids are bytes; loaded once in a worker."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])

        def ids(word: bytes) -> bytes:
            return np.array(model.encode(word.decode()), np.uint32).tobytes()

        _models[path] = Memo(ids, 300_000), is_byte
    return _models[path]


def script(text: str) -> str:
    """Commonest script of the letters, as Unicode names it; of equals the first by name."""
    counts: dict[str, int] = {}
    for c, n in Counter(text).items():
        if c.isalpha():
            name = unicodedata.name(c, "UNKNOWN").split(" ")[0]
            counts[name] = counts.get(name, 0) + n
    return min(counts, key=lambda name: (-counts[name], name)) if counts else "NONE"


def base_figures(text: str | None, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    text = text or ""
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line and line.encode().split():
            seen.add(line)
    windows = window_hashes(hashed(words), WINDOW)
    repeated = 0
    if len(windows) > 1:
        _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        if twice.any():
            repeated = int(spread(twice, WINDOW, len(words)).sum())
    chars = sum(map(len, words))
    if not text.isascii():  # continuation bytes are no characters of their own
        chars = len(b"".join(words).decode())
    return chars, sum(map(text.count, SYMBOLS)), again, repeated


def token_figures(chars: int, ids: np.ndarray, is_byte: np.ndarray) -> tuple:
    """n_tokens, characters a token, share of byte tokens, entropy over the most possible."""
    n = len(ids)
    if not n:
        return 0, None, None, None
    counts = np.unique(ids, return_counts=True)[1]
    share = counts / n
    most = np.log2(min(n, len(is_byte)))
    entropy = float(-(share * np.log2(share)).sum() / most) if most > 0 else 1.0
    return n, chars / n, float(is_byte[ids].mean()), entropy


def figures(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Base figures and token figures of every document."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    picked = docs.select("doc_id", "text", lang.cast("string").alias("lang"))

    def measure(batches):
        of_word, is_byte = _model(vocabulary)
        for ids, texts, langs in rows(batches, "doc_id", "text", "lang"):
            out = []
            for doc_id, text, lang in zip(ids, texts, langs, strict=True):
                words = space_words(text)
                base = base_figures(text, words)
                tokens = np.frombuffer(b"".join(map(of_word.__getitem__, words)), np.uint32)
                letters = f"script {script(text or '')}"
                out.append((doc_id, lang or letters, letters, len(words), *base, *token_figures(base[0], tokens, is_byte)))
            kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=[f.split(" ")[0] for f in _SCHEMA.split(", ")],
            )

    return picked.mapInArrow(measure, _SCHEMA)


def bands(measured: DataFrame) -> DataFrame:
    """Lowest and highest allowed figure for each language, script and length class.

    Quartiles of the language's documents of the class, blended with those of the script's,
    which are blended with those of all documents of the class, which are blended with those
    of all short ones: each counts as many documents as it has against PRIOR of the wider
    group. Texts without letters are not blended with all documents.
    """
    group = ["lang", "script", "length"]
    everything = F.when(F.col("script") != "script NONE", F.lit(""))
    length, shorter = F.col("length"), F.least("length", F.lit(1))
    # from the widest to the narrowest
    keys = [(everything, shorter), (everything, length), (F.col("script"), length), (F.col("lang"), length)]
    levels = F.array(
        *[F.struct(F.lit(k).alias("level"), x.alias("key"), n.alias("size")) for k, (x, n) in enumerate(keys)]
    )
    levelled = measured.select(*group, *METRICS, F.explode(levels).alias("at")).where("at.key is not null")
    quartiles = levelled.groupBy("at").agg(
        F.count("*").alias("n"),
        *[
            F.percentile(F.round(m, places), F.array(F.lit(0.25), F.lit(0.75))).alias(m)
            for m, places in DECIMALS.items()
        ],
    )
    found = quartiles.select("at", F.struct("n", *METRICS).alias("q"))
    groups = measured.select(*group).distinct().withColumn("at", F.explode(levels))
    wide = groups.join(found, "at").groupBy(*group).agg(
        *[F.max(F.when(F.col("at.level") == k, F.col("q"))).alias(f"_{k}") for k in range(len(keys))]
    )

    def blended(m: str, i: int) -> Column:
        value = F.lit(None).cast("double")
        for k in range(len(keys)):
            q, n = F.col(f"_{k}").getField(m)[i], F.col(f"_{k}.n")
            # a wider group or a level that is missing leaves the other as it is
            value = F.coalesce((value * PRIOR + q * n) / (n + PRIOR), q, value)
        return value

    def limits(m: str) -> list[Column]:
        low, high = F.col(f"{m}_q1"), F.col(f"{m}_q3")
        # a hundredth at least: equal quartiles do not make a band of one point
        reach = REACH * F.greatest(high - low, 0.01 * F.abs(high), F.lit(0.002))
        return [(low - reach).alias(f"{m}_low"), (high + reach).alias(f"{m}_high")]

    wide = wide.select(*group, *[blended(m, i).alias(f"{m}_q{q}") for m in METRICS for i, q in ((0, 1), (1, 3))])
    return wide.select(*group, *[c for m in METRICS for c in limits(m)])


def quality(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, then the token figures.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word windows.
    Null texts have no words. A document without tokens has no figures and is kept unless its
    base fails. Missing `lang` columns count as null.
    """
    length = F.lit(len(LEAST_TOKENS))
    for k, least in reversed(list(enumerate(LEAST_TOKENS))):
        length = F.when(F.col("n_tokens") >= least, k).otherwise(length)
    measured = materialize(figures(docs, vocabulary).withColumn("length", length), "fertility")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    inside = F.lit(True)
    for m in METRICS:
        inside &= F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    verdict = F.coalesce(inside, F.lit(True))
    allowed = materialize(bands(measured), "bands")
    if allowed.count() <= FEW_BANDS:
        allowed = F.broadcast(allowed)
    return measured.join(allowed, ["lang", "script", "length"], "left").select(
        "doc_id",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        failed.alias("base_failed"),
        (~failed & verdict).alias("kept"),
        *["lang", "n_tokens", *METRICS],
    )
