"""Personal data: patterns, and terms of the corpus that give protected entities away.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers; each value
is a protected entity. Whether a word near an entity reveals it is a matter of information:
pointwise mutual information of word and entity, in relation to what the entity's name
itself tells (its information content). Counts are of the different documents of the whole
corpus (copies of a text count once): in how many the entity stands, in how many of these
the word is near it, and in how many the word occurs at all. How likely the word is beside the
entity is judged in each such document by the other ones (leave one out), so that one
document, beside whose entity every rare word stands by chance, is no evidence, and two are.
Words beyond the upper threshold are removed, those beyond the lower one are replaced by a
word for their class, wherever they stand.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depot.llm.texts import field_rows, rows, whole
from depot.operators.durable import materialize

#: Words on either side of an entity that count as its surroundings.
REACH = 6
#: Shares of the entity's information beyond which a word is generalised or removed.
GENERALISE, REMOVE = 0.75, 0.95
#: Bits of the filter that tells tasks which words may matter (1 MB); more words than it can
#: tell apart only cost rows, never results.
FILTER_BITS = 1 << 23

#: The patterns of the kinds.
KINDS = ("email", "ip", "card", "phone", "removed", "generalised")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match that fails from the first digit of a run fails from the others too.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W_]+")
_ALL_DIGITS = re.compile("[0-9]")

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[Span]:
    """Every @ is looked at once: the local part is the run before it, the domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, domain.end(), "email"
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Start, end and kind of the matches of all patterns that hold, by start, then kind."""
    text = text or ""
    out = list(_emails(text))
    first = _DIGIT.search(text)
    if first:
        at = max(0, first.start() - 1)
        for m in _IP.finditer(text, at):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text, at):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text, at):
            if 10 <= len(_ALL_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def words_outside(text: str, spans: list[Span]) -> Iterator[tuple[int, int, str]]:
    """Start, end and lower-cased form of the words that touch no span."""
    taken = sorted((s, e) for s, e, _ in spans)
    k, reach = 0, 0
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if m.start() >= reach:
            yield m.start(), m.end(), m[0].lower()


def term_hash(word: str) -> int:
    """Signed 64-bit hash of a word, as a long column holds it."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def surroundings(text: str | None) -> Iterator[tuple[int, set[int]]]:
    """Hash of the entity and the words around it, wherever it stands, for each entity."""
    spans = base_spans(text)
    if not spans:
        return
    words = list(words_outside(text, spans))
    starts = [w[0] for w in words]
    around: dict[int, set[int]] = {}
    for start, end, kind in spans:
        value = text[start:end].lower()
        if kind in ("card", "phone"):
            value = "".join(_ALL_DIGITS.findall(value))
        left, right = np.searchsorted(starts, [start, end]).tolist()
        near = {w[2] for w in words[max(0, left - REACH) : left] + words[right : right + REACH]}
        around.setdefault(term_hash(f"{kind} {value}"), set()).update(map(term_hash, near))
    yield from around.items()


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term (hash) and share: how much of some entity's information the word gives, at most 1."""

    def scan(batches):
        for hashes, texts in rows(batches, "copy", "text"):
            # a value without words around it is a row too, it counts for the value
            found = [
                (e, h, t)
                for h, text in zip(hashes, texts, strict=True)
                for e, near in surroundings(text)
                for t in (near or (None,))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in range(3)],
                names=["entity", "copy", "term"],
            )

    # copies of a text have one hash, and count once everywhere
    picked = docs.select(F.xxhash64("text").alias("copy"), "text")
    seen = materialize(
        picked.mapInArrow(scan, "entity long, copy long, term long").distinct(), "surroundings"
    )
    entities = (
        seen.groupBy("entity", "copy").agg(F.lit(1).alias("one"))
        .groupBy("entity").agg(F.count("*").alias("n_entity"))
    )
    # leaving one out, a pair of one document has no likelihood, so it needs no row
    pairs = seen.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    pairs = materialize(pairs.where(F.col("n_both") > 1).join(entities, "entity"), "pairs")
    wanted = _filter(pairs.select("term"))
    copies = materialize(picked.groupBy("copy").agg(F.count("*").alias("rows")), "copies")
    everywhere = _documents_with(picked, wanted, _filter(copies.where("rows > 1").select(F.col("copy").alias("term"))))
    n = F.lit(float(max(2, copies.count())))
    beside = (F.col("n_both") - 1) / (F.col("n_entity") - 1)
    share = F.log2(beside * n / F.col("n_docs")) / F.log2(F.greatest(n / F.col("n_entity"), F.lit(2.0)))
    return (
        pairs.join(everywhere, "term")
        .groupBy("term")
        .agg(F.least(F.max(share), F.lit(1.0)).alias("share"))
        .where(F.col("share") >= GENERALISE)
    )


def _filter(terms: DataFrame) -> np.ndarray:
    """Bits of the words' hashes; a fixed size, whatever the number of words."""
    places = terms.select(F.pmod("term", F.lit(FILTER_BITS)).alias("bit")).distinct().repartition(8)

    def gather(batches):
        bits = np.zeros(FILTER_BITS, np.uint8)
        for batch in batches:
            bits[batch.column("bit").to_numpy()] = 1
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], names=["bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in places.mapInArrow(gather, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def _may_match(filter_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & (FILTER_BITS - 1)  # as pmod does for a power of two
    return (filter_bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0


def _documents_with(docs: DataFrame, wanted: np.ndarray, copied: np.ndarray) -> DataFrame:
    """term, n_docs: in how many different documents (copy, text) each wanted word occurs.

    `copied` is a filter of the hashes of texts with copies: only these are dealt by hash.
    """
    held = docs.sparkSession.sparkContext.broadcast((wanted, copied))

    def apart(batches, with_copies):
        for batch in batches:
            may = _may_match(held.value[1], batch.column("copy").to_numpy())
            yield batch.filter(pa.array(may == with_copies))

    def count(batches):
        seen = np.empty(0, np.int64)
        times = np.empty(0, np.int64)
        for (texts,) in rows(batches, "text"):
            each = [np.array(list(map(term_hash, {w.lower() for w in _WORD.findall(t or "")})), np.int64) for t in texts]
            new = np.concatenate(each)
            new = new[_may_match(held.value[0], new)]
            seen, back = np.unique(np.concatenate([seen, new]), return_inverse=True)
            times = np.bincount(
                back, np.concatenate([times, np.ones(len(new), np.int64)]), len(seen)
            ).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(times)], names=["term", "n"])

    once = docs.mapInArrow(lambda b: count(apart(b, False)), "term long, n long")
    several = docs.mapInArrow(lambda b: apart(b, True), "copy long, text string")
    several = several.groupBy("copy").agg(F.first("text").alias("text")).select("text")
    counted = once.unionByName(several.mapInArrow(count, "term long, n long"))
    return counted.groupBy("term").agg(F.sum("n").alias("n_docs"))


def find(docs: DataFrame) -> DataFrame:
    """The rows as `doc` with `base` (spans of patterns) and `added` (of words).

    Spans are (start, end, kind) in code points, end exclusive. Null texts have none. Rows
    are written to the shared folder on the way, so their numbers stay as they are.
    """
    spark = docs.sparkSession
    terms = materialize(disclosing_terms(docs), "disclosing-terms")
    held = spark.sparkContext.broadcast(_filter(terms.select("term")))
    docs = whole(docs)
    span = "array<struct<start:int,end:int,kind:string>>"
    word = "array<struct<start:int,end:int,term:bigint>>"
    schema = docs.select("*", F.lit(None).cast(span).alias("base"), F.lit(None).cast(word).alias("words")).schema
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    word_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.int64())]))

    def scan(batches):
        for part, texts in field_rows(batches):
            base, words = [], []
            for t in texts:
                spans = base_spans(t)
                base.append([dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans])
                found = [(a, b, term_hash(w)) for a, b, w in words_outside(t or "", spans)]
                may = _may_match(held.value, np.array([f[2] for f in found], np.int64))
                words.append(
                    [
                        dict(zip(("start", "end", "term"), found[i], strict=True))
                        for i in np.flatnonzero(may).tolist()
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(base, span_type), pa.array(words, word_type)],
                names=schema.names,
            )

    scanned = docs.mapInArrow(scan, schema)
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    some = scanned.where(F.size("words") > 0)
    action = F.when(F.col("share") >= REMOVE, "removed").otherwise("generalised")
    added = (
        some.select("row", F.explode("words").alias("w"))
        .select("row", "w.start", "w.end", "w.term")
        .join(terms, "term")
        .groupBy("row")  # as many as the document has words
        .agg(F.collect_list(F.struct("start", "end", action.alias("kind"))).alias("added"))
    )
    marked = some.join(added, "row", "left").select("doc", "base", "added")
    plain = scanned.where(F.size("words") == 0)
    return plain.select("doc", "base", F.lit(None).cast(span).alias("added")).unionByName(marked)


def private_data(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def spell(batches):
        for ids, bases, addeds in rows(batches, "doc_id", "base", "added"):
            out = []
            for doc_id, base, added in zip(ids, bases, addeds, strict=True):
                base = [(s["start"], s["end"], s["kind"]) for s in base]
                more = [(s["start"], s["end"], s["kind"]) for s in added or ()]
                counts = [sum(s[2] == kind for s in base) for kind in KINDS[:4]]
                digest = hashlib.sha256(spelled(base).encode()).hexdigest()
                out.append((doc_id, *counts, digest, spelled(ordered(base + more))))
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    found = find(docs.select("doc_id", "text")).select("doc.doc_id", "base", "added")
    return found.mapInArrow(
        spell,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string",
    )


def general(word: str) -> str:
    """A word for the class of a word: a number, a code of letters and digits, a name, another term."""
    if word.isdigit():
        return "[NUMBER]"
    if any(c.isdigit() for c in word):
        return "[CODE]"
    return "[NAME]" if word[:1].isupper() else "[TERM]"


def masked(text: str, spans: list[Span]) -> str:
    """The text with spans replaced by their kind in brackets, generalised words by their class, and
    nothing where a word is removed.

    Overlapping spans are replaced together, by the kind of the first.
    """
    out, at, k = [], 0, 0
    spans = ordered(spans)
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        k += 1
        instead = {"removed": "", "generalised": general(text[start:end])}
        out += [text[at:start], instead.get(kind, f"[{kind.upper()}]")]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents, all of them, with personal data masked in `text`; `n_chars`, where it is a
    column, follows the text. Null texts stay null."""
    columns = docs.columns
    text = columns.index("text")

    def mask(batches):
        for part, texts in field_rows(batches):
            out = []
            lists = (part.column(c).to_pylist() for c in ("base", "added"))
            for t, base, added in zip(texts, *lists, strict=True):
                spans = [(s["start"], s["end"], s["kind"]) for s in [*base, *(added or ())]]
                out.append(masked(t, spans) if spans else t)
            arrays = part.column("doc").flatten()
            arrays[text] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    clean = find(docs).mapInArrow(mask, docs.schema)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean
