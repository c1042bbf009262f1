"""Small helpers the operators share inside their tasks."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents handed to the loop of an operator at a time, inside one Arrow batch.
SLICE = 256

#: ASCII white space, and what is not a letter, a digit or beyond ASCII.
_SPACES = bytes(range(9, 14)) + b" "
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Column values of a few rows at a time, so that long texts are not all unpacked at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield tuple(part.column(c).to_pylist() for c in columns)


def field_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches of whole rows (column `doc`), each with its texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, pa.compute.struct_field(part.column("doc"), "text").to_pylist()


def whole(docs: DataFrame) -> DataFrame:
    """Rows as one column `doc`, so that columns put beside it cannot clash with theirs."""
    return docs.select(F.struct("*").alias("doc"))


def space_words(text: str | None) -> list[bytes]:
    """Words of `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes split on just these six characters."""
    return (text or "").encode().split()


def lower_words(text: str | None) -> list[bytes]:
    """The same words with A-Z lower-cased; bytes leave all other letters as they are."""
    return (text or "").encode().lower().split()


def plain_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_PLAIN).split()


class Memo(dict):
    """A dictionary that computes missing values; it starts anew when it holds `limit`."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


#: 64-bit hash of a word, kept per worker.
word_hash = Memo(xxhash.xxh64_intdigest, 250_000)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))


def mix(a: np.ndarray) -> np.ndarray:
    """Spreads 64 bits evenly (splitmix64's finaliser, a bijection)."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of `size` consecutive values; empty if there are fewer."""
    n = len(h)
    if n < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _powers(_ODD, n), out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * _powers(_INVERSE, n - size + 1))


def spread(marks: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places are covered by windows of `size` that start at the marked places."""
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(marks)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + size, n), -1)
    return np.cumsum(edges[:n]) > 0


# ---- ids of a public vocabulary ---------------------------------------------------------

#: The vocabulary's own pattern of what it encodes apart, for lower-cased Latin-1 texts.
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)
#: Python takes these for white space, the library does not; and special tokens begin so.
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


class WordTokenizer:
    """Ids of a lower-casing byte-level vocabulary of the tokenizers library.

    The library encodes each different piece once and its ids are kept, so a piece that
    comes back costs a look-up. Latin-1 texts are split by the vocabulary's own pattern;
    other texts at white space, which no token spans; texts with control characters that
    are white space to Python only, or with special tokens, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = self.library.model
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(self.kind)
        self.pieces = Memo(self._piece, 800_000)
        self.chunks = Memo(self._library, 50_000)

    def _library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            [(piece, _)] = self.as_bytes.pre_tokenize_str(piece)
        return array(self.kind, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for text in texts:
            text = text or ""
            if any(c in text for c in _WHOLE):
                ids = self._library(text)
            elif text.isascii() or _latin(text):
                ids = b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
            else:
                ids = b"".join(map(self.chunks.__getitem__, text.split()))
            yield np.frombuffer(ids, self.dtype)


def _latin(text: str) -> bool:
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this file, loaded once in a worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
