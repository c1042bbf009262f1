"""Token ids of documents in binary shards with Elias-Fano encoded document boundaries.

A shard holds one range of ascending document ids. Its layout, little-endian:

    magic | ids, 2 or 4 bytes each | boundaries (Elias-Fano) | document ids (Elias-Fano)
          | sizes of the parts, as JSON | length of that JSON, 8 bytes | magic

Ids go to the file as they come, so a task keeps only one number a document. Boundaries take
about 2 + log2(mean length) bits a document instead of 64, and any of them is found with
one look-up among samples and a scan of a few words.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depot.llm.shared import create, new_path, read_at, reader
from depot.llm.texts import rows, word_tokenizer
from depot.operators.durable import materialize, run_dir

MAGIC = b"DEPOTTK1"
#: One place is stored for so many set bits.
SAMPLE = 256
#: Ids and documents read back at a time.
READ_IDS, READ_DOCS = 4_000_000, 50_000


class EliasFano:
    """A non-decreasing list of non-negative integers in near-minimal space.

    The low bits of every value are packed side by side; the high bits are a bit vector in
    which value number i sets bit (high part + i). `select` finds a set bit from the samples.
    """

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width = n, width
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if width:
            low = np.concatenate(
                [
                    np.packbits(
                        (values[i : i + 8192, None] >> np.arange(width, dtype=np.uint64))
                        .astype(np.uint8) & 1,
                        bitorder="little",
                    )
                    for i in range(0, n, 8192)  # a multiple of 8 values fills whole bytes
                ]
            )
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = (int(at[-1]) // 8 + 1) if n else 0
        high = np.zeros(size, np.uint8)
        np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return cls(n, width, low.tobytes(), high.tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    def select(self, i: int) -> int:
        """Place of set bit number i: from its sample on, whole bytes are skipped by count."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        bits = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (count := bits.bit_count()) <= left:
            left -= count
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return byte * 8 + (bits & -bits).bit_length() - 1

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values number start to stop - 1."""
        if stop <= start:
            return np.empty(0, np.uint64)
        first, last = self.select(start), self.select(stop - 1)
        bits = np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")
        at = np.flatnonzero(bits[first & 7 :])[: stop - start] + first
        value = (at - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            begin = start * self.width
            raw = self.low[begin >> 3 : (stop * self.width + 7) >> 3]
            packed = np.unpackbits(raw, bitorder="little")[begin & 7 :]
            packed = packed[: (stop - start) * self.width].reshape(-1, self.width)
            value |= packed.astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))
        return value

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


class Shard:
    """A shard opened for reading; ids stay in the file until they are asked for."""

    def __init__(self, path: str):
        self.file = reader(path)
        end = self.file.size()
        assert read_at(self.file, end - 8, 8) == MAGIC, f"{path} is not a whole shard"
        size = int.from_bytes(read_at(self.file, end - 16, 8), "little")
        about = json.loads(read_at(self.file, end - 16 - size, size))
        self.dtype, self.n_docs, self.n_nulls = about["dtype"], about["docs"], about["nulls"]
        self.low_id, self.at = about["low_id"], len(MAGIC)
        place = self.at + about["ids_bytes"]
        lists = []
        for n, width, sizes in about["lists"]:
            parts = []
            for s in sizes:
                parts.append(read_at(self.file, place, s))
                place += s
            lists.append(EliasFano(n, width, *parts))
        self.ends, self.ids = lists

    def starts(self, first: int, stop: int) -> np.ndarray:
        """Start of each document first .. stop - 1 and, at last, the end of the last."""
        ends = self.ends.slice(max(first - 1, 0), stop).astype(np.int64)
        return ends if first else np.concatenate([[0], ends])

    def doc_ids(self, first: int, stop: int) -> list[int | None]:
        nulls = max(0, min(stop, self.n_nulls) - first)
        real = self.ids.slice(max(first, self.n_nulls) - self.n_nulls, stop - self.n_nulls)
        return [None] * nulls + [int(v) + self.low_id for v in real]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        width = np.dtype(self.dtype).itemsize
        raw = read_at(self.file, self.at + start * width, (stop - start) * width)
        return np.frombuffer(raw, self.dtype)

    def document(self, i: int) -> np.ndarray:
        """Ids of document number i of this shard, by two selects."""
        return self.tokens(self.ends[i - 1] if i else 0, self.ends[i])

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """First document and starts of successive blocks that fit in memory."""
        first = 0
        while first < self.n_docs:
            starts = self.starts(first, min(first + READ_DOCS, self.n_docs))
            fit = int(np.searchsorted(starts, starts[0] + READ_IDS, "right")) - 1
            starts = starts[: max(1, fit) + 1]
            yield first, starts
            first += len(starts) - 1


def write_shard(path: str, blocks, dtype: str) -> tuple[int, int]:
    """Writes a shard of (document ids, their token arrays); returns documents and ids."""
    lengths: list[int] = []
    ids: list[int | None] = []
    with create(path) as out:
        out.write(MAGIC)
        for doc_ids, arrays in blocks:
            for doc_id, tokens in zip(doc_ids, arrays, strict=True):
                ids.append(doc_id)
                lengths.append(len(tokens))
                out.write(tokens.astype(dtype).tobytes())
        ends = np.cumsum(np.array(lengths, np.int64))
        real = [i for i in ids if i is not None]
        low_id = real[0] if real else 0
        lists = [EliasFano.of(ends), EliasFano.of(np.array([i - low_id for i in real], np.uint64))]
        for part in (p for e in lists for p in e.parts()):
            out.write(part)
        total = int(ends[-1]) if len(ends) else 0
        about = {
            "dtype": dtype,
            "docs": len(ids),
            "nulls": len(ids) - len(real),
            "low_id": low_id,
            "ids_bytes": total * np.dtype(dtype).itemsize,
            "lists": [[e.n, e.width, [len(p) for p in e.parts()]] for e in lists],
        }
        footer = json.dumps(about).encode()
        out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
    return len(ids), total


def write_tokens(
    docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None
) -> DataFrame:
    """Encodes `text` of all documents and writes shards in ascending order of `doc_id`.

    Null texts have only the end id; null ids come first; rows with equal ids are ordered by
    a hash of their text. Extra columns are ignored. Returns the manifest (shard, path, docs,
    ids), one row a file, written to the shared folder: order of shards is order of ids.
    """
    folder = folder or run_dir(docs.sparkSession, "tokens")

    def encode(batches):
        tokenizer = word_tokenizer(vocabulary)

        def blocks():
            for doc_ids, texts in rows(batches, "doc_id", "text"):
                end = np.array([end_id])
                yield doc_ids, (np.concatenate([t, end]) for t in tokenizer.encode(texts))

        dtype = "<u2" if max(end_id, tokenizer.library.get_vocab_size()) < 1 << 16 else "<u4"
        shard = TaskContext.get().partitionId()
        path = new_path(folder, f"shard-{shard:06d}")
        n_docs, n_ids = write_shard(path, blocks(), dtype)
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [path], "docs": [n_docs], "ids": [n_ids]}
        )

    # the hash also splits an id that many rows share
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    ordered = keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    manifest = ordered.mapInArrow(encode, "shard long, path string, docs long, ids long")
    return materialize(manifest, "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    One row of the manifest is one file, so the driver adds up a list that is shorter than
    the data by the size of a shard.
    """
    spark = manifest.sparkSession
    files, base = [], 0
    for row in manifest.where("docs > 0").orderBy("shard").collect():
        files.append((row.shard, row.path, base))
        base += row.ids
    schema = "shard long, path string, base long"
    listed = spark.createDataFrame(files, schema)
    listed = listed.repartitionByRange(max(1, len(files)), "shard")

    def read(batches):
        for paths, bases in rows(batches, "path", "base"):
            for path, begin in zip(paths, bases, strict=True):
                shard = Shard(path)
                for first, starts in shard.blocks():
                    ids = shard.tokens(int(starts[0]), int(starts[-1])).astype("<u4")
                    cuts = (starts - starts[0]).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids(first, first + len(starts) - 1), pa.int64()),
                            pa.array(starts[:-1] + begin, pa.int64()),
                            pa.array(np.diff(starts), pa.int64()),
                            pa.array(
                                [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)],
                                pa.int64(),
                            ),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
