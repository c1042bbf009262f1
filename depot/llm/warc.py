"""WARC archives and their index, ordered by an external merge.

Every task writes one archive and a run: the index of its records, sorted by URL key, time
of capture and page. Key ranges are then merged side by side: a task opens all runs at the
beginning of its range and merges them with a loser tree, holding one block of each. More
runs than the fan-in are merged by groups first. The ranges, one after the other, are the
capture histories of all URLs.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.llm.shared import create, new_path, read_at, reader
from depot.llm.texts import rows
from depot.operators.durable import materialize, run_dir

#: Smaller payloads are always stored whole.
LEAST_PAYLOAD = 100
#: Runs merged at once; rows of a block of a run, of which one is held for each run; rows of
#: a key range, about; keys of a run that are looked at to find the ranges.
FAN_IN, BLOCK_ROWS, RANGE_ROWS, SAMPLES = 128, 512, 25_000, 32

_ENTRY = pa.schema(
    [
        ("url_key", pa.string()),
        ("captured", pa.string()),
        ("page_id", pa.int64()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)
INDEX = "url_key string, captured string, page_id long, file string, offset long, length long"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query, lower-cased."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    port = f":{parts.netloc.rpartition(':')[2]}" if re.search(r":\d+$", parts.netloc) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(
    page_id: int | None, url: str | None, captured: str, payload: bytes, refers_to: int | None
) -> bytes:
    """One gzip member. A revisit names the record it repeats, the digest and size of the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    d = captured
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Page-Id: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"Refers-To-Page: {refers_to}",
        ]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and the size that the payload has by its HTTP header."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return fields, payload, size


def _revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat the payload of an earlier one."""
    payload = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    narrow = narrow.where(F.col("n") >= LEAST_PAYLOAD)
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1 and refers_to is not null").drop("n"), "first-captures")
    return (
        narrow.join(first, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "digest", "refers_to")
        .distinct()
    )


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes every page (page_id, url, html, captured) as a record; null html has no payload.

    Of pages with equal payloads of at least LEAST_PAYLOAD bytes, that with the smallest
    page_id is the response and the others revisit it; a page without id never is chosen,
    and rows that share the chosen id are all responses. Returns the manifest: archive,
    run, records, samples (sorted keys of the run), one row a task.
    """
    folder = folder or run_dir(pages.sparkSession, "archives")
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    picked = pages.select("page_id", "url", "html", F.col("captured").cast("string"), digest.alias("digest"))
    repeats = _revisits(pages).withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    ready = picked.join(
        repeats,
        F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")),
        "left",
    ).select("page_id", "url", "html", "captured", "refers_to")

    def write(batches):
        part = TaskContext.get().partitionId()
        archive = new_path(folder, f"archive-{part:06d}") + ".warc.gz"
        entries, offset = [], 0
        with create(archive) as out:
            for ids, urls, bodies, times, refers in rows(
                batches, "page_id", "url", "html", "captured", "refers_to"
            ):
                for page, url, body, time, refer in zip(ids, urls, bodies, times, refers, strict=True):
                    time = (time or "").ljust(14, "0")[:14]
                    record = warc_record(page, url, time, (body or "").encode(), refer)
                    out.write(record)
                    entries.append((url_key(url), time, page, archive, offset, len(record)))
                    offset += len(record)
        run = new_path(folder, f"run-{part:06d}")
        samples = write_run(run, iter(sorted(entries, key=order)))
        step = max(1, len(samples) // SAMPLES)
        yield pa.RecordBatch.from_pydict(
            {"archive": [archive], "run": [run], "records": [len(entries)], "samples": [samples[::step]]},
            schema=pa.schema(
                [
                    ("archive", pa.string()),
                    ("run", pa.string()),
                    ("records", pa.int64()),
                    ("samples", pa.list_(pa.struct([("k", pa.string()), ("t", pa.string()), ("p", pa.int64())]))),
                ]
            ),
        )

    return materialize(
        ready.mapInArrow(
            write,
            "archive string, run string, records long, samples array<struct<k:string,t:string,p:bigint>>",
        ),
        "archive-manifest",
    )


def order(entry: tuple) -> tuple:
    """URL key, time, page; a page without id comes first."""
    page = entry[2]
    return entry[0].encode(), entry[1], -(1 << 63) if page is None else page


def write_run(path: str, entries: Iterator[tuple]) -> list[dict]:
    """Writes sorted entries in blocks; returns the first key of every block."""
    firsts = []
    with create(path) as out, pa.ipc.new_file(out, _ENTRY) as writer:
        block: list[tuple] = []

        def flush():
            if block:
                firsts.append(dict(zip("ktp", block[0][:3], strict=True)))
                columns = zip(*block, strict=True)
                writer.write_batch(
                    pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, _ENTRY, strict=True)], schema=_ENTRY
                    )
                )
                block.clear()

        for entry in entries:
            block.append(entry)
            if len(block) == BLOCK_ROWS:
                flush()
        flush()
    return firsts


def read_run(path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Entries of a run with low <= key < high, a block at a time; the first block is searched for."""
    blocks = pa.ipc.open_file(reader(path))

    def entries(i: int) -> list[tuple]:
        return list(zip(*blocks.get_batch(i).to_pydict().values(), strict=True))

    first, last = 0, blocks.num_record_batches
    while low is not None and last - first > 1:  # the last block that begins below `low`
        middle = (first + last) // 2
        if order(entries(middle)[0]) < low:
            first = middle
        else:
            last = middle
    for i in range(first, blocks.num_record_batches):
        for entry in entries(i):
            key = order(entry)
            if high is not None and key >= high:
                return
            if low is None or key >= low:
                yield entry


class LoserTree:
    """Merges sorted streams: inner nodes keep the losers, so a step replays one path."""

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams = streams
        self.k = len(streams)
        self.heads = [next(s, None) for s in streams]
        self.keys = [self._key(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _key(self, i: int) -> tuple:
        head = self.heads[i]
        return (1,) if head is None else (0, *order(head), i)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while the tree fills, the first to come waits here
                self.losers[node] = winner
                return
            if self.keys[other] < self.keys[winner]:
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            winner = self.losers[0]
            head = self.heads[winner]
            if head is None:
                return
            yield head
            self.heads[winner] = next(self.streams[winner], None)
            self.keys[winner] = self._key(winner)
            self._replay(winner)


class _Run:
    """A sorted run: its pieces (path, lowest key, key below which it ends), rows and sampled keys."""

    def __init__(self, pieces: list[tuple], records: int, samples: list[tuple]):
        self.pieces, self.records, self.samples = pieces, records, samples


def _bounds(runs: list[_Run]) -> list[tuple | None]:
    """Bounds of key ranges with about equally many rows of some runs; None is open."""
    n = max(1, -(-sum(r.records for r in runs) // RANGE_ROWS))
    keys = sorted({s for r in runs for s in r.samples})
    cuts = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    return [None, *cuts, None]


def _within(pieces: list[tuple], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Entries of a run with low <= key < high; only pieces that can hold some are opened."""
    for path, begin, end in pieces:
        if (high is None or begin is None or begin < high) and (low is None or end is None or low < end):
            yield from read_run(path, low, high)


def _merges(spark: SparkSession, folder: str, groups: list[list[_Run]], work: Callable, schema: str) -> DataFrame:
    """Runs `work(group, range, tree)` for every key range of every group of runs, a task each.

    What to merge is one file in the shared folder, where a task looks its range up: the
    driver sends numbers.
    """
    path = new_path(folder, "merge-plan")
    bounds = [_bounds(runs) for runs in groups]
    with create(path) as out:
        out.write(pickle.dumps([([r.pieces for r in runs], b) for runs, b in zip(groups, bounds, strict=True)]))
    ranges = [len(b) - 1 for b in bounds]

    def run(batches):
        for numbers, places in rows(batches, "group", "place"):
            plan = pickle.loads(reader(path).readall())
            for group, place in zip(numbers, places, strict=True):
                pieces, cuts = plan[group]
                low, high = cuts[place], cuts[place + 1]
                tree = LoserTree([_within(p, low, high) for p in pieces])
                yield from work(group, place, low, high, tree)

    # numbers of the tasks, made where they are needed: a row a group goes out
    table = spark.createDataFrame([(g, n) for g, n in enumerate(ranges)], "group int, ranges int")
    tasks = table.select("group", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("place"))
    return tasks.repartitionByRange(sum(ranges), "group", "place").mapInArrow(run, schema)


def merged_index(manifest: DataFrame, folder: str | None = None) -> DataFrame:
    """The index of all archives in one order: key_range, place, then the columns of INDEX.

    key_range and place order all captures by URL key, time and page. At most FAN_IN runs are
    merged at once. More are merged by groups first, each cut into key ranges of its own, whose
    results one after the other are a run; so every level reads and writes each entry once,
    and a range never opens more than FAN_IN runs. The driver holds a row and a few sampled
    keys for each run and range, and no captures.
    """
    spark = manifest.sparkSession
    folder = folder or run_dir(spark, "merged-runs")
    runs = [
        _Run([(m.run, None, None)], m.records, [order((s.k, s.t, s.p)) for s in m.samples])
        for m in manifest.where("records > 0").orderBy("run").collect()
    ]
    while len(runs) > FAN_IN:
        groups = [runs[i : i + FAN_IN] for i in range(0, len(runs), FAN_IN)]

        def level(group, place, low, high, tree):
            path, n = new_path(folder, f"run-{group:06d}-{place:06d}"), 0

            def counted():
                nonlocal n
                for entry in tree:
                    n += 1
                    yield entry

            write_run(path, counted())
            yield pa.RecordBatch.from_pydict(
                {
                    "group": pa.array([group], pa.int32()), "place": pa.array([place], pa.int32()),
                    "path": [path], "records": pa.array([n], pa.int64()),
                    "bounds": pa.array([pickle.dumps((low, high))], pa.binary()),
                }
            )

        schema = "group int, place int, path string, records long, bounds binary"
        done = materialize(_merges(spark, folder, groups, level, schema), "merge-level")
        merged: list[_Run] = []
        for g, members in enumerate(groups):
            samples = sorted(s for r in members for s in r.samples)
            # a level's samples are as many for a run as the level's before
            merged.append(_Run([], 0, samples[:: max(1, len(samples) // SAMPLES // FAN_IN)]))
        for row in done.where("records > 0").orderBy("group", "place").collect():
            merged[row.group].pieces.append((row.path, *pickle.loads(row.bounds)))
            merged[row.group].records += row.records
        runs = merged

    def merge(_, r, low, high, tree):
        names = ["key_range", "place", *_ENTRY.names]
        kinds = [pa.int32(), pa.int64(), *[f.type for f in _ENTRY]]
        place, block = 0, []

        def batch():
            columns = zip(*[(r, *b) for b in block], strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        for entry in tree:
            block.append((place, *entry))
            place += 1
            if len(block) == 4096:
                yield batch()
                block.clear()
        if block:
            yield batch()

    last = _merges(spark, folder, [runs], merge, f"key_range int, place long, {INDEX}")
    return materialize(last, "merged-index")


def read_captures(index: DataFrame) -> DataFrame:
    """Reads the record of every entry: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, captured, key_range, place. Each archive is read from front to back."""
    sorted_by_file = index.repartition("file").sortWithinPartitions("file", "offset")
    names = [
        *["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        *["url", "captured", "key_range", "place"],
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    kinds += [pa.string(), pa.string(), pa.int32(), pa.int64()]

    def read(batches):
        path, file = None, None
        for files, offsets, lengths, times, ranges, places in rows(
            batches, "file", "offset", "length", "captured", "key_range", "place"
        ):
            out = []
            for name, offset, length, time, r, place in zip(
                files, offsets, lengths, times, ranges, places, strict=True
            ):
                if name != path:
                    path, file = name, reader(name)
                fields, payload, size = parse_record(read_at(file, offset, length))
                kind = fields["WARC-Type"]
                stored = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response":
                    size, stored = len(payload), hashlib.sha256(payload).hexdigest()
                page, refers = fields["Page-Id"], fields.get("Refers-To-Page")
                out.append(
                    (
                        int(page) if page else None,
                        *(size, stored, kind, int(refers) if refers else None),
                        *(fields["WARC-Target-URI"], time, r, place),
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names
            )

    return sorted_by_file.mapInArrow(
        read,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "url string, captured string, key_range int, place long",
    )
