"""Operator 5: WARC archives, and the external merge of their indexes.

Archives are volumes of bounded size, in which each record is a gzip member of its own, so that one can be read by offset and length; Spark's text
writer puts them on any file system that it writes to, with its commits. Payloads that were seen before become revisits.
Each volume read back gives a run of index rows, sorted in its task. The runs are dealt into ranges of (URL key, timestamp,
id); in each range they stand as short sorted chunks, and a loser tree merges the runs, holding of each no more than the chunk that it is at:
the ranges in turn are all captures in global order, the captures of a URL key next to each other by time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import materialise, new_path, ship, with_doubt

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
#: Bytes of a volume: another begins when it has as many.
VOLUME = 32 << 20
#: Index rows of a chunk that the merge holds of a run.
CHUNK = 32
#: Where pages have no capture time, a page's is this many seconds after the first.
FIRST_CAPTURE = 1_704_067_200
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null. Line ends inside a value are percent-encoded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def with_digests(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """page_id, url, html (null: empty), captured (seconds), payload_bytes, payload_digest, and first: the id of the response that a revisit
    refers to, else null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    time = F.coalesce(F.col("page_id").cast("long"), F.lit(0)) + FIRST_CAPTURE if captured is None else captured.cast("long")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), time.alias("captured"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    big = rows.where(F.col("payload_bytes") >= LEAST_BYTES)
    seen = big.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("payload_digest").alias("seen"), "first")
    # written, so that the planner knows its size: a small one is broadcast; else only payloads that may be in it are shuffled
    seen = materialise(seen, "seen")
    told = with_doubt(rows, F.col("payload_digest"), seen.select("seen"))
    rest = told.where("__doubt").drop("__doubt")
    joined = rest.join(seen, rest.payload_digest == seen.seen, "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    columns = ["page_id", "url", "html", "captured", "payload_bytes", "payload_digest"]
    return told.where("not __doubt").select(*columns, F.lit(None).cast("long").alias("first")).unionByName(joined.select(*columns, first))


def records(rows: DataFrame) -> DataFrame:
    """One WARC/1.1 record a row, without the line ends that follow it."""
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    number = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _line("WARC-Record-ID", number(F.col("page_id"))), _line("WARC-Date", F.date_format(F.timestamp_seconds("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _line("WARC-Refers-To", F.when(revisit, number(F.col("first")))),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def _volumes(volume: int):
    """Concatenated gzip members, a row for each volume, without the zero byte that ends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()

        def full() -> pa.RecordBatch:
            if held[-1]:  # a record of 16 MB or more; an empty member ends in zeros
                held.extend(gzip.compress(b"", mtime=0))
            out = pa.RecordBatch.from_arrays([pa.array([bytes(held[:-1])], pa.large_binary())], ["value"])
            held.clear()
            return out

        for batch in batches:
            for record in batch.column(0):
                held += gzip.compress(record.as_py().encode() + b"\r\n\r\n", 6, mtime=0)
                if len(held) >= volume:
                    yield full()
        if held:
            yield full()

    return run


def write_archives(pages: DataFrame, path: str, captured: Column | None = None, volume: int = VOLUME) -> None:
    """Writes ``pages`` (page_id, url, html) as compressed WARC files into the folder ``path``.

    Of pages with equal payloads of LEAST_BYTES or more, that with the smallest id is a response and the others are revisits of it; all rows
    with that id, and all rows where no id is known, are responses. Null html is an empty payload; a null url gives no target
    line; further columns aren't used; an empty table gives an empty folder. Very long payloads are whole records, up to Spark's 2 GB for a value.
    The session's time zone must be UTC for the dates to be so.
    """
    ship(pages.sparkSession)
    volumes = records(with_digests(pages, captured)).mapInArrow(_volumes(volume), "value binary")
    # the bytes as they are, a volume a file; the line end is the zero byte that they lack
    volumes.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).mode("error").text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, in lower case, and block of each record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record ends before its length")
        yield head, block


def url_key(url: str | None) -> str:
    """The host's labels from the last, then port, path and query: captures of a site stand together. Null gives an empty key."""
    if not url:
        return ""
    try:
        x = urlsplit(url)
        host, port = (x.hostname or "").removeprefix("www."), x.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    rest = (x.path or "/") + (f"?{x.query}" if x.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + rest.lower()


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


INDEX = pa.schema([
    ("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
INDEX_DDL = "run string, offset long, length long, url_key string, captured long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def order_of(row: dict) -> tuple:
    return row["url_key"], row["captured"], row["page_id"] is None, row["page_id"] or 0, row["record_type"], row["run"], row["offset"]


#: The same order as columns.
ORDER = ("url_key", "captured", "page_id", "record_type", "run", "offset")


def members(content) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and decompressed bytes of each gzip member, one after another."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts, to = zlib.decompressobj(31), [], at
        while not z.eof:
            if to >= len(view):
                raise ValueError("an archive ends within a record")
            parts.append(z.decompress(view[to : to + (1 << 14)]))
            to = min(to + (1 << 14), len(view))
        to -= len(z.unused_data)
        yield at, to - at, b"".join(parts)
        at = to


def index_rows(content: bytes, run: str) -> list[dict]:
    """The sorted index of an archive; a response's payload must have the digest that its header names."""
    rows = []
    for offset, length, record in members(content):
        for head, block in parse(io.BytesIO(record)):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
            if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"the payload of {head['warc-record-id']} in {run} isn't what its header says")
            at = int(datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
            url = head.get("warc-target-uri")
            rows.append({
                "run": run, "offset": offset, "length": length, "url_key": url_key(url), "captured": at, "page_id": _number(head["warc-record-id"]), "url": url,
                "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _number(head.get("warc-refers-to")),
            })
    rows.sort(key=order_of)
    return rows


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = index_rows(content.as_buffer(), path.as_py())
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[a : a + 10_000], INDEX)


def read_record(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record that the index has at this place of its volume."""
    return next(parse(io.BytesIO(gzip.decompress(content[offset : offset + length]))))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all archives in a folder: a sorted run for each file, with each record's offset and length in it."""
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(_index, INDEX_DDL)


class LoserTree:
    """Merges sorted runs: each inner node keeps the run that lost there, so the next item costs one comparison a level.

    Runs come in chunks. A run that is out of items takes no part until its next chunk is added; that changes one path of the tree. The leaves are a power of two, which doubles
    when there are more runs.
    """

    def __init__(self) -> None:
        self.number: dict[object, int] = {}
        self.queues: list[deque] = [deque()]
        self.losers: list[int] = [-1]
        self.winner = 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.queues[a], self.queues[b]
        return not y or bool(x) and (x[0][0], a) < (y[0][0], b)

    def _play(self) -> None:
        """All games from the leaves k to 2k - 1 up."""
        k = len(self.queues)
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1]

    def _rise(self, run: int) -> None:
        """Puts a run that was out of items, so beat only others that are, where it belongs now."""
        k = len(self.queues)
        node = (run + k) // 2
        while node and self.losers[node] != run:
            node //= 2
        while node:  # the run lost at this node, to the one that went on from it
            level = k.bit_length() - node.bit_length()  # the numbers of the leaves below a node begin with its bits
            above = node // 2
            while above and (self.losers[above] + k) >> level != node:
                above //= 2
            other = self.losers[above] if above else self.winner
            if not self._beats(run, other):
                self.losers[node] = run
                return
            self.losers[node] = other
            node = above
        self.winner = run

    def add(self, run: object, items: list[tuple]) -> None:
        """Appends items (key, ...) to a run, in order."""
        grown = False
        if run not in self.number:
            self.number[run] = len(self.number)
            if len(self.number) > len(self.queues):
                self.queues += [deque() for _ in self.queues]
                self.losers = [-1] * len(self.queues)
                grown = True
        at = self.number[run]
        idle = not self.queues[at]
        self.queues[at].extend(items)
        if grown:
            self._play()
        elif idle and self.winner != at:
            self._rise(at)

    def least(self):
        """The least key of all; None where all runs are out of items."""
        return self.queues[self.winner][0][0] if self.queues[self.winner] else None

    def pop(self) -> tuple:
        win = self.winner
        item = self.queues[win].popleft()
        node = (win + len(self.queues)) // 2
        while node >= 1 and len(self.queues) > 1:
            if not self._beats(win, self.losers[node]):
                win, self.losers[node] = self.losers[node], win
            node //= 2
        self.winner = win
        return item


def merged(chunks: Iterator[tuple[object, list[tuple]]]) -> Iterator[tuple]:
    """Items (key, ...) in order, from chunks (run, items) in order of their first keys. A chunk is taken in when the merge has come to its first key, so no
    more is held than the chunk that each run is at."""
    tree, coming = LoserTree(), next(chunks, None)
    while True:
        while coming is not None and ((least := tree.least()) is None or coming[1][0][0] <= least):
            tree.add(*coming)
            coming = next(chunks, None)
        if tree.least() is None:
            return
        yield tree.pop()


_CHUNK_DDL = "url_key string, captured long, page_id long, record_type string, run string, offset long, rows binary"
_CHUNK = pa.schema([("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("run", pa.string()), ("offset", pa.int64()), ("rows", pa.binary())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs, one after another, as chunks with their first keys."""

    def packed(rows: pa.RecordBatch) -> dict:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        return {c: rows.column(c)[0].as_py() for c in ORDER} | {"rows": sink.getvalue().to_pybytes()}

    for batch in batches:
        run = batch.column("run").to_pylist()
        cuts = [0] + [i for i in range(1, len(run)) if run[i] != run[i - 1]] + [len(run)]
        out = [packed(batch.slice(i, min(CHUNK, b - i))) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in range(a, b, CHUNK)]
        if out:
            yield pa.RecordBatch.from_pylist(out, _CHUNK)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def chunks() -> Iterator[tuple[str, list[tuple]]]:
        for batch in batches:
            for blob in batch.column("rows"):
                rows = pa.ipc.open_stream(blob.as_buffer()).read_all().to_pylist()
                yield rows[0]["run"], [(order_of(r), r) for r in rows]

    out: list[dict] = []
    for place, (_, row) in enumerate(merged(chunks())):
        out.append({**row, "place": place})
        if len(out) == 10_000:
            yield pa.RecordBatch.from_pylist(out, MERGED)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, MERGED)


MERGED = INDEX.append(pa.field("place", pa.int64()))


def merge_indexes(index: DataFrame, ranges: int | None = None) -> DataFrame:
    """All index rows in global order of (url_key, captured, page_id), nulls last: columns of the index, part, place, position.

    ``part`` numbers the ranges in order, ``place`` the rows in each and ``position`` all of them, from 0. A URL key with most of all captures is spread
    over ranges by time and id. Rows that repeat stand next to each other. An empty index gives an empty result.
    """
    spark = index.sparkSession
    ship(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_last() for c in ORDER]
    dealt = index.repartitionByRange(ranges, *order).sortWithinPartitions("run", *order)
    chunks = dealt.mapInArrow(_chunks, _CHUNK_DDL).sortWithinPartitions(*order)
    # written, since the ranges are found from a sample
    parts = materialise(chunks.mapInArrow(_merge, INDEX_DDL + ", place long").withColumn("part", F.spark_partition_id()), "merged")
    begins, upto = {}, 0
    for r in sorted(parts.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each range
        begins[r.part], upto = upto, upto + r.n
    begin = F.get(F.array(*[F.lit(begins.get(i, 0)).cast("long") for i in range(max(begins, default=0) + 1)]), F.col("part"))
    return parts.withColumn("position", begin + F.col("place"))


def archive_and_index(pages: DataFrame, path: str | None = None, volume: int = VOLUME) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and merges their indexes; see ``write_archives`` and ``merge_indexes``."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, volume=volume)
    return merge_indexes(materialise(read_index(spark, path), "index"))
