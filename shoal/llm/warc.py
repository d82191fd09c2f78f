"""WARC archives of pages, read back into a merged capture index.

Writing: a record is one text value, so Spark's text sink writes (and commits) the
archives on any file system it knows; files are gzipped and bounded by a number of
records that fits their size class. Equal payloads of some length are stored once, as
a response; the others are revisits that refer to it.

Reading: each task parses archives by their content lengths and writes its captures,
sorted by URL key and time, as runs. Range partitions of the runs are then merged by a
loser tree in each task, which gives capture histories in one global order. There are
as many ranges as keep each to a fixed number of captures, however large the index.

A capture names its archive and where in it its record lies, so that `fetch` finds it
again. Places count bytes of the unzipped archive; to reach one, a task unzips what
stands before it, bit by bit.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, table

#: Payloads below this are always stored.
LEAST_REVISIT = 1000
#: Size classes: (payload bytes up to, records a file at most); the last takes all larger ones.
CLASSES = ((64 << 10, 4096), (4 << 20, 8), (1 << 62, 1))
CAPTURE = "page_id long, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
#: Captures of a range, about; a task holds that many while it merges.
RANGE = 100_000


def header(url: Column) -> Column:
    """A URL as a header value: blanks and control characters percent-encoded."""
    for c in (" ", "\r", "\n", "\t", "\x0b", "\x0c", "\x00"):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return url


def plan_records(pages: DataFrame, id_col: str, url: str, html: str, captured: Column | None) -> DataFrame:
    """Rows to write: page_id, url, captured, payload, payload_bytes, digest, refers_to (null: a response).

    Only ids and digests are grouped and joined by digest; payloads move once, by page.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    at = captured if captured is not None else F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col(id_col), F.lit(0)).cast("long") % 31_536_000)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), body.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    keys = table(rows.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest"), "payload-keys")
    kept = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_low")).where("_low < refers_to").drop("_low")
    revisits = table(keys.join(kept, "digest").where("page_id < refers_to").distinct(), "revisits")
    drop(keys)
    if revisits.isEmpty():
        return rows.withColumn("refers_to", F.lit(None).cast("long"))
    return rows.join(revisits, ["page_id", "digest"], "left")


def record() -> Column:
    """The whole record of a planned row, without its last line end."""
    crlf = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(crlf * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(crlf)), F.lit(""))  # noqa: E731  # no value, no line
    return F.concat(
        F.lit(f"WARC/1.1{crlf}"),
        F.when(revisit, F.lit(f"WARC-Type: revisit{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}")).otherwise(F.lit(f"WARC-Type: response{crlf}")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", header(F.col("url"))), line("WARC-Date", F.col("captured")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit(f"Content-Type: application/http; msgtype=response{crlf}"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(crlf), block, F.lit(crlf))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None) -> None:
    """Write a record of each row of pages below path.

    Null html is an empty payload, a null url or id has no line in the header. Of equal
    payloads of LEAST_REVISIT bytes or more the largest id is the response and smaller
    ones revisit it; rows that repeat an id and its payload are records of their own.
    """
    rows = plan_records(pages, id_col, url, html, captured)
    least = 0
    for most, records in CLASSES:
        part = rows.where((F.col("payload_bytes") >= least) & (F.col("payload_bytes") < most))
        if least and pages.where(F.octet_length(F.col(html).cast("string")).between(least, most - 1)).isEmpty():
            least = most
            continue
        (part.select(record().alias("value")).write.mode("append").option("lineSep", "\r\n").option("compression", "gzip")
         .option("maxRecordsPerFile", records).text(path))
        least = most


class Stream:
    """Reads a gzipped archive's content bit by bit."""

    def __init__(self, data: bytes):
        self.data, self.at, self.ahead, self.unzip, self.given = data, 0, bytearray(), zlib.decompressobj(31), 0

    def more(self) -> bool:
        while self.at < len(self.data) or self.unzip.unused_data:
            if self.unzip.eof:
                self.unzip, rest = zlib.decompressobj(31), self.unzip.unused_data
            else:
                rest, self.at = self.data[self.at : self.at + 65_536], self.at + 65_536
            if got := self.unzip.decompress(rest):
                self.ahead += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.ahead.find(mark, seen)) < 0:
            seen = max(0, len(self.ahead) - len(mark))
            if not self.more():
                return None
        out = bytes(self.ahead[:k])
        del self.ahead[: k + len(mark)]
        self.given += k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.ahead) < n and self.more():
            pass
        if len(self.ahead) < n:
            raise ValueError("an archive ends within a record")
        out = bytes(self.ahead[:n])
        del self.ahead[:n]
        self.given += n
        return out


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header lines by lower-case name, block, offset, length) of each record of a gzipped archive."""
    stream, offset = Stream(data), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins here: {version[:40]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        block = stream.take(int(fields["content-length"]))
        stream.take(4)
        yield fields, block, offset, stream.given - offset
        offset = stream.given


def url_key(url: str) -> str:
    """Sort-friendly form: host names reversed by commas, then `)` and the rest; case of the host ignored."""
    rest = url.partition("://")[2] or url
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def page_of(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def capture(fields: dict[str, str], block: bytes) -> tuple:
    """An index row; length and digest of a response are computed from its payload, those of a revisit are told."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "response":
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if fields.get("warc-payload-digest", "sha1:" + digest) != "sha1:" + digest:
            raise ValueError("a payload doesn't have its digest")
    else:
        n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
    return page_of(fields.get("warc-record-id")), url_key(fields.get("warc-target-uri", "")), fields.get("warc-date"), n, digest, kind, page_of(fields.get("warc-refers-to"))


NAMES = ["page_id", "url_key", "captured", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for archive, data in zip(*batch.columns, strict=True):
            for fields, block, offset, length in records(data.as_py()):
                rows.append((*capture(fields, block), archive.as_py(), offset, length))
                if len(rows) == 5000:
                    yield _batch(rows)
                    rows = []
    yield _batch(rows)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: Sequence[Iterator[tuple]]):
        self.runs, self.k = [iter(r) for r in runs], max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k - 1, -1, -1):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.losers[node] < 0:  # while building: wait for the other side
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of a range partition: rows (run, captures...) -> captures in order."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for run, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page, key, at, *_, archive, offset, _ = row
            runs.setdefault(run, []).append((key, at or "", page is not None, page or 0, archive, offset, tuple(row)))
    for rows in runs.values():
        if any(a[:6] > b[:6] for a, b in zip(rows, rows[1:])):  # a retried fetch may deliver a run in pieces
            rows.sort(key=lambda r: r[:6])
    out: list[tuple] = []
    for *_, row in LoserTree([iter(rows) for _, rows in sorted(runs.items())]):
        out.append(row)
        if len(out) == 5000:
            yield _batch(out)
            out = []
    yield _batch(out)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives below a path, in the global order of (url_key, captured, page_id, archive, offset).

    The order is that of the partitions and of the rows within them. Archives are gzipped;
    one that is torn, or whose payloads don't have their digests, fails the job. Without
    archives there are no captures.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    order = ["url_key", "captured", "page_id", "archive", "offset"]
    runs = table(files.mapInArrow(captures, CAPTURE).sortWithinPartitions(*order), "runs")
    ranges = max(1, -(-runs.count() // RANGE))
    runs = runs.select(F.col("_metadata.file_path").alias("run"), *NAMES)
    return runs.repartitionByRange(ranges, *order).mapInArrow(merge, CAPTURE)


def fetch(spark: SparkSession, path: str | list[str], wanted: DataFrame) -> DataFrame:
    """(archive, offset, record_type string, payload binary) of the captures named by `wanted` (archive, offset).

    Reads the archives below `path`, which may list just those that matter. Payloads of
    revisits are null; theirs is that of the page they refer to. Captures asked for more
    than once come once; places where no record begins, and nulls, give nothing.
    """
    # An archive has a bounded number of records, and offsets are distinct.
    places = wanted.where("archive is not null and offset is not null").groupBy("archive").agg(F.collect_set(F.col("offset").cast("long")).alias("offsets"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")
    return files.join(places, "archive").select("archive", "content", "offsets").mapInArrow(payloads, "archive string, offset long, record_type string, payload binary")


def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of the records at the given offsets, one batch each."""
    for batch in batches:
        for archive, data, offsets in zip(*batch.columns, strict=True):
            left = set(offsets.as_py())
            for fields, block, offset, _ in records(data.as_py()):
                if offset in left:
                    left.discard(offset)
                    kind = fields["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    yield pa.RecordBatch.from_arrays([pa.array([archive.as_py()]), pa.array([offset], pa.int64()), pa.array([kind]), pa.array([payload], pa.binary())], names=["archive", "offset", "record_type", "payload"])
                if not left:
                    break
