"""WARC archives: writing with revisit records, reading back, and a globally ordered index of the captures.

An archive is written by Spark's own text writer, which reaches any store: each row is a record up to its block's end,
the line separator is the blank line that closes a record. That writer gzips a file as a whole (one member, not one a
record) and gives no file a record of its own at the start, so archives have no warcinfo. Payloads are written by classes
of size, so that an archive holds at most about ``ARCHIVE_BYTES`` before compression. The index is an external merge: each archive yields one locally sorted run
of captures; runs are dealt by ranges of URL key, timestamp and page, and each range merges its parts of all runs with
a loser tree. The ranges in order form the global capture history.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import saved

# Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload bytes of an archive, about; one record may be larger.
ARCHIVE_BYTES = 64 << 20
#: Payloads up to so many bytes share archives of ARCHIVE_BYTES // bytes records; larger ones have archives of their own.
CLASSES = (64 << 10, 1 << 20, 16 << 20)
#: Captures that one range of the merged index holds, about.
RANGE_ROWS = 200_000
CAPTURES = "page_id long, url string, url_key string, captured string, record_type string, payload_digest string, payload_bytes long, refers_to long, run string, seq long"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 8 times 5 hex digits give 4 letters each."""
    digits = F.sha1(data)
    part = lambda i: F.conv(F.substr(digits, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
    letter = lambda i: F.substr(F.lit(BASE32), F.expr("1") + F.call_function("shiftright", part(i), (15 - (i % 4) * 5).cast("int")).bitwiseAND(31), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def record_id(page: Column, digest: Column) -> Column:
    """Rows that repeat page and payload describe one capture and share its id."""
    h = F.sha1(F.concat_ws(" ", page.cast("string"), digest).cast("binary"))
    cut = [F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with html not null, payload_digest, payload_bytes, record_type and refers_to.

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the largest page_id are response, the
    others revisit it; smaller payloads are all response. Rows with a null page_id are never the largest; if all of a
    payload's are null, all are response.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("payload_digest", base32_sha1(F.col("html").cast("binary"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    held = saved(own.select("page_id", "payload_digest", "payload_bytes").distinct())
    last = held.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("last"))
    verdict = held.join(last, "payload_digest", "left").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "last")
    both = own.join(verdict, own["page_id"].eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")))
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return both.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, captured: Column | None = None, largest: int | None = None) -> None:
    """Write the rows of ``deduplicated`` as WARC 1.1 records into gzipped archives below ``path``.

    ``captured`` is the time of each capture as text; by default one second per page_id from the start of 2024. A
    revisit holds the response's HTTP head but no payload. Line breaks inside URLs are percent-encoded. Null pages
    have no X-Page-ID, repeated rows are records each, and no rows leave an empty folder. ``largest``, the bytes of the
    largest payload, is looked up if it isn't given.
    """
    if captured is None:
        captured = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", captured),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"))), line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
    )
    size, low = F.col("payload_bytes"), -1
    if largest is None:
        largest = records.agg(F.max("payload_bytes")).first()[0] or 0
    for high in (*CLASSES, None):
        part = records.where(size > low) if high is None else records.where((size > low) & (size <= high))
        writer = part.select(F.concat(head, F.lit(END), block)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_BYTES // high if high else 1)
        writer.mode("overwrite" if low < 0 else "append").text(path)
        if high is None or largest <= high:
            return
        low = high


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then port, path and query; the scheme and a leading www. go."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail.lower()


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The archive's bytes in parts of about ``step``, whether it is gzipped (in one or more members) or plain."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            part = member.decompress(data, step)
            data = member.unconsumed_tail
            if not part and not data and not member.eof:
                raise ValueError("the archive ends inside a gzip member")
            yield part
        data = member.unused_data


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive; of the inflated bytes no more than a record is held at a time."""
    parts, held, end = _inflated(data), bytearray(), END.encode()

    def filled(size: int) -> bool:
        while len(held) < size:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while filled(1):
        stop = held.find(end)
        while stop < 0:
            if not filled(len(held) + 1):
                raise ValueError("a record has no end of its headers")
            stop = held.find(end)
        version, *lines = held[:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        headers = dict(line.split(": ", 1) for line in lines)
        lo = stop + len(end)
        hi = lo + int(headers["Content-Length"])
        if not filled(hi + len(end)) or held[hi : hi + len(end)] != end:
            raise ValueError("a record doesn't end where it says")
        yield headers, bytes(held[lo:hi])
        del held[: hi + len(end)]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; each archive's rows are one sorted run (run, seq).

    A response's payload is held against its digest, and a difference is an error; a revisit has digest and size from
    its headers. No archives give an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for headers, block in parse_archive(content.as_py()):
                    http, payload = block.split(END.encode(), 1)
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    size = int(http.rpartition(b": ")[2])
                    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size):
                        raise ValueError(f"{name}: payload differs from its digest")
                    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                    url = headers.get("WARC-Target-URI", "")
                    rows.append((page and int(page), url, url_key(url), headers["WARC-Date"], kind, digest, size, refers and int(refers)))
                rows.sort(key=capture_order)
                names = [f.split()[0] for f in CAPTURES.split(", ")]
                cols = list(zip(*rows)) or [()] * 8
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                made = [pa.array(c, k) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([*made, pa.array([name.as_py()] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CAPTURES)


def capture_order(row: tuple) -> tuple:
    """By URL key, time, page (null first) and payload digest."""
    return (row[2], row[3], row[0] is not None, row[0] or 0, row[5])


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its match, so an item costs log2 k comparisons."""

    def __init__(self, runs: Iterable[Iterator[tuple]], order):
        self.runs, self.order = list(runs), order
        k = len(self.runs)
        self.items: list = [None] * k
        self.keys: list = [None] * k
        for i in range(k):
            self._next(i)
        self.losers = [-1] * k
        for i in range(k):
            self._replay(i)

    def _next(self, i: int) -> None:
        self.items[i] = next(self.runs[i], None)
        self.keys[i] = (1,) if self.items[i] is None else (0, self.order(self.items[i]), i)

    def _replay(self, winner: int) -> None:
        k = len(self.runs)
        node = (winner + k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:  # first visit while building
                self.losers[node] = winner
                return
            if self.keys[other] < self.keys[winner]:
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            top = self.losers[0]
            if self.items[top] is None:
                return
            yield self.items[top]
            self._next(top)
            self._replay(top)


def merged_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures in global order of URL key, timestamp, page, digest, run and place there, over all partitions in turn.

    A range holds about ``range_rows`` captures whatever the inputs' number: page, digest, run and place in the key split
    a URL that has very many captures, also ones that repeat. Spark brings each range's part of every run, in the run's
    order; the loser tree merges them. Null pages come first, repeated captures all stay, and no captures give an empty
    index.
    """
    ranges = max(1, -(-captures.count() // range_rows))
    dealt = captures.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_first(), "payload_digest", "run", "seq").sortWithinPartitions("run", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        whole = pa.Table.from_batches(tables).combine_chunks()
        keys = list(zip(*(whole.column(c).to_pylist() for c in ("page_id", "url", "url_key", "captured", "run", "payload_digest"))))
        name = whole.column("run").to_pylist()
        starts = [i for i in range(len(name)) if i == 0 or name[i] != name[i - 1]]
        slices = [((*keys[i], i) for i in range(a, b)) for a, b in zip(starts, [*starts[1:], len(name)])]
        order = [row[6] for row in LoserTree(slices, capture_order)]
        yield from whole.take(pa.array(order)).to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, CAPTURES)
