"""Web archives: records written as WARC files, read back, and merged into one ordered index.

Each task writes its records as one gzipped file. Payloads of at least MIN_BYTES that several pages share
are stored once, with the page of the largest id; the others are revisit records that name it. Reading
streams through each archive, checks every payload against its digest, and leaves a run: the archive's
captures sorted by URL key and time. Runs are cut at the same URL keys into ranges, and each range's
runs are merged by a loser tree, so that the ranges in order are the ordered capture history.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import settle, shared_dir

MIN_BYTES = 1000
#: Capture times start here (2024-01-01 UTC) where pages have none: a second for each id, within ten years.
START = 1704067200
SPAN = 315360000
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def marked(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest (SHA-1), refers_to: the largest page_id with
    an equal payload of at least ``min_bytes``, if that is another one, else null; and refers_url: that page's url."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "key": F.sha2("payload", 256)}
    )
    shared = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("key")
        .agg(F.max(F.struct("page_id", "url")).alias("largest"), F.count("*").alias("n")).where("n > 1")
        .select("key", F.col("largest.page_id").alias("largest"), F.col("largest.url").alias("largest_url"))
    )
    other = F.col("largest").isNotNull() & ~F.col("largest").eqNullSafe(F.col("page_id"))
    referred = {"refers_to": F.when(other, F.col("largest")), "refers_url": F.when(other, F.col("largest_url"))}
    return rows.join(shared, "key", "left").withColumns(referred).drop("key", "largest", "largest_url")


def record(when: Column) -> Column:
    """A WARC/1.1 record, but for its last line feed, of the columns of ``marked`` and a time."""
    def header(name: str, value) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))

    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def name(page: str, url: str) -> Column:
        return F.concat(F.lit("<urn:md5:"), F.md5(F.concat_ws(" ", F.col(page).cast("string"), url, "digest")), F.lit(">"))

    return F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, F.lit(REVISIT)).otherwise(F.lit(RESPONSE))),
        header("WARC-Record-ID", name("page_id", "url")),
        header("WARC-Page-ID", F.col("page_id").cast("string")),
        header("WARC-Target-URI", url),
        header("WARC-Date", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        header("WARC-Refers-To", F.when(revisit, name("refers_to", "refers_url"))),
        header("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body, F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, when: Column | None = None) -> str:
    """Writes a record for every row of ``pages`` (page_id bigint, url, html) under ``path``, one
    gzipped file per task; ``when`` is a row's capture time, by default derived from its id.

    Null html is an empty payload; a null url or page_id leaves its header out. Of equal payloads
    of at least ``min_bytes``, all rows of the largest page_id are responses and the others revisit it;
    rows without an id only are all responses. A revisit names its response by record id. Other columns are ignored; an empty table writes no records.
    """
    if when is None:
        when = F.timestamp_seconds(F.lit(START) + F.coalesce(F.pmod("page_id", F.lit(SPAN)), F.lit(0)))
    marked(pages, min_bytes).select(record(when).alias("value")).write.text(path, compression="gzip")
    return path


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, so that a site's captures sort together."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return (url or "").lower()
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2].lower().partition(":")[0]
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:].partition("#")[0] or "/")


CAPTURE = (
    "archive string, offset bigint, url_key string, captured string, page_id bigint, url string, record_type string, "
    "payload_bytes bigint, payload_digest string, refers_to bigint"
)
NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's bytes, piece by piece; members may follow one another."""
    view, at = memoryview(content), 0
    stream = zlib.decompressobj(31)
    while at < len(view):
        yield stream.decompress(view[at : at + step])
        at = min(at + step, len(view))
        while stream.eof and stream.unused_data:
            rest, stream = stream.unused_data, zlib.decompressobj(31)
            yield stream.decompress(rest)
    yield stream.flush()


def records(pieces: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of each record in a stream of WARC bytes; holds one record at a time."""
    buffer, offset, parts = bytearray(), 0, iter(pieces)

    def more() -> bool:
        for p in parts:
            if p:
                buffer.extend(p)
                return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError(f"half a record at {offset}")
                return
        first, *lines = buffer[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {offset}")
        headers = {k: v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(headers["Content-Length"])
        whole = end + 4 + size + 4
        while len(buffer) < whole:
            if not more():
                raise ValueError(f"half a record at {offset}")
        yield offset, headers, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[:whole]
        offset += whole


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            run = []
            for offset, h, body in records(inflated(content.as_buffer())):
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                response = h["WARC-Type"] == RESPONSE
                if response and sha1(body).hexdigest() != digest:
                    raise ValueError(f"{path} at {offset}: the payload does not have its digest")
                page, url, other = h.get("WARC-Page-ID"), h.get("WARC-Target-URI"), h.get("WARC-Refers-To-Page-ID")
                run.append((
                    path, offset, url_key(url), h["WARC-Date"], page and int(page), url, h["WARC-Type"],
                    len(body) if response else None, digest, other and int(other),
                ))
            run.sort(key=order)
            yield batch_of(run)


def order(capture: tuple) -> tuple:
    """URL key, time, then id (null first), archive and offset."""
    return capture[2], capture[3], capture[4] is not None, capture[4] or 0, capture[0], capture[1]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if "bigint" in c else pa.string() for c in CAPTURE.split(", ")]
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every capture under ``path``; each archive's are a run, sorted by ``order``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(_read, CAPTURE)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of the match played there, so the next
    row takes one match per level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [0] * self.k
        self.winner = self._play(1) if self.k else 0

    def _next(self, i: int) -> tuple:
        row = next(self.runs[i], None)
        return (1,) if row is None else (0, order(row), i, row)  # an exhausted run loses to all

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, self.losers[node] = (a, b) if self.heads[a][:3] <= self.heads[b][:3] else (b, a)
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner][0] == 0:
            yield self.heads[self.winner][3]
            i = self.winner
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                other = self.losers[node]
                if self.heads[other][:3] < self.heads[i][:3]:
                    self.losers[node], i = i, other
                node //= 2
            self.winner = i


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's captures arrive run after run."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in NAMES)):
            runs.setdefault(row[0], []).append(row)
    out = []
    for row in LoserTree([iter(r) for r in runs.values()]):
        out.append(row)
        if len(out) == 10_000:
            yield batch_of(out)
            out = []
    yield batch_of(out)


def history(captures: DataFrame) -> DataFrame:
    """The captures of all runs in one order: by range (partition), and within it by URL key, time, id.

    A URL with very many captures is cut between them, as ranges are of URL key, time, id, archive and
    offset. Null URLs have the empty key.
    """
    key = ["url_key", "captured", "page_id", "archive", "offset"]
    ranges = settle(captures).repartitionByRange(*key)
    return ranges.sortWithinPartitions("archive", *key).mapInArrow(_merge, CAPTURE)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, path: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives, reads them back and returns the ordered history as (page_id,
    payload_bytes, payload_digest, record_type, refers_to). Size and digest are of the full payload,
    for a revisit those of the response that it names. See ``write_archives`` for nulls and ties."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/tillroll/{uuid.uuid4().hex}"
    ordered = settle(history(read_archives(spark, write_archives(pages, path, min_bytes))))
    named = (
        ordered.where((F.col("record_type") == RESPONSE) & (F.col("payload_bytes") >= min_bytes))
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    )
    return ordered.join(named, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
