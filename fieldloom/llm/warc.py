"""WARC archives of web pages and their capture index.

Writing: each page is a `response` record, or a `revisit` of the page with the smallest id among those with an equal payload of
at least MIN_SHARED bytes. Records are text in the WARC format (UTF-8 payloads), written by Spark's text writer as gzip files that
are bounded in records and bytes. Reading: each archive is parsed by its Content-Length headers alone, so payloads may hold any
text; payload lengths and SHA-256 digests are computed anew from what was read, and a revisit takes them from its own block and
header.

Index: the task that reads an archive sorts its captures by (URL key, time, id), a run. The key space is cut into ranges of about
RANGE_ROWS captures, the parts of all runs in a range meet in one task, each in its own order, and a loser tree merges them, k
ways, into capture histories that are in order over all ranges. A task holds one range's captures, in Arrow's form, or one
archive's, whatever the size of the corpus.

Edge cases: a null payload is empty; a null URL counts as empty; a page may be of any size that Spark's strings hold; an id may be
any 64-bit number, its time is EPOCH seconds later (the id itself beyond 64 bits), in any session time zone. Rows are judged by id
and payload: repeated rows are all written, those of the smallest id of a payload as responses, and rows of one id with other
payloads have records of their own. A page without an id is a whole response under a name made from its URL and payload, at the
time EPOCH, and has a null id in the index, before others of its URL and time; it is not revisited. An empty table gives an empty
index; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import join_by_key, staged
from fieldloom.sources.staging import shared_path

MIN_SHARED = 100
#: Archives: payloads of up to so many bytes, and how many records of such a file may have; larger ones have a file each.
SIZES = ((1 << 16, 4000), (1 << 22, 64), (1 << 40, 1))
#: About so many captures are merged in one task.
RANGE_ROWS = 100_000
EPOCH = 1_700_000_000
UNNAMED = "none-"
#: Of the years 1000 to 9999; the exact time of any capture stands in a header of its own.
FIRST_SECOND, LAST_SECOND = -30_610_224_000, 253_402_300_799
SECONDS = "X-Captured-Seconds"
END = "\r\n\r\n"


_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)[^/?#]*([^#]*)", re.DOTALL)


def url_key(url: str) -> str:
    """SURT-like: host parts reversed and comma-joined, then the path and query; scheme, www., port and case of the host go."""
    host, path = _URL.match(url).groups()
    return f"{','.join(reversed(re.sub(r'^www[0-9]*[.]', '', host.lower()).split('.')))}){path or '/'}"


def _texts(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, bytes and digest of each payload, written."""
    return staged(_texts(pages).select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest")), "payloads")


def repeats(facts: DataFrame) -> DataFrame:
    """page_id, digest and refers_to (the smallest id of the payload) of rows whose payload an earlier page has, written."""
    large = facts.where(F.col("bytes") >= MIN_SHARED)
    shared = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = join_by_key(large, shared, "digest", "copies", facts.count()).where(F.col("page_id") != F.col("first"))
    return staged(later.select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "repeats")


def records(pages: DataFrame, later: DataFrame | None = None, least: int = -1, most: int | None = None) -> DataFrame:
    """page_id, bytes of payload and record (a whole WARC record, without the two line ends after it) for pages of page_id, url, html
    with payloads of over `least` and up to `most` bytes. later: as repeats() gives it."""
    later = repeats(payloads(pages)) if later is None else later
    rows = _texts(pages).withColumn("n", F.octet_length("html")).where(F.col("n") > least)
    rows = (rows if most is None else rows.where(F.col("n") <= most)).withColumn("digest", F.sha2("html", 256)).join(later, ["page_id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    captured = F.coalesce(F.try_add(F.lit(EPOCH), F.coalesce("page_id", F.lit(0))), F.col("page_id"))
    shown = F.least(F.greatest(captured, F.lit(FIRST_SECOND)), F.lit(LAST_SECOND))  # a date has four digits of a year
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    of_day = F.pmod(shown, F.lit(86400)).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(shown / 86400).cast("int")).cast("string")
    date = F.concat(day, F.lit("T"), two(F.floor(of_day / 3600)), F.lit(":"), two(F.floor(of_day / 60) % 60), F.lit(":"), two(of_day % 60), F.lit("Z"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    unnamed = F.concat(F.lit(UNNAMED), F.sha2(F.concat("url", F.lit("\n"), "digest"), 256))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return rows.select(
        "page_id",
        F.col("n").alias("bytes"),
        F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.coalesce(F.col("page_id").cast("string"), unnamed))), line("WARC-Date", date), line(SECONDS, captured.cast("string")),
            line("WARC-Target-URI", F.col("url")), F.lit("Content-Type: application/http;msgtype=response\r\n"), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(""),
            line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
        ).alias("record"),
    )


def write_archives(pages: DataFrame, path: str) -> int:
    """Writes gzip archives below path, in a folder for each class of SIZES that has pages; returns the number of records. The pages
    are read once for all payloads' facts, and once for each class."""
    facts = payloads(pages)
    classes = F.when(F.col("bytes") <= SIZES[0][0], 0).when(F.col("bytes") <= SIZES[1][0], 1).otherwise(2)
    sizes = {r["i"]: r["count"] for r in facts.groupBy(classes.alias("i")).count().collect()}  # at most one row a class
    later = repeats(facts)
    for i in sorted(sizes):
        found = records(pages, later, SIZES[i - 1][0] if i else -1, SIZES[i][0]).select("record")
        found.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", SIZES[i][1]).text(f"{path}/{i}")
    return sum(sizes.values())


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in a stream of bytes, with no more than one record and one chunk held."""
    held = bytearray()
    more = True

    def fill(n: int) -> bool:
        nonlocal more
        while len(held) < n and more:
            part = next(chunks, None)
            more = part is not None
            held.extend(part or b"")
        return len(held) >= n

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and more:
            fill(len(held) + 1)
        if at < 0:
            if held.strip():
                raise ValueError("a record's header has no end")
            return
        first, *lines = held[:at].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(head["content-length"])
        if not fill(at + 4 + size):
            raise ValueError("a record's block is cut short")
        block = bytes(held[at + 4 : at + 4 + size])
        fill(at + 8 + size)
        if bytes(held[at + 4 + size : at + 8 + size]) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        del held[: at + 8 + size]
        yield head, block


def _inflate(content: memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """Members of a gzip file, one after the other, in parts."""
    z, part, at = None, b"", 0
    while z or part or at < len(content):
        if not part:
            part = bytes(content[at : at + step])
            at += step
        if not z:
            part = part.lstrip(b"\0")  # members may be padded
            if not part:
                continue
            z = zlib.decompressobj(31)
        given = bool(part)
        if out := z.decompress(part, step):
            yield out
        if z.eof:
            z, part = None, z.unused_data
        elif given or out:
            part = z.unconsumed_tail
        else:
            raise ValueError("a gzip member is cut short")


def _number(urn: str) -> int | None:
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name.startswith(UNNAMED) else int(name)


FIELDS = {
    "page_id": pa.int64(), "url": pa.string(), "url_key": pa.string(), "captured": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "run": pa.string(), "run_at": pa.int64(),
}
_SCHEMA = "page_id long, url string, url_key string, captured long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, run_at long"


def _capture(head: dict[str, str], block: bytes) -> tuple:
    """The first eight of FIELDS."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, n, refers = head["warc-payload-digest"].removeprefix("sha256:"), len(payload), None
    if head["warc-type"] == "revisit":
        n = int(http.rpartition(b"Content-Length: ")[2])
        refers = _number(head["warc-refers-to"])
    elif hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
    when = head.get(SECONDS.lower())
    when = int(when) if when else int(datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
    url = head.get("warc-target-uri", "")
    return _number(head["warc-record-id"]), url, url_key(url), when, n, digest, head["warc-type"], refers


def _order(url_key: str, captured: int, page_id: int | None) -> tuple:
    return url_key, captured, page_id is not None, page_id or 0


def read_archives(df: DataFrame) -> DataFrame:
    """Captures of archives (rows of Spark's binaryFile source): a locally sorted run from each, as the index has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                found = [_capture(*record) for record in parse(_inflate(memoryview(content.as_buffer())))]
                found.sort(key=lambda r: _order(r[2], r[3], r[0]))
                rows = [(*r, path.as_py(), i) for i, r in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(FIELDS.values())], names=list(FIELDS))

    return df.select("path", "content").mapInArrow(run, _SCHEMA)


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of the match played there, so a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        k = len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, k)
        for i in range(k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; runs that ended come last."""
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # a first match waits for its opponent
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def capture_index(captures: DataFrame, partitions: int) -> DataFrame:
    """Captures in the order of (url_key, captured, page_id) over all partitions, merged from the runs that were sorted as they were
    read. A URL with very many captures is split by time and id like any others, and equal captures by run and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema(list(FIELDS.items())))  # one range: about RANGE_ROWS captures
        if not held.num_rows:
            return
        keys = list(zip(*(held[c].to_pylist() for c in ("url_key", "captured", "page_id")), strict=True))
        names = held["run"].combine_chunks().dictionary_encode().indices.to_numpy()
        ends = [*(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(keys)]
        runs = [((*_order(*keys[i]), i) for i in range(a, b)) for a, b in zip([0, *ends], ends, strict=False)]
        order = np.fromiter((item[-1] for item in LoserTree(runs)), np.int64, len(keys))
        for at in range(0, len(order), 5000):
            yield from held.take(pa.array(order[at : at + 5000])).combine_chunks().to_batches()

    dealt = captures.repartitionByRange(partitions, "url_key", "captured", "page_id", "run", "run_at").sortWithinPartitions("run", "run_at")
    return dealt.mapInArrow(run, captures.schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder, reads these back and returns their merged capture index."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    written = write_archives(pages, path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
    captures = spark.createDataFrame([], _SCHEMA)
    if written:
        captures = staged(read_archives(found.load(path)), "captures")
    return capture_index(captures, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-written // RANGE_ROWS)))
