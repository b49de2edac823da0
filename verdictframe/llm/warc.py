"""WARC archives of web pages: written, read back, and indexed by address and time.

Writing is row-local SQL: a record is one string, and Spark's text writer puts the blank lines between records behind
it, so the part files are WARC 1.1 files (uncompressed, about ``FILE_BYTES`` each). Payloads of ``LEAST_BYTES`` or more that occur
under several ids are kept once, in the record of the smallest id; the others become revisit records, which hold the HTTP
headers only. Digests are counted before the shuffle; those of at least 1 in 10,000 rows (so at most 10,000) are
broadcast, so that no hot payload meets in a task.

Reading parses whole files by Content-Length, checks every payload against its digest and writes each file's captures as a
run sorted by URL key, time, id and place. Runs are cut into ranges of the whole key (its last parts are
unique, so a hot address is cut, too) of about ``RANGE_ROWS`` rows; in a range a loser tree merges the
parts of all runs. A capture's rank in its address's history adds the counts of earlier ranges, which matter
only for addresses that cross a border.

Defined results: null html counts as empty, null ids stay null and are later than all others (a payload under null ids alone is
kept every time); rows with one id and one payload are records of the same type; a null url gives no target line and an empty URL key;
CR and LF in a url are percent-encoded; texts of any length are stored whole; an empty table gives empty archives; columns other than those
named do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictframe.llm.shared import broadcast_within, stored
from verdictframe.session import scratch_path

#: Bytes from which an equal payload is stored once.
LEAST_BYTES = 100
#: About the bytes of one archive file.
FILE_BYTES = 32 << 20
#: Captures, and bytes of their keys, of one merged range.
RANGE_ROWS, RANGE_BYTES = 100_000, 32 << 20
#: A payload of more than one in so many rows is hot.
HOT_SHARE = 10_000
#: Captures without a time of their own are dated by their ids from here on.
FIRST_CAPTURE = 1_577_836_800
ID_SECONDS = 100_000_000

# Lines of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END_OF_LINE, END_OF_RECORD = "\r\n", "\r\n\r\n"
RECORD_ID = "urn:page:"

RECORDS = (
    "page_id long, url string, urlkey string, captured string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, archive string, offset long, length long, place long"
)
COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]


# ----------------------------------------------------------------- writing

def decided(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, int]:
    """``pages`` (page_id, url, captured, payload) with digest, bytes and refers_to (null: a response), and the records per file."""
    sized = pages.withColumns({
        "bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.encode("payload", "UTF-8"), 256),
    })
    groups = sized.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("copies"), F.count("page_id").alias("named")
    ).filter("first_id < last_id OR (named > 0 AND named < copies)")
    groups = stored(groups.select("digest", "first_id", "copies"), "payloads")
    total = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("bytes")).first()
    hot = F.col("copies") * HOT_SHARE >= max(total["n"], HOT_SHARE)
    names = groups.select("digest", F.col("first_id"))
    many = F.broadcast(names.filter(hot).withColumnRenamed("first_id", "hot_id"))
    few = broadcast_within(names.filter(~hot), 200_000)
    found = sized.join(many, "digest", "left").join(few, "digest", "left")
    first = F.when(F.col("bytes") >= least_bytes, F.coalesce("hot_id", "first_id"))
    out = found.withColumn("refers_to", F.when(~first.eqNullSafe(F.col("page_id")), first)).drop("hot_id", "first_id")
    mean = (total["bytes"] or 0) // max(total["n"], 1) + 600
    return out, max(1, FILE_BYTES // mean)


def record(page_id: Column, url: Column, captured: Column, payload: Column, size: Column, digest: Column, refers_to: Column) -> Column:
    """One WARC record without the blank lines behind it."""
    revisit = refers_to.isNotNull()

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END_OF_LINE)), F.lit(""))

    def urn(number: Column) -> Column:
        return F.concat(F.lit(f"<{RECORD_ID}"), number, F.lit(">"))

    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + END_OF_LINE + "Content-Type: text/html; charset=utf-8" + END_OF_LINE + "Content-Length: "),
        size.cast("string"), F.lit(END_OF_LINE + END_OF_LINE),
    )
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(size)
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(VERSION + END_OF_LINE),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.coalesce(page_id.cast("string"), F.lit("")))),
        line("WARC-Date", F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Refers-To", urn(refers_to.cast("string"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(END_OF_LINE), http, F.when(revisit, F.lit("")).otherwise(payload),
    )


def capture_time(page_id: Column) -> Column:
    """The time of a page without one: seconds by its id."""
    return F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce(F.pmod(page_id, F.lit(ID_SECONDS)), F.lit(0)))


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", text: str = "html", captured: Column | None = None,
    least_bytes: int = LEAST_BYTES,
) -> None:
    """Writes a record per row below ``path``. ``captured`` is a UTC timestamp column, by default ``capture_time`` of the id."""
    number = pages[key].cast("long")
    work = pages.select(
        number.alias("page_id"), pages[url].alias("url"),
        (capture_time(number) if captured is None else captured).alias("captured"),
        F.coalesce(pages[text], F.lit("")).alias("payload"),
    )
    rows, per_file = decided(work, least_bytes)
    one = record(*[F.col(c) for c in ("page_id", "url", "captured", "payload", "bytes", "digest", "refers_to")])
    rows.select(one.alias("value")).write.option("lineSep", END_OF_RECORD).option("maxRecordsPerFile", per_file).text(path)


# ----------------------------------------------------------------- reading

def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, all in lower case; a text without ``://`` as it is."""
    found = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", url)
    if not found:
        return url.lower()
    host = re.sub(r":\d*$", "", found[1].rpartition("@")[2].lower())
    return ",".join(reversed(host.split("."))) + ")" + (found[2].lower() or "/")


def records_of(content: memoryview) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], memoryview]]:
    """(offset, length, headers, HTTP headers, payload) of every record of an archive."""
    data, at = bytes(content), 0

    def headers(start: int) -> tuple[dict[str, str], int]:
        stop = data.index(b"\r\n\r\n", start)
        lines = data[start:stop].decode("utf-8").split(END_OF_LINE)
        return {"": lines[0], **dict(line.split(": ", 1) for line in lines[1:])}, stop + 4

    whole = memoryview(data)
    while at < len(data):
        own, block = headers(at)
        if own[""] != VERSION:
            raise ValueError(f"no WARC record at {at}")
        stop = block + int(own["Content-Length"])
        http, body = headers(block)
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end at {stop}")
        yield at, stop + 4 - at, own, http, whole[body:stop]
        at = stop + 4


def page_number(urn: str | None) -> int | None:
    number = (urn or "")[len(RECORD_ID) + 1 : -1]
    return int(number) if number else None


def capture(own: dict[str, str], http: dict[str, str], payload: memoryview) -> tuple:
    """The first eight columns of RECORDS; a payload must fit its digest."""
    digest = own["WARC-Payload-Digest"].removeprefix("sha256:")
    if own["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {own['WARC-Record-ID']} differs from its digest")
    size = int(http["Content-Length"]) if own["WARC-Type"] == "revisit" else len(payload)
    url = own.get("WARC-Target-URI")
    return (
        page_number(own["WARC-Record-ID"]), url, url_key(url or ""), re.sub(r"\D", "", own["WARC-Date"]), own["WARC-Type"],
        page_number(own.get("WARC-Refers-To")), size, digest,
    )


def order_of(row: Sequence) -> tuple:
    """Rows of RECORDS by address, time, id (null last), archive and offset."""
    return row[2], row[3], row[0] is None, row[0] or 0, row[8], row[9]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of all archives below ``path``: a run per archive, ``place`` counting in the order of the index."""
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("archive"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [
                    (*capture(own, http, payload), name, at, size)
                    for at, size, own, http, payload in records_of(memoryview(content.as_buffer()))
                ]
                rows.sort(key=order_of)
                yield record_batch([(*row, k) for k, row in enumerate(rows)])

    return files.mapInArrow(run, RECORDS)


def record_batch(rows: list[tuple], more: Sequence[str] = ()) -> pa.RecordBatch:
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in RECORDS.split(", ")] + [pa.int64()] * len(more)
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=[*COLUMNS, *more])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload) of the response records."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for _, _, own, _, payload in records_of(memoryview(content.as_buffer())):
                    if own["WARC-Type"] == "response":
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([page_number(own["WARC-Record-ID"])], type=pa.int64()), pa.array([bytes(payload)], type=pa.binary())],
                            names=["page_id", "payload"],
                        )

    return files.mapInArrow(run, "page_id long, payload binary")


# ------------------------------------------------------------------- index

class LoserTree:
    """Tournament over the heads of sorted runs: every inner node keeps the loser of its match, the winner stands on top.

    After a step only the matches on the winner's path are played again, one comparison per level.
    """

    END = (1,)

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.heads = [self._head(k) for k in range(len(runs))]
        size = len(runs)
        winners = [0] * size + list(range(size))
        self.losers = [0] * size
        for node in range(size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (b, a) if self.heads[b] < self.heads[a] else (a, b)
        self.winner = winners[1] if size > 1 else 0

    def _head(self, run: int) -> tuple:
        at = self.at[run]
        return (0, self.runs[run][at]) if at < len(self.runs[run]) else self.END

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) of all members in order."""
        if not self.runs:
            return
        heads, losers, size = self.heads, self.losers, len(self.runs)
        while heads[self.winner] is not self.END:
            best = self.winner
            yield best, self.at[best]
            self.at[best] += 1
            heads[best] = self._head(best)
            node = (best + size) // 2
            while node:
                if heads[losers[node]] < heads[best]:
                    losers[node], best = best, losers[node]
                node //= 2
            self.winner = best


def merged_index(records: DataFrame) -> DataFrame:
    """RECORDS in the order of the whole index: ``part`` and ``number`` give it, ``capture_rank`` counts within an address."""
    size = records.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("urlkey")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // RANGE_ROWS), -(-(size["bytes"] or 0) // RANGE_BYTES))
    ranges = records.repartitionByRange(
        parts, "urlkey", "captured", F.col("page_id").isNull(), "page_id", "archive", "offset"
    ).sortWithinPartitions("archive", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs, name = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[8] != name:
                    name = row[8]
                    runs.append([])
                runs[-1].append(row)
        order = LoserTree([[order_of(row) for row in rows] for rows in runs])
        out, number, rank, key = [], 0, 0, None
        for r, k in order:
            row = runs[r][k]
            rank = rank + 1 if row[2] == key else 1
            key = row[2]
            out.append((*row, part, number, rank))
            number += 1
            if len(out) == 10_000:
                yield record_batch(out, ["part", "number", "own_rank"])
                out = []
        yield record_batch(out, ["part", "number", "own_rank"])

    merged = stored(ranges.mapInArrow(run, f"{RECORDS}, part long, number long, own_rank long"), "index")
    # addresses in several ranges: at most two per range
    counts = merged.groupBy("urlkey", "part").agg(F.max("own_rank").alias("n"))
    crossing = counts.groupBy("urlkey").agg(F.count(F.lit(1)).alias("ranges")).filter("ranges > 1").select("urlkey")
    earlier = Window.partitionBy("urlkey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.join(crossing, "urlkey").withColumn("earlier", F.sum("n").over(earlier)).select("urlkey", "part", "earlier")
    found = merged.join(broadcast_within(stored(before, "crossing"), 20_000) if parts > 1 else F.broadcast(before), ["urlkey", "part"], "left")
    return found.withColumn("capture_rank", F.col("own_rank") + F.coalesce("earlier", F.lit(0))).drop("own_rank", "earlier")


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", captured: Column | None = None) -> DataFrame:
    """``pages`` written as archives in the shared folder, read back and indexed; one row per record."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, key, url, text, captured)
    return merged_index(stored(read_archives(spark, path), "captures"))
