"""WARC archives: writing, reading, revisits, and an index merged from sorted runs."""

from __future__ import annotations

import gzip
import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queryproof.llm.common import scalar, ship, written

ship(__name__)

LEAST_REVISIT = 100
CAPTURE = (
    "page_id long, url string, capture_date string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, intact boolean, file string, offset long, length long"
)
FIELDS = [part.split()[0] for part in CAPTURE.split(", ")]


def known_payloads(pages: DataFrame, least: int) -> DataFrame:
    """``(digest, first)``: payloads of at least ``least`` bytes that several pages have."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    large = pages.filter(F.octet_length("html") >= least).select(F.sha2(payload, 256).alias("_digest"), "page_id")
    groups = large.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    return groups.filter("_n > 1").drop("_n")


def lines(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, records: int = 2000) -> None:
    """Write one WARC record per row of ``pages`` (page_id, url, html) below ``path``.

    Payloads are the UTF-8 bytes of ``html`` (null: empty). Among equal payloads of at least ``least``
    bytes the one with the smallest page_id is a response, the others are revisits without a body that
    refer to it; rows with that same smallest id are responses too, and so are smaller payloads. A null id
    or url is left out of the record. The date is ``capture_date`` (ISO text), if there is such a column,
    else a second per page id. Other columns are not read. Records are put together by column functions and
    written by Spark's text writer, whose line separator is what ends a WARC record, as gzipped archives of
    at most ``records`` records; so they go to any storage that Spark writes to.
    """
    known = written(known_payloads(pages, least), "warc-known")
    clean = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)) + 1_704_067_200
    date = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if "capture_date" in pages.columns:
        date = F.coalesce(F.regexp_replace("capture_date", r"[^0-9A-Za-z:.+-]", ""), date)
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", clean.alias("_url"), date.alias("_date"), body.alias("_body"))
    rows = rows.withColumn("_size", F.octet_length("_body")).withColumn("_sha", F.sha2(F.col("_body").cast("binary"), 256))
    # small payloads join with nothing, and are not to meet in one place for it
    alone = lines("-", F.coalesce(F.col("page_id").cast("string"), F.col("_url"), F.lit("")))
    rows = rows.withColumn("_digest", F.when(F.col("_size") >= least, F.col("_sha")).otherwise(alone))
    rows = rows.join(known, "_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    content = lines(
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ",
        F.col("_size").cast("string"),
        "\r\n\r\n",
        F.when(revisit, "").otherwise(F.col("_body")),
    )
    page = F.coalesce(lines("WARC-Record-ID: <urn:page:", F.col("page_id").cast("string"), ">\r\n"), F.lit("WARC-Record-ID: <urn:page:none>\r\n"))
    record = lines(
        "WARC/1.1\r\nWARC-Type: ",
        F.when(revisit, "revisit").otherwise("response"),
        "\r\n",
        page,
        F.coalesce(lines("WARC-Target-URI: ", F.col("_url"), "\r\n"), F.lit("")),
        "WARC-Date: ",
        F.col("_date"),
        "\r\nWARC-Payload-Digest: sha256:",
        F.col("_sha"),
        "\r\n",
        F.when(
            revisit,
            lines(
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:",
                F.col("_first").cast("string"),
                ">\r\n",
            ),
        ).otherwise(""),
        "Content-Type: application/http; msgtype=response\r\nContent-Length: ",
        F.octet_length("_content").cast("string"),
        "\r\n\r\n",
        F.col("_content"),
    )
    out = rows.withColumn("_content", content).select(record.alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def headers_of(block: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def page_of(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive, in order: the capture fields without the file."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at) + 4
        fields = headers_of(data[at:head])
        end = head + int(fields["content-length"])
        body = data.index(b"\r\n\r\n", head, end) + 4
        http = headers_of(data[head:body])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        revisit = fields["warc-type"] == "revisit"
        size, intact = int(http["content-length"]), None
        if not revisit:  # what was stored decides, not what the header says
            found = hashlib.sha256(data[body:end]).hexdigest()
            size, digest, intact = end - body, found, found == digest and size == end - body
        yield (
            page_of(fields.get("warc-record-id")),
            fields.get("warc-target-uri"),
            fields["warc-date"],
            fields["warc-type"],
            size,
            digest,
            page_of(fields.get("warc-refers-to")) if revisit else None,
            intact,
            at,
            end + 4 - at,
        )
        at = end + 4


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then path and query: com,example)/a?b."""
    try:
        parts = urlsplit((url or "").lower())
        host = ",".join(reversed((parts.hostname or "").split(".")))
        return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"
    except ValueError:  # brackets that hold no address
        return f"){(url or '').lower()}"


def order_of(capture: tuple) -> tuple:
    """URL key, time, page id, then the place: no two captures are equal."""
    return (url_key(capture[1]), capture[2], capture[0] is None, capture[0] or 0, capture[8], capture[9])


class LoserTree:
    """Merges sorted runs: each inner node keeps the run that lost there, so that the next smallest element
    is found by one comparison a level on the winner's way up."""

    def __init__(self, runs: Iterable[list]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        size = max(1, len(self.runs))
        self.losers = [-1] * size
        for run in range(len(self.runs)):
            self.replay(run)

    def less(self, a: int, b: int) -> bool:
        if self.heads[b] is None:
            return True
        return self.heads[a] is not None and (self.heads[a][0], a) < (self.heads[b][0], b)

    def replay(self, run: int) -> None:
        node = (run + len(self.losers)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while the tree is built: wait here for the other side
                self.losers[node] = run
                return
            if self.less(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[self.losers[0]] is not None:
            run = self.losers[0]
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self.replay(run)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below ``path``: one row per record, with the place of the record in the
    unpacked archive. Digest and size of a response are those of the bytes read back; ``intact`` says
    whether the headers agree (null for revisits, which hold no payload)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("path")[i].as_py()
                rows = [(*r[:8], name, *r[8:]) for r in parse(gzip.decompress(batch.column("content")[i].as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(ARROW)], FIELDS)

    return files.mapInArrow(run, CAPTURE)


ARROW = [
    pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()
]


def merged_index(captures: DataFrame, range_rows: int = 5000, sample: int = 20_000) -> DataFrame:
    """All captures in one order by URL key and time: the fields, ``url_key``, ``range`` and ``position``.

    Each batch of captures is sorted where it lies: a run. Runs are cut at common bounds into pieces, a
    piece is one packed row, and the pieces of a range are merged by a loser tree. ``range, position`` is
    the global order. Bounds come from about ``sample`` keys, picked by hash, or all if there are fewer; they include time and page, so the captures
    of one frequent URL are spread over ranges, and they steer only how even the ranges are. Ranges hold
    about ``range_rows`` captures each.
    """
    count = captures.count()
    ranges = max(1, -(-count // range_rows))
    some = captures.select("url", "capture_date", "page_id", "file", "offset")
    if count > sample:  # by hash, so that no task sends more than its share
        some = some.filter(F.pmod(F.xxhash64("file", "offset"), F.lit(1 << 30)) < (sample << 30) // count)
    keys = sorted(order_of((r[2], r[0], r[1], *[None] * 5, r[3], r[4])) for r in some.collect())
    bounds = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            run = sorted((order_of(r), r) for r in rows)
            pieces: dict[int, list] = {}
            for one in run:
                pieces.setdefault(bisect_right(bounds, one[0]), []).append(one)
            yield pa.RecordBatch.from_pydict(
                {"range": pa.array(list(pieces), pa.int32()), "piece": [pickle.dumps(p) for p in pieces.values()]}
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [pickle.loads(p) for p in pdf["piece"]]
        rows = [(*row, key[0], pdf["range"].iloc[0], i) for i, (key, row) in enumerate(LoserTree(runs))]
        out = pd.DataFrame(rows, columns=[*FIELDS, "url_key", "range", "position"], dtype=object)
        return out

    pieces = captures.select(*FIELDS).mapInArrow(cut, "range int, piece binary")
    return pieces.groupBy("range").applyInPandas(merge, CAPTURE + ", url_key string, range int, position long")


def archived(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write ``pages`` as archives below ``path``, read them back, and return the merged index."""
    write_archives(pages, path, **options)
    captures = written(read_archives(pages.sparkSession, path), "warc-captures")
    damaged = scalar(captures.agg(F.count_if(~F.col("intact"))))
    if damaged:
        raise ValueError(f"{damaged} records were not read back as written")
    return merged_index(captures)
