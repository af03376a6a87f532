"""WARC archives of web pages, and their capture index by external merging.

Writing is plain DataFrame work: records are text, so Spark's text writer with the
record separator of the format makes real gzip WARC files in any store that Spark
can write to.  Of equal payloads one record keeps the bytes; the others are revisits.

Reading streams each archive, cut at the same separator, and puts records together by
their Content-Length fields, so that a task holds one record at a time however large
the archive.  Captures leave in locally sorted runs of bounded length.  Ranges of keys
then meet in their own partitions, where a loser tree merges the runs; partitions
follow each other, so the whole is ordered.  Ranges are cut on (key, time, page), so
that one URL with very many captures spreads over several of them, and their number
comes from the number of captures, so that none outgrows a task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import shared_dir, stored, text_bytes, tune

#: Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 1000
#: Ends a record, and stands between its header and its block.
_SEPARATOR = b"\r\n\r\n"
#: Captures of one sorted run, of one key range, and of one piece of a run that is unpacked for merging.
RUN_ROWS, RANGE_ROWS, PIECE_ROWS = 20_000, 50_000, 512
#: Captures without a time of their own get this epoch plus their page id in seconds.
EPOCH = 1_700_000_000

_CAPTURE = [
    ("url_key", "string", pa.string()),
    ("captured", "string", pa.string()),
    ("page_id", "long", pa.int64()),
    ("url", "string", pa.string()),
    ("record_type", "string", pa.string()),
    ("payload_digest", "string", pa.string()),
    ("payload_bytes", "long", pa.int64()),
    ("refers_to", "long", pa.int64()),
    ("intact", "boolean", pa.bool_()),
]
_DDL = ", ".join(f"{n} {k}" for n, k, _ in _CAPTURE)
_SCHEMA = pa.schema([(n, t) for n, _, t in _CAPTURE])


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another record keeps.

    ``pages``: page_id, payload.  Equal payloads are found by SHA-256; the largest
    page id keeps the bytes.  A hot payload is pre-aggregated per task.
    """
    facts = pages.where(F.col("page_id").isNotNull() & (F.length("payload") >= MIN_REVISIT_BYTES)).select(
        "page_id", F.sha2("payload", 256).alias("same")
    )
    keepers = facts.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return facts.join(keepers, "same").where("page_id < refers_to").select("page_id", "same", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> None:
    """Write one WARC record per row into gzip archives below ``path``.

    A null payload is empty, a null URL gives no target field, a null id no page
    field (such a record is always a response); repeated rows give repeated records.
    """
    when = F.col(time_col) if time_col else F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    clean = F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]+", "%20")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        clean.alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
        text_bytes(html_col).alias("payload"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    )
    shared = stored(revisits(rows.select("page_id", "payload")), "revisits")
    joined = rows.withColumn("same", F.sha2("payload", 256)).join(shared, ["page_id", "same"], "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.octet_length("html"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value)  # noqa: E731  null where the value is
    identity = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(identity(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        line("WARC-Refers-To", identity(F.col("refers_to"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", size.cast("string")),
    )
    record = F.concat(head, F.lit("\r\n\r\n"), http, F.when(again, F.lit("")).otherwise(F.col("html")))
    joined.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, scheme, ``www.``, fragment and port 80/443 dropped, lower case."""
    if not url:
        return ""
    rest = url.split("#", 1)[0].split("://", 1)[-1].lower()
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1], rest[cut:]
    name, _, port = host.partition(":")
    name = name[4:] if name.startswith("www.") else name
    return ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (path or "/")


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of archives read piece by piece."""
    data, at = b"", 0
    for piece in pieces:
        data, at = data[at:] + piece, 0
        while True:
            while data.startswith(b"\r\n", at):  # left where a block ended in a line break
                at += 2
            stop = data.find(_SEPARATOR, at)
            if stop < 0:
                break
            first, *lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record: {first[:40]!r}")
            fields = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}
            start = stop + len(_SEPARATOR)
            end = start + int(fields["content-length"])
            if end + len(_SEPARATOR) > len(data):
                break  # the rest comes with the next piece
            yield fields, data[start:end]
            at = end + len(_SEPARATOR)
    if data[at:].strip():
        raise ValueError("an archive ends within a record")


def _page(identity: str | None) -> int | None:
    return int(identity[10:-1]) if identity and identity.startswith("<urn:page:") else None


def _capture(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    full = fields["warc-type"] == "response"
    intact = not full or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
    url = fields.get("warc-target-uri")
    return (url_key(url), fields["warc-date"], _page(fields["warc-record-id"]), url, fields["warc-type"], digest, size, _page(fields.get("warc-refers-to")), intact)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, (_, _, t) in enumerate(_CAPTURE)], schema=_SCHEMA)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """What the separator was cut from, whole again, batch by batch."""
    for batch in batches:
        if batch.num_rows:
            yield _SEPARATOR.join([*batch.column(0).to_pylist(), b""])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run: list[tuple] = []
    for fields, block in records(_lines(batches)):
        run.append(_capture(fields, block))
        if len(run) == RUN_ROWS:
            yield _batch(sorted(run, key=_order))
            run = []
    if run:
        yield _batch(sorted(run, key=_order))


class LoserTree:
    """Merges k sorted runs; each step replays one path of about log2(k) matches."""

    def __init__(self, runs: list[Iterable[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.rows = [next(r, None) for r in self.runs] or [None]
        self.keys = [r and _order(r) for r in self.rows]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to arrive waits for its opponent
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.keys[self.winner] is not None:
            i = self.winner
            yield self.rows[i]
            self.rows[i] = next(self.runs[i], None)
            self.keys[i] = self.rows[i] and _order(self.rows[i])
            self._replay(i)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch, a piece of it unpacked at a time."""
    for a in range(0, batch.num_rows, PIECE_ROWS):
        yield from zip(*(c.to_pylist() for c in batch.slice(a, PIECE_ROWS).columns), strict=True)


def _sorted_stretches(batches: Iterator[pa.RecordBatch]) -> list[list[pa.RecordBatch]]:
    """The runs of a partition, wherever the shuffle cut them; rows stay packed."""
    runs: list[list[pa.RecordBatch]] = []
    last = None
    for batch in batches:
        start = 0
        for k, row in enumerate(_rows(batch.select(["url_key", "captured", "page_id"]))):
            key = _order(row)
            if last is None or key < last:
                if k > start:
                    runs[-1].append(batch.slice(start, k - start))
                runs.append([])
                start = k
            last = key
        if batch.num_rows > start:
            runs[-1].append(batch.slice(start))
    return runs


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in LoserTree([(row for part in run for row in _rows(part)) for run in _sorted_stretches(batches)]):
        out.append(row)
        if len(out) == 4096:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, in order of (url_key, captured, page_id).

    Columns: url_key, captured, page_id, url, record_type, payload_digest (bare hex),
    payload_bytes, refers_to, intact (the payload has the digest that its header names).
    A record without a target has the empty key; one whose id is not a page's has a null
    page_id; repeated records stay; empty archives give no rows; a cut one is an error.
    Memory is one record and one batch, however long the payloads.
    """
    tune(spark)
    lines = spark.read.option("lineSep", "\r\n\r\n").text(path).select(F.col("value").cast("binary"))
    runs = stored(lines.mapInArrow(_parse, _DDL), "captures")
    n_ranges = max(8, -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(n_ranges, "url_key", "captured", "page_id").mapInArrow(_merge, _DDL)


def capture_histories(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read the merged capture index back.

    An empty table writes one empty archive and gives no captures.
    """
    spark = pages.sparkSession
    tune(spark)
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, **columns)
    return read_captures(spark, path)
