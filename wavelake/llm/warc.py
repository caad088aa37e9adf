"""WARC archives of pages, read back into one globally ordered capture index.

Writing is native: each page becomes a WARC/1.0 record, and Spark's text writer, with the blank line that ends a record
as its separator, commits gzipped archives. Of pages with equal payloads of at least `least_bytes`, the one with the
largest id is a response and the others revisit it; only digests of such groups are joined, an equi-join that adaptive
execution splits where one payload is hot.

Reading parses each archive alone into a run of captures sorted by URL key, time and page. Runs are stored, dealt by
ranges of that key (time and page are part of it, so a hot host is split too) and each range is merged by a loser tree
over its parts of the runs, which gives capture histories in global order. Dealing keeps a run's order, so its parts
aren't sorted again; a part that came in pieces out of order, as after a lost executor, is told by its keys and sorted.

Nulls: null html is an empty payload, a null url has an empty key, a null page_id has none in its record and is never
the one revisited. Rows repeating a page_id and its payload are all responses if that id is the largest. Empty tables
give no archives and an empty index. Long payloads are whole. Further columns are ignored.
"""

from __future__ import annotations

import gzip
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.common import new_path, small_batches, store

#: Captures in one range of the merged index, about.
RANGE_ROWS = 100_000
#: Base-32 digits as conv() writes them, and as RFC 4648 does (fixed values).
CONV_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = b"\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base-32 SHA-1: eight groups of 20 bits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), CONV_DIGITS, BASE32)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for a response."""
    clean = lambda c: F.regexp_replace(F.col(c).cast("string"), "[\\r\\n]", "%0A")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), clean("url").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    groups = p.where(F.octet_length("html") >= least_bytes).groupBy(F.col("digest").alias("key")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    joined = p.join(groups, (p["digest"] == groups["key"]) & (F.octet_length(p["html"]) >= least_bytes), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    r = records(pages, least_bytes)
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("\r\n"))
    size = F.octet_length("html").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    body = F.concat(head, F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(""))
    revisit = F.col("refers_to").isNotNull()
    date = F.expr("date_format(timestampadd(SECOND, coalesce(pmod(page_id, 1000000000), 0), TIMESTAMP_NTZ'2020-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    value = F.concat(
        line("WARC/1.0"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: ", name("page_id")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI: ", F.col("url"))).otherwise(""),
        line("WARC-Date: ", date),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        F.when(revisit, line("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")).otherwise(""),
        F.when(revisit, line("WARC-Refers-To: ", name("refers_to"))).otherwise(""),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    r.select(value.alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def parse(data: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        if len(block) < size or data[at : at + 4] != END:
            raise ValueError("a record is cut off")
        at += 4
        yield headers, block


def url_key(url: str | None) -> str:
    """Host labels from the top domain down, then the rest: captures of one site and one page stand together."""
    rest = (url or "").split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.lower().split("."))) + ")" + slash + path if rest else ""


class LoserTree:
    """k-way merging of sorted runs: each inner node keeps the loser of its match, so a pop costs one path to the root."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = self.k = len(runs)
        self.tree = [-1] * max(k, 1)
        for i in range(k):
            self._up(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _up(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:  # first to come here while the tree is built waits for its match
                self.tree[node] = winner
                return
            if self._before(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k:
            i = self.tree[0]
            head = self.heads[i]
            if head is None:
                return
            yield head
            self.heads[i] = next(self.runs[i], None)
            self._up(i)


COLUMNS = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, ordinal long"
KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Sorted captures of each archive, payload digests and lengths of responses made anew from what is read."""
    small_batches(spark)

    def page(name: str | None) -> int | None:
        own = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return None if own in ("", "none") else int(own)

    def scan(batches):
        import base64
        import hashlib

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for k, (h, block) in enumerate(parse(gzip.decompress(data.as_py()))):
                    head, _, payload = block.partition(END)
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    size = next(int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload of record {k} of {name} differs from its digest")
                    rows.append((url_key(h.get("WARC-Target-URI")), h["WARC-Date"], page(h["WARC-Record-ID"]), size, digest, kind, page(h.get("WARC-Refers-To")), name, k))
                rows.sort(key=order)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(scan, COLUMNS)


def order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def merge(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The stored runs' captures in global order: ranges in order, and each range merged from its runs."""
    n = max(1, -(-captures.count() // range_rows))

    def merged(batches):
        own: dict[str, list] = {}
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own.setdefault(row[7], []).append((order(row), row))
        for run in own.values():
            if any(b[0] < a[0] for a, b in pairwise(run)):
                run.sort()
        out = []
        for _, row in LoserTree([own[k] for k in sorted(own)]):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=NAMES)

    keys = ["url_key", "captured_at", "page_id", "archive", "ordinal"]
    return captures.repartitionByRange(n, *keys).mapInArrow(merged, COLUMNS)


def archive_and_index(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write archives, read them back; returns their folder and the merged capture index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path, least_bytes)
    return path, merge(store(runs(spark, path), "runs"))
