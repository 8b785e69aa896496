"""WARC archives and their merged capture index.

Writing: one record per row, the payload being the row's text in UTF-8. Of rows with equal payloads of at least
``least_bytes`` bytes the one with the smallest id is a ``response`` record and the others are ``revisit`` records that
refer to it. A record ends with two line ends, so Spark's text writer (with these as its line separator) writes genuine
gzipped archives to any file system. Offsets are those of the unpacked archive.

Reading: archives come as a stream of pieces between carriage returns, by Spark's text reader, and are parsed by content
length, so that neither an archive nor its unpacked text is ever whole in memory. Each archive yields a capture run (the
records' descriptions without their blocks, ``per_archive`` rows at most) sorted by URL key and time.

Index: the runs are dealt by ranges of (URL key, time, id); a range gets of each run a sorted stretch, and a loser tree
merges the stretches. A range's rows, about ``rows_per_part``, wait in Arrow buffers, of which each stretch's cursor decodes
a few at a time. The parts in order are the globally ordered capture histories. Ranges divide one URL's captures too, so a
URL with very many captures is several tasks' work.

Defined results: a null text is an empty payload; a null URL has the empty URL key; carriage returns and line feeds are
left out of a URL, for they would end its header line; a null id compares below none and its record has no id field;
repeated rows are records of their own (of equal payload and id, each is the response); an empty table gives no archives
and an empty index; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthcal.llm.shared import fresh_path, materialize, utf8

LEAST_BYTES = 100
CRLF = "\r\n"
INDEX = "page_id long, url string, url_key string, captured string, record_type string, payload_digest string, payload_bytes long, stored_bytes long, refers_to long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort-friendly key: the host's labels reversed, without www or default port, then the path and the query's parts in order."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return url.strip().lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path.rstrip('/') or '/'}" + (f"?{query}" if query else "")


def records(pages: DataFrame, page_id: str, url: str, html: str, captured: Column | None, least_bytes: int) -> DataFrame:
    """page_id, record (without its closing line ends) and stored bytes."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\r\n]", "")
    when = captured if captured is not None else F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col(page_id).cast("long"), F.lit(0)))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), clean.alias("url"), F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"))
    # a digest that repeats, with its smallest id; written, so that Spark can split a digest's rows in the join
    first = rows.select("digest", "page_id", "bytes").where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    rows = rows.join(materialize(first, "warc-digests"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.col("captured")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return rows.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, least_bytes: int = LEAST_BYTES, per_archive: int = 5_000) -> None:
    """Gzipped archives of at most ``per_archive`` records under ``path``, written where the records are.

    The table of repeated digests is broadcast while Spark's size check allows it; beyond that the records go once through
    the shuffle of that join.
    """
    found = records(pages, page_id, url, html, captured, least_bytes)
    found.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)


NAMES = [x.split()[0] for x in INDEX.split(", ")]
SEPARATOR = b"\r\n\r\n"
_FIELD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")


class Parser:
    """Takes an archive's bytes piece by piece and gives out header fields, block, offset and length of each record; it holds
    one record at most. ValueError where the bytes aren't a record."""

    def __init__(self, name: str = ""):
        self.name, self.held, self.at, self.need, self.fields = name, bytearray(), 0, 1, None

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
        self.held += piece
        while len(self.held) >= self.need:
            if self.fields is None:
                end = self.held.find(SEPARATOR)
                if end < 0:
                    return
                if not self.held.startswith(b"WARC/1."):
                    raise ValueError(f"{self.name}: no record at byte {self.at}")
                self.fields = {k.decode(): v.decode() for k, v in _FIELD.findall(self.held, self.held.index(b"\r\n") + 2, end + 2)}
                self.start = end + 4
                self.need = self.start + int(self.fields["Content-Length"]) + 4
            else:
                if self.held[self.need - 4 : self.need] != SEPARATOR:
                    raise ValueError(f"{self.name}: record at byte {self.at} doesn't end at its length")
                yield self.fields, bytes(self.held[self.start : self.need - 4]), self.at, self.need
                del self.held[: self.need]
                self.at, self.need, self.fields = self.at + self.need, 1, None

    def close(self) -> None:
        """The text reader doesn't tell whether the last piece was followed by a carriage return, so one may be left."""
        if self.held not in (b"", b"\r"):
            raise ValueError(f"{self.name}: no record at byte {self.at}")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    parser = Parser()
    yield from parser.feed(data)
    parser.close()


def described(name: str, fields: dict[str, str], block: bytes, at: int, length: int) -> tuple:
    """A record's row of the index; ValueError if its payload doesn't match its digest."""

    def number(text: str | None) -> int | None:
        digits = (text or "").strip("<>").rpartition(":")[2]
        return int(digits) if digits else None

    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != int(fields["X-Payload-Length"])):
        raise ValueError(f"{name}: the payload at byte {at} doesn't match its digest")
    uri = fields["WARC-Target-URI"]
    return (number(fields["WARC-Record-ID"]), uri, url_key(uri), fields["WARC-Date"], fields["WARC-Type"], digest, int(fields["X-Payload-Length"]), len(block), number(fields.get("WARC-Refers-To")), name, at, length)


def index_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in TEXT else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all gzipped archives as capture runs: a run per archive, sorted by URL key, time and id, and each
    row's place in its run."""
    names = [*NAMES, "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, rows = None, []

        def ended() -> pa.RecordBatch:
            parser.close()
            rows.sort(key=capture_key)
            return index_batch([(*r, k) for k, r in enumerate(rows)], names)

        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if parser is None or parser.name != name:
                    if parser is not None:
                        yield ended()
                    parser, rows = Parser(name), []
                rows += [described(name, *record) for record in parser.feed(piece + b"\r")]
        if parser is not None:
            yield ended()

    # gzipped files aren't split, and the pieces of a file come in order; one character can't be found in part, as two line
    # ends can
    pieces = spark.read.option("lineSep", "\r").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path)
    return pieces.select("_metadata.file_path", "value").mapInArrow(run, f"{INDEX}, place long")


TEXT = {"url", "url_key", "captured", "record_type", "payload_digest", "archive"}


def capture_key(row: tuple) -> tuple:
    """URL key, time, id (null first), archive and offset, of a row of the index."""
    return (row[2].encode("utf-8", "surrogatepass"), row[3], row[0] is not None, row[0] or 0, row[9], row[10])


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, the root's winner comes out next."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.rows: list[tuple | None] = [None] * len(runs)
        self.heads: list = [None] * len(runs)
        for run in range(len(runs)):
            self.draw(run)
        self.tree = [-1] * self.k
        winners = [*[-1] * self.k, *range(len(runs))] if runs else []
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self.wins(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def draw(self, run: int) -> None:
        self.rows[run] = next(self.runs[run], None)
        self.heads[run] = None if self.rows[run] is None else self.key(self.rows[run])

    def wins(self, a: int, b: int) -> bool:
        """An exhausted run loses; of equal heads the earlier run wins."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y if x != y else a < b

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        while self.heads[self.top] is not None:
            run = self.top
            yield self.rows[run]
            self.draw(run)
            node, winner = (run + self.k) // 2, run
            while node:
                if self.wins(self.tree[node], winner):
                    winner, self.tree[node] = self.tree[node], winner
                node //= 2
            self.top = winner


def stretches(table: pa.Table) -> list[Iterator[tuple]]:
    """A cursor over the rows of each archive in the order of its run."""
    code = table.column("archive").combine_chunks().dictionary_encode()
    order = np.lexsort((table.column("place").to_numpy(), code.indices.to_numpy()))
    ends = np.cumsum(np.bincount(code.indices.to_numpy(), minlength=len(code.dictionary)))

    def cursor(first: int, last: int) -> Iterator[tuple]:
        for i in range(first, last, 500):
            part = table.take(pa.array(order[i : min(i + 500, last)]))
            yield from zip(*(part.column(n).to_pylist() for n in NAMES), strict=True)

    return [cursor(int(a), int(b)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def merged_index(runs: DataFrame, rows_per_part: int = 50_000) -> DataFrame:
    """The index in global order: its columns, the part (ascending in key) and the place within the part."""
    parts = max(1, -(-runs.count() // rows_per_part), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        part, out = TaskContext.get().partitionId(), []
        for place, row in enumerate(LoserTree(stretches(pa.Table.from_batches(held)), capture_key)):
            out.append((*row, part, place))
            if len(out) == 10_000:
                yield index_batch(out, [*NAMES, "part", "place"])
                out = []
        if out:
            yield index_batch(out, [*NAMES, "part", "place"])

    return runs.repartitionByRange(int(parts), "url_key", "captured", "page_id", "archive", "offset").mapInArrow(merge, f"{INDEX}, part long, place long")


def capture_index(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, least_bytes: int = LEAST_BYTES, per_archive: int = 5_000) -> DataFrame:
    """Write the pages as archives into the shared folder, read them back and merge their runs."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, page_id, url, html, captured, least_bytes, per_archive)
    return merged_index(materialize(read_records(spark, path), "capture-runs"))
