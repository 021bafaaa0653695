"""WARC archives of page captures, and their index merged from locally sorted runs.

Each task writes one archive (a gzip member per record) and the captures in it. The captures of a task, sorted by URL key
and time, are a run. Runs are cut by key range, and each range is merged from its runs by a loser tree.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.llm import files
from martlet.llm.shared import new_path, table

#: Payloads under this many bytes are never revisits; captures that one merging task gets, about.
LEAST_PAYLOAD, RANGE_ROWS = 100, 100_000
CAPTURE = "url_key string, captured_at string, page_id long, url string, record_type string, path string, offset long, length long"


def url_key(url: Column) -> Column:
    """Host labels in reverse, then the rest: http://www.a.org/x becomes org,a,www)/x. Null gives an empty key."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def record_id(page_id: int | None) -> str:
    """An id that holds the page's; another without one."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.UUID(int=page_id % 2**64)}>"


def page_of(record: str | None) -> int | None:
    number = uuid.UUID(record[1:-1]).int if record else 1 << 64
    return None if number >= 1 << 64 else number - (1 << 64 if number >= 1 << 63 else 0)


def record(page_id: int | None, url: str | None, at: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {at}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Of one record: its header, the length that its HTTP head states, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    header = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[:int(header["Content-Length"])].partition(b"\r\n\r\n")
    return header, int(re.search(rb"Content-Length: (\d+)", http)[1]), payload


def write_archives(pages: DataFrame, html: str = "html", *, captured_at: Column, folder: str | None = None) -> DataFrame:
    """Write a record for each row of page_id, url and `html`, and return the captures: locally sorted runs with `run`.

    Of rows with equal payloads of at least LEAST_PAYLOAD bytes the one with the smallest page_id is a response, and the
    others are revisits of it.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    files.make_folder(folder)
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_key(F.col("url")).alias("url_key"), captured_at.cast("string").alias("captured_at"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    firsts = rows.filter(F.octet_length("payload") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = table(firsts.filter("n > 1").select(F.col("digest").alias("same"), "first"), "firsts")
    rows = rows.join(firsts, F.col("digest") == F.col("same"), "left").withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    rows = rows.select("page_id", "url", "url_key", "captured_at", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            out = out or files.open_out(path)
            found = []
            for page_id, url, key, when, text, digest, refers_to in zip(*batch.columns):
                kind = "revisit" if refers_to.is_valid else "response"
                pack = zlib.compressobj(3, wbits=31)
                data = record(page_id.as_py(), url.as_py(), when.as_py(), text.as_buffer().to_pybytes(), digest.as_py(), kind, refers_to.as_py())
                data = pack.compress(data) + pack.flush()
                out.write(data)
                found.append((key.as_py(), when.as_py(), page_id.as_py(), url.as_py(), kind, path, at, len(data)))
                at += len(data)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 8, kinds)], names=[x.split()[0] for x in CAPTURE.split(", ")])
        if out:
            out.close()

    captures = rows.mapInArrow(write, CAPTURE)
    return table(captures.withColumn("run", F.spark_partition_id()).sortWithinPartitions("url_key", "captured_at", "page_id"), "runs")


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, so the next item takes one walk to the root."""

    def __init__(self, runs: Sequence[Sequence]) -> None:
        self.runs, self.k, self.at = runs, len(runs), [0] * len(runs)
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's next item comes before run b's; a run that is used up comes last."""
        if self.at[a] == len(self.runs[a]) or self.at[b] == len(self.runs[b]):
            return self.at[b] == len(self.runs[b]) and (self.at[a] < len(self.runs[a]) or a < b)
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        return won

    def __iter__(self) -> Iterator:
        while self.k and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._less(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures in global order of (url_key, captured_at, page_id): `part` orders the ranges, `position` the rows in one.

    Ranges are cut on the whole key, so a URL with very many captures spreads over several; a task holds one range.
    """
    parts = max(1, -(-runs.count() // RANGE_ROWS))
    names = [x.split()[0] for x in CAPTURE.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        keys = list(zip(rows.column("url_key").to_pylist(), rows.column("captured_at").to_pylist(), (-(1 << 63) if x is None else x for x in rows.column("page_id").to_pylist()), range(rows.num_rows)))
        own: dict[int, list] = {}
        for run, key in zip(rows.column("run").to_pylist(), keys):
            own.setdefault(run, []).append(key)
        # A run arrives in its order; where a shuffle dealt it otherwise, it is sorted again.
        sorted_runs = [r if all(a < b for a, b in zip(r, r[1:])) else sorted(r) for r in own.values()]
        order = pa.array([key[3] for key in LoserTree(sorted_runs)], pa.int64())
        merged = rows.select(names).take(order).append_column("position", pa.array(range(len(order)), pa.int64()))
        yield from merged.combine_chunks().to_batches(max_chunksize=10_000)

    ranged = runs.repartitionByRange(parts, "url_key", "captured_at", "page_id")
    merged = ranged.mapInArrow(merge, f"{CAPTURE}, position long").withColumn("part", F.spark_partition_id())
    return table(merged, "index")


def read_archives(spark: SparkSession, index: DataFrame) -> DataFrame:
    """One row per capture of an index, read from its archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured_at.

    A response's length and digest are those of the payload that was read; a revisit states its payload's.
    """
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            found = []
            for own, at, length, key, when in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if own != path:
                    path, file = own, files.open_in(own)
                file.seek(at)
                header, size, payload = parse(zlib.decompress(file.read(length), wbits=31))
                digest = header["WARC-Payload-Digest"].removeprefix("sha256:")
                if header["WARC-Type"] == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                found.append((page_of(header["WARC-Record-ID"]), size, digest, header["WARC-Type"], page_of(header.get("WARC-Refers-To")), key, when))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 7, types)], names=[x.split()[0] for x in kinds.split(", ")])

    parts = max(1, index.select("path").distinct().count())
    rows = index.select("path", "offset", "length", "url_key", "captured_at").repartition(parts, "path").sortWithinPartitions("path", "offset")
    return rows.mapInArrow(read, kinds)


def archive(pages: DataFrame, html: str = "html", *, captured_at: Column) -> DataFrame:
    """Write archives, merge their index, and read every record back by the index; see `read_archives` for the columns.

    Defined results: a null html is an empty payload; a null URL has the empty key and no target header; rows without a
    page_id are responses unless they repeat a payload; rows that repeat the smallest page_id of a payload are responses;
    other columns are not read; an empty table gives an empty one. Archives have new names for each task attempt, and only
    captures of attempts that count are in the index.
    """
    return read_archives(pages.sparkSession, merge_runs(write_archives(pages, html, captured_at=captured_at)))
