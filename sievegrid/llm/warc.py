"""WARC archives: written, read back, and their index merged into ordered capture histories.

Writing: a record is the text of its headers and payload, and records end in two line breaks, so Spark's text
writer with that separator writes valid WARC/1.1 files, gzipped as a whole and cut near ``FILE_MB``. Of records with equal
payloads of at least ``MIN_BYTES`` bytes, that of the smallest id is a response and the others are revisits; the
smallest id of a digest is a pre-aggregated minimum, joined back by digest.

Reading: each file is parsed record by record, by the lengths in the headers, and becomes one locally sorted run
of index entries. Entries are range-partitioned by (URL key, timestamp, id), which splits the history of a hot URL
too; in each range the slices of all runs meet and a loser tree merges them, so the index is globally ordered.

Defined results: a null html is an empty payload; payloads under ``MIN_BYTES`` are all responses; rows that share both
the smallest id and the payload are all responses; rows with a null id revisit a row that has one, and are responses
where no row of the payload has; a null url is an empty target, and control characters and spaces in it are
percent-encoded in the headers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.shared import Table, new_path, read_table

MIN_BYTES = 100
#: Size of an archive, about; a reading task holds one archive at a time.
FILE_MB = 8
RANGE_FILES = 16
#: Pages bring no capture time: records are stamped from here on, a second apart by id, within thirty years.
FIRST_CAPTURE = 1704067200
SPAN = 30 * 365 * 86400
CRLF = "\r\n"
END = CRLF + CRLF
_HEADER_END = END.encode()
_UNSAFE = "[\\x00-\\x20\\x7F]"


def _lines(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def with_origin(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds payload, bytes, digest and the id that each row revisits (null: none) to (id, url)."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(html_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    first = rows.where(F.col("bytes") >= min_bytes).groupBy(F.col("digest").alias("same")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    first = Table(first.select("same", "first_id"), "repeated-payloads").df  # its size decides the join: payloads move only beyond the broadcast threshold
    both = rows.join(first, (F.col("digest") == F.col("same")) & (F.col("bytes") >= min_bytes), "left")
    origin = F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return both.select("id", "url", "payload", "bytes", "digest", origin.alias("origin"))


def record(first_capture: int = FIRST_CAPTURE) -> Column:
    """The text of a row's WARC record, without the two line breaks that end it."""
    number = F.coalesce(F.col("id").cast("string"), F.lit(""))
    when = F.date_format(F.timestamp_seconds(F.lit(first_capture) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    coded = reduce(lambda x, c: F.replace(x, F.lit(chr(c)), F.lit(f"%{c:02X}")), [*range(33), 127], F.col("url"))
    target = F.when(F.col("url").rlike(_UNSAFE), coded).otherwise(F.col("url"))
    revisit = F.col("origin").isNotNull()
    block = _lines("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: ", F.col("bytes").cast("string"), END, F.when(revisit, "").otherwise(F.col("payload")))
    refers = F.when(revisit, _lines("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: <urn:page:", F.col("origin").cast("string"), ">" + CRLF)).otherwise("")
    return _lines(
        "WARC/1.1" + CRLF + "WARC-Type: ", F.when(revisit, "revisit").otherwise("response"), CRLF + "WARC-Record-ID: <urn:page:", number, ">" + CRLF + "WARC-Date: ", when, CRLF + "WARC-Target-URI: ", target, CRLF + "WARC-Payload-Digest: sha256:", F.col("digest"), CRLF, refers,
        "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: ", F.octet_length(block).cast("string"), END, block,
    )


def write_archives(rows: DataFrame, path: str, file_mb: int = FILE_MB) -> int:
    """Writes a row of ``with_origin`` as one record each, in gzipped files of about ``file_mb`` before compression.

    Files are cut by their number of records, so payloads aren't shuffled; returns about how many there are.
    """
    size = rows.agg(F.sum(F.col("bytes") + 700).alias("bytes"), F.count("*").alias("n")).first()
    files = max(1, -(-(size.bytes or 0) // (file_mb << 20)))
    rows.select(record().alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, size.n // files)).text(path)
    return int(files)


def parse(archive: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, headers, block) of each record, by the lengths that the headers give."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        body = archive.index(_HEADER_END, at) + len(_HEADER_END)
        version, *lines = archive[at : body - len(_HEADER_END)].decode().split(CRLF)
        if version != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        if archive[body + size : body + size + len(_HEADER_END)] != _HEADER_END:
            raise ValueError(f"the record at {at} doesn't end where it should")
        yield at, headers, view[body : body + size]
        at = body + size + len(_HEADER_END)


def url_key(url: str) -> str:
    """Sort key: host labels from the last to the first, then the path."""
    rest = url.partition("://")[2] or url
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, _, port = rest[:end].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest[end:]


ENTRY = "run string, seq int, url_key string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long"
_NAMES = [x.split()[0] for x in ENTRY.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in ENTRY.split(", "))])


def _number(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def _key(entry: tuple) -> tuple:
    return entry[2], entry[3], entry[4] is not None, entry[4] or 0


def read_run(path: str, archive: bytes) -> list[tuple]:
    """The sorted index entries of one gzipped archive; payloads are measured and digested anew."""
    run = path.rpartition("/")[2]
    entries = []
    for offset, headers, block in parse(gzip.decompress(archive)):
        cut = bytes(block[:4096]).index(_HEADER_END) + len(_HEADER_END)
        inner = dict(x.split(": ", 1) for x in bytes(block[: cut - len(_HEADER_END)]).decode().split(CRLF)[1:])
        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(inner["Content-Length"])
        revisit = headers["WARC-Type"] == "revisit"
        if not revisit and (len(block) - cut != size or hashlib.sha256(block[cut:]).hexdigest() != digest):
            raise ValueError(f"{path}: the payload at {offset} isn't what its headers say")
        url = headers["WARC-Target-URI"]
        refers = _number(headers["WARC-Refers-To"]) if revisit else None
        entries.append((run, 0, url_key(url), headers["WARC-Date"], _number(headers["WARC-Record-ID"]), url, headers["WARC-Type"], refers, size, digest, offset))
    entries.sort(key=_key)
    return [(run, i, *x[2:]) for i, x in enumerate(entries)]


class LoserTree:
    """Merges k sorted runs; each step plays one path of the tree from a leaf to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.width = 1 << max(0, len(runs) - 1).bit_length()
        self.losers = [-1] * self.width
        self.winner = self._build(1)

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if 0 <= run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x[0], a) <= (y[0], b))

    def _build(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return win

    def __iter__(self) -> Iterator[tuple]:
        while (head := self._head(self.winner)) is not None:
            yield head
            run = self.winner
            self.at[run] += 1
            node = (run + self.width) // 2
            while node:
                if self._beats(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of keys: slices of the runs in, merged entries out."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for entry in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(entry[0], []).append((_key(entry), entry))
    for slice_ in runs.values():
        slice_.sort(key=lambda x: x[1][1])  # a shuffle may deliver a run's entries in another order than it was read
    out: list[tuple] = []
    for _, entry in LoserTree([runs[x] for x in sorted(runs)]):
        out.append(entry)
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)


def capture_index(spark, path: str, archives: int) -> DataFrame:
    """Index entries of all archives under ``path``, globally ordered by (url_key, timestamp, page_id).

    Ranges grow in number with the archives, so that a merging task holds the entries of about ``RANGE_FILES``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                if entries := read_run(name.as_py(), data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries), _SCHEMA)], schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = Table(files.mapInArrow(read, ENTRY), "warc-runs").df  # archives are parsed once; finding the ranges reads the runs
    order = ["url_key", "timestamp", F.col("page_id").asc_nulls_first()]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-archives // RANGE_FILES))
    return runs.repartitionByRange(ranges, *order).mapInArrow(_merge, ENTRY)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archives = write_archives(with_origin(read_table(spark, sf_dir, "pages")), path)
    return capture_index(spark, path, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= {MIN_BYTES} GROUP BY d),
k AS (SELECT *, regexp_extract(regexp_replace(url, '^[^:]*://', ''), '^[^/?#]*') AS h, regexp_replace(url, '^[^:]*://[^/?#]*', '') AS rest FROM p)
SELECT page_id, n::bigint AS payload_bytes, d AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
       array_to_string(list_reverse(string_split(lower(h), '.')), ',') || ')' || rest AS url_key,
       strftime(to_timestamp({FIRST_CAPTURE} + page_id % {SPAN}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS timestamp
FROM k LEFT JOIN f USING (d)
"""
