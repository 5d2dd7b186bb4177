"""WARC archives with identical-payload revisits, and an index of their captures by external merge.

Write: each page becomes one WARC/1.1 record, in archives compressed as a whole (offsets are those of the unpacked archive). Of
pages with equal payloads of at least 100 bytes, the one with the smallest page_id is a response with its payload, the others are
revisit records that refer to it. Archives unpack to about ``ARCHIVE_BYTES`` and are written to the shared folder by Spark's own
writer, a record a row.

Read: every archive is parsed by content length; payload digests are computed again from the bytes. Each archive yields its
captures as a run sorted by URL key and timestamp; runs are written out. Merge: the key space is cut into ranges from a sample
(which decides balance only); in each range a loser tree merges the slices of all runs, a comparison path of log2(runs) a
capture. Ranges follow each other, so the index is globally ordered by URL key, timestamp and page_id.

Scale: the payload is exchanged once, by a hash of page_id and digest, into partitions of one archive each; digests and decisions
are rows of some 80 bytes. A digest or URL shared by a third of all pages is one counted row on one side of an adaptive join,
and many ranges in the merge, as ranges are cut within a URL as well.

Defined cases: null html is an empty payload; payloads under 100 bytes are never revisited; rows with the smallest page_id of
their payload are responses even if repeated; a null page_id is never referred to, and such rows are responses if their group has
no other; page_id may be any long (dates depend on it only where no timestamp column is named); a null or unparsable URL is indexed
under "-"; no pages give an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.plans.shared import materialize, scratch_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
RANGE_ROWS = 200_000
END = "\r\n\r\n"
DAY = 86_400
YEAR = 366 * DAY
EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z
YEARS = (-62_135_596_800, 253_402_300_799)  # the first second of the year 1 and the last of 9999
#: Runs that one loser tree merges; more are merged in passes.
FAN_IN = 256
INDEX = "url_key string, ts string, page_id long, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels reversed, without scheme, user, default port, www or fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip() if "//" in url else f"//{url.strip()}")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return "-"
    host = host.removeprefix("www.")
    if not host:
        return "-"
    key = ",".join(reversed(host.split(".")))
    if port not in (None, 80, 443):
        key += f":{port}"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{key}){parts.path.lower() or '/'}{query.lower()}"


def decide(pages: DataFrame) -> tuple[DataFrame, int]:
    """(page_id, digest, refers_to) of the pages that revisit another, and the bytes of all payloads."""
    small = materialize(pages.select("page_id", F.sha2(F.col("payload"), 256).alias("digest"), F.octet_length("payload").cast("long").alias("n")), "payloads")
    total = small.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    first = small.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c"))
    first = materialize(first.where("c > 1 and refers_to is not null").select("digest", "refers_to"), "first-payloads")
    later = small.join(first, "digest").where(F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to")))
    return later.select("page_id", "digest", "refers_to").distinct(), total


def capture_date(ts: str | None) -> Column:
    """The capture time in UTC, whatever the session's zone: of a timestamp column, where it is in the years 1 to 9999, else a second
    of the year 2024 by page_id, of any size and sign."""
    by_id = F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)).cast("long"), F.lit(YEAR))
    seconds = by_id if ts is None else F.coalesce(F.unix_seconds(F.to_timestamp(ts)), by_id)
    seconds = F.when(seconds.between(*YEARS), seconds).otherwise(by_id)
    day, second = F.floor(seconds / DAY), F.pmod(seconds, F.lit(DAY))
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(second / 3600), two(F.pmod(second / 60, F.lit(60))), two(F.pmod(second, F.lit(60))))
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T"), clock, F.lit("Z"))


def write_archives(pages: DataFrame, path: str, ts: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``page_id, url, html`` (and a timestamp column, if named) as WARC files under ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), capture_date(ts).alias("ts"))
    later, total = decide(rows)
    n = max(1, -(-total // archive_bytes))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    joined = keyed.repartition(n, "page_id", "digest").alias("p").join(later.repartition(n, "page_id", "digest").alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest")), "left")
    joined = joined.select("p.*", "r.refers_to")
    revisit = F.col("refers_to").isNotNull()
    bytes_ = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), bytes_.cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    clean = F.regexp_replace(F.col("url"), r"[\r\n]", " ")

    def line(name: str, value) -> list:
        return [F.lit(f"{name}: "), value, F.lit("\r\n")]

    optional = lambda name, value: F.when(value.isNotNull(), F.concat(*line(name, value))).otherwise(F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        *line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        *line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))),
        *line("WARC-Date", F.col("ts")),
        optional("WARC-Target-URI", clean),
        *line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        *line("Content-Type", F.lit("application/http;msgtype=response")),
        *line("X-Payload-Length", bytes_.cast("string")),
        optional("X-Page-ID", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(*line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), *line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        *line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    joined.select(F.concat(header, block).alias("value")).write.options(lineSep=END, compression="gzip").text(path)


def records(archive: memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, header fields, block) of each record; raises ValueError on a damaged one."""
    at = 0
    raw = archive.obj if isinstance(archive.obj, bytes) else bytes(archive)
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        if head < 0 or raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in raw[at:head].decode().split("\r\n")[1:])
        start = head + 4
        end = start + int(fields["Content-Length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield at, end + 4 - at, fields, archive[start:end]
        at = end + 4


COLUMNS = tuple(c.split()[0] for c in INDEX.split(", "))
RUN = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64()}[c.split()[1]]) for c in f"{INDEX}, place long".split(", ")])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as an Arrow batch, in which a null leaves the ids beside it as they are."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted run of captures for each archive, with each capture's place in it."""
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            rows = []
            for offset, length, f, block in records(memoryview(gzip.decompress(content.as_buffer()))):
                payload = bytes(block)[bytes(block[:512]).find(b"\r\n\r\n") + 4 :]
                kind = f["WARC-Type"]
                digest = hashlib.sha256(payload).hexdigest() if kind == "response" else f["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and f["WARC-Payload-Digest"] != f"sha256:{digest}":
                    raise ValueError(f"payload digest mismatch in {path} at byte {offset}")
                page, refers = f.get("X-Page-ID"), f.get("X-Refers-To-Page-ID")
                size = len(payload) if kind == "response" else int(f["X-Payload-Length"])
                rows.append((url_key(f.get("WARC-Target-URI")), f["WARC-Date"], None if page is None else int(page), path.rsplit("/", 1)[-1], offset, length, size, digest, kind, None if refers is None else int(refers)))
            rows.sort(key=order_key)
            yield _rows([(*row, place) for place, row in enumerate(rows)], RUN)


def order_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so the next winner needs one path of comparisons."""

    def __init__(self, runs: list[list[tuple]], key=order_key) -> None:
        self.k = max(1, len(runs))
        self.runs, self.key = [iter(r) for r in runs] or [iter(())], key
        self.heads: list[tuple | None] = [None] * self.k
        self.keys: list[tuple | None] = [None] * self.k
        for i in range(self.k):
            self._advance(i)
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        new = None if self.heads[i] is None else self.key(self.heads[i])
        if new is not None and self.keys[i] is not None and new < self.keys[i]:
            raise ValueError("a run is not sorted")
        self.keys[i] = new

    def _beats(self, a: int, b: int) -> bool:
        if b < 0 or a < 0:
            return b >= 0 and a < 0  # an empty seat wins while the tree is filled, so that losers settle
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (i := self.tree[0]) >= 0 and self.keys[i] is not None:
            yield self.heads[i]
            self._advance(i)
            self._replay(i)


def merge_runs(runs: list[list[tuple]], fan_in: int = FAN_IN) -> Iterator[tuple]:
    """All rows of sorted runs in order; more than ``fan_in`` runs are merged in passes."""
    while len(runs) > fan_in:
        runs = [list(LoserTree(runs[i : i + fan_in])) for i in range(0, len(runs), fan_in)]
    return iter(LoserTree(runs))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range, which come by archive and place, so that each archive's are a sorted run as they stand."""
    runs: list[list[tuple]] = []
    last = None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in COLUMNS)):
            if row[3] != last:
                runs.append([])
                last = row[3]
            runs[-1].append(row)
    held, schema = [], pa.schema([RUN.field(c) for c in COLUMNS])
    for row in merge_runs(runs):
        held.append(row)
        if len(held) == 10_000:
            yield _rows(held, schema)
            held = []
    if held:
        yield _rows(held, schema)


def build_index(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The merged index of the archives under ``path``, partitions in global order."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    runs = materialize(archives.mapInArrow(_parse, f"{INDEX}, place long"), "runs")
    n = max(1, -(-runs.count() // range_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64))
    ranges = runs.repartitionByRange(n, "url_key", "ts", "page_id", "archive", "offset")
    return ranges.sortWithinPartitions("archive", "place").mapInArrow(_merge, INDEX)


def archive_and_index(pages: DataFrame, path: str | None = None, ts: str | None = None) -> DataFrame:
    """Write the archives of ``pages``, read them back, and return the merged index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, f"warc-{uuid.uuid4().hex[:8]}")
    write_archives(pages, path, ts)
    return build_index(spark, path)

