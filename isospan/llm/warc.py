"""WARC archives with a two-level capture index.

Archives: each task writes files of one compressed member per record to the
shared folder. A payload met before (smallest page_id of equal payloads) is not
written again; its record is a revisit. Only the rows a task commits enter the
index, so what a lost or repeated attempt has written is never read.

Index: capture keys (reversed host, path, time, page) are range-sorted and laid
in compressed blocks of lines, a run of blocks for each sorting task; a sparse
directory keeps each block's first key. A lookup of many keys is one join: keys
are dealt to runs by the runs' first keys, and a run's task binary-searches its
part of the directory, then the block. A read fetches just the record's bytes
from its archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import posixpath
import uuid
import zlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_by_key, open_store, pieces_of, shared_dir, text_bytes

DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES = 1024
FILE_BYTES = 256_000_000
DIRECTORY_BYTES = 32_000_000
INDEX_TASK_ROWS = 200_000
WRITER_BYTES = 8_000_000  # of payload for each writing task, at least
READ_SPAN = 8_000_000
_SPACE = 0x6F2D8C51A3E94B07  # high half of a record id; the low half is the page


# -- records -------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    low = int.from_bytes(hashlib.sha1(payload_digest.encode()).digest()[:8], "big") if page_id is None else page_id & (2**64 - 1)
    return f"<urn:uuid:{uuid.UUID(int=((_SPACE ^ (page_id is None)) << 64) | low)}>"


def page_of(name: str | None) -> int | None:
    """The page_id in a record id; None for a record of a page without one."""
    if not name:
        return None
    whole = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    if whole >> 64 != _SPACE:
        return None
    low = whole & (2**64 - 1)
    return low - 2**64 if low >> 63 else low


def escaped(text: str) -> str:
    """Spaces and control characters as percent codes."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id, url, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """A response record, or a revisit of page refers_to, as one gzip member."""
    name = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = escaped(url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Record-ID: {record_id(page_id, name)}",
        f"WARC-Payload-Digest: sha1:{name}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, name)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _fields(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n")[1:])}


def parse(member: bytes) -> dict:
    """Header fields, HTTP fields and payload of a record; checks its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response" and f"sha1:{digest(payload)}" != fields["warc-payload-digest"]:
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    return {"fields": fields, "http": _fields(http), "payload": payload}


def host_key(url: str | None) -> str:
    """Reversed host, then path and query: com,example)/a?b, with spaces and control characters escaped."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower().removeprefix("www.")
    except ValueError:
        parts, host = None, ""
    if not parts or not host:
        return "-)" + escaped(url or "")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return escaped(",".join(reversed(host.split("."))) + ")" + path)


def capture_key(url, page_id, date: str = DATE) -> str:
    stamp = "".join(c for c in date if c.isdigit())
    return f"{host_key(url)} {stamp} {'-' if page_id is None else page_id + 2**63:0>20}"


# -- writing -------------------------------------------------------------------


def with_targets(pages: DataFrame, least_bytes: int = 0, total: int | None = None) -> DataFrame:
    """(page_id, url, payload, refers_to): which page each record revisits.

    Equal payloads (by SHA-256 and length) of least_bytes or more refer to the
    smallest page_id among them. Digests are counted without payloads; those of
    frequent payloads, an empty one say, are broadcast to their rows, so that no
    task gets all rows of one. total is the number of rows, counted if not given.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("_sha", F.unhex(F.sha2("payload", 256)))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("_sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    joined = join_by_key(rows, cut(first), "_sha", rows.count() if total is None else total, "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to"))


_CAPTURE = "key string, file string, at long, size long, page_id long"


def _written(root: str, date: str):
    def written(batches):
        import pyarrow as pa

        store, folder = open_store(root)
        out = name = None
        at = 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(posixpath.join(folder, name), compression=None)
                    member = record(page_id, url, payload, refers_to, date)
                    out.write(member)
                    rows.append((capture_key(url, page_id, date), name, at, len(member), page_id))
                    at += len(member)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "file", "at", "size", "page_id"])
        finally:
            if out is not None:
                out.close()

    return written


def _blocks(rows_a_block: int):
    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held: list[tuple] = []

        run = TaskContext.get().partitionId()

        def block(lines):
            text = "\n".join(" ".join(map(str, x)) for x in lines).encode()
            return run, lines[0][0], lines[-1][0], zlib.compress(text, 6), len(lines)

        def frame(got):
            cols = list(zip(*got)) if got else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.binary(), pa.int32()))], names=["run", "first_key", "last_key", "data", "n"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            got = []
            while len(held) >= rows_a_block:
                got.append(block(held[:rows_a_block]))
                held = held[rows_a_block:]
            yield frame(got)
        if held:
            yield frame([block(held)])

    return blocks


class Archive:
    """WARC files, index blocks and directory under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def write(cls, pages: DataFrame, root: str | None = None, least_bytes: int = 0, date: str = DATE, block_lines: int = BLOCK_LINES) -> Archive:
        """Writes a record per row of pages and indexes what was committed."""
        spark = pages.sparkSession
        root = root or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        total, size = text_bytes(pages, "html")
        writers = pieces_of(size, WRITER_BYTES)
        captures = cut(with_targets(pages, least_bytes, total).coalesce(writers).mapInArrow(_written(root, date), _CAPTURE))
        tasks = pieces_of(captures.count(), INDEX_TASK_ROWS)
        ordered = captures.select("key", "file", "at", "size").repartitionByRange(tasks, "key", "file", "at").sortWithinPartitions("key", "file", "at")
        ordered.coalesce(tasks).mapInArrow(_blocks(block_lines), "run int, first_key string, last_key string, data binary, n int").write.parquet(f"{root}/index")
        archive = cls(spark, root)
        archive.captures = captures
        return archive

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/index")

    def lookup(self, keys: DataFrame, directory_bytes: int = DIRECTORY_BYTES) -> DataFrame:
        """(key, file, at, size) of every capture whose key is in keys (column key).

        Each key is sent to the runs whose range it is in: all of them where a
        key is so frequent that it fills several. The runs' first keys are
        broadcast; neighbouring runs count as one where their keys together are
        longer than directory_bytes.
        """
        wanted = keys.select("key").where("key is not null").distinct()
        blocks = self.blocks()
        runs = cut(blocks.groupBy("run").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")))
        width = runs.agg(F.coalesce(F.sum(F.octet_length("first_key") + 64), F.lit(0))).first()[0]
        step = max(1, -(-int(width) // directory_bytes))
        # in one task, as there is but a row for each INDEX_TASK_ROWS captures
        runs = runs.withColumn("part", F.expr(f"(row_number() over (order by first_key, last_key, run) - 1) div {step}").cast("int"))
        firsts = runs.groupBy("part").agg(F.min("first_key").alias("first_key")).orderBy("part").collect()
        firsts = [(r["first_key"], r["part"]) for r in firsts]
        held = self.spark.sparkContext.broadcast(([k for k, _ in firsts], [r for _, r in firsts]))

        def dealt(batches):
            import pyarrow as pa

            names, numbers = held.value
            for batch in batches:
                out = [[], []]
                for key in batch.column(0).to_pylist():
                    low, high = max(bisect.bisect_left(names, key) - 1, 0), bisect.bisect_right(names, key)
                    for number in numbers[low:high]:
                        out[0].append(key)
                        out[1].append(number)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], names=["key", "part"])

        def matched(asked, own):
            import pandas as pd

            own = own.sort_values(["first_key", "last_key"], kind="stable")
            directory, data, rows = own["first_key"].tolist(), own["data"].tolist(), []
            last, lines, names = None, [], []
            for key in sorted(asked["key"]):
                at = max(bisect.bisect_left(directory, key) - 1, 0)  # the block before may end in the key
                while at < len(directory) and directory[at] <= key:
                    if at != last:
                        last, lines = at, zlib.decompress(data[at]).decode().split("\n")
                        names = [line.rsplit(" ", 3)[0] for line in lines]
                    for line in lines[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]:
                        _, file, start, size = line.rsplit(" ", 3)
                        rows.append((key, file, int(start), int(size)))
                    at += 1
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            return pd.DataFrame({"key": pd.Series(cols[0], dtype=object), "file": pd.Series(cols[1], dtype=object), "at": pd.array(cols[2], "int64"), "size": pd.array(cols[3], "int64")})

        spread = wanted.mapInArrow(dealt, "key string, part int")
        parts = blocks.join(runs.select("run", "part"), "run").select("part", "first_key", "last_key", "data")
        return spread.groupBy("part").cogroup(parts.groupBy("part")).applyInPandas(matched, "key string, file string, at long, size long")

    def read(self, places: DataFrame, tasks: int | None = None) -> DataFrame:
        """Records at (file, at, size): page_id, url, payload_bytes, payload_digest,
        record_type, refers_to and payload (null in a revisit).

        tasks, by default from the bytes to read, is set by hand because the
        rows are far smaller than the records that they point at.
        """
        root = self.root
        if tasks is None:
            tasks = reading_tasks(places)

        def read(batches):
            import pyarrow as pa

            store, folder = open_store(root)
            name = source = None
            for batch in batches:
                out = [[] for _ in range(7)]
                for file, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, store.open_input_file(posixpath.join(folder, file))
                    got = parse(source.read_at(size, at))
                    fields, kind = got["fields"], got["fields"]["warc-type"]
                    for col, v in zip(out, (page_of(fields["warc-record-id"]), fields["warc-target-uri"], int(got["http"]["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), kind, page_of(fields.get("warc-refers-to")), got["payload"] if kind == "response" else None)):
                        col.append(v)
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
            if source is not None:
                source.close()

        span = F.expr(f"at div {READ_SPAN}")
        dealt = places.select("file", "at", "size").repartition(tasks, "file", span).sortWithinPartitions("file", "at")
        return dealt.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def reading_tasks(places: DataFrame) -> int:
    return pieces_of(places.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], READ_SPAN)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives every page, then finds and reads each record through the index.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Null html is an empty payload; a null or odd url has a key of
    its own. A page without an id ranks after all others; its record revisits
    an equal payload that has one, else it is a response. Rows repeating the
    smallest page_id of a payload are responses too. An empty table gives no
    rows; other columns are ignored.
    """
    archive = Archive.write(pages, least_bytes=least_bytes)
    places = cut(archive.lookup(archive.captures))
    found, written = places.count(), archive.captures.count()
    if found != written:
        raise RuntimeError(f"{found} of {written} records found through the index")
    return archive.read(places).drop("payload", "url")
