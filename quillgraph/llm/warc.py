"""WARC archives with an externally merged capture index.

Writing: each task sorts its captures by URL key and timestamp, writes them as gzip-member WARC records to a
file of its own, and reports a run of index entries in that order. Of records with equal payloads of at least
``REVISIT_BYTES`` bytes the one with the largest page_id is the response, the others are revisits of it;
smaller payloads are always stored. The runs are written as Parquet to the shared folder (Spark's commit
keeps one attempt of each task, and an entry names the file of its own attempt).

Merging: the runs are merged by URL key, timestamp and page id with a k-way loser tree. Key ranges are merged
by different tasks, split on the whole key, so that one busy URL can be spread; more than ``FAN_IN`` runs are
first merged in groups, each by tasks of a key range. The result is a globally ordered index, whose order across partitions is the
captures' history.

Reading: each merged stretch of the index is read back from the archives by offset, neighbours in a file
together, and every payload is checked against its digest.

Defined results: null html is an empty payload; null url has an empty URL key; a row with null page_id is
stored as a response unless its payload has a page_id to refer to; repeated rows each get a record (those with
the response's own page_id are responses too); of other columns only the one named as ``fetched`` is read; an
empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, shared_path, tidy
from quillgraph.llm.storage import NewFile, open_file, place

REVISIT_BYTES = 1000
FAN_IN = 256
#: First capture time where a table has none: a capture each second in the order of page_id.
EPOCH = 1_704_067_200
#: Payloads known from several rows that are broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000
#: Index entries whose records are read together.
READ_ROWS = 20_000
#: ``known`` is 0 where page_id is null (and stored as 0).
INDEX = "url_key string, ts string, known int, page_id long, file string, offset long, length long"
NAMES = [f.split()[0] for f in INDEX.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
KEY = NAMES[:4]


def url_key(url: F.Column) -> F.Column:
    """Sort-friendly form: host labels from the top level down, then path and query without fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@|:\d+$|^www\.", ""))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"(?s)#.*$", "")
    return F.when(url == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def repeated(rows: DataFrame) -> DataFrame:
    """(digest, payload_bytes, response_id, n) of the payloads of ``REVISIT_BYTES`` or more that several rows have; no payload is moved."""
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
    return large.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def captures(pages: DataFrame, fetched: str | None = None, broadcast_rows: int | None = None) -> DataFrame:
    """(page_id, url, url_key, ts, payload, digest, payload_bytes, refers_to) per row of ``pages``; ``fetched`` names the column of the capture time, if there is one.

    Payloads that occur more than once are found on digests alone. Up to ``broadcast_rows`` of them are broadcast, and no
    payload is shuffled. Of more, the most frequent are broadcast (there are never more than ``broadcast_rows`` with so many
    rows), and the others are joined by a shuffle, in which each has few rows; rows that can't match are spread evenly.
    """
    broadcast_rows = broadcast_rows or BROADCAST_ROWS
    at = F.col(fetched).cast("timestamp") if fetched else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 30)))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        url_key(F.col("url").cast("string")).alias("url_key"),
        F.coalesce(F.date_format(at, "yyyyMMddHHmmss"), F.lit("00000000000000")).alias("ts"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = materialize(repeated(rows))
    few, all_rows = (shared.agg(F.count(F.lit(1)), F.sum("n")).first())[:2]
    key = ["digest", "payload_bytes"]
    if few <= broadcast_rows:
        joined = rows.join(F.broadcast(shared.drop("n")), key, "left")
    else:
        often = F.col("n") > all_rows // broadcast_rows
        hot = shared.where(often).select(*key, F.col("response_id").alias("hot_id"))
        cold = shared.where(~often).select(F.col("digest").alias("_d"), F.col("payload_bytes").alias("_b"), "response_id")
        part = rows.join(F.broadcast(hot), key, "left")
        asked = F.when((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("hot_id").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
        part = part.withColumn("_k", asked)
        joined = part.join(cold, (F.col("_k") == F.col("_d")) & (F.col("payload_bytes") == F.col("_b")), "left").withColumn("response_id", F.coalesce("hot_id", "response_id"))
    refers = F.when(~F.col("response_id").eqNullSafe(F.col("page_id")), F.col("response_id"))
    return joined.select("page_id", "url", "url_key", "ts", "payload", *key, refers.alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str, ts: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    date = f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z"
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Page-ID: {'-' if page_id is None else page_id}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    head = "\r\n".join([*fields, f"Content-Length: {len(block)}"]).encode()
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(data: bytes) -> dict:
    """The fields of a record from its gzip member, payload checked against its digest."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    if version != "WARC/1.1" or rest[int(fields["Content-Length"]) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(next(line for line in http.decode().split("\r\n") if line.startswith("Content-Length: ")).split(": ")[1])
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError("a payload differs from its digest")
    refers = fields.get("Refers-To-Page-ID")
    return {"page_id": None if fields["Page-ID"] == "-" else int(fields["Page-ID"]), "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": size, "refers_to": int(refers) if refers else None}


def write_archives(pages: DataFrame, folder: str | None = None, fetched: str | None = None) -> tuple[str, list[list[str]]]:
    """Write the archives and the sorted index runs; gives the folder and the runs, each as the names of its files in order."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out = TaskContext.get(), None
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            if out is None and batch.num_rows:
                out = NewFile(folder, name, str(task.taskAttemptId()))
            columns = [batch.column(c) for c in ("page_id", "url", "ts", "payload", "digest", "refers_to")]
            at, size = [], []
            for i in range(batch.num_rows):  # payloads one at a time
                data = make_record(*(c[i].as_py() for c in columns))
                at.append(out.write(data))
                size.append(len(data))
            own = batch.column("page_id")
            yield pa.RecordBatch.from_arrays(
                [batch.column("url_key"), batch.column("ts"), pc.cast(own.is_valid(), pa.int32()), pc.fill_null(own, 0), pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], NAMES
            )
        if out is not None:
            out.close()

    runs = captures(pages, fetched).sortWithinPartitions("url_key", "ts", F.col("page_id").asc_nulls_first()).mapInArrow(tidy(write), INDEX)
    runs.write.option("parquet.block.size", 1 << 20).parquet(f"{folder}/runs")
    return folder, [[f] for f in _files(f"{folder}/runs")]


def _files(folder: str) -> list[str]:
    from pyarrow import fs

    system, root = place(folder)
    found = system.get_file_info(fs.FileSelector(root))
    return sorted(f"{folder}/{f.base_name}" for f in found if f.base_name.endswith(".parquet"))


class LoserTree:
    """Merges sorted iterators of tuples: each inner node keeps the loser of its match, so a row costs log2(k) comparisons."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, self.k = sources, len(sources)
        self.rows: list[tuple | None] = [next(s, None) for s in sources]
        self.loser = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.rows[a], self.rows[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            held = self.loser[node]
            if building and held < 0:
                self.loser[node] = winner  # waits for its opponent
                return
            if self._beats(held, winner):
                self.loser[node], winner = winner, held
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.rows[top := self.loser[0]] is not None:
            yield self.rows[top]
            self.rows[top] = next(self.sources[top], None)
            self._play(top)


def read_run(path: str, low: tuple | None = None, high: tuple | None = None, rows: int = 1024) -> Iterator[tuple]:
    """The entries of a run in order, from ``low`` on and before ``high``; row groups outside are not read."""
    folder, _, name = path.rpartition("/")
    with open_file(folder, name) as raw:
        file = pq.ParquetFile(raw)
        groups = []
        for g in range(file.num_row_groups):
            stats = file.metadata.row_group(g).column(0).statistics
            known = stats is not None and stats.has_min_max
            if not (known and (low is not None and stats.max < low[0] or high is not None and stats.min > high[0])):
                groups.append(g)
        for batch in file.iter_batches(rows, groups, columns=NAMES):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if high is not None and row >= high:
                    return
                if low is None or row >= low:
                    yield row


def _whole_run(paths: list[str], low: tuple | None, high: tuple | None, rows: int) -> Iterator[tuple]:
    for path in paths:
        yield from read_run(path, low, high, rows)


def _merged(runs: list[list[str]], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    size = max(64, 200_000 // max(1, len(runs)))
    return iter(LoserTree([_whole_run(r, low, high, size) for r in runs]))


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


def _cut(low: tuple | None, high: tuple | None) -> tuple:
    return tuple(dict(zip(KEY, x, strict=True)) if x else None for x in (low, high))


def _tasks(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A task for each (part, runs, low, high)."""
    key = "struct<url_key:string,ts:string,known:int,page_id:long>"
    made = spark.createDataFrame([(i, runs, *_cut(low, high)) for i, runs, low, high in rows], f"part int, runs array<array<string>>, low {key}, high {key}")
    return made.repartitionByRange(max(1, len(rows)), "part")


def _fold(spark: SparkSession, folder: str, runs: list[list[str]], cuts: list[tuple]) -> list[list[str]]:
    """Merge runs in groups until one tree can take them all. A group is merged by several tasks, each of a range of keys; a merged run has a file for each range."""
    while len(runs) > FAN_IN:
        groups = [runs[i : i + FAN_IN] for i in range(0, len(runs), FAN_IN)]
        ranges = max(1, -(-(len(cuts) + 1) // len(groups)))
        own = [None, *(cuts[(len(cuts) + 1) * i // ranges - 1] for i in range(1, ranges)), None]
        rows = [(g * ranges + r, group, own[r], own[r + 1]) for g, group in enumerate(groups) for r in range(ranges)]
        out = f"{folder}/runs-{uuid.uuid4().hex}"

        def merge(batches: Iterator[pa.RecordBatch], out: str = out) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            attempt = TaskContext.get().taskAttemptId()
            for part, entries in _stretches(batches, 10_000):
                name, file, writer = f"run-{part:08d}-{attempt}.parquet", None, None
                for held in entries:
                    if file is None:
                        file = NewFile(out, name, str(attempt))
                        writer = pq.ParquetWriter(file.stream, pa.schema(list(zip(NAMES, TYPES, strict=True))))
                    writer.write_batch(_index_batch(held))
                if file is not None:
                    writer.close()
                    file.close()
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{out}/{name}"])], ["part", "file"])

        # a name for each range of a group; only reported files are read
        made = sorted(tuple(r) for r in materialize(_tasks(spark, rows).mapInArrow(tidy(merge), "part int, file string")).collect())
        merged: list[list[str]] = [[] for _ in groups]
        for part, file in made:
            merged[part // ranges].append(file)
        runs = [r for r in merged if r]
    return runs


def _splits(spark: SparkSession, runs: list[list[str]], parts: int) -> list[tuple]:
    """Keys that cut the index into stretches of about equal size, from a sample of bounded size."""
    index = spark.read.schema(INDEX).parquet(*(f for r in runs for f in r)).select(*KEY)
    n = index.count()
    every = max(1, n // (parts * 40))
    keys = sorted(tuple(r) for r in index.where(F.pmod(F.xxhash64(*KEY), F.lit(every)) == 0).limit(parts * 200).collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def merge_index(spark: SparkSession, folder: str, runs: list[list[str]], parts: int | None = None) -> DataFrame:
    """(part, runs, low, high): the stretches of the merged index; ``merged_index`` and ``read_back`` run through them."""
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _splits(spark, runs, parts) if runs else []
    runs = _fold(spark, folder, runs, cuts)
    ends = [None, *cuts, None] if runs else []
    return _tasks(spark, [(i, runs, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))])


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, Iterator[list[tuple]]]]:
    """Each task's number and its merged entries, ``size`` at a time."""

    def entries(task: dict) -> Iterator[list[tuple]]:
        low, high = (tuple(task[k].values()) if task[k] else None for k in ("low", "high"))
        found = _merged(task["runs"], low, high)
        while held := list(islice(found, size)):
            yield held

    for batch in batches:
        for task in batch.to_pylist():
            yield task["part"], entries(task)


def merged_index(tasks: DataFrame) -> DataFrame:
    """The globally ordered index."""
    return tasks.mapInArrow(tidy(lambda batches: (_index_batch(rows) for _, stretch in _stretches(batches, 10_000) for rows in stretch)), INDEX)


def read_back(folder: str, tasks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, capture_ts) of every record, in the order of the merged index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stretch in _stretches(batches, READ_ROWS):
            for rows in stretch:
                out: list[dict] = [{}] * len(rows)
                name, file = None, None
                # each archive is opened once and read forwards
                for i in sorted(range(len(rows)), key=lambda i: rows[i][4:6]):
                    if rows[i][4] != name:
                        if file:
                            file.close()
                        name = rows[i][4]
                        file = open_file(folder, name)
                    file.seek(rows[i][5])
                    out[i] = parse_record(file.read(rows[i][6])) | {"url_key": rows[i][0], "capture_ts": rows[i][1]}
                file.close()
                for i in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_pylist(out[i : i + 2000], schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()), ("capture_ts", pa.string())])
    return tasks.mapInArrow(tidy(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, capture_ts string")


def archive(pages: DataFrame, fetched: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC archives, merge their index and read everything back in its order."""
    folder, runs = write_archives(pages, fetched=fetched)
    return read_back(folder, merge_index(pages.sparkSession, folder, runs))
