"""Sources and sinks: tolerant JSON lines, documents, gazetteers, GeoJSON, work plans, provider interfaces."""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.functions.text import strip


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """JSON lines; broken lines are dropped, or raise if strict."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_documents(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """One JSON object per file, with the file it came from."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("path", F.col("_metadata.file_path"))


def classifiable(documents: DataFrame, disposition) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The documents to work on, and those set aside by disposition, from a column that says so (``evidence.eligibility``)."""
    rows = documents.withColumn("disposition", disposition)
    aside = {name: rows.where(F.col("disposition") == name).drop("disposition") for name in ("too_long", "social_truncated")}
    return rows.where("disposition = 'eligible'").drop("disposition"), aside


def set_aside(rows: DataFrame, path: str, key: str = "url") -> None:
    """Append rows to a side output that does not have them yet; a second run adds nothing."""
    spark = rows.sparkSession
    try:
        known = spark.read.schema(rows.schema).json(path).select(key).distinct().checkpoint()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows.dropDuplicates([key]).write.json(path)
        return
    rows.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").json(path)


def read_records(spark: SparkSession, paths: list[str], schema: StructType, key: str = "url", outside: DataFrame | None = None) -> DataFrame:
    """Several files whose keys must not meet; a repeated key raises. Keys that are ``outside`` the universe are left out afterwards."""
    rows = spark.read.schema(schema).json(paths)
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is repeated across files")
    return rows if outside is None else rows.join(outside.select(key).distinct(), key, "left_anti")


def read_table(spark: SparkSession, name: str, jdbc: dict[str, str] | None = None, part: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table of the catalog, or by JDBC: read-only, in ``part`` (column, lower, upper, number) many reads."""
    if jdbc is None:
        return spark.table(name)
    reader = spark.read.format("jdbc").options(**jdbc).option("dbtable", name)
    if part:
        reader = reader.options(partitionColumn=part[0], lowerBound=part[1], upperBound=part[2], numPartitions=part[3])
    return reader.load()


def read_reviewed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The documents of a reviewed package, a JSON object with the list 'documentos'; without it it raises."""
    whole = spark.read.option("multiLine", True).schema("documentos array<string>").json(path)
    if whole.where("documentos is null").limit(1).count() or whole.isEmpty():
        raise ValueError("the package has no list 'documentos'")
    return whole.select(F.explode("documentos").alias("d")).select(F.from_json("d", schema).alias("d")).select("d.*")


def read_targets(spark: SparkSession, path: str, ids: list[str] | None = None, key: str = "id") -> DataFrame:
    """The entries of a registry (JSON, or YAML where a parser is installed: a list, or one under 'targets'), those with the ids; a missing id raises."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML registries need a YAML parser; give JSON") from e
        entries = yaml.safe_load(text)
    else:
        entries = json.loads(text)
    entries = entries["targets"] if isinstance(entries, dict) else entries
    if ids is not None:
        known = {str(e[key]): e for e in entries}
        if missing := [i for i in ids if i not in known]:
            raise ValueError(f"unknown ids: {missing}")
        entries = [known[i] for i in ids]
    rows = [{k: None if v is None else str(v) for k, v in e.items()} for e in entries]
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def content_paths(records: DataFrame, documents: DataFrame, key: str = "url") -> DataFrame:
    """Records with the path of their document's file, null without one; of several the first."""
    return records.join(documents.groupBy(key).agg(F.min("path").alias("path")), key, "left")


def case_rows(sample: DataFrame, records: DataFrame, texts: DataFrame, key: str, order: str) -> DataFrame:
    """The sampled records, the last of each key, with their full text (null without one)."""
    own = latest(records.join(sample.select(key).distinct(), key, "left_semi"), key, order)
    return own.join(texts.groupBy(key).agg(F.max("text").alias("text")), key, "left")


def universe(records: DataFrame, key: str, order: str) -> DataFrame:
    """What may be enriched: the last record of each key, of those that are included and of the dated scope."""
    return latest(records.where("decision_documento = 'include' and corpus_scope = 'temporal_v2'"), key, order)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with header and, maybe, a byte-order mark; columns are found by name, whatever their order."""
    names = [n.removeprefix("\ufeff") for n in spark.read.option("header", False).csv(path).limit(1).first() or []]
    if missing := [f.name for f in schema.fields if f.name not in names]:
        raise ValueError(f"columns are missing: {missing}")
    rows = spark.read.option("header", True).option("enforceSchema", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    return rows.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, geometry string) of a feature collection."""
    schema = "type string, features array<struct<type:string, properties:map<string,string>, geometry:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry").alias("geometry"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids from a text file, without comments and blank lines."""
    return spark.read.text(path).select(strip(F.col("value")).alias("id")).where("id <> '' and not startswith(id, '#')")


def pinned(spark: SparkSession, path: str, sha256: str) -> bool:
    """Whether a file has the expected hash."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0] == sha256


def work_plan(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """All combinations of three small lists, with a hash of each."""
    plan = first.crossJoin(F.broadcast(second)).crossJoin(F.broadcast(third))
    return plan.withColumn("query_hash", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in plan.columns)), 256))


def pending(plan: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What has no completion marker."""
    return plan.join(done.select(*key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, order: str, first: bool = False) -> DataFrame:
    """One record for each key: the last, or the first, by ``order``."""
    pick = F.min_by if first else F.max_by
    return rows.groupBy(key).agg(pick(F.struct("*"), order).alias("r")).select("r.*")


def with_provider(rows: DataFrame, provider: Callable[[dict], dict], schema: str) -> DataFrame:
    """Rows through an injected provider (page fetcher, search, model): the interface for sources that need a network."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([provider(r) for r in frame.to_dict("records")])

    return rows.mapInPandas(run, schema)


def with_retries(provider: Callable[[dict], dict], retryable: Callable[[dict], bool], tries: int = 5, wait: float = 1.0, pause: Callable[[float], None] = time.sleep) -> Callable[[dict], dict]:
    """A provider that is asked again while its answer is retryable, after 2**n times ``wait`` and some jitter; 'cost' adds up over all paid answers, 'tries' counts them."""

    def ask(row: dict) -> dict:
        cost = 0.0
        for n in range(tries):
            answer = provider(row)
            cost += float(answer.get("cost") or 0.0)
            if not retryable(answer) or n == tries - 1:
                break
            pause(wait * 2**n * (1 + random.random() / 4))
        return {**answer, "cost": cost, "tries": n + 1}

    return ask


class Pace:
    """Waiting times of a provider that blocks fast callers: a base with jitter, longer after errors; a pause when they don't end; and an end.

    ``errors`` count up to ``most_errors``, one less after a success. When they reach it, the caller pauses (longer each time, at
    most ``longest``) and they count anew; after ``most_pauses`` pauses it raises. One instance serves one task.
    """

    def __init__(self, base: float = 12.0, jitter: float = 6.0, step: float = 10.0, most_errors: int = 5, pause: float = 300.0, longest: float = 1800.0, most_pauses: int = 30, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time):
        self.base, self.jitter, self.step, self.most_errors, self.pause, self.longest, self.most_pauses = base, jitter, step, most_errors, pause, longest, most_pauses
        self.sleep, self.clock = sleep, clock
        self.errors, self.pauses, self.last = 0, 0, float("-inf")

    def wait(self) -> None:
        """Until the next call may be made."""
        due = self.last + self.base + random.uniform(0, self.jitter) + self.step * self.errors
        if due > self.clock():
            self.sleep(due - self.clock())
        self.last = self.clock()

    def tell(self, ok: bool) -> None:
        """How the call went."""
        if ok:
            self.errors = max(0, self.errors - 1)
            return
        self.errors += 1
        if self.errors < self.most_errors:
            return
        self.pauses += 1
        if self.pauses > self.most_pauses:
            raise RuntimeError(f"the provider has failed through {self.most_pauses} pauses")
        self.sleep(min(self.pause * self.pauses, self.longest))
        self.errors = 0


def paced(provider: Callable[[dict], dict], pace: Pace, failed: Callable[[dict], bool]) -> Callable[[dict], dict]:
    """A provider that is asked at a pace."""

    def ask(row: dict) -> dict:
        pace.wait()
        answer = provider(row)
        pace.tell(not failed(answer))
        return answer

    return ask


def run_capped(rows: DataFrame, key: str, provider: Callable[[dict], dict], schema: str, folder: str, workers: int, cap: float) -> float:
    """Ask a provider for rows in waves of ``workers``, in the order of ``key``, until what it has cost reaches ``cap``; gives the cost.

    Each wave's answers (with status and cost) are written to the three sinks before the next begins, and rows that the ok sink has
    are not asked for again, so that a run that broke off goes on.
    """
    spark = rows.sparkSession
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name == key)

    def done() -> DataFrame:
        try:
            return spark.read.schema(kind).json(f"{folder}/ok")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], kind)

    spent, last = 0.0, None
    while spent < cap:
        left = rows.join(done(), key, "left_anti")
        wave = (left if last is None else left.where(F.col(key) > last)).orderBy(key).limit(workers)
        answers = with_provider(wave.repartition(workers), provider, schema).checkpoint()
        about = answers.agg(F.count(F.lit(1)), F.sum("cost"), F.max(key)).first()
        if not about[0]:
            break
        write_split(answers, folder)
        spent, last = spent + float(about[1] or 0.0), about[2]
    return spent


def read_env(path: str) -> dict[str, str]:
    """Settings of a file of NAME=value lines on the driver; blank lines and comments don't count."""
    found = {}
    with open(path, encoding="utf-8") as file:
        for line in file:
            name, sign, value = line.strip().partition("=")
            if sign and not name.startswith("#"):
                found[name.strip()] = value.strip()
    return found


def page_fetcher(get: Callable[[str], tuple[int, bytes]]) -> Callable[[dict], dict]:
    """A provider of pages from a function that gets (status, body) of a URL or raises OSError: status ok, http_error or network_error."""

    def fetch(row: dict) -> dict:
        try:
            code, body = get(row["url"])
        except OSError as e:
            return {"url": row["url"], "status": "network_error", "code": None, "body": None, "error": str(e)[:200]}
        return {"url": row["url"], "status": "ok" if 200 <= code < 300 else "http_error", "code": code, "body": body, "error": None}

    return fetch


def page_retryable(answer: dict) -> bool:
    """Too many requests, a server's error, or no answer."""
    return answer["status"] == "network_error" or answer["code"] == 429 or (answer["code"] or 0) >= 500


def raw_captures(pages: DataFrame, folder: str, stamp: str) -> DataFrame:
    """(url, path, sha256, bytes): bodies written once each under '<stamp>_<first 16 of the hash>.raw' in a folder that all executors share; a capture that is there stays."""
    from quillgraph.sources.files import write_once

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, body in zip(frame["url"], frame["body"], strict=True):
                digest = hashlib.sha256(body).hexdigest()
                rows.append((url, write_once(folder, f"{stamp}_{digest[:16]}.raw", bytes(body)), digest, len(body)))
            yield pd.DataFrame(rows, columns=["url", "path", "sha256", "bytes"])

    return pages.where("body is not null").select("url", "body").mapInPandas(run, "url string, path string, sha256 string, bytes long")


def write_report(spark: SparkSession, rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A small report as one JSON file that appears whole: written beside it, then renamed over it. More than ``most`` rows raise."""
    held = [json.loads(r) for r in rows.limit(most + 1).toJSON().collect()]
    if len(held) > most:
        raise ValueError(f"a report has more than {most} rows")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    part, whole = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.part", path))
    system = whole.getFileSystem(conf)
    out = system.create(part, True)
    out.write(bytearray(json.dumps(held, ensure_ascii=False, indent=1).encode()))
    out.hsync()
    out.close()
    system.delete(whole, False)
    if not system.rename(part, whole):
        raise OSError(f"could not write {path}")


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder as it is, over an older one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf):
        raise OSError(f"could not publish {target}")


def copy_table(rows: DataFrame, path: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StructType:
    """A table written again with the schema that it turns out to have, after a change; gives the schema."""
    out = change(rows)
    out.write.mode("overwrite").parquet(path)
    return out.schema


def write_split(rows: DataFrame, folder: str, status: str = "status") -> None:
    """Results to three sinks by status: ok, error, invalid."""
    for name in ("ok", "error", "invalid"):
        rows.where(F.col(status) == name).write.mode("append").json(f"{folder}/{name}")


def write_table(rows: DataFrame, path: str) -> None:
    """Drop and rebuild."""
    rows.write.mode("overwrite").parquet(path)


def publish_tables(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> str:
    """Write several tables as one version, which readers see whole or not at all: tables first, then the pointer that names them. Gives the version."""
    version = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{version}/{name}")
    write_report(spark, spark.createDataFrame([(version, sorted(tables))], "version string, tables array<string>"), f"{folder}/current.json")
    return version


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the version that is published."""
    now = spark.read.schema("version string, tables array<string>").option("multiLine", True).json(f"{folder}/current.json").first()
    if now is None or name not in now["tables"]:
        raise ValueError(f"{name} is not published")
    return spark.read.parquet(f"{folder}/{now['version']}/{name}")
