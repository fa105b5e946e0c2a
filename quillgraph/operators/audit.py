"""Audits as queries: keys, fingerprints, conservation, enumerations, sampling, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, StructField, StructType

from quillgraph.operators.components import materialize


def foreign_keys(links: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(name, violations) of child columns without a parent; nulls don't count."""
    parts = [
        child.select(F.col(c).alias("k")).where("k is not null").join(parent.select(F.col(p).alias("k")), "k", "left_anti").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("violations")).select("name", "violations")
        for name, child, c, parent, p in links
    ]
    return reduce(DataFrame.unionByName, parts)


def primary_keys(tables: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(name, duplicates): keys that occur more than once."""
    parts = [rows.groupBy(*key).count().where("count > 1").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("duplicates")).select("name", "duplicates") for name, rows, key in tables]
    return reduce(DataFrame.unionByName, parts)


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(n, fingerprint), whatever the rows' order: the sum, modulo 2**256, of the rows' SHA-256 hashes as numbers, in eight parts of 32 bits.

    A sum is combined before the shuffle and no list of hashes is made anywhere; unlike an exclusive or, it tells repeated rows.
    """
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    each = rows.select(digest.alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(8)]
    sums = each.agg(F.count(F.lit(1)).alias("n"), *parts)
    lower = [F.lpad(F.lower(F.hex((F.coalesce(f"s{i}", F.lit(0)) % F.lit(1 << 32)).cast("long"))), 8, "0") for i in range(8)]
    return sums.select("n", F.concat(*lower).alias("fingerprint"))


def enum_gaps(rows: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Values of a column that the label dictionary lacks."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().where(~F.col(column).isin(*labels))


def hash_sample(rows: DataFrame, key: str, seed: str, n: int, skip: int = 0) -> DataFrame:
    """The rows at places skip to skip + n in the order of sha256(seed|key)."""
    ordered = rows.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)).orderBy("_h", key)
    return ordered.limit(skip + n).orderBy("_h", key).offset(skip).drop("_h") if skip else ordered.limit(n).drop("_h")


def budget_waves(rows: DataFrame, order: str, cost: str, workers: int, cap: float, group: str | None = None) -> DataFrame:
    """Adds (wave, spent_before): rows run in waves of ``workers`` while what earlier waves spent is below the cap. ``order`` tells rows of a group apart.

    Rows are range-partitioned by group and order and numbered within partitions; only a group's rows by partition, a few
    numbers, are added up by themselves. Waves are summed the same way, so a group with most of the rows is spread.
    """
    key = [group] if group else ["_all"]
    dealt = rows if group else rows.withColumn("_all", F.lit(0))

    def running(df: DataFrame, by: str, value: Column, name: str) -> DataFrame:
        """``name``: the sum of ``value`` over a group's rows before this one, in the order of ``by``."""
        spread = materialize(df.repartitionByRange(*key, by).withColumns({"_part": F.spark_partition_id(), "_v": value}))
        parts = spread.groupBy(*key, "_part").agg(F.sum("_v").alias("_s"))
        upto = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        first = parts.withColumn("_first", F.coalesce(F.sum("_s").over(upto), F.lit(0))).select(*key, "_part", "_first")
        within = Window.partitionBy("_part", *key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        out = spread.withColumn("_w", F.coalesce(F.sum("_v").over(within), F.lit(0))).join(first, [*key, "_part"])
        return out.withColumn(name, F.col("_first") + F.col("_w")).drop("_part", "_v", "_w", "_first")

    numbered = running(dealt, order, F.lit(1), "_at").withColumn("wave", F.floor(F.col("_at") / workers)).drop("_at")
    waves = numbered.groupBy(*key, "wave").agg(F.sum(cost).alias("_c"))
    before = running(waves, "wave", F.col("_c"), "spent_before").drop("_c")
    out = numbered.join(before.where(F.col("spent_before") < cap), [*key, "wave"])
    return out if group else out.drop("_all")


def field_names(kind: DataType) -> set[str]:
    """All field names at any depth, for blindness checks."""
    if isinstance(kind, StructType):
        return {f.name for f in kind} | set().union(*(field_names(f.dataType) for f in kind))
    if isinstance(kind, MapType):
        return field_names(kind.keyType) | field_names(kind.valueType)
    return field_names(kind.elementType) if isinstance(kind, ArrayType) else set()


def require_blind(rows: DataFrame, hidden: set[str]) -> DataFrame:
    """The rows, if none of the hidden fields is in their schema at any depth."""
    if seen := sorted(field_names(rows.schema) & hidden):
        raise ValueError(f"a blind package shows {seen}")
    return rows


def publication_gate(status: str, blockers: DataFrame, open_queue: DataFrame, hashes: dict[str, tuple[str, str]], prints: tuple[str, str]) -> list[str]:
    """Reasons against publishing; none means go."""
    reasons = [] if status == "ok" else [f"status is {status}"]
    reasons += [] if blockers.isEmpty() else ["there are blockers"]
    reasons += [] if open_queue.isEmpty() else ["pairs are open"]
    reasons += [f"{name} has changed" for name, (want, got) in hashes.items() if want != got]
    return reasons + ([] if prints[0] == prints[1] else ["the topology has changed"])


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of tracked tables."""
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")).select("table", "rows") for name, rows in tables.items()])


def run_manifest(tables: dict[str, DataFrame], columns: dict[str, list[str]], violations: DataFrame, gate: list[str]) -> DataFrame:
    """(table, rows, fingerprint, violations, gate): what a run left behind, with the integrity and gate results on every row."""
    spark = violations.sparkSession
    total = violations.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))
    parts = []
    for name, rows in tables.items():
        about = fingerprint(rows, columns.get(name) or rows.columns)
        parts.append(about.select(F.lit(name).alias("table"), F.col("n").alias("rows"), "fingerprint"))
    said = spark.createDataFrame([("; ".join(gate) or "ok",)], "gate string")
    return reduce(DataFrame.unionByName, parts).crossJoin(total).crossJoin(said)


def review_package(conflicts: DataFrame, cases: DataFrame, projects: DataFrame, documents: DataFrame, hidden: set[str]) -> DataFrame:
    """(conflict_id, label, cases): for each conflict its cases, for each case its projects, for each project its documents, nested; no hidden field at any depth.

    ``cases`` (conflict_id, case_id), ``projects`` (case_id, project_id, name), ``documents`` (project_id, document_id, title, quotes array).
    """
    d = documents.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("document_id", "title", "quotes"))).alias("documents"))
    p = projects.join(d, "project_id", "left").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("project_id", "name", "documents"))).alias("projects"))
    c = cases.join(p, "case_id", "left").groupBy("conflict_id").agg(F.array_sort(F.collect_list(F.struct("case_id", "projects"))).alias("cases"))
    return require_blind(conflicts.select("conflict_id", "label").join(c, "conflict_id", "left"), hidden)


def open_pair_bundle(pairs: DataFrame, mentions: DataFrame, shared: DataFrame) -> DataFrame:
    """(pair_id, id_a, id_b, n_shared, a, b): open pairs, each side with its documents, mentions and names. ``mentions`` (project_id, document_id, name)."""
    side = mentions.groupBy("project_id").agg(F.countDistinct("document_id").alias("n_documents"), F.count(F.lit(1)).alias("n_mentions"), F.array_sort(F.collect_set("name")).alias("names"))
    out = pairs.select("id_a", "id_b").join(shared, ["id_a", "id_b"], "left")
    for k in ("a", "b"):
        out = out.join(side.select(F.col("project_id").alias(f"id_{k}"), F.struct("n_documents", "n_mentions", "names").alias(k)), f"id_{k}", "left")
    pair = F.substring(F.sha2(F.concat_ws("::", F.least("id_a", "id_b"), F.greatest("id_a", "id_b")), 256), 1, 20)
    return out.select(pair.alias("pair_id"), "id_a", "id_b", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), "a", "b")


def set_hash(rows: DataFrame, columns: list[str]) -> str:
    """The fingerprint of a set of rows: repeats don't count."""
    return fingerprint(rows.select(*columns).distinct(), columns).first()["fingerprint"]


def frozen(rows: DataFrame, key: str, want_hash: str, want_n: int) -> list[str]:
    """Reasons for which a universe of ids isn't the frozen one."""
    n = rows.select(key).distinct().count()
    reasons = [] if n == want_n else [f"{n} ids instead of {want_n}"]
    return reasons + ([] if set_hash(rows, [key]) == want_hash else ["other ids"])


def baseline(projects: DataFrame) -> dict[str, str]:
    """The snapshot of an identity mapping (project_id, case_id): hashes of the ids and of the mapping."""
    return {"ids": set_hash(projects, ["project_id"]), "mapping": set_hash(projects, ["project_id", "case_id"])}


def baseline_errors(projects: DataFrame, want: dict[str, str]) -> list[str]:
    """In what the present mapping differs from a snapshot."""
    return [name for name, found in baseline(projects).items() if want.get(name) != found]


def hash_reasons(want: dict[str, str], got: dict[str, str | None]) -> list[str]:
    """Reasons against a release by pinned hashes: missing and changed files."""
    return [f"{name} is missing" if got.get(name) is None else f"{name} has changed" for name in want if got.get(name) != want[name]]


def source_errors(spark: SparkSession, tables: dict[str, DataFrame], required: dict[str, int]) -> list[str]:
    """Reasons against a source: missing tables, and tables with fewer rows than they need."""
    short = {name: tables[name].limit(least).count() for name, least in required.items() if name in tables}
    return [f"{name} is missing" if name not in short else f"{name} has {short[name]} rows, {least} needed" for name, least in required.items() if short.get(name, -1) < least]


def conserved(expected: DataFrame, written: DataFrame, errors: DataFrame) -> DataFrame:
    """(expected, written, errors, conserved): whether every row went somewhere."""
    n = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    out = n(expected, "expected").crossJoin(n(written, "written")).crossJoin(n(errors, "errors"))
    return out.withColumn("conserved", F.col("written") + F.col("errors") == F.col("expected"))


def preflight(universe: DataFrame, done: DataFrame, quarantined: DataFrame, key: str, mean_cost: float, most: int | None = None) -> DataFrame:
    """(universe, done, retries, pending, selected, cost): what a run would do; quarantined rows are tried again."""
    ids = universe.select(key).distinct()
    left = ids.join(done.select(key).distinct(), key, "left_anti")
    again = left.join(quarantined.select(key).distinct(), key, "left_semi")
    n = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    out = n(ids, "universe").crossJoin(n(ids.join(done.select(key).distinct(), key, "left_semi"), "done")).crossJoin(n(again, "retries")).crossJoin(n(left, "pending"))
    chosen = F.col("pending") if most is None else F.least("pending", F.lit(most))
    return out.withColumn("selected", chosen).withColumn("cost", F.bround(chosen * F.lit(mean_cost), 6))


def checks_report(checks: dict[str, DataFrame]) -> DataFrame:
    """One row: how many violations each check has, and whether none has any."""
    parts = [rows.agg(F.count(F.lit(1)).alias(name)) for name, rows in checks.items()]
    out = reduce(DataFrame.crossJoin, parts)
    return out.withColumn("ok", reduce(lambda a, b: a & b, [F.col(name) == 0 for name in checks]))


def confusion(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall) of boolean columns; null where nothing is predicted, or true."""
    p, t = F.coalesce(predicted, F.lit(False)), F.coalesce(truth, F.lit(False))
    counts = rows.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    share = lambda a, b: F.bround(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 3)
    return counts.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})


def call_cost(prompt: Column, completion: Column, per_prompt: float, per_completion: float) -> Column:
    """What a call of a model costs, from its tokens and the prices of a million."""
    return (F.coalesce(prompt, F.lit(0)) * per_prompt + F.coalesce(completion, F.lit(0)) * per_completion) / 1e6


def record_schema(schema: StructType, quoted: dict[str, str], single: tuple[str, ...] = ()) -> StructType:
    """A record's schema from the extraction's: quoted fields of collections, and single ones, get <field>_verificada and <field>_original_modelo."""

    def extended(struct: StructType, names: tuple[str, ...]) -> StructType:
        more = [StructField(f"{n}_{end}", kind) for n in names if n in struct.names for end, kind in (("verificada", BooleanType()), ("original_modelo", StringType()))]
        return StructType([*struct.fields, *(f for f in more if f.name not in struct.names)])

    fields = []
    for f in schema.fields:
        kind = f.dataType
        if f.name in quoted and isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            kind = ArrayType(extended(kind.elementType, (quoted[f.name],)), kind.containsNull)
        fields.append(StructField(f.name, kind, f.nullable))
    return extended(StructType(fields), single)
