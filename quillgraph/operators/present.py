"""Presentation: territory roll-up, nested conflict detail, timeline, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.geo import rate_per_100k
from quillgraph.operators.network import display_names

# Fixed value: the status of conflicts with a verified quote of their own.
BACKED = "respaldo_exact_quote_detectado"


def first_rows(rows: DataFrame, key: list[str], order: list, n: int, distinct: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key, of distinct values if asked for."""
    if distinct:
        rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy(*key, distinct).orderBy(*order))).where("_d = 1").drop("_d")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rn") <= n)


def territory(areas: DataFrame, facts: DataFrame, key: str, counted: dict[str, str], population: str) -> DataFrame:
    """Every area with distinct counts of its facts (zeros filled) and rates."""
    counts = facts.groupBy(key).agg(*(F.countDistinct(c).alias(name) for name, c in counted.items()))
    out = areas.join(counts, key, "left")
    for name in counted:
        out = out.withColumn(name, F.coalesce(name, F.lit(0)).cast("long")).withColumn(f"{name}_rate", rate_per_100k(F.col(name), F.col(population)))
    return out


def timeline(events: DataFrame, n: int = 500) -> DataFrame:
    return events.where("fecha_year_grounded = 1").orderBy("fecha", "event_id").limit(n)


def conflict_detail(conflicts: DataFrame, projects: DataFrame, quotes: DataFrame, events: DataFrame, most_quotes: int = 3, most_events: int = 8) -> DataFrame:
    """Nested detail of each conflict: projects, first distinct focal quotes (others only where there are none and it is backed), first events."""
    p = projects.groupBy("conflict_id").agg(F.array_sort(F.collect_list(F.struct("name", "project_id"))).alias("projects"))
    has = quotes.where("focal").select("conflict_id").distinct().withColumn("has_focal", F.lit(True))
    usable = quotes.join(has, "conflict_id", "left").join(conflicts.select("conflict_id", "backed"), "conflict_id")
    usable = usable.where(F.col("focal") | (F.col("has_focal").isNull() & F.col("backed")))
    q = first_rows(usable, ["conflict_id"], ["document_id", "evidence_id"], most_quotes, "quote").groupBy("conflict_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "quote"))), lambda x: x["quote"]).alias("quotes"))
    total = events.groupBy("conflict_id").agg(F.count(F.lit(1)).alias("n_events"))
    e = first_rows(events, ["conflict_id"], ["fecha", "event_id"], most_events).groupBy("conflict_id").agg(F.array_sort(F.collect_list(F.struct("rn", "fecha", "event_id"))).alias("events"))
    out = conflicts
    for part in (p, q, e, total):
        out = out.join(part, "conflict_id", "left")
    return out.withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))


def backed_conflicts(conflicts: DataFrame) -> DataFrame:
    """(conflict_id) of the conflicts with backing; none where the table has no such column."""
    if "respaldo_evidencia" not in conflicts.columns:
        return conflicts.select("conflict_id").where("false")
    return conflicts.where(F.col("respaldo_evidencia") == BACKED).select("conflict_id").distinct()


def safe_document_conflicts(tables: dict[str, DataFrame]) -> DataFrame:
    """(document_id, conflict_id, role): the safe view if there is one, else the same rule on the tables, else (without case units) the roles alone."""
    if "document_conflict_case_safe" in tables:
        return tables["document_conflict_case_safe"].select("document_id", "conflict_id", "role")
    rows = tables["document_conflict"].where(F.col("role").isin("focal", "co_focal"))
    if "document_case_unit" in tables:
        rows = rows.join(tables["document_case_unit"].where("unidad_caso_tipo = 'caso_unico'").select("document_id").distinct(), "document_id", "left_semi")
    return rows.select("document_id", "conflict_id", "role")


def linked_actors(links: DataFrame, actors: DataFrame, institutions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(conflict_id, key, nombre, entity_id, tipo, stance, nivel_involucramiento): actors and institutions of explicit links, the last link of an identity counting.

    A link's source_table says which table its source_id is in; links without a row there say nothing. ``links`` has (link_id, conflict_id, source_table, source_id, resolution_status).
    """
    a = actors.select(F.lit("enrichment_actor").alias("source_table"), F.col("actor_id").alias("source_id"), F.col("nombre").alias("_name"), "tipo", "stance", "nivel_involucramiento")
    none = F.lit(None).cast("string")
    i = institutions.select(F.lit("enrichment_institution").alias("source_table"), F.col("institucion_id").alias("source_id"), F.col("nombre").alias("_name"), F.col("tipo_norm").alias("tipo"), none.alias("stance"), none.alias("nivel_involucramiento"))
    met = links.where("resolution_status = 'resolved_explicit'").join(a.unionByName(i), ["source_table", "source_id"])
    named = display_names(met, "_name", entities, aliases).withColumn("key", F.coalesce("entity_id", "nombre"))
    kept = ("nombre", "entity_id", "tipo", "stance", "nivel_involucramiento")
    return named.groupBy("conflict_id", "key").agg(F.max_by(F.struct(*kept), "link_id").alias("r")).select("conflict_id", "key", "r.*")


def linked_events(links: DataFrame, events: DataFrame) -> DataFrame:
    """(conflict_id, event_id, fecha, descripcion, tipo_hito) of explicit links to events."""
    own = links.where("resolution_status = 'resolved_explicit' and source_table = 'enrichment_event'").select("conflict_id", F.col("source_id").alias("event_id"))
    return own.join(events.select("event_id", "fecha", "descripcion", "tipo_hito"), "event_id").select("conflict_id", "event_id", "fecha", "descripcion", "tipo_hito")


def other_quotes(mentions: DataFrame, most: int = 3) -> DataFrame:
    """(conflict_id, rn, quote): the first quotes of a conflict's other documents, by document and evidence, repeats included."""
    return first_rows(mentions, ["conflict_id"], ["document_id", "evidence_id"], most).select("conflict_id", "rn", "quote")


def summary(tables: dict[str, DataFrame], conflicts: DataFrame, actors: DataFrame, territories: DataFrame, population: str = "n_conflicts") -> DataFrame:
    """One row of totals: rows by table, conflicts with and without backing, distinct identities among the conflicts' actors, territories with conflicts."""
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    parts = [count(rows, f"n_{name}") for name, rows in tables.items()]
    backed = conflicts.join(backed_conflicts(conflicts).withColumn("_b", F.lit(True)), "conflict_id", "left")
    parts += [
        backed.agg(F.count(F.lit(1)).alias("n_conflicts_total"), F.count("_b").alias("n_conflicts_evidence_backed"), F.count_if(F.col("_b").isNull()).alias("n_conflicts_without_exact_backing")),
        actors.agg(F.countDistinct(F.coalesce("entity_id", "nombre")).alias("n_actors")),
        count(territories.where(F.col(population) > 0), "n_territories_with_conflicts"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)
    return out


def conflicts_in_order(conflicts: DataFrame) -> DataFrame:
    """Conflicts by their number of cases, the largest first, ties by id."""
    return conflicts.orderBy(F.desc("n_case_ids"), "conflict_id")


def dataset(parts: dict[str, DataFrame]) -> DataFrame:
    """One JSON row for each part of the presentation dataset's rows."""
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out
