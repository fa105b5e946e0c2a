"""Nested records to detail tables: positional ids, evidence rows, corrections, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import materialize
from quillgraph.operators.conflict import require_empty

#: A record's collections: (table, word in ids, field of the quote, fields of the table).
COLLECTIONS = {
    "actores": ("actor", "actor", "cita", ("nombre", "tipo", "rol", "stance", "nivel_involucramiento", "proyecto_asociado")),
    "instituciones_mencionadas": ("institution", "institucion", "cita", ("nombre", "tipo_norm", "rol_en_texto", "accion_institucional", "proyecto_asociado")),
    "linea_tiempo": ("event", "evento", "evidencia_hito", ("fecha", "date_precision", "descripcion", "tipo_hito", "proyecto_asociado")),
}
#: How evidence of a collection is called.
FIELDS = {"actor": "actor", "institution": "institucion", "event": "hito"}


def match_records(records: DataFrame, documents: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The records with their document_id, found by url, the first of a document by ``order``; and one row of counts: (matched, unmatched, duplicates)."""
    known = documents.groupBy("url").agg(F.min("document_id").alias("document_id"))
    met = materialize(records.join(known, "url", "left"))
    ids = met.where("document_id is not null")
    first = ids.groupBy("document_id").agg(F.min_by(F.struct(*(c for c in met.columns if c != "document_id")), order).alias("r")).select("document_id", "r.*")
    counts = met.agg(F.countDistinct("document_id").alias("matched"), F.count_if(F.col("document_id").isNull()).alias("unmatched"), (F.count("document_id") - F.countDistinct("document_id")).alias("duplicates"))
    return first, counts


def corrected_lists(records: DataFrame, corrections: DataFrame, field: str = "proyectos_mencionados") -> DataFrame:
    """Records whose list is replaced by a reviewer's (document_id, list), an empty one included; two corrections of a document raise."""
    require_empty(corrections.groupBy("document_id").count().where("count > 1"), "a correction is repeated")
    out = records.join(corrections.select("document_id", F.col(field).alias("_list"), F.lit(True).alias("_hit")), "document_id", "left")
    return out.withColumn(field, F.when(F.col("_hit"), F.col("_list")).otherwise(F.col(field))).drop("_list", "_hit")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def project_mentions(records: DataFrame) -> DataFrame:
    """(project_mention_id, document_id, idx, nombre_proyecto, case_mention_index, case_mention_id)."""
    x = records.select("document_id", F.posexplode("proyectos_mencionados").alias("idx", "x"))
    i = F.col("x.case_mention_index")
    return x.select(
        F.concat_ws(":", "document_id", F.lit("project"), F.col("idx").cast("string")).alias("project_mention_id"), "document_id", "idx", _text(F.col("x.nombre")).alias("nombre_proyecto"), i.alias("case_mention_index"),
        F.when(i.isNotNull(), F.concat_ws(":", "document_id", i.cast("string"))).alias("case_mention_id"),
    )


def items(records: DataFrame, collection: str) -> DataFrame:
    """A collection's table: positional id, document, place, fields, quote with what the model gave and whether it is verified, and the id of its evidence (null without a quote)."""
    table, word, quote, fields = COLLECTIONS[collection]
    x = records.select("document_id", F.posexplode(collection).alias("idx", "x"))
    own = {f.name for f in records.schema[collection].dataType.elementType}
    get = lambda name: F.col(f"x.{name}") if name in own else F.lit(None).cast("string")
    flag = lambda name: (F.coalesce(F.col(f"x.{name}"), F.lit(False)) if name in own else F.lit(False)).cast("int")
    at = F.col("idx").cast("string")
    more = [flag("fecha_year_grounded").alias("fecha_year_grounded")] if table == "event" else []
    return x.select(
        F.concat_ws(":", "document_id", F.lit(word), at).alias(f"{table}_id"), "document_id", "idx", *(_text(get(f)).alias(f) for f in fields), *more, _text(get(quote)).alias("quote"),
        _text(get(f"{quote}_original_modelo")).alias("quote_original"), flag(f"{quote}_verificada").alias("verified"),
        F.when(_text(get(quote)) != "", F.concat_ws(":", "document_id", F.lit("enrichment"), F.lit(FIELDS[table]), at)).alias("evidence_id"),
    )


def evidence_rows(records: DataFrame) -> DataFrame:
    """(evidence_id, document_id, campo, idx, quote, quote_original, verified) of every quote, the disputed object's among them."""
    out = None
    for collection, (table, *_) in COLLECTIONS.items():
        part = items(records, collection).where("evidence_id is not null").select("evidence_id", "document_id", F.lit(FIELDS[table]).alias("campo"), "idx", "quote", "quote_original", "verified")
        out = part if out is None else out.unionByName(part)
    if "evidencia_objeto_disputa" not in records.columns:
        return out
    given = lambda name, kind: F.col(name) if name in records.columns else F.lit(None).cast(kind)
    single = records.where(_text(F.col("evidencia_objeto_disputa")) != "").select(
        F.concat_ws(":", "document_id", F.lit("enrichment"), F.lit("objeto_disputa"), F.lit("0")).alias("evidence_id"), "document_id", F.lit("objeto_disputa").alias("campo"), F.lit(0).alias("idx"), F.col("evidencia_objeto_disputa").alias("quote"),
        _text(given("evidencia_objeto_disputa_original_modelo", "string")).alias("quote_original"), F.coalesce(given("evidencia_objeto_disputa_verificada", "boolean"), F.lit(False)).cast("int").alias("verified"),
    )
    return out.unionByName(single)


def detail_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The six tables of matched records: document, project_mention, actor, institution, event, evidence."""
    lists = [*COLLECTIONS, "proyectos_mencionados"]
    plain = records.select(*(c for c in records.columns if c not in (*lists, "revision")), F.to_json("proyectos_mencionados").alias("proyectos_mencionados_json"), *([F.coalesce("revision.nivel", F.lit("ninguno")).alias("revision_nivel"), F.to_json("revision.campos_afectados").alias("revision_campos_afectados_json"), _text(F.col("revision.motivo")).alias("revision_motivo")] if "revision" in records.columns else []))
    return {"document": plain, "project_mention": project_mentions(records), **{t: items(records, c) for c, (t, *_) in COLLECTIONS.items()}, "evidence": evidence_rows(records)}


def context_block(mentions: Column) -> Column:
    """The lines that tell a model about a document's case mentions: index, object, area, decision."""
    line = lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] objeto="), _text(x["tipo_objeto_raw"]), F.lit(" | comuna="), _text(x["comuna"]), F.lit(" | decision="), _text(x["decision"]))
    return F.array_join(F.transform(mentions, line), "\n")
