"""Queries of the operators on nested records, the gate's layers and run logs, each with the SQL it equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import audit, evidence, nested, present
from quillgraph.plans.queries import _records, query, t
from quillgraph.sources import ingest
from quillgraph.streaming import resume

# Documents are case mentions with fields by their number; the first two lines of rules are the base layer, then quotes, then geography.
GATE_SQL = """
with m as (select doc_id as i, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as body, length(text) as n,
  case when doc_id % 11 = 0 then 'uncertain' when doc_id % 13 = 0 then 'exclude' else 'include' end as decision, case when doc_id % 7 = 0 then 'no' when doc_id % 17 = 0 then 'incierta' else 'confirmada' end as accion,
  case when doc_id % 5 = 0 then 'objeto_no_determinado' when doc_id % 19 = 0 then 'otro' else 'edificio' end as obj, case when doc_id % 23 = 0 then 'incierto' when doc_id % 29 = 0 then 'no' else 'si' end as estate,
  case when doc_id % 6 = 0 then 'desarrollo_proyecto' when doc_id % 31 = 0 then 'ocupacion_propiedad_sin_desarrollo' else 'inmueble_existente_relevancia_urbana' end as relation, doc_id % 8 = 0 as occupied,
  case when doc_id % 37 = 0 then 'fuera_de_area' when doc_id % 9 = 0 then 'ambigua' else 'comuna' end as geo, ['Ñuñoa', 'Lejos', 'Maipú y Lejos', '', 'MAIPU'][doc_id % 5 + 1] as comuna, case when doc_id % 12 = 0 then 'mencion_tangencial' when doc_id % 41 = 0 then 'x' else 'caso_principal' end as depth, lang from documents),
q as (select *, [left(text, 30)] as qa, case when i % 4 = 0 then [left(text, 30), 'nunca se dijo en el texto'] else [left(text, 30)] end as qo, case when i % 3 = 0 then ['nunca se dijo esto'] when i % 3 = 1 then [left(text, 6)] else [left(text, 40)] end as qg from m),
f as (select *, list_transform(qa, lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 15 and contains(body, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')))) as fa, list_transform(qo, lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 15 and contains(body, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')))) as fo,
  list_transform(qg, lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 15 and contains(body, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')))) as fg, comuna in ('Ñuñoa', 'MAIPU', 'Maipú y Lejos') as known from q),
g as (select *, geo <> 'fuera_de_area' and (case when comuna <> '' then known or i % 2 = 0 else true end) as area,
  -- the place of the list is the first six characters of the text where i % 3 = 1
  i % 3 = 1 and n >= 500 and regexp_replace(left(text, 6), '^\\s+|\\s+$', '', 'g') <> '' as short0 from f),
h as (select *, short0 and area as short, list_contains(fa, true) as sa, list_contains(fo, true) as so, list_contains(fg, true) as sg from g),
v as (select *, obj = 'objeto_no_determinado' and estate = 'si' and relation <> 'ocupacion_propiedad_sin_desarrollo' and sa and so and sg as ex1, obj = 'objeto_no_determinado' and estate = 'si' and relation <> 'ocupacion_propiedad_sin_desarrollo' and sa and so and (sg or short) as ex2,
  relation = 'inmueble_existente_relevancia_urbana' and occupied as veto from h),
r as (select *, list_filter([
  case when accion <> 'confirmada' then case when accion = 'no' then 'sin_accion_contenciosa' else 'accion_contenciosa_incierta' end end,
  case when relation = 'ocupacion_propiedad_sin_desarrollo' then 'objeto_existente_sin_vinculo_urbano' when obj = 'edificio' and estate = 'si' then null when obj = 'objeto_no_determinado' or estate = 'incierto' then case when ex2 and (not veto or true) then null else 'objeto_no_determinado' end else 'objeto_no_admisible' end,
  case when geo = 'fuera_de_area' then 'fuera_del_area_geografica' when geo = 'ambigua' then 'geografia_incierta' when comuna in ('Lejos', 'Maipú y Lejos') and not area then 'fuera_del_area_geografica' end,
  case when depth = 'mencion_tangencial' then 'mencion_tangencial' when depth = 'x' then 'caso_insuficientemente_documentado' end,
  case when not sa then 'evidencia_accion_no_verificada' end, case when not so then 'evidencia_objeto_no_verificada' end, case when not sg and not short then 'evidencia_geografica_no_verificada' end,
  case when veto then 'inmueble_existente_sin_intervencion_urbana_formal' end], lambda x: x is not null) as reasons from v)
select i as doc_id, case when decision = 'include' then array_to_string(reasons, ',') else '' end as gate_reasons, case when decision <> 'include' then decision
  when list_has_any(reasons, ['sin_accion_contenciosa', 'objeto_no_admisible', 'objeto_existente_sin_vinculo_urbano', 'fuera_del_area_geografica', 'mencion_tangencial']) then 'exclude' when len(reasons) > 0 then 'uncertain' else 'include' end as decision_final, short as short_geography_quote_accepted from r"""

AREAS = {"nunoa": "13120", "maipu": "13119"}


def gate_mentions(spark, d):
    i = F.col("doc_id")
    text = F.col("text")
    places = F.array(
        F.struct(F.left("text", F.lit(6)).alias("nombre"), F.when(i % 3 == 1, "barrio").otherwise("plaza").alias("tipo"), F.lit("").alias("codigo_comuna_ine")),
        F.struct(F.lit("Lugar").alias("nombre"), F.lit("comuna").alias("tipo"), F.when(i % 2 == 0, "13120").otherwise("99").alias("codigo_comuna_ine")),
    )
    never = F.lit("nunca se dijo en el texto")
    return t(spark, d, "documents").select(
        "doc_id", "source", "text", F.when(i % 11 == 0, "uncertain").when(i % 13 == 0, "exclude").otherwise("include").alias("decision"), F.when(i % 7 == 0, " No ").when(i % 17 == 0, "incierta").otherwise("Confirmada\n").alias("accion_contenciosa"),
        F.lit("demanda").alias("tipo_accion_contenciosa"), F.when(i % 5 == 0, "objeto_no_determinado").when(i % 19 == 0, "otro").otherwise("edificio").alias("tipo_objeto_norm"), F.lit("x").alias("tipo_objeto_raw"),
        F.when(i % 23 == 0, "incierto").when(i % 29 == 0, "no").otherwise("si").alias("es_proyecto_inmobiliario"), F.lit("si").alias("es_proyecto_vivienda_inmobiliario"),
        F.when(i % 6 == 0, "desarrollo_proyecto").when(i % 31 == 0, "ocupacion_propiedad_sin_desarrollo").otherwise("inmueble_existente_relevancia_urbana").alias("relacion_inmobiliaria_urbana"),
        F.when(i % 8 == 0, "ocupacion_propiedad").otherwise("otro").alias("tipo_conflicto_norm"), F.lit("none").alias("via_legal_norm"), F.when(i % 37 == 0, "fuera_de_area").when(i % 9 == 0, "ambigua").otherwise("comuna").alias("precision_geografica"),
        F.array(*map(F.lit, ("Ñuñoa", "Lejos", "Maipú y Lejos", "", "MAIPU")))[(i % 5).cast("int")].alias("comuna"), F.when(i % 12 == 0, "mencion_tangencial").when(i % 41 == 0, "x").otherwise("caso_principal").alias("profundidad_documentacion_caso"),
        F.array(F.left(text, F.lit(30))).alias("evidencia_accion_quotes"), F.when(i % 4 == 0, F.array(F.left(text, F.lit(30)), never)).otherwise(F.array(F.left(text, F.lit(30)))).alias("evidencia_objeto_quotes"),
        F.when(i % 3 == 0, F.array(F.lit("nunca se dijo esto"))).when(i % 3 == 1, F.array(F.left(text, F.lit(6)))).otherwise(F.array(F.left(text, F.lit(40)))).alias("evidencia_geografica_quotes"), places.alias("lugares_mencionados"),
    )


RULES = {"broad": ("edificio",), "residential": ("edificio",), "non_real_estate": (), "areas": AREAS}


@query(GATE_SQL)
def gate_decisions(spark, d):
    out = evidence.scope_gate(gate_mentions(spark, d), "inmobiliaria_urbana_amplia", **RULES)
    return out.select("doc_id", F.array_join("gate_reasons", ",").alias("gate_reasons"), "decision_final", "short_geography_quote_accepted")


@query("with g as (" + GATE_SQL + """) select source, case max(case decision_final when 'include' then 3 when 'uncertain' then 2 else 1 end) when 3 then 'include' when 2 then 'uncertain' else 'exclude' end as decision_documento
from g join documents using (doc_id) group by 1""")
def document_scope_decisions(spark, d):
    return evidence.document_decisions(gate_mentions(spark, d), t(spark, d, "documents"), "source", **RULES).select("source", "decision_documento")


@query("""
with o as (select conv_id, turn, case when turn % 3 = 0 then '  ' when turn % 3 = 1 then 'p' || turn % 5 else null end as periodo, case when turn % 2 = 0 then 'n' else chr(10) end as nivel from conversations),
w as (select conv_id, bool_or(trim(coalesce(periodo, '')) <> '' and trim(coalesce(nivel, ''), ' ' || chr(10)) <> '') as v2, bool_or(not (trim(coalesce(periodo, '')) <> '' and trim(coalesce(nivel, ''), ' ' || chr(10)) <> '')) as legacy from o group by 1)
select conv_id, case when v2 and legacy then 'temporal_v2_mixed_legacy' when v2 then 'temporal_v2' when legacy then 'legacy_sin_ventana' else 'unknown' end as scope from w""")
def lineage_scopes(spark, d):
    turn = F.col("turn")
    origin = F.struct(F.when(turn % 3 == 0, "  ").when(turn % 3 == 1, F.concat(F.lit("p"), (turn % 5).cast("string"))).alias("periodo"), F.when(turn % 2 == 0, "n").otherwise("\n").alias("nivel"))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(origin).alias("origins"))
    return rows.select("conv_id", evidence.lineage_scope(F.col("origins")).alias("scope"))


# quotes: the beginning of a turn with other spaces is literally in the conversation; another is not; a third is empty
QUOTES_SQL = """
with c as (select conv_id, string_agg(text, chr(10) order by turn) as body from conversations group by 1),
x as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as idx, role, text, case when turn % 3 = 0 then replace(left(text, 20), ' ', '  ') when turn % 3 = 1 then 'nunca se dijo' else ' ' end as cita from conversations),
y as (select x.*, trim(cita) <> '' and contains(trim(regexp_replace(lower(body), '\\s+', ' ', 'g')), trim(regexp_replace(lower(cita), '\\s+', ' ', 'g'))) as ok, trim(cita) <> '' as filled from x join c using (conv_id))
"""


def _quoted(spark, d):
    turn = F.col("turn")
    quote = F.when(turn % 3 == 0, F.replace(F.left("text", F.lit(20)), F.lit(" "), F.lit("  "))).when(turn % 3 == 1, "nunca se dijo").otherwise(" ")
    who = F.struct("turn", F.col("role").alias("nombre"), quote.alias("cita"), F.concat(F.lit("  "), F.when(turn % 2 == 0, F.col("role")).otherwise("otro"), F.lit("\n")).alias("proyecto_asociado"))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(who)).alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("body"))


@query(QUOTES_SQL + "select conv_id, idx, case when filled and not ok then '' else cita end as cita, case when filled and not ok then cita end as cita_original_modelo, ok as cita_verificada from y")
def quote_repairs(spark, d):
    fixed = _quoted(spark, d).select("conv_id", F.posexplode(evidence.repair_quotes(F.col("items"), F.col("body"))).alias("idx", "x"))
    return fixed.select("conv_id", "idx", "x.cita", "x.cita_original_modelo", "x.cita_verificada")


@query(QUOTES_SQL + """, z as (select c.conv_id, (row_number() over (partition by c.conv_id order by turn) - 1)::int as idx, case when turn % 2 = 0 then role else 'otro' end as own from conversations c)
select conv_id, idx, case when own in ('user', 'tool') then own else '' end as proyecto_asociado, case when own not in ('user', 'tool') then own end as proyecto_asociado_original_modelo, own in ('user', 'tool') as proyecto_asociado_verificada from z""")
def clean_associations(spark, d):
    names = F.array(F.lit(" user "), F.lit("tool"), F.lit(""), F.lit(None).cast("string"))
    fixed = _quoted(spark, d).select("conv_id", F.posexplode(evidence.clean_associations(F.col("items"), names)).alias("idx", "x"))
    return fixed.select("conv_id", "idx", "x.proyecto_asociado", "x.proyecto_asociado_original_modelo", "x.proyecto_asociado_verificada")


@query("""
select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as idx, case when turn % 4 between 0 and 2 and turn % 3 > 0 then (turn % 4)::int end as case_mention_index,
  case when turn % 3 > 0 and turn % 4 > 2 then (turn % 4)::int end as case_mention_index_original_modelo, turn % 3 > 0 and turn % 4 <= 2 as case_mention_index_verificada from conversations""")
def checked_indexes(spark, d):
    one = F.struct("turn", F.col("role").alias("nombre"), F.when(F.col("turn") % 3 > 0, (F.col("turn") % 4).cast("int")).alias("case_mention_index"))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    fixed = rows.select("conv_id", F.posexplode(evidence.check_indexes(F.col("p"), F.lit(3))).alias("idx", "x"))
    return fixed.select("conv_id", "idx", "x.case_mention_index", "x.case_mention_index_original_modelo", "x.case_mention_index_verificada")


@query("""
with x as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1) as idx, role = 'user' and turn % 4 = 0 as bad from conversations)
select conv_id, array_to_string(list_concat(case when conv_id % 2 = 0 then ['revision.campos_afectados'] else [] end, case when conv_id % 6 = 0 then ['revision.motivo'] else [] end,
  coalesce(list('actores[' || idx || '].cita' order by idx) filter (where bad), [])), ',') as errors, count(*) >= 4 as truncated from x group by conv_id""")
def record_rules(spark, d):
    user = F.col("role") == "user"
    one = F.struct("turn", F.when(user & (F.col("turn") % 4 == 0), " ").otherwise("x").alias("cita"), user.alias("cita_verificada"))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("actores"))
    even = F.col("conv_id") % 2 == 0
    errors = evidence.record_errors(F.when(even, "ninguno").otherwise("alto"), F.array(F.lit("a")), F.when(F.col("conv_id") % 3 == 0, "porque").otherwise(""), {"actores": (F.col("actores"), "cita")})
    return rows.select("conv_id", F.array_join(errors, ",").alias("errors"), evidence.maybe_truncated(F.col("actores"), 4).alias("truncated"))


@query("""
with r as (select page_id, 'u' || page_id % 70 as url from pages), d as (select 'u' || c_custkey as url, c_custkey as document_id from customer where c_custkey < 50)
select (select count(distinct document_id) from r join d using (url))::bigint as matched, (select count(*) from r where url not in (select url from d))::bigint as unmatched, (select count(*) - count(distinct document_id) from r join d using (url))::bigint as duplicates""")
def record_match_counts(spark, d):
    records = t(spark, d, "pages").select("page_id", F.concat(F.lit("u"), (F.col("page_id") % 70).cast("string")).alias("url"))
    documents = t(spark, d, "customer").where("c_custkey < 50").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_custkey").alias("document_id"))
    return nested.match_records(records, documents, "page_id")[1]


@query("""
with m as (select o_custkey::varchar as document_id, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as idx, case when o_custkey % 10 = 0 then 'corregido' else coalesce(o_orderstatus, '') end as nombre, case when o_orderkey % 3 > 0 then (o_orderkey % 3)::int end as i, o_orderkey from orders)
select document_id || ':project:' || idx as project_mention_id, document_id, idx, nombre as nombre_proyecto, i as case_mention_index, case when i is not null then document_id || ':' || i end as case_mention_id from m""")
def detail_project_mentions(spark, d):
    """Customers are records, their orders projects; a tenth of the records has a corrected list."""
    k = F.col("o_orderkey")
    index = F.when(k % 3 > 0, (k % 3).cast("int")).alias("case_mention_index")
    own = lambda name: F.transform(F.array_sort(F.collect_list(F.struct(k, name, index))), lambda x: F.struct(x["nombre"].alias("nombre"), x["case_mention_index"].alias("case_mention_index")))
    o = t(spark, d, "orders").withColumn("document_id", F.col("o_custkey").cast("string"))
    records = o.groupBy("document_id").agg(own(F.col("o_orderstatus").alias("nombre")).alias("proyectos_mencionados"))
    corrections = o.where("o_custkey % 10 = 0").groupBy("document_id").agg(own(F.lit("corregido").alias("nombre")).alias("proyectos_mencionados"))
    return nested.project_mentions(nested.corrected_lists(records, corrections))


@query("""with x as (select conv_id::varchar as document_id, (row_number() over (partition by conv_id order by turn) - 1)::int as idx, role, text from conversations)
select document_id || ':enrichment:actor:' || idx as evidence_id, document_id, 'actor' as campo, idx, md5(text) as quote, 1 as verified from x where role = 'user' and text <> ''
union all select distinct document_id || ':enrichment:objeto_disputa:0', document_id, 'objeto_disputa', 0, md5('disputa ' || document_id), (document_id::int % 2)::int from x where document_id::int % 3 = 0""")
def detail_evidence(spark, d):
    records = _records(spark, d)
    empty = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    i = F.col("document_id").cast("int")
    records = records.withColumns(
        {
            "instituciones_mencionadas": empty("nombre:string,cita:string"), "linea_tiempo": empty("fecha:string,evidencia_hito:string"),
            "evidencia_objeto_disputa": F.when(i % 3 == 0, F.concat(F.lit("disputa "), "document_id")), "evidencia_objeto_disputa_verificada": i % 2 == 1,
        }
    )
    return nested.evidence_rows(records).select("evidence_id", "document_id", "campo", "idx", F.md5(F.col("quote").cast("binary")).alias("quote"), "verified")


@query("""with x as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1) as i, role from conversations)
select conv_id, string_agg('[' || i || '] objeto=' || role || ' | comuna= | decision=include', chr(10) order by i) as block from x group by 1""")
def context_blocks(spark, d):
    one = F.struct("turn", F.col("role").alias("tipo_objeto_raw"), F.lit(None).cast("string").alias("comuna"), F.lit("include").alias("decision"))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return rows.select("conv_id", nested.context_block(F.col("m")).alias("block"))


@query("select conv_id, sum(length(text))::bigint as chars, round((sum(case when role = 'user' then length(text) else 0 end) * 0.5 + sum(case when role = 'user' then 0 else length(text) end) * 2.0) / 1e6, 9) as cost from conversations group by 1")
def call_costs(spark, d):
    user = F.col("role") == "user"
    n = F.length("text")
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.sum(n).alias("chars"), F.sum(F.when(user, n)).alias("p"), F.sum(F.when(~user, n)).alias("c"))
    return rows.select("conv_id", "chars", F.round(audit.call_cost(F.col("p"), F.col("c"), 0.5, 2.0), 9).alias("cost"))


@query("""with l as (select user_id as q, event_type from events), done as (select distinct q from l where event_type = 'purchase') select distinct user_id as q from events where user_id not in (select q from done)
union all select distinct c_custkey + 100000 from customer""")
def resumed_plan(spark, d):
    """Users are queries, purchases their completion markers; customers are queries that were never begun."""
    log = t(spark, d, "events").select(F.col("user_id").alias("q"), F.col("event_type").alias("event"))
    plan = log.select("q").distinct().unionByName(t(spark, d, "customer").select((F.col("c_custkey") + 100000).alias("q")))
    return resume.resume_plan(plan, log, "q", marker="purchase")


@query("select user_id as stage, arg_max(event_type, ts) as state, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as at from events group by 1")
def stage_states(spark, d):
    log = t(spark, d, "events").select(F.col("user_id").alias("stage"), F.col("event_type").alias("state"), F.col("ts").alias("at"))
    return resume.run_states(log).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("select event_type, min(event_id) as event_id, arg_min(user_id, event_id) as user_id from events group by 1")
def delivered_once(spark, d):
    return resume.once(t(spark, d, "events").select("event_type", "event_id", "user_id"), "event_type", "event_id")


@query("""select doc_id, md5(text) as text_md5 from documents where doc_id in (select doc_id from labels)""")
def sampled_case_rows(spark, d):
    docs = t(spark, d, "documents")
    rows = ingest.case_rows(t(spark, d, "labels"), docs.select("doc_id", "source"), docs.select("doc_id", "text"), "doc_id", "source")
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""select 'areas' as part, count(*)::bigint as n, sum(length('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}'))::bigint as chars from region
union all select 'nations', count(*), sum(length('{"n_name":"' || n_name || '"}'))::bigint from nation""")
def dataset_rows(spark, d):
    rows = present.dataset({"areas": t(spark, d, "region"), "nations": t(spark, d, "nation").select("n_name")})
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("row")).alias("chars"))


@query("""with c as (select n_nationkey as conflict_id, case when n_nationkey % 2 = 0 then 'respaldo_exact_quote_detectado' end as respaldo from nation) select conflict_id from c where respaldo is not null""")
def backed_conflict_ids(spark, d):
    k = F.col("n_nationkey")
    return present.backed_conflicts(t(spark, d, "nation").select(k.alias("conflict_id"), F.when(k % 2 == 0, present.BACKED).alias("respaldo_evidencia")))
