"""Queries of the evidence-graph operators over the driver's tables, each with the SQL it equals.

The tables take roles: parts are project mentions, orders are links, nations cases, regions conflicts, events
actors' appearances.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.fragment import fragment
from quillgraph.operators import audit, conflict, evidence, geo, layers, nested, network, present, resolve
from quillgraph.operators.components import connected_components, materialize
from quillgraph.sources import ingest
from quillgraph.streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"
TEXT, QUOTE = NORM.format("d.text"), NORM.format("b.text")


@query(f"""
with d as (select doc_id, {TEXT} as body from documents d), b as (select item_id, {QUOTE} as quote from benchmark b)
select b.item_id, d.doc_id, l.quality, l.toxic from d join b on length(b.quote) >= 15 and contains(d.body, b.quote)
left join labels l on l.doc_id = d.doc_id""")
def quote_literal_hits(spark, d):
    hits = evidence.literal_hits(t(spark, d, "benchmark"), t(spark, d, "documents"), "item_id", "doc_id")
    return hits.join(t(spark, d, "labels"), "doc_id", "left").select("item_id", "doc_id", "quality", "toxic")


@query(f"""
with q as (select doc_id, source, {TEXT} as body, list_concat(string_split(text, chr(10)), [case when doc_id % 2 = 0 then left(text, 30) else 'never in the text' end]) as quotes from documents d),
f as (select source, list_transform(quotes, lambda q: length(regexp_replace(q, '^\\s+|\\s+$', '', 'g')) >= 15 and contains(body, trim(regexp_replace(lower(q), '\\s+', ' ', 'g')))) as flags from q)
select source, count(*)::bigint as n, sum(len(list_filter(flags, lambda f: f)))::bigint as n_flags, count_if(list_contains(flags, true))::bigint as n_sufficient,
       count_if(list_contains(flags, true) and not list_contains(flags, false))::bigint as n_valid from f group by source""")
def quote_flags_summary(spark, d):
    docs = t(spark, d, "documents")
    quotes = F.concat(F.split("text", "\n"), F.array(F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 30)).otherwise("never in the text")))
    rows = docs.select("source", evidence.quote_flags(quotes, F.col("text")).alias("flags"))
    f = F.col("flags")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter("flags", lambda x: x))).alias("n_flags"), F.count_if(evidence.sufficient(f)).alias("n_sufficient"), F.count_if(evidence.contract_valid(f)).alias("n_valid"))


@query("""
with k as (select sha256(text) as h, min(doc_id) as keep from documents group by 1),
x as (select case when n_chars < 200 then 'too_short' when source = 'src3' then 'legacy' when d.doc_id <> k.keep then 'exact_duplicate'
  when lang = 'de' then 'not_listed' when n_chars > 30000 then 'too_long' else 'eligible' end as disposition, n_chars
  from documents d join k on sha256(d.text) = k.h)
select disposition, count(*)::bigint as n, sum(n_chars)::bigint as chars from x group by 1""")
def doc_eligibility(spark, d):
    docs = t(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    keep = docs.groupBy("h").agg(F.min("doc_id").alias("keep"))
    rows = docs.join(keep, "h")
    scope = F.when(F.col("source") == "src3", "legacy_sin_ventana").otherwise("temporal_v2")
    how = evidence.eligibility(F.col("n_chars"), scope, F.col("doc_id") != F.col("keep"), F.col("lang") != "de", F.lit(""))
    return rows.withColumn("disposition", how).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""
select sha256(text) as text_hash, count(*)::bigint as group_size, min(doc_id) as canonical, count(distinct source) > 1 as mixed
from documents group by 1 having count(*) > 1""")
def exact_duplicate_groups(spark, d):
    return conflict.exact_groups(t(spark, d, "documents").withColumn("text_hash", F.sha2("text", 256)), "text_hash", "doc_id", "source")


@query("""
with recursive k as (
  select doc_id, sha256(text) as k from documents union all select doc_id, 'line' || split_part(text, chr(10), 1) from documents where length(split_part(text, chr(10), 1)) >= 40),
hub as (select k, min(doc_id) as hub from k group by k),
e as (select distinct k.doc_id as a, hub.hub as b from k join hub using (k) where k.doc_id <> hub.hub),
s as (select a, b from e union select b, a from e),
walk(node, reach) as (select doc_id, doc_id from documents union select walk.node, s.b from walk join s on s.a = walk.reach)
select node as doc_id, min(reach) as component from walk group by node""")
def doc_duplicate_components(spark, d):
    docs = t(spark, d, "documents")
    line = F.split("text", "\n")[0]
    keys = docs.select("doc_id", F.sha2("text", 256).alias("k")).unionByName(docs.where(F.length(line) >= 40).select("doc_id", F.concat(F.lit("line"), line).alias("k")))
    hubs = keys.groupBy("k").agg(F.min("doc_id").alias("dst"))
    edges = keys.join(hubs, "k").select(F.col("doc_id").alias("src"), "dst")
    return connected_components(edges, docs.select(F.col("doc_id").alias("node"))).withColumnRenamed("node", "doc_id")


@query("""
select source, case max(case when l.doc_id is null then 0 when toxic = 1 then 1 when quality = 1 then 3 else 2 end)
  when 3 then 'include' when 2 then 'uncertain' when 1 then 'exclude' else 'insufficient_content' end as decision
from documents d left join labels l using (doc_id) group by source""")
def decision_priority(spark, d):
    docs = t(spark, d, "documents")
    decision = F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 1, "include").otherwise("uncertain")
    return evidence.best_decision(docs.join(t(spark, d, "labels"), "doc_id").withColumn("decision", decision), docs, "source")


PARTS_SQL = """
with m as (select case p_partkey % 4 when 0 then upper(p_name) when 1 then 'El Proyecto ' || p_name when 2 then p_name || '.' else p_name end as name, p_brand as document_id, p_name as key from part)"""


def _part_mentions(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    name = F.when(k == 0, F.upper(n)).when(k == 1, F.concat(F.lit("El Proyecto "), n)).when(k == 2, F.concat(n, F.lit("."))).otherwise(n)
    return t(spark, d, "part").select(name.alias("name"), F.col("p_brand").alias("document_id"))


@query(PARTS_SQL + """,
l as (select key, name, row_number() over (partition by key order by count(*) desc, length(name), name) as r, count(*) as n from m group by 1, 2)
select m.key, count(distinct document_id)::bigint as n_documents, count(*)::bigint as n_mentions, any_value(l.name) as canonical_name, substr(sha256('project|' || m.key), 1, 24) as project_id
from m join l on l.key = m.key and l.r = 1 group by m.key""")
def project_registry(spark, d):
    return resolve.registry(_part_mentions(spark, d)).select("key", "n_documents", "n_mentions", "canonical_name", "project_id")


@query(PARTS_SQL + """,
h as (select *, key || case when key like 'red %' and document_id in ('Brand#1', 'Brand#2') then '#one' when key like 'red %' and document_id = 'Brand#3' then '#two' else '' end as full_key from m)
select full_key as key, any_value(key) as normalized_name, case when any_value(key) in (select key from m where key like 'red %' and document_id in ('Brand#1', 'Brand#2', 'Brand#3')) then coalesce(nullif(split_part(full_key, '#', 2), ''), 'sin_particion') end as homonym_partition, count(*)::bigint as n_mentions from h group by 1""")
def homonym_partitions(spark, d):
    rows = _part_mentions(spark, d)
    red = rows.select(X.norm_name(F.col("name")).alias("key"), "document_id").distinct().where("key like 'red %' and document_id in ('Brand#1', 'Brand#2', 'Brand#3')")
    splits = red.withColumn("part", F.when(F.col("document_id") == "Brand#3", "two").otherwise("one"))
    return resolve.registry(rows, splits).select("key", "normalized_name", "homonym_partition", "n_mentions")


@query("select p_partkey, substr(sha256('link|part|' || p_partkey || '|' || p_name), 1, 24) as link_id from part")
def stable_ids(spark, d):
    return t(spark, d, "part").select("p_partkey", X.stable_id("link", "part", F.col("p_partkey").cast("string"), F.col("p_name")).alias("link_id"))


NAMES_SQL = "with n as (select distinct name from (select p_name as name from part union all select p_name || ' ' || lower(p_type) from part) where length(name) >= 6)"


def _names(spark, d):
    parts = t(spark, d, "part")
    return parts.select(F.col("p_name").alias("name")).unionByName(parts.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))).distinct()


@query(NAMES_SQL + " select x.name as a, y.name as b from n x join n y on x.name < y.name and (contains(x.name, y.name) or contains(y.name, x.name))")
def review_candidates(spark, d):
    return resolve.review_pairs(_names(spark, d))


@query("""
with n as (select distinct p_name || case p_size % 4 when 0 then '' when 1 then ' etapa ' || (p_size % 3 + 1) when 2 then ' ' || (p_size % 2 + 1) else ' fase ii' end as name from part),
p as (select x.name as a, y.name as b from n x join n y on x.name < y.name and (contains(y.name, x.name) or contains(x.name, y.name)) and length(x.name) >= 6 and length(y.name) >= 6),
s as (select *, list_sort(list_distinct(regexp_extract_all(a, '\\b((?:etapa|fase)\\s+[ivx\\d]+)\\b', 1))) as sa, list_sort(list_distinct(regexp_extract_all(b, '\\b((?:etapa|fase)\\s+[ivx\\d]+)\\b', 1))) as sb,
  regexp_extract(a, '\\b(i{1,3}|iv|\\d+)\\s*$', 1) as ta, regexp_extract(b, '\\b(i{1,3}|iv|\\d+)\\s*$', 1) as tb from p),
r as (select a, b, case when len(sa) + len(sb) > 0 and sa <> sb then 'explicit_stage' when ta <> tb then 'trailing_numeral' else 'open' end as reason from s)
select a, b, case when reason = 'explicit_stage' then false end as same, reason from r""")
def pair_decision(spark, d):
    size = F.col("p_size")
    tail = F.when(size % 4 == 0, "").when(size % 4 == 1, F.concat(F.lit(" etapa "), (size % 3 + 1).cast("string"))).when(size % 4 == 2, F.concat(F.lit(" "), (size % 2 + 1).cast("string"))).otherwise(" fase ii")
    pairs = resolve.review_pairs(t(spark, d, "part").select(F.concat("p_name", tail).alias("name")))
    same, reason = resolve.pair_decision(F.col("a"), F.col("b"))
    return pairs.withColumns({"same": same, "reason": reason})


LINKS_SQL = """
with links as (select event_id as link_id, user_id as document_id, case when cast(json_extract_string(props, '$.k') as int) % 3 = 0 then ' ' || chr(10) else event_type || cast(json_extract_string(props, '$.k') as int) % 4 end as raw from events),
mentions as (select o_custkey as document_id, ['click', 'view', 'error', 'purchase', 'signup'][o_orderkey % 5 + 1] || (o_orderkey % 3) as name, case when o_totalprice < 60000 then ['click', 'view', 'error', 'purchase', 'signup'][o_orderkey % 5 + 1] || (o_orderkey % 3) end as project_id from orders),
known as (select document_id, name, min(project_id) as explicit from mentions group by 1, 2),
per as (select document_id, count(distinct project_id) as n, min(project_id) as only_one from mentions group by 1),
r as (select l.link_id, l.document_id, m.explicit, case when trim(raw, ' ' || chr(10)) <> '' and m.explicit is not null then 'resolved_explicit' when trim(raw, ' ' || chr(10)) <> '' then 'unresolved_inconsistent_association'
  when per.n = 1 then 'inferred_single_project' when coalesce(per.n, 0) = 0 then 'unresolved_no_project' else 'unresolved_ambiguous' end as resolution_status, per.only_one
  from links l left join known m on m.document_id = l.document_id and m.name = l.raw left join per on per.document_id = l.document_id),
a as (select link_id, document_id, resolution_status, case resolution_status when 'resolved_explicit' then explicit when 'inferred_single_project' then only_one end as project_id from r)
"""


def _links(spark, d):
    """Events are links, orders mentions, those of a low price of a project."""
    k = F.get_json_object("props", "$.k").cast("int")
    links = t(spark, d, "events").select(F.col("event_id").alias("link_id"), F.col("user_id").alias("document_id"), F.when(k % 3 == 0, " \n").otherwise(F.concat("event_type", (k % 4).cast("string"))).alias("raw"))
    kinds = F.array(*map(F.lit, ("click", "view", "error", "purchase", "signup")))
    name = F.concat(kinds[(F.col("o_orderkey") % 5).cast("int")], (F.col("o_orderkey") % 3).cast("string"))
    mentions = t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), name.alias("name"), F.when(F.col("o_totalprice") < 60000, name).alias("project_id"))
    return resolve.associations(links, mentions).select("link_id", "document_id", "resolution_status", "project_id")


@query(LINKS_SQL + "select * from a")
def association_status(spark, d):
    return _links(spark, d)


UNITS_SQL = ", u as (select distinct c_custkey as document_id from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))"


def _view(spark, d, inferred):
    units = t(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "caso_unico").otherwise("panoramico").alias("unidad_caso_tipo"))
    return resolve.link_view(_links(spark, d), units, inferred).select("link_id", "document_id", "resolution_status", "project_id")


@query(LINKS_SQL + UNITS_SQL + " select a.* from a semi join u using (document_id) where resolution_status = 'resolved_explicit'")
def safe_links(spark, d):
    return _view(spark, d, False)


@query(LINKS_SQL + UNITS_SQL + " select a.* from a semi join u using (document_id) where resolution_status in ('resolved_explicit', 'inferred_single_project')")
def extended_links(spark, d):
    return _view(spark, d, True)


ROLE_SQL = "case o_orderpriority when '1-URGENT' then 'focal' when '2-HIGH' then 'co_focal' when '3-MEDIUM' then 'contextual_mention' when '4-NOT SPECIFIED' then 'panoramic_mention' else 'mentioned_unreviewed' end"


@query(f"""
select document_id, conflict_id, role, seq from (
  select o_custkey as document_id, o_orderstatus as conflict_id, {ROLE_SQL} as role, o_orderkey as seq,
    row_number() over (partition by o_custkey, o_orderstatus order by o_orderpriority, o_orderkey) as r from orders) where r = 1""")
def role_best(spark, d):
    p = F.col("o_orderpriority")
    role = F.when(p == "1-URGENT", "focal").when(p == "2-HIGH", "co_focal").when(p == "3-MEDIUM", "contextual_mention").when(p == "4-NOT SPECIFIED", "panoramic_mention").otherwise("mentioned_unreviewed")
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("conflict_id"), role.alias("role"), F.col("o_orderkey").alias("seq"))
    return conflict.best_role(rows, ["document_id", "conflict_id"], "role", "seq")


@query("""
with projects as (select n_regionkey as conflict_id, n_nationkey as project_id, n_name as name from nation),
chain as (select distinct p.conflict_id, p.project_id, o.o_orderkey, l.l_linenumber from projects p join customer c on c.c_nationkey = p.project_id
  join orders o on o.o_custkey = c.c_custkey and o.o_orderstatus = 'P' and o.o_totalprice > 400000 join lineitem l on l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R' and l.l_quantity >= 48),
hit as (select distinct conflict_id, project_id from chain)
select p.conflict_id, count(distinct p.project_id)::bigint as n_projects, count(distinct h.project_id)::bigint as n_backed,
  min_by(p.name, case when h.project_id is null then '1' else '0' end || p.name) as label,
  case when count(distinct h.project_id) = 0 then 'ninguna' when count(distinct h.project_id) = count(distinct p.project_id) then 'total' else 'parcial' end as coverage
from projects p left join hit h using (conflict_id, project_id) group by p.conflict_id""")
def backing_chain(spark, d):
    projects = t(spark, d, "nation").select(F.col("n_regionkey").alias("conflict_id"), F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    orders = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mentions = orders.select(F.col("c_nationkey").alias("project_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("case_mention_id"))
    decided = t(spark, d, "orders").select(F.col("o_orderkey").alias("case_mention_id"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000), "include").otherwise("exclude").alias("decision"))
    quotes = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_mention_id"), F.col("l_linenumber").alias("evidence_id"), F.lit("objeto").alias("quote_role"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 48)).cast("int").alias("verified"))
    backed = conflict.backing(projects.select("conflict_id", "project_id"), mentions, decided.where("decision = 'include'"), quotes)
    return conflict.coverage(projects, backed)


@query("""
with r as (select distinct c_mktsegment || c_custkey % 7 as actor, n_nationkey as case_id, n_regionkey as conflict_id from customer join nation on n_nationkey = c_nationkey)
select actor, count(distinct case_id)::bigint as d_case, count(distinct conflict_id)::bigint as d_conflict, (count(distinct conflict_id) - count(distinct case_id))::bigint as delta_collapse from r group by actor""")
def conflict_collapse(spark, d):
    cases = t(spark, d, "nation").select(F.col("n_nationkey").alias("case_id"), F.col("n_regionkey").alias("conflict_id"))
    rows = t(spark, d, "customer").select(F.concat("c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("actor"), F.col("c_nationkey").alias("case_id")).join(cases, "case_id")
    case, whole = (network.place_degrees(rows, "actor", c) for c in ("case_id", "conflict_id"))
    deltas = network.decomposition(case, case, whole)
    return deltas.join(case.withColumnRenamed("degree", "d_case"), "actor").join(whole.withColumnRenamed("degree", "d_conflict"), "actor").select("actor", "d_case", "d_conflict", "delta_collapse")


@query("select l_partkey, min(case when l_quantity >= 48 then s_nationkey end)::int as nation from lineitem join supplier on s_suppkey = l_suppkey group by 1 having count(distinct case when l_quantity >= 48 then s_nationkey end) = 1")
def single_region_parts(spark, d):
    """Lines are mentions, of which those of large quantities have a code."""
    rows = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", F.when(F.col("l_quantity") >= 48, F.col("s_nationkey")).alias("code"))
    return geo.single_value(rows, "l_partkey", "code", "nation")


@query("""
with x as (select s_suppkey, s_suppkey % 9 as k, s_nationkey as n from supplier),
y as (select *, case when n % 5 = 4 then false else true end as located from x)
-- places: Villa de NATION_i for each i; for i in 0..4 a namesake in another area; those with i % 5 = 4 without coordinates
select s_suppkey, n::int as place_id,
  case k when 0 then 0 when 1 then 0 when 2 then 3 when 3 then 3 when 4 then 1 when 5 then 0 when 7 then 0 end::int as position,
  case k when 0 then 'literal' when 1 then 'literal_de_variant' when 2 then 'fragment' when 3 then 'fragment' when 4 then 'fragment' when 5 then 'literal' when 7 then 'literal' end as method,
  (case when n < 5 then 2 else 1 end)::bigint as n_before, 'neighborhood' as precision
from y where located and (k = 5 or (n >= 5 and k in (0, 1, 2, 3, 4, 7)))""")
def gazetteer_lookup(spark, d):
    n, k = F.col("s_nationkey"), F.col("s_suppkey") % 9
    name = F.concat(F.lit("Villa de Nation_"), n.cast("string"))
    text = (
        F.when(k == 0, F.concat(F.lit("  VILLA DE  nation_"), n.cast("string"))).when(k == 1, F.concat(F.lit("villa nation_"), n.cast("string"))).when(k == 2, F.concat(F.lit("Sector de "), name, F.lit(", algo")))
        .when(k == 3, F.concat(F.lit("algo en  nada y "), name)).when(k == 4, F.concat(F.lit("barrio  de "), name)).when(k == 5, name).when(k == 6, F.concat(F.lit("cerca de "), name)).when(k == 7, name).otherwise("villa")
    )
    # k = 5 knows the area; k = 7 has a blank one, which is none; k = 8 has nothing to find
    area = F.when(k == 5, F.concat(F.lit(" ÁREA "), n.cast("string"))).when(k == 7, " ")
    texts = t(spark, d, "supplier").select("s_suppkey", text.alias("text"), area.alias("area"))
    i = F.col("n_nationkey")
    where = F.when(i % 5 != 4, "1.5")
    places = t(spark, d, "nation").select(i.alias("place_id"), F.concat(F.lit("Villa de "), "n_name").alias("name"), F.concat(F.lit("area "), i.cast("string")).alias("area"), where.alias("lat"), where.alias("lon"), F.lit("Villa").alias("place_type"))
    twins = places.where("place_id < 5").withColumns({"place_id": F.col("place_id") + 100, "area": F.lit("elsewhere"), "lat": F.lit("2"), "lon": F.lit("2")})
    return geo.gazetteer(texts, places.unionByName(twins), "s_suppkey").select("s_suppkey", "place_id", "position", "method", "n_before", "precision")


@query("""
select c_custkey as mention_id, case when c_custkey % 4 = 2 then c_nationkey + 100 when c_custkey % 4 = 3 and c_nationkey = 7 then 107 else c_nationkey + 100 end::int as code
from customer where c_custkey % 4 = 2 or (c_custkey % 4 = 3 and c_nationkey = 7)""")
def compound_split(spark, d):
    n, k = F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")), F.col("c_custkey") % 4
    text = F.when(k == 2, F.concat(n, F.lit(" / elsewhere"))).when(k == 3, F.concat(n, F.lit(" y NATION_7"))).otherwise("nowhere; far")
    mentions = t(spark, d, "customer").select(F.col("c_custkey").alias("mention_id"), F.lit(None).cast("int").alias("code"), text.alias("comuna"))
    areas = t(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).alias("code"))
    return geo.backfill_compound(mentions, areas)


@query("""
with m as (select s_suppkey, case when s_suppkey % 11 = 0 then null else s_suppkey end as cm, case when s_suppkey % 5 = 0 then null else s_nationkey end as code, s_suppkey % 7 = 0 as g, case when s_suppkey % 14 = 0 then 99 end as rv, s_acctbal > 1000 as inc from supplier),
x as (select *, case when cm is null then 'no_case_mention_index' when inc and code is not null then 'direct' when g and rv is null then 'ambiguous_duplicate_group' when rv is not null then 'via_reviewed_duplicate_group'
  when not inc then 'case_mention_no_incluido' else 'case_mention_sin_comuna' end as geo_status from m)
select s_suppkey, geo_status, case geo_status when 'direct' then code when 'via_reviewed_duplicate_group' then rv end::int as geo_code from x""")
def mention_geo_cascade(spark, d):
    k = F.col("s_suppkey")
    m = t(spark, d, "supplier").select("s_suppkey", F.when(k % 11 != 0, k).alias("case_mention_id"), F.when(k % 5 != 0, F.col("s_nationkey")).alias("code"), (k % 7 == 0).alias("in_group"), F.when(k % 14 == 0, 99).alias("reviewed_code"), (F.col("s_acctbal") > 1000).alias("included"))
    return geo.mention_geography(m).select("s_suppkey", "geo_status", "geo_code")


@query("""
with p as (select c_nationkey, count(*) as pop from customer where c_nationkey <> 5 group by 1), f as (select s_nationkey, count(distinct s_suppkey) as n from supplier group by 1)
select n_nationkey, coalesce(p.pop, 0)::bigint as population, coalesce(f.n, 0)::bigint as suppliers, round_even(coalesce(f.n, 0)::double / nullif(coalesce(p.pop, 0), 0) * 1e5, 2) as suppliers_rate
from nation left join p on p.c_nationkey = n_nationkey left join f on f.s_nationkey = n_nationkey""")
def territory_rollup(spark, d):
    pop = t(spark, d, "customer").where("c_nationkey <> 5").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("population"))
    areas = t(spark, d, "nation").select("n_nationkey").join(pop, "n_nationkey", "left").withColumn("population", F.coalesce("population", F.lit(0)).cast("long"))
    facts = t(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return present.territory(areas, facts, "n_nationkey", {"suppliers": "s_suppkey"}, "population")


@query("select event_id, strftime(ts, '%Y-%m-%d') as fecha, event_type from events where event_type <> 'error' order by fecha, event_id limit 500")
def timeline_top500(spark, d):
    e = t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("fecha"), "event_type", (F.col("event_type") != "error").cast("int").alias("fecha_year_grounded"))
    return present.timeline(e).drop("fecha_year_grounded")


@query("""
with l as (select source, doc_id, unnest(string_split(text, chr(10))) as quote, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
q as (select source, quote, min((doc_id, pos)) as spot from l group by 1, 2)
select source, spot[1] as doc_id, quote, rn::int as rn from (select *, row_number() over (partition by source order by spot) as rn from q) where rn <= 3""")
def topk_quotes_per_group(spark, d):
    lines = t(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "quote"))
    return present.first_rows(lines, ["source"], ["doc_id", "pos"], 3, "quote").select("source", "doc_id", "quote", "rn")


COOC_SQL = """with r as (select distinct user_id as actor, strftime(ts, '%Y-%m-%d %H') as place from events),
e as (select x.actor as a, y.actor as b, count(*)::bigint as weight from r x join r y on x.place = y.place and x.actor < y.actor group by 1, 2)"""


def _appearances(spark, d):
    return t(spark, d, "events").select(F.col("user_id").alias("actor"), F.date_format("ts", "yyyy-MM-dd HH").alias("place"))


def _cooccurrence(spark, d):
    return network.projection(_appearances(spark, d), "actor", "place")


@query(COOC_SQL + " select a, b, weight from e")
def cooccurrence(spark, d):
    return _cooccurrence(spark, d)


@query("""
with b as (select user_id as actor, event_type as case_id, count(distinct strftime(ts, '%Y-%m-%d')) as weight from events group by 1, 2),
g as (select case_id, count(*) as deg from b group by 1), w as (select case_id, list(weight order by weight) as v, len(list(weight)) as n from b group by case_id),
j as (select *, least(greatest(floor((n + 1) * 9 / 10), 1), n - 1)::int as j from w), z as (select *, (n + 1) * 9 - j * 10 as delta from j)
select z.case_id, g.deg::bigint as n_actors, median(b.weight)::double as median_weight, any_value(case when n >= 10 then (v[j] * (10 - delta) + v[j + 1] * delta) / 10.0 else v[n] end)::double as p90_weight
from z join g using (case_id) join b using (case_id) group by z.case_id, g.deg""")
def bipartite_degree(spark, d):
    b = network.bipartite(t(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "user_id", "event_type", "day")
    v = F.array_sort(F.collect_list("weight"))
    return b.groupBy(F.col("event_type").alias("case_id")).agg(F.count(F.lit(1)).alias("n_actors"), F.median("weight").alias("median_weight"), network.exclusive_p90(v).cast("double").alias("p90_weight"))


@query(COOC_SQL.replace("with r", "with recursive r") + """, f as (select a, b from e where weight >= 12), s as (select a, b from f union select b, a from f), nodes as (select distinct actor as node from r),
walk(node, reach) as (select node, node from nodes union select walk.node, s.b from walk join s on s.a = walk.reach),
c as (select component, count(*) as size from (select node, min(reach) as component from walk group by node) group by 1)
select sum(size)::bigint as n, (select count(*) from f)::bigint as m, coalesce(round_even((select count(*) from f) / nullif(sum(size) * (sum(size) - 1) / 2, 0), 5), 0.0)::double as density, count(*)::bigint as components, max(size)::bigint as largest,
  round_even(max(size) * 100.0 / sum(size), 1)::double as share from c""")
def projection_summary(spark, d):
    nodes = _appearances(spark, d).select(F.col("actor").alias("node")).distinct()
    return network.projection_summary(materialize(network.linked(_appearances(spark, d), "actor", "place", 12)), nodes)


@query("""
with g as (select user_id, count(*) filter (where event_type = 'click') as x, count(*) filter (where event_type = 'view') as y from events group by 1),
r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from g)
select count(*)::bigint as n, round(corr(rx, ry), 9) as rho from r""")
def spearman_rank(spark, d):
    g = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("x"), F.count_if(F.col("event_type") == "view").alias("y"))
    return network.spearman(g, "x", "y").withColumn("rho", F.round("rho", 9))


@query("""
with r as (select p_partkey, case when p_brand in ('Brand#1', 'Brand#2', 'Brand#3') then 'entity:1' when p_brand in ('Brand#4', 'Brand#5') then lower(p_brand) || '::' || p_type else lower(p_brand) end as node, p_type from part)
select node, count(*)::bigint as n, count(distinct p_type)::bigint as degree from r group by node""")
def actor_alias_resolution(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_brand"), F.lit("\t"))).otherwise(F.col("p_brand"))
    parts = t(spark, d, "part").select("p_partkey", name.alias("actor"), F.col("p_type").alias("case_id"))
    aliases = spark.createDataFrame([(f"Brand#{i}", "entity:1", "One") for i in (1, 2, 3)], "name string, entity_id string, label string")
    rows = network.resolve_actors(parts, aliases, generic=("brand#4", "brand#5"))
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("case_id").alias("degree"))


@query("""
with a as (select user_id from events where event_type = 'click' group by 1 order by count(*) desc, user_id limit 15), b as (select user_id from events where event_type = 'purchase' group by 1 order by count(*) desc, user_id limit 15)
select user_id, 'both' as side from a intersect select user_id, 'both' from b union all (select user_id, 'left' from a where user_id not in (select user_id from b)) union all (select user_id, 'right' from b where user_id not in (select user_id from a))""")
def set_overlap_top15(spark, d):
    labels = t(spark, d, "events").select(F.col("user_id").alias("actor"), F.col("user_id").alias("label")).distinct()

    def top(kind):
        own = t(spark, d, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("actor")).agg(F.count(F.lit(1)).alias("degree"))
        return network.top_degrees(own, labels, 15)

    return network.overlap(top("click"), top("purchase"), "actor").withColumnRenamed("actor", "user_id")


@query("select doc_id, source from documents order by sha256('20260924|' || doc_id), doc_id limit 100")
def holdout_sample(spark, d):
    return audit.hash_sample(t(spark, d, "documents").select("doc_id", "source"), "doc_id", "20260924", 100)


@query("""select u.user_id, u.event_type from (select distinct a.user_id, b.event_type from (select distinct user_id from events) a, (select distinct event_type from events) b) u
where not exists (select 1 from events e where e.user_id = u.user_id and e.event_type = u.event_type and e.value > 120)""")
def resume_pending(spark, d):
    e = t(spark, d, "events")
    plan = e.select("user_id").distinct().crossJoin(F.broadcast(e.select("event_type").distinct()))
    return ingest.pending(plan, e.where("value > 120"), ["user_id", "event_type"])


@query("select r_name, event_type, period, sha256(r_name || '|' || event_type || '|' || period) as query_hash from region, (select distinct event_type from events), (select unnest(['p1', 'p2', 'p3', 'p4']) as period)")
def query_plan(spark, d):
    periods = spark.createDataFrame([(f"p{i}",) for i in range(1, 5)], "period string")
    return ingest.work_plan(t(spark, d, "region").select("r_name"), t(spark, d, "events").select("event_type").distinct(), periods)


TURNS_SQL = """with x as (select conv_id::varchar as document_id, (row_number() over (partition by conv_id order by turn) - 1)::int as idx, role, text from conversations)"""


def _records(spark, d):
    """Conversations as nested records: turns are actors, the user's of which have a verified quote."""
    turns = t(spark, d, "conversations")
    none = F.lit(None).cast("string")
    user = F.col("role") == "user"
    one = F.struct("turn", F.col("role").alias("nombre"), F.lit("x").alias("tipo"), F.upper("role").alias("rol"), none.alias("stance"), F.when(user, F.col("text")).alias("cita"), F.when(~user, F.col("text")).alias("cita_original_modelo"), user.alias("cita_verificada"))
    return turns.groupBy(F.col("conv_id").cast("string").alias("document_id")).agg(F.array_sort(F.collect_list(one)).alias("actores"))


@query(TURNS_SQL + """ select document_id || ':actor:' || idx as actor_id, document_id, idx, role as nombre, upper(role) as rol, '' as stance, md5(case when role = 'user' then text else '' end) as quote,
  md5(case when role = 'user' then '' else text end) as quote_original, (role = 'user')::int as verified, case when role = 'user' and text <> '' then document_id || ':enrichment:actor:' || idx end as evidence_id from x""")
def nested_flatten(spark, d):
    rows = nested.items(_records(spark, d), "actores")
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return rows.select("actor_id", "document_id", "idx", "nombre", "rol", "stance", md5("quote").alias("quote"), md5("quote_original").alias("quote_original"), "verified", "evidence_id")


@query("""select doc_id, (1990 + doc_id % 40)::varchar || '-01' as date, list_contains(regexp_extract_all(text, '\\b(\\d{4})\\b', 1), (1990 + doc_id % 40)::varchar) as grounded from documents""")
def year_grounding(spark, d):
    docs = t(spark, d, "documents").withColumn("date", F.concat((F.lit(1990) + F.col("doc_id") % 40).cast("string"), F.lit("-01")))
    return docs.select("doc_id", "date", evidence.year_grounded(F.col("date"), F.col("text")).alias("grounded"))


@query("""
with n as (select source, doc_id, n_chars, (row_number() over (partition by source order by doc_id) - 1) // 4 as wave from documents),
w as (select source, wave, sum(n_chars) as c from n group by 1, 2), b as (select source, wave, coalesce(sum(c) over (partition by source order by wave rows between unbounded preceding and 1 preceding), 0) as spent_before from w)
select source, doc_id, wave::bigint as wave, spent_before::bigint as spent_before from n join b using (source, wave) where spent_before < 60000""")
def budget_waves(spark, d):
    rows = t(spark, d, "documents").select("source", "doc_id", "n_chars")
    return audit.budget_waves(rows, "doc_id", "n_chars", 4, 60000, "source").select("source", "doc_id", F.col("wave").cast("long").alias("wave"), "spent_before")


@query("""
select 'orders.customer' as name, count(*)::bigint as violations from orders where o_custkey not in (select c_custkey from customer)
union all select 'lineitem.supplier', count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0)
union all select 'labels.document', count(*) from labels where doc_id not in (select doc_id from documents)""")
def fk_violations(spark, d):
    return audit.foreign_keys([
        ("orders.customer", t(spark, d, "orders"), "o_custkey", t(spark, d, "customer"), "c_custkey"),
        ("lineitem.supplier", t(spark, d, "lineitem"), "l_suppkey", t(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey"),
        ("labels.document", t(spark, d, "labels"), "doc_id", t(spark, d, "documents"), "doc_id"),
    ])


@query("""
select 'lineitem' as name, count(*)::bigint as duplicates from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'documents', count(*) from (select 1 from documents group by doc_id having count(*) > 1)
union all select 'part.name', count(*) from (select 1 from part group by p_name having count(*) > 1)""")
def pk_duplicates(spark, d):
    return audit.primary_keys([("lineitem", t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]), ("documents", t(spark, d, "documents"), ["doc_id"]), ("part.name", t(spark, d, "part"), ["p_name"])])


@query("""
with r as (select sha256(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus) as h from orders), p as (select h, unnest(range(8)) as i from r),
z as (select i, sum(('0x' || substr(h, (8 * i + 1)::int, 8))::bigint) % 4294967296 as v from p group by i)
select (select count(*) from r)::bigint as n, string_agg(format('{:08x}', v::bigint), '' order by i) as fingerprint from z""")
def table_fingerprint(spark, d):
    return audit.fingerprint(t(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("""
with p as (select page_id, case when page_id % 3 = 0 then 'https://www.x.com/' || page_id when page_id % 3 = 1 then 'https://mobile.twitter.com/s' else url end as url,
  case when page_id % 7 = 0 then ' ' when page_id % 5 = 0 then 'Post Iniciar sesion registrate ahora' when page_id % 2 = 0 then 'A whole sentence.' else 'Cut in the mid' end as text, page_id % 3 < 2 as social from pages)
select page_id, case when not social then '' when trim(text) = '' then 'sin_texto' when contains(lower(text), 'post iniciar sesion registrate') then 'muro_login_capturado_en_vez_del_tuit'
  when right(trim(text), 1) not in ('.', '!', '?') then 'texto_cortado_a_mitad_de_frase' else '' end as reason from p""")
def social_truncation(spark, d):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://www.x.com/"), k.cast("string"))).when(k % 3 == 1, "https://mobile.twitter.com/s").otherwise(F.col("url"))
    text = F.when(k % 7 == 0, " ").when(k % 5 == 0, "Post Iniciar sesión regístrate ahora").when(k % 2 == 0, "A whole sentence.").otherwise("Cut in the mid")
    return t(spark, d, "pages").select("page_id", evidence.social_truncation(url, text).alias("reason"))


DUPLICATES_SQL = """
with recursive m as (select p_brand as document_id, p_partkey as idx, case when p_size % 5 = 0 then 'ótipo ' || p_type else '' end as o, case when p_size % 3 = 0 then p_name || ' ' || p_size % 7 else p_name end as q, case when p_size > 40 then null when p_size > 20 then 'include' else 'exclude' end as decision from part),
e as (select x.idx as a, y.idx as b, x.o <> '' and x.o = y.o as same, length(x.q) >= 8 and length(y.q) >= 8 and (contains(x.q, y.q) or contains(y.q, x.q)) as within_
  from m x join m y on x.document_id = y.document_id and x.idx <> y.idx),
l as (select * from e where same or within_),
walk(node, reach) as (select idx, idx from m union select walk.node, l.b from walk join l on l.a = walk.reach),
c as (select node, min(reach) as component from walk group by node),
g as (select c.component, count(*) as group_size, count(distinct coalesce(m.decision, '-')) > 1 as mixed, coalesce(min(case when decision = 'include' then idx end), min(idx)) as canonical_idx, 'cmdup:' || substr(sha256(string_agg(document_id || ':' || idx, '|' order by document_id || ':' || idx)), 1, 24) as group_id
  from c join m on m.idx = c.node group by 1),
h as (select c.component, bool_or(same) as s, bool_or(within_) as w from l join c on c.node = l.a group by 1)
select m.document_id, m.idx, group_id, group_size::bigint as group_size, canonical_idx, case when s and w then 'ambos' when s then 'tipo_objeto_raw_exact' when w then 'quote_substring' else 'single' end as method, mixed
from m join c on c.node = m.idx join g using (component) left join h using (component)"""


@query(DUPLICATES_SQL)
def duplicate_mentions(spark, d):
    """Parts are mentions, brands documents; objects and quotes are written with accents and capitals on one side."""
    size, odd = F.col("p_size"), F.col("p_partkey") % 2 == 0
    quote = F.when(size % 3 == 0, F.concat("p_name", F.lit(" "), (size % 7).cast("string"))).otherwise(F.col("p_name"))
    rows = t(spark, d, "part").select(
        F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("idx"), F.when(size % 5 == 0, F.concat(F.when(odd, "Ótipo  ").otherwise("otipo "), "p_type")).otherwise(" ").alias("object_raw"),
        F.when(odd, F.upper(F.translate(quote, "aeo", "áéó"))).otherwise(quote).alias("quote"), F.when(size > 40, None).when(size > 20, "include").otherwise("exclude").alias("decision"),
    )
    return conflict.duplicate_groups(rows)


@query("""
with a as (select distinct o_custkey as document_id, o_orderkey % 9 as conflict_id, case when o_orderstatus = 'P' then 'pending' else 'confirmed' end as status from orders),
s as (select document_id, conflict_id, max(status) as status from a group by 1, 2)
select x.conflict_id as conflict_a, y.conflict_id as conflict_b, case when bool_or(x.status = 'pending') then 'pending' else 'confirmed' end as status, count(distinct x.document_id)::int as n_documents
from s x join s y on x.document_id = y.document_id and x.conflict_id < y.conflict_id group by 1, 2""")
def distinct_conflict_relations(spark, d):
    rows = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 9).alias("conflict_id")).agg(F.max(F.when(F.col("o_orderstatus") == "P", "pending").otherwise("confirmed")).alias("status"))
    return conflict.distinct_relations(rows).select("conflict_a", "conflict_b", "status", F.size("documents").alias("n_documents"))


@query("""
select url_hash, doc_id, source from (select sha256(text) as url_hash, doc_id, source, row_number() over (partition by sha256(text) order by doc_id desc) as r from documents) where r = 1""")
def latest_record(spark, d):
    rows = t(spark, d, "documents").select(F.sha2("text", 256).alias("url_hash"), "doc_id", "source")
    return ingest.latest(rows, "url_hash", "doc_id")


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*)::bigint as n from events group by 1, 2")
def windowed_events(spark, d):
    return resume.windowed(t(spark, d, "events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""
with o as (select o_custkey as actor, o_orderstatus, o_orderpriority, n_nationkey as case_id, n_regionkey as conflict_id from orders join customer on c_custkey = o_custkey join nation on n_nationkey = (c_nationkey + o_orderkey) % 25),
raw as (select actor, count(distinct case_id) as d from o group by 1), g as (select actor, count(distinct case_id) as d from o where o_orderstatus = 'F' group by 1), c as (select actor, count(distinct conflict_id) as d from o where o_orderstatus = 'F' group by 1)
select actor, (g.d - raw.d)::bigint as delta_gate, (c.d - g.d)::bigint as delta_collapse, (c.d - raw.d)::bigint as delta_total from raw join g using (actor) join c using (actor)""")
def gate_decomposition(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("n_nationkey", ((F.col("c_nationkey") + F.col("o_orderkey")) % 25).cast("int")).join(F.broadcast(t(spark, d, "nation")), "n_nationkey")
    deg = lambda rows, c: rows.groupBy(F.col("o_custkey").alias("actor")).agg(F.countDistinct(c).alias("degree"))
    gated = o.where("o_orderstatus = 'F'")
    return network.decomposition(deg(o, "n_nationkey"), deg(gated, "n_nationkey"), deg(gated, "n_regionkey"))


@query("""
with v as (select p_brand || '/' || p_size as node, case p_type when 'PROMO' then 1 when 'SMALL' then 0 end as vote from part)
select node, case when count(vote) = 0 then null else count(*) filter (where vote = 1) >= count(*) filter (where vote = 0) end as es_institucional from v group by 1""")
def tri_state_votes(spark, d):
    votes = t(spark, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("node"), F.when(F.col("p_type") == "PROMO", 1).when(F.col("p_type") == "SMALL", 0).alias("vote"))
    return votes.groupBy("node").agg(network.tri_state().alias("es_institucional"))


@query("""
with r as (select o_custkey as document_id, o_orderkey as relation_index, ['mismo_conflicto', 'conflictos_distintos', 'focal', 'contextual', 'mismo_proyecto', 'odd'][o_orderkey % 6 + 1] as relation, [o_custkey % 40, o_orderkey % 41] as ids from orders),
i as (select document_id, relation_index, relation, unnest(ids) as id from r where relation <> 'odd'),
g as (select *, case when id between 30 and 34 then id - 20 else id end as now from i),
x as (select document_id, relation_index, relation, id as historical_case_id, case when relation in ('focal', 'contextual') then 'document_conflict_membership' when relation = 'mismo_proyecto' then 'project_identity_not_resolved'
  when id in (35, 36) then 'confirmed_non_resolvable_historical_reference' else 'conflict_topology' end as impact_scope from g where now not in (select n_nationkey from nation)
  union all select document_id, relation_index, relation, ids[1], 'unknown_relation_fail_closed' from r where relation = 'odd')
select *, impact_scope in ('conflict_topology', 'unknown_relation_fail_closed') as blocking from x""")
def historical_references(spark, d):
    kinds = F.array(*map(F.lit, ("mismo_conflicto", "conflictos_distintos", "focal", "contextual", "mismo_proyecto", "odd")))
    relations = t(spark, d, "orders").select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("relation_index"), kinds[(F.col("o_orderkey") % 6).cast("int")].alias("relation"), F.array(F.col("o_custkey") % 40, F.col("o_orderkey") % 41).alias("case_ids")
    )
    ids = spark.range(41).select(F.col("id").alias("old"))
    aliases = ids.where("old between 30 and 34").withColumn("new", F.col("old") - 20)
    return layers.historical_references(relations, t(spark, d, "nation").select(F.col("n_nationkey").alias("case_id")), aliases, ids.where("old in (35, 36)").withColumnRenamed("old", "case_id"))


@query("""
with k as (select unnest(range(10)) as k), p as (select n_nationkey as id, n_name as name from nation),
g as (select id, name, 'phase:' || substr(sha256((case when id >= 20 then id - 10 else id end)::varchar), 1, 24) as phase_id, id >= 20 or id < 14 as twin from p where id between 10 and 23)
select id::bigint as project_id, phase_id, case when twin then 'same_phase_alias' else 'represents_phase' end as relation_type, name as evidence from g
union all select (k % 5)::bigint, g.phase_id, 'has_phase', m.name || ' -> ' || g.name from k join p m on m.id = k % 5 join g on g.id = 10 + k""")
def phase_links(spark, d):
    """Nations are projects: reviewers made ten of them phases of the first five, and four of the last ones other names of phases."""
    projects = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("case_id"))
    named = lambda id_, name: projects.select(F.col("project_id").alias(id_), F.col("name").alias(name))
    phases = named("id", "phase").where("id between 10 and 19").withColumn("of", F.col("id") % 5)
    parts = phases.join(named("of", "matrix"), "of").select("matrix", "phase")
    same = named("id", "a").where("id between 10 and 13").withColumn("twin", F.col("id") + 10).join(named("twin", "b"), "twin").select("a", "b")
    return layers.phase_layer(projects, parts, same)[1]


@query("""
with r as (select 's' || s_nationkey as s, ['phase', 'replaces', 'odd'][s_suppkey % 3 + 1] as k, 's' || (s_suppkey % 30) as o, case when s_suppkey % 4 = 0 then 'http://x' when s_suppkey % 11 = 0 then ' ' else 'https://x' end as url, s_suppkey % 7 = 0 as long, s_suppkey % 5 = 0 as loose from supplier),
n as (select s, k, o, count(*) as n from r group by all)
select s as subject_project_id, k as relation_type, o as object_project_id, array_to_string(errors, ',') as errors from (
  select s, k, o, list_filter([case when s = o then 'self' end, case when n > 1 then 'repeated' end, case when k = 'odd' then 'unknown_type' end, case when substr(o, 2)::int > 24 then 'unknown_project' end,
    case when url = ' ' then 'no_evidence_url' end, case when url = 'http://x' then 'not_https' end, case when long then 'long_quote' end, case when loose then 'not_verified' end], lambda x: x is not null) as errors from r join n using (s, k, o))
where len(errors) > 0""")
def relation_errors(spark, d):
    k = F.col("s_suppkey")
    kinds = F.array(*map(F.lit, ("phase", "replaces", "odd")))
    rows = t(spark, d, "supplier").select(
        F.concat(F.lit("s"), "s_nationkey").alias("subject_project_id"), kinds[(k % 3).cast("int")].alias("relation_type"), F.concat(F.lit("s"), (k % 30).cast("string")).alias("object_project_id"),
        F.when(k % 4 == 0, "http://x").when(k % 11 == 0, " ").otherwise("https://x").alias("evidence_url"), F.lit("title").alias("source_title"), F.lit("p. 1").alias("source_locator"),
        F.when(k % 7 == 0, F.repeat(F.lit("word "), F.lit(26))).otherwise("a few words").alias("evidence_quote"), F.lit("2026-01-01").alias("source_accessed_at"), F.lit(None).cast("string").alias("source_sha256"),
        F.when(k % 5 == 0, "open").otherwise("source_verified").alias("verification_status"),
    )
    types = spark.createDataFrame([("phase",), ("replaces",)], "relation_type string")
    found = layers.relation_errors(rows, types, t(spark, d, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("project_id")))
    return found.withColumn("errors", F.array_join("errors", ","))


@query("""
select p_partkey as pair_id, case when p_partkey % 6 = 0 then 'same_identity' when p_partkey % 9 = 3 then 'distinct_entities' when p_partkey % 3 = 0 then 'unresolved' else 'distinct_entities' end as identity_class,
  case when p_partkey % 6 = 0 or p_partkey % 9 = 3 then 'high' else 'low' end as confidence, case when p_partkey % 6 = 0 or p_partkey % 9 = 3 then 'seen' else 'base' end as rationale, p_partkey % 6 = 0 or p_partkey % 9 = 3 as overridden from part""")
def adjudication_overrides(spark, d):
    k = F.col("pair_id")
    base = t(spark, d, "part").select(F.col("p_partkey").alias("pair_id"), F.when(F.col("p_partkey") % 3 == 0, "unresolved").otherwise("distinct_entities").alias("identity_class"), F.lit("low").alias("confidence"), F.lit("base").alias("rationale"))
    over = base.where((k % 6 == 0) | (k % 9 == 3)).select("pair_id", F.when(k % 6 == 0, "same_identity").otherwise("distinct_entities").alias("identity_class"), F.lit("high").alias("confidence"), F.lit("seen").alias("rationale"))
    return layers.effective_adjudications(base, over)


@query("""
with x as (select doc_id as pair_id, list_filter([case when doc_id % 3 = 0 then 'other_text' end, case when doc_id % 5 = 0 then 'other_url' end, case when doc_id % 7 = 0 then 'not_literal' end], lambda e: e is not null) as errors, doc_id as document_id from documents)
select pair_id, 'a' as side, document_id, array_to_string(errors, ',') as errors from x where len(errors) > 0""")
def adjudication_errors(spark, d):
    docs, k = t(spark, d, "documents"), F.col("doc_id")
    anchors = docs.select(
        k.alias("pair_id"), F.lit("a").alias("side"), k.alias("document_id"), F.when(k % 5 == 0, "elsewhere").otherwise(F.col("source")).alias("url"), F.sha2(F.when(k % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_sha256"),
        F.when(k % 7 == 0, F.lit("never \x01 in the text")).otherwise(F.left("text", F.lit(20))).alias("quote"),
    )
    found = layers.adjudication_errors(anchors, docs.select(k.alias("document_id"), F.col("source").alias("url"), "text"))
    return found.withColumn("errors", F.array_join("errors", ","))


@query("""
select p_partkey, 12 as start, (12 + length(p_name))::int as "end", upper(p_name) as fragment, 'normalized_full_mention' as method from part""")
def literal_fragment(spark, d):
    parts = t(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit("El proyecto "), F.upper("p_name"), F.lit(", hoy")).alias("text"))
    return parts.select("p_partkey", fragment(F.col("text"), F.col("p_name"), F.lit("hoy")).alias("x")).select("p_partkey", "x.start", "x.end", "x.fragment", "x.method")


@query("""
with x as (select c_custkey as project_id, c_nationkey as before, case when c_custkey % 10 = 0 then null when c_nationkey in (3, 4) then 3 else c_nationkey end as after from customer where c_custkey % 17 > 0
  union all select c_custkey, null, c_nationkey from customer where c_custkey % 17 = 0)
select project_id, before, after, case when before is null then 'added' when after is null then 'removed' else 'moved' end as change from x where before is distinct from after""")
def resolution_diff(spark, d):
    c, k, n = t(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    before = c.where(k % 17 > 0).select(k.alias("project_id"), n.alias("case_id"))
    after = c.where((k % 10 > 0) | (k % 17 == 0)).select(k.alias("project_id"), F.when(n.isin(3, 4) & (k % 17 > 0), F.lit(3)).otherwise(n).alias("case_id"))
    return layers.resolution_diff(before, after)
