"""Further queries of the evidence-graph operators over the driver's tables, each with the SQL it equals: networks, conflicts, reviews.

The tables take roles: events are links that name actors, nations projects or cases, regions conflicts, customers documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import audit, conflict, geo, network, present, resolve
from quillgraph.plans.queries import LINKS_SQL, _appearances, _links, query, t

K = "cast(json_extract_string(props, '$.k') as int)"
SOURCES = ("enrichment_actor", "enrichment_institution", "enrichment_event", "actor_second_pass_v2")

# links: a name is generic, blank, or one of thirty in several spellings
ACTORS_SQL = f"""
with l as (select event_id, user_id as document_id, {K} as k from events),
n as (select *, ['enrichment_actor', 'enrichment_institution', 'enrichment_event', 'actor_second_pass_v2'][k % 4 + 1] as source_table,
  case when k % 10 = 0 then '  Los   VECINOS ' when k % 10 = 1 then ' ' when k % 2 = 0 then 'Actor ' || document_id % 30 else ' ACTOR  ' || document_id % 30 end as nombre, k % 25 as project_id, k % 40 as source_id from l),
r as (select document_id, nombre, n_regionkey as case_id, source_table, event_id,
  case when source_table = 'enrichment_institution' then 1 when source_table = 'enrichment_actor' and c_mktsegment = 'BUILDING' then 1 when source_table = 'enrichment_actor' then 0 end as es_institucional
  from n join nation on n_nationkey = project_id left join customer on source_table = 'enrichment_actor' and c_custkey = source_id where source_table <> 'enrichment_event'),
a as (select *, trim(regexp_replace(lower(nombre), '\\s+', ' ', 'g')) as actor_norm from r where trim(nombre) <> ''),
x as (select *, case when actor_norm = 'los vecinos' then actor_norm || '::' || case_id else actor_norm end as actor from a)
"""


def _actor_links(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    who = (F.col("user_id") % 30).cast("string")
    name = F.when(k % 10 == 0, "  Los   VECINOS ").when(k % 10 == 1, " ").when(k % 2 == 0, F.concat(F.lit("Actor "), who)).otherwise(F.concat(F.lit(" ACTOR  "), who))
    table = F.array(*map(F.lit, SOURCES))[k % 4]
    return t(spark, d, "events").select("event_id", F.col("user_id").alias("document_id"), name.alias("nombre"), table.alias("source_table"), (k % 40).alias("source_id"), (k % 25).alias("project_id"))


def _actor_rows(spark, d):
    places = t(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_regionkey").alias("case_id"))
    actors = t(spark, d, "customer").select(F.col("c_custkey").alias("actor_id"), F.when(F.col("c_mktsegment") == "BUILDING", "municipio").otherwise("empresa").alias("tipo"))
    return network.annotate(network.load_rows(_actor_links(spark, d), places, actors, "case_id"), "case_id")


@query(ACTORS_SQL + "select actor, case_id, source_table, es_institucional::int as es_institucional, count(*)::bigint as n, count(distinct document_id)::bigint as n_documents from x group by all")
def network_rows(spark, d):
    rows = _actor_rows(spark, d)
    return rows.groupBy("actor", "case_id", "source_table", "es_institucional").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("n_documents"))


@query(ACTORS_SQL + """, l2 as (select actor, trim(nombre) as name, row_number() over (partition by actor order by count(*) desc, trim(nombre)) as r from x group by 1, 2)
select x.actor, any_value(l2.name) as label, case when count(es_institucional) = 0 then null else count(*) filter (where es_institucional = 1) >= count(*) filter (where es_institucional = 0) end as es_institucional
from x join l2 on l2.actor = x.actor and l2.r = 1 group by x.actor""")
def network_nodes(spark, d):
    return network.nodes(_actor_rows(spark, d))


ENTITIES = [("uno", "Uno S.A.", ["Actor 1", " actor   2", "ACTOR 99"]), ("dos", "Dos", ["actor 3"])]
ENTITY_SQL = ACTORS_SQL + """, k as (select 'entity:' || substr(sha256('actor|uno'), 1, 24) as uno, 'entity:' || substr(sha256('actor|dos'), 1, 24) as dos),
y as (select *, case when actor_norm in ('actor 1', 'actor 2') then uno when actor_norm = 'actor 3' then dos else actor end as node from x, k)
"""


def _registry(spark):
    return network.registry(spark.createDataFrame(ENTITIES, "entity_key string, canonical_label string, aliases array<string>"))


@query(ENTITY_SQL + """select node as actor, count(*)::bigint as n, count(distinct case_id)::bigint as degree, min(case when node like 'entity:%' then 1 else 0 end)::int as known,
  bool_and(node not like 'entity:%' or (es_institucional is not null or true)) as ok from y group by 1""")
def entity_substitution(spark, d):
    entities, aliases = _registry(spark)
    rows = network.substitute(_actor_rows(spark, d), entities, aliases)
    labels = [label for _, label, _ in ENTITIES]
    own = F.col("actor").startswith("entity:")
    return rows.groupBy("actor").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("case_id").alias("degree"), F.min(own.cast("int")).alias("known"), F.bool_and(~own | (F.col("nombre").isin(*labels) & (F.col("es_institucional") == 1))).alias("ok"))


@query(ENTITY_SQL + """, g as (select actor_norm, count(distinct case_id) as deg from x group by 1), e as (select node, count(distinct case_id) as deg from y where node like 'entity:%' group by 1)
select node as entity_id, case when node = (select uno from k) then 'Uno S.A.' else 'Dos' end as canonical_label, e.deg::bigint as degree, b.best::bigint as best_alias, (e.deg - b.best)::bigint as gain
from e join (select case when actor_norm = 'actor 3' then dos else uno end as node, max(deg) as best from g, k where actor_norm in ('actor 1', 'actor 2', 'actor 3') group by 1) b using (node)""")
def consolidation_gain(spark, d):
    entities, aliases = _registry(spark)
    rows = _actor_rows(spark, d)
    raw, whole = (network.place_degrees(r, "actor", "case_id") for r in (rows, network.substitute(rows, entities, aliases)))
    return network.consolidation(raw, whole, entities, aliases)


@query(ENTITY_SQL + """, g as (select actor, count(distinct case_id) as deg from x group by 1), h as (select node as actor, count(distinct case_id) as deg from y group by 1)
select (select count(*) from g)::bigint as n_raw, (select count(*) from h)::bigint as n_resolved, count(*)::bigint as n_untouched, count(*) filter (where g.deg = h.deg)::bigint as n_same_degree from g join h using (actor) where actor not like 'entity:%'""")
def network_comparison(spark, d):
    entities, aliases = _registry(spark)
    rows = _actor_rows(spark, d)
    raw, whole = (network.place_degrees(r, "actor", "case_id") for r in (rows, network.substitute(rows, entities, aliases)))
    return network.compare_networks(raw, whole, entities)


@query(ACTORS_SQL + """, e as (select 'uno' as entity_key, 'Uno S.A.' as canonical_label, ['actor 1', 'actor 2', 'actor 99'] as aliases union all select 'dos', 'Dos', ['actor 3']),
m as (select e.*, n.* from e left join (select *, trim(regexp_replace(lower(nombre), '\\s+', ' ', 'g')) as norm from n) n on list_contains(e.aliases, n.norm))
select entity_key, canonical_label, count(*) filter (where source_table = 'enrichment_actor')::bigint as n_enrichment_actor, count(*) filter (where source_table = 'enrichment_institution')::bigint as n_enrichment_institution,
  count(*) filter (where source_table = 'actor_second_pass_v2')::bigint as n_actor_second_pass_v2, count(distinct document_id)::bigint as n_documents,
  count(distinct case when k % 3 = 0 then document_id end)::bigint as n_documents_safe, count(distinct case when k % 3 = 0 then project_id % 5 end)::bigint as n_conflicts_safe from m group by 1, 2""")
def entity_coverage(spark, d):
    entities, aliases = _registry(spark)
    links = _actor_links(spark, d)
    k = t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    safe = links.join(k, "event_id").where("k % 3 = 0").withColumn("conflict_id", F.col("project_id") % 5)
    return network.entity_coverage(links, safe, entities, aliases).drop("entity_id")


FALLS_SQL = """
with o as (select o_custkey as actor, o_orderstatus, n_nationkey as case_id, n_regionkey as conflict_id from orders join customer on c_custkey = o_custkey join nation on n_nationkey = (c_nationkey + o_orderkey) % 25),
raw as (select actor, count(distinct case_id) as d from o group by 1), g as (select actor, count(distinct case_id) as d from o where o_orderstatus = 'F' group by 1), c as (select actor, count(distinct conflict_id) as d from o where o_orderstatus = 'F' group by 1),
z as (select actor, (g.d - raw.d)::bigint as delta_gate, (c.d - g.d)::bigint as delta_collapse, (c.d - raw.d)::bigint as delta_total from raw join g using (actor) join c using (actor))
"""


def _falls(spark, d):
    from quillgraph.plans.queries import QUERIES

    return QUERIES["gate_decomposition"](spark, d)


@query(FALLS_SQL + """select count(*)::bigint as n, count_if(delta_total = 0)::bigint as unchanged, count_if(delta_gate < 0 and delta_collapse = 0)::bigint as gate_only, count_if(delta_gate = 0 and delta_collapse < 0)::bigint as collapse_only,
  count_if(delta_gate < 0 and delta_collapse < 0)::bigint as both from z""")
def fall_counts(spark, d):
    return network.decomposition_counts(_falls(spark, d))


@query(FALLS_SQL + "select * from z where delta_total < 0 order by delta_total, actor limit 15")
def largest_falls(spark, d):
    return network.largest_falls(_falls(spark, d))


@query("""
with r as (select user_id as actor, strftime(ts, '%Y-%m-%d') as place, event_id % 11 as document from events),
p as (select place, count(distinct actor) as a, count(distinct document) as b from r group by 1), s as (select list(a order by a) as v, count(*) as n from p), j as (select *, least(greatest(floor((n + 1) * 9 / 10), 1), n - 1)::int as j from s), z as (select *, (n + 1) * 9 - j * 10 as delta from j)
select (select count(distinct actor) from r)::bigint as n_actors, (select count(distinct document) from r)::bigint as n_documents, (select count(*) from (select distinct actor, place from r))::bigint as n_links, (select count(*) from p)::bigint as n_places,
  round_even((select median(a) from p), 1)::double as actors_median, (select max(a) from p)::bigint as actors_max, round_even((select median(b) from p), 1)::double as documents_median,
  round_even(case when n >= 10 then (v[j] * (10 - delta) + v[j + 1] * delta) / 10.0 else v[n] end, 1)::double as actors_p90 from z""")
def bipartite_report(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("actor"), F.date_format("ts", "yyyy-MM-dd").alias("place"), (F.col("event_id") % 11).alias("document"))
    return network.bipartite_summary(rows, "actor", "place", "document")


@query("""with recursive r as (select distinct user_id as actor, strftime(ts, '%Y-%m-%d %H') as place from events),
e as (select x.actor as a, y.actor as b, count(*)::bigint as weight from r x join r y on x.place = y.place and x.actor < y.actor group by 1, 2),
f as (select a, b from e where weight >= 14), s as (select a, b from f union select b, a from f), nodes as (select distinct actor as node from r),
walk(node, reach) as (select node, node from nodes union select walk.node, s.b from walk join s on s.a = walk.reach)
select component, count(*)::bigint as size from (select node, min(reach) as component from walk group by node) group by 1 order by size desc, component limit 10""")
def top_components(spark, d):
    nodes = _appearances(spark, d).select(F.col("actor").alias("node")).distinct()
    return network.top_components(network.component_sizes(network.linked(_appearances(spark, d), "actor", "place", 14), nodes))


@query("""with r as (select distinct user_id as actor, strftime(ts, '%Y-%m-%d %H') as place from events)
select x.actor as a, y.actor as b, count(*)::bigint as weight from r x join r y on x.place = y.place and x.actor < y.actor where x.actor % 3 > 0 and y.actor % 3 > 0 group by 1, 2""")
def confirmed_subgraph(spark, d):
    """A third of the actors is confirmed as institutional, a third confirmed as not, and a third unknown."""
    k = F.col("node") % 3
    nodes = _appearances(spark, d).select(F.col("actor").alias("node")).distinct().withColumn("es_institucional", F.when(k == 0, True).when(k == 1, False))
    return network.projection_without_institutions(_appearances(spark, d), nodes, "actor", "place")


@query(ACTORS_SQL + "select count_if(f)::bigint as n_institutional, count_if(not f)::bigint as n_not_institutional, count_if(f is null)::bigint as n_unclassified from (select actor, case when count(es_institucional) = 0 then null else 2 * sum(es_institucional) >= count(es_institucional) end as f from x group by 1)")
def network_kinds(spark, d):
    return network.kind_counts(network.nodes(_actor_rows(spark, d)))


# reviewed relations: customers of two segments are reviewed documents; an id of 100 or more is historical, 200 is known to be gone
RELATIONS_SQL = """
with recursive rel as (select c_custkey as document_id, ['mismo_conflicto', 'conflictos_distintos', 'focal', 'contextual', 'mismo_proyecto'][c_custkey % 5 + 1] as relation, c_custkey as seq,
  case when c_custkey % 35 = 0 then [c_nationkey, 200] when c_custkey % 3 = 0 then [c_nationkey, 100 + (c_nationkey + 6) % 25] else [c_nationkey, (c_nationkey + 6) % 25] end as case_ids from customer where c_mktsegment in ('BUILDING', 'MACHINERY')),
ids as (select document_id, relation, seq, list_contains(case_ids, 200) as skipped, unnest(case_ids) as raw from rel), now as (select *, case when raw between 100 and 124 then raw - 100 else raw end as case_id from ids)
"""


def _relations(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    kinds = F.array(*map(F.lit, ("mismo_conflicto", "conflictos_distintos", "focal", "contextual", "mismo_proyecto")))
    other = F.when(k % 35 == 0, F.lit(200)).when(k % 3 == 0, (n + 6) % 25 + 100).otherwise((n + 6) % 25)
    reviewed = t(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return reviewed.select(k.alias("document_id"), kinds[(k % 5).cast("int")].alias("relation"), k.alias("seq"), F.array(n, other.cast("int")).alias("case_ids"))


def _historical(spark):
    ids = spark.range(25).select(F.col("id").cast("int").alias("new"))
    return ids.select((F.col("new") + 100).alias("old"), "new"), spark.createDataFrame([(200,)], "case_id int")


@query(RELATIONS_SQL + """, e as (select min(case_id) as a, max(case_id) as b from now where relation = 'mismo_conflicto' and not skipped group by document_id, seq), s as (select a, b from e union select b, a from e),
walk(node, reach) as (select n_nationkey, n_nationkey from nation union select walk.node, s.b from walk join s on s.a = walk.reach),
c as (select node, min(reach) as component from walk group by node)
select node as case_id, 'conflict:' || substr(sha256((select string_agg(c2.node::varchar, '|' order by c2.node::varchar) from c c2 where c2.component = c.component)), 1, 24) as conflict_id from c""")
def conflict_cases(spark, d):
    aliases, gone = _historical(spark)
    return conflict.case_groups_of(_relations(spark, d), t(spark, d, "nation").select(F.col("n_nationkey").alias("case_id")), aliases, gone)


@query(RELATIONS_SQL + """, p(name, rank) as (values ('focal', 5), ('co_focal', 4), ('contextual_mention', 3), ('panoramic_mention', 2), ('mentioned_unreviewed', 1)),
human as (select document_id, 'c' || n_regionkey as conflict_id, case relation when 'focal' then 5 when 'mismo_conflicto' then 4 when 'contextual' then 3 when 'conflictos_distintos' then 2 end as rank, 'reviewed_relations' as source from now join nation on n_nationkey = case_id where relation <> 'mismo_proyecto'),
m as (select o_custkey as document_id, 'p' || o_orderkey % 25 as raw_name, o_orderkey % 25 as project_id from orders where o_custkey not in (select document_id from rel)),
mech as (select m.document_id, 'c' || n_regionkey as conflict_id, case when raw_name = case when m.document_id % 4 = 0 then '' when m.document_id % 4 = 1 then 'p' || (c_nationkey + 1) % 25 else 'p' || c_nationkey end then 5 else 1 end as rank, 'trivial_from_project_mention' as source
  from m join customer on c_custkey = m.document_id join nation on n_nationkey = m.project_id)
select document_id, conflict_id, p.name as role, source from (select document_id, conflict_id, max(rank) as rank, source from (select * from human union all select * from mech) group by 1, 2, 4) join p using (rank)""")
def document_roles(spark, d):
    """Reviewed documents have the roles of their relations; elsewhere a mention is focal by the document's name, or the reviewer's correction of it ('' for a document without focus)."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    aliases, gone = _historical(spark)
    nations = t(spark, d, "nation")
    documents = t(spark, d, "customer").select(k.alias("document_id"), name(n).alias("focal_name"))
    units = t(spark, d, "customer").select(k.alias("document_id"), F.when(k % 4 == 0, "").when(k % 4 == 1, name((n + 1) % 25)).alias("focal_name"))
    mentions = t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), name(F.col("o_orderkey") % 25).alias("raw_name"), (F.col("o_orderkey") % 25).alias("project_id"))
    projects = nations.select(F.col("n_nationkey").alias("project_id"), F.col("n_nationkey").alias("case_id"))
    groups = nations.select(F.col("n_nationkey").alias("case_id"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("conflict_id"))
    return conflict.document_conflicts(_relations(spark, d), mentions, documents, units, projects, groups, aliases, gone)


VIEWS_SQL = LINKS_SQL + """, dc as (select c_custkey as document_id, 'c' || c_nationkey % 5 as conflict_id, ['focal', 'co_focal', 'contextual_mention', 'panoramic_mention'][c_custkey % 4 + 1] as role from customer),
u as (select c_custkey as document_id from customer where c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE')),
safe as (select dc.* from dc semi join u using (document_id) where role in ('focal', 'co_focal')), ext as (select dc.* from dc semi join u using (document_id) where role in ('focal', 'co_focal', 'contextual_mention')),
cp as (select distinct event_type || k as project_id, 'c' || (length(event_type) + k) % 5 as conflict_id from events, (select unnest(range(3)) as k))
"""


def _views(spark, d, extended):
    k = F.col("c_custkey")
    roles = F.array(*map(F.lit, ("focal", "co_focal", "contextual_mention", "panoramic_mention")))
    conflicts = t(spark, d, "customer").select(k.alias("document_id"), F.concat(F.lit("c"), (F.col("c_nationkey") % 5).cast("string")).alias("conflict_id"), roles[(k % 4).cast("int")].alias("role"))
    units = t(spark, d, "customer").select(k.alias("document_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"), "caso_unico").otherwise("panoramico").alias("unidad_caso_tipo"))
    return conflict.conflict_view(conflicts, units, extended)


def _conflict_projects(spark, d):
    kinds = t(spark, d, "events").select("event_type").distinct().crossJoin(spark.range(3).select(F.col("id").alias("k")))
    return kinds.select(F.concat("event_type", F.col("k").cast("string")).alias("project_id"), F.concat(F.lit("c"), ((F.length("event_type") + F.col("k")) % 5).cast("string")).alias("conflict_id"))


@query(VIEWS_SQL + "select document_id, conflict_id, role, 'safe' as tier from safe union all select document_id, conflict_id, role, 'extended' from ext")
def conflict_views(spark, d):
    return _views(spark, d, False).withColumn("tier", F.lit("safe")).unionByName(_views(spark, d, True).withColumn("tier", F.lit("extended")))


@query(VIEWS_SQL + """select link_id, a.document_id, project_id, conflict_id, 'safe' as tier from a join cp using (project_id) join safe using (document_id, conflict_id) where resolution_status = 'resolved_explicit'
union all select link_id, a.document_id, project_id, conflict_id, 'extended' from a join cp using (project_id) join ext using (document_id, conflict_id) where resolution_status = 'resolved_explicit'""")
def conflict_link_views(spark, d):
    links, projects = _links(spark, d), _conflict_projects(spark, d)
    view = lambda tier: conflict.link_conflict_view(links, projects, _views(spark, d, tier == "extended")).select("link_id", "document_id", "project_id", "conflict_id", F.lit(tier).alias("tier"))
    return view("safe").unionByName(view("extended"))


@query("""with p as (select distinct c_nationkey as old, c_nationkey % 20 as new from customer) select old, new::int as new, case when count(*) over (partition by new) > 1 then 'merged' else 'preserved' end as status from p""")
def case_alias_status(spark, d):
    n = F.col("c_nationkey")
    return resolve.case_aliases(t(spark, d, "customer").select(F.col("c_custkey").alias("project"), n.alias("old"), (n % 20).alias("new")))


@query("""
with a as (select c_custkey % 40 as old, c_nationkey + 10 * (c_custkey % 2) as new from customer), n as (select old, count(*) as n from a group by 1),
x as (select a.old, a.new, n > 1 as repeated, a.new not in (select n_nationkey from nation) as missing, a.new <> a.old and a.new in (select old from a where old <> new) as chain from a join n using (old))
select distinct old, array_to_string(list_filter([case when repeated then 'repeated' end, case when missing then 'missing_target' end, case when chain then 'chain' end], lambda e: e is not null), ',') as errors from x where repeated or missing or chain""")
def alias_rule_errors(spark, d):
    aliases = t(spark, d, "customer").select((F.col("c_custkey") % 40).alias("old"), (F.col("c_nationkey") + 10 * (F.col("c_custkey") % 2)).alias("new"))
    found = resolve.alias_errors(aliases, t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("case_id")))
    return found.withColumn("errors", F.array_join("errors", ","))


QUEUE_SQL = """
with q as (select c_custkey, 'NATION_' || c_nationkey as na, c_nationkey as a, (c_nationkey * 7 + c_custkey % 3) % 30 as b from customer),
r as (select c_custkey, a::bigint as id_a, case when c_custkey % 13 = 0 then 'odd' else na end as name_a, b::bigint as id_b, 'NATION_' || b as name_b from q)
"""


def _queue(spark, d):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    b = (n * 7 + k % 3) % 30
    name = lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    return t(spark, d, "customer").select(n.cast("long").alias("id_a"), F.when(k % 13 == 0, "odd").otherwise(name(n)).alias("name_a"), b.cast("long").alias("id_b"), name(b).alias("name_b"))


@query(QUEUE_SQL + """, c as (select least(id_a, id_b) as lo, greatest(id_a, id_b) as hi, count(*) as n from r group by 1, 2),
x as (select r.*, id_a > 24 or id_b > 24 as unknown, name_a = 'odd' as odd, id_a = id_b as self, n > 1 as repeated from r join c on lo = least(id_a, id_b) and hi = greatest(id_a, id_b))
select distinct id_a, id_b, array_to_string(list_filter([case when unknown then 'unknown_project' end, case when not unknown and odd then 'other_name' end, case when self then 'self' end, case when repeated then 'repeated' end], lambda e: e is not null), ',') as errors from x where unknown or odd or self or repeated""")
def review_queue_errors(spark, d):
    projects = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("canonical_name"))
    return resolve.queue_errors(_queue(spark, d), projects).withColumn("errors", F.array_join("errors", ","))


@query("""
with n as (select p_partkey, p_name, p_name || case p_size % 3 when 0 then '' when 1 then ' etapa ' || p_size % 4 + 1 else ' ' || p_size % 2 end as name from part),
p as (select distinct least(x.name, y.name) as name_a, greatest(x.name, y.name) as name_b from (select distinct name from n) x join (select distinct name from n) y on x.name <> y.name and (contains(x.name, y.name) or contains(y.name, x.name)) and length(x.name) >= 6 and length(y.name) >= 6)
select name_a, name_b, case when name_a like 'red ring%' then true when name_a like 'blue%' then null when name_a like 'green bolt%' then true when sa <> sb then false end as same,
  case when name_a like 'red ring%' then 'exact_id' when name_a like 'green bolt%' then 'manual_pair' when sa <> sb then 'explicit_stage' when ta <> tb then 'trailing_numeral' else 'open' end as reason
from (select *, regexp_extract(name_a, 'etapa (\\d+)', 1) as sa, regexp_extract(name_b, 'etapa (\\d+)', 1) as sb, regexp_extract(name_a, ' (\\d+)$', 1) as ta, regexp_extract(name_b, ' (\\d+)$', 1) as tb from p) where name_a not like 'blue%'
union all select name_a, name_b, case when sa <> sb then false end, case when sa <> sb then 'explicit_stage' when ta <> tb then 'trailing_numeral' else 'open' end
from (select *, regexp_extract(name_a, 'etapa (\\d+)', 1) as sa, regexp_extract(name_b, 'etapa (\\d+)', 1) as sb, regexp_extract(name_a, ' (\\d+)$', 1) as ta, regexp_extract(name_b, ' (\\d+)$', 1) as tb from p) where name_a like 'blue%'""")
def decided_queue(spark, d):
    """The review queue of parts' names: some pairs are decided by their ids, some by names, the others by rule."""
    size = F.col("p_size")
    tail = F.when(size % 3 == 0, "").when(size % 3 == 1, F.concat(F.lit(" etapa "), (size % 4 + 1).cast("string"))).otherwise(F.concat(F.lit(" "), (size % 2).cast("string")))
    names = t(spark, d, "part").select(F.concat("p_name", tail).alias("canonical_name")).distinct()
    projects = names.select("canonical_name", F.col("canonical_name").alias("normalized_name"), X.stable_id("project", F.col("canonical_name")).alias("project_id"))
    queue = resolve.project_review_queue(projects)
    low, high = F.least("name_a", "name_b"), F.greatest("name_a", "name_b")
    by_id = queue.where(low.startswith("red ring")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(True).alias("same"))
    by_name = queue.where(low.startswith("green bolt")).select(F.col("name_b").alias("a"), F.col("name_a").alias("b"), F.lit(True).alias("same"))
    return resolve.decide_pairs(queue, by_id, by_name).select(low.alias("name_a"), high.alias("name_b"), "same", "reason")


@query("""with m as (select distinct o_custkey % 400 as document_id, o_orderkey % 25 as project_id from orders), p as (select distinct least(c_nationkey, (c_nationkey + 3) % 25) as a, greatest(c_nationkey, (c_nationkey + 3) % 25) as b from customer)
select a::bigint as id_a, b::bigint as id_b, (select count(*) from m x join m y using (document_id) where x.project_id = p.a and y.project_id = p.b)::bigint as n_shared from p""")
def shared_project_documents(spark, d):
    mentions = t(spark, d, "orders").select((F.col("o_custkey") % 400).alias("document_id"), (F.col("o_orderkey") % 25).alias("project_id"))
    n = F.col("c_nationkey").cast("long")
    pairs = t(spark, d, "customer").select(F.least(n, (n + 3) % 25).alias("id_a"), F.greatest(n, (n + 3) % 25).alias("id_b")).distinct()
    return resolve.shared_documents(mentions, pairs)


@query("""
with s as (select 'enrichment_actor' as source_table, s_suppkey::varchar as source_id, s_nationkey as document_id, s_name as nombre, 'first' as source_pass from supplier
  union all select 'enrichment_institution', c_custkey::varchar, c_nationkey, c_name, 'first' from customer union all select 'enrichment_event', p_partkey::varchar, p_size, p_name, 'first' from part
  union all select 'actor_second_pass_v2', o_orderkey::varchar, o_custkey, o_orderstatus, 'second' from orders where o_orderpriority <> '1-URGENT')
select source_table, source_pass, count(*)::bigint as n, md5(string_agg(substr(sha256('link|' || source_table || '|' || source_id || '|' || nombre || '|' || source_pass), 1, 24), '' order by substr(sha256('link|' || source_table || '|' || source_id || '|' || nombre || '|' || source_pass), 1, 24))) as ids from s group by 1, 2""")
def link_source_union(spark, d):
    rows = lambda table, key, document, name: t(spark, d, table).select(F.col(key).cast("string").alias("source_id"), F.col(document).alias("document_id"), F.col(name).alias("nombre"), F.lit("").alias("raw"))
    p = F.col("o_orderpriority")
    second = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("source_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("nombre"), F.lit("").alias("raw"), F.when(p == "1-URGENT", "first").when(p == "2-HIGH", "second").alias("source_pass"))
    out = resolve.link_sources(rows("supplier", "s_suppkey", "s_nationkey", "s_name"), rows("customer", "c_custkey", "c_nationkey", "c_name"), rows("part", "p_partkey", "p_size", "p_name"), second)
    return out.groupBy("source_table", "source_pass").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("link_id")), "").cast("binary")).alias("ids"))


@query("select o_custkey as document_id, 'nunoa ' || o_orderkey % 5 as key, max(case when o_orderkey % 5 > 1 then (o_orderkey % 5)::int end) as case_mention_index from orders group by 1, 2")
def verified_mention_index(spark, d):
    k = F.col("o_orderkey") % 5
    name = F.concat(F.when(F.col("o_orderkey") % 2 == 0, " Ñuñoa  ").otherwise("NUNOA "), k.cast("string"))
    return conflict.verified_index(t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), name.alias("name"), F.when(k > 1, k.cast("int")).alias("case_mention_index")))


@query("""select o_orderkey, case when o_orderpriority = '1-URGENT' then 'urgent' else o_orderstatus end as filled, case when o_orderstatus = 'P' then 'R' else o_orderstatus end as swapped from orders""")
def decision_overlays(spark, d):
    """A gap filled by reviewers' values, and a compare-and-set of one status by another."""
    o = t(spark, d, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = o.select("o_orderkey", F.when(~urgent, F.col("o_orderstatus")).alias("filled"), F.col("o_orderstatus").alias("swapped"))
    filled = resolve.overlay(rows, o.select("o_orderkey", F.lit("urgent").alias("value")), ["o_orderkey"], "filled", only_null=True)
    changed = o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("R").alias("value"), F.lit("P").alias("expected"))
    return resolve.overlay(filled, changed, ["o_orderkey"], "swapped", expected="expected")


@query("""
with a as (select link_id, conflict_id, source_table, source_id from (select event_id as link_id, 'c' || user_id % 9 as conflict_id, case when {K} % 2 = 0 then 'enrichment_actor' else 'enrichment_institution' end as source_table, {K} as source_id, event_type <> 'error' as ok from events) where ok),
n as (select a.*, case when source_table = 'enrichment_actor' then s_name else c_name end as raw, case when source_table = 'enrichment_actor' then 'tipo' || s_nationkey else c_mktsegment end as tipo, case when source_table = 'enrichment_actor' then 'a favor' end as stance
  from a left join supplier on source_table = 'enrichment_actor' and s_suppkey = source_id left join customer on source_table = 'enrichment_institution' and c_custkey = source_id),
i as (select *, case when raw in ('Supplier#000000002', 'Customer#000000003') then 'entity:' || substr(sha256('actor|uno'), 1, 24) end as entity_id from n where raw is not null),
r as (select *, row_number() over (partition by conflict_id, coalesce(entity_id, raw) order by link_id desc) as r from i)
select conflict_id, coalesce(entity_id, raw) as key, case when entity_id is null then raw else 'Uno' end as nombre, entity_id, tipo, stance from r where r = 1""".replace("{K}", K))
def linked_actor_details(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    links = t(spark, d, "events").select(
        F.col("event_id").alias("link_id"), F.concat(F.lit("c"), (F.col("user_id") % 9).cast("string")).alias("conflict_id"), F.when(k % 2 == 0, "enrichment_actor").otherwise("enrichment_institution").alias("source_table"), k.alias("source_id"),
        F.when(F.col("event_type") != "error", "resolved_explicit").otherwise("inferred_single_project").alias("resolution_status"),
    )
    none = F.lit(None).cast("string")
    actors = t(spark, d, "supplier").select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("nombre"), F.concat(F.lit("tipo"), F.col("s_nationkey").cast("string")).alias("tipo"), F.lit("a favor").alias("stance"), none.alias("nivel_involucramiento"))
    institutions = t(spark, d, "customer").select(F.col("c_custkey").alias("institucion_id"), F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("tipo_norm"))
    entities, aliases = network.registry(spark.createDataFrame([("uno", "Uno", [" SUPPLIER#000000002", "customer#000000003 "])], "entity_key string, canonical_label string, aliases array<string>"))
    return present.linked_actors(links, actors, institutions, entities, aliases).select("conflict_id", "key", "nombre", "entity_id", "tipo", "stance")


@query("""
with c as (select n_nationkey as conflict_id, n_nationkey % 3 = 0 as backed from nation)
select (select count(*) from orders)::bigint as n_orders, (select count(*) from part)::bigint as n_parts, count(*)::bigint as n_conflicts_total, count_if(backed)::bigint as n_conflicts_evidence_backed, count_if(not backed)::bigint as n_conflicts_without_exact_backing,
  (select count(distinct case when c_custkey % 4 = 0 then 'e' || c_custkey % 8 else c_mktsegment end) from customer)::bigint as n_actors, (select count(*) from region where r_regionkey > 1)::bigint as n_territories_with_conflicts from c""")
def dashboard_summary(spark, d):
    conflicts = t(spark, d, "nation").select(F.col("n_nationkey").alias("conflict_id"), F.when(F.col("n_nationkey") % 3 == 0, present.BACKED).otherwise("x").alias("respaldo_evidencia"))
    actors = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("e"), (F.col("c_custkey") % 8).cast("string"))).alias("entity_id"), F.col("c_mktsegment").alias("nombre"))
    territories = t(spark, d, "region").select(F.when(F.col("r_regionkey") > 1, 2).otherwise(0).alias("n_conflicts"))
    return present.summary({"orders": t(spark, d, "orders"), "parts": t(spark, d, "part")}, conflicts, actors, territories)


@query("""
with q as (select n_regionkey as conflict_id, n_regionkey % 2 = 0 as focal, o_custkey as document_id, o_orderkey as evidence_id, o_orderpriority as quote from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
u as (select q.* from q where focal or conflict_id <> 1), f as (select *, row_number() over (partition by conflict_id, quote order by document_id, evidence_id) as k from u), g as (select *, row_number() over (partition by conflict_id order by document_id, evidence_id) as r from f where k = 1),
e as (select user_id % 5 as conflict_id, strftime(ts, '%Y-%m-%d') as fecha, event_id, row_number() over (partition by user_id % 5 order by strftime(ts, '%Y-%m-%d'), event_id) as r from events)
select r_regionkey as conflict_id, (select string_agg(n_name, ',' order by n_name) from nation where n_regionkey = r_regionkey) as projects, (select string_agg(quote, ',' order by r) from g where g.conflict_id = r_regionkey and r <= 3) as quotes,
  (select string_agg(event_id::varchar, ',' order by r) from e where e.conflict_id = r_regionkey and r <= 8) as events, (select count(*) from e where e.conflict_id = r_regionkey)::bigint as n_events from region""")
def conflict_details(spark, d):
    """Regions are conflicts; even ones have focal quotes, of the others all but one are backed, so their other quotes count."""
    conflicts = t(spark, d, "region").select(F.col("r_regionkey").alias("conflict_id"), (F.col("r_regionkey") != 1).alias("backed"))
    projects = t(spark, d, "nation").select(F.col("n_regionkey").alias("conflict_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("project_id"))
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    quotes = o.select(F.col("n_regionkey").alias("conflict_id"), (F.col("n_regionkey") % 2 == 0).alias("focal"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("quote"))
    events = t(spark, d, "events").select((F.col("user_id") % 5).cast("int").alias("conflict_id"), F.date_format("ts", "yyyy-MM-dd").alias("fecha"), "event_id")
    out = present.conflict_detail(conflicts, projects, quotes, events)
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    return out.select("conflict_id", names("projects", "name").alias("projects"), F.array_join("quotes", ",").alias("quotes"), names("events", "event_id").alias("events"), "n_events")


@query("""
with m as (select c_custkey as mention_id, case when c_custkey % 3 = 0 then '13' || c_nationkey else '' end as code, case when c_custkey % 3 = 1 then 'nation_' || c_nationkey || ' y lejos' when c_custkey % 3 = 2 then 'nation_1;Nation_2' end as comuna from customer)
select mention_id, case when code <> '' then code else '13' || regexp_extract(comuna, '\\d+') end as code from m where code <> '' or comuna like '%lejos'""")
def resolved_area_codes(spark, d):
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 3
    text = F.when(k == 1, F.concat(F.lit("Nation_"), n, F.lit(" y  Lejos"))).when(k == 2, "nation_1;Nation_2")
    mentions = t(spark, d, "customer").select(F.col("c_custkey").alias("mention_id"), F.when(k == 0, F.concat(F.lit("13"), n)).otherwise("").alias("code"), text.alias("comuna"))
    areas = t(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("13"), F.col("n_nationkey").cast("string")).alias("code"))
    return geo.resolved_codes(mentions, geo.backfill_compound(mentions, areas))


@query("""select c_nationkey as code, count(distinct o_orderkey % 50)::bigint as n_projects from orders join customer on c_custkey = o_custkey where c_mktsegment <> 'HOUSEHOLD' group by 1""")
def area_projects(spark, d):
    mentions = t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("raw_name"), (F.col("o_orderkey") % 50).alias("project_id"))
    statuses = t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("raw_name")).distinct()
    area = t(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_nationkey")).alias("code"))
    return geo.projects_by_area(mentions, statuses.join(area, "document_id"), "code")


@query("""select o_orderkey // 3 as document_id, min(o_orderstatus) as code, arg_max(o_orderpriority, o_orderkey) as name from orders group by 1 having count(distinct o_orderstatus) = 1""")
def document_areas(spark, d):
    document = F.floor(F.col("o_orderkey") / 3).alias("document_id")
    return geo.document_area(t(spark, d, "orders").select(document, F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("name"), "o_orderkey"), "document_id", "code", "name", "o_orderkey")


@query("""with c as (select o_orderkey // 3 as k, min(o_orderstatus) as conflict_id from orders group by 1 having count(distinct o_orderstatus) = 1) select event_id as geocode_id, conflict_id from events join c on k = event_id // 2""")
def conflict_bridges(spark, d):
    located = t(spark, d, "events").select(F.col("event_id").alias("geocode_id"), F.floor(F.col("event_id") / 2).alias("document_id"))
    return geo.conflict_bridge(located, t(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 3).alias("document_id"), F.col("o_orderstatus").alias("conflict_id")))


@query("""select 'orders' as "table", (select count(*) from orders)::bigint as rows, (select count(*) from orders where o_custkey not in (select c_custkey from customer))::bigint as violations, 'orders has changed' as gate
union all select 'nation', (select count(*) from nation), (select count(*) from orders where o_custkey not in (select c_custkey from customer)), 'orders has changed'""")
def run_manifest(spark, d):
    violations = audit.foreign_keys([("orders.customer", t(spark, d, "orders"), "o_custkey", t(spark, d, "customer"), "c_custkey")])
    gate = audit.hash_reasons({"orders": "1", "nation": "2"}, {"orders": "0", "nation": "2"})
    out = audit.run_manifest({"orders": t(spark, d, "orders"), "nation": t(spark, d, "nation")}, {"orders": ["o_orderkey"]}, violations, gate)
    return out.drop("fingerprint")


@query("""
with u as (select distinct doc_id as id from documents), done as (select doc_id as id from labels where quality = 1), q as (select doc_id as id from labels)
select (select count(*) from u)::bigint as universe, (select count(*) from u where id in (select id from done))::bigint as done, (select count(*) from u where id not in (select id from done) and id in (select id from q))::bigint as retries,
  (select count(*) from u where id not in (select id from done))::bigint as pending, least((select count(*) from u where id not in (select id from done)), 500)::bigint as selected, round_even(least((select count(*) from u where id not in (select id from done)), 500) * 0.25, 6)::double as cost""")
def run_preflight(spark, d):
    labels = t(spark, d, "labels")
    return audit.preflight(t(spark, d, "documents"), labels.where("quality = 1"), labels, "doc_id", 0.25, 500)


@query("""select (select count(*) from orders)::bigint as expected, (select count(*) from orders where o_orderstatus <> 'P')::bigint as written, (select count(*) from orders where o_orderstatus = 'P')::bigint as errors, true as conserved""")
def conserved_counts(spark, d):
    o = t(spark, d, "orders")
    return audit.conserved(o, o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'P'"))


@query("""with r as (select quality = 1 as t, toxic = 0 as p from labels), c as (select count_if(p and t) as tp, count_if(p and not t) as fp, count_if(not p and t) as fn, count_if(not p and not t) as tn from r)
select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round_even(tp / (tp + fp), 3)::double as precision, round_even(tp / (tp + fn), 3)::double as recall from c""")
def detector_confusion(spark, d):
    return audit.confusion(t(spark, d, "labels").select((F.col("quality") == 1).alias("t"), (F.col("toxic") == 0).alias("p")), "p", "t")


@query("select distinct p_type from part where p_type not in ('PROMO', 'SMALL')")
def label_gaps(spark, d):
    return audit.enum_gaps(t(spark, d, "part"), "p_type", ["PROMO", "SMALL", "unused"])


@query("""with a as (select distinct o_custkey as k from orders), b as (select c_custkey as k from customer where c_mktsegment <> 'BUILDING')
select k as document_id, 'left' as side from a where k not in (select k from b) union all select k, 'right' from b where k not in (select k from a)""")
def set_differences(spark, d):
    return resolve.same_set(t(spark, d, "orders").select(F.col("o_custkey").alias("document_id")), t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("document_id")), "document_id")
