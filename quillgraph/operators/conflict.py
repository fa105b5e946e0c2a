"""Conflict topology: duplicate groups, case groups, roles, evidence backing, views, relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import norm_key, stable_id
from quillgraph.operators.components import connected_components, materialize

# Fixed values.
ROLES = {"focal": 5, "co_focal": 4, "contextual_mention": 3, "panoramic_mention": 2, "mentioned_unreviewed": 1}
ROLE_OF_RELATION = {"focal": "focal", "mismo_conflicto": "co_focal", "contextual": "contextual_mention", "conflictos_distintos": "panoramic_mention"}
#: Relations that place a document beside a case without saying anything about the cases' topology.
MEMBERSHIP = ("focal", "contextual")
RELATIONS = ("mismo_conflicto", "conflictos_distintos", "mismo_proyecto", "focal", "contextual")
MIN_SHARED_QUOTE = 8


def _parts_of(rows: DataFrame, least: int) -> DataFrame:
    """(document_id, id, q, part): the runs of ``least`` characters of each quote."""
    starts = F.sequence(F.lit(1), F.length("q") - least + 1)
    return rows.select("document_id", "id", "q", F.explode(F.array_distinct(F.transform(starts, lambda i: F.col("q").substr(i, F.lit(least))))).alias("part"))


def duplicate_edges(mentions: DataFrame) -> DataFrame:
    """(src, dst, same, within): links that connect the duplicates of a document, from mentions (document_id, id, o, q).

    Mentions of one object are linked to the first of them, and equal quotes too. Quotes within others meet on the runs of
    MIN_SHARED_QUOTE characters: the contained one gives its first, which is among those of every quote that holds it. Work is
    on distinct quotes of a document.
    """
    star = lambda rows, key, same: rows.join(rows.groupBy("document_id", key).agg(F.min("id").alias("dst")), ["document_id", key]).where("id <> dst").select(F.col("id").alias("src"), "dst", F.lit(same).alias("same"), F.lit(not same).alias("within"))
    quoted = mentions.where(F.length("q") >= MIN_SHARED_QUOTE)
    distinct = materialize(quoted.groupBy("document_id", "q").agg(F.min("id").alias("id")))
    held = distinct.select("document_id", F.col("id").alias("dst"), F.col("q").alias("inner"), F.left("q", F.lit(MIN_SHARED_QUOTE)).alias("part"))
    met = _parts_of(distinct, MIN_SHARED_QUOTE).join(held, ["document_id", "part"]).where((F.col("q") != F.col("inner")) & F.contains("q", F.col("inner")))
    holds = met.select(F.col("id").alias("src"), "dst", F.lit(False).alias("same"), F.lit(True).alias("within"))
    return star(mentions.where("o <> ''"), "o", True).unionByName(star(quoted, "q", False)).unionByName(holds)


def duplicate_groups(mentions: DataFrame) -> DataFrame:
    """One row for each mention (document_id, idx, object_raw, quote, decision) with its group within the document: same object, or one quote within the other, both folded.

    (document_id, idx, group_id, group_size, canonical_idx, method, mixed); a null decision counts as a value of its own.
    """
    m = materialize(mentions.select("document_id", "idx", norm_key(F.col("object_raw")).alias("o"), norm_key(F.col("quote")).alias("q"), "decision", F.concat_ws(":", "document_id", "idx").alias("id")))
    edges = materialize(duplicate_edges(m))
    groups = materialize(connected_components(edges.select("src", "dst"), m.select(F.col("id").alias("node"))))
    how = edges.join(groups.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.max("same").alias("s"), F.max("within").alias("w"))
    method = F.when(F.col("s") & F.col("w"), "ambos").when(F.col("s"), "tipo_objeto_raw_exact").when(F.col("w"), "quote_substring").otherwise("single")
    rows = m.join(groups.withColumnRenamed("node", "id"), "id").join(how, "component", "left")
    about = rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("group_size"),
        (F.countDistinct(F.coalesce("decision", F.lit("\0"))) > 1).alias("mixed"),
        F.coalesce(F.min(F.when(F.col("decision") == "include", F.col("idx"))), F.min("idx")).alias("canonical_idx"),
        F.concat(F.lit("cmdup:"), stable_id(F.array_join(F.array_sort(F.collect_set("id")), "|"))).alias("group_id"),
    )
    return rows.withColumn("method", F.coalesce(method, F.lit("single"))).join(about, "component").select("document_id", "idx", "group_id", "group_size", "canonical_idx", "method", "mixed")


def exact_groups(rows: DataFrame, key: str, member: str, decision: str) -> DataFrame:
    """(key, group_size, canonical, mixed): keys that several rows have, their smallest member, and whether their decisions differ."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.min(member).alias("canonical"), (F.countDistinct(decision) > 1).alias("mixed"))
    return g.where("group_size > 1")


def verified_index(mentions: DataFrame, name: str = "name", index: str = "case_mention_index") -> DataFrame:
    """(document_id, key, index): the case mention that a project's name stands for, by folded name; two indexes of one key raise (null, 'explicitly none', is one)."""
    per = mentions.groupBy("document_id", norm_key(F.col(name)).alias("key")).agg(F.countDistinct(F.coalesce(F.col(index), F.lit(-1))).alias("_n"), F.max(index).alias(index))
    require_empty(per.where("_n > 1"), "a mention's index is contradicted")
    return per.drop("_n")


def current_ids(relations: DataFrame, known: DataFrame, aliases: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """Exploded relations (document_id, relation, seq, case_ids) as (document_id, relation, seq, case_id, resolved, skipped).

    ``aliases`` (old, new) replace ids that aren't current any more; ``gone`` (case_id) are confirmed to stand for nothing:
    a relation that names one is skipped.
    """
    rows = relations.select("document_id", "relation", "seq", F.explode("case_ids").alias("case_id"))
    now = known.select(F.col("case_id"), F.lit(True).alias("_now")).distinct()
    rows = rows.join(now, "case_id", "left")
    if aliases is not None:
        rows = rows.join(aliases.select(F.col("old").alias("case_id"), "new"), "case_id", "left").withColumn("case_id", F.when(F.col("_now").isNull() & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("case_id"))).drop("_now", "new").join(now, "case_id", "left")
    skipped = F.lit(False)
    if gone is not None:
        rows = rows.join(gone.select("case_id", F.lit(True).alias("_gone")).distinct(), "case_id", "left")
        skipped = F.max(F.coalesce("_gone", F.lit(False))).over(Window.partitionBy("document_id", "seq"))
    return rows.select("document_id", "relation", "seq", "case_id", F.col("_now").isNotNull().alias("resolved"), skipped.alias("skipped"))


def case_groups(relations: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, conflict_id): cases joined by 'mismo_conflicto' relations (case_a, case_b, relation); unknown relations raise."""
    require_empty(relations.where(~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False))), "unknown relation")
    edges = relations.where("relation = 'mismo_conflicto'").select(F.col("case_a").alias("src"), F.col("case_b").alias("dst"))
    known = cases.select(F.col("case_id").alias("node"))
    edges = edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    groups = connected_components(edges, known)
    ids = groups.groupBy("component").agg(F.concat(F.lit("conflict:"), stable_id(F.array_join(F.array_sort(F.collect_set(F.col("node").cast("string"))), "|"))).alias("conflict_id"))
    return groups.join(ids, "component").select(F.col("node").alias("case_id"), "conflict_id")


def case_groups_of(relations: DataFrame, cases: DataFrame, aliases: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """(case_id, conflict_id) from reviewed relations (document_id, relation, seq, case_ids) after the remap of historical ids; an id that leads nowhere raises."""
    require_empty(relations.where(~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False))), "unknown relation")
    ids = materialize(current_ids(relations.where("relation = 'mismo_conflicto'"), cases, aliases, gone).where("not skipped"))
    require_empty(ids.where("not resolved"), "a relation names an unknown case")
    first = ids.groupBy("document_id", "seq").agg(F.min("case_id").alias("case_b"))
    return case_groups(ids.join(first, ["document_id", "seq"]).select(F.col("case_id").alias("case_a"), "case_b", "relation"), cases)


def conflict_projects(projects: DataFrame, groups: DataFrame) -> DataFrame:
    """(conflict_id, project_id, case_id): every case is in one conflict."""
    return projects.where("case_id is not null").join(groups, "case_id").select("conflict_id", "project_id", "case_id")


def document_conflicts(relations: DataFrame, mentions: DataFrame, documents: DataFrame, units: DataFrame, projects: DataFrame, groups: DataFrame, aliases: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """(document_id, conflict_id, role, source): the roles that documents have in conflicts.

    Reviewed ``relations`` (document_id, relation, seq, case_ids) come first, and a reviewed document takes no other rows. Elsewhere
    a mention (document_id, raw_name, project_id) is focal if it is the document's focal name: the reviewer's correction
    in ``units`` (document_id, focal_name), where '' means that there is none, or else that of ``documents`` (document_id, focal_name). Of several roles
    the one of highest priority stays, the first among equals. An unknown relation raises, as does an id that leads nowhere,
    unless the relation is one of membership or the id is known to be gone.
    """
    require_empty(relations.where(~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False))), "unknown relation")
    rows = relations.where("relation <> 'mismo_proyecto'")
    ids = materialize(current_ids(rows, groups, aliases))
    dead = gone.select("case_id") if gone is not None else ids.select("case_id").limit(0)
    lost = ids.where("not resolved").where(~F.col("relation").isin(*MEMBERSHIP)).join(dead, "case_id", "left_anti")
    require_empty(lost, "a relation names an unknown case")
    role = F.coalesce(*(F.when(F.col("relation") == r, name) for r, name in ROLE_OF_RELATION.items()))
    human = ids.where("resolved").join(groups, "case_id").select("document_id", "conflict_id", role.alias("role"), F.lit("reviewed_relations").alias("source"), F.col("seq").cast("string").alias("at"))
    corrected = units.select("document_id", F.col("focal_name").alias("corrected"))
    named = mentions.join(documents.select("document_id", "focal_name"), "document_id").join(corrected, "document_id", "left").withColumn("focal", F.coalesce("corrected", "focal_name"))
    named = named.join(relations.select("document_id").distinct(), "document_id", "left_anti").join(projects.select("project_id", "case_id"), "project_id").join(groups, "case_id")
    mechanical = named.select("document_id", "conflict_id", F.when(F.col("raw_name").eqNullSafe(F.col("focal")), "focal").otherwise("mentioned_unreviewed").alias("role"), F.lit("trivial_from_project_mention").alias("source"), F.col("raw_name").alias("at"))
    return best_role(human.unionByName(mechanical), ["document_id", "conflict_id"], "role", "at").drop("at")


def unresolved_blockers(queue: DataFrame | None, required: tuple[str, ...] = ("resolved", "decision")) -> DataFrame:
    """Reasons for which a publication can't say that identities are settled: a missing queue or column, or open pairs, as (blocker, n)."""
    session = queue.sparkSession if queue is not None else None
    if session is None:
        raise ValueError("the review queue is missing")
    lacking = [c for c in required if c not in queue.columns]
    if lacking:
        return session.createDataFrame([(f"missing column {c}", 1) for c in lacking], "blocker string, n long")
    open_ = (F.coalesce("resolved", F.lit(0)) == 0) | (F.coalesce("decision", F.lit("")) == "needs_human_review")
    return queue.where(open_).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("open pairs").alias("blocker"), "n")


def best_role(rows: DataFrame, keys: list[str], role: str, order: str, priority: dict[str, int] | None = None) -> DataFrame:
    """One row for each key: the role of highest priority, the first among equals by ``order``."""
    rank = F.coalesce(*(F.when(F.col(role) == name, n) for name, n in (priority or ROLES).items()), F.lit(0))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(rank.desc(), order))).where("_r = 1").drop("_r")


def backing(projects: DataFrame, mentions: DataFrame, included: DataFrame, evidence: DataFrame) -> DataFrame:
    """Backing chain: conflict project -> its mention with an index -> that case mention, included -> its own verified 'objeto' quotes. Nothing passes to duplicate siblings."""
    m = mentions.where("case_mention_id is not null")
    e = evidence.where("quote_role = 'objeto' and verified = 1")
    chain = projects.join(m, "project_id").join(included.select("case_mention_id"), "case_mention_id", "left_semi").join(e, "case_mention_id")
    return chain.dropDuplicates(["conflict_id", "project_id", "document_id", "case_mention_id", "evidence_id"])


def coverage(projects: DataFrame, backed: DataFrame) -> DataFrame:
    """(conflict_id, n_projects, n_backed, coverage, label): total, parcial or ninguna; the label is the first backed project's, else the first of all."""
    hit = backed.select("conflict_id", "project_id").distinct().withColumn("hit", F.lit(True))
    rows = projects.join(hit, ["conflict_id", "project_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    out = rows.groupBy("conflict_id").agg(
        F.countDistinct("project_id").alias("n_projects"),
        F.countDistinct(F.when(F.col("hit"), F.col("project_id"))).alias("n_backed"),
        F.min_by("name", F.struct(~F.col("hit"), "name")).alias("label"),
    )
    return out.withColumn("coverage", F.when(F.col("n_backed") == 0, "ninguna").when(F.col("n_backed") == F.col("n_projects"), "total").otherwise("parcial"))


def conflict_view(document_conflict: DataFrame, units: DataFrame, extended: bool = False) -> DataFrame:
    roles = ["focal", "co_focal", *(["contextual_mention"] if extended else [])]
    return document_conflict.where(F.col("role").isin(*roles)).join(units.where("unidad_caso_tipo = 'caso_unico'").select("document_id").distinct(), "document_id", "left_semi")


def link_conflict_view(links: DataFrame, conflict_project: DataFrame, view: DataFrame) -> DataFrame:
    return links.where("resolution_status = 'resolved_explicit'").join(conflict_project, "project_id").join(view.select("document_id", "conflict_id"), ["document_id", "conflict_id"])


def distinct_relations(groups: DataFrame, pending: str = "pending") -> DataFrame:
    """Pairs within groups (document_id, conflict_id, status): any pending document makes a pair pending."""
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.conflict_id") < F.col("b.conflict_id")))
    named = pairs.select(F.col("a.conflict_id").alias("conflict_a"), F.col("b.conflict_id").alias("conflict_b"), F.col("a.document_id").alias("document_id"), F.col("a.status").alias("status"))
    return named.groupBy("conflict_a", "conflict_b").agg(F.when(F.max(F.col("status") == pending), pending).otherwise("confirmed").alias("status"), F.array_sort(F.collect_set("document_id")).alias("documents"))


def require_empty(rows: DataFrame, message: str) -> None:
    """Fail closed: raise before any write if a rule has violations."""
    if not rows.isEmpty():
        raise ValueError(message)


def rebuild(steps: dict[str, DataFrame], checks: list[tuple[str, DataFrame]], write: Callable[[str, DataFrame], None]) -> None:
    """Run all checks, then write every table."""
    for message, rows in checks:
        require_empty(rows, message)
    for name, rows in steps.items():
        write(name, rows)
