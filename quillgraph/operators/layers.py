"""Reviewed layers over the graph: phases, typed relations, adjudications and historical references, checked before use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import norm_plain, stable_id, stage_tokens, strip
from quillgraph.operators.components import connected_components
from quillgraph.operators.conflict import require_empty

# Fixed values.
TOPOLOGY = ("mismo_conflicto", "conflictos_distintos")
MEMBERSHIP = ("focal", "contextual")
IDENTITY = ("mismo_proyecto",)
MOST_QUOTE_WORDS = 25
MERGE, NO_VERDICT = "same_identity", "unresolved"
KEPT_APART = ("distinct_entities", "parent_component_phase", "insufficient_evidence", "unresolved")


def phase_layer(projects: DataFrame, parts: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phases (phase_id, case_id, phase_label, phase_number) and links (project_id, phase_id, relation_type, evidence).

    ``projects`` has (project_id, name, case_id); reviewed pairs of names are ``parts`` (matrix, phase) and ``same``
    (a, b: one phase under two names). Names that no project or several projects have raise. A phase is named after
    the member that tells its stage, the shortest, then the first by name; its id derives from the smallest member.
    """
    used = parts.select(F.explode(F.array("matrix", "phase")).alias("name")).unionByName(same.select(F.explode(F.array("a", "b")).alias("name"))).distinct()
    known = projects.join(used, "name", "left_semi").select("name", "project_id", "case_id")
    require_empty(used.join(known, "name", "left_anti"), "a phase names a project that does not exist")
    require_empty(known.groupBy("name").count().where("count > 1"), "a phase names a project ambiguously")
    ids = lambda c, to: known.select(F.col("name").alias(c), F.col("project_id").alias(to))
    edges = same.join(ids("a", "src"), "a").join(ids("b", "dst"), "b")
    has = parts.join(ids("matrix", "project_id"), "matrix").join(ids("phase", "node"), "phase")
    nodes = has.select("node").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node")))
    groups = connected_components(edges.select("src", "dst"), nodes).withColumn("phase_id", F.concat(F.lit("phase:"), stable_id(F.col("component").cast("string"))))
    members = groups.join(known.withColumnRenamed("project_id", "node"), "node")
    first = F.struct(F.size(stage_tokens(F.col("name"))) == 0, F.length("name"), "name")
    about = members.groupBy("phase_id").agg(F.min_by("case_id", first).alias("case_id"), F.min("name").alias("_any"), F.min_by("name", first).alias("phase_label"), F.count(F.lit(1)).alias("_n"))
    number = F.nullif(F.array_join(stage_tokens(F.col("phase_label")), ","), F.lit(""))
    own = members.join(about.select("phase_id", "_n"), "phase_id").select(
        F.col("node").alias("project_id"), "phase_id", F.when(F.col("_n") > 1, "same_phase_alias").otherwise("represents_phase").alias("relation_type"), F.col("name").alias("evidence")
    )
    whole = has.join(groups.select("node", "phase_id"), "node").groupBy("project_id", "phase_id")
    reviewed = whole.agg(F.lit("has_phase").alias("relation_type"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(" -> ", "matrix", "phase"))), "; ").alias("evidence"))
    return about.select("phase_id", "case_id", "phase_label", number.alias("phase_number")), own.unionByName(reviewed.select(own.columns))


def relation_errors(relations: DataFrame, types: DataFrame, projects: DataFrame) -> DataFrame:
    """(subject_project_id, relation_type, object_project_id, errors) of the relations that break a rule."""
    key = ["subject_project_id", "relation_type", "object_project_id"]
    ids = projects.select("project_id").distinct().withColumn("_known", F.lit(True))
    told = lambda c: ids.select(F.col("project_id").alias(c), F.col("_known").alias(f"_{c}"))
    rows = relations.join(told(key[0]), key[0], "left").join(told(key[2]), key[2], "left")
    rows = rows.join(types.select("relation_type").distinct().withColumn("_typed", F.lit(True)), "relation_type", "left")
    rows = rows.join(relations.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), key, "left")
    texts = ("evidence_url", "source_title", "source_locator", "evidence_quote", "source_accessed_at")
    blank = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    rules: dict[str, Column] = {
        "self": F.col(key[0]) == F.col(key[2]),
        "repeated": F.col("_n") > 1,
        "unknown_type": F.col("_typed").isNull(),
        "unknown_project": F.col(f"_{key[0]}").isNull() | F.col(f"_{key[2]}").isNull(),
        **{f"no_{c}": blank(c) for c in texts},
        "not_https": ~blank("evidence_url") & ~F.startswith("evidence_url", F.lit("https://")),
        "long_quote": F.size(F.split(norm_plain(F.col("evidence_quote")), " ")) > MOST_QUOTE_WORDS,
        "not_verified": ~F.col("verification_status").eqNullSafe(F.lit("source_verified")),
        "odd_hash": F.col("source_sha256").isNotNull() & ~F.col("source_sha256").rlike("^[0-9a-f]{64}$"),
    }
    return rows.select(*key, F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items()))).alias("errors")).where(F.size("errors") > 0)


def typed_relations(relations: DataFrame, types: DataFrame, projects: DataFrame) -> DataFrame:
    """The relations with their relation_id; any broken rule raises."""
    require_empty(relation_errors(relations, types, projects), "a typed relation breaks a rule")
    return relations.withColumn("relation_id", F.concat(F.lit("project-rel:"), stable_id(F.col("subject_project_id"), F.col("relation_type"), F.col("object_project_id"), sep="::")))


def effective_adjudications(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """``base`` (pair_id, identity_class, confidence, rationale) with reviewed overrides of the same columns.

    An override names a pair of ``base`` that has no verdict, once; a merge needs high confidence, any other class one
    of ``KEPT_APART``, and each a confidence and a rationale. Otherwise it raises.
    """
    was = base.select("pair_id", F.col("identity_class").alias("_was"))
    met = overrides.join(was, "pair_id", "left")
    require_empty(base.groupBy("pair_id").count().where("count > 1"), "a pair is adjudicated twice")
    require_empty(overrides.groupBy("pair_id").count().where("count > 1"), "a pair is overridden twice")
    require_empty(met.where(~F.col("_was").eqNullSafe(F.lit(NO_VERDICT))), "an override replaces a verdict or names an unknown pair")
    merge = F.col("identity_class").eqNullSafe(F.lit(MERGE))
    apart = F.coalesce(F.col("identity_class").isin(*KEPT_APART), F.lit(False))
    sound = F.coalesce(F.col("confidence").isin("high", "medium") & (strip(F.col("rationale")) != ""), F.lit(False))
    require_empty(overrides.where(~(merge | apart)), "an override has an unknown class")
    require_empty(overrides.where(merge & ~F.col("confidence").eqNullSafe(F.lit("high"))), "a merge needs high confidence")
    require_empty(overrides.where(~sound), "an override lacks confidence or rationale")
    columns = ["identity_class", "confidence", "rationale"]
    new = overrides.select("pair_id", F.lit(True).alias("_over"), *(F.col(c).alias(f"_{c}") for c in columns))
    rows = base.join(new, "pair_id", "left")
    return rows.select("pair_id", *(F.when(F.col("_over"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns), F.coalesce("_over", F.lit(False)).alias("overridden"))


def adjudication_errors(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair_id, side, document_id, errors) of evidence anchors (pair_id, side, document_id, url, text_sha256, quote) that ``texts`` (document_id, url, text) do not bear out."""
    source = texts.select("document_id", F.col("url").alias("_url"), F.col("text").alias("_text"))
    rows = anchors.join(source, "document_id", "left")
    there = F.col("_text").isNotNull()
    rules = {
        "no_document": ~there,
        "other_text": there & ~F.sha2("_text", 256).eqNullSafe(F.col("text_sha256")),
        "other_url": there & ~F.col("_url").eqNullSafe(F.col("url")),
        "no_quote": strip(F.coalesce("quote", F.lit(""))) == "",
        "not_literal": there & ~F.coalesce(F.contains("_text", F.col("quote")), F.lit(False)),
    }
    return rows.select("pair_id", "side", "document_id", F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items()))).alias("errors")).where(F.size("errors") > 0)


def historical_references(relations: DataFrame, cases: DataFrame, aliases: DataFrame, non_resolvable: DataFrame) -> DataFrame:
    """References of relations (document_id, relation_index, relation, case_ids) to cases that no longer exist, classified.

    ``aliases`` (old, new) lead to present ``cases`` (case_id). What changes the topology blocks, unless the id is
    listed as ``non_resolvable`` (case_id); memberships and project identities are preserved; unknown relations block
    as a whole, under their first id. Gives (document_id, relation_index, relation, historical_case_id, impact_scope, blocking).
    """
    kind = F.col("relation")
    known = F.coalesce(kind.isin(*TOPOLOGY, *MEMBERSHIP, *IDENTITY), F.lit(False))
    keep = ["document_id", "relation_index", "relation"]
    ids = relations.where(known).select(*keep, F.explode("case_ids").alias("historical_case_id"))
    ids = ids.join(aliases.select(F.col("old").alias("historical_case_id"), "new"), "historical_case_id", "left").withColumn("case_id", F.coalesce("new", "historical_case_id"))
    gone = ids.join(cases.select("case_id"), "case_id", "left_anti")
    given_up = non_resolvable.select(F.col("case_id").alias("historical_case_id"), F.lit(True).alias("_given_up")).distinct()
    scope = (
        F.when(kind.isin(*MEMBERSHIP), "document_conflict_membership")
        .when(kind.isin(*IDENTITY), "project_identity_not_resolved")
        .when(F.col("_given_up"), "confirmed_non_resolvable_historical_reference")
        .otherwise("conflict_topology")
    )
    classed = gone.join(given_up, "historical_case_id", "left").select(*keep, "historical_case_id", scope.alias("impact_scope"))
    odd = relations.where(~known).select(*keep, F.get("case_ids", F.lit(0)).alias("historical_case_id"), F.lit("unknown_relation_fail_closed").alias("impact_scope"))
    return classed.unionByName(odd).withColumn("blocking", F.col("impact_scope").isin("conflict_topology", "unknown_relation_fail_closed"))


def reference_summary(references: DataFrame) -> DataFrame:
    """One row for each gone case: (historical_case_id, n, scopes, blocking)."""
    return references.groupBy("historical_case_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("impact_scope")).alias("scopes"), F.max("blocking").alias("blocking"))


def rejoined_pairs(kept_apart: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs (a, b) of a reviewed no-merge that ``before`` (project_id, case_id) had apart and ``after`` joins; must be empty."""
    case = lambda rows, c, to: rows.select(F.col("project_id").alias(c), F.col("case_id").alias(to))
    was = kept_apart.select("a", "b").join(case(before, "a", "a0"), "a").join(case(before, "b", "b0"), "b").where("a0 <> b0")
    return was.join(case(after, "a", "a1"), "a").join(case(after, "b", "b1"), "b").where("a1 = b1").select("a", "b")


def reconnected_homonyms(projects: DataFrame) -> DataFrame:
    """(name_key, n_parts, n_cases) of homonyms (name_key, part, case_id) with fewer cases than reviewed partitions; must be empty."""
    counts = projects.where("part is not null").groupBy("name_key").agg(F.countDistinct("part").alias("n_parts"), F.countDistinct("case_id").alias("n_cases"))
    return counts.where("n_cases < n_parts")


def resolution_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id, before, after, change) of the projects whose case_id a dry run adds, removes or moves."""
    old, new = before.select("project_id", F.col("case_id").alias("before")), after.select("project_id", F.col("case_id").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("moved")
    return old.join(new, "project_id", "full").where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", change)
