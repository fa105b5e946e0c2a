"""Entity resolution: exact-key clusters, review pairs and their decisions, associations, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import GENERIC_NAMES, fold_ascii, norm_key, norm_name, stable_id, stage_tokens, strip, trailing_numeral
from quillgraph.operators.conflict import require_empty


def registry(mentions: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Clusters of mentions (document_id, name) by normalised name, split by reviewed homonym partitions (key, document_id, part).

    (key, normalized_name, homonym_partition, n_documents, n_mentions, canonical_name, aliases, project_id). Every cluster of a
    split name has a partition: what the review names, or 'sin_particion' for the rest. The label is the most frequent name, of equals the shortest, then the first in order.
    """
    rows = mentions.withColumn("normalized_name", norm_name(F.col("name"))).where("normalized_name <> ''").withColumns({"key": F.col("normalized_name"), "homonym_partition": F.lit(None).cast("string")})
    if splits is not None:
        split = splits.select(F.col("key").alias("normalized_name"), "document_id", "part")
        names = splits.select(F.col("key").alias("normalized_name"), F.lit(True).alias("_split")).distinct()
        rows = rows.join(split, ["normalized_name", "document_id"], "left").join(names, "normalized_name", "left")
        rows = rows.withColumns({"key": F.concat("normalized_name", F.coalesce(F.concat(F.lit("#"), "part"), F.lit(""))), "homonym_partition": F.when(F.col("_split"), F.coalesce("part", F.lit("sin_particion")))})
    names = rows.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))
    label = names.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), F.length("name"), "name")).alias("canonical_name"), F.array_sort(F.collect_set("name")).alias("aliases"))
    counts = rows.groupBy("key", "normalized_name", "homonym_partition").agg(F.countDistinct("document_id").alias("n_documents"), F.count(F.lit(1)).alias("n_mentions"))
    return counts.join(label, "key").withColumn("project_id", stable_id("project", F.col("key")))


def review_pairs(names: DataFrame, least: int = 6) -> DataFrame:
    """(a, b), a < b: names of ``least`` characters or more of which one contains the other.

    Every name is cut into its runs of ``least`` characters; a name can only stand in those that have its first run,
    so candidates meet by equality and are then compared whole.
    """
    n = names.select("name").where(F.length("name") >= least).distinct()
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - least + 1), lambda i: F.col("name").substr(i, F.lit(least))))
    holder = n.select(F.col("name").alias("holder"), F.explode(runs).alias("run"))
    held = n.select(F.col("name").alias("held"), F.left("name", F.lit(least)).alias("run"))
    met = holder.join(held, "run").where((F.col("holder") != F.col("held")) & F.contains("holder", F.col("held")))
    return met.select(F.least("holder", "held").alias("a"), F.greatest("holder", "held").alias("b"))


def project_review_queue(projects: DataFrame, manual: DataFrame | None = None, least: int = 6) -> DataFrame:
    """(id_a, name_a, id_b, name_b, reason): projects (project_id, canonical_name, normalized_name) of which one normalised name contains the other, and reviewers' pairs (name_a, name_b, reason).

    A reviewers' pair of an unknown name is passed over, one of an ambiguous name raises, one that is queued already is not repeated.
    """
    p = projects.select("project_id", "canonical_name", F.col("normalized_name").alias("name"))
    side = lambda k, name: p.select(F.col("project_id").alias(f"id_{k}"), F.col("canonical_name").alias(f"name_{k}"), F.col("name").alias(name))
    found = review_pairs(p, least).join(side("a", "a"), "a").join(side("b", "b"), "b").select("id_a", "name_a", "id_b", "name_b", F.lit("substring_match_not_auto_merged").alias("reason"))
    if manual is None:
        return found
    per = p.groupBy("canonical_name").agg(F.countDistinct("project_id").alias("n"), F.min("project_id").alias("id"))
    met = manual
    for k in ("a", "b"):
        met = met.join(per.select(F.col("canonical_name").alias(f"name_{k}"), F.col("n").alias(f"n_{k}"), F.col("id").alias(f"id_{k}")), f"name_{k}")
    require_empty(met.where("n_a > 1 or n_b > 1"), "a name of a manual pair is ambiguous")
    unordered = lambda rows: rows.withColumns({"_lo": F.least("name_a", "name_b"), "_hi": F.greatest("name_a", "name_b")})
    new = unordered(met).join(unordered(found).select("_lo", "_hi").distinct(), ["_lo", "_hi"], "left_anti")
    return found.unionByName(new.select("id_a", "name_a", "id_b", "name_b", "reason"))


def queue_errors(queue: DataFrame, projects: DataFrame) -> DataFrame:
    """(id_a, id_b, errors): rows of a review queue that name unknown projects, other names than the projects have, themselves, or a pair again."""
    name = lambda k: projects.select(F.col("project_id").alias(f"id_{k}"), F.col("canonical_name").alias(f"_{k}"))
    rows = queue.join(name("a"), "id_a", "left").join(name("b"), "id_b", "left").withColumns({"_lo": F.least("id_a", "id_b"), "_hi": F.greatest("id_a", "id_b")})
    pairs = queue.groupBy(F.least("id_a", "id_b").alias("_lo"), F.greatest("id_a", "id_b").alias("_hi")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(pairs, ["_lo", "_hi"])
    unknown = F.col("_a").isNull() | F.col("_b").isNull()
    errors = F.array_compact(
        F.array(F.when(unknown, "unknown_project"), F.when(~unknown & ((F.col("_a") != F.col("name_a")) | (F.col("_b") != F.col("name_b"))), "other_name"), F.when(F.col("id_a") == F.col("id_b"), "self"), F.when(F.col("_n") > 1, "repeated"))
    )
    return rows.select("id_a", "id_b", errors.alias("errors")).where(F.size("errors") > 0).distinct()


def pair_decision(a: Column, b: Column) -> tuple[Column, Column]:
    """(same tri-state, reason): generic name, explicit stage, trailing numeral, otherwise open."""
    na, nb = strip(fold_ascii(a)), strip(fold_ascii(b))
    generic = na.isin(*GENERIC_NAMES) != nb.isin(*GENERIC_NAMES)
    stage = (F.size(stage_tokens(a)) + F.size(stage_tokens(b)) > 0) & (stage_tokens(a) != stage_tokens(b))
    numeral = trailing_numeral(a) != trailing_numeral(b)
    reason = F.when(generic, "generic_name").when(stage, "explicit_stage").when(numeral, "trailing_numeral").otherwise("open")
    return F.when(generic | stage, F.lit(False)).otherwise(F.lit(None).cast("boolean")), reason


def apply_adjudications(pairs: DataFrame, decided: DataFrame) -> DataFrame:
    """Pairs (a, b, same) overridden by decisions on the exact unordered pair; a pair decided twice raises."""
    d = decided.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("same").alias("decided"), F.lit(True).alias("_hit"))
    require_empty(d.groupBy("lo", "hi").count().where("count > 1"), "a pair is decided twice")
    keyed = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    return keyed.join(d, ["lo", "hi"], "left").withColumn("same", F.when(F.col("_hit"), F.col("decided")).otherwise(F.col("same"))).drop("lo", "hi", "decided", "_hit")


def decide_pairs(queue: DataFrame, by_id: DataFrame | None = None, by_name: DataFrame | None = None) -> DataFrame:
    """A review queue (id_a, name_a, id_b, name_b) with (same, reason).

    A decision on the exact pair of ids (a, b, same) is first. Where such decisions name the same two names under other ids,
    nothing is decided by name. Then come reviewers' decisions by the exact unordered pair of names (a, b, same), then the rules of ``pair_decision``.
    """
    same, reason = pair_decision(F.col("name_a"), F.col("name_b"))
    rows = queue.withColumns({"_same": same, "_reason": reason, "_lo": F.least("id_a", "id_b"), "_hi": F.greatest("id_a", "id_b"), "_nlo": F.least("name_a", "name_b"), "_nhi": F.greatest("name_a", "name_b")})
    take, value, why = F.lit(False), F.lit(None).cast("boolean"), F.lit(None).cast("string")
    if by_id is not None:
        d = by_id.select(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi"), F.col("same").alias("_id_same"), F.lit(True).alias("_id"))
        require_empty(d.groupBy("_lo", "_hi").count().where("count > 1"), "a pair is decided twice")
        rows = rows.join(d, ["_lo", "_hi"], "left")
        guarded = rows.where("_id").select("_nlo", "_nhi", F.lit(True).alias("_guard")).distinct()
        rows = rows.join(guarded, ["_nlo", "_nhi"], "left")
        take, value, why = F.coalesce("_id", "_guard", F.lit(False)), F.col("_id_same"), F.when(F.col("_id"), "exact_id").otherwise("same_names_other_ids")
    if by_name is not None:
        d = by_name.select(F.least("a", "b").alias("_nlo"), F.greatest("a", "b").alias("_nhi"), F.col("same").alias("_name_same"), F.lit(True).alias("_name"))
        require_empty(d.groupBy("_nlo", "_nhi").count().where("count > 1"), "a pair is decided twice")
        rows = rows.join(d, ["_nlo", "_nhi"], "left")
        value = F.when(take, value).otherwise(F.col("_name_same"))
        why = F.when(take, why).otherwise("manual_pair")
        take = take | F.coalesce("_name", F.lit(False))
    return rows.select(*(c for c in queue.columns if c not in ("same", "reason")), F.when(take, value).otherwise(F.col("_same")).alias("same"), F.when(take, why).otherwise(F.col("_reason")).alias("reason"))


def constrained_groups(pairs: list[tuple[str, str, bool | None]], partitions: dict[str, str], baseline: list[tuple[str, ...]] = ()) -> dict[str, str]:
    """{project: smallest member of its group}: baseline groups first, then decided pairs in sorted order, refusing merges that would join two partitions of one homonym; fail if a pair kept apart ends up joined.

    The decisions are a reviewed list of hundreds, so this order-dependent rule runs on the driver. ``partitions`` maps projects to '<name>#<part>'.
    """
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    held: dict[str, dict[str, str]] = {k: {v.partition("#")[0]: v} for k, v in partitions.items()}

    def merge(a: str, b: str) -> None:
        ra, rb = root(a), root(b)
        pa, pb = held.get(ra, {}), held.get(rb, {})
        if ra == rb or any(pb.get(k, v) != v for k, v in pa.items()):
            return
        low, high = sorted((ra, rb))
        parent[high] = low
        held[low] = pa | pb

    for group in baseline:
        for other in group[1:]:
            merge(group[0], other)
    for a, b in sorted((min(a, b), max(a, b)) for a, b, same in pairs if same):
        merge(a, b)
    for a, b, same in pairs:
        if same is False and root(a) == root(b):
            raise ValueError(f"{a} and {b} are kept apart but connected")
    return {x: root(x) for x in sorted({x for p in pairs for x in p[:2]} | {x for g in baseline for x in g})}


def name_cases(groups: dict[str, str], before: dict[str, str]) -> dict[str, str]:
    """{project: case}: a group keeps the case that most of its members had, ties to the first in order; new groups are named by their smallest member."""
    members: dict[str, list[str]] = {}
    for project, first in groups.items():
        members.setdefault(first, []).append(project)
    named = {}
    for first, own in members.items():
        had = [before[p] for p in own if p in before]
        named[first] = min(set(had), key=lambda c: (-had.count(c), c)) if had else first
    return {p: named[first] for p, first in groups.items()}


def simulate(queue: DataFrame, decisions: DataFrame | None, cases: DataFrame, partitions: dict[str, str]) -> DataFrame:
    """(project_id, before, after, change): what the decisions on a queue would change in the cases (project_id, case_id), without writing. The queue is a reviewed list that fits the driver."""
    decided = decide_pairs(queue, by_id=decisions).select("id_a", "id_b", "same").collect()
    rows = cases.collect()
    before = {r["project_id"]: r["case_id"] for r in rows if r["case_id"] is not None}
    held: dict[str, list[str]] = {}
    for project, case in sorted(before.items()):
        held.setdefault(case, []).append(project)
    groups = constrained_groups([tuple(r) for r in decided], partitions, [tuple(g) for g in held.values() if len(g) > 1])
    after = before | name_cases(groups, before)
    spark = queue.sparkSession
    now = spark.createDataFrame(sorted(after.items()), "project_id string, after string")
    out = cases.select("project_id", F.col("case_id").alias("before")).join(now, "project_id", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("moved")
    return out.where(~F.col("before").eqNullSafe(F.col("after"))).select("project_id", "before", "after", change.alias("change"))


def associations(links: DataFrame, mentions: DataFrame) -> DataFrame:
    """Links (link_id, document_id, raw) with (project_id, resolution_status) from mentions (document_id, name, project_id)."""
    known = mentions.groupBy("document_id", "name").agg(F.min("project_id").alias("explicit"))
    per = mentions.groupBy("document_id").agg(F.countDistinct("project_id").alias("n"), F.min("project_id").alias("only"))
    raw = strip(F.coalesce("raw", F.lit("")))
    rows = links.withColumn("name", raw).join(known, ["document_id", "name"], "left").join(per, "document_id", "left")
    status = (
        F.when((F.col("name") != "") & F.col("explicit").isNotNull(), "resolved_explicit")
        .when(F.col("name") != "", "unresolved_inconsistent_association")
        .when(F.col("n") == 1, "inferred_single_project")
        .when(F.coalesce("n", F.lit(0)) == 0, "unresolved_no_project")
        .otherwise("unresolved_ambiguous")
    )
    rows = rows.withColumn("resolution_status", status)
    return rows.withColumn("project_id", F.when(status == "resolved_explicit", F.col("explicit")).when(status == "inferred_single_project", F.col("only"))).drop("explicit", "n", "only", "name")


def link_view(links: DataFrame, units: DataFrame, inferred: bool = False) -> DataFrame:
    """Links of documents with one case whose association is explicit (or also inferred)."""
    wanted = ["resolved_explicit", "inferred_single_project"] if inferred else ["resolved_explicit"]
    return links.where(F.col("resolution_status").isin(*wanted)).join(units.where("unidad_caso_tipo = 'caso_unico'").select("document_id").distinct(), "document_id", "left_semi")


def link_sources(actors: DataFrame, institutions: DataFrame, events: DataFrame, second_pass: DataFrame) -> DataFrame:
    """(link_id, source_table, source_id, document_id, nombre, raw, source_pass): all that may be linked to a project. Rows of the second pass that the first has given again don't count."""
    second = second_pass.where(F.coalesce("source_pass", F.lit("second")) == "second").withColumn("source_pass", F.lit("second"))
    parts = [("enrichment_actor", actors), ("enrichment_institution", institutions), ("enrichment_event", events), ("actor_second_pass_v2", second)]
    out = None
    for table, rows in parts:
        turn = F.col("source_pass") if "source_pass" in rows.columns else F.lit("first")
        part = rows.select(F.lit(table).alias("source_table"), "source_id", "document_id", "nombre", "raw", turn.alias("source_pass"))
        out = part if out is None else out.unionByName(part)
    return out.select(stable_id("link", F.col("source_table"), F.coalesce("source_id", F.lit("")), F.coalesce("nombre", F.lit("")), F.col("source_pass")).alias("link_id"), "*")


def shared_documents(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, n_shared): documents that two projects of a pair are both mentioned in."""
    m = mentions.select("project_id", "document_id").distinct()
    of = lambda k: m.select(F.col("project_id").alias(f"id_{k}"), "document_id")
    met = pairs.select("id_a", "id_b").join(of("a"), "id_a").join(of("b"), ["id_b", "document_id"]).groupBy("id_a", "id_b").agg(F.countDistinct("document_id").alias("n_shared"))
    return pairs.select("id_a", "id_b").join(met, ["id_a", "id_b"], "left").select("id_a", "id_b", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def case_aliases(mapping: DataFrame) -> DataFrame:
    """(old, new, status) from (project, old, new); an old case that splits raises."""
    per = mapping.groupBy("old").agg(F.countDistinct("new").alias("n"), F.min("new").alias("new"))
    require_empty(per.where("n > 1"), "a case is split")
    shared = Window.partitionBy("new")
    return per.withColumn("status", F.when(F.count(F.lit(1)).over(shared) > 1, "merged").otherwise("preserved")).select("old", "new", "status")


def alias_errors(aliases: DataFrame, cases: DataFrame) -> DataFrame:
    """(old, errors) of aliases (old, new) that are repeated, lead to a case that doesn't exist, or to one that is itself replaced by another."""
    repeated = aliases.groupBy("old").agg(F.count(F.lit(1)).alias("_n"))
    known = cases.select(F.col("case_id").alias("new"), F.lit(True).alias("_known")).distinct()
    onward = aliases.where("old <> new").select(F.col("old").alias("new"), F.lit(True).alias("_onward")).distinct()
    rows = aliases.join(repeated, "old").join(known, "new", "left").join(onward, "new", "left")
    errors = F.array_compact(F.array(F.when(F.col("_n") > 1, "repeated"), F.when(F.col("_known").isNull(), "missing_target"), F.when(F.col("_onward") & (F.col("old") != F.col("new")), "chain")))
    return rows.select("old", errors.alias("errors")).where(F.size("errors") > 0).distinct()


def overlay(rows: DataFrame, decisions: DataFrame, key: list[str], column: str, only_null: bool = False, expected: str | None = None) -> DataFrame:
    """Keyed decisions (key, value[, expected]) over a column; repeated decision keys raise.

    ``only_null`` fills gaps alone. With ``expected`` it is compare-and-set: a row that has the new value already stays as it
    is, one with another value than the expected raises, as does a decision on a row that isn't there.
    """
    require_empty(decisions.groupBy(*key).count().where("count > 1"), "a decision is repeated")
    joined = rows.join(decisions.withColumn("_hit", F.lit(True)), key, "left")
    take = F.coalesce("_hit", F.lit(False))
    if only_null:
        take = take & F.col(column).isNull()
    if expected:
        require_empty(decisions.join(rows.select(*key).distinct(), key, "left_anti"), "a decision is on a row that isn't there")
        odd = take & ~F.col(column).eqNullSafe(F.col(expected)) & ~F.col(column).eqNullSafe(F.col("value"))
        require_empty(joined.where(odd), "a decision expected another value")
    return joined.withColumn(column, F.when(take, F.col("value")).otherwise(F.col(column))).select(rows.columns)


def fill_indexes(mentions: DataFrame, corrections: DataFrame, key: list[str], column: str = "case_mention_index") -> DataFrame:
    """Reviewed indexes (key, value) where a mention has none; each must meet exactly one row without an index."""
    met = mentions.where(F.col(column).isNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    require_empty(corrections.join(met, key, "left").where("coalesce(_n, 0) <> 1"), "a correction does not meet exactly one row")
    return overlay(mentions, corrections, key, column, only_null=True)


def descriptive_mentions(references: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions (document_id, name) without reviewed descriptive ones (document_id, name), which never become projects.

    A mention whose words are all among a descriptive reference's, in the same document, raises: it might be the project itself.
    """
    words = lambda c: F.array_distinct(F.split(norm_name(c), " "))
    r = references.select("document_id", norm_key(F.col("name")).alias("_k"), words(F.col("name")).alias("_r"))
    other = mentions.withColumns({"_k2": norm_key(F.col("name")), "_m": words(F.col("name"))}).join(r, "document_id").where((F.col("_k") != F.col("_k2")) & (norm_name(F.col("name")) != "") & (F.size(F.array_except("_m", "_r")) == 0))
    require_empty(other, "a mention's words are all in a descriptive reference")
    return mentions.withColumn("_k", norm_key(F.col("name"))).join(r.select("document_id", "_k").distinct(), ["document_id", "_k"], "left_anti").select(mentions.columns)


def eligible_mentions(included: DataFrame, adjudicated: DataFrame, quotes: DataFrame) -> DataFrame:
    """(case_mention_id): included ones, and those that a review adds for backing alone, whose quote (case_mention_id, quote) must be among the mention's own."""
    own = quotes.select("case_mention_id", "quote").distinct()
    require_empty(adjudicated.join(own, ["case_mention_id", "quote"], "left_anti"), "an eligibility decision's quote isn't the mention's")
    return included.select("case_mention_id").unionByName(adjudicated.select("case_mention_id")).distinct()


def disjoint_resolutions(resolved: DataFrame, gone: DataFrame) -> DataFrame:
    """Historical ids (case_id) that are both resolved and declared not to be; there should be none."""
    return resolved.select("case_id").intersect(gone.select("case_id"))


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): members of one set that the other lacks; none means equal sets."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def provenance(kind: str, *parts: str) -> Column:
    """A reference to where a decision is from: its kind and a hash of that and its columns as JSON."""
    body = F.to_json(F.struct(*parts))
    return F.concat_ws(":", F.lit(kind), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), body), 256), 1, 16))


def open_pairs(queue: DataFrame) -> DataFrame:
    return queue.where((F.coalesce("resolved", F.lit(0)) == 0) | (F.coalesce("decision", F.lit("")) == "needs_human_review"))
