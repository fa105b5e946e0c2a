"""Actor networks: identity, projections, bipartite degrees, summaries, rank correlation, decomposition."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import norm_plain, stable_id, strip
from quillgraph.operators.components import connected_components, materialize
from quillgraph.operators.skew import BROADCAST_ROWS

# Fixed values.
ACTOR_SOURCES = ("enrichment_actor", "enrichment_institution", "actor_second_pass_v2")
INSTITUTIONAL_KINDS = ("municipio", "poder_judicial", "contraloria", "seremi_minvu", "consejo_monumentos_nacionales")
GENERIC_ACTORS = (
    "municipio", "el municipio", "la municipalidad", "municipalidad", "los vecinos", "vecinos", "vecinos de la comuna",
    "grupo de vecinos de esa comuna", "un grupo de vecinos de esa comuna", "residentes", "las familias", "familias", "la comunidad",
    "el gobierno", "la inmobiliaria", "las inmobiliarias", "inmobiliarias", "la empresa", "las empresas", "estado", "el estado",
)


def institutional(source: Column, kind: Column) -> Column:
    return F.when(source == "enrichment_institution", 1).when((source == "enrichment_actor") & kind.isin(*INSTITUTIONAL_KINDS), 1).when(source == "enrichment_actor", 0)


def tri_state(vote: str = "vote") -> Column:
    """No votes: null; otherwise whether the ones are at least the zeros."""
    ones, zeros = F.count_if(F.col(vote) == 1), F.count_if(F.col(vote) == 0)
    return F.when(ones + zeros > 0, ones >= zeros)


def generic_name(name: Column) -> Column:
    return name.isin(*GENERIC_ACTORS)


def load_rows(links: DataFrame, places: DataFrame, actors: DataFrame, place: str) -> DataFrame:
    """(document_id, nombre, place, source_table, es_institucional) of a view's links that name actors.

    ``places`` gives a project's case or conflict (project_id, place); ``actors`` (actor_id, tipo) the kind of those links whose source is
    an extracted actor. Events are no actors: their name is a description.
    """
    own = links.where(F.col("source_table").isin(*ACTOR_SOURCES)).join(places.select("project_id", place), "project_id")
    kinds = actors.select(F.col("actor_id").alias("source_id"), F.lit("enrichment_actor").alias("source_table"), F.col("tipo").alias("_tipo"))
    rows = own.join(kinds, ["source_table", "source_id"], "left")
    return rows.select("document_id", "nombre", place, "source_table", institutional(F.col("source_table"), F.col("_tipo")).alias("es_institucional"))


def annotate(rows: DataFrame, place: str) -> DataFrame:
    """Adds (actor_norm, actor): the normalised name, and the node's id, which ties a generic name to its place; blank names go."""
    named = rows.withColumn("actor_norm", norm_plain(F.col("nombre"))).where("actor_norm <> ''")
    return named.withColumn("actor", F.when(generic_name(F.col("actor_norm")), F.concat_ws("::", "actor_norm", F.col(place).cast("string"))).otherwise(F.col("actor_norm")))


def registry(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, entity_key, canonical_label, n_alias) and (nombre_norm, entity_id) from reviewed entities (entity_key, canonical_label, aliases array).

    A repeated key, an alias of two entities, and a generic name as alias raise.
    """
    if not entities.groupBy("entity_key").count().where("count > 1").isEmpty():
        raise ValueError("an entity key is repeated")
    ids = entities.withColumn("entity_id", F.concat(F.lit("entity:"), stable_id("actor", F.col("entity_key"))))
    aliases = ids.select("entity_id", F.explode(F.array_distinct(F.transform("aliases", norm_plain))).alias("nombre_norm")).where("nombre_norm <> ''")
    if not aliases.where(generic_name(F.col("nombre_norm"))).isEmpty():
        raise ValueError("a generic name can't be an alias")
    if not aliases.groupBy("nombre_norm").count().where("count > 1").isEmpty():
        raise ValueError("an alias belongs to two entities")
    counts = aliases.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_alias"))
    return ids.join(counts, "entity_id", "left").select("entity_id", "entity_key", "canonical_label", F.coalesce("n_alias", F.lit(0)).alias("n_alias")), aliases.select("nombre_norm", "entity_id")


def substitute(rows: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Annotated rows in which an alias stands for its entity: its id as node, its label as name, and institutional."""
    known = aliases.join(entities.select("entity_id", "canonical_label"), "entity_id").withColumnRenamed("nombre_norm", "actor_norm")
    out = rows.join(known, "actor_norm", "left")
    hit = F.col("entity_id").isNotNull()
    out = out.withColumns({"actor": F.coalesce("entity_id", "actor"), "nombre": F.coalesce("canonical_label", "nombre"), "es_institucional": F.when(hit, F.lit(1)).otherwise(F.col("es_institucional"))})
    return out.select(rows.columns)


def display_names(rows: DataFrame, name: str, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds (nombre, nombre_raw, identity_resolved, entity_id) for presentation: the entity's label, where the normalised name is an alias."""
    known = aliases.join(entities.select("entity_id", "canonical_label"), "entity_id", "left").select(F.col("nombre_norm").alias("_k"), "entity_id", F.coalesce("canonical_label", "nombre_norm").alias("_label"))
    raw = rows.withColumn("nombre_raw", F.col(name)).withColumn("_k", norm_plain(F.col(name)))
    out = raw.join(known, "_k", "left").withColumns({"nombre": F.coalesce("_label", "nombre_raw"), "identity_resolved": F.col("entity_id").isNotNull()})
    return out.drop("_k", "_label")


def nodes(rows: DataFrame) -> DataFrame:
    """(actor, label, es_institucional): the name it has most often (the first in order among equals), and the vote on its kind."""
    names = rows.groupBy("actor", strip(F.col("nombre")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    first = names.groupBy("actor").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("label"))
    return first.join(rows.groupBy("actor").agg(tri_state("es_institucional").alias("es_institucional")), "actor")


def resolve_actors(rows: DataFrame, aliases: DataFrame, actor: str = "actor", case: str = "case_id", generic: tuple[str, ...] = GENERIC_ACTORS) -> DataFrame:
    """Adds (node, label): registered aliases (name, entity_id, label) become their entity; generic names are tied to their case. All by normalised names; an alias given twice raises."""
    known = aliases.select(norm_plain(F.col("name")).alias("_k"), "entity_id", "label")
    if not known.groupBy("_k").count().where("count > 1").isEmpty():
        raise ValueError("an alias is repeated")
    out = rows.withColumn("_k", norm_plain(F.col(actor))).join(known, "_k", "left")
    own = F.when(F.col("_k").isin(*generic), F.concat_ws("::", "_k", F.col(case).cast("string"))).otherwise(F.col("_k"))
    return out.withColumn("node", F.coalesce("entity_id", own)).withColumn("label", F.coalesce("label", F.col(actor))).drop("_k")


#: Members of a place that pair up in one task, where the places of pairs are asked for or few pairs meet.
BLOCK = 512
#: Actors in a block of the grid in which shared places are counted, about; four bytes for each pair of two blocks are held by a task.
GRID = 4096
#: Pairs that a task handles at once.
SLAB = 1 << 20


def projection(rows: DataFrame, actor: str, place: str, documents: bool = False) -> DataFrame:
    """(a, b, weight[, places]), a < b: places (documents or cases) that two actors share.

    The result has every pair of a place by definition. Pairs are counted where two blocks of actors meet (``_grid``), so that members of places
    are shuffled and not pairs. Their places, or few pairs, are met by equality and shuffled.
    """
    if documents or not (grid := _grid(rows, actor, place)):
        return _met(rows, actor, place, documents)
    kind = rows.schema[actor].dataType.simpleString()
    found = grid.mapInArrow(_counted(1, False), f"a {kind}, b {kind}, weight long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")


def linked(rows: DataFrame, actor: str, place: str, least: int) -> DataFrame:
    """(a, b, links): edges with the components of the pairs that share ``least`` places or more; the sum of ``links`` is how many such pairs there are.

    Of two blocks of actors that meet no more than a star of each component is given, however many pairs are linked.
    """
    if not (grid := _grid(rows, actor, place)):
        return _met(rows, actor, place).where(F.col("weight") >= least).select("a", "b", F.lit(1).cast("long").alias("links"))
    kind = rows.schema[actor].dataType.simpleString()
    return grid.mapInArrow(_counted(least, True), f"a {kind}, b {kind}, links long")


def _met(rows: DataFrame, actor: str, place: str, documents: bool = False) -> DataFrame:
    """``projection`` by pairs that are shuffled: a place's members are dealt to blocks of about BLOCK by hash, and pairs of blocks meet by equality."""
    r = rows.select(F.col(actor).alias("_a"), F.col(place).alias("_p")).where("_a is not null and _p is not null").distinct()
    sizes = r.groupBy("_p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k"))
    dealt = r.join(sizes, "_p").withColumn("_i", F.pmod(F.xxhash64("_a"), F.col("_k")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_k") - 1)
    # blocks i <= j meet under (place, i, j): as the lower one and as the higher one
    low = dealt.select("_p", F.col("_a").alias("a"), F.col("_i"), F.explode(F.filter(every, lambda j: j >= F.col("_i"))).alias("_j"))
    high = dealt.select("_p", F.col("_a").alias("b"), F.explode(F.filter(every, lambda i: i <= F.col("_i"))).alias("_i"), F.col("_i").alias("_j"))
    met = low.join(high, ["_p", "_i", "_j"]).where("a <> b and (_i < _j or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "_p")
    about = [F.count(F.lit(1)).alias("weight"), *([F.array_sort(F.collect_list("_p")).alias("places")] if documents else [])]
    return met.groupBy("a", "b").agg(*about)


def _grid(rows: DataFrame, actor: str, place: str) -> DataFrame | None:
    """(i, j, side, names, x, y) sorted by (i, j, side) within partitions that hold whole (i, j): blocks i <= j of actors.

    Side 0 has the names of block i, side 1 those of block j; side 2 tells for each place which of them are there, as numbers of names.
    None if so few pairs meet in places that these rows would be more.
    """
    r = rows.select(F.col(actor).alias("_a"), F.col(place).alias("_p")).where("_a is not null and _p is not null")
    ids = r.select("_a").distinct()
    n, spark = ids.count(), rows.sparkSession
    k = max(-(-n // GRID), math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism)))
    c = F.col("_c").cast("double")
    sizes = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).agg(F.sum(c), F.sum(c * (c - 1) / 2)).first()
    if (sizes[1] or 0) <= (sizes[0] or 0) + n * k:
        return None
    blocks = ids.groupBy(F.pmod(F.xxhash64("_a"), F.lit(k)).cast("int").alias("_i")).agg(F.array_sort(F.collect_list("_a")).alias("names"))
    numbered = blocks.select("_i", F.posexplode("names").alias("_o", "_a")).withColumn("_o", F.col("_o").cast("short"))
    cells = r.join(F.broadcast(numbered) if n <= BROADCAST_ROWS else numbered, "_a").groupBy("_p", "_i").agg(F.sort_array(F.collect_set("_o")).alias("who"))
    places = cells.groupBy("_p").agg(F.collect_list(F.struct("_i", "who")).alias("cells"))
    low = places.select("cells", F.explode("cells").alias("x"))
    pairs = low.select("x", F.explode(F.filter("cells", lambda y: (y["_i"] > F.col("x._i")) | ((y["_i"] == F.col("x._i")) & (F.size("x.who") > 1)))).alias("y"))
    there = pairs.select(F.col("x._i").alias("i"), F.col("y._i").alias("j"), F.lit(2).alias("side"), F.lit(None).cast(blocks.schema["names"].dataType).alias("names"), F.col("x.who").alias("x"), F.col("y.who").alias("y"))
    none = F.lit(None).cast("array<short>")
    other = blocks.select("_i", "names", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_j"))
    named = other.select(F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), F.when(F.col("_i") <= F.col("_j"), 0).otherwise(1).alias("side"), "names", none.alias("x"), none.alias("y"))
    parts = min(k * (k + 1) // 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return named.unionByName(there).repartition(parts, "i", "j").sortWithinPartitions("i", "j", "side")


def _counted(least: int, stars: bool) -> Callable:
    """From the rows of a ``_grid``: the pairs that share ``least`` places or more and how many, or as ``stars`` edges with their components, the first with the number of pairs."""

    def rows_of(names: list[pa.Array], src: np.ndarray, dst: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names[0].take(pa.array(src)), names[1].take(pa.array(dst)), pa.array(n.astype(np.int64))], ["a", "b", "links" if stars else "weight"])

    def counts(held: list[np.ndarray], table: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if table is None:
            code, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            yield code[n >= least], n[n >= least]
            return
        for at in range(0, len(table), SLAB):
            code = np.flatnonzero(table[at : at + SLAB] >= least)
            yield code + at, table[at : at + SLAB][code]

    def of_blocks(names: list[pa.Array], same: bool, held: list[np.ndarray], table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        width, total = len(names[1]), 0
        root = np.arange(len(names[0]) + (0 if same else width))
        for code, n in counts(held, table):
            src, dst = np.divmod(code, width)
            if same:  # each pair is there twice
                n, src, dst = n[src < dst], src[src < dst], dst[src < dst]
            total += len(src)
            if stars:
                root = joined(root, src, dst if same else dst + len(names[0]))
                continue
            for at in range(0, len(src), 1 << 16):
                of = slice(at, at + (1 << 16))
                yield rows_of(names, src[of], dst[of], n[of])
        if total and stars:
            own = np.flatnonzero(root != np.arange(len(root)))
            every = [names[0] if same else pa.concat_arrays(names)] * 2
            yield rows_of(every, own, root[own], np.where(np.arange(len(own)) == 0, total, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, held, n, table = None, [], [], 0, None
        for batch in batches:
            i, j, side = (batch.column(c).to_numpy() for c in ("i", "j", "side"))
            (x, xs), (y, ys) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column("x"), batch.column("y")))
            for k in range(batch.num_rows):
                if (i[k], j[k]) != at:
                    if names:
                        yield from of_blocks(names, at[0] == at[1], held, table)
                    at, names, held, n, table = (i[k], j[k]), [], [], 0, None
                if side[k] < 2:
                    own = batch.column("names")[k].values
                    names += [own, own] if i[k] == j[k] else [own]
                    continue
                a, b = x[xs[k] : xs[k + 1]].astype(np.int64) * len(names[1]), y[ys[k] : ys[k + 1]].astype(np.int64)
                step = max(1, SLAB // len(b))
                for s in range(0, len(a), step):
                    code = (a[s : s + step, None] + b).ravel()
                    if table is not None:
                        table[code] += 1
                        continue
                    held.append(code)
                    n += len(code)
                    if n > len(names[0]) * len(names[1]) // 8:
                        table = np.zeros(len(names[0]) * len(names[1]), np.int32)
                        for c in held:
                            table[c] += 1  # a place has each pair once
                        held = []
        if names:
            yield from of_blocks(names, at[0] == at[1], held, table)

    return run


def joined(root: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The roots of components (each node's smallest) after the links from src to dst."""
    while len(src):
        a, b = root[src], root[dst]
        apart = a != b
        if not apart.any():
            break
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def bipartite(rows: DataFrame, actor: str, case: str, document: str) -> DataFrame:
    return rows.groupBy(actor, case).agg(F.countDistinct(document).alias("weight"))


def place_degrees(rows: DataFrame, actor: str, place: str) -> DataFrame:
    """(actor, degree): in how many places each actor is."""
    return rows.groupBy(F.col(actor).alias("actor")).agg(F.countDistinct(place).alias("degree"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def projection_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, m, density, components, largest, share): isolated nodes are components of their own; share is the largest one's, in per cent.

    ``edges`` (a, b) are the links, or those of ``linked`` (a, b, links), which tells their number and is read twice.
    """
    sizes = component_sizes(edges, nodes)
    about = sizes.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))
    m = edges.agg((F.coalesce(F.sum("links"), F.lit(0)) if "links" in edges.columns else F.count(F.lit(1))).alias("m"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    share = F.bround(F.col("largest") * 100.0 / F.nullif(F.col("n"), F.lit(0)), 1)
    return about.crossJoin(m).select("n", "m", F.coalesce(F.bround(F.col("m") / F.nullif(pairs, F.lit(0.0)), 5), F.lit(0.0)).alias("density"), "components", "largest", F.coalesce(share, F.lit(0.0)).alias("share"))


def component_sizes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, size) of the nodes' components."""
    groups = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), nodes)
    return groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def top_components(sizes: DataFrame, n: int = 10) -> DataFrame:
    return sizes.orderBy(F.desc("size"), "component").limit(n)


def top_degrees(degree: DataFrame, labels: DataFrame, n: int = 15) -> DataFrame:
    """(actor, label, degree) of the best connected, ties by id."""
    return degree.join(labels.select("actor", "label"), "actor").orderBy(F.desc("degree"), "actor").limit(n).select("actor", "label", "degree")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): which of two sets has each member: left, right or both."""
    x, y = a.select(key).distinct().withColumn("_x", F.lit(True)), b.select(key).distinct().withColumn("_y", F.lit(True))
    side = F.when(F.col("_x").isNull(), "right").when(F.col("_y").isNull(), "left").otherwise("both")
    return x.join(y, key, "full").select(key, side.alias("side"))


def kind_counts(labels: DataFrame) -> DataFrame:
    """(n_institutional, n_not_institutional, n_unclassified) of nodes."""
    kind = F.col("es_institucional")
    return labels.agg(F.count_if(kind).alias("n_institutional"), F.count_if(~kind).alias("n_not_institutional"), F.count_if(kind.isNull()).alias("n_unclassified"))


def bipartite_summary(rows: DataFrame, actor: str, place: str, document: str) -> DataFrame:
    """One row about an actor-place network: nodes, links, documents, and median, p90 and maximum of actors and of documents by place."""
    links = rows.select(actor, place).distinct()
    per = rows.groupBy(place).agg(F.countDistinct(actor).alias("n_actors"), F.countDistinct(document).alias("n_documents"))
    spread = per.agg(
        F.count(F.lit(1)).alias("n_places"), F.bround(F.median("n_actors"), 1).alias("actors_median"), F.max("n_actors").alias("actors_max"), F.bround(F.median("n_documents"), 1).alias("documents_median"),
    )
    base = rows.agg(F.countDistinct(actor).alias("n_actors"), F.countDistinct(document).alias("n_documents")).crossJoin(links.agg(F.count(F.lit(1)).alias("n_links")))
    return base.crossJoin(spread).crossJoin(grouped_p90(per, "n_actors").withColumnRenamed("p90", "actors_p90"))


def grouped_p90(rows: DataFrame, value: str) -> DataFrame:
    """(p90) of a column of whole numbers: the ninth of ten exclusive cuts, from the counts of its distinct values, so that no list of all values is made."""
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = counts.withColumn("_to", F.sum("_c").over(Window.orderBy("_v")))
    n = rows.agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_max"))
    spot = (F.col("_n") + 1) * 9
    j = F.least(F.greatest(F.floor(spot / 10), F.lit(1)), F.col("_n") - 1)
    at = lambda k: F.min(F.when(F.col("_to") >= k, F.col("_v")))
    cut = upto.crossJoin(F.broadcast(n)).groupBy("_n", "_max").agg(at(j).alias("_low"), at(j + 1).alias("_high"))
    delta = spot - j * 10
    p90 = F.when(F.col("_n") >= 10, (F.col("_low") * (10 - delta) + F.col("_high") * delta) / 10).otherwise(F.col("_max").cast("double"))
    return cut.select(F.bround(p90, 1).alias("p90"))


def exclusive_p90(values: Column) -> Column:
    """Ninth of ten exclusive quantile cuts of a sorted array; the maximum of fewer than ten values."""
    n = F.size(values)
    spot = (n + 1) * 9
    j = F.least(F.greatest(F.floor(spot / 10), F.lit(1)), n - 1).cast("int")
    delta = spot - j * 10
    cut = (F.element_at(values, j) * (10 - delta) + F.element_at(values, j + 1) * delta) / 10
    return F.when(n >= 10, cut).otherwise(F.array_max(values).cast("double"))


def _counts_before(counts: DataFrame, value: str, n: str) -> DataFrame:
    """(value, n, before): how many rows have smaller values, from the counts of distinct ones.

    Values are range-partitioned; the sums of the partitions, one number each, are added up by themselves.
    """
    sorted_ = materialize(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    parts = sorted_.groupBy("_part").agg(F.sum(n).alias("_s"))
    first = parts.withColumn("_first", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_first")
    within = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sorted_.withColumn("_within", within).join(F.broadcast(first), "_part").select(value, n, (F.col("_first") + F.col("_within")).alias("before"))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho): null for fewer than three pairs and where one side is constant. Ranks (ties averaged) come from counts of equal values; no task sorts them all."""
    ranked = pairs.groupBy(x, y).agg(F.count(F.lit(1)).alias("_n"))
    for c in (x, y):
        counts = _counts_before(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("_c")), c, "_c")
        ranked = ranked.join(counts.select(c, (F.col("before") + (F.col("_c") + 1) / 2.0).alias(f"_rank_{c}")), c)
    rx, ry, w = F.col(f"_rank_{x}"), F.col(f"_rank_{y}"), F.col("_n")
    sums = ranked.agg(F.sum("_n").alias("n"), *(F.sum(w * e).alias(k) for k, e in {"sx": rx, "sy": ry, "sxx": rx * rx, "syy": ry * ry, "sxy": rx * ry}.items()))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    # the mean rank is (n + 1) / 2 on both sides
    r = F.try_divide(F.col("sxy") - sx * sy / n, F.sqrt(F.col("sxx") - sx * sx / n) * F.sqrt(F.col("syy") - sy * sy / n))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(n >= 3, r).alias("rho"))


def t_two_sided(t: float, df: int) -> float:
    """Chance that Student's t with ``df`` degrees of freedom is at least as far from zero: the incomplete beta function by Lentz's continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    swapped = x > (a + 1) / (a + b + 2)
    if swapped:
        x, a, b = 1 - x, b, a
    if x <= 0:
        return 1.0 if swapped else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    tail = front * (f - 1)
    return 1 - tail if swapped else tail


def spearman_test(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho, p) of one row: p by Student's t with n - 2 degrees of freedom; null without a rho, 0 where it is 1 or -1."""

    def chance(n: pd.Series, rho: pd.Series) -> pd.Series:
        one = lambda k, r: None if r is None or r != r else 0.0 if abs(r) >= 1 - 1e-15 else t_two_sided(r * math.sqrt((k - 2) / (1 - r * r)), k - 2)
        return pd.Series([one(int(k), r) for k, r in zip(n, rho, strict=True)], dtype="float64")

    return spearman(pairs, x, y).withColumn("p", F.pandas_udf(chance, "double")("n", "rho"))


def decomposition(gate: DataFrame, collapse: DataFrame, both: DataFrame) -> DataFrame:
    """(actor, deltas) of degree tables (actor, degree): raw to gated, gated to collapsed; as conflicts only join cases, the latter is never positive (else it raises when read)."""
    joined = gate.withColumnRenamed("degree", "d0").join(collapse.withColumnRenamed("degree", "d1"), "actor").join(both.withColumnRenamed("degree", "d2"), "actor")
    fall = F.col("d2") - F.col("d1")
    checked = F.when(fall > 0, F.raise_error(F.lit("a conflict's degree exceeds the cases'")).cast("long")).otherwise(fall)
    return joined.select("actor", (F.col("d1") - F.col("d0")).alias("delta_gate"), checked.alias("delta_collapse"), (F.col("d2") - F.col("d0")).alias("delta_total"))


def decomposition_counts(deltas: DataFrame) -> DataFrame:
    """(n, unchanged, gate_only, collapse_only, both): which effect lowered how many actors' degrees."""
    g, c = F.col("delta_gate") < 0, F.col("delta_collapse") < 0
    return deltas.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("delta_total") == 0).alias("unchanged"), F.count_if(g & (F.col("delta_collapse") == 0)).alias("gate_only"),
        F.count_if((F.col("delta_gate") == 0) & c).alias("collapse_only"), F.count_if(g & c).alias("both"),
    )


def largest_falls(deltas: DataFrame, n: int = 15) -> DataFrame:
    return deltas.where("delta_total < 0").orderBy("delta_total", "actor").limit(n)


def consolidation(raw: DataFrame, resolved: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, canonical_label, degree, best_alias, gain): what an entity's degree (actor, degree) gains over its best single alias; aliases that the raw network lacks count 0."""
    best = aliases.join(raw.select(F.col("actor").alias("nombre_norm"), "degree"), "nombre_norm", "left").groupBy("entity_id").agg(F.max(F.coalesce("degree", F.lit(0))).alias("best_alias"))
    out = entities.select("entity_id", "canonical_label").join(resolved.select(F.col("actor").alias("entity_id"), "degree"), "entity_id").join(best, "entity_id", "left")
    top = F.coalesce("best_alias", F.lit(0))
    return out.select("entity_id", "canonical_label", "degree", top.alias("best_alias"), (F.col("degree") - top).alias("gain"))


def alias_breakdown(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, nombre_norm, degree): each alias's own degree, 0 where the raw network lacks it."""
    return aliases.join(raw.select(F.col("actor").alias("nombre_norm"), "degree"), "nombre_norm", "left").select("entity_id", "nombre_norm", F.coalesce("degree", F.lit(0)).alias("degree"))


def compare_networks(raw: DataFrame, resolved: DataFrame, entities: DataFrame) -> DataFrame:
    """(n_raw, n_resolved, n_untouched, n_same_degree): nodes (actor, degree) before and after identities are resolved, and how many of those that aren't entities kept their degree."""
    ids = entities.select(F.col("entity_id").alias("actor"))
    met = raw.join(resolved.withColumnRenamed("degree", "_d"), "actor").join(ids, "actor", "left_anti")
    same = met.agg(F.count(F.lit(1)).alias("n_untouched"), F.count_if(F.col("degree") == F.col("_d")).alias("n_same_degree"))
    return raw.agg(F.count(F.lit(1)).alias("n_raw")).crossJoin(resolved.agg(F.count(F.lit(1)).alias("n_resolved"))).crossJoin(same)


def entity_coverage(links: DataFrame, safe: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows by source and distinct documents of each entity in all ``links``, and distinct documents and conflicts in the ``safe`` ones (by their own rows, not by documents)."""
    of = lambda rows: rows.withColumn("nombre_norm", norm_plain(F.col("nombre"))).join(aliases, "nombre_norm")
    counted = of(links).groupBy("entity_id").agg(*(F.count_if(F.col("source_table") == t).alias(f"n_{t}") for t in ACTOR_SOURCES), F.countDistinct("document_id").alias("n_documents"))
    kept = of(safe).groupBy("entity_id").agg(F.countDistinct("document_id").alias("n_documents_safe"), F.countDistinct("conflict_id").alias("n_conflicts_safe"))
    out = entities.select("entity_id", "entity_key", "canonical_label").join(counted, "entity_id", "left").join(kept, "entity_id", "left")
    return out.na.fill(0, [*(f"n_{t}" for t in ACTOR_SOURCES), "n_documents", "n_documents_safe", "n_conflicts_safe"])


def network_report(rows: DataFrame, place: str) -> dict[str, DataFrame]:
    """The parts of a network's report from annotated rows (actor, nombre, place, document_id, es_institucional)."""
    rows = materialize(rows)
    labels = nodes(rows)
    places = rows.groupBy("actor").agg(F.countDistinct(place).alias("degree"))
    by_document, by_place = projection(rows, "actor", "document_id"), projection(rows, "actor", place)
    ids = labels.select(F.col("actor").alias("node"))
    out = {"bipartite": bipartite_summary(rows, "actor", place, "document_id"), "kinds": kind_counts(labels), "top_places": top_degrees(places, labels)}
    for name, edges in (("documents", by_document), ("places", by_place)):
        edges = materialize(edges)
        out[f"{name}_summary"] = projection_summary(edges, ids)
        out[f"{name}_top"] = top_degrees(degrees(edges).withColumnRenamed("node", "actor"), labels)
    return out


def compare_reports(a: dict[str, DataFrame], b: dict[str, DataFrame], degrees_a: DataFrame, degrees_b: DataFrame) -> dict[str, DataFrame]:
    """Two reports side by side: whose best connected actors are whose, and the rank correlation of degrees on common actors."""
    both = degrees_a.withColumnRenamed("degree", "x").join(degrees_b.withColumnRenamed("degree", "y"), "actor")
    return {"documents_top": overlap(a["documents_top"], b["documents_top"], "label"), "places_top": overlap(a["places_top"], b["places_top"], "label"), "ranks": spearman_test(both, "x", "y")}


def projection_without_institutions(rows: DataFrame, nodes: DataFrame, actor: str, place: str) -> DataFrame:
    """``exclude_institutions`` of a projection: the rows of confirmed institutions are left out before pairs are made, not the pairs after."""
    kept = nodes.where(~F.coalesce("es_institucional", F.lit(False))).select(F.col("node").alias(actor))
    return projection(rows.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, actor, "left_semi"), actor, place)


def exclude_institutions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The subgraph without confirmed institutions; null and false flags stay."""
    kept = nodes.where(~F.coalesce("es_institucional", F.lit(False))).select("node")
    return edges.join(kept.withColumnRenamed("node", "a"), "a", "left_semi").join(kept.withColumnRenamed("node", "b"), "b", "left_semi")
