"""Geography: compound names, resolved codes, gazetteer cascade, mention cascade, roll-ups. Ambiguity always abstains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import collapse, norm_geo, norm_key, number_or_null, spatial_precision, split_compound, strip

# Generic words before "de" and a place's own name; connectives that gazetteers write or leave out; what separates places.
PREFIXES = ("sector", "zona", "barrio")
CONNECTIVES = ("de la", "de los", "de las", "del", "de")
SEPARATORS = (",", " en ", " y ")
#: Statuses of a project mention's geography.
DIRECT, NO_INDEX, REVIEWED, AMBIGUOUS, NOT_INCLUDED, NO_CODE = "direct", "no_case_mention_index", "via_reviewed_duplicate_group", "ambiguous_duplicate_group", "case_mention_no_incluido", "case_mention_sin_comuna"


def place_codes(texts: Column, codes: dict[str, str]) -> Column:
    """Codes of an array of place structs (nombre, tipo): each with its code if it is a known comuna, and whether that puts it in the area (si, incierto)."""
    names = sorted(codes)

    def one(x: Column) -> Column:
        key = norm_key(x["nombre"])
        code = F.when(x["tipo"] == "comuna", F.coalesce(*(F.when(key == n, codes[n]) for n in names)))
        return F.struct(x["nombre"].alias("nombre"), x["tipo"].alias("tipo"), F.coalesce(code, F.lit("")).alias("codigo_comuna_ine"), F.when(code.isNotNull(), "si").otherwise("incierto").alias("en_area_estudio"))

    return F.transform(texts, one)


def backfill_compound(mentions: DataFrame, areas: DataFrame) -> DataFrame:
    """(mention_id, code): mentions without a code whose text names exactly one known area among its parts. ``areas``: (name, code)."""
    open_ = mentions.where((F.coalesce(F.col("code").cast("string"), F.lit("")) == "") & (F.coalesce("comuna", F.lit("")) != ""))
    parts = open_.select("mention_id", F.explode(split_compound(F.col("comuna"))).alias("part"))
    known = areas.select(norm_key(F.col("name")).alias("k"), F.col("code").alias("found"))
    hits = parts.join(known, norm_key(F.col("part")) == F.col("k")).groupBy("mention_id")
    return hits.agg(F.countDistinct("found").alias("n"), F.min("found").alias("code")).where("n = 1").select("mention_id", "code")


def resolved_codes(mentions: DataFrame, backfilled: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """(mention_id, code): a mention's own code, else the backfilled one; with ``areas`` (name, code) also its name, and only known codes count."""
    own = mentions.select("mention_id", F.when(F.col("code").cast("string") != "", F.col("code")).alias("own"))
    if areas is None:
        return own.join(backfilled, "mention_id", "left").select("mention_id", F.coalesce("own", "code").alias("code")).where("code is not null")
    named = areas.groupBy("code").agg(F.min("name").alias("name"))
    known = own.join(named.withColumnRenamed("code", "own"), "own").select("mention_id", F.col("own").alias("code"), "name")
    rest = backfilled.join(known.select("mention_id"), "mention_id", "left_anti").join(named, "code").select("mention_id", "code", "name")
    return known.unionByName(rest)


def collapse_articles(name: Column) -> Column:
    """A normalised name without connectives, longer ones before their beginnings."""
    return collapse(F.regexp_replace(name, rf"(?U)\b(?:{'|'.join(CONNECTIVES)})\b", " "))


def fragments(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "|".join(SEPARATORS)), strip), lambda p: p != ""))


def candidates(text: Column) -> Column:
    """Structs (place in the order of trials, normalised text): the whole text, then its other fragments, each followed by itself without a generic prefix where that is new."""
    whole = strip(F.coalesce(text, F.lit("")))
    every = F.concat(F.array(whole), F.filter(fragments(whole), lambda f: norm_geo(f) != norm_geo(whole)))
    plain = F.transform(every, norm_geo)
    bare = lambda c: F.regexp_extract(c, rf"(?iU)^(?:{'|'.join(PREFIXES)})\s+de\s+(.*)$", 1)
    derived = F.transform(every, lambda c: norm_geo(strip(bare(c))))
    # what a prefix hides is tried once, if no candidate or earlier prefix has given it
    new = F.transform(derived, lambda d, i: F.when((d != "") & ~F.array_contains(plain, d) & ~F.array_contains(F.slice(derived, F.lit(1), i), d), d))
    return F.array_compact(F.flatten(F.zip_with(plain, new, lambda c, d: F.array(c, d))))


def gazetteer(texts: DataFrame, places: DataFrame, text_id: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(text_id, place_id, position, method, normalized_text, lat, lon, precision, n_before, n_after) of the first candidate with exactly one place that has coordinates.

    ``texts`` (text_id, text[, area]): an area that isn't blank is a hard filter. ``places`` (place_id, name, area, lat,
    lon[, place_type]). Of each candidate its literal name is looked up, then, if that isn't unique, without connectives; places are
    counted before coordinates are looked at, so that a place without them makes its name ambiguous all the same, and
    a unique place without coordinates ends its candidate. Normalised names in ``skip`` are no candidates.
    """
    wanted = norm_geo(F.col("area").cast("string")) if "area" in texts.columns else F.lit("")
    asked = texts.select(text_id, wanted.alias("wanted"), F.posexplode(candidates(F.col("text"))).alias("position", "c")).where(~F.col("c").isin("", *skip))
    both = lambda name: F.array(F.struct(F.lit(0).alias("variant"), name.alias("k")), F.struct(F.lit(1).alias("variant"), collapse_articles(name).alias("k")))
    kind = F.col("place_type").cast("string") if "place_type" in places.columns else F.lit(None).cast("string")
    p = places.select("place_id", norm_geo(F.col("area").cast("string")).alias("area"), number_or_null(F.col("lat")).alias("lat"), number_or_null(F.col("lon")).alias("lon"), spatial_precision(kind).alias("precision"), F.explode(both(norm_geo(F.col("name")))).alias("x"))
    keys = p.select("place_id", "area", "lat", "lon", "precision", "x.variant", "x.k").where("k <> ''")
    tried = asked.select(text_id, "wanted", "position", "c", F.explode(both(F.col("c"))).alias("x")).select(text_id, "wanted", "position", "c", "x.variant", "x.k")
    met = tried.join(keys, ["variant", "k"])
    fits = (F.col("wanted") == "") | (F.col("wanted") == F.col("area"))
    found = met.groupBy(text_id, "position", "c", "variant").agg(F.count(F.lit(1)).alias("n_before"), F.count_if(fits).alias("n_after"), F.min(F.when(fits, F.struct("place_id", "lat", "lon", "precision"))).alias("p")).where("n_after = 1")
    # the literal name decides a candidate if it is unique
    literal = found.groupBy(text_id, "position").agg(F.min_by(F.struct("c", "variant", "n_before", "n_after", "p"), "variant").alias("b")).where("b.p.lat is not null and b.p.lon is not null")
    best = literal.groupBy(text_id).agg(F.min_by(F.struct("position", "b"), "position").alias("r")).select(text_id, "r.position", "r.b.*")
    method = F.concat(F.when(F.col("position") == 0, "literal").otherwise("fragment"), F.when(F.col("variant") == 1, "_de_variant").otherwise(""))
    return best.select(text_id, "p.place_id", "position", method.alias("method"), F.col("c").alias("normalized_text"), "p.lat", "p.lon", "p.precision", "n_before", "n_after")


def evidence_texts(evidence: DataFrame, areas: DataFrame) -> DataFrame:
    """Verified geographic quotes to look up: not blank, and not the bare name of an area."""
    quotes = evidence.where("quote_role = 'geografica' and verified = 1").withColumn("text", strip(F.col("quote_text"))).where("text <> ''")
    return quotes.withColumn("_k", norm_key(F.col("text"))).join(areas.select(norm_key(F.col("name")).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def within_areas(located: DataFrame, areas: DataFrame, area: str) -> DataFrame:
    """Located rows whose area is a known one: a unique name elsewhere is a namesake, not a place of the study."""
    return located.withColumn("_k", norm_key(F.col(area))).join(areas.select(norm_key(F.col("name")).alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def conflict_bridge(located: DataFrame, document_conflict: DataFrame) -> DataFrame:
    """(geocode_id, conflict_id): located rows (geocode_id, document_id) of documents with exactly one conflict."""
    return located.select("geocode_id", "document_id").join(single_value(document_conflict, "document_id", "conflict_id", "conflict_id"), "document_id").select("geocode_id", "conflict_id")


def geocode_report(n_total: int, texts: DataFrame, located: DataFrame, kept: DataFrame) -> DataFrame:
    """(precision, n, n_attempted, n_outside, n_total, rate): what the geocoder made of the quotes, a row for each precision."""
    attempted, found, inside = texts.count(), located.count(), kept.count()
    rate = F.bround(F.lit(float(inside)) / F.nullif(F.lit(float(attempted)), F.lit(0.0)), 3)
    return kept.groupBy("precision").agg(F.count(F.lit(1)).alias("n")).select("precision", "n", F.lit(attempted).alias("n_attempted"), F.lit(found - inside).alias("n_outside"), F.lit(n_total).alias("n_total"), F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mention_geography(mentions: DataFrame) -> DataFrame:
    """Adds (geo_status, geo_code) to mentions (case_mention_id, code, included, in_group, reviewed_code); the order of cases is their meaning.

    A mention that is included and has a code is direct, whatever its group. A reviewed code needs a group: one without raises.
    """
    grouped, reviewed = F.coalesce("in_group", F.lit(False)), F.col("reviewed_code").isNotNull()
    direct = F.coalesce("included", F.lit(False)) & F.col("code").isNotNull()
    indexed = F.col("case_mention_id").isNotNull()
    if not mentions.where(indexed & ~direct & ~grouped & reviewed).isEmpty():
        raise ValueError("a reviewed link points to a mention without a group")
    status = (
        F.when(~indexed, NO_INDEX)
        .when(direct, DIRECT)
        .when(grouped & ~reviewed, AMBIGUOUS)
        .when(reviewed, REVIEWED)
        .when(~F.coalesce("included", F.lit(False)), NOT_INCLUDED)
        .otherwise(NO_CODE)
    )
    return mentions.withColumn("geo_status", status).withColumn("geo_code", F.when(status == DIRECT, F.col("code")).when(status == REVIEWED, F.col("reviewed_code")))


def reviewed_link_errors(links: DataFrame, mentions: DataFrame, groups: DataFrame, resolved: DataFrame) -> DataFrame:
    """(project_mention_id, errors) of reviewed links (project_mention_id, document_id, source_case_mention_id, duplicate_group_id, resolved_case_mention_id, status) that don't fit the record.

    ``mentions`` (project_mention_id, document_id, case_mention_id), ``groups`` (case_mention_id, document_id, duplicate_group_id), ``resolved``
    (case_mention_id) of included mentions with a code. The resolved mention must be another member of the same group.
    """
    repeated = links.groupBy("project_mention_id").agg(F.count(F.lit(1)).alias("_n"))
    real = mentions.select("project_mention_id", F.col("document_id").alias("_doc"), F.col("case_mention_id").alias("_cm"))
    own = groups.select(F.col("case_mention_id").alias("_cm"), F.col("duplicate_group_id").alias("_g"))
    sibling = groups.select(F.col("case_mention_id").alias("resolved_case_mention_id"), F.col("duplicate_group_id").alias("_sg"), F.col("document_id").alias("_sd"))
    known = resolved.select(F.col("case_mention_id").alias("resolved_case_mention_id"), F.lit(True).alias("_ok")).distinct()
    rows = links.join(repeated, "project_mention_id").join(real, "project_mention_id", "left").join(own, "_cm", "left").join(sibling, "resolved_case_mention_id", "left").join(known, "resolved_case_mention_id", "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    found = F.array_compact(
        F.array(
            F.when(F.col("_n") > 1, "repeated"),
            F.when(~F.col("status").eqNullSafe("reviewed_geography_only"), "status"),
            F.when(~same("document_id", "_doc") | ~same("document_id", "_sd"), "document"),
            F.when(~same("source_case_mention_id", "_cm"), "mention"),
            F.when(F.col("_g").isNull() | ~same("duplicate_group_id", "_g") | ~same("duplicate_group_id", "_sg"), "group"),
            F.when(same("resolved_case_mention_id", "source_case_mention_id"), "itself"),
            F.when(F.col("_ok").isNull(), "unresolved"),
        )
    )
    return rows.select("project_mention_id", found.alias("errors")).where(F.size("errors") > 0).distinct()


def single_value(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): keys with exactly one distinct value."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(name)).where("_n = 1").drop("_n")


def document_area(mentions: DataFrame, document: str, code: str, name: str, order: str) -> DataFrame:
    """(document, code, name): documents of exactly one code, with the name that code was last seen under."""
    last = mentions.where(F.col(code).isNotNull()).groupBy(document, code).agg(F.max_by(name, order).alias(name))
    only = Window.partitionBy(document)
    return last.withColumn("_n", F.count(F.lit(1)).over(only)).where("_n = 1").select(document, code, name)


def projects_by_area(mentions: DataFrame, geography: DataFrame, code: str) -> DataFrame:
    """(code, n_projects): projects of the mentions (document_id, raw_name, project_id) whose geography (document_id, raw_name, code) is resolved."""
    met = mentions.join(geography.where(F.col(code).isNotNull()), ["document_id", "raw_name"])
    return met.groupBy(code).agg(F.countDistinct("project_id").alias("n_projects"))


def load_blocks(features: DataFrame) -> DataFrame:
    """Census blocks of a feature collection (properties, geometry): one row for each block id, the last given; ids are strings, counts numbers."""
    p = lambda name: F.col("properties")[name]
    rows = features.select(
        p("MANZENT").cast("string").alias("manzana_id"), p("CUT").cast("string").alias("codigo_comuna_ine"), p("COMUNA").alias("comuna"), p("COD_DISTRITO").cast("string").alias("cod_distrito"), p("DISTRITO").alias("distrito"),
        p("AREA_C").alias("area_c"), p("TIPO_MZ").alias("tipo_mz"), *(p(n).try_cast("int").alias(n) for n in ("n_per", "n_hog", "n_vp")), F.col("geometry").alias("geometry_json"), F.monotonically_increasing_id().alias("_at"),
    )
    return rows.groupBy("manzana_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("manzana_id", "_at"))), "_at").alias("r")).select("manzana_id", "r.*")


def block_totals(blocks: DataFrame) -> DataFrame:
    """(codigo_comuna_ine, n_blocks, population) by area."""
    return blocks.groupBy("codigo_comuna_ine").agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum("n_per"), F.lit(0)).alias("population"))


def rate_per_100k(n: Column, population: Column) -> Column:
    return F.bround(n.cast("double") / F.nullif(population, F.lit(0)) * 1e5, 2)
