"""Literal evidence: quote flags, repair, year grounding, record rules, the scope gate's layers, decision priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import host_of, norm_key, norm_plain, split_compound, strip, strip_marks
from quillgraph.operators.components import materialize
from quillgraph.operators.skew import BROADCAST_ROWS, join_frequent

MIN_QUOTE = 15
MIN_TEXT, MAX_TEXT = 200, 30_000
# Fixed values.
SOCIAL_HOSTS = ("x.com", "twitter.com", "t.co", "mobile.twitter.com")
SOCIAL_WALLS = ("post iniciar sesion registrate", "javascript no esta disponible")
SENTENCE_ENDS = (".", "!", "?", "…", '"', "'", "”", "’", ")", "]")
DECISIONS = {"include": 3, "uncertain": 2, "exclude": 1}
HARD_EXCLUDE = (
    "sin_accion_contenciosa",
    "objeto_fuera_de_alcance_residencial",
    "objeto_no_admisible",
    "objeto_existente_sin_vinculo_urbano",
    "fuera_del_area_geografica",
    "mencion_tangencial",
)


def literal_in(quote: Column, text: Column) -> Column:
    return F.contains(norm_plain(text), norm_plain(quote))


def _against(source: Column, items: Column, made) -> Column:
    """``made(item, source)`` for each item, with the source made once for all of them."""
    return F.element_at(F.transform(F.array(source), lambda own: F.transform(items, lambda x: made(x, own))), 1)


def quote_flags(quotes: Column, text: Column, normal: bool = False) -> Column:
    """For each quote: long enough and literally in the text (which may be normalised already)."""
    given = F.coalesce(quotes, F.array().cast("array<string>"))
    return _against(text if normal else norm_plain(text), given, lambda q, source: F.coalesce((F.length(strip(q)) >= MIN_QUOTE) & F.contains(source, norm_plain(q)), F.lit(False)))


def sufficient(flags: Column) -> Column:
    return F.exists(flags, lambda f: f)


def contract_valid(flags: Column) -> Column:
    return F.exists(flags, lambda f: f) & F.forall(flags, lambda f: f)


def repair_quotes(items: Column, text: Column, field: str = "cita", keep: tuple[str, ...] = ("nombre",)) -> Column:
    """Structs of ``keep`` and ``field``: a quote that is not literally in the text moves to <field>_original_modelo and leaves the field empty; <field>_verificada tells."""

    def fix(x: Column, source: Column) -> Column:
        quote = F.coalesce(x[field], F.lit(""))
        some = strip(quote) != ""
        ok = some & F.contains(source, norm_plain(quote))
        return F.struct(*(x[k].alias(k) for k in keep), F.when(some & ~ok, "").otherwise(quote).alias(field), F.when(some & ~ok, quote).alias(f"{field}_original_modelo"), ok.alias(f"{field}_verificada"))

    return _against(norm_plain(text), items, fix)


def year_grounded(date: Column, text: Column) -> Column:
    """The date's first four digits occur in the text as a word."""
    year = F.regexp_extract(strip(F.coalesce(date, F.lit(""))), r"^(\d{4})", 1)
    return (year != "") & F.array_contains(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b(\d{4})\b"), F.lit(1)), year)


def repair_events(items: Column, text: Column, keep: tuple[str, ...] = ("fecha", "descripcion")) -> Column:
    """Timeline structs with their year grounded and their own quote (evidencia_hito) repaired."""
    fixed = repair_quotes(items, text, "evidencia_hito", keep)
    return F.transform(fixed, lambda x: x.withField("fecha_year_grounded", year_grounded(x["fecha"], text)))


def clean_associations(items: Column, names: Column, keep: tuple[str, ...] = ("nombre",)) -> Column:
    """Structs with proyecto_asociado stripped; one that is no name of the record's projects moves to proyecto_asociado_original_modelo."""
    known = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), strip), lambda n: n.isNotNull() & (n != ""))

    def fix(x: Column) -> Column:
        own = strip(F.coalesce(x["proyecto_asociado"], F.lit("")))
        bad = (own != "") & ~F.array_contains(known, own)
        return F.struct(
            *(x[k].alias(k) for k in keep), F.when(bad, "").otherwise(own).alias("proyecto_asociado"), F.when(bad, own).alias("proyecto_asociado_original_modelo"), ((own != "") & ~bad).alias("proyecto_asociado_verificada")
        )

    return F.transform(items, fix)


def check_indexes(projects: Column, n_mentions: Column) -> Column:
    """Project structs (nombre, case_mention_index): an index outside 0 to n moves to case_mention_index_original_modelo; null is 'explicitly none'."""

    def fix(x: Column) -> Column:
        i = x["case_mention_index"]
        good = F.coalesce((i >= 0) & (i < n_mentions), F.lit(False))
        return F.struct(x["nombre"].alias("nombre"), F.when(good, i).alias("case_mention_index"), F.when(~good, i).alias("case_mention_index_original_modelo"), good.alias("case_mention_index_verificada"))

    return F.transform(projects, fix)


def record_errors(level: Column, fields: Column, reason: Column, checked: dict[str, tuple[Column, str]], single: dict[str, tuple[Column, Column]] | None = None) -> Column:
    """Names of the invariants that a record breaks.

    A review of level 'ninguno' has neither fields nor reason; what is marked as verified is not empty. ``checked`` maps
    a collection's name to its structs and the field to look at, ``single`` a field's name to (value, flag).
    """
    empty = F.array().cast("array<string>")
    none = F.coalesce(level == "ninguno", F.lit(False))
    found = [
        F.when(none & (F.size(F.coalesce(fields, empty)) > 0), F.array(F.lit("revision.campos_afectados"))).otherwise(empty),
        F.when(none & (F.coalesce(reason, F.lit("")) != ""), F.array(F.lit("revision.motivo"))).otherwise(empty),
    ]

    def empty_but_verified(name: str, field: str):
        return lambda x, i: F.when(F.coalesce(x[f"{field}_verificada"], F.lit(False)) & (strip(F.coalesce(x[field], F.lit(""))) == ""), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{field}")))

    for name, (items, field) in checked.items():
        found.append(F.coalesce(F.array_compact(F.transform(items, empty_but_verified(name, field))), empty))
    for name, (value, flag) in (single or {}).items():
        found.append(F.when(F.coalesce(flag, F.lit(False)) & (strip(F.coalesce(value, F.lit(""))) == ""), F.array(F.lit(name))).otherwise(empty))
    return F.concat(*found)


def maybe_truncated(items: Column, most: int) -> Column:
    """Whether a list is as long as its schema allows."""
    return F.coalesce(F.size(items), F.lit(0)) >= most


def social_truncation(url: Column, text: Column) -> Column:
    """Why a social post counts as cut, or an empty string."""
    own = strip(F.coalesce(text, F.lit("")))
    wall = F.lit(False)
    for marker in SOCIAL_WALLS:
        wall = wall | F.contains(strip_marks(F.lower(own)), F.lit(marker))
    return (
        F.when(~host_of(url).isin(*SOCIAL_HOSTS), "")
        .when(own == "", "sin_texto")
        .when(wall, "muro_login_capturado_en_vez_del_tuit")
        .when(~F.right(own, F.lit(1)).isin(*SENTENCE_ENDS), "texto_cortado_a_mitad_de_frase")
        .otherwise("")
    )


def eligibility(chars: Column, scope: Column, duplicate: Column, listed: Column, social: Column) -> Column:
    """A document's disposition; the order of the cases is their meaning."""
    return (
        F.when(F.coalesce(chars, F.lit(0)) < MIN_TEXT, "too_short")
        .when(scope == "legacy_sin_ventana", "legacy")
        .when(duplicate, "exact_duplicate")
        .when(~listed, "not_listed")
        .when(social != "", "social_truncated")
        .when(chars > MAX_TEXT, "too_long")
        .otherwise("eligible")
    )


def lineage_scope(origins: Column) -> Column:
    """Scope of an array of (periodo, nivel) origins."""
    whole = lambda o: (strip(F.coalesce(o["periodo"], F.lit(""))) != "") & (strip(F.coalesce(o["nivel"], F.lit(""))) != "")
    v2, legacy = F.exists(origins, whole), F.exists(origins, lambda o: ~whole(o))
    return F.when(v2 & legacy, "temporal_v2_mixed_legacy").when(v2, "temporal_v2").when(legacy, "legacy_sin_ventana").otherwise("unknown")


def decide(reasons: Column) -> Column:
    return F.when(F.arrays_overlap(reasons, F.array(*map(F.lit, HARD_EXCLUDE))), "exclude").when(F.size(reasons) > 0, "uncertain").otherwise("include")


SCOPES = ("residencial", "inmobiliaria_urbana_amplia")
LABELS = ("accion", "objeto", "geografica")
VETO = "inmueble_existente_sin_intervencion_urbana_formal"
#: Characters of a source in which a short place name counts as a geographic quote.
SHORT_QUOTE_SOURCE = 500


def _low(name: str) -> Column:
    return F.lower(strip(F.coalesce(F.col(name), F.lit(""))))


def base_reasons(scope: str, broad: tuple[str, ...], residential: tuple[str, ...], non_real_estate: tuple[str, ...], areas: dict[str, str], flags: dict[str, Column]) -> Column:
    """The reasons against a mention, in order: action, object, geography, depth, evidence (by the ``flags`` of its quotes)."""
    action, kind, obj = _low("accion_contenciosa"), _low("tipo_accion_contenciosa"), _low("tipo_objeto_norm")
    estate, home, relation = _low("es_proyecto_inmobiliario"), _low("es_proyecto_vivienda_inmobiliario"), _low("relacion_inmobiliaria_urbana")
    geo, depth, area = _low("precision_geografica"), _low("profundidad_documentacion_caso"), strip(F.coalesce("comuna", F.lit("")))
    narrow = F.lit(scope == "residencial")
    ok = obj.isin(*(residential if scope == "residencial" else broad)) & ((home == "si") if scope == "residencial" else ((estate == "si") | obj.isin(*non_real_estate)))
    rules = [
        F.when((action != "confirmada") | kind.isin("", "ninguna", "incierta"), F.when(action.isin("no", "ninguna"), "sin_accion_contenciosa").otherwise("accion_contenciosa_incierta")),
        F.when(~narrow & (relation == "ocupacion_propiedad_sin_desarrollo"), "objeto_existente_sin_vinculo_urbano")
        .when(ok, None)
        .when(narrow & (estate == "si") & (home == "no"), "objeto_fuera_de_alcance_residencial")
        .when(obj.isin("", "none", "objeto_no_determinado") | estate.isin("", "incierto"), "objeto_no_determinado")
        .otherwise("objeto_no_admisible"),
        F.when(geo == "fuera_de_area", "fuera_del_area_geografica")
        .when(geo.isin("", "ambigua", "provincia_general"), "geografia_incierta")
        .when((area != "") & ~norm_key(area).isin(*areas) & geo.isin("proyecto_exacto", "sector_barrio", "comuna"), "fuera_del_area_geografica"),
        F.when(depth == "mencion_tangencial", "mencion_tangencial").when(~depth.isin("caso_principal", "caso_secundario_documentado"), "caso_insuficientemente_documentado"),
        *(F.when(~sufficient(flags[k]), f"evidencia_{k}_no_verificada").when(~contract_valid(flags[k]), f"evidencia_{k}_contrato_invalido") for k in LABELS),
    ]
    return F.array_compact(F.array(*rules))


def existing_property_veto() -> Column:
    return (_low("relacion_inmobiliaria_urbana") == "inmueble_existente_relevancia_urbana") & (_low("tipo_conflicto_norm") == "ocupacion_propiedad") & _low("via_legal_norm").isin("", "none", "sin_via_identificada", "incierta")


def broad_exception(scope: str, quoted: Column) -> Column:
    """Whether an undetermined object passes in the broad scope: an explicit project with sufficient quotes of all kinds."""
    return (
        F.lit(scope == "inmobiliaria_urbana_amplia")
        & (_low("tipo_objeto_norm") == "objeto_no_determinado")
        & (_low("es_proyecto_inmobiliario") == "si")
        & _low("relacion_inmobiliaria_urbana").isin("desarrollo_proyecto", "transformacion_regulacion_uso", "inmueble_existente_relevancia_urbana")
        & quoted
        & (strip(F.coalesce("tipo_objeto_raw", F.lit(""))) != "")
    )


def in_area(areas: dict[str, str]) -> Column:
    """Whether a mention lies in the area: a known part of its comuna, or else a place of its list. ``areas`` maps folded names to codes."""
    names, codes = list(areas), sorted(set(areas.values()))
    places = F.filter(F.coalesce(F.col("lugares_mencionados"), F.array().cast("array<struct<nombre:string,tipo:string,codigo_comuna_ine:string>>")), lambda x: x["tipo"] == "comuna")
    named = lambda x: strip(F.coalesce(x["nombre"], F.lit("")))
    coded = F.exists(places, lambda x: F.coalesce(norm_key(named(x)).isin(*names) | strip(x["codigo_comuna_ine"]).isin(*codes), F.lit(False)))
    any_name = F.exists(places, lambda x: named(x) != "")
    parts = split_compound(F.col("comuna"))
    known = F.exists(parts, lambda x: norm_key(x).isin(*names))
    return (_low("precision_geografica") != "fuera_de_area") & F.when(F.size(parts) > 0, known | coded).otherwise(coded | any_name)


def short_quote_flags(areas: dict[str, str], source: Column, inside: Column) -> Column:
    """For each geographic quote: literal in a source (normalised here) of ``SHORT_QUOTE_SOURCE`` characters or more, and the name of one of the mention's places, in the area."""
    places = F.transform(F.coalesce(F.col("lugares_mencionados"), F.array().cast("array<struct<nombre:string,tipo:string,codigo_comuna_ine:string>>")), lambda x: norm_key(x["nombre"]))
    anchors = F.filter(F.concat(places, F.transform(split_compound(F.col("comuna")), norm_key)), lambda n: n != "")
    long = F.length(F.coalesce("text", F.lit(""))) >= SHORT_QUOTE_SOURCE
    quotes = F.coalesce(F.col("evidencia_geografica_quotes"), F.array().cast("array<string>"))
    named = _against(anchors, quotes, lambda q, own: (strip(q) != "") & F.array_contains(own, norm_key(strip(q))))
    literal = _against(source, quotes, lambda q, own: F.contains(own, norm_plain(q)))
    return F.when(long & inside, F.zip_with(named, literal, lambda a, b: F.coalesce(a & b, F.lit(False)))).otherwise(F.transform(quotes, lambda q: F.lit(False)))


def scope_gate(mentions: DataFrame, scope: str, broad: tuple[str, ...], residential: tuple[str, ...], non_real_estate: tuple[str, ...], areas: dict[str, str]) -> DataFrame:
    """Mentions with (gate_reasons, decision_final, short_geography_quote_accepted, quality_flags) after all layers of the gate.

    Layers: base rules; the existing-property veto; quote quality (reasons about single bad quotes go, the broad-object
    exception comes in); geography (short quotes of named places count, reasons they answer go, and the decision is made
    anew from the hard reasons, which the veto is not among). Only what the model includes is gated. ``mentions`` has the
    model's fields, ``text``, and lugares_mencionados (nombre, tipo, codigo_comuna_ine), which may be missing.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope}")
    if "lugares_mencionados" not in mentions.columns:
        mentions = mentions.withColumn("lugares_mencionados", F.lit(None).cast("array<struct<nombre:string,tipo:string,codigo_comuna_ine:string>>"))
    without = lambda reasons, gone, *names: F.filter(reasons, lambda r: ~(gone & r.isin(*names)))
    none = F.array().cast("array<string>")
    given = F.coalesce("decision", F.lit("uncertain"))
    gated = given == "include"
    # the source is normalised once, quotes are looked at once
    body = mentions.withColumns({"_body": norm_plain(F.col("text")), "_in": in_area(areas)})
    checked = body.withColumns({f"_{k}": quote_flags(F.col(f"evidencia_{k}_quotes"), F.col("_body"), normal=True) for k in LABELS} | {"_short": short_quote_flags(areas, F.col("_body"), F.col("_in"))}).drop("_body")
    rows = checked.withColumn("_base", base_reasons(scope, broad, residential, non_real_estate, areas, {k: F.col(f"_{k}") for k in LABELS}))
    enough = {k: sufficient(F.col(f"_{k}")) for k in LABELS}
    accepted = F.exists("_short", lambda f: f)
    geo = enough["geografica"] | accepted
    contract = F.array_except("_base", F.array(*(F.lit(f"evidencia_{k}_contrato_invalido") for k in LABELS)))
    quality = F.when(existing_property_veto(), F.concat(contract, F.array(F.lit(VETO)))).otherwise(without(contract, broad_exception(scope, enough["accion"] & enough["objeto"] & enough["geografica"]), "objeto_no_determinado"))
    placed = without(without(quality, F.col("_in"), "fuera_del_area_geografica"), geo, "evidencia_geografica_no_verificada")
    final = without(placed, broad_exception(scope, enough["accion"] & enough["objeto"] & geo), "objeto_no_determinado")
    used = {"accion": F.col("_accion"), "objeto": F.col("_objeto"), "geografica": F.when(accepted, F.col("_short")).otherwise(F.col("_geografica"))}
    unclean = F.array_compact(F.array(*(F.when(sufficient(f) & ~F.forall(f, lambda x: x), f"{k}_quote_set_not_fully_clean") for k, f in used.items())))
    out = rows.withColumns({"gate_reasons": F.when(gated, final).otherwise(none), "short_geography_quote_accepted": accepted, "quality_flags": unclean})
    out = out.withColumn("decision_final", F.when(gated, decide(F.col("gate_reasons"))).otherwise(given))
    return out.drop("_base", "_short", "_in", *(f"_{k}" for k in LABELS))


def document_decisions(mentions: DataFrame, universe: DataFrame, key: str, **rules) -> DataFrame:
    """(key, decision_residencial, decision_inmobiliaria_urbana_amplia, decision_documento): every mention through both scopes; the document has the broad one's."""
    by = {}
    for scope in SCOPES:
        gated = scope_gate(mentions, scope, **rules).select(key, F.col("decision_final").alias("decision"))
        by[scope] = best_decision(gated, universe, key).withColumnRenamed("decision", f"decision_{scope}")
    return by["residencial"].join(by["inmobiliaria_urbana_amplia"], key).withColumn("decision_documento", F.col("decision_inmobiliaria_urbana_amplia"))


def best_decision(mentions: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """(key, decision): include before uncertain before exclude; keys without mentions have insufficient_content."""
    rank = F.coalesce(*(F.when(F.col("decision") == d, r) for d, r in DECISIONS.items()), F.lit(0))
    top = mentions.groupBy(key).agg(F.max(rank).alias("r"))
    name = F.when(F.col("r") == 3, "include").when(F.col("r") == 2, "uncertain").when(F.col("r") == 1, "exclude").otherwise("insufficient_content")
    return universe.select(key).distinct().join(top, key, "left").select(key, name.alias("decision"))


#: Letters of the anchors of quotes without an inner word; a quote of MIN_QUOTE characters in two words has one of seven.
EDGE = 7


def _quote_anchors(quote: Column) -> Column:
    """What every text with the quote has among its words' anchors: the longest inner word whole; of two words the longer one's inner edge; of one word its first run of MIN_QUOTE letters."""
    parts = F.split(quote, " ")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    first, second = parts[0], F.get(parts, F.lit(1))
    two = F.when(F.length(second) >= EDGE, F.concat(F.lit("<"), F.left(second, F.lit(EDGE)))).otherwise(F.concat(F.lit(">"), F.right(first, F.lit(EDGE))))
    return F.when(F.size(parts) >= 3, F.concat(F.lit("="), longest)).when(F.size(parts) == 2, two).otherwise(F.concat(F.lit("~"), F.left(first, F.lit(MIN_QUOTE))))


def _word_anchors(word: Column, kinds: set[str]) -> Column:
    """The anchors of a text's word, of the kinds that quotes have."""
    none = F.array().cast("array<string>")
    made = {
        "=": F.array(F.concat(F.lit("="), word)),
        "<": F.when(F.length(word) >= EDGE, F.array(F.concat(F.lit("<"), F.left(word, F.lit(EDGE))))).otherwise(none),
        ">": F.when(F.length(word) >= EDGE, F.array(F.concat(F.lit(">"), F.right(word, F.lit(EDGE))))).otherwise(none),
        "~": F.when(F.length(word) >= MIN_QUOTE, F.transform(F.sequence(F.lit(1), F.length(word) - MIN_QUOTE + 1), lambda i: F.concat(F.lit("~"), word.substr(i, F.lit(MIN_QUOTE))))).otherwise(none),
    }
    return F.concat(*(made[k] for k in sorted(kinds)))


def literal_hits(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str) -> DataFrame:
    """(quote_id, text_id) where a quote of at least MIN_QUOTE characters is literally in a text (both normalised).

    Each quote has an anchor that stands among the words of every text with the quote, so candidates meet by equality on
    (text_id, anchor) rows, which carry no text. Up to BROADCAST_ROWS anchors are broadcast; beside more, those of many
    words are, and the rest is shuffled. Candidates then meet their texts once, one row for each text. Rows with a null
    id meet nothing.
    """
    q = materialize(quotes.select(F.col(quote_id).alias("_q"), norm_plain(F.col("text")).alias("quote")).where(F.col("_q").isNotNull() & (F.length("quote") >= MIN_QUOTE)).withColumn("anchor", _quote_anchors(F.col("quote"))))
    kinds = {r[0] for r in q.select(F.left("anchor", F.lit(1))).distinct().collect()}  # four at most
    if not kinds:
        return quotes.select(quote_id).join(texts.select(text_id).limit(0)).where("false")
    t = texts.select(F.col(text_id).alias("_t"), norm_plain(F.col("text")).alias("body")).where("_t is not null")
    words = t.select("_t", F.explode(F.array_distinct(F.split("body", " "))).alias("word")).select("_t", F.explode(_word_anchors(F.col("word"), kinds)).alias("anchor"))
    anchors = q.select("anchor", "_q")
    if anchors.count() <= BROADCAST_ROWS:
        near = words.join(F.broadcast(anchors), "anchor")
    else:
        counted = words.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        total = counted.agg(F.sum("n")).first()[0] or 0
        near = join_frequent(words, anchors.join(counted, "anchor"), "anchor", "n", total)
    met = near.select("_t", "_q").distinct().join(q.select("_q", "quote"), "_q")
    # a text with very many candidates is asked about them in parts
    asked = materialize(met.groupBy("_t", F.pmod(F.xxhash64("_q"), F.lit(8)).alias("part")).agg(F.collect_set(F.struct("_q", "quote")).alias("asked")).drop("part"))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS // 10 else asked
    found = t.join(asked, "_t").select("_t", F.explode(F.filter("asked", lambda x: F.contains(F.col("body"), x["quote"]))).alias("x"))
    return found.select(F.col("x._q").alias(quote_id), F.col("_t").alias(text_id)).distinct()
