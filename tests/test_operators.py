"""The evidence-graph operators on small fixtures, and every query against its SQL."""

import pytest

from quillgraph.functions import text as X
from quillgraph.functions.fragment import folded_words, locate
from quillgraph.operators import audit, conflict, evidence, geo, layers, network, resolve
from quillgraph.operators.components import connected_components
from quillgraph.plans import graph, records  # noqa: F401
from quillgraph.plans import queries as plans
from quillgraph.sources import ingest
from quillgraph.streaming import resume

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = plans.QUERIES[name](spark, DATA)
    want = con.execute(plans.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain([r[n] for n in names] for r in got.collect()) == plain(want.fetchall())


def one(spark, value, f):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def test_normalisers_differ(spark):
    assert one(spark, "Edificio  Lote 18-A, Ñuñoa", X.norm_name) == "lote 18a nunoa"
    import unicodedata

    for value in ("A–B Nº ½ ß", "Torre…Norte", "a\u2009b\u202fc", "™ ㎏ éÉ", "αά́ 日本", "𝐀 ① ﬁn", "Á\u0301 e\u0301", "", None):
        folded = None if value is None else unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().lower()
        marks = None if value is None else "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
        assert one(spark, value, X.fold_ascii) == folded and one(spark, value, X.strip_marks) == marks
    assert one(spark, "Torre…Norte", X.norm_name) == "torre norte" and one(spark, "Torres 15-20", X.norm_name) == "torres 15 20" and one(spark, "Lote 18-A1", X.norm_name) == "lote 18a1"
    assert one(spark, "\u2003 a\tb\x1c\n", X.strip) == "a\tb"
    assert one(spark, "Etapa  2, fase-3 subetapa 4 etapa 5b FASE iv", X.stage_tokens) == ["etapa_2", "fase_iv"] == one(spark, "fase\tIV etapa 2", X.stage_tokens)
    assert one(spark, " 1,5", X.number_or_null) is None and one(spark, " -33.4 ", X.number_or_null) == -33.4
    assert [one(spark, v, X.spatial_precision) for v in ("Comuna", "Centro  Poblado", None, "plaza")] == ["commune", "neighborhood", "poi", "poi"]
    assert one(spark, " Ñuñoa  Centro ", X.norm_key) == "nunoa centro"
    assert one(spark, " Ñuñoa  Centro ", X.norm_plain) == "ñuñoa centro"
    assert one(spark, "Peña-Lolén", X.norm_geo) == "pena lolen"
    assert one(spark, "A y B / C", X.split_compound) == ["A", "B", "C"]
    assert one(spark, "Torre Etapa II", X.stage_tokens) == ["etapa_ii"]
    assert one(spark, "Amengual 480", X.trailing_numeral) == "480"


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5), (None, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 61), 100, 101, 200]], "node long")
    got = {r.node: r.component for r in connected_components(edges, nodes).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 200: 200}


def test_duplicate_groups_do_not_cross_documents(spark):
    rows = [("d", 0, "Torre", "", "exclude"), ("d", 1, "torre ", "a long quote here", "include"), ("d", 2, "", "long quote", None), ("d", 3, "other", "x", "include"), ("e", 0, "Torre", "", "include")]
    out = {(r.document_id, r.idx): r for r in conflict.duplicate_groups(spark.createDataFrame(rows, "document_id string, idx int, object_raw string, quote string, decision string")).collect()}
    assert out["d", 0].group_size == 3 and out["d", 0].canonical_idx == 1 and out["d", 0].mixed and out["d", 2].method == "ambos"
    assert out["d", 3].method == "single" and out["e", 0].group_size == 1


def test_case_groups_fail_closed(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    rel = spark.createDataFrame([("a", "b", "mismo_conflicto"), ("a", "zz", "mismo_conflicto")], "case_a string, case_b string, relation string")
    got = {r.case_id: r.conflict_id for r in conflict.case_groups(rel, cases).collect()}
    assert got["a"] == got["b"] != got["c"]
    with pytest.raises(ValueError):
        conflict.case_groups(spark.createDataFrame([("a", "b", "odd")], "case_a string, case_b string, relation string"), cases)


def test_constrained_groups():
    pairs = [("a", "b", True), ("b", "c", True), ("d", "e", None)]
    assert resolve.constrained_groups(pairs, {"a": "x#1", "c": "x#2"})["c"] == "c"
    with pytest.raises(ValueError):
        resolve.constrained_groups([("a", "b", True), ("b", "c", True), ("a", "c", False)], {})


def test_scope_gate(spark):
    base = {
        "decision": "include", "accion_contenciosa": "confirmada", "tipo_accion_contenciosa": "demanda", "tipo_objeto_norm": "edificio", "tipo_objeto_raw": "x", "es_proyecto_inmobiliario": "si",
        "es_proyecto_vivienda_inmobiliario": "si", "relacion_inmobiliaria_urbana": "desarrollo_proyecto", "precision_geografica": "comuna", "profundidad_documentacion_caso": "caso_principal", "comuna": "Ñuñoa",
        "tipo_conflicto_norm": "x", "via_legal_norm": "x", "evidencia_accion_quotes": ["the neighbours have sued"], "evidencia_objeto_quotes": ["a tower of 20 floors"], "evidencia_geografica_quotes": ["a street in the east"],
        "text": "The neighbours  have sued over a tower of 20 floors on a street in the east.",
    }
    cases = [base, base | {"decision": "exclude"}, base | {"comuna": "Elsewhere"}, base | {"evidencia_accion_quotes": ["never said in the text"]}, base | {"profundidad_documentacion_caso": "mencion_tangencial"}, base | {"tipo_objeto_norm": "objeto_no_determinado"}]
    schema = ", ".join(f"{k} {'array<string>' if k.endswith('quotes') else 'string'}" for k in base)
    rows = spark.createDataFrame([tuple(c.values()) for c in cases], schema).coalesce(1)
    out = evidence.scope_gate(rows, "inmobiliaria_urbana_amplia", ("edificio",), ("edificio",), (), {"nunoa": "13120"}).collect()
    assert [r.decision_final for r in out][:5] == ["include", "exclude", "exclude", "uncertain", "exclude"]


PLACES = [
    ("p1", "Villa Rosa", "Ñuñoa", "-33.1", "-70.1", "villa"), ("p2", "Parque Sur", "Ñuñoa", "-33.2", "-70.2", "parque"), ("p3", "Parque Sur", "Macul", "-33.3", "-70.3", "parque"), ("p4", "Plaza de la Luna", "Macul", "-33", "-70", "plaza"),
    ("p5", "Sin Punto", "Macul", "", "x", "x"), ("p6", "Doble", "Macul", "1", "1", "x"), ("p7", "Doble", "Renca", "", "", "x"), ("p8", "Las Rosas", "Renca", "1", "1", "comuna"),
]


@pytest.mark.parametrize(
    ("text", "area", "want"),
    [
        ("Villa Rosa", None, ("p1", 0, "literal", "neighborhood")), ("  villa-ROSA ", " ", ("p1", 0, "literal", "neighborhood")), ("Rosa", None, None), ("Rosas", None, None), ("Los vecinos, Villa Rosa", None, ("p1", 2, "fragment", "neighborhood")),
        ("Sector de Villa Rosa", None, ("p1", 1, "fragment", "neighborhood")), ("Sector Villa Rosa", None, None), ("Barrio de  Las Rosas", None, ("p8", 1, "fragment", "commune")), ("Parque Sur", None, None), ("Parque Sur", "NUNOA", ("p2", 0, "literal", "poi")),
        ("Parque Sur", "Renca", None), ("Villa Rosa", "Macul", None), ("Plaza Luna", None, ("p4", 0, "literal_de_variant", "poi")), ("plaza del Luna", "macul", ("p4", 0, "literal_de_variant", "poi")), ("Sin Punto", None, None), ("Doble", None, None),
        ("Doble", "Macul", ("p6", 0, "literal", "poi")), ("Sin Punto, Villa Rosa", None, ("p1", 2, "fragment", "neighborhood")), ("Parque Norte", None, None), ("Macul y Villa Rosa", None, ("p1", 2, "fragment", "neighborhood")), ("", None, None), (None, "Macul", None),
    ],
)
def test_gazetteer_cases(spark, text, area, want):
    places = spark.createDataFrame(PLACES, "place_id string, name string, area string, lat string, lon string, place_type string")
    texts = spark.createDataFrame([(1, text, area)], "id int, text string, area string")
    got = [(r.place_id, r.position, r.method, r.precision) for r in geo.gazetteer(texts, places, "id").collect()]
    assert got == ([want] if want else [])


def test_gazetteer_skips_names(spark):
    places = spark.createDataFrame(PLACES, "place_id string, name string, area string, lat string, lon string, place_type string")
    texts = spark.createDataFrame([(1, "Villa Rosa, Las Rosas")], "id int, text string")
    assert [r.place_id for r in geo.gazetteer(texts, places, "id", skip=("villa rosa",)).collect()] == ["p8"]


def test_mention_geography_cases(spark):
    schema = "k string, case_mention_id string, code string, included boolean, in_group boolean, reviewed_code string"
    rows = [
        ("none", None, "1", True, True, "9"), ("direct", "m", "1", True, False, None), ("direct in a group", "m", "1", True, True, "9"), ("ambiguous", "m", None, True, True, None), ("ambiguous, excluded", "m", "1", False, True, None),
        ("reviewed", "m", None, True, True, "9"), ("reviewed, excluded", "m", "1", False, True, "9"), ("not included", "m", "1", False, False, None), ("no code", "m", None, True, None, None),
    ]
    got = {r.k: (r.geo_status, r.geo_code) for r in geo.mention_geography(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "none": (geo.NO_INDEX, None), "direct": (geo.DIRECT, "1"), "direct in a group": (geo.DIRECT, "1"), "ambiguous": (geo.AMBIGUOUS, None), "ambiguous, excluded": (geo.AMBIGUOUS, None),
        "reviewed": (geo.REVIEWED, "9"), "reviewed, excluded": (geo.REVIEWED, "9"), "not included": (geo.NOT_INCLUDED, None), "no code": (geo.NO_CODE, None),
    }
    with pytest.raises(ValueError):
        geo.mention_geography(spark.createDataFrame([("x", "m", None, True, False, "9")], schema))


def test_duplicates_are_folded(spark):
    rows = [("d", 0, None, "La construcción ilegal", "include"), ("d", 1, "", "CONSTRUCCION  ilegal", "include"), ("d", 2, "Ótro", "corto", None), ("d", 3, "otro", None, None), ("e", 0, None, "construccion ilegal", None)]
    out = {(r.document_id, r.idx): r for r in conflict.duplicate_groups(spark.createDataFrame(rows, "document_id string, idx int, object_raw string, quote string, decision string")).collect()}
    assert out["d", 0].group_id == out["d", 1].group_id != out["d", 2].group_id == out["d", 3].group_id and out["d", 0].method == "quote_substring" and out["d", 2].method == "tipo_objeto_raw_exact"
    assert out["e", 0].group_size == 1 and len(out) == 5


def test_overlay_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    out = resolve.overlay(rows, spark.createDataFrame([(1, "x"), (2, "y")], "k int, value string"), ["k"], "v", only_null=True)
    assert {r.k: r.v for r in out.collect()} == {1: "x", 2: "b"}
    with pytest.raises(ValueError):
        resolve.overlay(rows, spark.createDataFrame([(1, "x"), (1, "y")], "k int, value string"), ["k"], "v")
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([StructField("a", IntegerType())])
    assert ingest.read_jsonl(spark, str(tmp_path / "r.jsonl"), schema).count() == 2
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        resume.available_now(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/cp", f"{tmp_path}/out", "k").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_audit(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    prints = [audit.fingerprint(r, ["k", "v"]).first().fingerprint for r in (rows, rows.orderBy("k", ascending=False), rows.limit(1))]
    assert prints[0] == prints[1] != prints[2]
    assert audit.field_names(spark.createDataFrame([], "a int, b array<struct<c:int>>").schema) == {"a", "b", "c"}
    assert audit.publication_gate("ok", rows.limit(0), rows.limit(0), {"x": ("1", "1")}, ("a", "a")) == []
    assert network.degrees(spark.createDataFrame([("x", "y", 1)], "a string, b string, weight int")).count() == 2


def test_phase_layer(spark):
    projects = spark.createDataFrame([(1, "Mall", "c1"), (2, "Mall Etapa II", "c1"), (3, "Centro Mall Etapa II", "c2"), (4, "Loteo Fase 1", None), (5, "Twin", "c"), (6, "Twin", "c")], "project_id long, name string, case_id string")
    parts = spark.createDataFrame([("Mall", "Mall Etapa II"), ("Mall", "Centro Mall Etapa II"), ("Mall", "Loteo Fase 1")], "matrix string, phase string")
    same = spark.createDataFrame([("Centro Mall Etapa II", "Mall Etapa II")], "a string, b string")
    phases, links = layers.phase_layer(projects, parts, same)
    assert {(r.phase_label, r.phase_number, r.case_id) for r in phases.collect()} == {("Mall Etapa II", "etapa_ii", "c1"), ("Loteo Fase 1", "fase_1", None)}
    assert sorted((r.project_id, r.relation_type) for r in links.collect()) == [(1, "has_phase"), (1, "has_phase"), (2, "same_phase_alias"), (3, "same_phase_alias"), (4, "represents_phase")]
    for odd in (("Mall", "Twin"), ("Mall", "Nowhere")):
        with pytest.raises(ValueError):
            layers.phase_layer(projects, spark.createDataFrame([odd], "matrix string, phase string"), same)


def test_overrides_fail_closed(spark):
    schema = "pair_id string, identity_class string, confidence string, rationale string"
    base = spark.createDataFrame([("p", "unresolved", None, None), ("q", "distinct_entities", "high", "x")], schema)
    out = {r.pair_id: r for r in layers.effective_adjudications(base, spark.createDataFrame([("p", "same_identity", "high", "y")], schema)).collect()}
    assert out["p"].identity_class == "same_identity" and out["p"].overridden and not out["q"].overridden and out["q"].rationale == "x"
    for odd in (("q", "same_identity", "high", "y"), ("p", "same_identity", "medium", "y"), ("zz", "unresolved", "high", "y"), ("p", "odd", "high", "y"), ("p", None, "high", "y"), ("p", "unresolved", "high", " ")):
        with pytest.raises(ValueError):
            layers.effective_adjudications(base, spark.createDataFrame([odd], schema))


def test_fragments_are_literal():
    text = "El  proyecto «Torre  Ñuñoa-Sur», ½ cuadra de Mall Vivo"
    assert locate(text, "torre nunoa sur") == (14, 30, "Torre  Ñuñoa-Sur", "normalized_full_mention")
    assert locate(text, "Centro Mall Vivo", None)[2:] == ("Mall Vivo", "normalized_literal_subphrase")
    assert locate(text, "Proyecto Azul") is None and locate(None, "x") is None and locate("", None) is None
    assert locate("Un edificio ubicado en el sector", "Edificio Ubicado Sector") is None, "no word of it tells a project"
    assert locate("Alto Parque, luego Bajo Parque", "Nuevo Alto Parque", "Bajo Parque Viejo")[2] == "Bajo Parque", "of equal runs the last"
    assert [w for w, _, _ in folded_words("Ñuñoa ½x")] == ["nunoa", "1", "2x"]


def test_fragments_equal_brute_force():
    import random

    from quillgraph.functions.fragment import telling

    rng, words = random.Random(3), "torre plan azul verde norte casa ubicado gran lago".split()
    for _ in range(300):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 12))]
        names = [[rng.choice(words) for _ in range(rng.randrange(1, 6))] for _ in range(2)]
        spot = lambda run, body=body: next((i for i in range(len(body) - len(run) + 1) if body[i : i + len(run)] == run), None)
        whole = next((n for n in names if spot(n) is not None), None)
        runs = [n[i:j] for n in names for i in range(len(n)) for j in range(i + 1, len(n) + 1) if telling(n[i:j]) and spot(n[i:j]) is not None]
        best = whole or max(runs, key=lambda r: (telling(r), len(r), len(" ".join(r)), spot(r)), default=None)
        got = locate(" ".join(body), *(" ".join(n) for n in names))
        assert (got and got[2]) == (best and " ".join(best))


def test_rank_correlation_chance(spark):
    import math

    for t in (0.0, 0.2, 1.5, 40.0):
        assert network.t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        assert network.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
    rows = lambda *r: network.spearman_test(spark.createDataFrame(r, "x int, y int"), "x", "y").first()
    four = rows((1, 1), (2, 3), (3, 2), (4, 4))
    assert four.rho == pytest.approx(0.8) and four.p == pytest.approx(0.2)
    assert rows((1, 1), (2, 2), (3, 3)).p == pytest.approx(0.0, abs=1e-6) and rows((1, 1), (2, 2)).p is None and rows((1, 1), (1, 2), (1, 3)).p is None


def test_review_pairs_meet_by_equality(spark):
    names = ["abcdef", "xabcdefx", "abcdefabcdef", "abcde", "zzzzzz", None]
    got = {(r.a, r.b) for r in resolve.review_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {("abcdef", "abcdefabcdef"), ("abcdef", "xabcdefx")}


def test_no_merge_and_homonyms(spark):
    cases = lambda *r: spark.createDataFrame(r, "project_id string, case_id string")
    before, after = cases(("p", "1"), ("q", "2"), ("r", "1")), cases(("p", "1"), ("q", "1"), ("r", "1"))
    pairs = spark.createDataFrame([("p", "q"), ("p", "r")], "a string, b string")
    assert [(r.a, r.b) for r in layers.rejoined_pairs(pairs, before, after).collect()] == [("p", "q")]
    assert layers.rejoined_pairs(pairs, before, before).isEmpty()
    rows = spark.createDataFrame([("k", "x", "1"), ("k", "y", "1"), ("m", "x", "1"), ("m", "y", "2"), ("n", None, "1")], "name_key string, part string, case_id string")
    assert [(r.name_key, r.n_parts, r.n_cases) for r in layers.reconnected_homonyms(rows).collect()] == [("k", 2, 1)]
