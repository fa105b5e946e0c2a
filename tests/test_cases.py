"""Defined cases of the evidence-graph operators on small fixtures: overlays, registries, the gate, records, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.operators import audit, components, conflict, evidence, geo, nested, network, present, resolve, skew
from quillgraph.sources import files, ingest
from quillgraph.streaming import resume


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_frequent_keys_are_joined_apart(spark):
    rows = components.materialize(frame(spark, [(k, i) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)] + [(9, 0), (None, 0)], "k int, i int"))
    table = frame(spark, [(1, 50, "a"), (2, 3, "b"), (3, 1, "c"), (4, 0, "d")], "k int, n int, v string")
    want = sorted([(1, i, "a") for i in range(50)] + [(2, i, "b") for i in range(3)] + [(3, 0, "c")])
    for usual, most in ((1000, 200_000), (1000, 2), (5, 2)):
        got = skew.join_frequent(rows, table, "k", "n", 56, usual, most)
        assert sorted((r.k, r.i, r.v) for r in got.collect()) == want and "n" not in got.columns


def test_components_of_hubs_and_chains(spark, monkeypatch):
    import random

    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    table = frame(spark, edges, "src long, dst long")
    want = {x: root(x) for x in parent}
    assert {r.node: r.component for r in components.connected_components(table).collect()} == want
    monkeypatch.setattr(skew.join_frequent, "__defaults__", (5, 3))
    assert {r.node: r.component for r in components.connected_components(table).collect()} == want
    assert components.connected_components(table.limit(0)).count() == 0


def test_checkpoints_need_a_folder():
    from types import SimpleNamespace

    context = SimpleNamespace(getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError):
        components.materialize(SimpleNamespace(sparkSession=session))


def test_overlays_fail_closed(spark):
    rows = frame(spark, [(1, None), (2, "b"), (3, "c")], "k int, v string")
    swap = lambda *d: resolve.overlay(rows, frame(spark, d, "k int, value string, was string"), ["k"], "v", expected="was")
    assert {r.k: r.v for r in swap((2, "x", "b"), (3, "c", "old")).collect()} == {1: None, 2: "x", 3: "c"}, "a value that is there already stays"
    for odd in ([(2, "x", "z")], [(9, "x", "b")], [(2, "x", "b"), (2, "y", "b")]):
        with pytest.raises(ValueError):
            swap(*odd)
    mentions = frame(spark, [("d", "a", None), ("d", "b", 1), ("e", "a", None), ("e", "a", None)], "document_id string, name string, case_mention_index int")
    fix = lambda *d: resolve.fill_indexes(mentions, frame(spark, d, "document_id string, name string, value int"), ["document_id", "name"])
    assert sorted((r.document_id, r.name, r.case_mention_index) for r in fix(("d", "a", 4)).where("document_id = 'd'").collect()) == [("d", "a", 4), ("d", "b", 1)]
    for odd in (("d", "b", 3), ("e", "a", 3), ("z", "a", 3)):
        with pytest.raises(ValueError):
            fix(odd)


def test_descriptive_and_eligible_mentions(spark):
    mentions = frame(spark, [("d", "Las torres del barrio alto"), ("d", "Mall Sur"), ("e", "torres barrio")], "document_id string, name string")
    refs = frame(spark, [("d", "LAS TORRES del  barrio alto")], "document_id string, name string")
    assert sorted((r.document_id, r.name) for r in resolve.descriptive_mentions(refs, mentions).collect()) == [("d", "Mall Sur"), ("e", "torres barrio")]
    with pytest.raises(ValueError):
        resolve.descriptive_mentions(refs, mentions.unionByName(frame(spark, [("d", "Torres Alto")], "document_id string, name string")))
    ids = lambda *i: frame(spark, [(x,) for x in i], "case_mention_id string")
    quotes = frame(spark, [("m1", "q1"), ("m2", "q2")], "case_mention_id string, quote string")
    assert sorted(r.case_mention_id for r in resolve.eligible_mentions(ids("m0"), frame(spark, [("m1", "q1")], quotes.schema), quotes).collect()) == ["m0", "m1"]
    with pytest.raises(ValueError):
        resolve.eligible_mentions(ids("m0"), frame(spark, [("m1", "q2")], quotes.schema), quotes)
    assert [r.case_id for r in resolve.disjoint_resolutions(frame(spark, [("a",), ("b",)], "case_id string"), frame(spark, [("b",)], "case_id string")).collect()] == ["b"]


def test_registry_collisions(spark):
    schema = "entity_key string, canonical_label string, aliases array<string>"
    entities, aliases = network.registry(frame(spark, [("k", "K", ["A b", " a  B", "c"]), ("m", "M", None)], schema))
    assert {r.entity_key: r.n_alias for r in entities.collect()} == {"k": 2, "m": 0} and sorted(r.nombre_norm for r in aliases.collect()) == ["a b", "c"]
    for odd in ([("k", "K", ["a"]), ("k", "K", ["b"])], [("k", "K", ["a"]), ("m", "M", [" A"])], [("k", "K", ["Los  VECINOS"])]):
        with pytest.raises(ValueError):
            network.registry(frame(spark, odd, schema))
    with pytest.raises(ValueError):
        network.resolve_actors(frame(spark, [("a", "c")], "actor string, case_id string"), frame(spark, [("a", "1", "x"), (" A", "2", "y")], "name string, entity_id string, label string"))


def test_generic_names_never_bridge_cases(spark):
    rows = frame(spark, [("d1", " Los  Vecinos", "c1", 0), ("d1", "Ana", "c1", None), ("d2", "los vecinos", "c2", None), ("d2", "ANA ", "c2", None), ("d2", "  ", "c2", 1)], "document_id string, nombre string, case_id string, es_institucional int")
    own = network.annotate(rows, "case_id")
    assert sorted({r.actor for r in own.collect()}) == ["ana", "los vecinos::c1", "los vecinos::c2"]
    places = {r.actor: r.degree for r in network.place_degrees(own, "actor", "case_id").collect()}
    assert places == {"ana": 2, "los vecinos::c1": 1, "los vecinos::c2": 1}
    report = network.network_report(own, "case_id")
    assert report["documents_summary"].first().components == 1 and report["bipartite"].first().n_links == 4 and report["kinds"].first().n_unclassified == 2
    side = network.compare_reports(report, report, network.place_degrees(own, "actor", "case_id"), network.place_degrees(own, "actor", "case_id"))
    assert {r.side for r in side["documents_top"].collect()} == {"both"} and side["ranks"].first().n == 3


@pytest.mark.parametrize("block", [512, 3])
def test_projection_equals_brute_force(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(network, "BLOCK", block)
    rng = random.Random(2)
    rows = [(rng.randrange(25), rng.randrange(4) if i % 2 else 0) for i in range(120)] + [(None, 1), (3, None)]
    got = {(r.a, r.b): (r.weight, r.places) for r in network.projection(frame(spark, rows, "who int, place int"), "who", "place", documents=True).collect()}
    seen = {p: sorted({a for a, q in rows if q == p and a is not None}) for p in {q for _, q in rows if q is not None}}
    want = {}
    for p in sorted(seen):
        for i, a in enumerate(seen[p]):
            for b in seen[p][i + 1 :]:
                want.setdefault((a, b), []).append(p)
    assert got == {k: (len(v), v) for k, v in want.items()}


@pytest.mark.parametrize("grid", [4096, 5])
def test_pairs_are_counted_before_they_are_shuffled(spark, monkeypatch, grid):
    """Dense places by the grid, of long and string actors: brute force's pairs and components, and no exchange by pair."""
    import random

    monkeypatch.setattr(network, "GRID", grid)
    rng = random.Random(3)
    seen = [(rng.randrange(60) // (1 + p % 3), p) for p in range(30) for _ in range(90)]
    rows = seen + [(None, 1), (3, None), (900, 77), (901, 78), (901, 78)]
    by = {p: sorted({a for a, q in seen if q == p}) for p in range(30)}
    want = {}
    for own in by.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    table = frame(spark, rows, "who long, place int")
    for shown in (F.col("who"), F.format_string("n%03d", "who")):
        edges = network.projection(table.withColumn("who", F.when(F.col("who").isNotNull(), shown)), "who", "place")
        assert "hashpartitioning(a#" not in edges._jdf.queryExecution().executedPlan().toString()
        key = (lambda a: a) if edges.schema["a"].dataType.simpleString() == "bigint" else (lambda a: f"n{a:03d}")
        assert {(r.a, r.b): r.weight for r in edges.collect()} == {(key(a), key(b)): n for (a, b), n in want.items()} and edges.count() == len(want)
    nodes = table.where("who is not null").select(F.col("who").alias("node")).distinct()
    kinds = nodes.withColumn("es_institucional", F.when(F.col("node") % 3 == 0, True).when(F.col("node") % 3 == 1, False))
    kept = network.projection_without_institutions(table, kinds, "who", "place").collect()
    assert {(r.a, r.b): r.weight for r in kept} == {p: n for p, n in want.items() if p[0] % 3 and p[1] % 3}
    for least in (1, 12) if grid == 5 else (24,):
        far = [p for p, n in want.items() if n >= least]
        parent = {r.node: r.node for r in nodes.collect()}
        for a, b in far:
            x, y = parent[a], parent[b]
            parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
        links = network.linked(table, "who", "place", least)
        sizes = {r.component: r["size"] for r in network.component_sizes(links, nodes).collect()}
        assert sizes == {c: list(parent.values()).count(c) for c in set(parent.values())}
        summary = network.projection_summary(links, nodes).first()
        assert (summary.m, summary.n, summary.components) == (len(far), len(parent), len(sizes))
    assert network.projection(frame(spark, [(1, 1), (2, 1), (5, 2)], "who int, place int"), "who", "place").collect() == [(1, 2, 1)], "few pairs"
    assert network.linked(frame(spark, [], "who int, place int"), "who", "place", 1).count() == 0


def test_ranks_and_waves_are_spread(spark):
    import random

    rng = random.Random(1)
    xs = [(i, rng.randrange(9), rng.randrange(9)) for i in range(200)]
    rank = lambda values: [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]
    a, b = rank([x for _, x, _ in xs]), rank([y for _, _, y in xs])
    mean = lambda v: sum(v) / len(v)
    cov = sum((p - mean(a)) * (q - mean(b)) for p, q in zip(a, b, strict=True))
    rho = cov / (sum((p - mean(a)) ** 2 for p in a) * sum((q - mean(b)) ** 2 for q in b)) ** 0.5
    assert network.spearman(frame(spark, xs, "i int, x int, y int"), "x", "y").first().rho == pytest.approx(rho)
    for values in ([3], list(range(9)), list(range(10)), [1] * 30, [rng.randrange(100) for _ in range(57)]):
        import statistics

        want = round(statistics.quantiles(values, n=10)[8], 1) if len(values) >= 10 else max(values)
        assert network.grouped_p90(frame(spark, [(v,) for v in values], "v int"), "v").first().p90 == pytest.approx(want)
    rows = [(i, i % 7 + 1.0, "one") for i in range(60)] + [(100 + i, 2.0, "two") for i in range(5)]
    out = audit.budget_waves(frame(spark, rows, "i int, cost double, g string"), "i", "cost", 4, 40.0, "g").collect()
    want = []
    for g in ("one", "two"):
        own, spent = [r for r in rows if r[2] == g], 0.0
        for w in range(0, len(own), 4):
            if spent >= 40:
                break
            want += [(r[0], w // 4, spent) for r in own[w : w + 4]]
            spent += sum(r[1] for r in own[w : w + 4])
    assert sorted((r.i, r.wave, r.spent_before) for r in out) == sorted(want)
    assert audit.budget_waves(frame(spark, rows[:9], "i int, cost double, g string"), "i", "cost", 4, 10.0).count() == 4


def test_verified_index_and_roles_fail_closed(spark):
    rows = lambda *r: frame(spark, r, "document_id string, name string, case_mention_index int")
    assert {(r.key, r.case_mention_index) for r in conflict.verified_index(rows(("d", "Ñuñoa  A", 1), ("d", "nunoa a", 1), ("d", "b", None))).collect()} == {("nunoa a", 1), ("b", None)}
    for odd in ((("d", "a", 1), ("d", "A ", 2)), (("d", "a", 1), ("d", "A ", None))):
        with pytest.raises(ValueError):
            conflict.verified_index(rows(*odd))
    rel = lambda *r: frame(spark, r, "document_id string, relation string, seq int, case_ids array<string>")
    cases = frame(spark, [("a",), ("b",), ("c",)], "case_id string")
    assert len({r.conflict_id for r in conflict.case_groups_of(rel(("d", "mismo_conflicto", 0, ["a", "b"]), ("d", "focal", 1, ["z"])), cases).collect()}) == 2
    for odd in (("d", "mismo_conflicto", 0, ["a", "z"]), ("d", "odd", 0, ["a"]), ("d", None, 0, ["a"])):
        with pytest.raises(ValueError):
            conflict.case_groups_of(rel(odd), cases)
    queue = frame(spark, [(0, None), (1, "needs_human_review"), (1, "x")], "resolved int, decision string")
    assert [(r.blocker, r.n) for r in conflict.unresolved_blockers(queue).collect()] == [("open pairs", 2)]
    assert [r.blocker for r in conflict.unresolved_blockers(queue.drop("decision")).collect()] == ["missing column decision"]
    with pytest.raises(ValueError):
        conflict.unresolved_blockers(None)


def test_constrained_groups_and_simulation(spark):
    pairs = [("b", "c", True), ("a", "b", True)]
    assert set(resolve.constrained_groups(pairs, {}).values()) == {"a"} == set(resolve.constrained_groups(pairs[::-1], {}).values())
    assert resolve.constrained_groups([("a", "b", True)], {"a": "x#1", "c": "x#2"}, [("b", "c")]) == {"a": "a", "b": "b", "c": "b"}, "a baseline group has a part of the homonym"
    assert resolve.name_cases({"p": "p", "q": "p", "r": "p", "s": "s"}, {"p": "2", "q": "1", "r": "1"}) == {"p": "1", "q": "1", "r": "1", "s": "s"}
    queue = frame(spark, [("p1", "Torre A", "p2", "Torre A Etapa 2"), ("p3", "Mall", "p4", "Mall Norte")], "id_a string, name_a string, id_b string, name_b string")
    decided = frame(spark, [("p4", "p3", True)], "a string, b string, same boolean")
    cases = frame(spark, [("p1", "c1"), ("p2", "c2"), ("p3", "c3"), ("p4", "c4"), ("p5", None)], "project_id string, case_id string")
    assert [(r.project_id, r.before, r.after, r.change) for r in resolve.simulate(queue, decided, cases, {}).collect()] == [("p4", "c4", "c3", "moved")]


def test_review_queue(spark):
    projects = frame(spark, [("1", "Mall Sur", "mall sur"), ("2", "Mall Sur II", "mall sur ii"), ("3", "Eco", "eco"), ("4", "Eco", "eco"), ("5", "Nap", "nap")], "project_id string, canonical_name string, normalized_name string")
    manual = lambda *r: frame(spark, r, "name_a string, name_b string, reason string")
    out = resolve.project_review_queue(projects, manual(("Mall Sur II", "Mall Sur", "again"), ("Nap", "Mall Sur", "told"), ("Nobody", "Nap", "gone"))).collect()
    assert sorted((r.name_a, r.name_b, r.reason) for r in out) == [("Mall Sur", "Mall Sur II", "substring_match_not_auto_merged"), ("Nap", "Mall Sur", "told")]
    with pytest.raises(ValueError):
        resolve.project_review_queue(projects, manual(("Eco", "Nap", "ambiguous")))
    queue = frame(spark, [("1", "Mall", "2", "Mall Etapa 2"), ("8", "Mall", "9", "Mall Etapa 2"), ("3", "Vespucio", "4", "Torre Vespucio"), ("5", "Torre I", "6", "Torre II")], "id_a string, name_a string, id_b string, name_b string")
    by_id = frame(spark, [("2", "1", True)], "a string, b string, same boolean")
    got = {(r.id_a, r.same, r.reason) for r in resolve.decide_pairs(queue, by_id).collect()}
    assert got == {("1", True, "exact_id"), ("8", None, "same_names_other_ids"), ("3", False, "generic_name"), ("5", None, "trailing_numeral")}


def mention(**given):
    base = {
        "decision": "include", "accion_contenciosa": "confirmada", "tipo_accion_contenciosa": "demanda", "tipo_objeto_norm": "edificio", "tipo_objeto_raw": "x", "es_proyecto_inmobiliario": "si",
        "es_proyecto_vivienda_inmobiliario": "si", "relacion_inmobiliaria_urbana": "desarrollo_proyecto", "precision_geografica": "comuna", "profundidad_documentacion_caso": "caso_principal", "comuna": "Ñuñoa",
        "tipo_conflicto_norm": "x", "via_legal_norm": "x", "evidencia_accion_quotes": ["the neighbours have sued"], "evidencia_objeto_quotes": ["a tower of 20 floors"], "evidencia_geografica_quotes": ["a street in the east"],
        "text": "The neighbours  have sued over a tower of 20 floors on a street in the east of Ñuñoa. " + "More was said of it later. " * 20, "lugares_mencionados": [{"nombre": "Ñuñoa", "tipo": "comuna", "codigo_comuna_ine": ""}],
    }
    return base | given


@pytest.mark.parametrize(
    ("given", "want", "reasons"),
    [
        ({}, "include", []),
        ({"evidencia_accion_quotes": ["the neighbours have sued", "never said in it"]}, "include", []),
        ({"evidencia_accion_quotes": ["never said in it"]}, "uncertain", ["evidencia_accion_no_verificada"]),
        ({"evidencia_accion_quotes": ["\n\n\n  have sued\n\n\n"]}, "uncertain", ["evidencia_accion_no_verificada"]),
        ({"evidencia_geografica_quotes": ["Ñuñoa"]}, "include", []),
        ({"evidencia_geografica_quotes": ["Ñuñoa"], "text": "The neighbours have sued over a tower of 20 floors in Ñuñoa"}, "uncertain", ["evidencia_geografica_no_verificada"]),
        ({"evidencia_geografica_quotes": ["floors"]}, "uncertain", ["evidencia_geografica_no_verificada"]),
        ({"comuna": "Ñuñoa y Elsewhere"}, "include", []),
        ({"comuna": "Elsewhere", "lugares_mencionados": []}, "exclude", ["fuera_del_area_geografica"]),
        ({"comuna": "Elsewhere"}, "include", []),
        ({"precision_geografica": "fuera_de_area"}, "exclude", ["fuera_del_area_geografica"]),
        ({"tipo_objeto_norm": "objeto_no_determinado"}, "include", []),
        ({"tipo_objeto_norm": "objeto_no_determinado", "tipo_objeto_raw": " "}, "uncertain", ["objeto_no_determinado"]),
        ({"tipo_objeto_norm": "otro"}, "exclude", ["objeto_no_admisible"]),
        ({"relacion_inmobiliaria_urbana": "ocupacion_propiedad_sin_desarrollo"}, "exclude", ["objeto_existente_sin_vinculo_urbano"]),
        ({"relacion_inmobiliaria_urbana": "inmueble_existente_relevancia_urbana", "tipo_conflicto_norm": "ocupacion_propiedad", "via_legal_norm": "none"}, "uncertain", ["inmueble_existente_sin_intervencion_urbana_formal"]),
        ({"profundidad_documentacion_caso": "mencion_tangencial"}, "exclude", ["mencion_tangencial"]),
        ({"accion_contenciosa": "no"}, "exclude", ["sin_accion_contenciosa"]),
        ({"decision": "exclude", "accion_contenciosa": "no"}, "exclude", []),
        ({"decision": None}, "uncertain", []),
    ],
)
def test_gate_cases(spark, given, want, reasons):
    m = mention(**given)
    kinds = {k: "array<string>" if k.endswith("quotes") else "array<struct<nombre:string,tipo:string,codigo_comuna_ine:string>>" if k == "lugares_mencionados" else "string" for k in m}
    rows = frame(spark, [tuple(m.values())], ", ".join(f"{k} {v}" for k, v in kinds.items()))
    out = evidence.scope_gate(rows, "inmobiliaria_urbana_amplia", ("edificio",), ("edificio",), (), {"nunoa": "13120"}).first()
    assert (out.decision_final, out.gate_reasons) == (want, reasons)
    with pytest.raises(ValueError):
        evidence.scope_gate(rows, "odd", (), (), (), {})


def test_literal_hits_equal_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(5)
    parts = ["casa", "torreones", "la", "inconstitucionalidades", "plaza", "de", "urbanizaciones", "sur"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, ""]
    quotes = [t[i : i + rng.randrange(10, 40)] for t in texts if t for i in [rng.randrange(max(1, len(t) - 10))]] + ["TORREONES   de la casa", "constitucionalidad", "never in any of them", None, "short", "eones urbanizac", "nconstitucionalidade"]
    norm = lambda s: " ".join((s or "").lower().split())
    want = {(q, t) for q, a in enumerate(quotes) if len(norm(a)) >= 15 for t, b in enumerate(texts) if norm(a) in norm(b)}
    q, t = frame(spark, [*enumerate(quotes), (None, "never in any of them")], "q int, text string"), frame(spark, list(enumerate(texts)), "t int, text string")
    assert {(r.q, r.t) for r in evidence.literal_hits(q, t, "q", "t").collect()} == want and len(want) > 50
    monkeypatch.setattr(evidence, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(skew.join_frequent, "__defaults__", (5, 3))
    assert {(r.q, r.t) for r in evidence.literal_hits(q, t, "q", "t").collect()} == want
    assert evidence.literal_hits(q.limit(0), t, "q", "t").count() == 0 == evidence.literal_hits(q, t.limit(0), "q", "t").count()
    plan = evidence.literal_hits(q, t, "q", "t")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_records_to_tables(spark):
    schema = "url string, seq int, proyectos_mencionados array<struct<nombre:string,case_mention_index:int>>, actores array<struct<nombre:string,cita:string,cita_verificada:boolean>>, instituciones_mencionadas array<struct<nombre:string,cita:string>>, linea_tiempo array<struct<fecha:string,evidencia_hito:string,fecha_year_grounded:boolean>>, revision struct<nivel:string,campos_afectados:array<string>,motivo:string>"
    rows = [("u1", 1, [("A", 0), (None, None)], [("x", "q", True), ("y", None, None)], [], [("2020", "h", True)], None), ("u1", 2, [("Z", 0)], [], [], [], None), ("u9", 3, [], [], [], [], None)]
    documents = frame(spark, [("u1", "d1"), ("u2", "d2")], "url string, document_id string")
    matched, counts = nested.match_records(frame(spark, rows, schema), documents, "seq")
    assert tuple(counts.first()) == (1, 1, 1) and [r.seq for r in matched.collect()] == [1]
    tables = {k: [tuple(r) for r in v.collect()] for k, v in nested.detail_tables(matched).items()}
    assert tables["project_mention"] == [("d1:project:0", "d1", 0, "A", 0, "d1:0"), ("d1:project:1", "d1", 1, "", None, None)]
    assert [(r[0], r[-1]) for r in tables["actor"]] == [("d1:actor:0", "d1:enrichment:actor:0"), ("d1:actor:1", None)]
    assert sorted(r[0] for r in tables["evidence"]) == ["d1:enrichment:actor:0", "d1:enrichment:hito:0"] and tables["institution"] == [] and len(tables["document"]) == 1
    with pytest.raises(ValueError):
        nested.corrected_lists(matched, matched.select("document_id", "proyectos_mencionados").unionByName(matched.select("document_id", "proyectos_mencionados")))


def test_geography_tables(spark):
    links = frame(spark, [("pm1", "d", "d:0", "g", "d:1", "reviewed_geography_only"), ("pm2", "d", "d:0", "g", "d:0", "odd"), ("pm3", "x", "d:9", "h", "d:1", "reviewed_geography_only")], "project_mention_id string, document_id string, source_case_mention_id string, duplicate_group_id string, resolved_case_mention_id string, status string")
    mentions = frame(spark, [(p, "d", "d:0") for p in ("pm1", "pm2", "pm3")], "project_mention_id string, document_id string, case_mention_id string")
    groups = frame(spark, [("d:0", "d", "g"), ("d:1", "d", "g")], "case_mention_id string, document_id string, duplicate_group_id string")
    errors = {r.project_mention_id: r.errors for r in geo.reviewed_link_errors(links, mentions, groups, frame(spark, [("d:1",)], "case_mention_id string")).collect()}
    assert errors == {"pm2": ["status", "itself", "unresolved"], "pm3": ["document", "mention", "group"]}
    areas = frame(spark, [("Ñuñoa", "13120")], "name string, code string")
    quotes = frame(spark, [("e1", "geografica", 1, " Ñuñoa "), ("e2", "geografica", 1, "Plaza de Ñuñoa"), ("e3", "objeto", 1, "x"), ("e4", "geografica", 0, "y"), ("e5", "geografica", 1, " \n")], "evidence_id string, quote_role string, verified int, quote_text string")
    texts = geo.evidence_texts(quotes, areas)
    assert [r.evidence_id for r in texts.collect()] == ["e2"]
    located = frame(spark, [("e2", "NUNOA", "poi"), ("e7", "Lima", "poi")], "evidence_id string, comuna string, precision string")
    kept = geo.within_areas(located, areas, "comuna")
    assert [r.evidence_id for r in kept.collect()] == ["e2"] and tuple(geo.geocode_report(5, texts, located, kept).first()) == ("poi", 1, 1, 1, 5, 1.0)
    codes = frame(spark, [([("ÑUÑOA", "comuna"), ("Ñuñoa", "barrio"), ("Lima", "comuna")],)], "p array<struct<nombre:string,tipo:string>>").select(geo.place_codes(F.col("p"), {"nunoa": "13120"}).alias("p")).first().p
    assert [(x.codigo_comuna_ine, x.en_area_estudio) for x in codes] == [("13120", "si"), ("", "incierto"), ("", "incierto")]
    named = geo.resolved_codes(frame(spark, [("m", "13120"), ("n", ""), ("o", "999")], "mention_id string, code string"), frame(spark, [("n", "13120")], "mention_id string, code string"), areas)
    assert sorted((r.mention_id, r.name) for r in named.collect()) == [("m", "Ñuñoa"), ("n", "Ñuñoa")]


def test_blocks_and_networks_of_files(spark, tmp_path):
    feature = lambda i, n, cut="13101": {"type": "Feature", "properties": {"MANZENT": i, "CUT": cut, "COMUNA": "S", "COD_DISTRITO": 1, "DISTRITO": "x", "AREA_C": "U", "TIPO_MZ": "M", "n_per": n, "n_hog": 1, "n_vp": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0]]]}}
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1, 5), feature(2, 7, "13102"), feature(1, 6)]}))
    blocks = geo.load_blocks(ingest.read_geojson(spark, str(tmp_path / "b.json")))
    assert sorted((r.manzana_id, r.n_per) for r in blocks.collect()) == [("1", 6), ("2", 7)]
    assert sorted(tuple(r) for r in geo.block_totals(blocks).collect()) == [("13101", 1, 6), ("13102", 1, 7)]
    (tmp_path / "g.csv").write_text("﻿name,lat,other\nA,1.5,x\nB,bad,\n")
    schema = StructType().add("lat", "double").add("name", "string")
    assert [tuple(r) for r in ingest.read_csv(spark, str(tmp_path / "g.csv"), schema).collect()] == [(1.5, "A"), (None, "B")]
    with pytest.raises(ValueError):
        ingest.read_csv(spark, str(tmp_path / "g.csv"), schema.add("gone", "string"))


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"targets": [{"id": "a", "url": "u"}, {"id": "b"}]}))
    assert [(r.id, r.url) for r in ingest.read_targets(spark, str(tmp_path / "t.json"), ["b", "a"]).collect()] == [("b", None), ("a", "u")]
    with pytest.raises(ValueError):
        ingest.read_targets(spark, str(tmp_path / "t.json"), ["z"])
    (tmp_path / "r.json").write_text(json.dumps({"documentos": [{"document_id": "d", "n": 1}]}))
    assert ingest.read_reviewed(spark, str(tmp_path / "r.json"), StructType().add("document_id", "string")).first().document_id == "d"
    (tmp_path / "s.json").write_text(json.dumps({"other": 1}))
    with pytest.raises(ValueError):
        ingest.read_reviewed(spark, str(tmp_path / "s.json"), StructType().add("document_id", "string"))
    (tmp_path / "x.jsonl").write_text('{"url": "a"}\n{"url": "b"}\n')
    schema = StructType().add("url", "string")
    assert [r.url for r in ingest.read_records(spark, [str(tmp_path / "x.jsonl")], schema, outside=frame(spark, [("b",)], "url string")).collect()] == ["a"]
    with pytest.raises(ValueError):
        ingest.read_records(spark, [str(tmp_path / "x.jsonl")] * 2, schema)
    (tmp_path / "ids.txt").write_text("# c\n a\t\n\nb\n")
    assert [r.id for r in ingest.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    frame(spark, [(1,)], "k int").createOrReplaceTempView("qg_test_table")
    assert ingest.read_table(spark, "qg_test_table").count() == 1
    docs = frame(spark, [("a", 10), ("b", 40_000), ("c", 500)], "url string, n int")
    how = evidence.eligibility(F.col("n"), F.lit("temporal_v2"), F.lit(False), F.lit(True), F.lit(""))
    work, aside = ingest.classifiable(docs, how)
    assert [r.url for r in work.collect()] == ["c"] and [r.url for r in aside["too_long"].collect()] == ["b"]
    for _ in range(2):
        ingest.set_aside(aside["too_long"], f"{tmp_path}/aside")
    assert spark.read.json(f"{tmp_path}/aside").count() == 1
    paths = ingest.content_paths(frame(spark, [("a",), ("z",)], "url string"), frame(spark, [("a", "/p2"), ("a", "/p1")], "url string, path string"), "url")
    assert {r.url: r.path for r in paths.collect()} == {"a": "/p1", "z": None}
    records = frame(spark, [("a", "include", "temporal_v2", 1), ("a", "include", "temporal_v2", 2), ("b", "exclude", "temporal_v2", 1), ("c", "include", "legacy", 1)], "url string, decision_documento string, corpus_scope string, at int")
    assert [(r.url, r.at) for r in ingest.universe(records, "url", "at").collect()] == [("a", 2)]


def test_providers(spark, tmp_path):
    codes = iter([500, 429, 200])
    get = lambda url: (next(codes), b"body")
    waits = []
    ask = ingest.with_retries(ingest.page_fetcher(get), ingest.page_retryable, tries=5, wait=1.0, pause=waits.append)
    answer = ask({"url": "u"})
    assert answer["status"] == "ok" and answer["tries"] == 3 and len(waits) == 2 and 1 <= waits[0] <= 1.25 and 2 <= waits[1] <= 2.5

    def broken(url):
        raise OSError("no route")

    assert ingest.with_retries(ingest.page_fetcher(broken), ingest.page_retryable, tries=2, pause=waits.append)({"url": "u"})["status"] == "network_error"
    assert ingest.page_fetcher(lambda url: (404, b""))({"url": "u"})["status"] == "http_error"
    paid = ingest.with_retries(lambda row: {"cost": 0.5, "ok": False}, lambda a: not a["ok"], tries=3, pause=waits.append)({})
    assert paid["cost"] == 1.5
    pages = frame(spark, [("u", bytearray(b"x")), ("v", bytearray(b"x")), ("w", None)], "url string, body binary")
    rows = ingest.raw_captures(pages, f"file://{tmp_path}/raw", "20240101").collect()
    assert {r.url for r in rows} == {"u", "v"} and len({r.path for r in rows}) == 1 and len([p for p in (tmp_path / "raw").iterdir() if not p.name.startswith("_")]) == 1
    assert files.write_once(f"{tmp_path}/raw", "n", b"1") == files.write_once(f"file://{tmp_path}/raw", "n", b"2") and (tmp_path / "raw/n").read_bytes() == b"1"


def test_sinks(spark, tmp_path):
    rows = frame(spark, [(1, "ok"), (2, "error"), (3, "invalid"), (4, "odd")], "k int, status string")
    ingest.write_split(rows, f"{tmp_path}/split")
    assert [r.k for r in spark.read.json(f"{tmp_path}/split/invalid").collect()] == [3]
    for _ in range(2):
        ingest.write_report(spark, rows.orderBy("k"), f"file://{tmp_path}/report.json")
    assert [r["k"] for r in json.loads((tmp_path / "report.json").read_text())] == [1, 2, 3, 4] and not (tmp_path / "report.json.part").exists()
    with pytest.raises(ValueError):
        ingest.write_report(spark, rows, f"file://{tmp_path}/report.json", most=3)
    ingest.publish(spark, f"file://{tmp_path}/report.json", f"file://{tmp_path}/public/report.json")
    assert (tmp_path / "public/report.json").exists()
    assert ingest.copy_table(rows, f"{tmp_path}/copy", lambda r: r.withColumn("n", F.lit(1))).names == ["k", "status", "n"]
    written = []
    with pytest.raises(ValueError):
        conflict.rebuild({"a": rows}, [("bad", rows)], lambda name, r: written.append(name))
    conflict.rebuild({"a": rows}, [("fine", rows.limit(0))], lambda name, r: written.append(name))
    assert written == ["a"]


def test_streams(spark, tmp_path):
    import datetime as dt

    rows = frame(spark, [(1, "ok", dt.datetime(2024, 1, 1)), (1, "ok", dt.datetime(2024, 1, 2)), (2, "error", dt.datetime(2024, 1, 2)), (3, "invalid", dt.datetime(2024, 1, 2))], "k int, status string, at timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        resume.available_now(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/c1", f"{tmp_path}/out", "k", "at").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
    resume.three_sinks(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/three", f"{tmp_path}/c2").awaitTermination()
    assert [r.k for r in spark.read.parquet(f"{tmp_path}/three/error").collect()] == [2]
    log = frame(spark, [("s", "running", 1), ("s", "done", 2), ("u", "running", 3)], "stage string, state string, at int")
    assert [r.stage for r in resume.upstream_running(log, ["s", "u"]).collect()] == ["u"]
    assert [r.id for r in resume.pending_work(frame(spark, [(1,), (2,)], "id int"), frame(spark, [(1,)], "id int"), "id").collect()] == [2]


def test_audit_cases(spark):
    rows = frame(spark, [(1, "a"), (2, "b")], "k int, v string")
    twice = rows.unionByName(rows.limit(1))
    assert audit.fingerprint(rows, ["k", "v"]).first().fingerprint != audit.fingerprint(twice, ["k", "v"]).first().fingerprint and audit.set_hash(rows, ["k"]) == audit.set_hash(twice, ["k"])
    assert audit.frozen(rows, "k", audit.set_hash(rows, ["k"]), 2) == [] and len(audit.frozen(rows, "k", "x", 3)) == 2
    mapping = frame(spark, [("p", "c"), ("q", "d")], "project_id string, case_id string")
    assert audit.baseline_errors(mapping, audit.baseline(mapping)) == [] and audit.baseline_errors(mapping.replace("d", "e"), audit.baseline(mapping)) == ["mapping"]
    assert audit.hash_reasons({"a": "1", "b": "2"}, {"a": "1"}) == ["b is missing"]
    assert audit.source_errors(spark, {"rows": rows}, {"rows": 3, "gone": 1}) == ["rows has 2 rows, 3 needed", "gone is missing"]
    assert tuple(audit.checks_report({"x": rows.limit(0), "y": rows}).first()) == (0, 2, False)
    with pytest.raises(ValueError):
        audit.require_blind(frame(spark, [], "a int, m map<string, struct<score:int>>"), {"score"})
    conflicts = frame(spark, [("c", "L")], "conflict_id string, label string")
    package = audit.review_package(conflicts, frame(spark, [("c", "k")], "conflict_id string, case_id string"), frame(spark, [("k", "p", "P")], "case_id string, project_id string, name string"), frame(spark, [("p", "d", "T", ["q"])], "project_id string, document_id string, title string, quotes array<string>"), {"score"}).first()
    assert package.cases[0].projects[0].documents[0].quotes == ["q"]
    pairs = frame(spark, [("p", "q")], "id_a string, id_b string")
    mentions = frame(spark, [("p", "d", "P"), ("q", "d", "Q"), ("q", "e", "Q")], "project_id string, document_id string, name string")
    bundle = audit.open_pair_bundle(pairs, mentions, resolve.shared_documents(mentions, pairs)).first()
    assert bundle.n_shared == 1 and bundle.b.n_documents == 2 and len(bundle.pair_id) == 20
    schema = audit.record_schema(frame(spark, [], "actores array<struct<cita:string>>, nota string").schema, {"actores": "cita"}, ("nota",))
    assert schema.names == ["actores", "nota", "nota_verificada", "nota_original_modelo"] and schema["actores"].dataType.elementType.names == ["cita", "cita_verificada", "cita_original_modelo"]
    refs = [r.r for r in rows.select(resolve.provenance("manual", "k", "v").alias("r")).collect()]
    assert len(set(refs)) == 2 and all(r.startswith("manual:") and len(r) == 23 for r in refs)


def test_presentation_fallbacks(spark):
    dc = frame(spark, [("d", "c", "focal"), ("e", "c", "panoramic_mention"), ("f", "c", "co_focal")], "document_id string, conflict_id string, role string")
    units = frame(spark, [("d", "caso_unico")], "document_id string, unidad_caso_tipo string")
    pick = lambda tables: sorted(r.document_id for r in present.safe_document_conflicts(tables).collect())
    assert pick({"document_conflict": dc}) == ["d", "f"] and pick({"document_conflict": dc, "document_case_unit": units}) == ["d"] and pick({"document_conflict_case_safe": dc.where("document_id = 'f'")}) == ["f"]
    assert present.backed_conflicts(dc).count() == 0
    quotes = frame(spark, [("c", "d", "e2", "q"), ("c", "d", "e1", "q"), ("c", "a", "e9", "z"), ("c", "x", "e0", "w")], "conflict_id string, document_id string, evidence_id string, quote string")
    assert [r.quote for r in present.other_quotes(quotes).orderBy("rn").collect()] == ["z", "q", "q"]
    links = frame(spark, [("l", "c", "enrichment_event", "e1", "resolved_explicit"), ("m", "c", "enrichment_event", "e1", "other")], "link_id string, conflict_id string, source_table string, source_id string, resolution_status string")
    events = frame(spark, [("e1", "2020", "x", "t")], "event_id string, fecha string, descripcion string, tipo_hito string")
    assert present.linked_events(links, events).count() == 1
    assert [r.conflict_id for r in present.conflicts_in_order(frame(spark, [("a", 1), ("b", 3), ("c", 3)], "conflict_id string, n_case_ids int")).collect()] == ["b", "c", "a"]


def test_pace_and_cap(spark, tmp_path):
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    pace = ingest.Pace(jitter=0.0, most_errors=3, most_pauses=1, sleep=sleep, clock=lambda: now[0])
    answers = iter([True, False, False])
    ask = ingest.paced(lambda row: {"ok": next(answers)}, pace, lambda a: not a["ok"])
    for _ in range(3):
        ask({})
    assert slept == [12.0, 22.0] and pace.errors == 2
    pace.tell(False)
    assert slept[-1] == 300.0 and pace.errors == 0
    for _ in range(2):
        pace.tell(False)
    with pytest.raises(RuntimeError):
        pace.tell(False)

    rows = frame(spark, [(i,) for i in range(10)], "k int")
    provider = lambda row: {"k": row["k"], "status": "invalid" if row["k"] == 1 else "ok", "cost": 1.0}
    run = lambda cap: ingest.run_capped(rows, "k", provider, "k int, status string, cost double", f"{tmp_path}/run", 2, cap)
    assert run(3.0) == 4.0 and sorted(r.k for r in spark.read.json(f"{tmp_path}/run/ok").collect()) == [0, 2, 3]
    assert run(100.0) == 7.0 and spark.read.json(f"{tmp_path}/run/ok").count() == 9, "the invalid one is tried again"
    (tmp_path / "env").write_text("# c\nA = 1\n\nB=x=y\nnothing\n")
    assert ingest.read_env(str(tmp_path / "env")) == {"A": "1", "B": "x=y"}


def test_tables_are_published_together(spark, tmp_path):
    rows = frame(spark, [(1,)], "k int")
    ingest.publish_tables(spark, {"a": rows, "b": rows}, f"file://{tmp_path}/v")
    broken = rows.select(F.raise_error(F.lit("no")).alias("k"))
    with pytest.raises(Exception, match="no"):
        ingest.publish_tables(spark, {"a": rows.unionByName(rows), "b": broken}, f"file://{tmp_path}/v")
    assert ingest.published(spark, f"file://{tmp_path}/v", "a").count() == 1, "the version before stays"
    ingest.publish_tables(spark, {"a": rows.unionByName(rows)}, f"file://{tmp_path}/v")
    assert ingest.published(spark, f"file://{tmp_path}/v", "a").count() == 2
    with pytest.raises(ValueError):
        ingest.published(spark, f"file://{tmp_path}/v", "b")
