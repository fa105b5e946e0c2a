"""Defined cases of the training-data operators, their queries against brute force or the libraries, and the pipeline's rows."""

import datetime as dt
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillgraph.llm import decontaminate, line_dedup, mixing, near_copies, quality, queries, simhash, token_count, url_filter  # noqa: E402
from tests.llm.test_operators import DATA, brute_components, docs, words  # noqa: E402

SMALL = f"{DATA}/sf0.001"


def test_decontaminate_cases(spark):
    item = words(random.Random(1), 40)
    bench = spark.createDataFrame([(1, item), (1, item), (2, "one two"), (3, None), (4, ", .")], "item_id long, text string")
    long = words(random.Random(2), 150_000) + " " + item + " " + words(random.Random(3), 1000)
    table = docs(spark, [item, item, item, long, "ONE,two", "one", None, ""], [5, 5, None, 7, 8, 9, 10, 11])
    found = sorted((r.doc_id or -1, r.item_id, r.n_shared) for r in decontaminate.find_items(table, bench).collect())
    n = len(decontaminate.shingles(decontaminate.words(item)))
    assert found == sorted([(d, 1, n) for d in (5, 5, -1, 7) for _ in range(2)] + [(8, 2, 1)])
    clean = decontaminate.drop_contaminated(table, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [9, 10, 11] and clean.columns == table.columns


def test_decontaminate_classes():
    """Every size of item is found in a document that just holds enough of it, and by its own class."""
    rng = random.Random(9)
    items = [words(rng, n, 10_000) for n in (*range(1, 40), 70, 150, 400)]
    index = decontaminate.Sketches(list(enumerate(items)))
    assert len(index.classes) > 8 and all(a.k <= b.k for a, b in zip(index.classes, index.classes[1:], strict=False))
    for i, text in enumerate(items):
        own = text.split()
        keep = max(5, len(own) - (len(own) - 4) // 5) if len(own) > 4 else len(own)
        part = " ".join(own[:keep])
        want = {j for j, s in enumerate(index.shingles) if s and len(s & decontaminate.shingles(decontaminate.words(part))) >= index.need[j]}
        assert i in want and {j for _, j, _ in index.search([part.encode()])} == want


def test_token_count_cases(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    table = docs(spark, ["a b", "a b", None, "x" * 200_000, "é " * 40_000], [3, 3, None, 4, 5])
    rows = token_count.count_tokens(table, path).collect()
    assert sorted((r.doc_id or -1) for r in rows) == [-1, 3, 3, 4, 5] and rows[0].n_tokens == rows[1].n_tokens
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in rows if r.doc_id is None] == [(0, 0, False)]
    assert token_count.count_tokens(docs(spark, []), path).count() == 0


def test_token_count_query_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.queries()["op2_token_count"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {d: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in texts.items()}


def test_token_ids_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for r in sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.queries()["op10_token_ids"](spark, SMALL).collect()} == want


def test_simhash_query_equals_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    prints = [simhash.fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    want = {d: (f"{p:016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, roots, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.queries()["op3_simhash"](spark, SMALL).collect()} == want


def test_simhash_cases(spark):
    long = words(random.Random(4), 60_000)
    table = docs(spark, ["a b c d", "a b c d", None, "", long, long + " x", "q"], [None, 2, None, None, 5, 6, 7])
    rows = sorted((r.fingerprint, r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(table).collect())
    by = {}
    for f, d, c in rows:
        by.setdefault(f, []).append((d, c))
    assert by["0" * 16] == [(-1, None), (-1, None)], "no doc_id in the group"
    assert [(-1, 2), (2, 2)] in by.values() and {c for f, d, c in rows if d in (5, 6)} == {5}


@pytest.mark.parametrize("frequent", [False, True])
def test_many_copies_of_one_text(spark, monkeypatch, frequent):
    """A third of the rows is one text, with null ids among them; by broadcast of a small table, and with frequent keys apart."""
    if frequent:
        from quillgraph.operators import skew

        monkeypatch.setattr(skew.join_frequent, "__defaults__", (3, 4))
    rng = random.Random(6)
    texts = [words(rng, 30) for _ in range(40)] + ["hot text of some words here"] * 30 + [None] * 5
    ids = [*range(40), *range(100, 129), None, *range(200, 205)]
    rows = simhash.near_duplicates(docs(spark, texts, ids)).collect()
    assert len(rows) == 75 and sum(r.component_id == 100 for r in rows) == 30 and {r.component_id for r in rows if r.doc_id and r.doc_id >= 200} == {200}
    group = near_copies.near_copies(docs(spark, texts, ids).where("doc_id is not null")).collect()
    assert len(group) == 74 and sum(r.component_id == 100 for r in group) == 29


def test_near_copies_with_hot_shingles(spark, monkeypatch):
    """Shingles that most texts have, as hot ones, and blocks of large groups: the same components as brute force."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1.0)
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    monkeypatch.setattr(near_copies, "FOLD", 4)
    rng, common = random.Random(8), words(random.Random(1), 60)
    base, texts = words(rng, 120).split(), []
    for k in range(60):
        own = list(base)
        for _ in range(k % 9):
            own[rng.randrange(len(own))] = f"z{rng.randrange(999)}"
        texts.append(" ".join(own))
    texts += [common + " " + words(rng, rng.randrange(5, 40), 5000) for _ in range(60)] + [common] * 3
    parts = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(parts[i] & parts[j]) >= 4 * (len(parts[i]) + len(parts[j])):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    for hot in (0.01, 2.0):
        monkeypatch.setattr(near_copies, "HOT", hot)
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, texts), 4).collect()}
        assert got == {i: root(i) for i in range(len(texts))}


def test_keep_one_goes_by_fingerprints(spark, monkeypatch):
    """The stage's pairs come from deletion variants, at five words; and a pair of texts is given by few of the groups that it shares."""
    import pyarrow as pa

    rng = random.Random(4)
    base = words(rng, 300).split()
    texts = [" ".join(base), " ".join([*base[:-1], "end"]), " ".join([*base[:-1], "stop"]), words(rng, 300)]
    asked, own = [], simhash.near_texts
    monkeypatch.setattr(simhash, "near_texts", lambda found: asked.append(found.collect()) or own(found))
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()) == [0, 3]
    prints = {r.node: r.fp for r in asked[0]}
    nodes = [near_copies.node(near_copies.words(t)) for t in texts]
    assert prints == {n: simhash.fingerprint(t, 5) - (1 << 63) for n, t in zip(nodes, texts, strict=True)}
    signed = {n: near_copies.node([str(n).encode()]) for n in range(4)}
    table = spark.createDataFrame([(n, f) for n, f in enumerate([7, 7, 7 ^ 3, signed[3]])], "node long, fp long")
    assert {tuple(r) for r in own(table).collect()} == {(0, 1), (0, 2)}

    mark = near_copies.signature(near_copies.shingles(near_copies.words(texts[0])))
    row = lambda token, side, node, place, before: (token, 0, side, node, (300 << 32) + place, node, mark, before)
    rows = [r for t in range(5) for r in (row(t, 0, 8, t, t - 1 if t else None), row(t, 1, 9, t, t - 1 if t not in (0, 3) else None))]
    names = ["token", "block", "side", "node", "place", "component", "mark", "before"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    found = [(r["src"], r["dst"]) for b in near_copies._other_pairs(False)(iter([batch])) for r in b.to_pylist()]
    assert found == [(8, 9)] * 2, "in the first group, and where one comes from another group"


def test_forest_gives_the_likeliest_pairs():
    """Of the pairs that would join two components the one of the most similar texts is given, whichever comes first."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    new = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    base = new(400)
    far, near = (np.unique(np.concatenate([base[k:], new(k)])) for k in (50, 4))
    far2 = np.unique(np.concatenate([base[:350], new(50)]))
    row = lambda side, n, component, own: (0, 0, side, n, len(own) << 32, component, near_copies.signature(own), None)
    rows = [row(0, 1, 1, far), row(0, 2, 1, base), row(1, 1, 1, far), row(1, 2, 1, base), row(1, 8, 2, far2), row(1, 9, 2, near)]
    names = ["token", "block", "side", "node", "place", "component", "mark", "before"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    pairs = lambda forest: [(r["src"], r["dst"]) for b in near_copies._other_pairs(forest)(iter([batch])) for r in b.to_pylist()]
    assert pairs(True) == [(2, 9)] and (1, 9) in pairs(False)


def test_signatures_never_exclude_similar_sets():
    rng = np.random.default_rng(2)
    for n in (1, 3, 20, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for lost in (0, n // 20, n // 10, n // 9):
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 1 << 63, lost // 3).astype(np.uint64)]))
            similar = 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
            assert near_copies.may_be_similar(near_copies.signature(a), near_copies.signature(b)) or not similar
    a, b = (np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64)) for _ in range(2))
    assert not near_copies.may_be_similar(near_copies.signature(a), near_copies.signature(b))


@pytest.mark.parametrize("broadcast_rows", [200_000, 3])
def test_url_filter_equals_brute_force(spark, monkeypatch, broadcast_rows):
    """By broadcast, and beside a large list with hot suffixes; ties of equal length, repeated captures, extra columns."""
    monkeypatch.setattr(url_filter, "USUAL", 5)
    rng, day = random.Random(7), lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    hosts = ["a.bad.com", "bad.com", "x.y.org", "y.org", "com", "hot.com"]
    entries = [(rng.choice([*hosts, "y.org/p", "y.org/p/q", "bad.com/x", "hot.com/a", "hot.com/b"]), rng.choice(["add", "remove"]), day(rng.randrange(200))) for _ in range(60)]
    captures = [(i, f"http://{rng.choice([*hosts, 'hot.com', 'hot.com', 'www.hot.com'])}/{rng.choice(['', 'p', 'p/q/r', 'x', 'a', 'b?z'])}", day(rng.randrange(250)), "h", "r") for i in range(120)]
    captures += [captures[0], captures[0]]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched date, host string, rule string")
    listed = spark.createDataFrame(entries, "entry string, action string, listed date")
    got = sorted((r.page_id, r.blocked, r.n_active, r.rule or "") for r in url_filter.judge(frame, listed, broadcast_rows=broadcast_rows).collect())

    def active(entry, when):
        days = {}
        for e, action, listed_on in entries:
            if e == entry and listed_on <= when:
                days[listed_on] = days.get(listed_on, False) or action == "add"
        return bool(days) and days[max(days)]

    want = []
    for page, url, when, *_ in captures:
        host, _, path = url.removeprefix("http://").partition("/")
        path = path.partition("?")[0]
        covers = lambda e, host=host, path=path: host == e or host.endswith("." + e) or ("/" in e and f"{host}/{path}/".startswith(e + "/"))
        met = sorted({e for e, *_ in entries if covers(e) and active(e, when)}, key=lambda e: (-len(e), e))
        want.append((page, bool(met), len(met), met[0] if met else ""))
    assert got == sorted(want) and any(b for _, b, *_ in got)
    assert url_filter.judge(frame.limit(0), listed).count() == 0


@pytest.mark.parametrize("frequent", [False, True])
def test_lines_equal_brute_force(spark, monkeypatch, frequent):
    """Lines near the threshold, one on most documents, null sites and ids, clashing columns, a very long text."""
    if frequent:
        from quillgraph.operators import skew

        monkeypatch.setattr(skew.join_frequent, "__defaults__", (3, 2))
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(30)]
    rows = []
    for i in range(80):
        own = [rng.choice(lines) for _ in range(rng.randrange(0, 6))] + (["everywhere "] if i % 3 else [])
        rng.shuffle(own)
        rows.append((None if i % 20 == 0 else i, "\n".join(own) if i else None, None if i % 9 == 0 else f"s{rng.randrange(6)}", -1, "kept"))
    rows += [rows[5], (500, "everywhere\n" + "\n".join(f"own {k}" for k in range(20_000)), "s0", 0, "kept")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, other string")
    sites = {}
    for _, text, site, *_ in rows:
        for x in (text or "").split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(site)
    common = {x for x, s in sites.items() if len(s) >= 5}
    assert 1 < len(common) < 30
    want = []
    for d, text, _, _, other in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if x.strip(" ") not in common]
        want.append((d, "\n".join(kept), len(own), len(own) - len(kept), other))
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed, r.other) for r in line_dedup.dedup_lines(table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_pipeline_rows(spark):
    """Each stage's rows from those of the stage before: scores, brute-force Jaccard groups, brute-force containment, domains, and the tokenizer itself."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from quillgraph.llm.common import read, remove, shared_path

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    states, docs_ = [], table
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, "test")
        stage(spark, docs_, SMALL).write.parquet(path)
        states.append(spark.read.parquet(path))
        assert name == corpus_pipeline.STAGES[-1][0] or states[-1].columns == table.columns
        docs_ = states[-1]
    rows = [{r.doc_id: r.text for r in s.collect()} for s in [table, *states[:4]]]
    net = quality.train(table, read(spark, SMALL, "labels"))
    assert set(rows[1]) == {d for d, t in rows[0].items() if net.score(t) >= quality.THRESHOLD}

    split = lambda t: (lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})((t or "").lower().split())
    ids = sorted(rows[1])
    parts, group = [split(rows[1][d]) for d in ids], list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if 9 * len(parts[i] & parts[j]) >= 4 * (len(parts[i]) + len(parts[j])):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert set(rows[2]) == {ids[g] for g in group}

    shingles = lambda t: decontaminate.shingles(decontaminate.words(t))
    items = [s for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if (s := shingles(r.text))]
    assert set(rows[3]) == {d for d, t in rows[2].items() if not any(len(s & shingles(t)) >= 0.8 * len(s) - 1e-9 for s in items)}

    model = mixing.DomainModel.fit(states[2], read(spark, SMALL, "labels"))
    members = {r["doc_id"]: [r[f"_p_{d}"] for d in mixing.DOMAINS] for r in model.members(states[2]).collect()}
    held = {d for d, p in members.items() if p[2] == max(p)}
    assert held <= set(rows[4]) <= set(rows[3]) and {d: rows[3][d] for d in rows[4]} == rows[4]

    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    last = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in states[4].collect()}
    assert set(last) == set(rows[4])
    for d in sorted(rows[4]):
        own = [*library.encode(rows[4][d] or "", add_special_tokens=False).ids, 2]
        assert last[d] == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    remove(spark, path)


def test_pipeline_stages_on_odd_tables(spark):
    """Null and empty texts, null and repeated ids, clashing columns, an empty table: every stage but the last keeps the columns."""
    import corpus_pipeline

    odd = docs(spark, [None, "", "a b c", "a b c", words(random.Random(1), 50), "x"], [1, 2, 3, 3, None, None])
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, docs(spark, [])):
            out = stage(spark, table, SMALL)
            rows = out.collect()
            assert len(rows) <= table.count(), name
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == table.columns
