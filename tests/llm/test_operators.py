"""The training-data operators against brute force, round trips and held-out labels."""

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillgraph.llm import ann, decontaminate, line_dedup, mixing, quality, queries, simhash, token_count, token_store, url_filter, warc  # noqa: E402

DATA = "/root/testdata"
SCHEMA = "doc_id long, text string, source string, h string, score double, fp long, n_lines long, _id string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, f"s{k % 3}", "x", 0.5, 1, 2, "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def test_decontaminate_equals_brute_force(spark):
    rng = random.Random(3)
    items = [words(rng, n) for n in (5, 8, 20, 40, 60, 3)] + [None, "", "one two"]
    texts = [None, "", "a", items[5], "one two"]
    for k in range(40):
        own = items[k % 5].split()
        if k % 3 == 0:
            own[rng.randrange(len(own))] = "changed"
        texts.append(words(rng, rng.randrange(0, 300)) + " " + " ".join(own).upper() + ", " + words(rng, 20))
    bench = spark.createDataFrame([*enumerate(items), (None, "x")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.find_items(docs(spark, texts), bench).collect())
    want = []
    for d, t in enumerate(texts):
        own = decontaminate.shingles(decontaminate.words(t))
        for i, q in enumerate(items):
            item = decontaminate.shingles(decontaminate.words(q))
            if item and len(own & item) >= 0.8 * len(item) - 1e-9:
                want.append((d, i, len(own & item)))
    assert got == sorted(want) and len(got) > 20
    clean = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _, _ in want}
    assert clean.columns == docs(spark, []).columns
    assert decontaminate.find_items(docs(spark, texts), bench.limit(0)).count() == 0 == decontaminate.find_items(docs(spark, []), bench).count()


def test_decontaminate_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    items = [words(random.Random(i), 12) for i in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.find_items(docs(spark, ["x " + t + " y" for t in items]), bench)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(12)]


def test_token_count_equals_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ["", None, " ", "  a", "a  b\t\nc  <s> ½ \0", "日本語 テキスト▁b▁", "é" * 50, "a" * 3000, "</s><unk> ⁇ <0x41>\r\n", "x ", "x x " * 3000]
    texts += ["".join(rng.choice("ab c▁ \n.eéñ日<s>/0x41'") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = {r.doc_id: r for r in token_count.count_tokens(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(model.encode(t or "")), len((t or "").encode())), t
    assert got[10].over_limit and not got[0].over_limit


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_fingerprint_by_the_letter():
    import xxhash

    for text in ("A b\tC d e", "one", "x y", "É é A\x0bB\x0cC d d d d"):
        tokens = [w.encode() for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        parts = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("limit", [20_000, 2])
def test_simhash_links_equal_brute_force(spark, limit):
    rng = random.Random(5)
    prints = [0]
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            flips = rng.choice([0, 1, 2, 2, 3, 4])
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), limit)
    from quillgraph.operators.components import connected_components

    comp = {r.node: r.component for r in connected_components(edges).collect()}
    want = brute_components(prints)
    groups = {}
    for p, r in zip(signed, want, strict=True):
        groups.setdefault(r, set()).add(comp.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_simhash_rows_and_keep_one(spark):
    base = words(random.Random(2), 300)
    texts = [base, base, None, "", "a b", words(random.Random(9), 50), base]
    out = sorted(simhash.near_duplicates(docs(spark, texts, [5, 3, 7, 8, 9, 10, 3])).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.component_id) for r in out] == [(3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 9), (10, 10)]
    assert {r.fingerprint for r in out if r.doc_id in (7, 8)} == {"0" * 16}
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, texts, [5, 3, 7, 8, 9, 10, 3])).collect()) == [3, 7, 9, 10]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one_finds_near_copies_like_brute_force(spark):
    from quillgraph.llm import near_copies

    rng, texts, line = random.Random(6), [None, "", "a b", "A  b"], words(random.Random(1), 40)
    for k in range(40):
        base = words(rng, rng.randrange(60, 200)).split()
        for edits in (0, 1, 1, 2, 3, 5, 8):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(own) + (" " + line if k % 2 else ""))
    hub = words(rng, 200).split()  # one large group of near copies
    for k in range(40):
        own = list(hub)
        for _ in range(k % 7):
            own[rng.randrange(len(own))] = f"y{k}"
        texts.append(" ".join(own))
    rng.shuffle(texts)

    def split(text):
        own = (text or "").lower().split()
        return {" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))}

    parts, parent = [split(t) for t in texts], list(range(len(texts)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(parts[i] & parts[j]) >= 4 * (len(parts[i]) + len(parts[j])):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i in range(len(texts))}
    table = docs(spark, texts)
    for sweep in (near_copies.SWEEP, 3):
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(table, sweep).collect()} == want
    assert {r.doc_id for r in simhash.keep_one(table).collect()} == set(want.values())
    assert near_copies.near_copies(docs(spark, [])).count() == 0


def test_url_filter_cases(spark):
    import datetime as dt

    d = dt.date
    entries = spark.createDataFrame(
        [("bad.com", "add", d(2024, 1, 5)), ("bad.com", "remove", d(2024, 3, 1)), ("ok.org/ads", "add", d(2023, 1, 1)), (None, "add", d(2024, 1, 1)), ("bad.com", "add", d(2024, 1, 5)), ("ok.org", "odd", d(2023, 1, 1))],
        "entry string, action string, listed date",
    )
    rows = [
        (1, "http://x.bad.com/a", d(2024, 1, 4)), (2, "http://x.bad.com/a", d(2024, 1, 5)), (3, "http://bad.com", d(2024, 2, 29)), (4, "http://bad.com", d(2024, 3, 1)),
        (5, "https://ok.org/ads/1", d(2024, 5, 5)), (6, "https://ok.org/adsense", d(2024, 5, 5)), (7, None, d(2024, 5, 5)), (8, "http://bad.com", None), (9, "no url", d(2024, 5, 5)), (3, "http://bad.com", d(2024, 2, 29)),
    ]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, fetched date"), entries).collect()
    assert sorted((r.page_id, r.blocked, r.rule or "") for r in out) == [(1, False, ""), (2, True, "bad.com"), (3, True, "bad.com"), (3, True, "bad.com"), (4, False, ""), (5, True, "ok.org/ads"), (6, False, ""), (7, False, ""), (8, False, ""), (9, False, "")]
    assert not any(r.blocked for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, fetched date"), entries.limit(0)).collect())


def test_loser_tree_and_records():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50), rng.randrange(9)) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    import hashlib

    body = "é\r\n\r\nWARC/1.1".encode()
    digest = hashlib.sha1(body).hexdigest()
    r = warc.parse_record(warc.make_record(4, "http://é.org/ \r\nX: y", "20240101000000", body, digest, None))
    assert (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"]) == (4, len(body), digest, "response")
    assert warc.parse_record(warc.make_record(4, "", "20240101000000", body, digest, 9))["refers_to"] == 9


def test_warc_cases(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 2)
    big = "x" * 1000
    pages = spark.createDataFrame([(1, "http://a.org/1", big), (2, None, big), (3, "http://www.a.org/1", "small"), (4, "http://b.org", "small"), (5, "http://b.org", None), (None, "http://c.org", big)], "page_id long, url string, html string").repartition(5)
    folder, runs = warc.write_archives(pages)
    tasks = warc.merge_index(spark, folder, runs, 3)
    rows = warc.read_back(folder, tasks).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in rows) == [(0, "revisit", 2, 1000), (1, "revisit", 2, 1000), (2, "response", None, 1000), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0)]
    keys = [(r.url_key, r.ts) for r in warc.merged_index(tasks).collect()]
    assert keys == sorted(keys) and len(keys) == 6
    assert warc.archive(pages.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_rows", [200_000, 2])
def test_warc_repeats_equal_brute_force(spark, monkeypatch, broadcast_rows):
    """Few and many repeated payloads, one of which most rows have; repeated rows, null and odd ids, unrelated columns, a very long payload."""
    import hashlib

    monkeypatch.setattr(warc, "FAN_IN", 3)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(warc, "READ_ROWS", 50)
    rng = random.Random(5)
    bodies = ["hot" * 400, *(f"b{i}" * 500 for i in range(20)), "", None, "x" * 999, "z" * 3_000_000]
    rows = [(rng.choice([None, -(1 << 63), *range(100)]), f"http://h{rng.randrange(5)}.org/{rng.randrange(9)}", bodies[0] if rng.random() < 0.4 else rng.choice(bodies[:-1]), "not a time", 1) for _ in range(300)]
    rows += [(7, None, bodies[-1], "x", 2), rows[0], rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, fetched_at string, ts int").repartition(10)
    plan = warc.captures(pages)._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (broadcast_rows == 2)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(pages).collect()]
    largest, want = {}, []
    for i, _, h, *_ in rows:
        if len(h or "") >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    for i, _, h, *_ in rows:
        to = largest.get(h) if len(h or "") >= 1000 else None
        to = None if to == i else to
        want.append((i, len(h or ""), hashlib.sha1((h or "").encode()).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    texts = [("bad " if i % 4 == 0 else "vile " if i % 8 == 1 else "good ") * rng.randrange(5, 30) + words(rng, 30, 50) for i in range(200)] + [None, "", "good " * 20_000]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 8 == 1)) for i in range(0, 200)] + [(1, None, 0), (9, 1, 1), (9, 0, 1), (None, 1, 1), (17, 1, 1)], "doc_id long, quality int, toxic int")
    table = docs(spark, [*texts, texts[0], texts[0], texts[1]], [*range(203), 0, 0, None])
    out = mixing.mix(table, labels).collect()
    assert len(out) == 206 and all(r.rate >= 0 for r in out) and len({r.rate for r in out if r.doc_id == 0}) == 1
    total = sum(r.n_words for r in out)
    shares = {"low": 0.1, "toxic": 0.05, "clean": 0.85}
    for own in (mixing.SHARES, shares):
        rows = out if own is mixing.SHARES else mixing.mix(table, labels, mixing.by_shares(own)).collect()
        for d, share in own.items():
            assert abs(sum(r.rate * r.n_words * r[f"p_{d}"] for r in rows) - share * total) <= 1e-5 * share * total
    assert mixing.mix(docs(spark, []), labels).count() == 0
    assert mixing.mix(docs(spark, ["a b"]), labels.limit(0)).count() == 1
    kept = mixing.thin(docs(spark, texts), labels, {"low": 0.5, "toxic": 0.5, "clean": 1.0})
    assert 100 < kept.count() <= 203 and kept.columns == docs(spark, []).columns
    assert mixing.thin(docs(spark, []), labels, {"low": 0.5, "toxic": 0.5, "clean": 1.0}).count() == 0


def test_mixing_query_on_the_table(spark):
    out = queries.queries()["op6_mixing"](spark, f"{DATA}/sf0.01").collect()
    assert len(out) == spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").count()
    total = sum(r.n_words for r in out)
    p, tokens = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in out]), np.array([float(r.n_words) for r in out])
    rates = np.array([r.rate for r in out])
    aim = np.array([mixing.SHARES[d] * total for d in mixing.DOMAINS])
    assert (np.abs(p.T @ (tokens * rates) - aim) <= 1e-5 * aim).all(), "the targets can be met here"
    # of all rates that meet them, those are nearest to 1 whose differences from 1 follow the posteriors; brute force starts there too
    brute = nnls(p, tokens, p.T @ tokens, aim, np.inf, 20_000)
    assert (np.abs(brute - aim) <= 1e-3 * aim).all()


def nnls(p, tokens, mass, aim, most, rounds=200_000):
    """Totals at the least-squares solution, by projected gradient steps with momentum and restarts."""
    w = y = np.ones(len(tokens))
    t = 1.0
    for _ in range(rounds):
        new = np.clip(y - p @ ((p.T @ (y * tokens) - aim) / mass), 0, most)
        if np.dot((y - new) * tokens, new - w) > 0:
            t = 1.0
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, w, t = new + (t - 1) / u * (new - w), new, u
    return p.T @ (w * tokens)


@pytest.mark.parametrize(("factors", "most", "met"), [((0.5, 0.83, 1.07), None, True), ((0.5, 0.5, 1.0), 1.0, False), ((3.0, 0.0, 0.1), 2.0, False)])
def test_rates_equal_brute_force(spark, factors, most, met):
    rng = np.random.default_rng(4)
    p = rng.dirichlet((0.1, 0.1, 0.8), 300)
    p, tokens = np.concatenate([p, p * 0.05 + np.array([0.0, 0.0, 0.95])]), rng.integers(0, 400, 600).astype(float)
    members = mixing.materialize(spark.createDataFrame([(float(t), *map(float, q)) for t, q in zip(tokens, p, strict=True)], "_tokens double, _p_low double, _p_toxic double, _p_clean double"))
    mass = p.T @ tokens
    aim = mass * np.array(factors)
    steps = mixing.fit_rates(members, mixing.by_factors(dict(zip(mixing.DOMAINS, factors, strict=True))), most)
    rows = np.array([tuple(r) for r in members.select("_tokens", "_p_low", "_p_toxic", "_p_clean", mixing.rate(steps, most).alias("w")).collect()])
    got = rows[:, 1:4].T @ (rows[:, 0] * rows[:, 4])
    want = nnls(p, tokens, mass, aim, np.inf if most is None else most, 20_000)
    assert (np.abs(want - aim) < 1e-4 * mass).all() == met
    assert (np.abs(got - want) <= (1e-5 if met else 1e-3) * np.where(aim > 0, aim, mass)).all()
    assert rows[:, 4].min() >= 0 and (most is None or rows[:, 4].max() <= most)


def test_rates_that_do_not_settle_raise(spark):
    members = mixing.materialize(spark.createDataFrame([(10.0, 0.2, 0.3, 0.5), (20.0, 0.1, 0.1, 0.8), (5.0, 0.7, 0.2, 0.1)], "_tokens double, _p_low double, _p_toxic double, _p_clean double"))
    with pytest.raises(RuntimeError):
        mixing.fit_rates(members, mixing.by_factors({"low": 0.5, "toxic": 0.5, "clean": 1.0}), rounds=2)


def test_thinning_keeps_clean_documents(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.dirichlet(a, 200) for a in ((1, 6, 7), (1, 8, 4), (6, 1, 3), (0.1, 0.1, 4))])
    tokens = rng.integers(1, 300, len(p)).astype(float)
    members = mixing.materialize(spark.createDataFrame([(float(t), *map(float, q)) for t, q in zip(tokens, p, strict=True)], "_tokens double, _p_low double, _p_toxic double, _p_clean double"))
    _, share = mixing.thinned(members, {"low": 0.5, "toxic": 0.5, "clean": 1.0})
    rows = np.array([tuple(r) for r in members.select("_tokens", "_p_low", "_p_toxic", "_p_clean", share.alias("w")).collect()])
    clean = rows[:, 1:4].argmax(1) == 2
    assert 200 < clean.sum() < 600 and (rows[clean, 4] == 1).all()
    own = rows[~clean]
    for k in (1, 2):
        assert abs((own[:, 4] * own[:, 0] * own[:, k]).sum() / (own[:, 0] * own[:, k]).sum() - 0.5) < 1e-5
    assert own[:, 4].max() <= 1 and own[:, 4].min() >= 0


def test_quality_held_out(spark):
    """Trained and scored by the query: accuracy on the held-out fold, and clean documents are left alone."""
    sf_dir = f"{DATA}/sf0.1"
    truth = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.queries()["op7_quality"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    own = [(r.doc_id, r.score, truth[r.doc_id][0]) for r in rows if r.doc_id in truth]
    assert quality.held_out_accuracy(own) > 0.97
    clean = [s for d, s, _ in own if truth[d] == (1, 0) and zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(clean) > 500 and sum(s < quality.THRESHOLD for s in clean) <= 0.005 * len(clean)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_cases(spark):
    texts = ["good words here and there, as usual " * 20, "%%% ### !!! $$$ " * 30] * 12
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(24)] + [(None, 1), (99, None)], "doc_id long, quality int")
    table = docs(spark, [*texts, None, "", "x" * 300_000, texts[0], texts[1]], [*range(24), 30, 31, None, 0, 0])
    net = quality.train(table, labels)
    rows = quality.score(table, net).collect()
    assert len(rows) == 29 and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in rows if r.doc_id is not None and 0 < r.doc_id < 24)
    kept = quality.keep_good(table, net)
    assert kept.columns == table.columns and kept.count() == sum(r.score >= quality.THRESHOLD for r in rows)
    assert quality.score(docs(spark, []), net).count() == 0 == quality.keep_good(docs(spark, []), net).count()
    assert quality.train(table, labels.limit(0)).score("x") == 1.0 and quality.fit([], []).score("x") == 1.0 and quality.fit(["a"], [0]).score("x") == 0.0


def test_quality_gradients():
    """The hand-made gradients against differences of the loss."""
    rng = np.random.default_rng(3)
    net = quality.Network.new(rng)
    for name in quality.LAYERS:
        setattr(net, name, getattr(net, name).astype(np.float64))
    data, label = rng.integers(32, 127, 900).astype(np.uint8), 1.0
    grads = {k: np.zeros(getattr(net, k).shape) for k in quality.LAYERS}
    net.learn(data, label, 1.0, grads)
    loss = lambda: -np.log(quality._sigmoid(float(net.pool(data) @ net.dense + net.offset[0])))
    for name in quality.LAYERS:
        value = getattr(net, name).reshape(-1)
        for at in rng.choice(len(value), min(6, len(value)), replace=False):
            was, step = value[at], 1e-5
            value[at] = was + step
            up = loss()
            value[at] = was - step
            down = loss()
            value[at] = was
            assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * step), abs=2e-4, rel=2e-2), name


def test_pooling_covers_the_document_in_pieces(monkeypatch):
    net = quality.Network.new(np.random.default_rng(1))
    data = np.frombuffer(("plain words " * 900).encode(), np.uint8)
    whole = net.pool(data)
    monkeypatch.setattr(quality, "PIECE", quality.CHUNK * 4)
    assert np.allclose(net.pool(data), whole, atol=0.1)
    assert not np.allclose(net.pool(np.concatenate([data, np.frombuffer(b"%#" * 600, np.uint8)])), whole, atol=0.01), "the end counts"


def brute_nearest(rows, top=10):
    """{query: [(distance, id)]} of plain rows (id, vector) for the ids that 100 divides."""
    x = {i: np.array(v, np.float64) for i, v in rows}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    out = {}
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        out[q] = sorted((float(a), int(i)) for a, i in zip(d, ids, strict=True) if i != q)[:top]
    return out


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[300:330] = v[0]
    plain = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows = [*plain, *plain[:3], (1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, []), (1004, [1.0, None] * 8), (1005, [1.0, 2.0]), (None, [1.0] * 16), (1006, [float("inf")] * 16)]
    table = ann.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = ann.nearest(table, table.where("vec_id % 100 = 0"), shard=200).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute_nearest(plain)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 54 and set(got) == set(want)
    assert [i for _, i in got[0]] == list(range(300, 310)) and all(s == 0 for s, _ in got[0])
    assert all(s == pytest.approx(np.sqrt(((np.float64(v[q]) - np.float64(v[i])) ** 2).sum()), abs=1e-12) for q, own in got.items() for s, i in own)
    assert 1005 not in {i for o in got.values() for _, i in o} and len(out) == 60
    none = table.limit(0)
    assert ann.nearest(none, none).count() == 0 == ann.nearest(table, none).count()


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_ann_recall_on_several_shards(spark, kind):
    """Shards of more nodes than are compared exactly; tight clusters are the hard case of a graph."""
    rng = np.random.default_rng(5)
    if kind == "spread":
        v = rng.normal(size=(6000, 24))
    else:
        v = (rng.normal(size=(100, 1, 24)) * 5 + rng.normal(size=(100, 60, 24)) * 0.05).reshape(-1, 24)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    table = ann.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    folder, shards = ann.build_index(table, shard=2500)
    assert shards.count() == 3
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 100 = 0"), index=(folder, shards)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) / (10 * len(want)) > 0.9


def test_ann_query_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").collect()]
    usable = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = queries.queries()["op8_ann"](spark, f"{DATA}/sf0.01").collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(usable)
    assert set(got) == set(want) and sum(len(got[q] & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.95


def test_lines_case(spark):
    texts = ["common\nown one", " common \n\nother", "common", None, "a\nb"]
    rows = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)] + [(0, texts[0], "s0")], "doc_id long, text string, source string")
    out = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(rows, min_sites=3).collect())
    assert out == [(0, "own one", 2, 1), (0, "own one", 2, 1), (1, "\nother", 3, 1), (2, "", 1, 1), (3, "", 1, 0), (4, "a\nb", 2, 0)]
    assert line_dedup.dedup_lines(rows.limit(0)).count() == 0


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = ["", None, " ", "a ", "a  b", "a\n b", "x <|endoftext|> y", "d'll 12 34%%% \0 z", "word " * 3000] + ["".join(rng.choice("ab'sé1% \n\t ") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    ids = [i * 7 - 50 for i in range(len(texts))]
    table = docs(spark, [*texts, "again", None], [*ids, ids[8], None])
    folder, manifest = token_store.write_tokens(table, path, shards=4)
    rows = token_store.read_tokens(folder, manifest).collect()
    want = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in zip(ids, texts, strict=True)}
    assert len(rows) == len(texts) + 2
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None and r.doc_id != ids[8]:
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes())
    assert sorted(r.ids_crc32 for r in rows if r.doc_id == ids[8]) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in (want[ids[8]], [*library.encode("again").ids, 2]))
    got = token_store.lookup(folder, manifest, [ids[3], ids[8], 10**12, None])
    assert [list(x) for x in got[None]] == [[2]]
    assert [list(x) for x in got[ids[3]]] == [want[ids[3]]] and len(got[ids[8]]) == 2 and got[10**12] == []
    assert token_store.tokenize(docs(spark, []), path).count() == 0


def test_token_rows_come_from_the_index(spark, monkeypatch):
    """Rows follow slot, number and offset: another number in the slots gives other rows, a lost level none."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = docs(spark, ["a", "b c", "d e f"], [5, 6, -(1 << 63)]).coalesce(1)
    folder, manifest = token_store.write_tokens(table, path, shards=1)
    (row,) = manifest.collect()
    with token_store.open_file(folder, row.file) as file:
        shard = token_store.Shard(file)
        keys = np.array([-(1 << 63), 5, 6])
        assert [x.tolist() for x in shard.documents(keys)] == [[0, 1, 2], [1, 1, 1]]
        shard.number = shard.number[::-1].copy()
        assert (shard.documents(keys)[0] < 0).any()
    assert sorted(r.doc_id for r in token_store.read_tokens(folder, manifest).collect()) == keys.tolist()


def test_many_rows_of_one_key_are_dealt_over_shards(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = spark.range(4000, numPartitions=8).selectExpr("cast(if(id % 3 = 0, null, 7) as long) as doc_id", "concat('w', id % 2) as text", "1 as row", "2 as of")
    folder, manifest = token_store.write_tokens(table, path, shards=8)
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1200
    rows = sorted(token_store.read_tokens(folder, manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert [r.doc_id for r in rows] == [None] * 1334 + [7] * 2666
    assert len(token_store.lookup(folder, manifest, [7])[7]) == 2666


def test_encoder_forgets_and_learns_anew(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "CACHE", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encode, rng = Tokenizer.from_file(path), token_store.Encoder(path), random.Random(2)
    for _ in range(6):
        texts = [words(rng, rng.randrange(0, 30), 60) for _ in range(5)]
        ids, counts = encode(pa.array(texts), 2)
        want = [[*library.encode(t).ids, 2] for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder_remembers_words_that_came_again(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE", 60)
    encode, rng = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    for _ in range(3):
        encode(pa.array(["a usual word"]), 2)
        encode(pa.array(["a " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(20))]), 2)
    assert {"usual", "word"} <= set(encode.words.to_pylist()) and len(encode.words) <= 60


def test_gathered_batches_are_within_their_bound():
    rows = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (400, 700, 300, 900, 2000, 10, 10)]})
    got = list(token_store._gathered(iter([rows.slice(i, 1) for i in range(rows.num_rows)]), 1200))
    assert [x for b in got for x in b.column("text").to_pylist()] == rows.column("text").to_pylist()
    assert all(b.nbytes <= 1200 or b.num_rows == 1 for b in got)


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
from quillgraph.llm import token_store
encode, rng = token_store.Encoder(sys.argv[1]), np.random.default_rng(0)
encode(pa.array(["a b"]), 2)
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
text = lambda: " ".join(f"{x:x}" for x in rng.zipf(1.3, 600) % 10**6)
docs = [pa.RecordBatch.from_pydict({"text": [text() for _ in range(250)]}) for _ in range(20)]
before = most()
for batch in token_store._gathered(iter(docs)):
    encode(batch.column("text"), 2)
print(most() - before)
"""


def test_encoder_takes_little_memory():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", MEMORY, public_tokenizers.path("byte_bpe_50k.json")], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert float(done.stdout) < 100


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000))
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert (index.find(np.arange(20_000)) >= 0).mean() < 0.001


def test_sql_of_the_queries(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/sf0.001/{name}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, f"{DATA}/sf0.001")
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall())), name


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    docs_, sizes = table, [table.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs_, f"{DATA}/sf0.001").write.parquet(f"{tmp_path}/{i}")
        docs_ = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs_.count())
        assert i == 4 or docs_.columns == table.columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100


def test_batches_are_bounded_by_bytes(spark):
    from quillgraph.llm import common

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    docs = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('x', 2000) as text")
    common.bound_batches(spark, 1 << 20)
    rows = [r["n"] for r in docs.mapInArrow(count, "n long").collect()]
    assert sum(rows) == 3000 and max(rows) < 600
    common.bound_batches(spark, 2 << 20)
    assert spark.conf.get(common.BATCH_KEY).removesuffix("b") == str(1 << 20)
    spark.conf.unset(common.BATCH_KEY)
