"""Near copies by exact Jaccard similarity of word shingles: what the pipeline's near-dedup stage, on SimHash (``simhash.keep_one``), verifies by and completes.

Texts link when the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Candidates come
from prefixes: with all shingles in one order, of two linked sets of n and m some shared one stands at places
i and j with min(n - i, m - j) >= (n + m) 4/9, so indexing the first n - ceil(0.8 n) + 1 shingles of each set
can't miss a pair. The order is by hash, except that shingles that are frequent in a sample come last; which ones
these are changes the number of candidates, never the links. Each candidate is verified on the whole sets.

Work is on distinct texts (equal words), and only what joins components is of use. Two texts that alone have a
prefix shingle are a pair. In a larger group each text is first paired with the smallest id of the group, which near copies
mostly share; groups of shingles that a hundredth of the sample has are not gathered for that. Each text is verified
against one candidate, the smallest; the other pairs of two follow. Then groups that are still of several components are looked
at again, dealt in blocks: first for pairs that would join all their components (``FOREST`` times, as not all of those hold), at last
for all pairs of different components, each given only where its texts' shared groups begin or go apart. A pair is verified, once, only if the counts of its sets by hash bucket (``signature``, a byte for four
shingles) allow enough common ones. Verification brings a text to its candidate's, which is held once for all texts
that are compared with it; a candidate of many texts is held by several tasks.

Defined results: null text counts as empty; texts without words are equal to each other; a text of less than five
words is one shingle; shingles count as equal by their 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, tidy
from quillgraph.operators.components import connected_components
from quillgraph.operators.skew import join_frequent

SEED = 42
SHINGLE = 5
SWEEP = 2
#: Share of the documents in which frequent shingles are looked for; how many texts of it, and which share, make a shingle frequent, and hot.
SAMPLE = 0.05
FREQUENT = 3
HOT = 0.01
MOST_FREQUENT = 200_000
#: Members of a large group in a block; buckets in which blocks are compared first.
BLOCK = 512
FOLD = 64
#: Rounds in which a group gives just enough pairs to join its components, before the one for all pairs.
FOREST = 2
#: Shingles for each count of a signature.
PER_BUCKET = 4
#: Texts that are compared with one candidate in one task.
PER_LEADER = 500
#: Comparisons whose ids are broadcast (some 50 bytes each), so that only their texts are shuffled.
BROADCAST_ROWS = 300_000
#: Texts that a task remembers so as not to index their copies again.
SEEN = 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def node(own: list[bytes]) -> int:
    """The id of a text: a signed hash of its words."""
    return xxhash.xxh64_intdigest(b" ".join(own), SEED) - (1 << 63)


def shingles(own: list[bytes]) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, one for less than ``SHINGLE`` words."""
    joined = b" ".join(own)
    if len(own) <= SHINGLE:
        return np.frombuffer(xxhash.xxh64_digest(joined, SEED), np.uint64)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    first = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(first, ends[SHINGLE - 1 :].tolist(), strict=False)]), np.uint64))


def majority(digests: bytes) -> int:
    """The unsigned 64-bit fingerprint of big-endian hashes: a bit is 1 if set in over half of them."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(bits)).tobytes(), "big")


def prefix(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set by hash, frequent ones (sorted) last: as many as can't all be missed."""
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[: len(own) - (4 * len(own) + 4) // 5 + 1]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = [shingles(words(t.as_py())).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.list_(pa.int64()))], ["shingles"])


def sets(documents: DataFrame) -> DataFrame:
    """(shingles) per row."""
    return _texts(documents).mapInArrow(tidy(_sets), "shingles array<long>")


def signature(own: np.ndarray) -> bytes:
    """How many shingles of a set fall in each of a power of two of hash buckets, about ``PER_BUCKET`` on the average, a byte each."""
    n = 1 << max(0, len(own) // PER_BUCKET).bit_length()
    while (counts := np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n)).max() > 255:
        n *= 2
    return counts.astype(np.uint8).tobytes()


def may_be_similar(a: bytes, b: bytes) -> bool:
    """Whether sets with these signatures can be: in no bucket can more be common than the smaller count."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = x.reshape(-1, n).sum(0, dtype=np.int64), y.reshape(-1, n).sum(0, dtype=np.int64)
    return 9 * int(np.minimum(x, y).sum()) >= 4 * int(x.sum() + y.sum())


def frequent_shingles(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles seen in ``FREQUENT`` or more texts of a sample of the share ``SAMPLE``, the most frequent ones; and those that ``HOT`` of them have."""
    part = documents.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(SAMPLE * (1 << 30)))
    seen = sets(part).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    rows = seen.orderBy(F.col("n").desc(), "s").limit(MOST_FREQUENT).collect()
    least = max(FREQUENT, HOT * part.count())
    sorted_ = lambda values: np.sort(np.array(values, np.int64).view(np.uint64))
    return sorted_([r["s"] for r in rows]), sorted_([r["s"] for r in rows if r["n"] >= least])


def _index(frequent: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, firsts, marks, prints = [], [], [], [], []
            for text in batch.column("text"):
                own = words(text.as_py())
                nodes.append(node(own))
                if nodes[-1] in seen:
                    sizes.append(0)
                    firsts.append(np.zeros(0, np.int64))
                    marks.append(None)
                    prints.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(nodes[-1])
                whole = shingles(own)
                sizes.append(len(whole))
                firsts.append(prefix(whole, frequent).view(np.int64))
                marks.append(signature(whole))
                prints.append(majority(whole.astype("<u8").tobytes()) - (1 << 63))
            columns = [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "first", "mark", "fp"])

    return run


def _near(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m that share a shingle at places i and j, and none before, can be similar."""
    return 9 * np.minimum(n - i, m - j) >= 4 * (n + m)


def _near_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _near(a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF)


MET = "token long, src long, dst long, place long"


def _met(src: np.ndarray, dst: np.ndarray, lead: int | None = None) -> pa.RecordBatch:
    """Pairs; place 0 tells those with the smallest of a large group."""
    none = pa.nulls(len(src), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(src), pa.array(dst), none if lead is None else pa.array(np.full(len(src), lead))], ["token", "src", "dst", "place"])


def _members(token: np.ndarray, who: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows of large groups."""
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(place)], ["token", "src", "dst", "place"])


def _first_pairs(sweep: int) -> Callable:
    """From (token, node, place) sorted by token and node: the pairs of small groups, and of large ones those with their first member, and their rows."""

    def of_large(token: np.ndarray, who: np.ndarray, place: np.ndarray, lead: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        near = (who != lead[0]) & _near_places(place, np.full(len(place), lead[1]))
        yield _met(np.full(int(near.sum()), lead[0]), who[near], 0)
        yield _members(token, who, place)

    def of_groups(t: np.ndarray, w: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(t)])
        size = np.repeat(sizes, sizes)
        pairs, small = [np.zeros((0, 2), np.int64)], (size > 1) & (size <= sweep)
        a, b, c = t[small], w[small], p[small]
        for d in range(1, min(sweep, int(sizes.max(initial=0)))):
            hit = (a[d:] == a[:-d]) & (b[d:] != b[:-d]) & _near_places(c[d:], c[:-d])
            pairs.append(np.stack([b[:-d][hit], b[d:][hit]], 1))
        found = np.unique(np.concatenate(pairs), axis=0)
        yield _met(found[:, 0], found[:, 1])
        for g in np.flatnonzero(sizes > sweep):
            of = slice(starts[g], starts[g] + sizes[g])
            yield from of_large(t[of], w[of], p[of], (int(w[starts[g]]), int(p[starts[g]])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, w, p = (np.zeros(0, np.int64),) * 3
        large = None  # a large group that goes on: its token and first member
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if large is not None:
                more = int(np.searchsorted(now[0], large[0], "right"))
                yield from of_large(*(c[:more] for c in now), large[1])
                now = [c[more:] for c in now]
            if not len(now[0]):
                continue
            t, w, p = (np.concatenate(x) for x in zip((t, w, p), now, strict=True))
            large = None
            cut = int(np.searchsorted(t, t[-1], "left"))
            yield from of_groups(t[:cut], w[:cut], p[:cut])
            t, w, p = t[cut:], w[cut:], p[cut:]
            if len(t) > sweep:
                large = (int(t[0]), (int(w[0]), int(p[0])))
                yield from of_large(t, w, p, large[1])
                t, w, p = t[:0], w[:0], p[:0]
        yield from of_groups(t, w, p)

    return run


def _first_met(postings: DataFrame, hot: np.ndarray, sweep: int) -> DataFrame:
    """What ``_first_pairs`` gives, for all postings; the groups of ``hot`` shingles are large and not gathered."""
    usual = postings
    out = None
    if len(hot):
        spark = postings.sparkSession
        known = F.broadcast(spark.createDataFrame([(int(x),) for x in hot.view(np.int64)], "token long"))
        own = postings.join(known, "token")
        first = own.groupBy("token").agg(F.min(F.struct("node", "place")).alias("lead"))
        n, i = lambda p: F.shiftright(p, 32), lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF))
        a, b = F.col("place"), F.col("lead.place")
        near = 9 * F.least(n(a) - i(a), n(b) - i(b)) >= 4 * (n(a) + n(b))
        lead = own.join(F.broadcast(first), "token").where((F.col("node") != F.col("lead.node")) & near)
        null = F.lit(None).cast("long")
        out = own.select("token", F.col("node").alias("src"), null.alias("dst"), "place").unionByName(lead.select(null.alias("token"), F.col("lead.node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("place")))
        usual = postings.join(known, "token", "left_anti")
    met = usual.select("token", "node", "place").repartition("token").sortWithinPartitions("token", "node").mapInArrow(tidy(_first_pairs(sweep)), MET)
    return met if out is None else met.unionByName(out)


def _folded(mark: bytes, buckets: int) -> np.ndarray:
    """A signature in at most so many buckets, spread over as many."""
    x = np.frombuffer(mark, np.uint8)
    n = min(len(x), buckets)
    out = np.zeros(buckets, np.int32)
    out[:n] = x.reshape(-1, n).sum(0)
    return out


def _other_pairs(forest: bool) -> Callable:
    """From rows (token, block, side, node, place, component, mark, before) sorted by block: the pairs of side 0 and side 1 whose components differ and whose signatures allow it.

    Texts whose last shared group before this one is the same (``before``, its token) meet there too, no later in their orders, and are left to it. As a ``forest`` only those that join components which the block's earlier pairs, if they hold, have not joined, the likeliest first.
    """

    def pairs_of(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        asking, other = ([r for r in rows if r["side"] == k] for k in (0, 1))
        if not asking or not other:
            return
        who, place, part = (np.array([r[c] for r in other], np.int64) for c in ("node", "place", "component"))
        size, before, first = place >> 32, np.array([r["before"] or 0 for r in other], np.int64), np.array([r["before"] is None for r in other], bool)
        # buckets of equal number are comparable where both signatures have FOLD of them; shorter ones are left to the exact look
        fold, full = np.stack([_folded(r["mark"], FOLD) for r in other]), np.array([len(r["mark"]) >= FOLD for r in other], bool)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def fitting(r: dict) -> tuple[np.ndarray, np.ndarray]:
            """What may be similar to a text, and the share of both sets that can be common (the least that is asked where too few buckets tell it)."""
            new = first | (before != r["before"]) if r["before"] is not None else True
            at = np.flatnonzero((part != r["component"]) & new & _near_places(place, np.full(len(place), r["place"])))
            share = np.full(len(at), 4 / 9)
            if len(at) and len(r["mark"]) >= FOLD:
                most, both = np.minimum(fold[at], _folded(r["mark"], FOLD)).sum(1), size[at] + (r["place"] >> 32)
                fits = ~full[at] | (9 * most >= 4 * both)
                at, share = at[fits], np.where(full[at], most / both, 4 / 9)[fits]
            return at, share

        if forest:  # the likeliest pairs first, as components are joined by the first ones
            asking = [r for _, r in sorted(((-float(fitting(r)[1].max(initial=0)), r) for r in asking), key=lambda x: x[0])]
        src, dst = [], []
        for r in asking:
            at, share = fitting(r)
            if forest:
                at = at[np.argsort(-share, kind="stable")]
            for x in at.tolist():
                if forest and root(r["component"]) == root(other[x]["component"]):
                    continue
                if may_be_similar(r["mark"], other[x]["mark"]):
                    parent[root(r["component"])] = root(other[x]["component"])
                    src.append(min(r["node"], other[x]["node"]))
                    dst.append(max(r["node"], other[x]["node"]))
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # a block and those that ask
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["token"], row["block"]) != (held[0]["token"], held[0]["block"]):
                    yield from pairs_of(held)
                    held = []
                held.append(row)
        if held:
            yield from pairs_of(held)

    return run


def _other(large: DataFrame, groups: DataFrame, first: DataFrame, turn: int | None) -> DataFrame:
    """The distinct pairs of large groups (token, node, place) that are in different components and may be similar, materialised.

    Groups that are of one component by now are dropped before anything is gathered. Members of the others are dealt to blocks of
    about ``BLOCK``, each once; those that aren't of a group's largest component, one of which is in every pair, ask in all its
    blocks. In a ``turn`` of a forest each text takes part in one of its groups, by turns that of most members and that of fewest.
    """
    placed = materialize(large.join(groups, "node", "left").select("token", "node", "place", F.coalesce("component", "node").alias("component")))
    parts = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = materialize(parts.groupBy("token").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("c", "component")).alias("top")).where("parts > 1").drop("parts"))
    rows = join_frequent(placed, mixed.withColumn("total", F.col("n")), "token", "n", placed.count())
    if turn is not None:
        of = F.struct(F.col("total") if turn % 2 == 0 else -F.col("total"), "token")
        rows = materialize(rows)
        rows = rows.join(rows.groupBy("node").agg(F.max(of)["token"].alias("token")), ["node", "token"])
    rows = rows.join(first.select("node", "mark"), "node").withColumn("k", F.ceil(F.col("total") / BLOCK).cast("int"))
    rows = rows.withColumn("before", F.lag("token").over(Window.partitionBy("node").orderBy("place")) if turn is None else F.lit(None).cast("long"))
    columns = ["node", "place", "component", "mark", "before"]
    dealt = rows.select("token", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("block"), F.lit(1).alias("side"), *columns)
    asking = rows.where("component <> top").select("token", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), F.lit(0).alias("side"), *columns)
    met = dealt.unionByName(asking).repartition("token", "block").sortWithinPartitions("token", "block", "side", "node")
    return materialize(met.mapInArrow(tidy(_other_pairs(turn is not None)), "src long, dst long").distinct())


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fits = [may_be_similar(a.as_py(), b.as_py()) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
        yield batch.select(["src", "dst"]).filter(pa.array(fits, pa.bool_()))


def _candidates(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The distinct pairs (src, dst) whose signatures allow that they are similar, materialised."""
    of = lambda end, name: first.select(F.col("node").alias(end), F.col("mark").alias(name))
    marked = pairs.distinct().join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("src", "dst", "a", "b")
    return materialize(marked.mapInArrow(tidy(_plausible), "src long, dst long"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (src, salt, node, text) in which src's own text comes before those that are compared with it: the similar pairs."""
    leader, own, last = None, np.zeros(0, np.uint64), None
    for batch in batches:
        src, dst = [], []
        columns = [batch.column(c) for c in ("src", "salt", "node", "text")]
        for i in range(batch.num_rows):
            of, salt, who, text = (c[i].as_py() for c in columns)
            if (of, salt, who) == last:
                continue  # a repeated row
            if (of, salt) == leader and who == of:
                continue
            read = words(text)
            if node(read) != who:
                continue  # another text under the same doc_id
            last = (of, salt, who)
            if who == of:
                leader, own = (of, salt), shingles(read)
            elif (of, salt) == leader:
                other = shingles(read)
                if 9 * len(np.intersect1d(own, other, assume_unique=True)) >= 4 * (len(own) + len(other)):
                    src.append(of)
                    dst.append(who)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _verified(pairs: DataFrame, documents: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose whole sets are similar; ``pairs`` is materialised and distinct."""
    parts = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / PER_LEADER).cast("int").alias("parts"))
    salted = join_frequent(pairs, parts.withColumn("n", F.col("parts") * PER_LEADER), "src", "n", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("dst"), F.col("parts")))
    ids = first.select(F.col("node").alias("who"), "doc_id")
    # in the order of (src, salt, at) the candidate's own text comes first
    members = salted.select("src", "salt", F.lit(1).alias("at"), F.col("dst").alias("who"))
    leaders = parts.select("src", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("at"), F.col("src").alias("who"))
    asked = materialize(members.unionByName(leaders).join(ids, "who"))
    few = asked.count() <= BROADCAST_ROWS
    texts = _texts(documents).join(F.broadcast(asked) if few else asked, "doc_id").select("src", "salt", "at", F.col("who").alias("node"), "text")
    sorted_ = texts.repartition("src", "salt").sortWithinPartitions("src", "salt", "at", "node").select("src", "salt", "node", "text")
    return materialize(sorted_.mapInArrow(tidy(_compare), "src long, dst long"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    placed = pairs.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return placed.where(F.coalesce("_src", "src") != F.coalesce("_dst", "dst")).select("src", "dst")


def near_copies(documents: DataFrame, sweep: int = SWEEP, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, component_id) per row of ``documents``: the smallest doc_id of the texts connected by links.

    ``near`` gives pairs (src, dst) of distinct texts (node, fp) to be verified first, from their fingerprints (``majority`` of the shingles, less 2 ** 63).
    """
    frequent, hot = frequent_shingles(documents)
    index = materialize(_texts(documents).mapInArrow(tidy(_index(frequent)), "doc_id long, node long, n int, first array<long>, mark binary, fp long"))
    first = materialize(index.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("mark").alias("mark"), F.max("fp").alias("fp")))
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("place")
    postings = index.select(F.posexplode("first").alias("i", "token"), "node", "n").select("token", "node", place)
    met = materialize(_first_met(postings, hot, sweep))
    pairs = met.where("token is null")
    least = pairs.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")
    tried = _candidates(near(first.select("node", "fp")).unionByName(least) if near else least, first)
    links = _verified(tried, documents, first)
    groups = materialize(connected_components(links))
    small = pairs.where("place is null").select("src", "dst").distinct()
    large = materialize(met.where("token is not null").select("token", F.col("src").alias("node"), "place").distinct())
    turns = iter([*range(FOREST), None])
    more = _candidates(_apart(small, groups), first)
    while True:
        rest = materialize(more.join(tried, ["src", "dst"], "left_anti"))
        found = not rest.isEmpty()
        if found:
            tried, links = tried.unionByName(rest), links.unionByName(_verified(rest, documents, first))
            groups = materialize(connected_components(links))
        turn = next(turns, -1)
        if turn == -1:
            break
        if turn and not found:  # a forest that finds nothing ends them
            turn = None
            turns = iter(())
        more = _other(large, groups, first, turn)
    named = materialize(first.join(groups, "node", "left").select("node", "doc_id", "copies", F.coalesce("component", "node").alias("component")))
    sizes = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    total = index.count()
    of = join_frequent(named, sizes, "component", "members", total).select("node", "copies", "component_id")
    return join_frequent(index.select("doc_id", "node"), of, "node", "copies", total).select("doc_id", "component_id")
