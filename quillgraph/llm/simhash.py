"""SimHash near-duplicate grouping by deletion-variant signatures.

Fingerprints of 64 bits link when they differ in at most ``MAX_BITS`` = 2 bits. Each fingerprint is cut
into two segments of 32 bits, fewer than the three that would force one equal segment, so of two linked
fingerprints one segment differs by at most one bit. The upper segment is indexed under its 32 one-wildcard
variants (catching pairs whose upper halves differ by 0 or 1 bit); if the upper halves differ by 2 bits the
lower ones are equal, so the lower segment is indexed once as it is. Buckets are equality groups over those
33 keys, and every link is verified on the whole fingerprints.

Work is on distinct fingerprints, so exact copies cost nothing. Variants are sorted by key once and buckets read
from that stream; up to ``BUCKET_LIMIT`` members are searched breadth-first for a spanning forest (never all
pairs). Larger buckets are cut again by two-wildcard variants of their remaining bits, an exact path: a member
has 528 such variants in each large bucket (at most 17,424 in all 33, if a family shares a half), whatever the
bucket's size.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any
other; repeated rows each get a result row; a null doc_id keeps its row and takes the component of its
fingerprint (the id is the smallest non-null doc_id, null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, tidy
from quillgraph.llm.near_copies import BROADCAST_ROWS, majority, near_copies
from quillgraph.operators.components import connected_components
from quillgraph.operators.skew import join_frequent

SEED = 42
SHINGLE = 3
MAX_BITS = 2
BUCKET_LIMIT = 20_000
#: Buckets up to this size are compared in one vectorised sweep over all buckets of a batch.
SWEEP = 24
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        first = [0, *(ends[:-1] + 1).tolist()]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(first, ends[shingle - 1 :].tolist(), strict=False)])
    return majority(digests)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp long) of each row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidy(_fingerprints), "doc_id long, fp long")


def _variants(fp: F.Column) -> F.Column:
    """33 bucket keys: tag << 32 | segment bits, the wildcard bit cleared."""
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    keys = [high.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << p))) + F.lit(p << 32) for p in range(32)]
    return F.array(*keys, low + F.lit(32 << 32))


def forest(members: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning-forest links of one bucket, breadth first: each member is compared with those not yet reached."""
    out, rest = [], members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = np.bitwise_count(rest ^ u) <= max_bits
            if near.any():
                found = rest[near]
                out += [(int(u), int(v)) for v in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _bucket_links(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Links within buckets of the sizes, one after another in ``flat``, as a forest over all of them (a union-find drops what is implied)."""
    bucket, size = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes)
    pairs = []
    small = size <= SWEEP
    a, b = flat[small], bucket[small]
    for d in range(1, min(SWEEP, int(sizes.max(initial=0)))):
        if len(a) <= d:
            break
        hit = (b[d:] == b[:-d]) & (np.bitwise_count(a[d:] ^ a[:-d]) <= MAX_BITS)
        pairs.append(np.stack([a[d:][hit], a[:-d][hit]], 1))
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes > SWEEP):
        if links := forest(flat[ends[i] - sizes[i] : ends[i]]):
            pairs.append(np.array(links, np.uint64))
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.uint64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for u, v in found.tolist():
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
            kept.append((u, v))
    return np.array(kept, np.uint64).reshape(-1, 2)


def _searched(limit: int):
    """From (key, fp) sorted by key: the links within buckets as (null, src, dst), and the members of buckets over the limit as (key, fp, null)."""

    def links_of(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(key)])
        of = np.repeat(sizes, sizes)
        out = _bucket_links(fp[of <= limit], sizes[sizes <= limit]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int64()), pa.array(out[:, 0]), pa.array(out[:, 1])], ["key", "src", "dst"])
        if (of > limit).any():
            yield members(key[of > limit], fp[of > limit])

    def members(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.nulls(len(key), pa.int64())], ["key", "src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            k, f = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if large is not None:  # a bucket over the limit is passed on as it comes
                more = int(np.searchsorted(k, large, "right"))
                if more:
                    yield members(k[:more], f[:more])
                k, f = k[more:], f[more:]
            if not len(k):
                continue
            key, fp, large = np.concatenate([key, k]), np.concatenate([fp, f]), None
            cut = int(np.searchsorted(key, key[-1], "left"))
            yield from links_of(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
            if len(key) > limit:
                yield members(key, fp)
                key, fp, large = key[:0], fp[:0], int(key[0])
        yield from links_of(key, fp)

    return run


def links(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(src, dst) links that connect what is within two bits, from distinct ``fp``."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes of fingerprints become 33 times as many: they are spread before
    variants = prints.repartition(n, "fp").select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    found = materialize(variants.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_searched(bucket_limit)), "key long, src long, dst long"))
    usual, hot = found.where("key is null").select("src", "dst"), found.where("key is not null").select("key", F.col("src").alias("fp"))
    return usual if hot.isEmpty() else usual.unionByName(_hot_links(hot))


def _hot_links(members: DataFrame) -> DataFrame:
    """Links within large buckets (key, fp): members that agree outside two of the 33 bits left open meet in groups of four at most."""
    tag = "shiftright(key, 32)"
    open_bit = lambda c: F.expr(
        f"case when {tag} = 32 then if({c} < 32, shiftleft(1L, cast(32 + {c} as int)), 0L)"
        f" when {c} < 32 then shiftleft(1L, cast({c} as int)) else shiftleft(1L, cast(32 + {tag} as int)) end"
    )
    wild = members.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("j", F.explode(F.expr("sequence(i + 1, 32)")))
    cut = wild.select("key", "i", "j", "fp", F.col("fp").bitwiseAND(F.bitwise_not(open_bit("i").bitwiseOR(open_bit("j")))).alias("cut"))
    met = cut.groupBy("key", "i", "j", "cut").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
    return met.select(F.array_min("met").alias("dst"), F.explode("met").alias("src")).where("src <> dst").select("src", "dst")


def near_duplicates(documents: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``documents``."""
    prints = materialize(fingerprints(documents))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    edges = materialize(links(distinct.select("fp"), bucket_limit).distinct())
    groups = connected_components(edges)
    named = materialize(distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "copies", F.coalesce("component", "fp").alias("component")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    total = prints.count()
    of = join_frequent(named, smallest, "component", "members", total).select("fp", "copies", "component_id")
    return join_frequent(prints, of, "fp", "copies", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_texts(texts: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(src, dst), src < dst: pairs of texts (node, fp) that connect those whose fingerprints are equal or linked."""
    lead = materialize(texts.groupBy("fp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")))
    equal = join_frequent(texts, lead, "fp", "n", texts.count()).where("node <> lead").select(F.col("lead").alias("src"), F.col("node").alias("dst"))
    of = lambda end: lead.select(F.col("fp").alias(end), F.col("lead").alias(f"_{end}"))
    linked = links(lead.select("fp"), bucket_limit).distinct().join(of("src"), "src").join(of("dst"), "dst")
    return equal.unionByName(linked.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")))


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with one document of each group of near copies: the smallest doc_id, and of its rows of one text one (different texts under a doc_id stay together).

    By SimHash of five-word shingles: what the deletion variants of its fingerprints link is verified by Jaccard similarity, 0.8 or more, on
    the whole sets. Fingerprints of such texts may differ by more bits than the variants reach, so ``near_copies`` completes the groups by an
    exact way. Rows without a doc_id can't stand for a group and are kept as they are.
    """
    own = documents.where("doc_id is not null")
    ids = materialize(near_copies(own, near=near_texts).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count(F.lit(1)).alias("n")))
    out = _without(own, ids.where("not kept"), "left_anti")
    repeated = ids.where("kept and n > 1")
    if not repeated.isEmpty():
        out = _without(out, repeated, "left_anti").unionByName(_without(out, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.unionByName(documents.where("doc_id is null"))


def _without(documents: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``documents`` semi- or anti-joined with ``ids``; documents stay where they are beside few ids."""
    listed = ids.select(F.col("doc_id").alias("__qg_id"))
    if listed.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    return documents.join(listed, F.col("doc_id") == F.col("__qg_id"), how)
