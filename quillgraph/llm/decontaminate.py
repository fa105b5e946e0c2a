"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is found in a document that contains at least ``CONTAINMENT`` = 0.8 of the item's distinct shingles of
five words. Items are partitioned by size (number of distinct shingles, classes growing by ``GROWTH``). Each
class has an index of its own over its items' bottom-k MinHash sketches, the k smallest values of one hash over
an item's shingles; a document probes only the classes of which it is large enough to hold an item. A banded Jaccard index loses a 30-word item in a 20,000-word document (Jaccard 0.001), so the class
fixes k from its largest size u instead: k = floor(0.2 u) + 1. A document that holds 0.8 of an item lacks at
most floor(0.2 n) of its shingles and so holds at least one of the k: no match is lost, whatever the
document's length. Documents too small for an item (fewer than 0.8 n shingles) are skipped, and each
candidate is verified on the words themselves.

Documents are read once and nothing is shuffled. The items are broadcast in blocks of bounded size; a benchmark
of several blocks takes as many passes over the documents, whose results are put together.

Words are the runs of letters, digits, underscores and non-ASCII characters of the lower-cased text. Defined
results: null or word-less texts match nothing; a text of one to four words has its whole sequence as its only
shingle; repeated items and documents each give their own rows; documents with null doc_id are reported with
null; items with null item_id are left out of the benchmark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import tidy


SHINGLE = 5
CONTAINMENT = 0.8
GROWTH = 1.5
#: Bytes of item text in a block, which bounds the broadcast.
BLOCK_BYTES = 8_000_000
#: Bytes of documents that are hashed together.
CHUNK = 1 << 20
WORD = re.compile(rb"[a-z0-9_\x80-\xff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_", *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def shingles(tokens: list[bytes], k: int = SHINGLE) -> set[bytes]:
    """The distinct shingles; of fewer than k words the whole sequence."""
    if not tokens:
        return set()
    return {b" ".join(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK)
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, _BASE))])
            _POWERS["down"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64))))])
    return _POWERS["up"], _POWERS["down"]


def shingle_hashes(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MinHash values of the shingles of lower-cased texts, with the text each belongs to, and the words of each text."""
    joined = b"\n".join(texts) + b"\n"
    buffer = np.frombuffer(joined, np.uint8)
    is_word = _IS_WORD[buffer]
    edge = np.flatnonzero(np.diff(is_word, prepend=False))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=total[1:])
    word = _mix((total[end] - total[start]) * down[start])
    limits = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(limits, start, side="right")
    counts = np.bincount(of, minlength=len(texts))
    n = len(word) - k + 1
    hashes, owner = [], []
    if n > 0:
        value = np.zeros(n, np.uint64)
        for i in range(k):
            value = value * np.uint64(0xD1342543DE82EF95) + word[i : i + n]
        same = of[:n] == of[k - 1 :]
        hashes.append(_mix(value[same]))
        owner.append(of[:n][same])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        value = np.zeros(1, np.uint64)
        for i in range(counts[t]):
            value = value * np.uint64(0xD1342543DE82EF95) + word[first[t] + i : first[t] + i + 1]
        hashes.append(_mix(value + np.uint64(counts[t])))
        owner.append(np.array([t]))
    return (np.concatenate(hashes), np.concatenate(owner), counts) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64), counts)


class SizeClass:
    """The bottom-k sketches of the items of one size class: k is fixed by the class's largest size."""

    def __init__(self, largest: int, items: list[int], own: list[np.ndarray], need: int, containment: float):
        self.k, self.need = math.floor((1 - containment) * largest + 1e-9) + 1, need
        sketches = [hashes[: self.k] for hashes in own]
        flat, item = np.concatenate(sketches), np.repeat(items, [len(x) for x in sketches])
        order = np.argsort(flat, kind="stable")
        self.flat, self.item = flat[order], item[order]

    def probe(self, hashes: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of the hashes that are in an item's sketch."""
        low, high = np.searchsorted(self.flat, hashes, "left"), np.searchsorted(self.flat, hashes, "right")
        return {(int(owner[i]), int(self.item[j])) for i in np.flatnonzero(high > low) for j in range(low[i], high[i])}


def size_class(n: int) -> int:
    """The largest size of the class that items of n shingles are in."""
    c = math.ceil(math.log(max(1, n), GROWTH) - 1e-9)
    return max(n, math.floor(GROWTH**c))


class Sketches:
    """The indexes of a block of items, one for each size class."""

    def __init__(self, items: list[tuple[int, str | None]], containment: float = CONTAINMENT, k: int = SHINGLE):
        self.k, self.containment = k, containment
        self.ids = [i for i, _ in items]
        self.shingles = [shingles(words(t), k) for _, t in items]
        self.need = [max(1, math.ceil(containment * len(s) - 1e-9)) for s in self.shingles]
        hashes, owner, _ = shingle_hashes([(t or "").lower().encode("utf-8", "surrogatepass") for _, t in items], k) if items else (np.zeros(0, np.uint64), np.zeros(0, np.int64), None)
        order = np.lexsort((hashes, owner))
        cuts = np.searchsorted(owner[order], np.arange(len(items) + 1))
        own = [np.unique(hashes[order][cuts[i] : cuts[i + 1]]) for i in range(len(items))]
        members: dict[int, list[int]] = {}
        for i, found in enumerate(own):
            if len(found):
                members.setdefault(size_class(len(self.shingles[i])), []).append(i)
        self.classes = [SizeClass(u, of, [own[i] for i in of], min(self.need[i] for i in of), containment) for u, of in sorted(members.items())]
        self.filter = np.zeros(1 << 22, bool)
        for c in self.classes:
            self.filter[c.flat >> np.uint64(42)] = True

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of the matches among lower-cased texts; a text probes the classes of which it can hold an item."""
        hashes, owner, counts = shingle_hashes(texts, self.k)
        maybe = self.filter[hashes >> np.uint64(42)]
        hashes, owner = hashes[maybe], owner[maybe]
        room = np.maximum(1, counts - self.k + 1)[owner]  # shingles of the text, repeats included
        found = set()
        for c in self.classes:
            large = room >= c.need
            found |= c.probe(hashes[large], owner[large])
        last, own = -1, set()
        for text, item in sorted(found):
            if max(1, counts[text] - self.k + 1) < self.need[item]:
                continue
            if text != last:
                last, own = text, shingles(WORD.findall(texts[text]), self.k)
            shared = len(own & self.shingles[item])
            if shared >= self.need[item]:
                yield text, item, shared


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").lower().encode("utf-8", "surrogatepass")
        held.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _blocks(benchmark: DataFrame, containment: float, k: int) -> Iterator[Sketches]:
    """The benchmark's sketches in blocks whose text is bounded; a block is collected alone."""
    items = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = math.ceil(2 * size / BLOCK_BYTES) if size > BLOCK_BYTES else 1
    for b in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        rows = block.collect()
        if rows:
            yield Sketches([(r[0], r[1]) for r in rows], containment, k)


def find_items(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): each document with each item that it contains."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    out = None
    for block in _blocks(benchmark, containment, k):
        held = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            s = held.value
            for batch in batches:
                ids, found = batch.column("doc_id"), []
                for first, texts in _chunks(batch.column("text").to_pylist()):
                    found += [(ids[first + t].as_py(), s.ids[i], n, len(s.shingles[i])) for t, i, n in s.search(texts)]
                columns = [pa.array([f[c] for f in found], pa.int64()) for c in range(4)]
                share = pa.array([f[2] / f[3] for f in found], pa.float64())
                yield pa.RecordBatch.from_arrays([*columns, share], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        part = docs.mapInArrow(tidy(search), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """The rows of ``documents`` that contain no benchmark item, all columns kept."""
    out, spark = documents, documents.sparkSession
    for block in _blocks(benchmark, containment, k):
        held = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, texts in _chunks(batch.column("text").to_pylist()):
                    clean[[first + t for t, _, _ in held.value.search(texts)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(tidy(keep), documents.schema)
    return out
