"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, kept as flat arrays.

Vectors are deduplicated first (equal vectors are one node that stands for its smallest ids, which no result
can need more of), then hashed to shards. A shard grows with the table, from ``SHARD`` nodes to what
``SHARD_BYTES`` of vectors allow, so that there are about as many shards as shuffle partitions. A shard's graph is a file
in the shared folder: vectors, and for every layer a flat neighbour array (node x slots, -1 for none). Queries are
written there once, in blocks; a task loads one graph, reads the blocks one after another and answers each by a
best-first search from layer to layer, so neither graphs nor queries are multiplied by a join. The shards' answers
are merged by rank.

Graphs are built by insertion in hash order, a block of nodes at a time: each node is searched for in the graph of
the earlier nodes, as a query would be, and compared with the others of its block; its neighbours are chosen by the
usual rule that drops a candidate nearer to a chosen neighbour than to the node, and reverse links are cut by the same
rule. Work is about n log n for a shard. Searches run for a block together, by array operations.

Recall of the ten nearest on check_s (10,256 vectors): see README; tests measure it again on several shards and on clusters.

Defined results: vectors that are null or empty, zero, or hold null or non-finite components take no part;
vectors of different lengths are never neighbours (each length has its own shards); repeated vec_ids with equal vectors
count as one, with different ones each is a candidate and a query of its own, of which the nearer counts for a pair of ids; ties go to the smaller vec_id;
an empty table, or no queries, give no rows; other columns are not read.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, shared_path, tidy
from quillgraph.llm.storage import NewFile, open_file

TOP = 10
#: Nodes of a shard at least, and bytes of its vectors at most.
SHARD = 4096
SHARD_BYTES = 64 << 20
#: Queries, or new nodes, that are searched for together.
BLOCK = 256
LINKS = 16  # neighbours of a node in the upper layers; twice as many at the bottom
CANDIDATES = 64
BREADTH = 96
DESCENT = 8
#: Nodes that are expanded at once for each query.
EXPAND = 2
HEAD = struct.Struct("<QQQ")


def search_layer(vectors: np.ndarray, squares: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for each of ``queries`` from its ``entry`` nodes (-1: none): the ``breadth`` nearest nodes met (-1: fewer), and their squared distances.

    Each round expands the nearest nodes that were not expanded yet; a query is done when all its ``breadth`` nearest are.
    """
    n, width = len(queries), links.shape[1]
    every = np.arange(n)[:, None]
    own = (queries * queries).sum(1)
    seen = np.zeros((n, len(vectors)), bool)

    def distances(of: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        products = np.matmul(vectors[nodes], queries[of][:, :, None])[:, :, 0]
        return np.maximum(squares[nodes] + own[of][:, None] - 2 * products, 0)

    found = np.full((n, breadth), -1, np.int64)
    far = np.full((n, breadth), np.inf, vectors.dtype)
    done = np.ones((n, breadth), bool)
    first = entry[:, :breadth]
    k = first.shape[1]
    known = first >= 0
    found[:, :k] = first
    far[:, :k] = np.where(known, distances(np.arange(n), np.maximum(first, 0)), np.inf)
    done[:, :k] = ~known
    seen[np.broadcast_to(every, first.shape)[known], first[known]] = True
    while True:
        waiting = np.where(done, np.inf, far)
        active = np.flatnonzero(~done.all(1))
        if not len(active):
            return found, far
        pick = np.argpartition(waiting[active], EXPAND - 1, axis=1)[:, :EXPAND] if breadth > EXPAND else np.tile(np.arange(breadth), (len(active), 1))
        row = active[:, None]
        usable = ~done[row, pick]
        nodes = np.where(usable, found[row, pick], -1)
        done[row, pick] = True
        near = np.where((nodes >= 0)[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        order = np.sort(near, axis=1)  # a node that two expanded ones share counts once
        near = np.where(np.concatenate([np.zeros((len(active), 1), bool), order[:, 1:] == order[:, :-1]], 1), -1, order)
        new = (near >= 0) & ~seen[row, np.maximum(near, 0)]
        seen[np.broadcast_to(row, near.shape)[new], near[new]] = True
        columns = new.any(0)
        near, new = near[:, columns], new[:, columns]
        if not near.shape[1]:
            continue
        dist = np.where(new, distances(active, np.maximum(near, 0)), np.inf)
        all_far = np.concatenate([far[active], dist], 1)
        all_found = np.concatenate([found[active], np.where(new, near, -1)], 1)
        all_done = np.concatenate([done[active], ~new], 1)
        best = np.argpartition(all_far, breadth - 1, axis=1)[:, :breadth]
        far[active], found[active], done[active] = (np.take_along_axis(x, best, 1) for x in (all_far, all_found, all_done))


def _choose(order: np.ndarray, dist: np.ndarray, vectors: np.ndarray, most: int) -> list[int]:
    """Of candidates in order of distance, those not nearer to an already chosen one; then the nearest of the rest."""
    own = vectors[order]
    sq = (own * own).sum(1)
    between = sq[:, None] + sq[None, :] - 2 * own @ own.T
    kept, dropped, blocked = [], [], np.zeros(len(order), bool)
    for i in range(len(order)):
        if len(kept) == most:
            break
        if blocked[i]:
            dropped.append(i)
        else:
            kept.append(i)
            blocked |= between[i] < dist
    kept += dropped[: most - len(kept)]
    return order[kept].tolist()


def _cut(own: dict[int, float], x: np.ndarray, most: int) -> None:
    order = np.array(sorted(own, key=own.get))
    kept = set(_choose(order, np.array([own[j] for j in order.tolist()]), x, most))
    for j in order.tolist():
        if j not in kept:
            del own[j]


def _layer(vectors: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of ``nodes`` (positions in insertion order) within one layer: an array of nodes x most."""
    x = vectors[nodes].astype(np.float32)
    squares = (x * x).sum(1)
    links: list[dict[int, float]] = [{} for _ in nodes]
    flat = np.full((len(x), most), -1, np.int64)
    for a in range(0, len(x), BLOCK):
        b = min(a + BLOCK, len(x))
        new = x[a:b]
        if a <= 4 * BLOCK:  # few nodes: all earlier ones are candidates
            met = np.tile(np.arange(a), (b - a, 1))
            far = np.maximum(squares[a:b, None] + squares[None, :a] - 2 * new @ x[:a].T, 0)
        else:
            # searches begin at the nearest of the first nodes, which are spread over all
            start = np.argpartition(squares[None, :BLOCK] - 2 * new @ x[:BLOCK].T, 4, axis=1)[:, :4]
            met, far = search_layer(x[:a], squares[:a], flat[:a], new, start, CANDIDATES)
        within = np.maximum(squares[a:b, None] + squares[None, a:b] - 2 * new @ new.T, 0)
        changed = set(range(a, b))
        for i in range(max(a, 1), b):
            near, dist = np.concatenate([met[i - a], np.arange(a, i)]), np.concatenate([far[i - a], within[i - a, : i - a]])
            near, dist = near[near >= 0], dist[: len(near)][near >= 0] if (near < 0).any() else dist
            if len(near) > CANDIDATES:
                best = np.argpartition(dist, CANDIDATES)[:CANDIDATES]
                near, dist = near[best], dist[best]
            order = np.argsort(dist, kind="stable")
            near, dist = near[order], dist[order]
            own = dict(zip(near.tolist(), dist.tolist(), strict=True))
            for j in _choose(near, dist, x, most // 2):
                links[i][j] = links[j][i] = own[j]
                changed.add(j)
                if len(links[j]) > most + most // 2:
                    _cut(links[j], x, most)
        for i in changed:
            if len(links[i]) > most:
                _cut(links[i], x, most)
            flat[i] = -1
            flat[i, : len(links[i])] = list(links[i])
    return np.where(flat >= 0, nodes[np.maximum(flat, 0)], -1).astype(np.int32) if len(nodes) else flat.astype(np.int32)


class Graph:
    """A small-world graph over the rows of ``vectors``, which are in insertion order, with the ids of each."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], ids: list[list[int]] | None = None):
        self.vectors, self.layers, self.ids = vectors, layers, ids
        self.near = vectors.astype(np.float32)
        self.squares = (self.near * self.near).sum(1)
        self.local = []
        for nodes, links in layers:
            at = np.full(len(vectors) + 1, -1, np.int64)
            at[nodes] = np.arange(len(nodes))
            self.local.append((nodes, at[links]))  # -1 stays -1: the last place is none's

    @classmethod
    def build(cls, vectors: np.ndarray, ids: list[list[int]] | None = None, seed: int = 11) -> Graph:
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        layers = []
        for depth in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= depth)
            layers.append((nodes, _layer(vectors, nodes, 2 * LINKS if depth == 0 else LINKS)))
        return cls(vectors, layers, ids)

    def to_bytes(self) -> bytes:
        n, dim = self.vectors.shape
        parts = [HEAD.pack(n, dim, len(self.layers)), self.vectors.astype("<f8").tobytes()]
        for nodes, links in self.layers:
            parts += [struct.pack("<QQ", *links.shape), nodes.astype("<i4").tobytes(), links.astype("<i4").tobytes()]
        ids = self.ids if self.ids is not None else [[i] for i in range(n)]
        parts += [np.cumsum([0, *map(len, ids)]).astype("<i8").tobytes(), np.array([i for own in ids for i in own], "<i8").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        n, dim, count = HEAD.unpack_from(data)
        at = HEAD.size
        vectors = np.frombuffer(data, "<f8", n * dim, at).reshape(n, dim)
        at += 8 * n * dim
        layers = []
        for _ in range(count):
            rows, width = struct.unpack_from("<QQ", data, at)
            nodes = np.frombuffer(data, "<i4", rows, at + 16)
            links = np.frombuffer(data, "<i4", rows * width, at + 16 + 4 * rows).reshape(rows, width)
            layers.append((nodes, links))
            at += 16 + 4 * rows + 4 * rows * width
        ends = np.frombuffer(data, "<i8", n + 1, at)
        flat = np.frombuffer(data, "<i8", int(ends[-1]), at + 8 * (n + 1))
        return cls(vectors, layers, [flat[a:b].tolist() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])

    def search(self, queries: np.ndarray, breadth: int = BREADTH) -> tuple[np.ndarray, np.ndarray]:
        """For each query about the ``breadth`` nearest nodes, nearest first (-1: fewer), and their distances in double precision."""
        q = np.ascontiguousarray(queries, np.float32)
        found = np.zeros((len(q), 1), np.int64)
        found[:] = self.layers[-1][0][0]
        for depth in range(len(self.layers) - 1, -1, -1):
            nodes, links = self.local[depth]
            at = np.full(len(self.vectors), -1, np.int64)
            at[nodes] = np.arange(len(nodes))
            entry = np.where(found >= 0, at[np.maximum(found, 0)], -1)
            met, _ = search_layer(self.near[nodes], self.squares[nodes], links, q, entry, breadth if depth == 0 else DESCENT)
            found = np.where(met >= 0, nodes[np.maximum(met, 0)], -1)
        far = np.sqrt(((self.vectors[np.maximum(found, 0)] - queries[:, None, :]) ** 2).sum(2))
        far = np.where(found >= 0, far, np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(good)


def _write_file(folder: str, kind: str, data: bytes) -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    name = f"{kind}-{task.taskAttemptId()}"
    out = NewFile(folder, name, str(task.taskAttemptId()))
    out.write(data)
    out.close()
    return name


def _read_file(folder: str, name: str) -> bytes:
    with open_file(folder, name) as file:
        return file.read()


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _build(folder: str):
    """From (shard, v, ids) sorted by shard and hash: each shard's graph, written to a file of this attempt."""

    def made(shard: str, parts: list[np.ndarray], ids: list[list[int]], number: int) -> pa.RecordBatch:
        graph = Graph.build(np.concatenate(parts), ids)
        name = _write_file(folder, f"graph-{shard}-{number}", graph.to_bytes())
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([name])], ["shard", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, ids, number = None, [], [], 0
        for batch in batches:
            names = batch.column("shard").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if names[a] != shard:
                    if parts:
                        yield made(shard, parts, ids, number)
                        number += 1
                    shard, parts, ids = names[a], [], []
                part = batch.slice(a, b - a)
                parts.append(_matrix(part.column("v")))
                ids += part.column("ids").to_pylist()
        if parts:
            yield made(shard, parts, ids, number)

    return run


def build_index(vectors: DataFrame, top: int = TOP, shard: int | None = None) -> tuple[str, DataFrame]:
    """The folder of the shards' graphs, and (shard, file); a shard's name begins with the length of its vectors."""
    spark = vectors.sparkSession
    folder = shared_path(spark, "ann")
    # enough ids that a query's own can be passed over
    ranked = vectors.dropDuplicates(["vec_id", "v"]).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    nodes = materialize(ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = nodes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    if shard is None:
        most = F.greatest(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim"))))
        size = F.least(most, F.greatest(F.lit(SHARD), F.ceil(F.col("n") / parts)))
    else:
        size = F.lit(shard)
    dims = counts.select("dim", F.ceil(F.col("n") / size).alias("shards"))
    placed = nodes.withColumn("dim", F.size("v")).join(dims, "dim").withColumn("shard", F.concat_ws("-", "dim", F.pmod(F.xxhash64("v"), F.col("shards"))))
    # a hash order is a random insertion order
    rows = placed.select("shard", F.xxhash64("v", F.lit(5)).alias("o"), "v", "ids").repartition("shard").sortWithinPartitions("shard", "o").select("shard", "v", "ids")
    return folder, materialize(rows.mapInArrow(tidy(_build(folder)), "shard string, file string"))


def _write_queries(folder: str):
    """From (dim, vec_id, v) sorted by dim: blocks of queries, each a file of this attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for i in range(a, b, BLOCK):
                    part = batch.slice(i, min(BLOCK, b - i))
                    out = io.BytesIO()
                    np.savez(out, ids=part.column("vec_id").to_numpy(), vectors=_matrix(part.column("v")))
                    name = _write_file(folder, f"queries-{dims[a]}-{number}", out.getvalue())
                    number += 1
                    yield pa.RecordBatch.from_arrays([pa.array([int(dims[a])], pa.int32()), pa.array([name])], ["dim", "block"])

    return run


def _search(folder: str, blocks_folder: str, blocks: dict[int, list[str]], top: int):
    def answers(graph: Graph, ids: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        nodes, far = graph.search(queries)
        out: list[tuple[int, int, float]] = []
        for q, near, dist in zip(ids.tolist(), nodes.tolist(), far.tolist(), strict=True):
            limit, own = None, 0
            for n, d in zip(near, dist, strict=True):
                if n < 0 or (limit is not None and d > limit):
                    break
                found = [(q, i, d) for i in graph.ids[n] if i != q]
                out += found
                own += len(found)
                if limit is None and own >= top:
                    limit = d  # ties with the last one are kept; the merge breaks them
        columns = [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, part, parts in zip(*(batch.column(c).to_pylist() for c in ("shard", "file", "part", "parts")), strict=True):
                own = blocks.get(int(shard.split("-")[0]), [])[part::parts]
                if not own:
                    continue
                graph = Graph.from_bytes(_read_file(folder, file))
                for block in own:
                    held = np.load(io.BytesIO(_read_file(blocks_folder, block)))
                    yield answers(graph, held["ids"], held["vectors"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, shard: int | None = None, index: tuple[str, DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` (vec_id, v) the ``top`` nearest of ``vectors`` found, itself left out."""
    spark = vectors.sparkSession
    graphs, shards = build_index(vectors, top, shard) if index is None else index
    folder = shared_path(spark, "ann-queries")
    asked = queries.dropDuplicates(["vec_id", "v"]).select(F.size("v").alias("dim"), "vec_id", "v").sortWithinPartitions("dim")
    written = materialize(asked.mapInArrow(tidy(_write_queries(folder)), "dim int, block string"))
    # a name for each block, BLOCK queries or a partition's rest
    blocks: dict[int, list[str]] = {}
    for r in written.orderBy("dim", "block").collect():
        blocks.setdefault(r["dim"], []).append(r["block"])
    tasks, most = shards.count(), max((len(b) for b in blocks.values()), default=0)
    # where there are fewer shards than partitions, a shard's blocks are shared out over several tasks
    parts = max(1, min(most, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, tasks))))
    visits = shards.select("shard", "file", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(parts).alias("parts")).repartition(max(1, tasks * parts))
    found = visits.mapInArrow(tidy(_search(graphs, folder, blocks, top)), "query_id long, vec_id long, score double")
    nearer = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = nearer.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= top)
    return best.select("query_id", "rank", "vec_id", "score")
