"""Quality classifier: a byte-level convolutional network in numpy.

A document is its UTF-8 bytes. Learned filters of eight bytes run over the whole of it: bytes are embedded by a learned
table, and each filter is applied at every fourth byte. Activations are averaged within overlapping chunks (``CHUNK``
bytes, half of it overlapping); learned detectors look at each chunk's averages; each detector is max-pooled over the chunks
that cover the document, and a dense layer combines the maxima into one probability. Nothing else is an input.

All layers are fitted together on the driver, from scratch, by Adam with a fixed seed, on whole texts of a sample of
labelled documents whose size is bounded: at most ``PER_LABEL`` for each label, chosen by a hash of doc_id among texts of up to
``TEXT_BYTES`` bytes. The same sample gives the same model (weights are averages over the last third of the steps). Labels
are learned in equal weight; the probability is then brought to their shares in the table. Scoring reads every document
whole, in bounded pieces.

Defined results: null text is empty; an empty text is one empty chunk; without labelled rows of both kinds
every document scores the share of label 1 (1.0 without any labels); labels that are null or contradict each other for a
document count as given, each; repeated rows each get a row; rows with null doc_id are scored and not held out; an
empty table gives no rows. Only text is an input of the score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import labelled_sample, tidy

EMBED, WIDTH, STRIDE, FILTERS, DETECTORS = 4, 8, 4, 24, 32
CHUNK = 512
HALF = CHUNK // 2
STEPS = HALF // STRIDE  # filter places in half a chunk
#: Bytes that a half chunk is averaged over at least, so that a few words can't make an extreme average.
LEAST = 128
#: Bounds of the sample that the network is fitted on.
PER_LABEL = 2000
TEXT_BYTES = 1 << 16
#: Steps of the fit, and texts of each label in one.
FIT_STEPS, FIT_BATCH = 600, 12
THRESHOLD = 0.7
#: Bytes scored together, a multiple of half a chunk.
PIECE = 1 << 20
LAYERS = ("embed", "filters", "bias", "detectors", "shift", "dense", "offset")


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    detectors: np.ndarray  # FILTERS x DETECTORS
    shift: np.ndarray
    dense: np.ndarray
    offset: np.ndarray  # of one number
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FILTERS, np.float32))
    constant: float | None = None

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        made = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(
            made(256, EMBED, scale=0.5), made(WIDTH * EMBED, FILTERS, scale=1 / math.sqrt(WIDTH * EMBED)), np.zeros(FILTERS, np.float32),
            made(FILTERS, DETECTORS, scale=1 / math.sqrt(FILTERS)), np.full(DETECTORS, 0.1, np.float32), made(DETECTORS, scale=0.3), np.zeros(1, np.float32),
        )

    def convolve(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """Padded bytes, their embedding, where filters are active, bytes averaged over, and the averages by half chunk (the last may be shorter)."""
        n = max(1, len(data))
        count = -(-n // HALF)
        padded = np.zeros(count * HALF + WIDTH, np.uint8)
        padded[: len(data)] = data
        x = self.embed[padded].reshape(-1, STRIDE * EMBED)
        places = count * STEPS
        act = x[:places] @ self.filters[: STRIDE * EMBED]
        act += x[1 : places + 1] @ self.filters[STRIDE * EMBED :]
        act += self.bias
        live = act > 0
        np.maximum(act, 0, out=act)
        size = np.clip(n - np.arange(count) * HALF, LEAST, HALF) // STRIDE
        return padded, x, live, size, act.reshape(count, STEPS, FILTERS).sum(1) / size[:, None].astype(np.float32)

    def chunks(self, halves: np.ndarray) -> np.ndarray:
        return (halves[:-1] + halves[1:]) / 2 if len(halves) > 1 else halves

    def detect(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' scaled averages, and each detector's value for each chunk."""
        u = (self.chunks(halves) - self.mean) / self.scale
        return u, u @ self.detectors + self.shift

    def halves(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([self.convolve(data[i : i + PIECE])[4] for i in range(0, max(1, len(data)), PIECE)])

    def pool(self, data: np.ndarray) -> np.ndarray:
        """Each detector's maximum over the chunks that cover the document."""
        return np.maximum(self.detect(self.halves(data))[1].max(0), 0)

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        return _sigmoid(float(self.pool(data) @ self.dense + self.offset[0]))

    def learn(self, data: np.ndarray, label: float, weight: float, out: dict[str, np.ndarray]) -> None:
        """Adds the gradients of one text's loss to ``out``; only the chunks that are a detector's maximum pass any on."""
        padded, x, live, size, halves = self.convolve(data)
        u, found = self.detect(halves)
        top = found.argmax(0)
        pooled = np.maximum(found.max(0), 0)
        d = np.float32(weight * (_sigmoid(float(pooled @ self.dense + self.offset[0])) - label))
        out["offset"] += d
        out["dense"] += d * pooled
        dpool = d * self.dense * (pooled > 0)
        out["shift"] += dpool
        out["detectors"] += (u[top] * dpool[:, None]).T
        dchunk = self.detectors.T * dpool[:, None] / self.scale
        dhalf = np.zeros_like(halves)
        if len(halves) > 1:
            np.add.at(dhalf, top, dchunk / 2)
            np.add.at(dhalf, top + 1, dchunk / 2)
        else:
            dhalf[0] = dchunk.sum(0)
        for h in np.flatnonzero(dhalf.any(1)):
            at = slice(h * STEPS, (h + 1) * STEPS)
            dact = dhalf[h] / size[h] * live[at]
            xs = x[h * STEPS : (h + 1) * STEPS + 1]
            out["filters"][: STRIDE * EMBED] += xs[:-1].T @ dact
            out["filters"][STRIDE * EMBED :] += xs[1:].T @ dact
            out["bias"] += dact.sum(0)
            dx = np.zeros_like(xs)
            dx[:-1] += dact @ self.filters[: STRIDE * EMBED].T
            dx[1:] += dact @ self.filters[STRIDE * EMBED :].T
            flat = dx.reshape(-1, EMBED)
            own = padded[h * HALF : h * HALF + len(flat)]
            for e in range(EMBED):
                out["embed"][:, e] += np.bincount(own, flat[:, e], minlength=256)


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def fit(texts: list[str | None], labels: list[int], steps: int = FIT_STEPS, seed: int = 7, share: float | None = None) -> Network:
    """Fit the network from scratch on whole texts; ``share`` of label 1 in the table (by default in ``labels``) sets the level of its probabilities."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        net.constant = float(y.mean()) if len(y) else 1.0
        return net
    docs = [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    by = [np.flatnonzero(y == v) for v in (0, 1)]
    seen = np.concatenate([net.chunks(net.convolve(docs[i])[4]) for own in by for i in own[:200]])
    net.mean, net.scale = seen.mean(0), seen.std(0) + np.float32(1e-2)
    moments = {k: [0.0, 0.0] for k in LAYERS}
    late = {k: 0.0 for k in LAYERS}
    for r in range(steps):
        pick = np.concatenate([rng.choice(own, FIT_BATCH) for own in by])  # the rarer label is drawn more often
        grads = {k: np.zeros_like(getattr(net, k)) for k in LAYERS}
        for i in pick:
            net.learn(docs[i], y[i], 1 / len(pick), grads)
        rate = 0.02 * (1 - r / steps) + 1e-4
        for name, g in grads.items():
            m = moments[name]
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * np.square(g)
            delta = rate * (m[0] / (1 - 0.9 ** (r + 1))) / (np.sqrt(m[1] / (1 - 0.99 ** (r + 1))) + 1e-7)
            setattr(net, name, (getattr(net, name) - delta).astype(np.float32))
            if r >= steps * 2 // 3:
                late[name] = late[name] + getattr(net, name)
    for name, total in late.items():
        setattr(net, name, (total / (steps - steps * 2 // 3)).astype(np.float32))
    share = min(max(y.mean() if share is None else share, 0.01), 0.99)
    net.offset = net.offset + np.float32(math.log(share / (1 - share)))
    return net


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of doc_id as text, modulo 4; remainder 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def train(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Network:
    """Fit on at most ``per_label`` documents of each label outside the held-out fold."""
    own = labels.where(fold(F.col("doc_id")) != 2)
    counts = own.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
    short = documents.where(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) <= TEXT_BYTES)
    # ids are bounded; of documents that share an id one is taken
    rows = labelled_sample(short, own, "quality", per_label).groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id", "label").collect()
    return fit([r["text"] for r in rows], [r["label"] for r in rows], share=counts[0] / max(1, counts[0] + counts[1]))


def score(documents: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``documents``."""
    held = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([held.value.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that the classifier does not reject, all columns kept."""
    held = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.array([held.value.score(t) >= threshold for t in batch.column("text").to_pylist()], bool)
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(tidy(run), documents.schema)


def held_out_accuracy(labelled: list[tuple[int, float, int]]) -> float:
    """Share of (doc_id, score, label) in the held-out fold whose score falls on the label's side of the threshold."""
    own = [(s >= THRESHOLD) == (q == 1) for d, s, q in labelled if zlib.crc32(str(d).encode()) % 4 == 2]
    return sum(own) / len(own) if own else float("nan")
