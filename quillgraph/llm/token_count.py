"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece of text form a doubly linked list; a heap holds the adjacent pairs that the
vocabulary can merge, lowest rank first and leftmost among equals. Popping the best live pair merges it and
pushes its new neighbours. The count is the number of initial symbols minus the merges; no ids are made. A
character that the vocabulary lacks can take part in no merge and counts as its UTF-8 bytes (byte fallback).

Text is first cut where no vocabulary piece spans the two characters next to the cut (such as before a space
mark after a letter). No merge can cross such a place, so the pieces are independent and their counts are
remembered in a bounded cache.

Defined results: null text counts as empty and has no tokens; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import tidy


LIMIT = 4096
CACHE = 600_000
SPACE = "▁"


class Words(dict):
    """Counts of words without their space mark, made when first asked for and kept while there is room."""

    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count(SPACE + word)
        if len(self) < CACHE and len(word) <= 32:
            self[word] = n
        return n


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model does. The library only supplies the vocabulary and the normaliser's settings."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # best score first; equal scores share a rank, so that the leftmost pair goes first
        scores = sorted({model.get_score(i) for i in usual}, reverse=True)
        at = {s: r for r, s in enumerate(scores)}
        self.rank = {model.id_to_piece(i): at[model.get_score(i)] for i in usual}
        self.known = frozenset(p for p in self.rank if len(p) == 1)
        self.spans = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.prefix = model.encode("a", out_type=str)[0].startswith(SPACE)
        self.odd = [s for s in self.spans if s[1] == SPACE and s[0] != SPACE]
        self.words = Words(self)
        self.pieces: dict[str, int] = {}

    def merge(self, piece: str) -> int:
        """Tokens of one independent piece."""
        get, size = self.rank.get, len(piece)
        n = size if self.known.issuperset(piece) else sum(1 if c in self.known else len(c.encode("utf-8", "surrogatepass")) for c in piece)
        if size == 1:
            return n
        text = list(piece)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # an entry is rank and place in one integer; it is live while the pair at that place still has that rank
        heap = [r << 32 | i for i in range(size - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            left, j = text[i], after[i]
            if not left or j == size or get(both := left + text[j]) != entry >> 32:
                continue
            text[i], text[j] = both, ""
            n -= 1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (r := get(both + text[k])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := get(text[h] + both)) is not None:
                heappush(heap, r << 32 | h)
        return n

    def count(self, piece: str) -> int:
        """Tokens of a string in which spaces are marked: cut it, then merge each part."""
        spans, cache, start, n = self.spans, self.pieces, 0, 0
        for i in range(1, len(piece) + 1):
            if i == len(piece) or piece[i - 1 : i + 1] not in spans:
                part = piece[start:i]
                if (found := cache.get(part)) is None:
                    found = self.merge(part)
                    if len(cache) < CACHE and len(part) <= 32:
                        cache[part] = found
                n, start = n + found, i
        return n

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.runs(marked):
            return self.count(marked)
        return sum(map(self.words.__getitem__, marked.split(SPACE)[1:]))

    def runs(self, marked: str) -> bool:
        """Whether the text can't be cut at each space mark: it has runs of them, or doesn't begin with one."""
        return bool(self.odd) or SPACE + SPACE in marked or not marked.startswith(SPACE) or marked.endswith(SPACE)


@cache
def counter(path: str) -> PieceCounter:
    """The counter of a worker process: loaded once, its caches live on from task to task."""
    return PieceCounter(path)


def count_tokens(documents: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``documents``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = counter(model_path)
        for batch in batches:
            tokens = [tokens_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return docs.mapInArrow(tidy(count), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
