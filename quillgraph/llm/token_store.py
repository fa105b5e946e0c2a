"""Token-id output: raw id payloads in shards, with a minimal perfect hash index for keyed access.

A shard file holds, in this order: the ids (uint16, or uint32 for larger vocabularies), written as they are
made; the hash levels (bit arrays); for each slot of the hash a fingerprint, the number of the key's first
document in the shard and how many it has (uint32 each); the document keys (int64); the offsets of the payload
in ids (uint64, one more than documents); a fixed trailer; little-endian throughout. Looking up a key takes one
probe for each level (2 to 4 as a rule), one fingerprint comparison and one read of the payload, whatever the
shard's size. A key that is absent is refused by its fingerprint (and, as keys are stored, by the key itself).

The hash is built level by level: keys that are alone at their bit of a level's array are settled there,
colliding keys go to the next level; a key's slot is the number of set bits before its own.

Documents are range-partitioned by doc_id and sorted, so that shard number and position follow doc_id. Each
writer makes a file of its own attempt and reports it; only reported files are read, so a lost executor's
files are simply ignored.

Defined results: null text is empty and yields the end id alone; rows with null doc_id come first, without an
entry in the hash (the trailer counts them); repeated keys are stored one after another (ties by a hash of the
text) and a key's entry leads to the first of them and tells how many follow; if they are many, over
neighbouring shards; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, shared_path, tidy
from quillgraph.llm.storage import NewFile, open_file

MAGIC = b"QGTOKEN2"
TRAILER = struct.Struct("<8sIIQQQQQ")  # magic, bytes of an id, levels, documents, those without a key, distinct keys, ids, bytes of the index
END_ID = 2
NULL_KEY = -(1 << 63)
GAMMA = 2.0
#: Bytes of the source (its files) that one shard should hold.
SHARD_BYTES = 16_000_000
#: Words whose ids a worker remembers, eight ids each on the average at most.
CACHE = 200_000
#: Bytes of texts that are encoded together, and words of them whose ids are put in a row at once.
BATCH = 2 << 20
ROW = 1 << 15
#: White space, and what some libraries take for it.
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct int64 keys, with a fingerprint for each slot."""

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray):
        self.levels, self.fingerprints = levels, fingerprints
        self.before = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = (_hash(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        made = cls(levels, np.zeros(len(keys), np.uint32))
        made.fingerprints[made.slots(keys)] = cls.fingerprint(keys)
        return made

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (_hash(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            at = (_hash(keys[left], i) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            out[left[hit]] = self.before[i] + self.ranks[i][at[hit]]
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 for keys whose fingerprint is not the stored one."""
        slots = self.slots(keys)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == self.fingerprint(keys[known])
        return np.where(known, slots, -1)


def write_index(out, keys: np.ndarray, n_null: int, lengths: np.ndarray, width: int) -> None:
    """End a shard whose payload ``out`` already has, from its documents in key order (those without a key first)."""
    distinct, first, copies = np.unique(keys[n_null:], return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    number, count = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
    number[slot], count[slot] = first + n_null, copies
    parts = [struct.pack("<Q", len(x)) + np.packbits(x).tobytes() for x in index.levels]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    parts += [index.fingerprints.astype("<u4").tobytes(), number.astype("<u4").tobytes(), count.astype("<u4").tobytes(), keys.astype("<i8").tobytes(), offsets.tobytes()]
    size = 0
    for part in parts:
        out.write(part)
        size += len(part)
    out.write(TRAILER.pack(MAGIC, width, len(index.levels), len(keys), n_null, len(distinct), int(offsets[-1]), size))


class Shard:
    """Keyed access to a shard file: the index is held, ids are read on demand."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - TRAILER.size)
        magic, self.width, n_levels, self.n, self.n_null, distinct, self.n_ids, size = TRAILER.unpack(file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(end - TRAILER.size - size)
        head, at, levels = file.read(size), 0, []
        for _ in range(n_levels):
            (bits,) = struct.unpack_from("<Q", head, at)
            n = (bits + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(head, np.uint8, n, at + 8))[:bits].astype(bool))
            at += 8 + n
        take = lambda kind, count, at: np.frombuffer(head, kind, count, at)
        self.index = PerfectHash(levels, take("<u4", distinct, at))
        self.number, self.count = take("<u4", distinct, at + 4 * distinct), take("<u4", distinct, at + 8 * distinct)
        self.keys = take("<i8", self.n, at + 12 * distinct)
        self.offsets = take("<u8", self.n + 1, at + 12 * distinct + 8 * self.n).astype(np.int64)
        self.kind = {2: "<u2", 4: "<u4"}[self.width]

    def documents(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the number of its first document in the shard (-1: absent), and how many it has."""
        slots = self.index.find(keys)
        if not len(self.number):
            return np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        number = np.where(slots >= 0, self.number[slots].astype(np.int64), -1)
        known = number >= 0
        known[known] = self.keys[number[known]] == keys[known]
        return np.where(known, number, -1), np.where(known, self.count[slots].astype(np.int64), 0)

    def ids(self, document: int) -> np.ndarray:
        a, b = self.offsets[document], self.offsets[document + 1]
        self.file.seek(int(a) * self.width)
        return np.frombuffer(self.file.read(int(b - a) * self.width), self.kind)

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each document under the key (None: of those without one); none if it is absent."""
        if key is None:
            return [self.ids(d) for d in range(self.n_null)]
        (first,), (count,) = self.documents(np.array([key], np.int64))
        return [self.ids(d) for d in range(first, first + count)]


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begin`` on, as many as ``size`` tells, in a row."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word of a batch encoded once.

    The pre-tokenizer never crosses a single space between two characters that aren't white space, so text is
    cut there. The words of a batch are told apart by Arrow's dictionary encoding; those that earlier batches
    did not have are encoded together as one text, and told apart by the bytes of their tokens; documents are
    then put together from the words' ids by array operations. Texts in which white space touches a space, and
    texts with the string of a special token, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts of which a space may not be a cut, and empty ones.
        self.whole = "|".join([f" {BLANK}", f"{BLANK} ", " $", "^$", *(re.escape(s) for s in special)])
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # in a byte-level vocabulary each character of a token stands for one byte
        self.length = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.words, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, self.kind), np.zeros(0, np.int64)
        #: Which of the words a later batch had again.
        self.again = np.zeros(0, bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts in a row, and how many each has."""
        done = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.kind), *done]), np.array([len(x) for x in done], np.int64)

    def encode_words(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same of words with a space before each, which neither begin nor end with white space."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        every, counts = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), 5000):
            part = texts.slice(i, 5000).to_pylist()
            (own,) = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(own.ids, self.kind)
            done = np.cumsum(self.length[ids])
            ends = np.cumsum(size[i : i + 5000])
            cuts = np.searchsorted(done, ends) + 1
            if not len(ids) or cuts[-1] > len(ids) or not np.array_equal(done[cuts - 1], ends):
                return self.encode([" " + w for w in texts.to_pylist()])  # not a byte-level vocabulary
            every.append(ids)
            counts.append(np.diff(cuts, prepend=0))
        return np.concatenate(every), np.concatenate(counts)

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words (with a space before) the place of each in the second array's counts, of the ids in the first; remembers them."""
        at = pc.index_in(words, value_set=self.words)
        missing = words.filter(at.is_null())
        ids, counts = self.encode_words(missing)
        old = len(self.words)
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = old + np.arange(len(missing))
        ids, ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, (self.ends[-1] if old else 0) + np.cumsum(counts)])
        again = np.concatenate([self.again, np.zeros(len(missing), bool)])
        again[place[place < old]] = True
        every = pa.concat_arrays([self.words, missing])
        if len(ends) <= CACHE and len(ids) <= 8 * CACHE:
            self.words, self.ids, self.ends, self.again = every, ids, ends, again
        else:  # begin anew with the words at hand and, if half of the cache holds them, those that came again
            held = np.zeros(len(ends), bool)
            held[place] = True
            size = np.diff(ends, prepend=0)
            more = held | again
            if int(more.sum()) <= CACHE // 2 and int(size[more].sum()) <= 4 * CACHE:
                held = more
            own = size[held]
            self.words, self.ids, self.ends = every.filter(pa.array(held)), ids[_spans(ends[held] - own, own)], np.cumsum(own)
            self.again = np.zeros(len(own), bool)
        return ids, ends, place

    def __call__(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` after each, and how many each has."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        starts = parts.offsets.to_numpy()
        pieces = parts.flatten()
        is_first = np.zeros(len(pieces), bool)
        is_first[starts[:-1] - starts[0]] = True
        # pieces of other kinds are put behind the words: first words, whole texts, the end id
        first_ids, first_counts = self.encode(pieces.filter(pa.array(is_first)).to_pylist())
        coded = pieces.filter(pa.array(~is_first)).dictionary_encode()
        del parts, pieces
        ids, ends, place = self.known(coded.dictionary)
        whole_ids, whole_counts = self.encode(texts.filter(pa.array(whole)).to_pylist())
        n_words, n_first, n_whole = len(ends), len(first_counts), len(whole_counts)
        ids = np.concatenate([ids, first_ids, whole_ids, np.array([end_id], self.kind)])
        counts = np.concatenate([np.diff(ends, prepend=0), first_counts, whole_counts, [1]])
        begin = np.cumsum(counts) - counts
        # the pieces of every text in order: its first word or the whole of it, its other words, the end
        size = np.ones(len(texts), np.int64)
        size[~whole] = np.diff(starts)
        last = np.cumsum(size + 1) - 1
        order = np.empty(int(last[-1]) + 1 if len(last) else 0, np.int32)
        of_word = np.ones(len(order), bool)
        of_word[last] = of_word[last - size] = False
        order[of_word] = place[coded.indices.to_numpy()]
        order[(last - size)[~whole]] = n_words + np.arange(n_first)
        order[(last - size)[whole]] = n_words + n_first + np.arange(n_whole)
        order[last] = n_words + n_first + n_whole
        rows = [ids[_spans(begin[o], counts[o])] for o in (order[i : i + ROW] for i in range(0, len(order), ROW))]
        return np.concatenate([ids[:0], *rows]), np.diff(np.cumsum(counts[order])[last], prepend=0)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes: small ones are joined, large ones cut."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            if held and size + part.nbytes > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _shards(documents: DataFrame) -> int:
    """Shards of about ``SHARD_BYTES`` of what the table takes as the optimizer knows it from its files; counted where that is no size to believe."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not 0 <= size < 1 << 52:
        size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def write_tokens(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID, folder: str | None = None, shards: int | None = None) -> tuple[str, DataFrame]:
    """Write the token shards; gives their folder and the manifest (shard, file, n_docs, n_ids, start), start being the ids before the shard.

    Rows of one key are told apart by their text's hash and their place in the input, so that a key with many
    rows is dealt over shards like any other.
    """
    spark = documents.sparkSession
    folder = folder or shared_path(spark, "tokens")
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("of"), F.monotonically_increasing_id().alias("row"))
    shards = shards or _shards(documents)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encode = encoder(tokenizer_path)
        keys, lengths, out, n_null = [], [], None, 0
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        for batch in _gathered(batches):
            out = out or NewFile(folder, name, str(task.taskAttemptId()))
            ids, counts = encode(batch.column("text"), end_id)
            out.write(ids.tobytes())
            lengths.append(counts)
            n_null += batch.column("doc_id").null_count
            keys.append(pc.fill_null(batch.column("doc_id"), NULL_KEY).to_numpy())
        names = ["shard", "file", "n_docs", "n_ids"]
        if out is None:
            return
        n_ids = int(sum(x.sum() for x in lengths))
        keys = np.concatenate(keys)
        write_index(out, keys, n_null, np.concatenate(lengths), encode.kind.itemsize)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), name, len(keys), n_ids)], names)

    order = [F.col("doc_id").asc_nulls_first(), F.col("of").asc_nulls_first(), F.col("row")]
    ranged = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    written = materialize(ranged.mapInArrow(tidy(write), "shard long, file string, n_docs long, n_ids long"))
    # a row for each shard: their number is the input's size over SHARD_BYTES
    rows, start, manifest = sorted(tuple(r) for r in written.collect()), 0, []
    for shard, file, n_docs, n_ids in rows:
        manifest.append((shard, file, n_docs, n_ids, start))
        start += n_ids
    return folder, spark.createDataFrame(manifest, "shard long, file string, n_docs long, n_ids long, start long")


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document: each key of a shard is looked up by the hash, and its rows are what the slot leads to."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(folder, row["file"]) as file:
                    shard = Shard(file)
                    keys = np.unique(shard.keys[shard.n_null :])
                    first, count = shard.documents(keys)
                    if (first < 0).any() or int(count.sum()) != shard.n - shard.n_null:
                        raise ValueError(f"{row['file']}: the index misses documents")
                    # the documents that the slots lead to, in the order of the keys
                    number = np.concatenate([np.arange(shard.n_null), _spans(first, count)])
                    doc = np.concatenate([np.zeros(shard.n_null, np.int64), np.repeat(keys, count)])
                    for i in range(0, len(number), 5000):
                        own = number[i : i + 5000]
                        crc = [zlib.crc32(shard.ids(d).astype("<u4").tobytes()) for d in own.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc[i : i + 5000], mask=np.arange(i, i + len(own)) < shard.n_null),
                                pa.array(shard.offsets[own] + row["start"]),
                                pa.array(shard.offsets[own + 1] - shard.offsets[own]),
                                pa.array(crc, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    n = max(1, manifest.count())
    one_each = manifest.repartition(n)
    return one_each.mapInArrow(tidy(back), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, manifest: DataFrame, keys: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """The ids stored under each of a few keys, read by the index of the shards; absent keys have none."""
    out: dict[int | None, list[np.ndarray]] = {k: [] for k in keys}
    for row in manifest.orderBy("shard").collect():
        with open_file(folder, row["file"]) as file:
            shard = Shard(file)
            for k in keys:
                out[k] += shard.get(k)
    return out


def tokenize(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write ``documents`` as token shards, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    return read_tokens(*write_tokens(documents, tokenizer_path, end_id))
