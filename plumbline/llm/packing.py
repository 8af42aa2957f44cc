"""Best-fit packing of tokenized documents into sequences of a fixed length.

1. Tokenize each document and cut it into pieces; a piece gets its rank among
   the pieces of its length in its own task. This table is written once.
2. The histogram of lengths (at most ``capacity`` rows) goes to the driver,
   where ``bin_packing.plan`` makes the plan: as many rows as there are kinds
   of bins, whatever the number of documents.
3. Counts by task and length become rank offsets by a prefix sum; each piece
   looks its place up by length and rank. No sort over all pieces is needed.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import bin_packing
from plumbline.llm import shingles as sh
from plumbline.llm.common import bound_batches, materialize, table

CAPACITY = 2048
END_ID = 0
#: Beyond so many known strings a worker forgets them and starts again.
KNOWN = 2_000_000

_tokenizers: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts, by way of their space-separated strings.

    The vocabulary's own rules lower-case, drop white space and never join
    across it, so the ids of a text are those of its strings in order, and A-Z
    may be lower-cased first. A full stop or comma after a-z at the end of a
    string is a token of its own. Only strings that a worker has not met go to
    the tokenizer; it knows the others by a 64-bit hash, in sorted arrays. Texts
    that may hold a special token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _store(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.uint32)])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _learn(self, keys: np.ndarray, strings: list[bytes]) -> None:
        """keys: sorted and new.

        A string of letters has one token with the mark of a word's end, its
        last. Such strings are encoded as one text and told apart by that mark;
        if the marks don't add up, and for all other strings, one by one.
        """
        texts = [s.decode() for s in strings]
        at, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        single = [i for i, t in enumerate(texts) if not t.isalpha()]
        for k in range(0, len(plain), 2_000):
            part = plain[k : k + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.nonzero(self.word_end[ids])[0] + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                single += part
                continue
            starts = np.concatenate([[0], ends[:-1]])
            at[part], size[part] = self._store(ids) + starts, ends - starts
        for k in range(0, len(single), 5_000):
            part = single[k : k + 5_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                at[i], size[i] = self._store(ids), len(ids)
        place = np.searchsorted(self.keys, keys)
        self.at, self.size, self.keys = np.insert(self.at, place, at), np.insert(self.size, place, size), np.insert(self.keys, place, keys)

    def _slice(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of at most a slice, the starts of its strings, and the number of ids before each string and at the end."""
        x = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(x) + 2, bool)
        inside[1:-1] = ~_SPACE[x]
        first = inside[1:-1] & ~inside[:-2]
        stop = np.zeros(len(x), bool)
        stop[1:] = _STOP[x[1:]] & _LETTER[x[:-1]]
        stop &= ~inside[2:]
        starts = np.nonzero(first | stop)[0]
        last = np.nonzero((inside[1:-1] & ~inside[2:]) | np.append(stop[1:], False))[0] + 1
        keys, one, which = np.unique(sh.hash_runs(x, starts, last), return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        if not known.all():
            self._learn(keys[~known], [data[starts[i] : last[i]] for i in one[~known]])
            place = np.searchsorted(self.keys, keys)
        at, size = self.at[place][which], self.size[place][which]
        before = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(at - before[:-1], size) + np.arange(before[-1])], starts, before

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        batch: list[bytes] = []
        room = sh.SLICE
        for text in texts:
            data = text.encode()
            if b"<|" in data:
                yield from self._joined(batch)
                batch, room = [], sh.SLICE
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            if len(data) >= room:
                yield from self._joined(batch)
                batch, room = [], sh.SLICE
            if len(data) >= sh.SLICE:
                yield self._long(data.lower())
                continue
            batch.append(data.lower())
            room -= len(data) + 1
        yield from self._joined(batch)

    def _joined(self, batch: list[bytes]) -> Iterator[np.ndarray]:
        if batch:
            ids, starts, before = self._slice(b" ".join(batch))
            edges = before[np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(b) + 1 for b in batch])]))]
            for i in range(len(batch)):
                yield ids[edges[i] : edges[i + 1]]

    def _long(self, data: bytes) -> np.ndarray:
        """A text beyond a slice, cut at white space; a single string beyond a slice goes to the tokenizer."""
        out, at = [], 0
        while at < len(data):
            end = len(data) if len(data) - at < sh.SLICE else max(data.rfind(c, at, at + sh.SLICE) for c in (b" ", b"\n"))
            if end <= at:
                ends = [i for c in (b" ", b"\n") if (i := data.find(c, at + 1)) > 0]
                end = min(ends, default=len(data))
                out.append(np.array(self.tokenizer.encode(data[at:end].decode(), add_special_tokens=False).ids, np.uint32))
            else:
                out.append(self._slice(data[at:end])[0])
            at = end
        return np.concatenate(out)


_SPACE, _STOP, _LETTER = np.zeros((3, 256), bool)
_SPACE[[9, 10, 13, 32]], _STOP[[44, 46]], _LETTER[97:123] = True, True, True


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, task, rank (in task and length). A null text is empty: one id."""
    bound_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _tokenizers.get(path) or _tokenizers.setdefault(path, WordIds(path))
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, place, start, length, crc, rank = [], [], [], [], [], []
            for i, ids in enumerate(ids_of.encode([t or "" for t in batch.column(1).to_pylist()])):
                data = ids.astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append(i), place.append(k), start.append(at // 4), length.append(n), crc.append(zlib.crc32(part)), rank.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(place, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(rows), pa.int32()), pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset.

    Every row of ``docs`` counts, equal rows and null ids too; null and empty
    texts are one end id. Sequences are numbered from 0 without gaps and their
    offsets are gapless. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, doc_id, text, tokenizer, capacity))
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = bin_packing.places(bin_packing.plan(counts, capacity))
    key = (plan[:, 0] << 44) + plan[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), side="right") - 1
        row = plan[at] if len(plan) else np.zeros((0, 5), np.int64)
        n = rank.to_numpy(np.int64) - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + n // np.maximum(row[:, 3], 1), "offset": row[:, 4] + n % np.maximum(row[:, 3], 1) * row[:, 0]})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = cut.join(offsets, ["task", "length"]).withColumn("at", placed("length", F.col("rank") + F.col("before")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
