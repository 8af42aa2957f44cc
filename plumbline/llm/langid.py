"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to ``ORDER`` with frozen
counts. A byte costs -log2 of its share in the longest context that has it;
each longer known context on the way adds its escape (method C: distinct
symbols over counts plus distinct symbols), and below order 0 all 256 bytes
are equal. The language with the shortest code for the whole text wins.

The trees are trained on a bounded sample of labelled documents
(``SAMPLE_DOCS`` a language on average, fewer where there are over 1000
languages; of documents no longer than ``SAMPLE_BYTES``, or the first bytes of
longer ones where a language has no others), drawn by a hash of the key; every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import bound_batches, table

ORDER = 3
SAMPLE_DOCS = 400
SAMPLE_BYTES = 64_000
MIN_DOCS = 5
#: Documents in the whole sample, in expectation, as long as that leaves MIN_DOCS a language.
ALL_SAMPLE_DOCS = 1000 * SAMPLE_DOCS
#: Bytes of the whole sample, in expectation: what the driver holds.
ALL_SAMPLE_BYTES = 256 << 20
#: Bytes that count for the score; a longer text is no surer.
SCORE_BYTES = 64
#: Bytes scored at a time; slots of the table of known grams.
SLICE, TABLE_BITS = 1 << 19, 20
PAD = b"\n" * ORDER


def grams(data: np.ndarray) -> np.ndarray:
    """The last ORDER + 1 bytes at each byte as one number, the newest lowest."""
    out = data[ORDER:].astype(np.uint32)
    for k in range(1, ORDER + 1):
        out |= data[ORDER - k : len(data) - k].astype(np.uint32) << np.uint32(8 * k)
    return out


class ContextTrees:
    """Frozen statistics of all languages; ``costs`` gives the bits of any gram in each."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        self.levels = [self._level(texts[x]) for x in self.langs]
        self._forget()

    @staticmethod
    def _level(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: sorted grams and their bits, sorted contexts and the bits of their escape."""
        full = [grams(np.frombuffer(PAD + t, np.uint8)) for t in texts]
        seen, n = np.unique(np.concatenate(full) if full else np.zeros(0, np.uint32), return_counts=True)
        out = []
        for k in range(ORDER + 1):
            mask = np.uint32((1 << (8 * (k + 1))) - 1)
            g, at = np.unique(seen & mask, return_inverse=True)
            count = np.bincount(at, n, len(g))
            c, of = np.unique(g >> np.uint32(8), return_inverse=True)
            total, distinct = np.bincount(of, count, len(c)), np.bincount(of, minlength=len(c))
            out.append((g, np.log2((total + distinct)[of] / count), c, np.log2((total + distinct) / distinct)))
        return out

    def costs(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((len(g), len(self.langs)), np.float32)
        for j, levels in enumerate(self.levels):
            bits, open_ = np.zeros(len(g)), np.arange(len(g))
            for k in range(ORDER, -1, -1):
                keys, code, contexts, escape = levels[k]
                here = g[open_] & np.uint32((1 << (8 * (k + 1))) - 1)
                hit, at = _find(keys, here)
                bits[open_[hit]] += code[at[hit]]
                open_, here = open_[~hit], here[~hit]
                hit, at = _find(contexts, here >> np.uint32(8))
                bits[open_[hit]] += escape[at[hit]]
            bits[open_] += 8
            out[:, j] = bits
        return out

    def lookup(self, g: np.ndarray) -> np.ndarray:
        """Row numbers of the grams in ``bits``; grams not met before are added.

        A table by hash answers for most; where two grams share a slot, or for
        new ones, the sorted list does.
        """
        at = self.table[_slot(g)].astype(np.int64) if len(self.known) else np.zeros(len(g), np.int64)
        open_ = np.nonzero(self.known[at] != g)[0] if len(self.known) else np.arange(len(g))
        if not len(open_):
            return at
        rest = g[open_]
        hit, place = _find(self.known, rest)
        if not hit.all():
            if len(self.known) > 2_000_000:
                self._forget()
                return self.lookup(g)
            new = np.unique(rest[~hit])
            keys = np.concatenate([self.known, new])
            order = np.argsort(keys, kind="stable")
            self.known, self.bits = keys[order], np.concatenate([self.bits, self.costs(new)])[order]
            self.table[_slot(self.known)] = np.arange(len(self.known), dtype=np.int32)
            return self.lookup(g)
        at[open_] = place
        return at

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint32)
        self.bits = np.zeros((0, len(self.langs)), np.float32)
        self.table = np.zeros(1 << TABLE_BITS, np.int32)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for first, last in _slices(texts, SLICE):
            part = texts[first:last]
            if len(part[0]) > SLICE:  # alone in its slice
                padded = PAD + part[0]
                for k in range(0, len(part[0]), SLICE):
                    at = self.lookup(grams(np.frombuffer(padded[k : k + ORDER + SLICE], np.uint8)))
                    out[first] += self.bits[at].sum(axis=0, dtype=np.float64)
                continue
            at = self.lookup(grams(np.frombuffer(PAD + PAD.join(part) + PAD, np.uint8)))
            ends = np.cumsum([len(t) + ORDER for t in part])
            starts = ends - [len(t) + ORDER for t in part]
            edges = np.column_stack([starts, ends - ORDER]).ravel()
            # reduceat gives a text at the even places and the padding after it at the odd ones.
            bits = np.concatenate([self.bits[at], np.zeros((1, len(self.langs)), np.float32)])
            sums = np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[::2]
            out[first:last] = np.where((np.diff(edges)[::2] > 0)[:, None], sums, 0)
        return out


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint32(2654435769)) >> np.uint32(32 - TABLE_BITS)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def _slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the key as text is a multiple of 5; a null key is not held out and never trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> ContextTrees:
    """Context trees of the languages with at least MIN_DOCS labelled documents outside the held-out fold.

    The sample holds about ALL_SAMPLE_BYTES at most, in equal parts.

    The share of a language doesn't matter. A language with MIN_DOCS documents
    up to SAMPLE_BYTES is learned from these, another from the first
    SAMPLE_BYTES bytes of all of its documents.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.octet_length(text) <= SAMPLE_BYTES).alias("fits"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("n_fit"), F.sum(F.when(F.col("fits"), F.octet_length("text"))).alias("bytes_fit")).where(F.col("n") >= MIN_DOCS).orderBy("lang").collect()
    each = max(MIN_DOCS, min(SAMPLE_DOCS, ALL_SAMPLE_DOCS // max(1, len(sizes))))
    rates = []
    for r in sizes:
        cut = r["n_fit"] < MIN_DOCS
        n, held = (r["n"], r["n"] * SAMPLE_BYTES) if cut else (r["n_fit"], r["bytes_fit"])
        share = min(1.0, each / n, max(MIN_DOCS / n, ALL_SAMPLE_BYTES / len(sizes) / max(1, held)))
        rates.append((r["lang"], cut, share * 1_000_000))
    limits = docs.sparkSession.createDataFrame(rates, "_lang string, cut boolean, rate double")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000))
    drawn = labelled.join(F.broadcast(limits) if len(rates) <= 100_000 else limits, F.col("lang") == F.col("_lang")).where((F.col("fits") | F.col("cut")) & (draw < F.col("rate")))
    texts: dict[str, list[bytes]] = {r["lang"]: [] for r in sizes}
    for r in drawn.select("lang", F.substring("text", 1, SAMPLE_BYTES)).toLocalIterator():
        texts[r[0]].append(r[1].encode()[:SAMPLE_BYTES])
    return ContextTrees({k: v for k, v in texts.items() if v})


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(texts: list[str | None], trees: ContextTrees) -> tuple[list[str], np.ndarray]:
    known = [bool(t) and bool(trees.langs) and has_letter(t) for t in texts]
    data = [t.encode() for t, k in zip(texts, known, strict=True) if k]
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if data:
        bits = trees.code_lengths(data)
        n = np.array([len(t) for t in data])
        share = np.exp2((bits.min(axis=1)[:, None] - bits) * (np.minimum(n, SCORE_BYTES) / n)[:, None])
        at = np.nonzero(known)[0]
        scores[at] = 1 / share.sum(axis=1)
        for i, b in zip(at, bits.argmin(axis=1), strict=True):
            names[i] = trees.langs[b]
    return names, scores


def identify(docs: DataFrame, trees: ContextTrees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row.

    A text that is null or has no letter is ``und`` with score 0, as is any
    text if no language was learned. Ties go to the first language in order.
    The score is the winner's share of 2 to the minus bits, at the mean bits of
    a byte over at most SCORE_BYTES bytes. Repeated rows stay.
    """
    bound_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(1).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, trees: ContextTrees, text: str = "text", rejected: tuple[str, ...] = ("und",)) -> DataFrame:
    """The rows whose predicted language isn't rejected, with all their columns; no row is shuffled.

    If no language was learned, only texts that are null or have no letter go.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        if not trees.langs:
            return pd.Series([bool(t) and has_letter(t) for t in texts], dtype=bool)
        return pd.Series([x not in rejected for x in predict(texts.to_list(), trees)[0]], dtype=bool)

    return docs.where(kept(F.col(text)))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
