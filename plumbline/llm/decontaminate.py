"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping patterns, long ones and, for passages
of an item, short ones at a small stride. A text region within k
edits of a pattern of m characters shares at least m + 1 - q(k + 1) of its
q-grams with it, on diagonals that differ by k at most. So the shared q-grams
of a text and all patterns are counted in overlapping bands of diagonals; a
band that reaches the bound is a region to verify, by banded alignment.

The patterns' q-grams go to the tasks as sorted arrays; the benchmark is cut
into blocks of a bounded size for that, each compared with all documents. No
document is shuffled. Items too short for patterns are searched exactly, as
whole words.

Characters are compared after lower-casing, with white space as one kind of
character; positions are code points of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import bound_batches, table

Q = 12
#: Pattern length, step between patterns of an item, and edits allowed for a full pattern.
PATTERN, STEP, EDIT_RATE = 100, 50, 0.06
#: The same of the short patterns, which find passages of an item.
SHORT_PATTERN, SHORT_STEP = 50, 10
#: Items shorter than this (after trimming) have no patterns and are searched exactly, between word boundaries.
LEAST = 24
#: Characters of the benchmark in a block; of the text in a slice.
BLOCK_CHARS = 1_500_000
SLICE = 1 << 17
TABLE_BITS = 20


def _lower_table() -> np.ndarray:
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        low = c.lower() if not 0xD800 <= i < 0xE000 else c
        out[i] = 32 if c.isspace() else ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    out[0] = 32  # 0 separates texts
    return out


def _word_table() -> np.ndarray:
    return np.array([not 0xD800 <= i < 0xE000 and chr(i).isalnum() for i in range(1 << 16)])


_tables: dict[str, np.ndarray] = {}


def normal(text: str) -> np.ndarray:
    """One number for each code point: lower-cased, all white space as one."""
    if "lower" not in _tables:
        _tables["lower"] = _lower_table()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code) or code.max() <= 0xFFFF:
        return _tables["lower"][code]
    out = np.where(code <= 0xFFFF, _tables["lower"][np.minimum(code, 0xFFFF)], code)
    for c in np.unique(code[code > 0xFFFF]).tolist():  # few in any text
        if len(low := chr(c).lower()) == 1 and ord(low) != c:
            out[code == c] = ord(low)
    return out


def word_characters(x: np.ndarray) -> np.ndarray:
    if "word" not in _tables:
        _tables["word"] = _word_table()
    if not len(x) or x.max() <= 0xFFFF:
        return _tables["word"][x]
    out = _tables["word"][np.minimum(x, 0xFFFF)]
    for c in np.unique(x[x > 0xFFFF]).tolist():
        out[x == c] = chr(c).isalnum()
    return out


def qgrams(x: np.ndarray) -> np.ndarray:
    """A hash of the Q = 12 characters from each place on, by way of 8-bit classes."""
    c = (x ^ (x >> np.uint32(8)) ^ (x >> np.uint32(16))).astype(np.uint8)
    two = c[:-1].astype(np.uint32) | (c[1:].astype(np.uint32) << np.uint32(8))
    four = two[:-2] | (two[2:] << np.uint32(16))
    n = len(x) - Q + 1
    eight = four[:n].astype(np.uint64) | (four[4 : n + 4].astype(np.uint64) << np.uint64(32))
    return eight * np.uint64(0x9E3779B97F4A7C15) + four[8 : n + 8].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Patterns:
    item: np.ndarray  # number of the item of each pattern
    start: np.ndarray  # its place in the item
    chars: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray  # q-grams that a region must share
    keys: np.ndarray  # sorted distinct q-grams
    first: np.ndarray  # their first posting, and the end
    owner: np.ndarray  # postings: pattern and place in it
    place: np.ndarray
    seen: np.ndarray  # one flag for each hash of TABLE_BITS
    short: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # for each length below LEAST: sorted hashes, items, their characters

    @classmethod
    def of(cls, texts: list[str]) -> Patterns:
        item, start, chars, edits = [], [], [], []
        short: dict[int, list] = {}
        for k, text in enumerate(texts):
            x = normal(text.strip())
            if len(x) < LEAST:
                if word_characters(x).any():
                    short.setdefault(len(x), []).append((k, x))
                continue
            for s, e in _places(len(x)):
                part = x[s:e]
                item.append(k), start.append(s), chars.append(part)
                edits.append(min(int(EDIT_RATE * len(part)), (len(part) - Q) // Q))
        edits_ = np.array(edits, np.int64)
        sizes = np.array([len(c) for c in chars], np.int64)
        grams = [qgrams(c) for c in chars]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(chars)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        seen = np.zeros(1 << TABLE_BITS, bool)
        seen[_short(keys)] = True
        return cls(np.array(item, np.int64), np.array(start, np.int64), chars, edits_, sizes + 1 - Q * (edits_ + 1), keys, np.append(first, len(order)), owner[order], place[order], seen, [_by_hash(short[n]) for n in sorted(short)])


def _places(n: int) -> list[tuple[int, int]]:
    """Start and end of the patterns of an item of n characters."""
    out = set()
    for size, step in ((PATTERN, STEP), (SHORT_PATTERN, SHORT_STEP)):
        last = max(0, n - size)
        out |= {(s, min(n, s + size)) for s in (*range(0, last, step), last)}
    return sorted(out)


def _by_hash(items: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of one length in the order of their hashes: hashes, numbers, characters."""
    chars = np.stack([x for _, x in items])
    hashes = _hashes(chars.ravel(), chars.shape[1])[:: chars.shape[1]]
    order = np.argsort(hashes, kind="stable")
    return hashes[order], np.array([k for k, _ in items], np.int64)[order], chars[order]


def _hashes(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters from each place on."""
    out = np.zeros(len(x) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ x[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def short_items(x: np.ndarray, p: Patterns, first: bool, last: bool) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of each whole-word occurrence in x of an item below LEAST characters.

    ``first`` and ``last``: x begins and ends its text; else what touches that
    end is left to the neighbouring slice, which overlaps.
    """
    word = word_characters(x) if p.short else None
    for hashes, items, chars in p.short:
        n = chars.shape[1]
        if len(x) < n:
            continue
        g = _hashes(x, n)
        left, right = np.searchsorted(hashes, g, side="left"), np.searchsorted(hashes, g, side="right")
        for at in np.nonzero(right > left)[0].tolist():
            end = at + n
            if at == 0 and not first or end == len(x) and not last:
                continue
            if at and word[at - 1] and word[at] or end < len(x) and word[end - 1] and word[end]:
                continue
            for k in range(left[at], right[at]):
                if np.array_equal(chars[k], x[at:end]):
                    yield int(items[k]), at, end


def _short(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def candidate_regions(x: np.ndarray, p: Patterns) -> np.ndarray:
    """Rows (pattern, band start): bands of diagonals, in x, that share enough q-grams with a pattern."""
    if len(x) < Q or not len(p.keys):
        return np.zeros((0, 2), np.int64)
    g = qgrams(x)
    # A cheap table first, by the high bits, which the multiplications have mixed.
    at = np.nonzero(p.seen[_short(g)])[0]
    k = np.minimum(np.searchsorted(p.keys, g[at]), len(p.keys) - 1)
    hit = p.keys[k] == g[at]
    at, k = at[hit], k[hit]
    if not len(at):
        return np.zeros((0, 2), np.int64)
    found = []
    postings = p.first[k + 1] - p.first[k]
    ends = np.cumsum(postings)
    for a, b in _parts(ends, 2_000_000):
        n = postings[a:b]
        which = np.repeat(p.first[k[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = p.owner[which]
        diagonal = np.repeat(at[a:b], n) - p.place[which] + PATTERN
        width = 2 * (p.edits[owner] + 1)
        for half in (0, 1):
            band = (diagonal + half * width // 2) // width
            found.append(np.stack([owner, 2 * band + half], axis=1))
    keys, counts = np.unique(np.concatenate(found), axis=0, return_counts=True)
    keys = keys[counts >= p.least[keys[:, 0]]]
    width = 2 * (p.edits[keys[:, 0]] + 1)
    band, half = keys[:, 1] // 2, keys[:, 1] % 2
    return np.stack([keys[:, 0], band * width - half * width // 2 - PATTERN], axis=1)


def _parts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(ends):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield a, b
        a = b


def windows(x: np.ndarray, regions: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The text under each region with ``most`` places on either side, zeros outside; and where it starts."""
    base = regions[:, 1] - most
    length = PATTERN + 4 * most + 3
    padded = np.concatenate([np.zeros(2 * PATTERN, np.uint32), x, np.zeros(length + 2 * PATTERN, np.uint32)])
    return padded[base[:, None] + np.arange(2 * PATTERN, 2 * PATTERN + length)], base


def align(text: np.ndarray, which: np.ndarray, p: Patterns) -> np.ndarray:
    """Rows (start, end, edits) of the best alignment of each pattern within its window; zeros in a window can't be crossed.

    All windows at once, a row of cells for each character of the patterns. A
    cell's value is its edits, then, in the lower half, where it began. A run
    of skipped text characters is a running minimum.
    """
    one, wall = np.int64(1) << 32, np.int64(1000) << 32
    width = text.shape[1] - PATTERN
    pattern = np.zeros((len(which), PATTERN), np.uint32)
    for row, j in enumerate(which):
        pattern[row, : len(p.chars[j])] = p.chars[j]
    size = np.array([len(p.chars[j]) for j in which], np.int64)
    out = np.zeros((len(which), 3), np.int64)
    value = np.tile(np.arange(width, dtype=np.int64), (len(which), 1))
    for row in range(int(size.max(initial=0))):
        # Cell d holds the alignment that ends before place row + 1 + d of the window.
        char = text[:, row : row + width]
        blocked = char == 0
        step = value + np.where(blocked, wall, (char != pattern[:, row, None]) * one)
        step[:, :-1] = np.minimum(step[:, :-1], value[:, 1:] + one)
        gap = np.where(blocked, wall, one)
        gap[:, 0] = 0
        gap = np.cumsum(gap, axis=1)
        step = np.minimum.accumulate(step - gap, axis=1) + gap
        value = np.where((row < size)[:, None], step, value)
        done = np.nonzero(row + 1 == size)[0]
        if len(done):
            d = value[done].argmin(axis=1)
            best = value[done, d]
            out[done] = np.stack([best & 0xFFFFFFFF, row + 1 + d, best >> 32], axis=1)
    return out


def batch_leaks(texts: list[str], p: Patterns) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text (item, start, end, least edits, patterns found) of every item with a pattern in it.

    Short texts are searched together, apart by a character that no pattern
    has; a longer one in slices that overlap by more than a pattern.
    """
    found: list[dict[int, list]] = [{} for _ in texts]
    most = int(p.edits.max(initial=0))
    waiting: list[tuple] = []

    def verify() -> None:
        if waiting:
            text, which, base = (np.concatenate([w[i] for w in waiting]) for i in range(3))
            owner = np.repeat(np.arange(len(waiting)), [len(w[1]) for w in waiting])
            for (s, e, edits), j, b, w in zip(align(text, which, p).tolist(), which.tolist(), base.tolist(), owner, strict=True):
                if edits <= p.edits[j]:
                    members, edges, shift = waiting[w][3:]
                    k = int(np.searchsorted(edges, b + s, side="right")) - 1
                    at = shift - int(edges[k]) + b
                    o = found[members[k]].setdefault(int(p.item[j]), [s + at, e + at, edits, set()])
                    o[0], o[1], o[2] = min(o[0], s + at), max(o[1], e + at), min(o[2], edits)
                    o[3].add(j)
        waiting.clear()

    def search(x: np.ndarray, members: list[int], edges: np.ndarray, shift: int, last: bool) -> None:
        for item, s, e in short_items(x, p, not shift, last):
            k = int(np.searchsorted(edges, s, side="right")) - 1
            at = shift - int(edges[k])
            o = found[members[k]].setdefault(item, [s + at, e + at, 0, {-1}])
            o[0], o[1] = min(o[0], s + at), max(o[1], e + at)
        regions = candidate_regions(x, p)
        for i in range(0, len(regions), 5000):
            part = regions[i : i + 5000]
            text, base = windows(x, part, most)
            waiting.append((text, part[:, 0], base, members, edges, shift))
            if sum(len(w[1]) for w in waiting) >= 5000:
                verify()

    group: list[int] = []
    size = 0
    for i, t in enumerate([*texts, None]):
        if t is not None and len(t) > SLICE:
            for at in range(0, len(t), SLICE):
                first = max(0, at - 2 * PATTERN)
                search(normal(t[first : at + SLICE]), [i], np.zeros(1, np.int64), first, at + SLICE >= len(t))
            continue
        if group and (t is None or size + len(t) > SLICE):
            edges = np.cumsum([0] + [len(texts[k]) + 1 for k in group])
            x = normal("\0".join(texts[k] for k in group)).copy()
            x[edges[1:-1] - 1] = 0
            search(x, group, edges, 0, True)
            group, size = [], 0
        if t is not None and len(t) >= (1 if p.short else LEAST - 2):
            group.append(i)
            size += len(t) + 1
    verify()
    return [[(k, o[0], o[1], o[2], len(o[3])) for k, o in sorted(f.items())] for f in found]


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of the items, a bounded number of characters at a time."""
    keys, texts, size = [], [], 0
    for r in benchmark.where(F.col(text).isNotNull()).select(item, text).toLocalIterator():
        if size and size + len(r[1]) > BLOCK_CHARS:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(r[0]), texts.append(r[1])
        size += len(r[1])
    yield keys, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start, end, edits, patterns.

    start and end hold all of the item's patterns found in the text. Null and
    empty texts have no rows, nor have items without a letter or digit; items
    below LEAST characters are found exactly, as whole words, with no edits and
    one pattern. Repeated rows give repeated rows; an empty table on either
    side gives none.
    """
    spark = docs.sparkSession
    bound_batches(spark, 500)
    kind, item_kind = docs.schema[doc_id].dataType, benchmark.schema[item].dataType
    schema = f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, start long, end long, edits int, patterns int"

    def search(shared):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, p = shared.value
            for batch in batches:
                found = batch_leaks([t or "" for t in batch.column(1).to_pylist()], p)
                rows = [(i, *x) for i, xs in enumerate(found) for x in xs]
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({
                        "doc_id": batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())).to_pandas(types_mapper=pd.ArrowDtype) if rows else [],
                        "item_id": [keys[r[1]] for r in rows], "start": [r[2] for r in rows], "end": [r[3] for r in rows], "edits": [r[4] for r in rows], "patterns": [r[5] for r in rows],
                    }),
                    schema=arrow, preserve_index=False,
                )
        return find

    from pyspark.sql.pandas.types import to_arrow_schema

    out = spark.createDataFrame([], schema)
    arrow = to_arrow_schema(out.schema)
    for keys, texts in blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast((keys, Patterns.of(texts)))
        out = out.union(docs.select(F.col(doc_id), F.col(text)).mapInArrow(search(shared), schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns; null texts stay. Nothing is shuffled."""
    bound_batches(docs.sparkSession, 500)
    for _, texts in blocks(benchmark, item, item_text):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(Patterns.of(texts)))(F.col(text)))
    return docs


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(column: pd.Series) -> pd.Series:
        return pd.Series([not x for x in batch_leaks([t or "" for t in column], shared.value)], dtype=bool)

    return clean


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
