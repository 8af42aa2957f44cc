"""Removal of every byte under a string of ``LENGTH`` bytes that starts at two places or more.

1. Each window of LENGTH bytes has an anchor, the place of its smallest Q-byte
   hash. Equal windows have equal anchors at equal places, so they meet under
   the anchor's hash. Neighbouring windows with one anchor are a context; a
   text has about two contexts for LENGTH - Q bytes, and only their hashes are
   written.
2. Anchors that occur once are dropped. Where all contexts of an anchor are the
   same, all their windows repeat. The other contexts, once each, get their
   text back.
3. Per anchor, the texts after it and, reversed, before it are put in order
   by deep-shallow sorting. For each distance of window and anchor, the
   windows with equal neighbours on both sides are those whose prefixes tie in
   both orders: they occur more than once. Anchors with more than
   ``HOT`` contexts don't meet in one task: their windows are counted one by
   one, by a 128-bit digest, with partial sums before the shuffle.
4. The intervals found go back to the contexts' texts, and texts lose them.

Contexts carry the first and last row that have them, so each repeated window
is known to be in one row only or in several, which tells passages that rows
share from lines that one text repeats.

Texts are known by a 128-bit digest; equal texts are treated once and each of
their rows counts as a place. Texts cross the network twice, compressed, for
steps 2 and 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import shingles as sh
from plumbline.llm.common import bound_batches, broadcast_if_small, discard, materialize, table
from plumbline.llm.deep_shallow import sort_groups
from plumbline.plans.lineage import release

LENGTH, Q = 200, 16
SPAN = LENGTH - Q  # largest distance of a window's start from its anchor
HOT = 4096
#: Bytes searched at a time; at most that of the word hashes.
SLICE = 1 << 19
#: Contexts that a task sorts at a time, at least (an anchor stays together).
CHUNK = 8000

OCCURRENCE = pa.struct([("key", pa.int64()), ("context", pa.int64()), ("at", pa.int64())])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each ``width`` in a row, by block-wise running minima."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, context hash, first window, anchor less first window, last less first window, of the runs of valid windows.

    x: at most a slice of bytes; valid: whether a window may start at each place.
    """
    if len(x) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    b = x.astype(np.uint64)
    two = b[:-1] | (b[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    grams = sh.mix(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + sh.mix(eight[8:]))
    # The lowest 22 bits give way to the place, so that ties go to the leftmost.
    low = np.uint64((1 << 22) - 1)
    anchor = (_sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), SPAN + 1) & low).astype(np.int64)
    p = np.nonzero(valid[: len(anchor)])[0]
    if not len(p):
        return contexts(x[:0], valid)
    m = anchor[p]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(m) != 0) | (np.diff(p) != 1)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(p)) - 1
    a, z = p[first], p[last]
    digest = sh.mix(sh.hash_runs(x, a, z + LENGTH) + (z - a).astype(np.uint64))
    return grams[m[first]].view(np.int64), digest.view(np.int64), a, m[first] - a, z - a


def _scan(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """key, context and packed place of the contexts of each text; places pack first window, anchor and last window."""
    none = (np.zeros(0, np.int64),) * 3
    out = [none for _ in texts]
    group: list[int] = []
    size = 0

    def search() -> None:
        if group:
            x = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
            edges = np.cumsum([0] + [len(texts[i]) for i in group])
            valid = np.ones(len(x), bool)
            for e in edges[1:]:
                valid[max(0, e - LENGTH + 1) : e] = False
            key, context, a, m, z = contexts(x, valid)
            at = np.searchsorted(a, edges)
            for k, i in enumerate(group):
                s = slice(at[k], at[k + 1])
                out[i] = (key[s], context[s], (a[s] - edges[k] << 16) | (m[s] << 8) | z[s])
            group.clear()

    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if len(t) > SLICE:
            parts = []
            for at in range(0, len(t) - LENGTH + 1, SLICE - LENGTH):
                x = np.frombuffer(t, np.uint8)[at : at + SLICE]
                valid = np.arange(len(x)) < min(SLICE - LENGTH, len(t) - LENGTH + 1 - at)
                key, context, a, m, z = contexts(x, valid)
                parts.append((key, context, (a + at << 16) | (m << 8) | z))
            out[i] = tuple(np.concatenate([p[k] for p in parts]) for k in range(3))
            continue
        if size + len(t) > SLICE:
            search()
            size = 0
        group.append(i)
        size += len(t)
    search()
    return out


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, row (a number), rid (digest of the text), n_bytes, whole_sha256 and the contexts' hashes of each document."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            found = _scan(texts)
            offsets = np.cumsum([0] + [len(f[0]) for f in found])
            flat = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.arange(row, row + len(texts))), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(f) for f in flat], fields=list(OCCURRENCE))),
                ],
                names=["doc_id", "row", "rid", "n_bytes", "whole_sha256", "found"],
            )
            row += len(texts)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(find, f"doc_id {kind}, row long, rid binary, n_bytes long, whole_sha256 string, found array<struct<key:long,context:long,at:long>>")


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """rid and the compressed text of every different text, partitioned by rid."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            seen: dict[bytes, bytes] = {}
            for t in texts:
                if len(t) >= LENGTH:
                    seen.setdefault(hashlib.blake2b(t, digest_size=16).digest(), t)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([squeeze.compress(t) for t in seen.values()], pa.binary())], names=["rid", "packed"])

    return docs.select(F.col(text)).mapInArrow(pack, "rid binary, packed binary").groupBy("rid").agg(F.first("packed").alias("packed"))


def context_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text of the wanted contexts: key, context, n, low and high (rows), before (anchor less start), last, body."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for packed, want in zip(batch.column(0), batch.column(1), strict=True):
                data = unpack.decompress(packed.as_py())
                for w in want.as_py():
                    a, m, z = w["at"] >> 16, (w["at"] >> 8) & 255, w["at"] & 255
                    rows.append((w["key"], w["context"], w["n"], w["low"], w["high"], m, z, data[a : a + z + LENGTH]))
            kinds = (*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], names=["key", "context", "n", "low", "high", "before", "last", "body"])

    return texts.join(wanted, "rid").select("packed", "want").mapInArrow(cut, "key long, context long, n long, low long, high long, before int, last int, body binary")


def _runs(flags: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, start, end) under the runs of flagged windows; flags by distance of window and anchor."""
    edge = np.diff(np.vstack([np.zeros((1, flags.shape[1]), np.int8), flags.astype(np.int8)]), axis=0).T
    c, near = np.nonzero(edge == 1)
    _, far = np.nonzero(edge == -1)
    return c, before[c] - (far - 1), before[c] - near + LENGTH


def repeated_windows(key: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray, last: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context number, start, end, shared) of the parts of contexts under windows that occur twice or more among their anchor's; those in several rows once more, as shared."""
    size = len(bodies)
    length = np.array([len(b) for b in bodies], np.int64)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    offset = np.concatenate([[0], np.cumsum(length)])[:-1]
    after = np.arange(LENGTH)[None, :]
    take = np.minimum(offset[:, None] + before[:, None] + after, len(flat) - 1)
    right = np.where(before[:, None] + after < length[:, None], flat[take], 0).astype(np.uint8)
    back = np.arange(1, SPAN + 1)[None, :]
    take = np.maximum(offset[:, None] + before[:, None] - back, 0)
    left = np.where(back <= before[:, None], flat[take], 0).astype(np.uint8)
    _, group = np.unique(key, return_inverse=True)
    places = []
    for side in (right, left):
        order, common = sort_groups(side, group)
        places.append((order, common))
    repeated, shared = np.zeros((SPAN + 2, size), bool), np.zeros((SPAN + 2, size), bool)
    tie_right, tie_left = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for d in range(int(before.max(initial=-1)) + 1):
        # Windows that start d before the anchor: d bytes on the left and the rest on the right must tie.
        here = np.nonzero((d <= before) & (d >= before - last))[0]
        if not len(here):
            continue
        tie_right[places[0][0]] = np.cumsum(places[0][1] < LENGTH - d)
        tie_left[places[1][0]] = np.cumsum(places[1][1] < d)
        _, which = np.unique(tie_right[here] * (size + 1) + tie_left[here], return_inverse=True)
        repeated[d, here] = np.bincount(which, n[here])[which] >= 2
        first, final = np.full(len(here), np.iinfo(np.int64).max), np.full(len(here), -1, np.int64)
        np.minimum.at(first, which, low[here])
        np.maximum.at(final, which, high[here])
        shared[d, here] = (first < final)[which]
    parts = [_runs(flags, before) for flags in (repeated, shared)]
    kind = np.repeat([False, True], [len(p[0]) for p in parts])
    return *(np.concatenate([p[k] for p in parts]) for k in range(3)), kind


def sort_contexts(bodies: DataFrame) -> DataFrame:
    """key, context, start, end, shared of the repeated parts; each anchor's contexts are in one partition."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        rows = 0

        def done(t: pa.Table) -> pa.RecordBatch:
            key, context = t["key"].to_numpy(), t["context"].to_numpy()
            one = np.unique(np.stack([key, context]), axis=1, return_index=True)[1]  # copies of a text send its contexts again
            t = t.take(pa.array(one))
            key, context = key[one], context[one]
            c, start, end, shared = repeated_windows(key, t["n"].to_numpy(), t["low"].to_numpy(), t["high"].to_numpy(), t["before"].to_numpy().astype(np.int64), t["last"].to_numpy().astype(np.int64), t["body"].to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(key[c]), pa.array(context[c]), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(shared, pa.bool_())], names=["key", "context", "start", "end", "shared"])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= CHUNK:
                t = pa.concat_tables(waiting)
                keys = t["key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield done(t.slice(0, cut))
                waiting, rows = [t.slice(cut)], len(keys) - cut
        if rows:
            yield done(pa.concat_tables(waiting))

    return bodies.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "key long, context long, start long, end long, shared boolean")


def count_windows(bodies: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: each window's digest is counted over the cluster."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                r = batch.slice(one, 1).to_pylist()[0]
                many = r["last"] + 1
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[k]] * many, pa.int64()) for k in ("key", "context", "n", "low", "high")), pa.array(range(many), pa.int64()), pa.array([hashlib.blake2b(r["body"][i : i + LENGTH], digest_size=16).digest() for i in range(many)], pa.binary())],
                    names=["key", "context", "n", "low", "high", "start", "window"],
                )

    windows = materialize(bodies.mapInArrow(explode, "key long, context long, n long, low long, high long, start long, window binary").dropDuplicates(["key", "context", "start"]))
    often = windows.groupBy("window").agg(F.sum("n").alias("times"), (F.min("low") < F.max("high")).alias("shared")).where("times >= 2").select("window", "shared")
    found = windows.join(often, "window").select("key", "context", "start", (F.col("start") + LENGTH).alias("end"), "shared")
    return found.withColumn("shared", F.explode(F.when(F.col("shared"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))


def cut_texts(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """rid, kept (the remaining bytes), n_removed, n_spans and n_shared of the texts that lose something."""
    def joined(marks: list[tuple[int, int]]) -> list[list[int]]:
        ends: list[list[int]] = []
        for m in sorted(marks):
            if ends and m[0] <= ends[-1][1]:
                ends[-1][1] = max(ends[-1][1], m[1])
            else:
                ends.append(list(m))
        return ends

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, removed, spans, shared = [], [], [], []
            for packed, marks_ in zip(batch.column(1), batch.column(2), strict=True):
                data = unpack.decompress(packed.as_py())
                found = marks_.as_py()
                ends = joined([(m["start"], m["end"]) for m in found])
                stops = [0, *(x for e in ends for x in e), len(data)]
                kept.append(b"".join(data[stops[i] : stops[i + 1]] for i in range(0, len(stops), 2)))
                removed.append(len(data) - len(kept[-1]))
                spans.append(len(ends))
                shared.append(sum(e[1] - e[0] for e in joined([(m["start"], m["end"]) for m in found if m["shared"]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (removed, spans, shared))], names=["rid", "kept", "n_removed", "n_spans", "n_shared"])

    return texts.join(marks, "rid").select("rid", "packed", "marks").mapInArrow(cut, "rid binary, kept binary, n_removed long, n_spans long, n_shared long")


def _free(spark: SparkSession, *written: DataFrame) -> None:
    """Delete tables of steps that are over, and let Spark drop their shuffle files, which would stay until the driver happens to collect garbage."""
    for df in written:
        discard(df)
    release(spark)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, and with ``keep_bytes`` kept (binary).

    n_shared: those of the removed bytes that are under a string which another
    row has as well; the others repeat only within their own text.

    A null text is empty. Rows with equal texts repeat one another, whatever
    their keys, so such texts of LENGTH bytes or more lose everything. Shorter
    texts lose nothing. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scanned = materialize(scan(docs, doc_id, text))
    rows = materialize(scanned.select("doc_id", "row", "rid", "n_bytes", "whole_sha256"), spark)
    every = scanned.select("row", F.explode("found").alias("o")).select("row", "o.key", "o.context", "o.at")

    # Written first, so that both sides of the join are plain shuffles, whose hot keys the adaptive join splits.
    twice = materialize(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("key"))
    _free(spark)
    found = materialize(every.join(twice, "key", "left_semi"))
    _free(spark, scanned, twice)
    by_context = found.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("one"), F.max("row").alias("high"))
    by_context = materialize(by_context.select("key", "context", "n", "one.row", "one.at", F.col("one.row").alias("low"), "high"))
    by_key = materialize(by_context.groupBy("key").agg(F.count(F.lit(1)).alias("n_contexts")))
    sole = by_context.join(by_key.where("n_contexts = 1").select("key"), "key", "left_semi").where("n >= 2")
    sole = sole.select("key", "context", F.lit(0).cast("long").alias("start"), (F.col("at").bitwiseAND(255) + LENGTH).alias("end"), F.explode(F.when(F.col("low") < F.col("high"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("shared"))

    several = by_context.join(by_key.where("n_contexts > 1"), "key").join(rows.select("row", "rid"), "row")
    # Written first: its shuffle files go before those of the texts come.
    wanted = materialize(several.groupBy("rid").agg(F.collect_list(F.struct("key", "context", "n", "low", "high", "at")).alias("want")))
    _free(spark)
    bodies = materialize(context_texts(distinct_texts(docs, text), wanted))
    _free(spark, wanted)
    # One key in HOT contexts at most, so few: the texts are not shuffled to meet them.
    hot = broadcast_if_small(materialize(by_key.where(F.col("n_contexts") > HOT).select("key")))
    parts = materialize(sole.union(sort_contexts(bodies.join(hot, "key", "left_anti"))).union(count_windows(bodies.join(hot, "key", "left_semi"))))
    _free(spark, bodies)

    first_rows = rows.groupBy("rid").agg(F.min("row").alias("row"))
    marks = (
        found.join(parts, ["key", "context"])
        .select("row", (F.shiftright("at", 16) + F.col("start")).alias("start"), (F.shiftright("at", 16) + F.col("end")).alias("end"), "shared")
        .join(first_rows, "row")
        .groupBy("rid").agg(F.collect_list(F.struct("start", "end", "shared")).alias("marks"))
    )
    marks = materialize(marks)
    _free(spark, found, parts)
    lost = cut_texts(distinct_texts(docs, text), marks).withColumn("kept_sha256", F.sha2("kept", 256))
    lost = materialize(lost if keep_bytes else lost.drop("kept"))
    out = rows.join(lost, "rid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"), *(["kept"] if keep_bytes else []),
    )
    return out


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
