"""Readers of exported data: graph JSON, benchmark results, repository lists, commit logs, issues, synthetic graphs."""

from __future__ import annotations

import contextlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.graph import Graph
from plumbline.plans.lineage import materialize, release, ship_package

#: Characters of a document that a task holds, about.
PIECE = 1 << 20
#: Cuts of a piece tried before its members are taken one by one.
TRIES = 20
RESULTS = "results array<struct<name:string,url:string,agq:struct<modularity:double,acyclicity:double,stability:double,cohesion:double,agq_score:double,nodes:long,edges:long,language:string>,churn:struct<hotspot_ratio:double,churn_gini:double,n_files:long,mean_churn:double>,runtime_ms:double>>"
LOG = "repo string, sha string, ts timestamp, subject string, path string"
ISSUES = "repo string, state string, created_at timestamp, closed_at timestamp, is_pull_request boolean, ncloc double"


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """file, block, n, chunk: the files' texts in pieces of about ``PIECE`` characters; each ends with a comma, the last of a file with one too many.

    Lines end at commas, so that a document without line ends isn't one row.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []
        size = n = 0
        at = None

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([",".join([*waiting, ""])])], names=["file", "block", "n", "chunk"])

        for batch in batches:
            files, blocks, values = (batch.column(i) for i in range(3))
            if not batch.num_rows:
                continue
            change = (np.diff(files.dictionary_encode().indices.to_numpy()) != 0) | (np.diff(blocks.to_numpy()) != 0)
            edges = [0, *(int(i) + 1 for i in np.nonzero(change)[0]), batch.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                here = (files[i].as_py(), blocks[i].as_py())
                if here != at:
                    if waiting:
                        yield piece()
                    at, waiting, size, n = here, [], 0, 0
                part = ",".join(values.slice(i, j - i).to_pylist())
                waiting.append(part)
                size += len(part)
                if size >= PIECE:
                    yield piece()
                    waiting, size, n = [], 0, n + 1
        if waiting:
            yield piece()

    lines = spark.read.text(path, lineSep=",").select("_metadata.file_path", "_metadata.file_block_start", "value")
    return lines.mapInArrow(join, "file string, block long, n long, chunk string")


def _documents(pieces: Iterator[str]) -> Iterator[tuple[str | None, list]]:
    """(key, values) of JSON objects that stand one after another, as their text comes in pieces: members of an array in several goes, others as one value.

    Only text that isn't parsed yet is held. A cut within a string or a nested
    value leaves it open, so what parses was cut between two members. Each
    object begins with the key None.
    """
    decoder = json.JSONDecoder()
    text, at, ended = "", 0, False
    space = " \t\r\n"

    def more() -> bool:
        nonlocal text, at, ended
        part = next(pieces, None)
        ended = part is None
        text, at = text[at:] + (part or ""), 0
        return not ended

    def peek(skipped: str = space) -> str:
        nonlocal at
        while True:
            while at < len(text) and text[at] in skipped:
                at += 1
            if at < len(text) or not more():
                return text[at : at + 1]

    def value() -> object:
        nonlocal at
        while True:
            try:
                out, end = decoder.raw_decode(text, at)
                if end < len(text) or ended:  # a number at the end may go on
                    at = end
                    return out
            except json.JSONDecodeError:
                if ended:
                    raise
            more()

    while peek(space + ",[]\ufeff"):
        if peek() != "{":
            raise ValueError("a graph's JSON must be an object")
        yield None, []
        at += 1
        while (c := peek(space + ",")) != "}":
            if not c:
                raise ValueError("a graph's JSON ends within an object")
            key = value()
            if peek() != ":":
                raise ValueError("a graph's JSON lacks a colon")
            at += 1
            if peek() != "[":
                yield key, [value()]
                continue
            while not ended and len(text) - at < PIECE:
                more()
            with contextlib.suppress(json.JSONDecodeError):
                members, at = decoder.raw_decode(text, at)
                yield key, members
                continue
            at += 1
            while (c := peek(space + ",")) != "]":
                if not c:
                    raise ValueError("a graph's JSON ends within an array")
                while not ended and len(text) - at < PIECE:
                    more()
                # As many members as are there, else one of any size.
                cut, close = len(text), {"[": "],", "{": "},", '"': '",'}.get(c)
                members = []
                for _ in range(TRIES if close else 0):
                    cut = text.rfind(close, at, cut)
                    if cut < 0:
                        break
                    with contextlib.suppress(json.JSONDecodeError):
                        whole = f"[{text[at : cut + 1]}]"
                        members, end = decoder.raw_decode(whole)
                        at = cut + 1 if end == len(whole) else at + end - 2  # or where the array ends before the cut
                        break
                yield key, members or [value()]
            at += 1
        at += 1


def read_graph_json(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """A graph per file, named by it or by a first key graph_id, and its class components (graph_id, lcom4).

    A node is a name or an object with id and internal; edges are pairs. Nodes
    that only edges name aren't internal. A file has one object of any size,
    or several; those with one graph_id are parts of a graph. A file is read
    by one task, which holds about ``PIECE`` characters of it.
    """
    ship_package(spark)
    name = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, c) for batch in batches for f, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for file, group in itertools.groupby(rows, lambda r: r[0]):
            named = graph = re.sub(r"\.json$", "", unquote(file).rsplit("/", 1)[-1])
            begun = False
            for key, members in _documents(c for _, c in group):
                if key is None:
                    graph, begun = named, False
                elif key == "graph_id" and not begun:
                    graph = name(members[0])
                begun = begun or key in ("nodes", "edges", "classes_lcom4")
                if key == "nodes":
                    found = [("n", name(m.get("id")), None, bool(m.get("internal")), None) if isinstance(m, dict) else ("n", name(m), None, False, None) for m in members]
                elif key == "edges":
                    found = [("e", *map(name, [*(m or []), None, None][:2]), None, None) for m in members]
                else:
                    found = [("c", None, None, None, None if m is None else int(m)) for m in members] if key == "classes_lcom4" else []
                if found:
                    columns = list(zip(*found, strict=True))
                    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([graph] * len(found), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["graph_id", "kind", "a", "b", "internal", "lcom4"])

    pieces = _chunks(spark, path).repartition("file").sortWithinPartitions("file", "block", "n").select("file", "chunk")
    rows = materialize(pieces.mapInArrow(parse, "graph_id string, kind string, a string, b string, internal boolean, lcom4 long"))
    release(spark)
    nodes = rows.where("kind = 'n'").select("graph_id", F.col("a").alias("id"), "internal")
    edges = rows.where("kind = 'e'").select("graph_id", F.col("a").alias("src"), F.col("b").alias("tgt"))
    return Graph.of_edges(edges, nodes), rows.where("kind = 'c'").select("graph_id", "lcom4")


def _joined(entries: DataFrame, sort: list[str]) -> DataFrame:
    """graph_id, at, text: the column entry in the order of ``sort``, joined by commas to texts of about ``PIECE`` characters; at is their order."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            graphs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for graph, group in itertools.groupby(range(len(graphs)), lambda i: graphs[i]):
                yield pa.RecordBatch.from_arrays([pa.array([graph], pa.string()), pa.array([at], pa.int64()), pa.array([",".join(texts[i] for i in group)])], names=["graph_id", "at", "text"])
                at += 1

    return entries.repartitionByRange("graph_id", *sort).sortWithinPartitions("graph_id", *sort).select("graph_id", "entry").mapInArrow(join, "graph_id string, at long, text string")


def _entries(g: Graph) -> tuple[DataFrame, DataFrame]:
    node, edge = F.to_json(F.struct("id", "internal")), F.to_json(F.array("src", "tgt"))
    return g.nodes.withColumn("entry", node), g.edges.withColumn("entry", edge)


def graph_json(g: Graph) -> DataFrame:
    """graph_id, json: each graph as one document with sorted nodes and edges.

    A document is one value, so a task holds it several times; ``write_graph_json`` has no such bound.
    """
    ship_package(g.edges.sparkSession)
    g = g.written()
    nodes, edges = _entries(g)
    texts = _joined(nodes, ["id"]).withColumn("part", F.lit(0)).union(_joined(edges, ["src", "tgt"]).withColumn("part", F.lit(1)))
    lists = texts.repartition("graph_id").groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("part", "at", "text"))).alias("l"))
    of = lambda part: F.concat_ws(",", F.transform(F.filter("l", lambda x: x["part"] == part), lambda x: x["text"]))
    return lists.select("graph_id", F.concat(F.lit('{"nodes":['), of(0), F.lit('],"edges":['), of(1), F.lit("]}")).alias("json"))


def write_graph_json(g: Graph, path: str) -> str:
    """Writes graphs as lines, each a document with a part of the nodes or edges of the graph in its graph_id; no task holds more than a batch."""
    ship_package(g.edges.sparkSession)

    def lines(of: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                graphs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                groups = itertools.groupby(range(len(graphs)), lambda i: graphs[i])
                out = [f'{{"graph_id":{json.dumps(graph, ensure_ascii=False)},"{of}":[{",".join(texts[i] for i in group)}]}}' for graph, group in groups]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

        return write

    g = g.written()
    nodes, edges = (x.select("graph_id", "entry").mapInArrow(lines(of), "value string") for x, of in zip(_entries(g), ("nodes", "edges"), strict=True))
    nodes.union(edges).write.text(path, compression="gzip")
    return path


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """name, url, the metrics, churn measures and run time of each project of benchmark result files; numbers that aren't finite are null."""
    rows = spark.read.schema(RESULTS).json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.name", "r.url", "r.agq.*", "r.churn.*", "r.runtime_ms")
    numbers = [c for c, kind in rows.dtypes if kind == "double"]
    return rows.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c in numbers})


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """name, url of a JSON list; a row without either is an error."""
    rows = spark.read.schema("name string, url string").json(path, multiLine=True)
    bad = F.col("name").isNull() | F.col("url").isNull()
    return rows.withColumn("name", F.when(bad, F.raise_error(F.lit("a repository needs a name and a url"))).otherwise(F.col("name")))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """commit_files from text dumps of ``git log --name-only --format='@%H%x09%ct%x09%s'``, one file per repository.

    A line with @ starts a commit; the others are its paths.
    """
    raw = spark.read.text(path, wholetext=True).withColumn("repo", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1))
    commits = raw.select("repo", F.explode(F.split("value", r"(?m)^@")).alias("c")).where(F.trim("c") != "")
    lines = commits.select("repo", F.split("c", "\n").alias("l")).withColumn("h", F.split(F.get("l", F.lit(0)), "\t", 3))
    head = lambda k: F.get("h", F.lit(k))
    return lines.select("repo", head(0).alias("sha"), F.timestamp_seconds(head(1).cast("long")).alias("ts"), head(2).alias("subject"), F.explode(F.filter(F.slice("l", F.lit(2), F.size("l")), lambda x: F.trim(x) != "")).alias("path"))


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues exported as JSON lines."""
    return spark.read.schema(ISSUES).json(path)


def synthetic_graph(spark: SparkSession, n_nodes: int, n_edges: int, seed: int = 42, packages: tuple[str, ...] = ("api", "core", "db", "ui", "auth", "jobs", "util", "web")) -> DataFrame:
    """Distinct edges without loops between modules ``package.m<i>``, from hashes of the row number."""
    name = lambda k: F.concat(F.element_at(F.array(*[F.lit(p) for p in packages]), (F.pmod(k, F.lit(len(packages))) + 1).cast("int")), F.lit(".m"), k)
    node = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{salt}"), "id")), 1, 8), 16, 10).cast("long") % n_nodes
    rows = spark.range(n_edges * 2).select("id", name(node("s")).alias("src"), name(node("t")).alias("tgt")).where("src <> tgt")
    return rows.groupBy("src", "tgt").agg(F.min("id").alias("id")).orderBy("id").limit(n_edges).select(F.lit("g").alias("graph_id"), "src", "tgt")


def synthetic_rules(n: int, seed: int = 42, packages: tuple[str, ...] = ("api", "core", "db", "ui", "auth", "jobs", "util", "web")) -> list[dict]:
    """Forbidden rules of five kinds in turn: package to package, wildcard source, wildcard target, character class, single modules."""
    k = len(packages)
    out = []
    for i in range(n):
        a, b = packages[(i * 7 + seed) % k], packages[(i * 3 + seed + 1) % k]
        kinds = ((f"{a}/*", f"{b}/*"), ("*", f"{b}/m{i % 10}*"), (f"{a}/*", "*/m?"), (f"{a}/m[0-4]*", f"{b}/*"), (f"{a}/m{i}", f"{b}/m{i + 1}"))
        out.append({"name": f"r{i}", "type": "forbidden", "from": kinds[i % 5][0], "to": kinds[i % 5][1]})
    return out


def parse_cases(spec: str) -> list[tuple[int, int, int]]:
    """``nodes:edges:rules`` triples, comma-separated."""
    return [tuple(int(x) for x in case.split(":")) for case in spec.split(",") if case.strip()]


def links(pages: DataFrame, url: Column, page: Column) -> DataFrame:
    """src (host), tgt (target of a link) of HTML pages, distinct."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return pages.select(host.alias("src"), F.explode(F.regexp_extract_all(page, F.lit(r'href="([^"]+)"'), F.lit(1))).alias("tgt")).distinct()
