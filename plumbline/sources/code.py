"""Source files as rows: scanning, language and root detection, parsing to modules, edges and classes.

files: graph_id, path (relative, with slashes), text.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.lineage import ship_package

EXTENSIONS = {"Python": "py", "Java": "java", "Go": "go"}
SKIP_DIRECTORIES = r"(^|/)(\.[^/]*|target|node_modules|__pycache__)/"
MOST_BYTES = 1_048_576
CLASS = "struct<name:string,is_abstract:boolean,methods:array<struct<name:string,attrs:array<string>>>>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def read_files(spark: SparkSession, root: str, graph_id: str = "g", pattern: str = "*.{py,java,go}") -> DataFrame:
    """graph_id, path, text of the source files below a folder; too large or not UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("/")[-1]
    path = F.regexp_replace("path", rf"^.*?/{re.escape(base)}/", "")
    return keep_sources(raw.where((F.col("length") <= MOST_BYTES) & F.is_valid_utf8(F.col("content").cast("string"))).select(F.lit(graph_id).alias("graph_id"), path.alias("path"), F.col("content").cast("string").alias("text")))


def keep_sources(files: DataFrame) -> DataFrame:
    """Leave out hidden, generated and Java test directories and package markers."""
    path = F.col("path")
    java_test = (extension(path) == "java") & path.rlike(r"(^|/)(src/)?test/")
    return files.where(~path.rlike(SKIP_DIRECTORIES) & ~path.rlike(r"(^|/)__init__\.py$") & ~java_test)


def within_depth(files: DataFrame, depth: int) -> DataFrame:
    return files.where(F.size(F.split("path", "/")) <= depth)


def detect_language(files: DataFrame) -> DataFrame:
    """graph_id, language: Go, then Java, where they have files and at least a quarter of the Python files; else Python, if any."""
    count = lambda e: F.count(F.when(extension(F.col("path")) == e, 1))
    n = files.groupBy("graph_id").agg(*[count(e).alias(e) for e in ("py", "java", "go")])
    language = (
        F.when((F.col("go") > 0) & (F.col("go") * 4 >= F.col("py")) & (F.col("go") >= F.col("java")), "Go")
        .when((F.col("java") > 0) & (F.col("java") * 4 >= F.col("py")), "Java").when(F.col("py") > 0, "Python")
    )
    return n.select("graph_id", language.alias("language"))


def common_language(files: DataFrame, default: str = "Python") -> DataFrame:
    """graph_id, language of the most frequent known extension; ties by name."""
    language = F.lit(None).cast("string")
    for name, e in EXTENSIONS.items():
        language = F.when(extension(F.col("path")) == e, F.lit(name)).otherwise(language)
    counts = files.groupBy("graph_id", language.alias("language")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("graph_id").agg(F.max(F.when(F.col("language").isNotNull(), F.struct("n", "language"))).alias("b"))
    return best.select("graph_id", F.coalesce("b.language", F.lit(default)).alias("language"))


def source_root(files: DataFrame) -> DataFrame:
    """graph_id, root: ``src/main/java``, else ``src/<one package>``, else ``src``, else the top folder that holds a package marker, else empty."""
    has = lambda p: F.max(F.col("path").rlike(p))
    packages = F.collect_set(F.when(F.col("path").rlike(r"^src/[^/]+/__init__\.py$"), F.regexp_extract("path", r"^src/([^/]+)/", 1)))
    tops = F.min(F.when(F.col("path").rlike(r"^[^/]+/__init__\.py$") & ~F.col("path").rlike(r"^tests?/"), F.substring_index("path", "/", 1)))
    root = F.when(has(r"^src/main/java/"), F.lit("src/main/java")).when(F.size(packages) == 1, F.concat(F.lit("src/"), F.get(packages, F.lit(0)))).when(has(r"^src/"), F.lit("src")).otherwise(F.coalesce(tops, F.lit("")))
    return files.groupBy("graph_id").agg(root.alias("root"))


def module_name(path: Column, root: Column, text: Column) -> Column:
    """Dotted name: a Java file's package and stem; else the path below the root without its ending."""
    inner = F.when((root != "") & F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)
    stem = F.regexp_replace(inner, r"\.[A-Za-z0-9]+$", "")
    declared = F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    java = (extension(path) == "java") & (declared != "")
    return F.when(java, F.concat_ws(".", declared, F.element_at(F.split(stem, "/"), -1))).otherwise(F.translate(stem, "/", "."))


def python_rows(text: str) -> tuple[list[str], list[dict]]:
    """Imported modules (relative ones left out) and classes of a Python file; nothing if it doesn't parse.

    Imports within functions count, those within classes don't.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    imports, classes, stack = [], [], [tree]
    while stack:
        for node in ast.iter_child_nodes(stack.pop()):
            if isinstance(node, ast.Import):
                imports += [a.name for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                imports += [node.module] if node.module and not node.level else []
            elif isinstance(node, ast.ClassDef):
                classes.append(_python_class(node))
            else:
                stack.append(node)
    return sorted(set(imports)), classes


def _python_class(node: ast.ClassDef) -> dict:
    name = lambda x: x.attr if isinstance(x, ast.Attribute) else x.id if isinstance(x, ast.Name) else ""
    abstract = any(name(b) in ("ABC", "ABCMeta", "Protocol") for b in [*node.bases, *(k.value for k in node.keywords)])
    methods = []
    for item in node.body:
        if isinstance(item, ast.FunctionDef | ast.AsyncFunctionDef):
            abstract = abstract or any(name(d) == "abstractmethod" for d in item.decorator_list)
            attrs = {x.attr for x in ast.walk(item) if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self"}
            methods.append({"name": item.name, "attrs": sorted(attrs)})
    return {"name": node.name, "is_abstract": abstract, "methods": methods}


_JAVA_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_JAVA_TYPE = re.compile(r"((?:\b(?:public|protected|private|abstract|final|static|sealed|strictfp)\s+)*)\b(class|interface|enum)\s+(\w+)")
_JAVA_METHOD = re.compile(r"(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{")


def java_rows(text: str) -> tuple[list[str], list[dict]]:
    """Imports (``static`` and ``.*`` dropped) and top-level types of a Java file, by a scan of braces outside comments and strings."""
    plain = _JAVA_NOISE.sub(" ", text)
    imports = sorted({m.removesuffix(".*") for m in re.findall(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", plain)})
    classes, depth, at = [], 0, 0
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "}":
            depth -= 1
            at = m.end() if depth == 0 else at
            continue
        if depth == 0 and (kind := _JAVA_TYPE.search(plain, at, m.start())):
            body = _java_body(plain, m.end())
            classes.append({"name": kind[3], "is_abstract": "abstract" in kind[1] or kind[2] == "interface", "methods": _java_methods(body)})
        depth += 1
    return imports, classes


def _java_body(text: str, start: int) -> str:
    depth = 1
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return text[start : m.start()]
    return text[start:]


def _java_methods(body: str) -> list[dict]:
    out, at = [], 0
    while m := _JAVA_METHOD.search(body, at):
        inner = _java_body(body, m.end())
        if m[1] not in ("if", "for", "while", "switch", "catch", "synchronized"):
            out.append({"name": m[1], "attrs": sorted(set(re.findall(r"\bthis\.(\w+)", inner)))})
        at = m.end() + len(inner)
    return out


def go_rows(text: str) -> tuple[list[str], list[dict]]:
    """Imports, single and in blocks, and one class without methods for each type declaration of a Go file."""
    plain = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    blocks = re.findall(r"(?m)^\s*import\s*\(([^)]*)\)", plain)
    imports = re.findall(r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', plain) + [x for b in blocks for x in re.findall(r'"([^"]+)"', b)]
    types = re.findall(r"(?m)^type\s+(?:\(\s*)?(\w+)", plain)
    return sorted(set(imports)), [{"name": t, "is_abstract": False, "methods": []} for t in types]


PARSERS = {"py": python_rows, "java": java_rows, "go": go_rows}


def parse(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """graph_id, path, module, imports, classes of each file; files of unknown endings are left out."""
    roots = roots if roots is not None else source_root(files)
    named = files.join(roots, "graph_id").select("graph_id", "path", module_name(F.col("path"), F.col("root"), F.coalesce("text", F.lit(""))).alias("module"), extension(F.col("path")).alias("ext"), "text")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [PARSERS[e](t or "") for e, t in zip(batch["ext"], batch["text"], strict=True)]
            yield batch[["graph_id", "path", "module"]].assign(imports=[f[0] for f in found], classes=[f[1] for f in found])

    ship_package(files.sparkSession)
    return named.where(F.col("ext").isin(*PARSERS)).mapInPandas(read, f"graph_id string, path string, module string, imports array<string>, classes array<{CLASS}>")


def module_nodes(parsed: DataFrame) -> DataFrame:
    return parsed.select("graph_id", F.col("module").alias("id"), F.lit(True).alias("internal")).distinct()


def module_edges(parsed: DataFrame) -> DataFrame:
    """Imports of other modules; a module's import of itself is left out."""
    return parsed.select("graph_id", F.col("module").alias("src"), F.explode("imports").alias("tgt")).where("src <> tgt").distinct()


def class_methods(parsed: DataFrame, by_name: bool = False) -> DataFrame:
    """graph_id, class, method, attrs, one row per method; a class without methods has one row with nulls.

    Classes are known by file and name; with ``by_name`` by name, where the
    last file in order wins.
    """
    rows = parsed.select("graph_id", "path", F.explode("classes").alias("c"))
    if by_name:
        rows = rows.groupBy("graph_id", F.col("c.name").alias("class")).agg(F.max_by("c", "path").alias("c"))
    else:
        rows = rows.select("graph_id", F.concat_ws(":", "path", "c.name").alias("class"), "c")
    return rows.select("graph_id", "class", F.explode_outer("c.methods").alias("m")).select("graph_id", "class", F.col("m.name").alias("method"), F.col("m.attrs").alias("attrs"))


def file_index(parsed: DataFrame) -> DataFrame:
    """graph_id, alias, path: every suffix of a module's dotted name, to the first file that has it."""
    parts = F.split("module", r"\.")
    aliases = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return parsed.select("graph_id", F.explode(aliases).alias("alias"), "path").groupBy("graph_id", "alias").agg(F.min("path").alias("path"))


def lines_of_code(text: Column) -> Column:
    """Lines that are neither blank nor comments."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#")))
