"""Main text of HTML pages with wrappers inferred per host.

A page is a stream of text blocks, each with its path of elements. Per host
the streams are aligned into a union-free regular expression, the wrapper:
repeated runs of blocks fold into groups, blocks that only some pages have
become optional, and blocks whose texts differ become text slots. Terms count
their pages and the characters of their texts, linked ones apart.

The wrapper decides what is taken from its host's pages. What stays constant
outside of slots and groups is template. The article is the element that holds
most of the slots' plain text: from the root on, the step goes to the child
with ``MOST`` of it. Names (article, main, "content") lower that bar and words
of a class ("ad", "comments") strike a part out, unless the wrapper shows that
nearly all plain text of the host stands in it. A page without its host's
article, of another layout, is its own wrapper. Without a wrapper there is no
text.

Inference is a fold in each task and then a tree of merges by (host, task
range), so a host with a third of all pages never meets in one task. What the
wrappers decide is then joined to the pages by host.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import bound_batches, broadcast_if_small, materialize, table
from plumbline.llm.url_filter import host_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|select|iframe|object|title|math|xmp)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?[a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?"
    r"|<[!?/][^>]*+>?"
    r"|([^<]++|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)

#: Kinds of elements and the words in class, id and role that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("nav aside footer form button dialog menu head label input fieldset audio video canvas map search".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead header footer comment comments commentlist respond reply replies discussion disqus related recommended recommendations share sharing social widget toolbar pagination pager paywall".split()
)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
MAIN_WORDS = frozenset("content article post entry story".split())
#: Elements that an opening tag closes first, up to the given limit.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: A template block stands on at least this share of a host's pages, and these pages are so many at least.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 5
#: Share of the slots' plain text that a step towards the article keeps at least; with a name like article or content.
MOST, NAMED = 0.7, 0.2
#: Beyond so many terms optional ones that are surely on less than one page in RARE leave the wrapper; they are summed beside it and come back at the end.
WRAPPER_TERMS, RARE = 400, 200
MERGE = 64
#: Names that no caller's column has.
HOST, SAID = "_wrapper_of_host_", "_said_by_wrapper_"
#: Longer element paths go on as a digest, so that each still has its own.
PATH = 400


@dataclass
class Block:
    path: str  # labels joined by ">"; ~ before the path of boilerplate elements, ! before a label with boilerplate words, * before one with content words
    text: str
    linked: int


def _mark(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Label, whether the element is boilerplate by its kind, and whether its words mark it."""
    words: list[str] = []
    first, role, hidden = "", "", False
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name in ("class", "id"):
                words += re.split(r"[^a-z0-9]+", value)
                first = first or re.sub("[>~!*\\s].*", "", value.strip(), flags=re.S)
            elif name == "role":
                role = value
            else:
                hidden = hidden or name == "hidden" or value == "true"
    marked = not SKIP_WORDS.isdisjoint(words) and tag not in ("html", "body", "main")
    named = tag in ("article", "main") or role == "main" or tag in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(words)
    label = f"{tag}.{first}" if first else tag
    return ("!" if marked else "*" if named else "") + label, tag in SKIP or role in SKIP_ROLES or hidden, marked


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order with their element paths; scripts, styles and comments have none.

    Unclosed and wrongly nested elements end where their parent ends; a page
    that is cut off ends all of them.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, bool, int, bool]] = []  # tag, path, boilerplate, marked elements, in an article
    parts: list[str] = []
    linked = depth_a = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path, boilerplate = stack[-1][1:3] if stack else ("", False)
                out.append(Block(f"~{path}" if boilerplate else path, text, linked))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal depth_a
        while len(stack) > to:
            if stack[-1][0] == "a":
                depth_a -= 1
            if stack[-1][0] in BLOCK or stack[-1][2:4] != (stack[-2][2:4] if len(stack) > 1 else (False, 0)):
                flush()
            stack.pop()

    for m in TOKEN.finditer(page):
        tag, text = m[2], m[4]
        if text is not None:
            parts.append(html.unescape(text) if "&" in text else text)
            if depth_a:
                linked += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag[0] == "/":
            tag = tag[1:]
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if at >= 0 and not (tag not in BLOCK and any(x[0] in BLOCK for x in stack[at + 1 :])):
                pop(at)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in BLOCK:
            flush()
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK or stack[i][0] == "a"), -1)
            if at >= 0 and stack[at][0] == "p":
                pop(at)
            if tag in CLOSES:
                ends, limit = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in limit:
                        break
                    if stack[i][0] in ends:
                        pop(i)
                        break
        if tag in VOID:
            continue
        label, boilerplate, marked = _mark(tag, m[3])
        path, above, marks, inside = stack[-1][1:] if stack else ("", False, 0, False)
        boilerplate = boilerplate or above or (tag == "header" and not inside)
        if marked or boilerplate and not above:
            flush()
        if tag == "a":
            depth_a += 1
        if tag in BLOCK or marked:
            path = f"{path}>{label}" if path else label
            if len(path) > PATH:
                path = f"{path[: PATH - 40]}>{hashlib.blake2b(path.encode(), digest_size=8).hexdigest()}{'!' if marked else ''}"
        stack.append((tag, path, boilerplate, marks + marked, inside or tag == "article"))
    flush()
    return out


# --- wrappers -------------------------------------------------------------------------------------------------------------
# A term: [signature, repeated, optional, text or None for a slot, pages that have it, pages that may stand beside the wrapper, characters, linked ones].
# A text that stands beside the wrapper is known by its stamp: {"stamp": ...}.


def stamp(path: str, text: str) -> str:
    return hashlib.blake2b(f"{path}\n{text}".encode(), digest_size=12).hexdigest()


def fold(paths: list[str]) -> list[tuple[str, int, int]]:
    """Fold tandem repeats of one to four terms into groups: (signature, first block, blocks)."""
    terms = [(p, i, 1) for i, p in enumerate(paths)]
    for width in (1, 2, 3, 4):
        out: list[tuple[str, int, int]] = []
        i = 0
        while i < len(terms):
            unit = [t[0] for t in terms[i : i + width]]
            j = i + width
            while len(unit) == width and [t[0] for t in terms[j : j + width]] == unit:
                j += width
            if j > i + width:
                name = unit[0] if width == 1 else f"({' '.join(unit)})"
                out.append((name if name.endswith("+") else name + "+", terms[i][1], sum(t[2] for t in terms[i:j])))
                i = j
            else:
                out.append(terms[i])
                i += 1
        terms = out
    return terms


def page_wrapper(blocks: list[Block]) -> list[list]:
    out = []
    for name, at, n in fold([b.path for b in blocks]):
        repeated = name.endswith("+")
        run = blocks[at : at + n]
        out.append([name.removesuffix("+"), repeated, False, None if repeated or n > 1 else blocks[at].text, 1, 0, sum(len(b.text) for b in run), sum(min(b.linked, len(b.text)) for b in run)])
    return out


def align(a: list[list], n_a: int, b: list[list], n_b: int, rest: list[list] | None = None) -> list[list]:
    """Wrapper of both: common terms in order, slots where texts differ, all other terms optional. Terms that leave it are added to ``rest``."""
    keys_a, keys_b = [t[0] for t in a], [t[0] for t in b]
    pairs = [("equal", 0, len(a), 0, len(b))] if keys_a == keys_b else SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes()
    out = []
    for what, i, j, k, m in pairs:
        if what == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                repeated = x[1] or y[1]
                out.append([x[0], repeated, x[2] or y[2], x[3] if not repeated and x[3] == y[3] else None, *(x[q] + y[q] for q in range(4, 8))])
        else:
            # The term may have left the other side: at most one page in RARE.
            out += [[t[0], t[1], True, t[3], t[4], t[5] + n_b // RARE, *t[6:]] for t in a[i:j]]
            out += [[t[0], t[1], True, t[3], t[4], t[5] + n_a // RARE, *t[6:]] for t in b[k:m]]
    n = n_a + n_b
    if len(out) > WRAPPER_TERMS:
        stays = [not t[2] or t[4] + t[5] > n // RARE for t in out]
        if rest is not None:
            rest += [t for t, s in zip(out, stays, strict=True) if not s]
        out = [t for t, s in zip(out, stays, strict=True) if s]
    return out


def _stamped(term: list) -> str | None:
    """Stamp of a term's text; None for a slot."""
    if term[3] is None or isinstance(term[3], dict):
        return term[3] and term[3]["stamp"]
    return stamp(_paths(term)[0], term[3])


def whole_wrapper(terms: list[list], rest: list[dict]) -> list[list]:
    """The wrapper with the sums of the terms that left it, each added to the live term of its text (or slot) or as one of its own; counts are exact."""
    out = [[*t[:5], 0, *t[6:]] for t in terms]
    live: dict[tuple, list] = {}
    for t in out:
        live.setdefault((t[0], _stamped(t)), t)
    for r in rest:
        t = live.get((r["name"], r["stamp"]))
        if t is None:
            t = [r["name"], r["repeated"], True, r["stamp"] and {"stamp": r["stamp"]}, 0, 0, 0, 0]
            live[r["name"], r["stamp"]] = t
            out.append(t)
        for k, x in ((4, "had"), (6, "chars"), (7, "linked")):
            t[k] += r[x]
    return out


def expression(terms: list[list]) -> str:
    """The wrapper as a union-free regular expression over block paths; # is a text slot."""
    return " ".join(f"({t[0]}{'' if t[3] is not None else ' #'}){'+' if t[1] else ''}{'?' if t[2] else ''}" for t in terms)


def _paths(term: list) -> list[str]:
    """Element paths of a term: of each block in its group."""
    return [p.rstrip("+") for p in re.sub(r"[()]", " ", term[0]).split()] or [""]


def _above(path: str) -> list[str]:
    """The element of a path's text and those around it, from the root on."""
    parts = path.split(">")
    return [">".join(parts[:i]) for i in range(1, len(parts) + 1)] if path else []


def _marked(path: str, cleared: frozenset[str]) -> bool:
    return "!" in path and any(("!" in x.rsplit(">", 1)[-1]) and x not in cleared for x in _above(path))


def decide(terms: list[list], pages: int) -> dict[str, list[str]]:
    """What the wrapper says: constant (stamps of template blocks), cleared (marked elements that hold the host's text) and regions (paths of the article).

    Pages without varying text, copies of one another, show no template; nor
    do fewer than TEMPLATE_PAGES.
    """
    plain = [(t, _paths(t)) for t in terms if not t[0].lstrip("(").startswith("~")]
    fixed = [pages >= TEMPLATE_PAGES and t[3] is not None and not t[1] and t[4] + t[5] >= TEMPLATE_SHARE * pages for t, _ in plain]

    def weigh(cleared: frozenset[str]) -> list[tuple[list, list[str], bool, int]]:
        return [(t, ps, f, max(0, t[6] - 2 * t[7])) for (t, ps), f in zip(plain, fixed, strict=True) if not _marked(ps[0], cleared)]

    cleared: frozenset[str] = frozenset()
    alive = weigh(cleared)
    if pages >= TEMPLATE_PAGES and not any("*" in ps[0] for _, ps, _, _ in alive):
        mass: dict[str, int] = defaultdict(int)
        for t, ps in plain:
            for x in _above(ps[0]):
                if "!" in x.rsplit(">", 1)[-1]:
                    mass[x] += max(0, t[6] - 2 * t[7])
        whole = sum(max(0, t[6] - 2 * t[7]) for t, _ in plain)
        cleared = frozenset(x for x, m in mass.items() if m >= 0.9 * whole > 0)
        alive = weigh(cleared)
    slots = [(ps, w) for _, ps, f, w in alive if not f and w]
    if not any("*" in ps[0] for ps, _ in slots) and sum(w for _, w in slots) <= sum(w for _, _, f, w in alive if f):
        alive = [(t, ps, False, w) for t, ps, f, w in alive]
    constant = [_stamped(t) for t, _, f, _ in alive if f]

    holds: dict[str, int] = defaultdict(int)
    for _, ps, f, w in alive:
        if not f:
            for p in ps:
                for x in _above(p)[:-1]:
                    holds[x] += w // len(ps)
    region, also = "", []
    left = sum(w for _, _, f, w in alive if not f)
    while left and not re.fullmatch(r"\*article\b.*", region.rsplit(">", 1)[-1]):
        depth = region.count(">") + 1 if region else 0
        within = [x for x in holds if x.count(">") == depth and (not region or x.startswith(f"{region}>"))]
        named = [x for x in within if x.rsplit(">", 1)[-1].startswith("*") and (holds[x] >= NAMED * left or x.endswith("*article"))]
        most = [x for x in within if holds[x] >= MOST * left and not region.rsplit(">", 1)[-1].startswith("*")]
        step = max(named or most, key=lambda x: (holds[x], x), default=None)
        if step is None:
            break
        for _, ps, f, _ in alive:  # varying headings beside the step belong to it
            also += [p for p in ps if not f and p.rpartition(">")[0] == region and re.fullmatch(r"h[1-6]\b.*", p.rsplit(">", 1)[-1])]
        region, left = step, holds[step]
    return {"constant": constant, "cleared": sorted(cleared), "regions": [region, *sorted(set(also))]}


REST = "array<struct<name:string,repeated:boolean,stamp:string,had:long,chars:long,linked:long>>"


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, pages, wrapper (JSON terms): one row per host.

    Rows with 0 pages carry what left the wrappers; by host, signature and
    text these are summed over the cluster. A text keeps its own term where
    the wrapper has it too or enough pages do; others are slots.
    """
    spark = pages.sparkSession
    bound_batches(spark, 200)

    def beside(rest: dict[str, list[list]]) -> list[tuple[str, int, str]]:
        out = []
        for host, terms in rest.items():
            sums: dict[tuple, list] = {}
            for t in terms:
                x = sums.setdefault((t[0], _stamped(t)), [False, 0, 0, 0])
                x[:] = [x[0] or t[1], x[1] + t[4], x[2] + t[6], x[3] + t[7]]
            if sums:
                out.append((host, 0, json.dumps([dict(zip(("name", "stamp", "repeated", "had", "chars", "linked"), (*k, *x), strict=True)) for k, x in sums.items()])))
        return out

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        found: dict[str, list] = {}
        rest: dict[str, list[list]] = defaultdict(list)

        def rows(data: list[tuple[str, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in data], pa.string()), pa.array([task] * len(data), pa.int32()), pa.array([r[1] for r in data], pa.int64()), pa.array([r[2] for r in data], pa.string())], names=["host", "task", "pages", "wrapper"])

        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = page_wrapper(blocks_of(text or ""))
                if host in found:
                    n, old = found[host]
                    found[host] = [n + 1, align(old, n, new, 1, rest[host])]
                else:
                    found[host] = [1, new]
            if len(found) > 1000:
                yield rows([(h, w[0], json.dumps(w[1])) for h, w in found.items()])
                found.clear()
            if sum(map(len, rest.values())) > 10 * WRAPPER_TERMS:
                yield rows(beside(rest))
                rest.clear()
        if found:
            yield rows([(h, w[0], json.dumps(w[1])) for h, w in found.items()])
        yield rows(beside(rest))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        n, terms = 0, []
        rest: list[list] = []
        for m, w in sorted(zip(group["pages"], group["wrapper"], strict=True), key=lambda x: (-x[0], x[1])):
            terms = align(terms, n, json.loads(w), m, rest) if n else json.loads(w)
            n += m
        host = group["host"].iloc[0]
        return pd.DataFrame([(host, int(group["task"].iloc[0]) // MERGE, k, w) for host, k, w in [(host, n, json.dumps(terms)), *beside({host: rest})]], columns=["host", "task", "pages", "wrapper"])

    schema = "host string, task int, pages long, wrapper string"
    source = pages.select(host_of(F.col(url)).alias("host"), F.col(page))
    out = materialize(source.mapInArrow(infer, schema), spark)
    rest = out.where("pages = 0")
    left = source.rdd.getNumPartitions()
    while True:
        out = materialize(out.where("pages > 0").groupBy("host", F.floor(F.col("task") / MERGE).alias("_")).applyInPandas(merge, schema), spark)
        rest = rest.union(out.where("pages = 0"))
        left = -(-left // MERGE)
        if left <= 1:
            break
    known = out.where("pages > 0").drop("task")

    @F.pandas_udf("array<struct<name:string,stamp:string>>")
    def texts_of(wrappers: pd.Series) -> pd.Series:
        return pd.Series([[{"name": t[0], "stamp": _stamped(t)} for t in json.loads(w) if t[3] is not None] for w in wrappers])

    @F.pandas_udf("string")
    def completed(wrappers: pd.Series, rests: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(whole_wrapper(json.loads(w), json.loads(r) if r is not None else [])) for w, r in zip(wrappers, rests, strict=True)])

    sums = rest.select("host", F.explode(F.from_json("wrapper", REST)).alias("r")).select("host", "r.*")
    sums = sums.groupBy("host", "name", "stamp").agg(F.max("repeated").alias("repeated"), *[F.sum(c).alias(c) for c in ("had", "chars", "linked")])
    live = known.join(sums.select("host").distinct(), "host", "left_semi").select("host", F.explode(texts_of("wrapper")).alias("t")).select("host", "t.name", "t.stamp").distinct().withColumn("live", F.lit(True))
    sums = sums.join(live, ["host", "name", "stamp"], "left").join(known.select("host", "pages"), "host")
    text = F.when(F.coalesce("live", F.lit(False)) | (F.col("had") >= TEMPLATE_SHARE * F.col("pages")), F.col("stamp"))
    sums = sums.withColumn("stamp", text).groupBy("host", "name", "stamp").agg(F.max("repeated").alias("repeated"), *[F.sum(c).alias(c) for c in ("had", "chars", "linked")])
    names = ("name", "stamp", "repeated", "had", "chars", "linked")
    lists = sums.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*names))), {"ignoreNullFields": "false"}).alias("rest"))
    return known.join(lists, "host", "left").select("host", "pages", completed("wrapper", "rest").alias("wrapper"))


def _within(path: str, regions: list[str]) -> bool:
    return not regions[0] or any(path == r or path.startswith(f"{r}>") for r in regions)


def main_text(page: str, wrapper: dict[str, list[str]] | None = None) -> str:
    """The article's text by what ``decide`` says of the host's wrapper, or by the page as its own wrapper where it has none of the regions."""
    blocks = blocks_of(page)
    own = wrapper is None
    while True:
        said = decide(page_wrapper(blocks), 1) if own else wrapper
        cleared, constant = frozenset(said["cleared"]), frozenset(said["constant"])
        kept = [b for b in blocks if not b.path.startswith("~") and not _marked(b.path, cleared) and _within(b.path, said["regions"])]
        if kept or own:
            break
        own = True
    if not said["regions"][0].rsplit(">", 1)[-1].startswith("*"):
        kept = [b for b in kept if 2 * b.linked <= len(b.text)]
    return "\n\n".join(b.text for b in kept if not constant or stamp(b.path, b.text) not in constant)


def extract(pages: DataFrame, url: str = "url", page: str = "html", wrappers: DataFrame | None = None) -> DataFrame:
    """``pages`` without the html, with host, text and n_chars (code points).

    Null and empty pages give an empty text; a null URL belongs to the host
    with the empty name; repeated rows stay; columns named host, text or
    n_chars are replaced. Pages are never cut, whatever their length.
    """
    known = wrappers if wrappers is not None else materialize(infer_wrappers(pages, url, page))

    @F.pandas_udf("string")
    def said(terms: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(decide(json.loads(t), k)) for t, k in zip(terms, n, strict=True)])

    decided = materialize(known.select(F.col("host").alias(HOST), said("wrapper", "pages").alias(SAID)), pages.sparkSession)

    @F.pandas_udf("string")
    def texts(htmls: pd.Series, decisions: pd.Series) -> pd.Series:
        return pd.Series([main_text(h or "", json.loads(d)) if d is not None else "" for h, d in zip(htmls, decisions, strict=True)])

    drop = [c for c in ("host", "text", "n_chars") if c not in (url, page)]
    out = pages.drop(*drop).withColumn("host", host_of(F.col(url)))
    out = out.join(broadcast_if_small(decided, 4 << 20), F.col("host") == F.col(HOST), "left")
    out = out.withColumn("text", texts(F.col(page), F.col(SAID))).drop(page, HOST, SAID)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
