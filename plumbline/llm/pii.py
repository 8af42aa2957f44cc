"""Personal data by weak supervision.

1. Loose patterns propose spans in each whole text. Labelers vote on a span:
   the strict pattern of its kind, a check (digits, sums, ranges), a gazetteer
   and the words before it. A vote is +1, -1 or 0 (abstains).
2. Spans with the same kind, votes and context features are one pattern; the
   patterns' counts over all documents are a table bounded by the number of
   vote combinations, not by the documents.
3. Expectation-maximisation over that table estimates each labeler's
   reliability for each kind and the share of true spans.
4. A logistic span classifier over kind, votes and features is trained on the
   estimated labels, weighted by the counts, and decides on every pattern.

Base spans (the strict patterns with their checks) are always kept; the
classifier decides on the others.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import bound_batches, materialize, table

#: Kinds in order; the first four have base spans.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret", "name")
BASE_KINDS = KINDS[:4]
LABELERS = ("shape", "check", "gazetteer", "context")
FEATURES = ("long", "digits", "line_start")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits matches only if the run's first digit does, so the look-behind changes nothing but the time.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Kind, pattern, and strings of which a text that matches has one, in lower case; digits stand for any digit.
LOOSE = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}(?:[ \n]?(?:\(at\)|\[at\]|\{at\})[ \n]?|[ \n]at[ \n])[\w-]{1,63}(?:(?:[ \n]?(?:\(dot\)|\[dot\]|\{dot\})[ \n]?|[ \n]dot[ \n]|\.)[\w-]{2,63}){1,5}(?!\w)", re.I), ("(at)", "[at]", "{at}", " at ", "\nat ", " at\n", "\nat\n")),
    ("phone", re.compile(r"(?<![\w+.-])(?:\(\d{3}\)\s?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])", re.A), ("0",)),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A), ("0",)),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?!\w)", re.A), ("0",)),
    ("secret", re.compile(r"(?<!\w)(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})(?!\w)", re.A), ("akia", "ghp_", "sk-")),
    ("secret", re.compile(r"(?<!\w)(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?([^\s\"']{8,})", re.I), ("password", "passwd", "pwd", "secret", "token", "api")),
    ("name", re.compile(r"(?:(?i:my name is|name:|signed,|contact)|\b(?:Mr|Mrs|Ms|Dr)\.)\s([A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?)"), ("my name is", "name:", "signed,", "contact", "mr.", "mrs.", "ms.", "dr.")),
)
#: What follows the sign of an obfuscated address: cheaper to look for than the whole.
_AT = re.compile(r"(?:[(\[{]at[)\]}]|[ \n]at[ \n])[ \n]?[\w-]{1,63}(?:[ \n]?[(\[{]dot|[ \n]dot[ \n]|\.[\w-])", re.I)

#: The gazetteers.
FIRST_NAMES = frozenset("james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah anna maria peter paul hans julia sofia carlos jean pierre marie claire luis juan ana".split())
DOMAIN_ENDS = frozenset("com org net edu gov io de fr es uk eu info".split())
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
WEAK_SECRETS = frozenset("password changeme example placeholder undefined".split())
CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "server", "host", "address"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "contact"), "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "aws", "credential"), "name": ("name", "mr", "mrs", "ms", "dr", "signed"),
}
#: Words that speak against a kind just before a span.
ANTI_CUES = ("version", "order", "invoice", "page", "isbn", "build", "part")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, leftmost and non-overlapping in each kind; failed checks are dropped."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_DIGIT = re.compile("[0-9]")


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    digit = bool(_DIGIT.search(text))
    lower = text.lower()
    out = set()
    for kind, pattern, hints in LOOSE:
        if not (digit if hints == ("0",) else any(h in lower for h in hints)) or kind == "email" and not _AT.search(text):
            continue
        for m in pattern.finditer(text):
            out.add((m.start(pattern.groups), KINDS.index(kind), m.end(pattern.groups)))
    return sorted(out)


def beyond_base(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap no base span, and the secrets that no base span covers, so that the rest of a credential with an address in it is found."""
    secret = KINDS.index("secret")
    starts, ends = [b[0] for b in base], list(itertools.accumulate((b[2] for b in base), max))  # ends: the largest so far
    out = []
    for s in spans:
        near = base[bisect.bisect_right(ends, s[0]) : bisect.bisect_left(starts, s[2])]
        if not any(s[0] < b[2] and not (s[1] == secret and (s[0] < b[0] or b[2] < s[2])) for b in near):
            out.append(s)
    return out


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes, then the features, of one span."""
    span = text[start:end]
    before = text[max(0, start - 40) : start].lower()
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        shape = 1 if base else 0
        end_ = re.split(r"[^a-z0-9]+", span.lower())[-1]
        check = 1 if len(span) <= 254 and ".." not in span else -1
        gazetteer = 1 if end_ in DOMAIN_ENDS else -1
    elif kind == "ip":
        shape, check, gazetteer = 1, (1 if all(p == "0" or not p.startswith("0") for p in span.split(".")) else -1), (-1 if span.startswith(("0.", "127.", "255.")) else 0)
    elif kind == "card":
        shape, check, gazetteer = 1, (1 if luhn(digits) else -1), (1 if digits[0] in "3456" else -1)
    elif kind == "phone":
        shape, check, gazetteer = (1 if base else 0), (1 if 10 <= len(digits) <= 15 else -1), (1 if base or digits[0] not in "01" else -1)
    elif kind == "ssn":
        shape, check, gazetteer = 1, (1 if span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000" else -1), 0
    elif kind == "iban":
        plain = re.sub(r"\s", "", span)
        shape, gazetteer = 0, (1 if plain[:2] in IBAN_COUNTRIES else -1)
        check = 1 if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    elif kind == "secret":
        mixed = bool(digits) and any(c.isalpha() for c in span)
        shape, check, gazetteer = (1 if span.startswith(("AKIA", "ghp_", "sk-")) else 0), (1 if mixed and len(set(span)) >= 6 else -1), (-1 if span.lower() in WEAK_SECRETS else 0)
    else:
        first = span.split()[0].lower()
        shape, check, gazetteer = (1 if " " in span else 0), 0, (1 if first in FIRST_NAMES else -1)
    words = re.findall(r"[a-z]+", before)[-4:]
    context = 1 if any(w.startswith(CUES[kind]) for w in words) else -1 if any(w in ANTI_CUES for w in words) else 0
    return shape, check, gazetteer, context, int(len(span) > 24), int(2 * len(digits) > len(span)), int(start == 0 or text[start - 1] == "\n")


def propose(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and all proposed spans, each with its kind, whether it is base, and its pattern."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                more = beyond_base(loose_spans(t), base)
                found = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                rows.append([{"start": s, "kind": k, "end": e, "base": b, "pattern": ",".join(map(str, (k, *votes(t, KINDS[k], s, e, b))))} for s, k, e, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "found"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(find, f"doc_id {kind}, found array<struct<start:long,kind:int,end:long,base:boolean,pattern:string>>")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probability that a span of each pattern is true, and the reliabilities [kind, labeler, truth, vote].

    patterns: rows of kind and the labelers' votes. The start trusts each
    labeler by 0.8; Dirichlet weights keep rare kinds near that.
    """
    kinds, m = len(KINDS), len(LABELERS)
    start = np.array([[0.35, 0.45, 0.2], [0.1, 0.4, 0.5]])  # false and true spans: -1, 0, +1
    theta = np.broadcast_to(start, (kinds, m, 2, 3)).copy()
    prior = np.full(kinds, 0.7)
    kind, vote = patterns[:, 0], patterns[:, 1 : 1 + m] + 1
    p = np.zeros(len(patterns))
    for _ in range(rounds):
        logs = np.log(np.stack([1 - prior[kind], prior[kind]], axis=1))
        for j in range(m):
            logs += np.log(theta[kind, j, :, vote[:, j]])
        p = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        for k in range(kinds):
            at = kind == k
            n = counts[at]
            prior[k] = (n @ p[at] + 7) / (n.sum() + 10)
            for j in range(m):
                for truth, w in ((0, n * (1 - p[at])), (1, n * p[at])):
                    got = np.bincount(vote[at, j], w, 3) + 20 * start[truth]
                    theta[k, j, truth] = got / got.sum()
    return p, theta


def classifier_features(patterns: np.ndarray) -> np.ndarray:
    kind = np.eye(len(KINDS))[patterns[:, 0]]
    return np.hstack([kind, patterns[:, 1:].astype(float)])


def fit_classifier(patterns: np.ndarray, counts: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    x = classifier_features(patterns)
    w = np.zeros(x.shape[1])
    n = counts / counts.sum() * min(counts.sum(), 1e6)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - q)) - ridge * w
        hessian = (x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(found: DataFrame) -> dict[str, float]:
    """Probability of every pattern, by EM and the classifier, from the patterns' counts over all documents."""
    rows = found.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count().orderBy("pattern").collect()
    if not rows:
        return {}
    patterns = np.array([[int(v) for v in r[0].split(",")] for r in rows])
    counts = np.array([r[1] for r in rows], dtype=float)
    p, _ = estimate(patterns, counts)
    w = fit_classifier(patterns, counts, p)
    q = 1 / (1 + np.exp(-np.clip(classifier_features(patterns) @ w, -30, 30)))
    return {r[0]: float(v) for r, v in zip(rows, q, strict=True)}


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id and spans: array of (start, kind, end, base, score), in order of start, then kind.

    Offsets are code points, ends exclusive. Null and empty texts have no
    spans; equal rows give equal rows; an empty table gives an empty result.
    Base spans always stay, with the classifier's score; others stay from
    ``threshold`` on.
    """
    found = materialize(propose(docs, doc_id, text))
    known = learn(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])
        for batch in batches:
            rows = [[{"start": s["start"], "kind": KINDS[s["kind"]], "end": s["end"], "base": s["base"], "score": known[s["pattern"]]} for s in spans if s["base"] or known[s["pattern"]] >= threshold] for spans in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return found.mapInArrow(decide, f"doc_id {kind}, spans array<struct<start:long,kind:string,end:long,base:boolean,score:double>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def mask(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with each found span in the text replaced by its kind in brackets; overlapping spans become one.

    The patterns are learned from all of ``docs``; each text is then searched
    again, so no text is shuffled. Null texts stay null.
    """
    spark = docs.sparkSession
    known = learn(materialize(propose(docs, doc_id, text), spark))
    bound_batches(spark)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask_text(t, known, threshold), na_action="ignore")

    return docs.withColumn(text, masked(F.col(text)))


def mask_text(text: str, known: dict[str, float], threshold: float) -> str:
    base = base_spans(text)
    spans = [s for s in base]
    for s, k, e in beyond_base(loose_spans(text), base):
        pattern = ",".join(map(str, (k, *votes(text, KINDS[k], s, e, False))))
        if known.get(pattern, 0.0) >= threshold:
            spans.append((s, k, e))
    out, done = [], 0
    for s, k, e in sorted(spans):
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    out.append(text[done:])
    return "".join(out)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return spans.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
