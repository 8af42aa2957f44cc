"""SQL for DuckDB that gives the rows of the operators that SQL can express, from the same parameters."""

from __future__ import annotations

import math

from plumbline.llm import license_scan as ls
from plumbline.llm import near_duplicates as nd
from plumbline.llm import quality as ql
from plumbline.llm import shingles as sh
from plumbline.llm import suffix_dedup, url_filter


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def license_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places, labels = [], []
    for label, phrase in ls.PHRASES:
        p = ls._tokens(phrase)
        here = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p))
        found = f"[i for i in range(0, greatest(0, len(w) - {len(p) - 1})) if {here}]"
        places.append(found)
        labels.append(f"CASE WHEN len({found}) > 0 THEN '{label}' END")
    rows = []
    for k, (label, body) in enumerate(ls.TEMPLATES):
        t = sorted(set(ls._tokens(body)))
        rows += [f"({k}, '{label}', {len(t)}, {math.ceil(ls.THRESHOLD * len(t) - 1e-9)}, '{w}')" for w in t]
    run = max(len(ls._tokens(body)) for _, body in ls.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{ls.UPPER}', '{ls.LOWER}') AS t FROM documents),
x AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS w FROM d),
p AS (SELECT doc_id, len(w) AS n_words, flatten([{", ".join(places)}]) AS pos, list_filter([{", ".join(labels)}], lambda l: l IS NOT NULL) AS base FROM x),
v AS (SELECT * FROM (VALUES {", ".join(rows)}) AS v(template, label, size, need, word)),
o AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM x),
b AS (SELECT doc_id, label, size, need, count(DISTINCT word) OVER (PARTITION BY doc_id, template ORDER BY i RANGE BETWEEN CURRENT ROW AND {run - 1} FOLLOWING) AS n FROM o JOIN v USING (word)),
hits AS (SELECT doc_id, label, max(n / size) AS c FROM b WHERE n >= need GROUP BY doc_id, label),
m AS (SELECT doc_id, list(label) AS more, max(c) AS most FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(pos) AS BIGINT) AS n_base, CAST(list_min(pos) AS BIGINT) AS first_word, CAST(list_max(pos) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(pos) > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0)::DOUBLE END AS score
FROM p LEFT JOIN m USING (doc_id)"""


def quality_sql() -> str:
    rules, common = ql.QualityRules(), ql.all_common()
    chars, n_char, n_word = [], len(ql.CHARACTER_CLASSES) + 1, len(common) + 1
    left = "t0"
    steps = []
    for k, (_, pattern) in enumerate(ql.CHARACTER_CLASSES):
        sql = pattern.replace("'", "''")
        steps.append(f"t{k + 1} AS (SELECT *, regexp_replace({left}, '{sql}', '', 'g') AS t{k + 1} FROM {f't{k}'})")
        chars.append(f"length(t{k}) - length(t{k + 1})")
        left = f"t{k + 1}"
    chars.append(f"length({left})")
    distance = "CASE WHEN list_sum({h}) > 0 THEN sqrt(greatest(0, list_sum([(CASE WHEN {h}[i] > 0 THEN {h}[i]/list_sum({h})*log2(({h}[i]/list_sum({h}))/(({h}[i]/list_sum({h})+{r}[i])/2)) ELSE 0 END + CASE WHEN {r}[i] > 0 THEN {r}[i]*log2({r}[i]/(({h}[i]/list_sum({h})+{r}[i])/2)) ELSE 0 END)/2 for i in range(1, {n} + 1)]))) ELSE 1 END"
    return f"""
WITH t0 AS (SELECT doc_id, lang, coalesce(text, '') AS t0 FROM documents),
{", ".join(steps)},
w AS (SELECT doc_id, lang, t0, [{", ".join(chars)}] AS c, regexp_extract_all(t0, '[^\\x20\\x09-\\x0D]+') AS w, [x for x in string_split(t0, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM t{len(ql.CHARACTER_CLASSES)}),
g AS (SELECT doc_id, unnest([{{'i': i, 's': w[i:i+2]}} for i in range(1, greatest(1, len(w) - 1))], recursive := true) FROM w),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS x FROM w),
k AS (SELECT doc_id, list_position({_quoted(common)}, x) AS i, count(*) AS n FROM u WHERE list_position({_quoted(common)}, x) > 0 GROUP BY 1, 2),
h AS (SELECT doc_id, map(list(i), list(n)) AS m, sum(n) AS s FROM k GROUP BY 1),
f AS (SELECT w.*, list_append([coalesce(m[i], 0) for i in range(1, {n_word})], len(w) - coalesce(s, 0)) AS v, coalesce(r.n, 0) AS n_repeat FROM w LEFT JOIN h USING (doc_id) LEFT JOIN r USING (doc_id)),
a AS (SELECT lang, count(*) AS n, {", ".join(f"sum(c[{i}]) AS c{i}" for i in range(1, n_char + 1))}, {", ".join(f"sum(v[{i}]) AS v{i}" for i in range(1, n_word + 1))} FROM f GROUP BY 1),
refs AS (SELECT [x / list_sum(cs) for x in cs] AS rc, [x / list_sum(vs) for x in vs] AS rv FROM (SELECT [{", ".join(f"c{i}" for i in range(1, n_char + 1))}] AS cs, [{", ".join(f"v{i}" for i in range(1, n_word + 1))}] AS vs FROM a
  WHERE lang IS NOT NULL AND n >= {rules.min_reference_docs})),
e AS (SELECT doc_id, min({distance.format(h="c", r="rc", n=n_char)}) AS dc, min({distance.format(h="v", r="rv", n=n_word)}) AS dv FROM f, refs GROUP BY doc_id),
q AS (SELECT f.doc_id, len(w) AS n_words, list_sum(c) - c[1] AS word_chars, c[3] AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, n_repeat AS n_repeat_words, dc, dv FROM f JOIN e USING (doc_id)),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM q)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ((word_chars >= {rules.char_guard} AND dc > {rules.max_char_distance}) OR (n_words >= {rules.word_guard} AND dv > {rules.max_word_distance})) AS kept,
  round(dc, 6) AS char_distance, round(dv, 6) AS word_distance
FROM b"""


def near_duplicate_sql() -> str:
    n = sh.WORDS
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9a-z_]|[^\\x00-\\x7F])+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i+least({n}, len(w))-1], ' ') for i in range(1, greatest(1, len(w)-{n}+1) + 1)]) AS s FROM w WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS z FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, n = x.z AND n = y.z AS same FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE n >= {nd.THRESHOLD} * (x.z + y.z - n) - 1e-9),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
r AS (SELECT a, least(a, min(b)) AS class_id FROM c GROUP BY 1),
o AS (SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM l WHERE a = doc_id AND same), doc_id)) AS one FROM documents),
k AS (SELECT a, count(*) AS n_links, count(DISTINCT CASE WHEN NOT same THEN o.one END) AS n_text_links FROM l JOIN o ON o.doc_id = l.b GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links
FROM documents LEFT JOIN r ON r.a = doc_id LEFT JOIN k ON k.a = doc_id"""


def repeats_sql() -> str:
    """Bytes as pairs of hex digits; windows are grouped by their MD5."""
    n = suffix_dedup.LENGTH
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2*p+1, {2 * n})) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h)//2 - {n - 1})) AS p FROM d WHERE length(h) >= {2 * n})),
r AS (SELECT doc_id, p, shared FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n, min(doc_id) OVER (PARTITION BY k) < max(doc_id) OVER (PARTITION BY k) AS shared FROM w) WHERE n > 1),
o AS (SELECT doc_id, sum(least({n}, coalesce(next - p, {n}))) AS n_shared FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next FROM r WHERE shared) GROUP BY doc_id),
g AS (SELECT doc_id, p, sum(CASE WHEN p > before + {n} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + {n} AS b FROM g GROUP BY doc_id, island),
x AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y, a AS z FROM s UNION ALL SELECT doc_id, max(b), NULL FROM s GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2*y+1, CASE WHEN z IS NULL THEN length(h) ELSE 2*(z-y) END), '' ORDER BY y) AS kept FROM x JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT doc_id, length(h)//2 AS n_bytes, (length(h) - length(coalesce(kept, h)))//2 AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)"""


ORACLES = {
    "op2_license_scan": license_sql(),
    "op4_suffix_dedup": repeats_sql(),
    "op6_near_duplicates": near_duplicate_sql(),
    "op7_url_filter": url_filter.ORACLE_SQL,
    "op9_quality": quality_sql(),
}
