"""Findings of the second round on operators for training data."""

import json

from plumbline.llm import html_extract as he
from plumbline.llm import suffix_dedup as sd


def pages():
    """Pages of one host, each with its article in an element of its own name, and a notice and a list of links that all share."""
    links = "".join(f"<li><a href=/{i}>somewhere else</a></li>" for i in range(3))
    # From the end of the first half on, a rare block that stands on every 150th page.
    return [f"<body><div class=q0>{links}</div><div class=r{i}><p>Story {i} {'of a long day ' * 12}</p></div><div class=q1>Our rules hold here</div>{'<h6 class=z>rare</h6>' if i % 150 == 7 else ''}</body>" for i in range(1200)]


def test_terms_that_leave_a_wrapper_count(spark):
    """Every term's pages and characters are in the wrapper in the end, also those beyond the number of terms that it keeps while it grows."""
    html = pages()
    df = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in enumerate(html)], "page_id long, url string, html string").repartition(3)
    (row,) = he.infer_wrappers(df).collect()
    terms = json.loads(row["wrapper"])
    expected = {}
    for p in html:
        for t in he.page_wrapper(he.blocks_of(p)):
            e = expected.setdefault(t[0], [0, 0, 0])
            e[:] = [e[0] + t[4], e[1] + t[6], e[2] + t[7]]
    found = {}
    for t in terms:
        e = found.setdefault(t[0], [0, 0, 0])
        e[:] = [e[0] + t[4] + t[5], e[1] + t[6], e[2] + t[7]]
    assert row["pages"] == len(html) and len(expected) > he.WRAPPER_TERMS and found == expected
    said = he.decide(terms, row["pages"])
    assert he.stamp("body>div.q1", "Our rules hold here") in said["constant"]
    texts = {r["page_id"]: r["text"] for r in he.extract(df).collect()}
    assert all(f"Story {k} of" in texts[k] and "rules" not in texts[k] for k in range(len(html)))


def test_sums_go_to_the_live_term_of_their_text():
    live = [["a", False, True, "x", 100, 7, 100, 0], ["b", False, False, None, 50, 0, 1000, 5]]
    rest = [{"name": "a", "stamp": he.stamp("a", "x"), "repeated": False, "had": 60, "chars": 60, "linked": 0}, {"name": "a", "stamp": None, "repeated": False, "had": 9, "chars": 30, "linked": 2}, {"name": "b", "stamp": None, "repeated": True, "had": 3, "chars": 4, "linked": 1}]
    whole = he.whole_wrapper(live, rest)
    assert whole == [["a", False, True, "x", 160, 0, 160, 0], ["b", False, False, None, 53, 0, 1004, 6], ["a", False, True, None, 9, 0, 30, 2]]
    assert he.decide(whole, 200)["constant"] == [he.stamp("a", "x")]


def test_contexts_are_shuffled_once(spark, monkeypatch):
    """The texts of contexts are not shuffled to find those of frequent anchors, whatever the threshold of automatic broadcasts."""
    plans, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name in ("sort_contexts", "count_windows"):
        f = getattr(sd, name)
        monkeypatch.setattr(sd, name, lambda bodies, f=f: plans.append(bodies._jdf.queryExecution().executedPlan().toString()) or f(bodies))
    shared = "".join(chr(97 + i * i % 23) for i in range(300))
    texts = [f"{k} {'xyz' * k} {shared} end of {k}" for k in range(6)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r["doc_id"]: r["n_removed"] for r in sd.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(found[k] >= 300 for k in range(6))
    assert len(plans) == 2 and not any("SortMergeJoin" in p or "hashpartitioning" in p for p in plans)
