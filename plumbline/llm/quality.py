"""Quality rules: counts of a text and the divergence of its histograms from language references.

A document's character classes and common words are compared with those of
each language by the Jensen-Shannon distance (square root of the base-2
divergence, 0 to 1). The references are sums over all documents of a language,
so they need one aggregation with a row per language, and go to the documents
as one broadcast row. Everything is a chain of
built-in functions within a row: no document row is ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, let, materialize, table

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"

#: Function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for on with as was by this be are or it an at from not he".split(),
    "de": "der die und das den zu von mit ist dem des auf für nicht ein eine im sich auch als".split(),
    "fr": "le la les de des et en un une du est que dans qui pour pas sur par au avec".split(),
    "es": "el la de que y en un una los las del se por con para es no su al lo".split(),
}
#: Character classes in the order in which they are taken from a text; the last class is the rest.
CHARACTER_CLASSES = (
    ("space", r"[\x20\x09-\x0D]+"),
    ("lower", r"[a-z]+"),
    ("symbol", SYMBOLS),
    ("upper", r"[A-Z]+"),
    ("letter", r"[\p{L}\p{M}]+"),
    ("digit", r"[0-9]+"),
    ("stop", r"[.,;:?'\"()-]+"),
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; the guards keep short texts, whose histograms say little, from the distance tests."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A language needs so many labelled documents to be a reference.
    min_reference_docs: int = 20
    char_guard: int = 200
    word_guard: int = 100
    max_char_distance: float = 0.30
    max_word_distance: float = 0.45


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK, -1), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more."""
    def marked(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = let(by_hash, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )))
        # A window covers three words, or as many as there are before the next marked window.
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x,
        ))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(
        let(hashed(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))
    ).cast("long")


def _class_counts(text: Column) -> Column:
    """Array of character counts: each class is removed in turn, so that later patterns see less text."""
    def step(left: Column, classes: tuple, counts: list[Column]) -> Column:
        if not classes:
            return F.array(*counts, F.length(left).cast("long"))
        return let(F.regexp_replace(left, classes[0][1], ""), lambda rest: step(rest, classes[1:], [*counts, (F.length(left) - F.length(rest)).cast("long")]))

    return step(text, CHARACTER_CLASSES, [])


def _common_counts(words: Column, common: list[str]) -> Column:
    """Array with the count of each common word, then that of all other words.

    The found words become sorted numbers; with one extra of each number, the
    first place of k + 1 less that of k is the count of k, plus one.
    """
    n = len(common)
    numbers = F.transform(F.filter(words, lambda w: w.isin(*common)), lambda w: F.array_position(F.array(*[F.lit(c) for c in common]), w).cast("int"))
    with_all = F.sort_array(F.concat(numbers, F.array(*[F.lit(k) for k in range(1, n + 2)])))
    return let(with_all, lambda s: let(
        F.array(*[F.array_position(s, F.lit(k)) for k in range(1, n + 2)]),
        lambda p: F.concat(F.array(*[F.get(p, F.lit(k + 1)) - F.get(p, F.lit(k)) - 1 for k in range(n)]), F.array(F.size(words) - F.size(s) + n + 1).cast("array<bigint>")),
    ))


def quality_features(docs: DataFrame, text: str = "text", common: list[str] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms.

    A null text has no words and no lines. Whole texts are read, whatever
    their length. Input columns of these names are replaced.
    """
    common = common or all_common()
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    classes = [c for c, _ in CHARACTER_CLASSES]
    made = let(_words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeat_words(w).alias("n_repeat_words"),
        _common_counts(w, common).alias("word_hist"),
    ))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_hist", "word_hist"]
    out = docs.drop(*[c for c in names if c != text])
    words = fresh("_words", docs)
    out = out.withColumns({
        words: made,
        "char_hist": _class_counts(t),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    return out.withColumns({
        "n_words": F.col(f"{words}.n_words"),
        "n_repeat_words": F.col(f"{words}.n_repeat_words"),
        "word_hist": F.col(f"{words}.word_hist"),
        "n_symbols": F.get("char_hist", F.lit(classes.index("symbol"))),
        "word_chars": F.aggregate("char_hist", F.lit(0).cast("long"), lambda a, x: a + x) - F.get("char_hist", F.lit(classes.index("space"))),
    }).drop(words)


def all_common() -> list[str]:
    return list(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))


def language_references(features: DataFrame, lang: str = "lang", min_docs: int = 20) -> DataFrame:
    """lang, c and w: shares of character classes and common words of each language, over all labelled documents.

    Languages below ``min_docs`` documents give no reference, whatever their share.
    """
    n_char, n_word = len(CHARACTER_CLASSES) + 1, len(all_common()) + 1
    sums = features.groupBy(F.col(lang).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.get("char_hist", F.lit(k))) for k in range(n_char)]).alias("c"),
        F.array(*[F.sum(F.get("word_hist", F.lit(k))) for k in range(n_word)]).alias("w"),
    ).where(F.col("lang").isNotNull() & (F.col("n") >= min_docs))
    share = lambda x: let(F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v), lambda n: F.transform(x, lambda v: v / F.greatest(F.lit(1), n)))
    return sums.select("lang", share(F.col("c")).alias("c"), share(F.col("w")).alias("w"))


def js_distance(counts: Column, reference: list[float] | Column) -> Column:
    """Jensen-Shannon distance of a count array from fixed shares or an array of them; 1 if there is nothing to compare."""
    ref = reference if isinstance(reference, Column) else F.array(*[F.lit(float(x)) for x in reference])
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    return let(total, lambda n: F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(
        F.zip_with(counts, ref, lambda x, q: let(x / n, lambda p: let((p + q) / 2, lambda m: (part(p, m) + part(q, m)) / 2))),
        F.lit(0.0), lambda a, x: a + x,
    )))).otherwise(1.0))


def judge_quality(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang", references: dict | None = None, keep_text: bool = False) -> DataFrame:
    """Adds the counts, base_failed, the distances to the nearest reference and kept.

    The texts are read once: their features, without the texts, are written to
    the shared folder, then give the references and the distances. With
    ``keep_text`` the text column stays and the texts are read twice.

    base_failed: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of the words in repeated windows. Else a text is
    kept unless a distance to every language exceeds its limit; the character
    test needs ``char_guard`` characters and the word test ``word_guard``
    words. Without references (empty table) only the base rule decides.
    """
    features = quality_features(docs, text)
    features = features if keep_text else materialize(features.drop(text))
    if references is not None:
        refs = docs.sparkSession.createDataFrame([(k, *map(list, references[k])) for k in sorted(references)], "lang string, c array<double>, w array<double>")
    else:
        refs = language_references(features, lang, rules.min_reference_docs)
    # An aggregation without keys: one row, also of no languages.
    c, w = fresh("_c", features), fresh("_w", features)
    features = features.crossJoin(F.broadcast(refs.agg(F.collect_list("c").alias(c), F.collect_list("w").alias(w))))

    def nearest(hist: str, refs: str) -> Column:
        return F.coalesce(F.array_min(F.transform(refs, lambda r: js_distance(F.col(hist), r))), F.lit(0.0))

    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    out = features.withColumns({"base_failed": failed, "char_distance": nearest("char_hist", c), "word_distance": nearest("word_hist", w)}).drop(c, w)
    far = ((F.col("word_chars") >= rules.char_guard) & (F.col("char_distance") > rules.max_char_distance)) | (
        (F.col("n_words") >= rules.word_guard) & (F.col("word_distance") > rules.max_word_distance)
    )
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return judge_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance")
    )
