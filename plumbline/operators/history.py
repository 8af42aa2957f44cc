"""Measures of change history: churn, co-change, bug-fix spread, issues.

commit_files: repo, sha, ts, subject, path - one row per file of a commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.plans.ordering import running_sum

#: Paths of tests, subjects of bug fixes, files that aren't source.
TEST_PATHS = r"(?i)(^|/)(tests?|testing|conftest\.py)(/|$)|(^|/)test_[^/]*$|_test\.[a-z]+$"
BUG_FIX = r"(?i)\b(fix|bug|regress|hotfix|issue|patch)\b"
SKIP_NAMES = ("CHANGELOG", "CHANGELOG.md", "CHANGES", "README.md", "README.rst", "LICENSE", "setup.py", "setup.cfg", "pyproject.toml")
SKIP_DIRECTORIES = ("docs/", "doc/", ".github/", "ci/", ".circleci/")
SKIP_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "ico", "pdf", "md", "rst", "txt", "lock")


def is_source(path: Column) -> Column:
    name, ending = F.element_at(F.split(path, "/"), -1), F.lower(F.element_at(F.split(path, r"\."), -1))
    skipped = name.isin(*SKIP_NAMES) | ending.isin(*SKIP_ENDINGS)
    for d in SKIP_DIRECTORIES:
        skipped = skipped | path.startswith(d)
    return ~skipped


def touches(commit_files: DataFrame, pattern: str = r"\.py$") -> DataFrame:
    """repo, path, module, n: commits that touch each production file."""
    rows = commit_files.where(F.col("path").rlike(pattern) & ~F.col("path").rlike(TEST_PATHS))
    return rows.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("module", F.substring_index("path", "/", 1))


def gini(values: DataFrame, by: str, x: str) -> DataFrame:
    """Gini coefficient of x within each group; 0 where all are equal or zero.

    Ranks come from the counts of the distinct values, so a group's rows are
    summed before they meet.
    """
    counts = values.groupBy(by, x).agg(F.count(F.lit(1)).alias("k"))
    before = F.col("upto") - F.col("k")
    weighted = running_sum(counts, [by], x, "k", "upto").withColumn("ranks", F.col("k") * before + F.col("k") * (F.col("k") + 1) / 2.0)
    n, total = F.sum("k"), F.sum(F.col(x) * F.col("k"))
    return weighted.groupBy(by).agg(F.coalesce(F.try_divide(2.0 * F.sum(F.col("ranks") * F.col(x)), n * total) - (n + 1.0) / n, F.lit(0.0)).alias("gini"))


def churn(file_touches: DataFrame) -> DataFrame:
    """repo, n_files, mean, median and largest churn, hotspot_ratio (share above twice the mean), module_cv, gini."""
    means = file_touches.groupBy("repo").agg(F.avg("n").alias("mean"))
    stats = file_touches.join(means, "repo").groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.avg("n").alias("mean_churn"), F.median("n").alias("median_churn"), F.max("n").alias("max_churn"),
        F.avg((F.col("n") > 2 * F.col("mean")).cast("double")).alias("hotspot_ratio"),
    )
    modules = file_touches.groupBy("repo", "module").agg(F.sum("n").alias("m")).groupBy("repo").agg(
        F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.stddev_pop("m"), F.avg("m")), F.lit(0.0))).alias("module_cv")
    )
    return stats.join(modules, "repo").join(gini(file_touches, "repo", "n"), "repo")


def hottest(file_touches: DataFrame, n: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "path"))
    return file_touches.withColumn("place", place).where(F.col("place") <= n)


def cochange(commit_files: DataFrame, least: int = 2, most: int = 30) -> DataFrame:
    """repo, n_commits, n_files, entropy, entropy_norm, cross_package_ratio, files_per_commit.

    A file's weighted degree in the co-change graph is the sum of the other
    files of its commits, so no pair of files is ever built.
    """
    files = commit_files.select("repo", "sha", "path").distinct()
    commits = files.groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("size"), F.countDistinct(names.file_package(F.col("path"))).alias("packages")).where(F.col("size").between(least, most))
    degree = files.join(commits, ["repo", "sha"]).groupBy("repo", "path").agg(F.sum(F.col("size") - 1).alias("d"))
    total = degree.groupBy("repo").agg(F.sum("d").alias("t"))
    p = F.col("d") / F.col("t")
    entropy = degree.join(total, "repo").groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), (-F.sum(p * F.log2(p))).alias("entropy"))
    per = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("n_commits"), F.avg((F.col("packages") > 1).cast("double")).alias("cross_package_ratio"), F.avg("size").alias("files_per_commit"))
    norm = F.when(F.col("n_files") > 1, F.col("entropy") / F.log2(F.col("n_files").cast("double"))).otherwise(0.0)
    return entropy.join(per, "repo").select("repo", "n_commits", "n_files", "entropy", norm.alias("entropy_norm"), "cross_package_ratio", "files_per_commit")


def cochange_pairs(commit_files: DataFrame, least: int = 2, most: int = 30) -> DataFrame:
    """repo, a, b, n: commits that touch both files, a before b. Commits above ``most`` files don't count, which bounds the pairs of a commit."""
    files = commit_files.select("repo", "sha", "path").distinct()
    sized = files.groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(least, most)).select("repo", "sha")
    files = files.join(sized, ["repo", "sha"], "left_semi")
    pairs = files.toDF("repo", "sha", "a").join(files.toDF("repo", "sha", "b"), ["repo", "sha"]).where("a < b")
    return pairs.groupBy("repo", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def bugfix_ratio(commits: DataFrame, pattern: str = BUG_FIX) -> DataFrame:
    """repo, n_commits, n_bugfix, bugfix_ratio from one row per commit with its subject."""
    fix = F.col("subject").rlike(pattern)
    return commits.groupBy("repo").agg(F.count(F.lit(1)).alias("n_commits"), F.count(F.when(fix, 1)).alias("n_bugfix"), F.avg(F.coalesce(fix, F.lit(False)).cast("double")).alias("bugfix_ratio"))


def blast_radius(commit_files: DataFrame, root: str = "", wide: int = 5, least: int = 3, pattern: str = BUG_FIX) -> DataFrame:
    """repo, n_bugfix_commits, mean, median, p90 and largest number of files, shares of commits across packages and of wide ones.

    Only bug-fix commits and source files count; a repository with fewer than
    ``least`` such commits has nulls. A file outside ``root`` is in ``__root__``.
    """
    rows = commit_files.where(F.col("subject").rlike(pattern) & is_source(F.col("path")) & ~F.col("path").rlike(TEST_PATHS))
    inner = F.when(F.col("path").startswith(root), names.file_package(F.substring("path", len(root) + 1, 1 << 30))).otherwise("__root__")
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    per = rows.groupBy("repo", "sha").agg(F.countDistinct("path").alias("files"), F.countDistinct(directory).alias("directories"), F.countDistinct(inner).alias("packages"))
    out = per.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_bugfix_commits"), F.avg("files").alias("mean_files"), F.median("files").alias("median_files"), F.percentile("files", 0.9).alias("p90_files"), F.max("files").alias("max_files"),
        (100 * F.avg((F.col("packages") > 1).cast("double"))).alias("cross_package_pct"), (100 * F.avg((F.col("files") > wide).cast("double"))).alias("wide_pct"),
    )
    enough = F.col("n_bugfix_commits") >= least
    return out.select("repo", "n_bugfix_commits", *[F.when(enough, F.col(c)).alias(c) for c in out.columns[2:]])


def issue_stats(issues: DataFrame) -> DataFrame:
    """repo, n_issues, n_open, n_closed, issues_per_kloc, median_days_to_close; pull requests and negative times are left out.

    issues: repo, state, created_at, closed_at, is_pull_request, ncloc.
    """
    rows = issues.where(~F.coalesce("is_pull_request", F.lit(False)))
    days = (F.unix_micros("closed_at") - F.unix_micros("created_at")) / 86_400e6
    n = F.count(F.lit(1))
    return rows.groupBy("repo").agg(
        n.alias("n_issues"), F.count(F.when(F.col("state") == "open", 1)).alias("n_open"), F.count(F.when(F.col("state") == "closed", 1)).alias("n_closed"),
        F.when(F.max("ncloc") > 0, n / (F.max("ncloc") / 1000.0)).alias("issues_per_kloc"), F.median(F.when(days >= 0, days)).alias("median_days_to_close"),
    )
