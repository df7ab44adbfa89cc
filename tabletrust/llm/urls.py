"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

DataFrame functions only. The trees are fitted by Spark's own booster on a bounded sample of labelled URLs and
compiled to one column expression, so judging is a projection and a join with the small table of suffix statistics.

Labels: the given tables have none for URLs, and what a page says doesn't tell good hosts from bad ones there. So a URL is
a known bad one if a label of its host has one of the seed terms as a part; other hosts are good. The terms only make
labels. The trees see lengths, depth, ratios, entropy, counts and suffix statistics, so that they also judge hosts whose
words were never seen.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.common import bounded, saved

#: Most labelled URLs that the trees are fitted on; those with the smallest hashes are taken.
SAMPLE = 20_000
#: Parts of host labels that mark known bad URLs.
SEED_TERMS = ["ads", "adult", "bet", "bets", "casino", "cheap", "click", "farm", "free", "loan", "loans", "pills", "poker", "porn", "spam", "sex", "track", "viagra", "warez", "win", "xxx"]
#: Always part of the labelled table, so that it has both kinds.
EXAMPLES = [
    ("https://www.casino-win.example.org/en/14?page=2&ref=x", 1), ("http://m.free-bets.example.com/de/963", 1), ("https://spam-farm.example.net/x/1.html", 1),
    ("https://cheap-pills.example.com/fr/176/", 1), ("https://ads-track.example.org/en/584", 1), ("http://win-casino-free.example.net/?id=1&aff=2&sub=3", 1),
    ("https://news.example.org/en/25", 0), ("http://blog.garden.example.com/de/252?utm_source=feed", 0), ("https://example.net/es/797#top", 0),
    ("https://m.library.example.org/fr/414.html", 0), ("http://www.harbour.example.com/en/328/", 0), ("https://school.example.net/about/people", 0),
]
TREES, DEPTH = 20, 3
A_TO_Z, a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty for null and without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), A_TO_Z, a_to_z)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fit(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. rules: ("org/en/", "allow" or "block")."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits.append(F.when(((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def features(urls: DataFrame) -> DataFrame:
    """Adds host, path, suffix and the lexical features to rows that have a url."""
    u = F.coalesce(F.col("url"), F.lit(""))
    count = lambda text, pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    named = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    h, p = F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return named.withColumns({
        "f_length": F.length(u).cast("double"), "f_host_length": F.length(h).cast("double"), "f_path_length": F.length(p).cast("double"),
        "f_depth": F.length(F.regexp_replace(p, "[^/]", "")).cast("double"), "f_labels": F.length(F.regexp_replace(h, "[^.]", "")).cast("double"),
        "f_digits": F.when(u == "", 0.0).otherwise(count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1))), "f_entropy": entropy(h),
        "f_params": F.when(query == "", 0.0).otherwise(F.length(F.regexp_replace(query, "[^&]", "")) + 1.0), "f_hyphens": F.length(F.regexp_replace(h, "[^-]", "")).cast("double"),
        "f_longest": F.coalesce(F.array_max(F.transform(F.split(h, "[.]"), lambda x: F.length(x))), F.lit(0)).cast("double"),
        "f_vowels": F.when(h == "", 0.0).otherwise(count(h, "[aeiou]") / F.greatest(F.length(h), F.lit(1))), "suffix": F.substring_index(h, ".", -1),
    })


FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_longest", "f_vowels", "f_suffix_bad", "f_suffix_seen"]


def labelled(urls: DataFrame, url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """url, label: the bounded sample with its labels, and the fixed examples."""
    term = "(?:^|[-.])(?:" + "|".join(SEED_TERMS) + ")(?:$|[-.])"
    known = urls.select(F.col(url).alias("url")).where(host(F.col(url)) != "").distinct().orderBy(F.xxhash64("url"), "url").limit(sample)
    examples = urls.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y}D)" for u, y in EXAMPLES) + " AS t(url, label)")
    return known.withColumn("label", host(F.col("url")).rlike(term).cast("double")).unionByName(examples)


def tree_column(text: str, names: list[str]) -> list[Column]:
    """The trees of a fitted model's printed form, each as a nested conditional of the named columns."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if re.match(r"\s*(If|Else|Predict|Tree)", x)]

    def node(at: int) -> tuple[Column, int]:
        depth, x = lines[at]
        if x.startswith("Predict"):
            return F.lit(float(x.partition(":")[2])), at + 1
        test = re.match(r"If \(feature (\d+) <= (\S+)\)", x)
        yes, at = node(at + 1)
        no, at = node(at + 1)  # the line "Else"
        return F.when(F.col(names[int(test[1])]) <= float(test[2]), yes).otherwise(no), at

    return [node(k + 1)[0] for k, (_, x) in enumerate(lines) if x.startswith("Tree")]


class UrlModel:
    """Fitted trees as a column expression, and a table of suffix statistics."""

    def __init__(self, rows: DataFrame):
        """rows: url and label (0 or 1), a bounded number with both labels."""
        shaped = saved(features(rows), "url_features")
        overall = shaped.agg(F.avg("label")).first()[0]
        stats = shaped.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
        self.overall = overall
        self.suffixes = saved(stats.select("suffix", ((F.col("bad") + 10 * overall) / (F.col("n") + 10)).alias("_bad"), F.log1p("n").alias("_seen")), "suffixes")
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self._suffix(shaped)).select("features", "label")
        fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, stepSize=0.3).fit(ready)
        trees = tree_column(fitted.toDebugString, FEATURES)
        margin = reduce(lambda a, b: a + b, [t * F.lit(float(w)) for t, w in zip(trees, fitted.treeWeights, strict=True)])
        self.score = 1 / (1 + F.exp(-2 * margin))

    def _suffix(self, df: DataFrame) -> DataFrame:
        known = df.join(bounded(self.suffixes), "suffix", "left")
        return known.withColumns({"f_suffix_bad": F.coalesce("_bad", F.lit(self.overall)), "f_suffix_seen": F.coalesce("_seen", F.lit(0.0))}).drop("_bad", "_seen")

    def judged(self, urls: DataFrame) -> DataFrame:
        """urls (with a column url) with host, path, suffix, the features and score (0 to 1, higher: likelier bad)."""
        return self._suffix(features(urls)).withColumn("score", self.score)


ADDED = ["host", "path", "rule", "verdict", "score"]


def filtered(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url", limit: float = 0.5, sample: int = SAMPLE, model: UrlModel | None = None) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and score. A rule decides where one fits; else the trees do.

    Null and empty URLs, and those without ://, have an empty host and path and are judged by the trees; URLs of any length
    are read whole. Of rules of equal length that fit, the first by name holds. Repeated rows and rows with equal keys are
    judged each; an empty table gives no rows. Columns of urls named host, path, rule, verdict or score are replaced, all
    others stay, whatever they are called.
    """
    base = urls.select(*(c for c in urls.columns if c.lower() not in ADDED))
    model = model or UrlModel(labelled(urls, url, sample))
    judged = model.judged(base.select(F.struct(*base.columns).alias("row"), F.col(url).alias("url"))).withColumn("fit", rule_fit(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= limit, "block").otherwise("allow"))
    return judged.select("row.*", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
