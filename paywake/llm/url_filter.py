"""URL filter: rules on host and path, and gradient-boosted trees for the URLs that no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywake.llm.store import Scratch

#: host, path, verdict. A rule fits its host and all subdomains if the path starts with its path; the longest wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SAMPLE = 20_000     # labelled URLs that the trees are fitted to, at most
TREES, DEPTH = 20, 4
SUFFIX_PRIOR = 20   # URLs of a suffix at which its own block rate counts as much as the overall rate

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "entropy", "parameters",
            "fragment", "secure", "suffix_share", "suffix_block")
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *_LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null without one; equal lengths: the first given."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        here = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(start)
        fits = F.when(here, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _entropy(text: Column) -> Column:
    """Bits per character of a whole text, from the runs of its sorted characters: the time is that of sorting them."""
    characters = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def weight(run: Column) -> Column:
        return F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(seen: Column, c: Column) -> Column:
        same = seen["last"] == c
        return F.struct(c.alias("last"), F.when(same, seen["run"] + 1).otherwise(1.0).alias("run"),
                        (seen["total"] + F.when(same, 0.0).otherwise(weight(seen["run"]))).alias("total"))

    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    return F.log2(n) - F.aggregate(characters, start, step, lambda seen: seen["total"] + weight(seen["run"])) / n


def lexical(urls: DataFrame) -> DataFrame:
    """Columns of FEATURES that need one URL only, and its suffix (the last two labels of the host)."""
    url, name, way = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")

    def count(pattern: str, text: Column = url) -> Column:
        return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("double")

    length = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    return urls.withColumns({
        "length": F.char_length(url).cast("double"), "host_length": F.char_length(name).cast("double"),
        "path_length": F.char_length(way).cast("double"), "depth": count("/", way), "labels": count("[.]", name),
        "digits": count("[0-9]") / length, "hyphens": count("-", name), "entropy": _entropy(url),
        "parameters": count("[?&]"), "fragment": count("#"), "secure": F.lower(url).startswith("https:").cast("double"),
        "suffix": F.substring_index(name, ".", -2)})


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """(suffix, suffix_share, suffix_block): share of all URLs, and share of its rule-labelled URLs that are blocked.

    The block rate is drawn to the overall rate where there are few labels.
    """
    blocked, labelled = F.col("label") == 1, F.col("label").isNotNull()
    by = urls.groupBy("suffix").agg(F.count("*").alias("n"), F.count_if(labelled).alias("labelled"), F.count_if(blocked).alias("blocked"))
    total = urls.agg(F.count("*"), F.count_if(labelled), F.count_if(blocked)).first()
    rate = total[2] / total[1] if total[1] else 0.5
    return by.select("suffix", (F.col("n") / max(1, total[0])).alias("suffix_share"),
                     ((F.col("blocked") + rate * SUFFIX_PRIOR) / (F.col("labelled") + SUFFIX_PRIOR)).alias("suffix_block"))


def judge(pages: DataFrame, rules=RULES, page: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of block) of every page.

    URLs that a rule fits are the labelled ones. The trees learn from at most SAMPLE of them, those least in a hash
    of URL and page_id, so that a URL of many pages has no more than its share, and judge the rest; suffix statistics count all. Without labels of both kinds everything that no
    rule fits is allowed, with score null. A null url, or one without ://, has an empty host and path and is judged
    like any other. Repeated rows come back as often as given, a null page_id stays null, no rows give no rows,
    and other columns are ignored.
    """
    rows = pages.select(F.col(page).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rows = rows.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    label = F.when(F.col("fits.verdict") == "block", 1.0).when(F.col("fits.verdict") == "allow", 0.0)
    rows = lexical(rows.withColumn("label", label))
    scratch = Scratch(pages.sparkSession, "urls")
    rows = scratch.keep(rows.select("page_id", "url", "host", "path", "fits", "label", "suffix", *FEATURES[:-2]), "features")
    described = scratch.keep(rows.join(scratch.keep(suffix_statistics(rows), "suffixes"), "suffix", "left"), "described")
    sample = described.where("label is not null").orderBy(F.xxhash64("url", "page_id"), "page_id").limit(SAMPLE).select("label", *FEATURES)
    sample = scratch.keep(sample.repartition(4), "sample")
    verdict, score = F.lit("allow"), F.lit(None).cast("double")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    if sample.agg(F.count_distinct("label")).first()[0] == 2:
        trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1, cacheNodeIds=False)
        model = trees.fit(assembler.transform(sample).select("label", "features"))
        described = model.transform(assembler.transform(described))
        score = vector_to_array("probability")[1]
        verdict = F.when(score >= 0.5, "block").otherwise("allow")
    return described.select("page_id", "host", "path", F.col("fits.rule").alias("rule"),
                            F.coalesce("fits.verdict", verdict).alias("verdict"), score.alias("score"))
