"""URL filter: rules by host and path, and a logistic regression where no rule speaks.

The regression sees hashed character n-grams of host and path. It is trained from a small table of
labelled URLs; everything runs as DataFrame and MLlib operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.functions.text import let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the labelled URLs per class; ``features`` the hashed space; ``n`` the n-grams."""

    fit_rows: int = 2000
    features: int = 1 << 14
    n: tuple[int, ...] = (3, 4)
    steps: int = 50
    penalty: float = 1e-3


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits, or null.

    ``rules`` are pairs of verdict and ``host/path``. A rule fits its host and all subdomains if the
    path starts with its path. Of equally long rules, ``block`` comes before ``allow``.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngrams(host: Column, path: Column, sizes: Sequence[int]) -> Column:
    """Character n-grams of host and path, marked with where they come from; both ends are marked too."""
    def of(value: Column, mark: str) -> list[Column]:
        framed = F.concat(F.lit("^"), value, F.lit("$"))

        def cut(n: int) -> Column:
            return let(framed, lambda t: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))),
                lambda i: F.concat(F.lit(mark), F.substring(t, i, F.lit(n)))))

        return [cut(n) for n in sizes]

    return F.concat(*of(host, "h"), *of(path, "p"))


def _hashed(df: DataFrame, s: Settings) -> DataFrame:
    grams = df.withColumn("grams", ngrams(F.col("host"), F.col("path"), s.n))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=s.features, binary=True).transform(grams)


def learn(labelled: DataFrame, settings: Settings = Settings()) -> LogisticRegressionModel | str:
    """Fit on a table ``host, path, verdict``: of each verdict at most ``fit_rows`` different pairs, by hash.

    With one verdict only, that one is returned; with no row at all, ``allow``.
    """
    pairs = labelled.select("host", "path", "verdict").distinct()
    rank = F.row_number().over(Window.partitionBy("verdict").orderBy(F.xxhash64("host", "path"), "host", "path"))
    sample = pairs.withColumn("_rank", rank).filter(F.col("_rank") <= settings.fit_rows).drop("_rank")
    verdicts = [r["verdict"] for r in sample.select("verdict").distinct().collect()]
    if len(verdicts) < 2:
        return verdicts[0] if verdicts else "allow"
    rows = _hashed(sample, settings).select("features", (F.col("verdict") == "block").cast("double").alias("label"))
    return LogisticRegression(maxIter=settings.steps, regParam=settings.penalty, aggregationDepth=2).fit(rows)


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]], keep: tuple[str, ...], url: str = "url",
          labelled: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` of every URL, beside ``keep``.

    ``labelled`` is the training table (host, path, verdict). If it is not given, the URLs that a rule
    decides are the labels. Null URLs and those without ``://`` have an empty host and path; the
    regression judges them, as it judges every URL without a rule. Repeated rows are each judged, an
    empty table gives an empty table; a kept column with the name of a result gives way to it.
    """
    new = ("host", "path", "rule", "verdict", "block_score")
    kept = [c for c in keep if c not in new]
    parsed = urls.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = parsed.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = ruled.filter(F.col("_rule").isNotNull()).select("host", "path", F.col("_rule.verdict").alias("verdict"))
    model = learn(labelled, settings)
    if isinstance(model, str):
        scored = ruled.withColumn("_learned", F.lit(model)).withColumn(
            "block_score", F.lit(1.0 if model == "block" else 0.0))
    else:
        from pyspark.ml.functions import vector_to_array

        model.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")
        scored = model.transform(_hashed(ruled, settings)).withColumn(
            "block_score", F.get(vector_to_array("_probability"), F.lit(1)))
        scored = scored.withColumn("_learned", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select(*kept, "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce(F.col("_rule.verdict"), F.col("_learned")).alias("verdict"), "block_score")
