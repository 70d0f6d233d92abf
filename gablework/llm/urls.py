"""URL filters: path rules by host, and a logistic model of hashed character n-grams for all other URLs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .url_labels import ALLOWED, BLOCKED

PLACES = 1 << 14
GRAMS = (3, 4, 5)
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null and where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, or null; for rule lists of up to some hundreds."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def places(host: str, path: str) -> list[int]:
    """Distinct hashed places of the n-grams of host and path, whose ends are marked."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            for i in range(len(text) - n + 1):
                found.add(crc32((mark + text[i : i + n]).encode()) % PLACES)
    return sorted(found)


def parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


class UrlModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, host: str, path: str) -> float:
        """Probability that the URL is to be blocked."""
        found = places(host, path)
        z = self.bias + (self.weights[found].sum() / len(found) ** 0.5 if found else 0.0)
        return float(1 / (1 + np.exp(-z)))


@cache
def trained(rounds: int = 1000, rate: float = 20.0, decay: float = 0.00005) -> UrlModel:
    """Weights by gradient descent on the labelled URLs; the bias keeps unknown URLs allowed."""
    urls = [(u, 1.0) for u in BLOCKED] + [(u, 0.0) for u in ALLOWED]
    x = np.zeros((len(urls), PLACES))
    for row, (url, _) in enumerate(urls):
        found = places(*parts(url))
        x[row, found] = len(found) ** -0.5
    y = np.array([label for _, label in urls])
    # The weights stay sums of the rows, so the steps need only the products of the rows.
    products, share, bias = x @ x.T, np.zeros(len(urls)), -1.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(products @ share + bias))) - y
        share -= rate * (miss / len(y) + decay * share)
    return UrlModel(x.T @ share, bias)


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list[tuple[str, str]] | None = None,
    model: UrlModel | None = None,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict (allow or block).

    The longest rule that fits decides, else the model; a null or empty url, or one without ``://``, has an empty
    host and path and is judged by the model's bias (allow). URLs are read whole. Null and repeated ids are carried
    along. An empty table gives an empty result.
    """
    model = model or trained()
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", matched_rule(F.col("host"), F.col("path"), RULES if rules is None else rules))

    @F.pandas_udf("string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(["block" if model.score(h, p) >= 0.5 else "allow" for h, p in zip(hosts, paths)], dtype=str)

    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", verdict("host", "path")).alias("verdict"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
