"""URL rules by hashed expressions, as blocklist services match them.

Each URL is expanded into host suffixes crossed with path prefixes, for those label counts and
prefix lengths only that some rule has. The expressions meet the rules in an equi-join on the
first four bytes of their SHA-256 digest; the whole digest confirms; among the confirmed rules the
longest wins (host and path together, then the host, then block before allow, then the text).
Columns and joins only. The join works on the distinct URLs: copies of a URL are decided once.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import local

#: (verdict, host, path)
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*", 0), F.lit("")),
                       UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null and where :// is missing."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def expressions(host_: Column, path_: Column, labels: Sequence[int],
                lengths: Sequence[int]) -> Column:
    """Array of host-suffix + path-prefix strings; null elements where the URL is too short."""
    parts = F.split(host_, r"\.")
    found = []
    for n in labels:
        suffix = F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), "."))
        found += [F.when(F.length(path_) >= k, F.concat(suffix, F.substring(path_, 1, k)))
                  for k in lengths]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def match(urls: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """`urls` with host, path, rule (host and path of the winning one, else null) and verdict.

    urls needs a column url. Null, empty or malformed URLs have an empty host and path and get the
    default verdict. Each row is answered, repeated ones alike; an empty table or no rules are
    fine. Other columns pass through, but for host, path, rule and verdict, which are replaced.
    """
    spark = urls.sparkSession
    table = [(v, h, p, h + p, h.count(".") + 1, len(p)) for v, h, p in dict.fromkeys(rules)]
    labels, lengths = sorted({r[4] for r in table}), sorted({r[5] for r in table})
    columns = pa.schema([("verdict", pa.string()), ("host", pa.string()), ("path", pa.string()),
                         ("rule", pa.string()), ("n_labels", pa.int32()), ("n_path", pa.int32())])
    known = (local(spark, table, columns)
             .withColumn("digest", F.sha2("rule", 256)).withColumn("head", _head(F.col("digest"))))
    distinct = (urls.select("url").filter("url is not null").distinct()
                .select("url", host(F.col("url")).alias("h"), path(F.col("url")).alias("p")))
    asked = (distinct.select("url", F.explode(expressions(F.col("h"), F.col("p"), labels, lengths))
                             .alias("text"))
             .withColumn("full", F.sha2("text", 256)).withColumn("prefix", _head(F.col("full"))))
    hits = asked.join(known, F.col("prefix") == F.col("head")).filter("full = digest")
    order = F.struct((F.col("n_path") + F.length("host")).alias("both"), F.length("host").alias("h"),
                     (F.col("verdict") == "block").alias("b"), F.col("rule"))
    best = hits.groupBy(F.col("url").alias("__of")).agg(
        F.max_by(F.struct("rule", "verdict"), order).alias("__best"))
    kept = urls.drop("host", "path", "rule", "verdict")
    return (kept.join(best, F.col("url") == F.col("__of"), "left")
            .select(*kept.columns, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                    F.col("__best.rule").alias("rule"),
                    F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict")))


def _head(digest: Column) -> Column:
    """The first four bytes as a number: the key of the join."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
