"""URL filters: sort-merge range join of urls and rules.

A rule is (action, host, path): it fits its host and all subdomains when the
url's path starts with the rule's.  Both sides get a canonical key, the host's
labels in reverse order, a separator and the path.  For each depth that
rules use, a url has one key (its last labels and its path).  A rule's key is
then a prefix of every key it fits, so it is the interval of keys that begin
with it.  Keys and interval starts are sorted together; at each start the
sweep takes over the stack of rules that enclose it, and a key's rules are
those of the last stack that still enclose the key.

Only DataFrame functions.  The keys are distinct before the sort.  They are dealt
evenly over ``sweeps`` sorted runs with the rules' stacks in each of them, so a
host with a third of all urls is no hot partition; R rules cost R x sweeps
rows.

Defined cases: a null url, or one without ``://``, has an empty host and
path and fits no rule with a host; repeated urls are judged once and joined
back; among equally long rules the one with the longer host wins, then the
smaller text, then ``block``; no rules or an empty table give null rules or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between host and path; sorts before every character a url may hold.
_END = "\x01"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit(_END), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``key``, ``depth`` and ``stack``: all rules whose key is a prefix of this one's.

    Every prefix of a key is looked up among the keys, so the join is an
    equi-join on whole keys.
    """
    host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER)
    path = F.coalesce("path", F.lit(""))
    labels = F.split(host, r"\.", -1)
    keyed = rules.select(
        _key(labels, path).alias("key"), F.size(labels).alias("depth"),
        F.struct(F.length(F.concat(host, path)).alias("len"), F.length(host).alias("host_len"),
                 F.concat(host, path).alias("rule"), F.col("action"), _key(labels, path).alias("key")).alias("rule"),
    )
    at = keyed.select("key", "depth").distinct()
    ends = F.sequence(F.lit(1), F.length("key"))
    prefixes = at.select("key", "depth", F.explode(ends).alias("n")).select(
        F.col("key").alias("of"), "depth", F.expr("substring(key, 1, n)").alias("key"))
    return (prefixes.join(keyed.select("key", "rule"), "key")
            .groupBy(F.col("of").alias("key"), "depth").agg(F.collect_set("rule").alias("stack")))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               sweeps: int | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the longest
    rule that fits, else null) and ``verdict`` (the rule's action, else ``default``).

    ``pages`` columns of those names are replaced.
    """
    spark = pages.sparkSession
    sweeps = sweeps or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns(
        {"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    stacks = rule_stacks(rules)
    depths = [r.depth for r in stacks.select("depth").distinct().collect()]  # a few small numbers
    labels = F.split("host", r"\.", -1)
    keys = F.filter(F.array(*[
        F.when(F.size(labels) >= d, _key(F.slice(labels, -d, d), F.col("path"))) for d in depths] or [F.lit(None).cast("string")]
    ), lambda k: k.isNotNull())
    urls = parsed.select("host", "path").distinct()
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    points = urls.select(F.explode(keys).alias("key"), "host", "path",
                         F.pmod(F.xxhash64("host", "path"), F.lit(sweeps)).alias("sweep"), F.lit(1).alias("side"), none.alias("stack"))
    starts = stacks.select("key", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sweeps - 1).cast("long"))).alias("sweep"), F.lit(0).alias("side"), "stack")
    run = Window.partitionBy("sweep").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = points.unionByName(starts).withColumn("stack", F.last("stack", ignorenulls=True).over(run)).where("side = 1")
    # longest first: larger lengths, then the smaller text, then block (the larger of the two words)
    best = F.array_sort(
        F.filter("stack", lambda r: F.col("key").startswith(r["key"])),
        lambda a, b: F.when(a["len"] != b["len"], b["len"] - a["len"]).when(a["host_len"] != b["host_len"], b["host_len"] - a["host_len"])
        .when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).when(a["action"] > b["action"], -1).when(a["action"] < b["action"], 1).otherwise(0))
    # of the depths of one url, the best again by the same order
    fits = swept.select("host", "path", F.get(best, F.lit(0)).alias("r")).where("r is not null")
    won = fits.groupBy("host", "path").agg(F.max_by("r", F.struct("r.len", "r.host_len")).alias("r"))
    judged = won.select("host", "path", F.col("r.rule").alias("rule"), F.col("r.action").alias("verdict"))
    return (parsed.join(judged, ["host", "path"], "left")
            .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
            .select(*[c for c in parsed.columns if c not in ("host", "path")], "host", "path", "rule", "verdict"))
