"""Operator 3: URL rules by a sort-merge range join.

A rule's canonical key is its host's labels in reverse, a separator and its path; the urls that it fits are
an interval of keys that begin with it, and such intervals nest or are disjoint. A url has one key for each
of its host's suffixes (as many as the longest rule host has labels). Rules and keys are sorted together and
swept once; the state of the sweep is the stack of rules whose intervals are open, and the deepest one that
the key begins with wins.

The sweep runs in many ranges at once. Bounds are quantiles of a bounded sample of the keys, taken by hash;
a range that would need several equal bounds (one key with very many urls) is dealt out over as many salts.
A rule with an open interval at a range's start is a prefix of the bound itself, so what a range inherits is
found by an equi-join on the bound's prefixes; no range waits for another. DataFrame functions only.

Defined results: a null url, or one without ://, has an empty host and path, no rule and the default
verdict; equal urls and page_ids are judged once per row; of rules with one key, block wins; of rules of
equal length that fit, the one with the longer host; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Below every character of hosts and paths that occur.
SEPARATOR = "\x01"
#: Sampled keys for each range, and the most that are sampled.
SAMPLE_PER_RANGE, MOST_SAMPLED = 16, 1 << 14


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules read them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return lower_ascii(host), path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def stacks(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct `key` the rules that are prefixes of it, the shortest first."""
    prefixes = keys.select("key", F.explode(F.expr("transform(sequence(1, length(key)), i -> substring(key, 1, i))")).alias("rule_key"))
    return prefixes.join(rules, "rule_key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rule_key", "host", "path", "verdict"))).alias("stack"))


def _ranges(keys: DataFrame, wanted: int) -> list[tuple[str, int]]:
    """(lower bound, salts) of each range but the first, from a sample of bounded size."""
    sampled = min(MOST_SAMPLED, SAMPLE_PER_RANGE * wanted)
    sample = sorted(r[0] for r in keys.select("key", F.xxhash64("uid", "key").alias("h")).orderBy("h", "key").limit(sampled).select("key").collect())
    found: dict[str, int] = {}
    for i in range(1, wanted):
        if sample:
            bound = sample[i * len(sample) // wanted]
            found[bound] = found.get(bound, 0) + 1
    return sorted(found.items())


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the bounds are not above the key: a search in two steps."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    tops = F.array(*(F.lit(b[0]) for b in blocks))
    coarse = F.size(F.filter(tops, lambda s: s <= key))
    inner = F.array(*(F.array(*map(F.lit, b)) for b in blocks))
    fine = F.size(F.filter(F.element_at(inner, F.greatest(coarse, F.lit(1))), lambda s: s <= key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine)


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages` (page_id, url).

    rules: host, path, verdict; a rule fits its host and all subdomains, for paths that begin with its path.
    """
    spark = pages.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").where("host <> ''")
    rules = rules.withColumn("rule_key", F.concat(reversed_host(F.col("host")), F.lit(SEPARATOR), F.col("path")))
    rules = rules.groupBy("rule_key", "host", "path").agg(F.max("verdict").alias("verdict"))
    labels = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1

    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("uid", F.monotonically_increasing_id())
    names = F.split(F.col("host"), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda n: F.concat(F.array_join(F.slice(F.reverse(names), F.lit(1), n), "."), F.lit(SEPARATOR), F.col("path")))
    keys = urls.select("uid", "page_id", "host", "path", F.explode(suffixes).alias("key"))

    found = _ranges(keys, ranges)
    bounds, salts = [b for b, _ in found], F.array(F.lit(1), *(F.lit(n) for _, n in found))
    bucket = lambda c: _range_of(F.col(c), bounds)

    opened = stacks(rules.select(F.col("rule_key").alias("key")), rules).withColumn("range", bucket("key")).withColumn("kind", F.lit(1))
    if found:
        starts = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(b).alias("key"), F.lit(i + 1).alias("range")) for i, b in enumerate(bounds)))))
        inherited = stacks(starts.select("key"), rules).join(starts, "key").withColumn("kind", F.lit(0))
        opened = opened.unionByName(inherited)
    opened = opened.withColumn("salt", F.explode(F.sequence(F.lit(0), F.element_at(salts, F.col("range") + 1) - 1)))
    swept = keys.withColumn("range", bucket("key")).withColumn("salt", F.pmod(F.xxhash64("uid"), F.element_at(salts, F.col("range") + 1)).cast("int")).withColumn("kind", F.lit(2))

    sweep = Window.partitionBy("range", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = swept.unionByName(opened, allowMissingColumns=True).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2")
    fits = F.filter("open", lambda r: F.startswith(F.col("key"), r["rule_key"]) & F.startswith(F.col("path"), r["path"]))
    top = F.try_element_at(fits, F.lit(-1))
    top = F.when(top.isNotNull(), F.struct((F.length(top["host"]) + F.length(top["path"])).alias("length"), F.length(top["host"]).alias("labels"), F.concat(top["host"], top["path"]).alias("rule"), top["verdict"].alias("verdict")))
    best = state.withColumn("top", top).groupBy("uid", "page_id", "host", "path").agg(F.max("top").alias("top"))
    return best.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
