"""URL filters as a sort-merge range join.

A host is turned round (``a.example.net`` becomes ``net.example.a.``), so a
host rule covers one interval of keys, and intervals nest or lie apart. Rules
and URLs are sorted together; at a URL, the last rule begun and those around it
are the active stack. The longest rule of the stack whose interval holds the key
and whose path begins the URL's path decides. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the key space that are swept apart, each cut at a rule's key.
SWEEPS = 64
#: URLs of a group at least; a sweep with more is cut into several, and its rules go
#: to each. Groups are larger where a sweep has many rules.
TASK_URLS, URLS_TO_RULES = 256, 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def turned(host: Column) -> Column:
    """Labels in reverse, each followed by a dot; nothing for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def compiled(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule host's key, and the rules of all hosts around it.

    The stack is an array of (length, host, path, verdict), longest first. It is
    found by equality with the key's own beginnings, label by label.
    """
    r = rules.select(F.translate("host", UPPER, UPPER.lower()).alias("host"), "path", "verdict").where("host <> '' and path is not null and verdict is not null").distinct()
    r = r.withColumn("key", turned(F.col("host")))
    entry = F.struct((-F.length("host") - F.length("path")).alias("rank"), "host", "path", "verdict", F.col("key").alias("at"))
    held = r.groupBy("key").agg(F.collect_set(entry).alias("own"))
    labels = F.split("key", r"\.", -1)
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "."), F.lit(".")))
    around = held.select("key", F.explode(F.array_distinct(starts)).alias("start"))
    return around.join(held.select(F.col("key").alias("start"), "own"), "start").groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", task_urls: int = TASK_URLS) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has host, path and verdict; a rule with a null or an empty host is ignored. A rule
    fits its host and all subdomains, if the URL's path starts with the rule's.
    The longest host and path together win; among equals the smallest host,
    then path, then verdict. A null URL or one without ``://`` has an empty host
    and path and gets ``otherwise``, as do URLs without a rule. Repeated rows and
    null ids are kept. Empty rules or pages are allowed. The stack of rules around
    a host is bounded by its labels and the rules of one host. URLs are counted by
    sweep first, so the number of tasks grows with them and a crowded sweep gets
    more.
    """
    urls = pages.select(F.col(id_col).alias("k"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("key", turned(F.col("host")))
    begun = compiled(rules)
    # Cuts are rule keys: a sweep starts with the stack of its cut.
    picked = [x.key for x in begun.select("key").orderBy(F.xxhash64("key")).limit(SWEEPS).collect()]
    cuts = F.array(*[F.lit(k) for k in picked]).cast("array<string>")
    sweep = F.size(F.filter(cuts, lambda c: c <= F.col("key")))
    size = max(task_urls, URLS_TO_RULES * -(-begun.count() // (len(picked) + 1)))
    # one number for each of at most SWEEPS + 1 sweeps
    held = {r["sweep"]: r["count"] for r in urls.groupBy(sweep.alias("sweep")).count().collect()}
    tasks = F.array(*[F.lit(max(1, -(-held.get(s, 0) // size))) for s in range(len(picked) + 1)])
    salt = F.pmod(F.xxhash64("k", "path"), F.get(tasks, sweep)).cast("int")
    u = urls.select("k", "host", "path", "key", sweep.alias("sweep"), salt.alias("salt"), F.lit(1).alias("kind"))
    r = begun.select("key", sweep.alias("sweep"), F.explode(F.sequence(F.lit(0), F.get(tasks, sweep) - 1)).alias("salt"), F.lit(0).alias("kind"), "stack")
    both = u.unionByName(r, allowMissingColumns=True)
    swept = both.withColumn("active", F.last("stack", True).over(Window.partitionBy("sweep", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.filter("active", lambda s: F.startswith(F.col("key"), s["at"]) & F.startswith(F.col("path"), s["path"]))
    won = F.get(fits, F.lit(0))
    return swept.where("kind = 1").withColumn("won", won).select(
        F.col("k").alias(id_col), "host", "path", F.concat("won.host", "won.path").alias("rule"), F.coalesce("won.verdict", F.lit(otherwise)).alias("verdict")
    )
