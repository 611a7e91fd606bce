"""URL filter by association rules.

Labelled URLs become item sets: scheme, host and each of its parent domains, host
names, every path segment, every word within segments and host names, extension,
depth, every query key and every pair of key and value; digits are masked.  Spark's
FP-growth mines the item combinations of the blocked URLs; each is then counted in
all labelled URLs through an inverted index, which holds it under its rarest item.
A combination becomes a rule if its support and confidence reach their thresholds
and if a share like its own would hardly come about by chance: the lower Wilson
bound of its confidence, at a level divided by the number of combinations tested,
must pass the share of blocked URLs.  Labels that have nothing to do with URLs
therefore mine no rules.  Explicit host and path rules come first.

Only labelled rows with crc32(id as text) mod 5 other than 0 are mined, so the rest
can measure the rules.  What bounds the mining: items below the least count go
before, and of items that occur in exactly the same rows (a host and its only path,
say) one stays, which changes no rule's rows; so a URL's items add combinations only
as far as they vary independently among at least that many blocked URLs.

`labelled` and `pages` meet by id: the `labels` table is keyed by doc_id, and the
query takes a page's label from the row whose doc_id is its page_id.

Defined results: a null URL or one without "://" has an empty host and path, no
items, and the default verdict; an empty table gives no rows; a URL that no rule
matches is allowed; labels that are null count as not blocked; repeated and null ids
stay rows of their own; items over 256 characters stand as their SHA-256; hosts over
253 characters, the limit of DNS, give no parent domains.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ROW, cut, drop, keyed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix) of the production list.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rules that are broadcast at most; more are joined by a shuffle with salted items.
BROADCAST = 4096
SALTS = 16
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _masked(part: Column) -> Column:
    return F.regexp_replace(F.translate(part, UPPER, LOWER), "[0-9]+", "#")


def items_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct items of a URL."""
    some = lambda name, value: F.when(value != "", F.concat(F.lit(name + "="), value))
    each = lambda name, values: F.transform(values, lambda x: some(name, x))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    names = F.transform(labels, _masked)
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), _masked)
    last = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    inner = lambda values: F.flatten(F.transform(values, lambda x: F.split(x, "[^a-z#\\x{80}-\\x{10FFFF}]+")))
    query = F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    lone = F.array(
        some("scheme", F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)),
        some("first", F.coalesce(F.get(parts, F.lit(0)), F.lit(""))),
        some("last", last),
        some("ext", F.regexp_extract(last, r"\.([a-z0-9#]+)$", 1)),
        F.concat(F.lit("depth="), F.size(parts).cast("string")),
        F.when(url.contains("#"), F.lit("fragment")),
    )
    found = F.concat(
        lone,
        F.when(F.length(host) <= 253, each("site", parents)).otherwise(F.array(some("site", host))),
        each("name", names),
        each("part", parts),
        each("word", inner(F.concat(names, parts))),
        each("key", F.transform(query, lambda x: F.substring_index(x, "=", 1))),
        each("pair", F.transform(query, _masked)),
    )
    short = F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.when(F.length(x) > 256, F.concat(F.lit("sha="), F.sha2(x, 256))).otherwise(x))
    return F.when(url.contains("://"), F.array_sort(F.array_distinct(short))).otherwise(F.array().cast("array<string>"))


def _survivors(bags: DataFrame, need: int) -> DataFrame:
    """(item, n): items of at least `need` blocked bags; of those in the same bags, the first."""
    items = bags.select(F.explode("items").alias("item"), "blocked", F.xxhash64("items").cast("decimal(20,0)").alias("h"))
    counts = items.groupBy("item").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b"), F.sum("h").alias("where")).filter(F.col("b") >= need)
    return counts.groupBy("n", "b", "where").agg(F.min("item").alias("item")).select("item", "n")


def _lower(right: Column, n: Column, z: float) -> Column:
    """The lower Wilson bound of a share, z deviations away."""
    p, zz = right / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_count: int = 1, chance: float = 1.0) -> DataFrame:
    """(anchor, antecedent, confidence, support) of rules for `block`.

    `labelled` has items (array of strings) and blocked (boolean).  The anchor is
    the rarest item of the rule among the labelled URLs, ties by the item itself.
    `chance` bounds the probability that any rule at all passes by luck; 1 tests nothing.
    """
    none = labelled.sparkSession.createDataFrame([], "anchor string, antecedent array<string>, confidence double, support double")
    bags = cut(labelled.filter(F.size("items") > 0).select("items", F.coalesce("blocked", F.lit(False)).alias("blocked")))
    total, blocked = bags.agg(F.count("*"), F.count_if("blocked")).first()
    need = max(min_count, 1, -int(-min_support * total // 1))
    if blocked < need:
        drop(bags)
        return none
    singles = cut(_survivors(bags, need))
    # Items number at most those of all bags divided by `need`, a share of the bags.
    known = F.broadcast(singles.agg(F.collect_list("item").alias("known")))
    sets = cut(bags.crossJoin(known).select(F.array_sort(F.array_intersect("items", "known")).alias("items"), "blocked").filter(F.size("items") > 0).groupBy("items").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b")))
    drop(bags)
    seen = sets.filter("b > 0").select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("b"))).alias("k")).select("items")
    fed = seen.count()
    if not fed:
        return none
    frequent = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / fed), minConfidence=0.0).fit(seen).freqItemsets
    found = cut(frequent.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("b")))
    tests = found.count()
    rarest = found.select("antecedent", F.explode("antecedent").alias("item")).join(singles, "item").groupBy("antecedent").agg(F.min(F.struct("n", "item"))["item"].alias("anchor"))
    rules = cut(found.join(rarest, "antecedent").select("anchor", "antecedent", "b"))
    drop(found)
    hits = _meet(sets.select("items", "n"), rules.select("anchor", "antecedent"), tests)
    counted = rules.join(hits.groupBy("antecedent").agg(F.sum("n").alias("n")), "antecedent")
    sure = counted.withColumn("confidence", F.col("b") / F.col("n")).filter(F.col("confidence") >= min_confidence)
    if chance < 1:
        z = NormalDist().inv_cdf(1 - chance / max(tests, 1))
        sure = sure.filter(_lower(F.col("b").cast("double"), F.col("n").cast("double"), z) > blocked / total)
    out = cut(sure.select("anchor", "antecedent", "confidence", (F.col("b") / total).alias("support")))
    for t in (singles, sets, rules):
        drop(t)
    return out


def _meet(bags: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """Rows of `bags` and `rules` where the bag holds all items of the rule."""
    each = bags.withColumn("anchor", F.explode("items"))
    if n_rules <= BROADCAST:
        both = each.join(F.broadcast(rules), "anchor")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = each.withColumn("salt", F.pmod(F.xxhash64(*(c for c in bags.columns)), F.lit(SALTS)).cast("int")).join(salted, ["anchor", "salt"]).drop("salt")
    return both.filter(F.size(F.array_except("antecedent", "items")) == 0)


def matched(bags: DataFrame, rules: DataFrame, key: str = "items") -> DataFrame:
    """(key, mined, confidence): the surest rule of each key of `bags` that some rule fits.

    `key` is a column that tells rows apart, or the item sets themselves.
    """
    each = bags.select("items").distinct() if key == "items" else bags.select(key, "items")
    best = F.max(F.struct("confidence", "support", F.array_join("antecedent", " ").alias("mined"))).alias("best")
    return _meet(each, rules, rules.count()).groupBy(key).agg(best).select(key, "best.mined", "best.confidence")


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def explicit(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule; null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in reversed(ordered):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(
    pages: DataFrame, labelled: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id",
    min_support: float = 0.002, min_confidence: float = 0.5, min_count: int = 8, chance: float = 0.01,
) -> DataFrame:
    """(id, host, path, rule, verdict, mined, confidence, held_out) of every page.

    `labelled` has `label_id` and a boolean column blocked.  A rule needs `min_count`
    blocked URLs, however few URLs have labels.
    """
    url = F.col("url")
    base = keyed(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")), "page_id")
    base = base.withColumns({"host": host_of(url), "path": path_of(url), "held_out": held_out(F.col("page_id"))})
    bags = base.select(ROW, "page_id", "held_out", items_of(F.coalesce(url, F.lit("")), F.col("host"), F.col("path")).alias("items"))
    flags = labelled.select(F.col(label_id).cast("long").alias("page_id"), F.coalesce("blocked", F.lit(False)).alias("blocked")).groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    mined = mine(bags.filter("not held_out").join(flags, "page_id").select("items", "blocked"), min_support, min_confidence, min_count, chance)
    hit = F.col("hit")
    return (
        base.join(matched(bags, mined, ROW), ROW, "left")
        .withColumn("hit", explicit(F.col("host"), F.col("path"), rules))
        .select(
            F.col("page_id").alias(id_col),
            "host",
            "path",
            hit["rule"].alias("rule"),
            F.coalesce(hit["verdict"], F.when(F.col("mined").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
            "mined",
            "confidence",
            "held_out",
        )
    )
