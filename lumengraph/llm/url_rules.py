"""URL filters by association rules, in DataFrame functions.

Fixed rules (host and path) come first: a rule fits its host and all subdomains where the url's path
starts with the rule's; of those that fit, the longest wins. Their verdicts are the labels.
Token combinations that imply a verdict are mined from all tokens of the labelled urls, a size at a
time. Rules below the least support or confidence are pruned, and so are rules that a shorter one already implies at
no lower confidence. Those are never grown: of n tokens that the same urls share, one at a time is looked at
and not 2 ** n combinations. A mined rule is listed in an inverted index under its rarest token, a url looks
up its own tokens, and a hit counts if the url holds the whole combination; urls with the same tokens
are looked up once. The verdict of a url
without a fixed rule is that of its most confident hit (then most specific, then `allow`); without a
hit it is `allow`.

Tokens: `host:` each of the host's labels, `tld:` its last, `path:` each part of the path (a number
becomes `#`, the ending stays), `key:` each query key.

Edge cases: a null url, or one without `://`, has an empty host and path, no rule, and but for the
keys of its query no tokens; without a hit it is allowed. The verdict hangs on the url alone: rows
with a null or repeated page_id are judged each. Extra columns are ignored. With no labelled url, or labels of
one verdict only, rules may all point one way. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.runtime import durable, table

#: (verdict, host, path): the fixed rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SUPPORT, CONFIDENCE = 0.005, 0.9
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(h: Column, p: Column, rules: tuple = RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith(f".{rule_host}")) & p.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(found)
    return found


def tokens(url: Column, h: Column, p: Column) -> Column:
    """Sorted distinct tokens of a url."""
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.when(F.size(labels) > 0, F.array(F.concat(F.lit("tld:"), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>")),
        F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"[0-9]+", "#"))),
        F.transform(keys, lambda x: F.concat(F.lit("key:"), x)),
    )))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (rule_id, items, verdict, confidence, support) from `labelled(items, verdict)`.

    Combinations grow by one token a round, from those that share all tokens but the last. One that holds for as many urls
    as with a token less has that shorter one's confidence, and beside a shorter one of confidence 1 none is higher: neither
    these nor what holds them can be a rule that stays, so all others are found without them.
    """
    total = labelled.count()
    each = F.posexplode(F.array_distinct("items")).alias("at", "token")
    rows = durable(labelled.groupBy("items", "verdict").agg(F.count("*").alias("n")).withColumn("row", F.monotonically_increasing_id()), "labelled")
    often = _counted(rows.select("verdict", "n", each).select("verdict", "n", F.array("token").alias("items")), support * total).select(F.get("items", F.lit(0)).alias("token"))
    # Labelled urls that differ in rare tokens alone are one row from here on.
    rows = rows.select("row", "verdict", "n", each).join(durable(often, "often"), "token").groupBy("row", "verdict", "n").agg(F.array_sort(F.collect_list("token")).alias("items"))
    rows = durable(rows.groupBy("items", "verdict").agg(F.sum("n").alias("n")).withColumn("row", F.monotonically_increasing_id()), "baskets")
    held = rows.select("row", "verdict", "n", F.explode("items").alias("token")).select("row", "verdict", "n", F.array("token").alias("items"))
    found, live, size = None, None, 1
    while True:
        level = _counted(held, support * total)
        if live is not None:
            less = level.select("items", "n", F.explode("items").alias("token")).select("items", "n", F.array_remove("items", F.col("token")).alias("less"))
            short = live.select(F.col("items").alias("less"), F.col("n").alias("n_less"))
            whole = less.join(short, "less").groupBy("items", "n").agg(F.count("*").alias("k"), F.min("n_less").alias("n_less")).where((F.col("k") == size) & (F.col("n_less") > F.col("n")))
            level = level.join(whole.select("items"), "items", "left_semi")
        level = durable(level, "level")
        found = level if found is None else found.union(level)
        live = level.where("most < n")
        held = durable(held.join(live.select("items"), "items", "left_semi"), "held")
        if held.isEmpty():
            break
        ends = held.select("row", "verdict", "n", F.slice("items", 1, size - 1).alias("same"), F.element_at("items", -1).alias("last"))
        pairs = ends.join(ends.select("row", "same", F.col("last").alias("next")), ["row", "same"]).where(F.col("last") < F.col("next"))
        held = durable(pairs.select("row", "verdict", "n", F.concat("same", F.array("last", "next")).alias("items")), "grown")
        size += 1
    rules = found.select("items", "n", F.explode("by").alias("x")).where((F.col("x.n") >= support * total) & (F.col("x.n") / F.col("n") >= confidence))
    rules = rules.select("items", "x.verdict", (F.col("x.n") / F.col("n")).alias("confidence"), (F.col("x.n") / F.lit(total)).alias("support"))
    rules = durable(rules, "mined").withColumn("rule_id", F.concat_ws(" ", "items"))
    # A rule one of whose tokens can go without loss of confidence says nothing new.
    shorter = rules.select(F.col("rule_id").alias("less"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    cut = rules.where(F.size("items") > 1).select("rule_id", "verdict", "confidence", F.explode(F.transform("items", lambda x: F.concat_ws(" ", F.array_remove("items", x)))).alias("less"))
    implied = cut.join(shorter, "less").where("verdict = v AND c >= confidence").select("rule_id", "verdict").distinct()
    return rules.join(implied, ["rule_id", "verdict"], "left_anti")


def _counted(held: DataFrame, least: float) -> DataFrame:
    """(items, n, most, by) of `held(items, verdict, n)`: in all, with the most frequent verdict and with each, where one reaches the least."""
    per = held.groupBy("items", "verdict").agg(F.sum("n").alias("n"))
    by = F.collect_list(F.struct("verdict", "n")).alias("by")
    return per.groupBy("items").agg(F.sum("n").alias("n"), F.max("n").alias("most"), by).where(F.col("most") >= least)


def match(pages: DataFrame, rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """(key, mined, mined_rule) of the distinct token sets of `pages(key, items)` with a hit, by the inverted index on the rarest token."""
    df = labelled.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    listed = rules.select("rule_id", "verdict", "confidence", "items", F.explode("items").alias("token")).join(df, "token")
    index = listed.groupBy("rule_id", "verdict", "confidence", "items").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    index = durable(index, "index").withColumnRenamed("items", "needed")
    sets = pages.groupBy("key").agg(F.first("items").alias("items"))
    hits = sets.select("key", "items", F.explode("items").alias("token")).join(index, "token").where(F.size(F.array_except("needed", "items")) == 0)
    rank = F.struct(F.col("confidence"), F.size("needed").alias("n"), (F.col("verdict") == ALLOW).alias("a"), F.col("rule_id"))
    return hits.groupBy("key").agg(F.max_by("verdict", rank).alias("mined"), F.max_by("rule_id", rank).alias("mined_rule"))


def judge(pages: DataFrame, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row of `pages(page_id, url)`: page_id, host, path, rule, verdict and mined_rule."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules)).withColumn("items", tokens(F.col("url"), F.col("host"), F.col("path")))
    key = F.when(F.col("fixed").isNull(), F.md5(F.concat_ws("\x1f", "items").cast("binary")))
    rows = durable(rows.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.col("fixed.verdict").alias("given"), "items", key.alias("key")), "urls")
    labelled = rows.where("given IS NOT NULL").select("items", F.col("given").alias("verdict"))
    free = rows.where("given IS NULL")
    if labelled.isEmpty():
        judged = free.select("*", F.lit(None).cast("string").alias("mined"), F.lit(None).cast("string").alias("mined_rule"))
    else:
        # Written first, so that the join can split the rows of a token set that many urls share.
        judged = free.join(durable(match(free, mine(labelled, support, confidence), labelled), "hits"), "key", "left")
    fixed = rows.where("given IS NOT NULL").select("page_id", "host", "path", "rule", F.col("given").alias("verdict"), F.lit(None).cast("string").alias("mined_rule"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit(ALLOW)).alias("verdict"), "mined_rule").unionByName(fixed)


def op3_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op3_association_rules": op3_association_rules}
ORACLES: dict[str, str] = {}
