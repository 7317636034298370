"""URL filter: explicit host-and-path rules, then association rules mined by FP-growth.

Every URL is a set of tokens: scheme, the host and each of its parent domains, all path segments
(the first told from the others), the file extension, query keys and whether there is a fragment.
Rules are mined from the labelled pages and pruned by support and confidence alone:

1. A token that tells by itself is a rule, and takes no part in longer ones, which would be redundant.
   Tokens of all labelled pages tell nothing and are left out; tokens of the same labelled pages are
   mined as one item, for which any of them stands.
2. FP-growth mines the sets of the other items that occur together with the label "unwanted". Item sets
   of a basket can double with each item, so its support is raised, by factors of two, until no basket
   holds more than MAX_ITEMS items that reach it; no basket is cut.
3. Where the support was raised, the sets between it and the true support are searched too: pages are
   projected on each item, as FP-growth does, and sets grow in tasks by branch and bound. Only branches
   that can hold no rule, or only rules that contain another, are left out, so no rule is lost. A task's
   memory is bounded; its time is not, as the sets of long baskets of independent tokens are too many.
4. A rule is dropped if a shorter one is contained in it, which fires wherever it does.

A rule has to hold on min_pages unwanted pages at least, whatever the share, so that no token of a few
pages is learned by heart; with fewer labelled pages nothing is mined and all is allowed.

Matching joins the tokens of the different URLs with the inverted index token -> rule; a rule fires when
as many of its items as it has are met. The same join prunes rules that contain another.

Rows: a null URL, or one without "://", has an empty host and path and is judged by the mined rules
on no tokens, so it is allowed. Very long URLs are read whole. Null labels are left out; a page labelled
more than once is unwanted if any of its labels says so. Repeated rows are judged each by itself; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm.common import FEW, UPPER, Scratch, columns_free_of

#: Items that a basket may hold when FP-growth starts.
MAX_ITEMS = 16
#: Pages times items, and items of all pages, that a task may search; more are projected on one more item.
MAX_CELLS = 1 << 22
UNWANTED = "label:unwanted"


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, an empty array for none."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.lit(64)), ".")))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    tokens = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1))),
        domains,
        F.transform(segments, lambda x, i: F.concat(F.when(i == 0, F.lit("path0:")).otherwise(F.lit("path:")), x)),
        F.when(F.regexp_like(path, F.lit(r"\.[A-Za-z0-9]{1,5}$")), F.array(F.concat(F.lit("ext:"), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)))).otherwise(F.array()),
        keys,
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array()),
    )
    return F.when(host != "", F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def _few(df: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def mine(scratch: Scratch, pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_pages: int = 20, min_confidence: float = 0.8) -> DataFrame:
    """The pruned rules as an inverted index: (token, rule, item, items). A rule of `items` items fires on
    a set that holds, for each of its items, one of the tokens listed with it."""
    judged = labels.filter("unwanted is not null").groupBy("item").agg(F.max("unwanted").alias("unwanted"))
    baskets = scratch.save(pages.join(judged, pages.page_id == judged.item).select(F.monotonically_increasing_id().alias("basket"), "tokens", "unwanted"))
    n = baskets.count()
    least = max(min_pages, math.ceil(min_support * n))
    each = baskets.select("basket", F.explode("tokens").alias("token"), F.col("unwanted").cast("int").alias("bad"))
    # which pages a token is on, as a sum of their hashes; a token on fewer unwanted pages is in no rule
    pages_of = [F.sum(F.xxhash64(F.lit(k), "basket").cast("decimal(38,0)")).alias(f"pages_{k}") for k in range(2)]
    extents = scratch.save(each.groupBy("token").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"), *pages_of).filter(F.col("bad") >= least))
    alike = extents.groupBy("n", "bad", "pages_0", "pages_1").agg(F.min("token").alias("item"))
    named = scratch.save(extents.join(alike, ["n", "bad", "pages_0", "pages_1"]).select("token", "item", "n", "bad"))
    alone = F.col("bad") >= F.lit(min_confidence) * F.col("n")
    single = named.filter(alone).select("item").distinct().select(F.array("item").alias("antecedent"))
    open_ = _few(scratch.save(named.filter(~alone & (F.col("n") < n)).select("token", "item", "bad")))
    items = scratch.save(each.withColumnRenamed("bad", "unwanted").join(open_, "token").select("basket", "item", "unwanted", "bad").distinct())
    raised = least
    while items.filter(F.col("bad") >= raised).groupBy("basket").count().filter(F.col("count") > MAX_ITEMS).limit(1).count():
        raised *= 2
    found = items.filter(F.col("bad") >= raised).groupBy("basket", "unwanted").agg(F.collect_list("item").alias("items"))
    found = found.select(F.when(F.col("unwanted") == 1, F.array_append("items", F.lit(UNWANTED))).otherwise(F.col("items")).alias("items"))
    mined = single
    if not found.isEmpty():
        # baskets without an item count for no rule, so supports are taken of those that have some
        share = (raised - 0.5) / max(1, found.count())
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, share), minConfidence=min_confidence).fit(found)
        mined = mined.unionByName(model.associationRules.filter(F.element_at("consequent", 1) == UNWANTED).select("antecedent"))
    if raised > least:
        mined = mined.unionByName(searched(scratch, items, least, min_confidence))
    rules = scratch.save(mined.select(F.array_sort("antecedent").alias("antecedent")).distinct().select(F.xxhash64("antecedent").alias("rule"), "antecedent"))
    by_item = scratch.save(rules.select("rule", F.explode("antecedent").alias("token"), F.size("antecedent").alias("items")).withColumn("item", F.col("token")))
    longer = fired(rules.select(F.col("rule").alias("key"), F.col("antecedent").alias("tokens")), by_item, but_itself=True)
    kept = by_item.join(longer.withColumnRenamed("key", "rule"), "rule", "left_anti").drop("token")
    return scratch.save(kept.join(named.select("token", "item"), "item").select("token", "rule", "item", "items"))


def searched(scratch: Scratch, items: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """(antecedent): every set of items on `least` unwanted pages or more that reaches min_confidence and
    contains no other such set; some that do contain one may be among them.

    Pages are projected on each of their items: the item and those after it, the rarest first. A projection
    of more than MAX_CELLS is projected again.
    """
    row, out = ["prefix", "items"], None
    sums = [F.sum("bad").alias("bad"), F.sum("good").alias("good")]
    listed = items.groupBy("basket", "unwanted").agg(F.array_sort(F.collect_list(F.struct("bad", "item"))).alias("items"))
    pages = listed.select(F.array().cast("array<string>").alias("prefix"), F.col("items.item").alias("items"), F.col("unwanted").cast("bigint").alias("bad"), (1 - F.col("unwanted")).cast("bigint").alias("good"))
    pages = scratch.save(pages.groupBy(*row).agg(*sums))

    def sets(table: pa.Table) -> pa.Table:
        prefix = table["prefix"][0].as_py()
        names, lists = np.unique(np.array(table["items"].combine_chunks().flatten().to_pylist(), dtype=object), return_inverse=True)
        bad, good = table["bad"].to_numpy(), table["good"].to_numpy()
        rows = np.repeat(np.arange(len(table)), np.asarray(pc.list_value_length(table["items"])))
        often = np.bincount(lists, bad[rows]) >= least
        rows, lists, names = rows[often[lists]], (np.cumsum(often) - 1)[lists[often[lists]]], names[often]
        has = np.zeros((len(table), len(names)), bool)
        has[rows, lists] = True
        grown = branch_and_bound(has, bad, good, least, min_confidence)
        return pa.table({"antecedent": pa.array([prefix + names[list(s)].tolist() for s in grown], pa.list_(pa.string()))})

    while not pages.isEmpty():
        after = pages.select("*", F.posexplode("items").alias("at", "item"))
        after = after.select(F.array_append("prefix", F.col("item")).alias("prefix"), F.expr("slice(items, at + 2, size(items))").alias("items"), "bad", "good")
        pages = scratch.save(after.groupBy(*row).agg(*sums))
        often = pages.select("prefix", F.explode("items").alias("item"), "bad").groupBy("prefix", "item").agg(F.sum("bad").alias("bad")).filter(F.col("bad") >= least)
        whole = pages.groupBy("prefix").agg(*sums, F.count(F.lit(1)).alias("n"), F.sum(F.size("items")).alias("held")).filter(F.col("bad") >= least)
        sizes = whole.join(often.groupBy("prefix").agg(F.count(F.lit(1)).alias("wide")), "prefix", "left")
        is_rule = F.col("bad") >= F.lit(min_confidence) * (F.col("bad") + F.col("good"))
        sizes = scratch.save(sizes.select("prefix", is_rule.alias("is_rule"), F.col("wide").isNull().alias("ends"), ((F.col("n") * F.col("wide") > MAX_CELLS) | (F.col("held") > MAX_CELLS)).alias("large")))
        open_ = sizes.filter("not is_rule and not ends")
        small = pages.join(open_.filter("not large").select("prefix"), "prefix")
        grown = small.groupBy("prefix").applyInArrow(sets, "antecedent array<string>")
        found = scratch.save(sizes.filter("is_rule").select(F.col("prefix").alias("antecedent")).unionByName(grown))
        out = found if out is None else out.unionByName(found)
        pages = scratch.save(pages.join(open_.filter("large").select("prefix"), "prefix"))
    return out


def branch_and_bound(has: np.ndarray, bad: np.ndarray, good: np.ndarray, least: int, min_confidence: float):
    """The sets of columns that hold on `least` bad rows or more with min_confidence, without any that contains
    another with the same first choices; the empty set is not asked for. Row i of has stands for bad[i] and
    good[i] pages.

    Sets grow along the good row that lacks the fewest open columns: a set keeps that row, or holds one of
    them. A branch ends where a bound shows that more good rows stay than the bad ones allow: a set of
    columns x leaves at least sum p (1 - x's columns lacking) good ones, 0 <= p <= 1, and at most
    sum (1 - the share of a row's lacking columns in x) bad ones; the linear problem's dual is tried for a few
    p and multipliers.
    """
    ratio = (1 - min_confidence) / min_confidence
    at = np.array([0, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4])[:, None]

    def hopeless(no_bad, bad, no_good, good) -> bool:
        few, most = no_good.sum(1), ratio * bad.sum()
        cost = (bad / np.maximum(no_bad.sum(1), 1)) @ no_bad
        for p in (few <= i for i in (0, 1, 2, 3, 4, 6)):
            gain = (good * p) @ no_good
            if (most - (good * p).sum() + at[:, 0] * (bad.sum() - least) + np.maximum(gain - (ratio + at) * cost, 0).sum(1) < -1e-6).any():
                return True
        return False

    def grow(chosen, no_bad, bad, no_good, good, columns):
        """Smaller branches one after the other; this one goes on without the columns they have chosen."""
        while True:
            # a column that takes no good row only makes a rule longer
            keep = (bad.sum() - bad @ no_bad >= least) & (good @ no_good > 0)
            no_bad, no_good, columns = no_bad[:, keep], no_good[:, keep], columns[keep]
            if not len(columns) or hopeless(no_bad, bad, no_good, good):
                return
            few = no_good.sum(1)
            of = np.nonzero(no_good[np.where(few > 0, few, np.inf).argmin()])[0]
            left = np.ones(len(columns), bool)
            for j in of[np.argsort(-(good @ no_good[:, of]), kind="stable")]:
                left[j] = False
                b, g = no_bad[:, j] == 0, no_good[:, j] == 0
                yield (*chosen, int(columns[j])), no_bad[b][:, left], bad[b], no_good[g][:, left], good[g], columns[left]
            no_bad, no_good, columns = no_bad[:, left], no_good[:, left], columns[left]

    no = (~has).astype(np.float64)
    stack = [grow((), no[bad > 0], bad[bad > 0], no[good > 0], good[good > 0], np.arange(has.shape[1]))]
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        chosen, _, b, _, g, _ = node
        if b.sum() >= min_confidence * (b.sum() + g.sum()):
            yield chosen
        else:
            stack.append(grow(*node))


def fired(sets: DataFrame, index: DataFrame, but_itself: bool = False) -> DataFrame:
    """The keys of the sets (key, tokens) on which a rule of the saved index fires; but_itself leaves out
    the rule that has the set's key."""
    met = sets.select("key", F.explode("tokens").alias("token")).join(_few(index), "token")
    if but_itself:
        met = met.filter("key <> rule")
    whole = met.groupBy("key", "rule", "items").agg(F.count_distinct("item").alias("met")).filter("met = items")
    return whole.select("key").distinct()


def explicit(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule that fits; null where none does.

    rules: (verdict, "host/path"); a rule fits its host and all subdomains, by path prefix.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        on, _, below = text.partition("/")
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit("/" + below))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def filter_urls(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages. labels: (item, unwanted boolean)."""
    slim = columns_free_of(pages, id_col, url_col).toDF("page_id", "url")
    slim = slim.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    slim = slim.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    scratch = Scratch(spark, "urls")
    index = mine(scratch, slim, labels, **options)
    # each different set of tokens is matched once
    slim = slim.withColumn("key", F.xxhash64("tokens"))
    hit = scratch.save(fired(slim.filter(F.size("tokens") > 0).select("key", "tokens").dropDuplicates(["key"]), index))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("fires"), F.lit("block")).otherwise(F.lit("allow"))
    judged = slim.join(_few(hit).withColumn("fires", F.lit(True)), "key", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
