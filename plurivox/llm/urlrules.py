"""URL filter by association rules, in DataFrame functions and Spark's own FP-growth.

The tokens of a URL are the labels and the suffix of its host, the segments of its path (digits as 0), the suffix of its
file, and the keys and key=value pairs of its query, each with a mark of its kind. FP-growth mines token combinations
of the labelled URLs that no site rule decides. A rule `tokens -> bad` stays when its confidence reaches the bound, when
it is no chance find (by the Chernoff bound of the binomial tail at the base rate, times the number of combinations tried, at most
`CHANCE`), when no part of its tokens is a rule of at least its confidence, and, of rules that match the same URLs, if it is the
shortest. Rules match through an inverted index: each is found under its rarest token, and matches where all its tokens
are in the URL.

A combination counts from `MIN_COUNT` labelled URLs on, however large the table. All tokens of a URL enter, of those in the same URLs one. FP-growth lists all combinations of
what enters, so a table with a URL of more than `ITEMS` tokens that often are bad is mined token by token instead, and only combinations that can be rules
of their own grow: those in fewer URLs than each of their parts, no part of which is in bad URLs alone. Either way these are the combinations tried.

Site rules come first: a listed host fits itself and its subdomains, if the path starts with the listed
path; the longest fitting rule decides. The mined rules decide the rest: block where one matches, else allow.

Defined cases: a URL that is null or without `://` has an empty host and path, no tokens, and is allowed; labels without a URL
and URLs without a label only miss the training; without labels of both kinds no rule is mined; repeated rows and null
ids give one result row each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables, lower_ascii, written

# Fixed site rules: (host, path, verdict).
SITE_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MIN_COUNT = 8
MIN_CONFIDENCE = 0.6
CHANCE = 0.01
#: Tokens of a URL up to which FP-growth lists their combinations; with longer URLs these grow token by token (`grown`).
ITEMS = 12
_ITEMSETS = "tokens array<string>, n long, of long"
#: Rules in the broadcast index at most; FP-growth's support bound keeps them far below, and more are joined by a shuffle.
BROADCAST_RULES = 100_000
_BAD = "\x00bad"


def host_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    host = lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def site_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or null."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(SITE_RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    full = lambda x: F.length(x) > 0
    marked = lambda mark, xs: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
    words = marked("h=", F.filter(F.split(host, r"[.\-:@]"), full))
    segments = marked("p=", F.transform(F.filter(F.split(path, "/"), full), lambda x: F.regexp_replace(x, "[0-9]+", "0")))
    suffix = marked("e=", F.filter(F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)), full))
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1), "[&;]"), full)
    keys = marked("q=", F.transform(query, lambda x: F.substring_index(x, "=", 1)))
    site = F.array(F.concat(F.lit("s="), F.substring_index(host, ".", -3)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(words, site, segments, suffix, keys, marked("v=", query))))


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """row, rule_id of each of the `rows` (row, have) and each of the `rules` (rule_id, tokens) that matches it."""
    keyed = rules.select("rule_id", "tokens", F.explode("tokens").alias("token"))
    often = keyed.groupBy("token").agg(F.count("*").alias("n"))
    index = keyed.join(often, "token").groupBy("rule_id").agg(F.first("tokens").alias("need"), F.min_by("token", F.struct("n", "token")).alias("token"))
    if rules.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    found = rows.select("row", "have", F.explode("have").alias("token")).join(index, "token")
    return found.where(F.size(F.array_except("need", "have")) == 0).select("row", "rule_id")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """row, have (tokens), bad: the labelled URLs that no site rule decides; a page is bad where its label has low quality or is toxic."""
    host, path = host_path(F.col("url"))
    is_bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    bad = known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(is_bad.cast("int")).alias("bad"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.where(site_rule(F.col("host"), F.col("path"))[1].isNull()).select("page_id", tokens(F.col("url"), F.col("host"), F.col("path")).alias("have")).join(bad, "page_id")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "have", "bad"), "url-labelled")


def itemsets(seen: DataFrame, min_count: int) -> DataFrame:
    """tokens (sorted), of (labelled URLs with all of them), n (bad ones) of each combination with at least `min_count` bad URLs; where a URL has more than
    `ITEMS` tokens that often are bad, of the combinations that `grown` needs."""
    own = seen.select("row", "bad", F.explode("have").alias("token"))
    often = own.groupBy("token").agg(F.sum("bad").alias("n")).where(F.col("n") >= min_count).select("token")
    chosen = own.join(often, "token").groupBy("row", "bad").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    chosen = written(chosen, "url-items")
    total, widest = chosen.agg(F.count("*"), F.max(F.size("tokens"))).first()
    if not total:
        return seen.sparkSession.createDataFrame([], _ITEMSETS)
    if widest > ITEMS:
        return grown(chosen, min_count)
    baskets = chosen.select(F.when(F.col("bad") == 1, F.concat("tokens", F.array(F.lit(_BAD)))).otherwise(F.col("tokens")).alias("items"))
    # a little less than the bound, so that rounding loses none
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_count - 0.5) / total)).fit(baskets).freqItemsets.withColumn("bad", F.array_contains("items", _BAD))
    whole = found.where("bad").select(F.array_sort(F.array_remove("items", _BAD)).alias("tokens"), F.col("freq").alias("n")).where(F.size("tokens") > 0)
    parts = found.where("not bad").select(F.array_sort("items").alias("tokens"), F.col("freq").alias("of"))
    return whole.join(parts, "tokens").select("tokens", "n", "of")


def without_twins(seen: DataFrame) -> DataFrame:
    """`seen` with the smallest only of the tokens that occur in the same URLs: the others could only make the same rules with larger tokens."""
    own = seen.select("row", "bad", F.explode("have").alias("token"))
    rows = own.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows"))
    ones = rows.groupBy("n", "rows").agg(F.min("token").alias("token")).select("token")
    return written(own.join(ones, "token", "left_semi").groupBy("row", "bad").agg(F.collect_list("token").alias("have")), "url-twins")


def _parts(found: DataFrame) -> DataFrame:
    """whole, whole_of and tokens: each combination of two tokens or more without one of its tokens."""
    each = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.filter("tokens", lambda _, j: i != j))
    return found.where(F.size("tokens") > 1).select(F.col("tokens").alias("whole"), F.col("of").alias("whole_of"), F.explode(each).alias("tokens"))


def grown(chosen: DataFrame, min_count: int) -> DataFrame:
    """tokens, n, of as `itemsets` has them, of the combinations of `chosen` (bad, tokens) that `needed` leaves, token by token.

    A combination of k + 1 tokens is made of two of k that differ in their last one, where both occur; URLs with equal tokens count as one row. Its parts are
    all needed ones, so that the copies of a long URL do not list its combinations."""
    tables = Tables(chosen.sparkSession, "url-grown")
    rows = tables.write(chosen.groupBy("tokens").agg(F.count("*").alias("of"), F.sum("bad").alias("n")).withColumn("row", F.monotonically_increasing_id()), "rows")
    held = rows.select("row", "n", "of", F.explode("tokens").alias("token")).select("row", "n", "of", F.array("token").alias("tokens"))
    found, open_ = chosen.sparkSession.createDataFrame([], _ITEMSETS), None
    while True:
        held = tables.write(held, "held")
        sums = tables.write(held.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("of").alias("of")).where(F.col("n") >= min_count), "sums")
        if open_ is not None:
            larger = _parts(sums).join(open_.select("tokens", F.col("of").alias("part_of")), "tokens").where("part_of > whole_of")
            full = larger.groupBy(F.col("whole").alias("tokens")).agg(F.count("*").alias("parts")).where(F.col("parts") == F.size("tokens"))
            sums = tables.write(sums.join(full.select("tokens"), "tokens", "left_semi"), "level")
        found, open_ = found.unionByName(sums), sums.where("n < of")
        if open_.isEmpty():
            return found
        last, head = F.element_at("tokens", -1), F.slice("tokens", 1, F.size("tokens") - 1)
        ends = held.join(open_.select("tokens"), "tokens", "left_semi").select("row", head.alias("head"), "n", "of", last.alias("last"))
        more = ends.join(ends.select("row", "head", F.col("last").alias("next")), ["row", "head"]).where("last < next")
        held = more.select("row", "n", "of", F.concat("head", F.array("last", "next")).alias("tokens"))


def needed(found: DataFrame, total: int) -> DataFrame:
    """The combinations of `found` that can be rules of their own: those in fewer of the `total` URLs than each of their parts (else the part has their
    confidence), no part of which is in bad URLs alone (its confidence is not exceeded)."""
    useless = _parts(found).join(found, "tokens").where("of = whole_of or n = of").select(F.col("whole").alias("tokens")).distinct()
    return found.where((F.size("tokens") > 1) | (F.col("of") < total)).join(useless, "tokens", "left_anti")


def mine(pages: DataFrame, labels: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule_id, tokens, confidence, n (bad URLs), of (labelled URLs): kept rules `tokens -> bad`."""
    seen = labelled(pages, labels)
    total, bad = seen.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not 0 < bad < total:
        return pages.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double, n long, of long")
    found = written(needed(written(itemsets(without_twins(seen), min_count), "url-itemsets"), total), "url-needed")
    tried, base = max(1, found.count()), bad / total
    c = F.col("confidence")
    # n bad ones of `of` by chance: at most exp(-of * divergence of the confidence from the base rate)
    divergence = c * F.log(c / base) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - base))).otherwise(0.0)
    rules = found.withColumn("confidence", F.col("n") / F.col("of")).where((c >= min_confidence) & (c > base) & (F.col("of") * divergence >= F.log(F.lit(tried / CHANCE))))
    rules = written(rules.withColumn("rule_id", F.xxhash64("tokens")), "url-candidates")
    # a rule's tokens are matched like a URL's by the rules that are parts of it
    inside = matches(rules.select(F.col("rule_id").alias("row"), F.col("tokens").alias("have")), rules).where("row != rule_id")
    parts = inside.join(rules.select("rule_id", "confidence"), "rule_id").join(rules.select(F.col("rule_id").alias("row"), c.alias("whole")), "row")
    implied = parts.where(c >= F.col("whole")).select(F.col("row").alias("rule_id")).distinct()
    rules = written(rules.join(implied, "rule_id", "left_anti"), "url-minimal")
    covered = matches(seen, rules).groupBy("rule_id").agg(F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows"))
    one = rules.join(covered, "rule_id").groupBy("rows", "n", "of").agg(F.min(F.struct(F.size("tokens").alias("size"), "tokens", "rule_id", "confidence")).alias("r"))
    return one.select("r.rule_id", "r.tokens", "r.confidence", "n", "of")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (matched mined rules)."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    text, verdict = site_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", text.alias("rule"), verdict.alias("listed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("have"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    mined = matches(rows, rules).groupBy("row").agg(F.count("*").alias("mined"))
    out = rows.join(mined, "row", "left").withColumn("mined", F.coalesce("mined", F.lit(0)))
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("mined") > 0, "block").otherwise("allow")).alias("verdict"), "mined")
