"""URL verdicts: fixed host-and-path rules first, then association rules mined from labelled pages.

Each URL becomes a set of tokens (host, site, path parts, query names, extension). FP-growth over the token sets of
labelled pages, with a token for a bad label, gives rules `tokens -> bad`. Support is a count of bad pages, the same for
every size of input. Confidence is judged against the share of bad labels among all: the lower end of its Wilson interval
must have at least `min_odds` times the odds of that share (a lift that holds for frequent bad labels, too). Rules are
posted under each of their tokens, and a URL matches a rule when all the rule's postings are found.

Nulls: a null URL, or one without `://`, has an empty host and path and no tokens, so no rule of either kind matches
and it is allowed. Equal URLs are looked up once and get one verdict. No labels give no mined rules; no rows give no
rows. Only the id and URL columns are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrostrat.runtime import stash

BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*(/[^?#]*)", 1), F.lit(""))


def document_of(url: Column) -> Column:
    """The number that a URL's path ends in, with or without an extension (/en/7817, /en/7817.html): the page's document. Null without one."""
    return F.regexp_extract(path_of(url), r"/(\d+)(?:\.\w+)?/?\z", 1).try_cast("long")


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: its host, the host's last two labels, path parts, query names and extension."""
    host = host_of(url)
    at = F.array(F.concat(F.lit("host="), host), F.concat(F.lit("site="), F.substring_index(host, ".", -2)))
    parts = F.transform(F.filter(F.split(path_of(url), "/"), lambda p: p != ""), lambda p: F.concat(F.lit("path="), p))
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), 1), lambda q: F.concat(F.lit("query="), q))
    ending = F.array(F.concat(F.lit("ext="), F.nullif(F.regexp_extract(path_of(url), r"\.(\w+)\z", 1), F.lit(""))))
    return F.when(F.instr(url, "://") > 0, F.array_compact(F.array_distinct(F.concat(at, parts, names, ending))))


def wilson_lower(share: Column, n: Column, z: float) -> Column:
    """The lower end of the Wilson interval of a share of n."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(labelled: DataFrame, min_support: float = 0.0, min_confidence: float = 0.0, min_count: int = 20, min_odds: float = 2.0, z: float = 1.96) -> DataFrame:
    """(rule_id, tokens, confidence, support) for rules that end in a bad label, from (url, bad). `min_count` bad pages hold a rule's tokens at least.
    A rule that holds another one of at least its confidence is left out, as it never decides anything."""
    items = F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    baskets = stash(labelled.filter(tokens_of(F.col("url")).isNotNull()).select(items.alias("items")), "baskets")
    n, n_bad = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", BAD))).first()
    if n_bad < max(1, min_count):
        return labelled.sparkSession.sql("SELECT 0L AS rule_id, cast(array() AS array<string>) AS tokens, 0D AS confidence, 0D AS support LIMIT 0")
    bar = min_odds * n_bad / (min_odds * n_bad + n - n_bad)
    least = max(min_support, (min_count - 0.5) / n)  # FP-growth takes the next whole count
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min(1.0, max(min_confidence, bar))).fit(baskets)
    rules = model.associationRules.filter(F.array_contains("consequent", BAD))
    rules = rules.filter(wilson_lower(F.col("confidence"), F.col("support") * n / F.col("confidence"), z) >= bar)
    rules = stash(rules.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support"), "rules")
    other = rules.select(F.col("tokens").alias("t"), F.col("confidence").alias("c"), F.explode("tokens").alias("token"))
    inside = rules.withColumn("token", F.explode("tokens")).join(other, "token").groupBy("tokens", "t").agg(F.count("*").alias("n"), F.first("confidence").alias("confidence"), F.first("c").alias("c"))
    weaker = inside.filter((F.col("n") == F.size("t")) & (F.size("t") < F.size("tokens")) & (F.col("c") >= F.col("confidence"))).select("tokens").distinct()
    return stash(rules.join(weaker, "tokens", "left_anti").withColumn("rule_id", F.xxhash64("tokens")), "pruned")


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct URLs that hold all tokens of some rule, by an inverted index from token to rules."""
    index = rules.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    posted = urls.filter(F.col("url").isNotNull()).distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    found = posted.join(index, "token").groupBy("url", "rule_id").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    return found.filter(F.col("n") == F.col("need")).select("url").distinct()


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (verdict, host, path prefix) that fits: a struct of its name and verdict, or null."""
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer ones go outside
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        choice = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return choice


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", min_support: float = 0.0, min_confidence: float = 0.0) -> DataFrame:
    """id, host, path, rule, verdict, mined (whether a mined rule matches) of each page."""
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    bad = stash(matched_urls(slim.select("url"), mine_rules(labelled, min_support, min_confidence)), "bad_urls").withColumnRenamed("url", "bad_url")
    met = slim.join(bad, F.col("url") == F.col("bad_url"), "left").withColumn("mined", F.col("bad_url").isNotNull())
    met = met.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    met = met.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow")))
    return met.select(F.col("id").alias(id_col), "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined")
