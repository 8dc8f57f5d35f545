"""URL filter: given rules first, then association rules mined from labelled pages.

Given rules are pairs of host and path. A rule fits its host and all subdomains when the path starts
with the rule's path; the longest one that fits decides.

For all other pages Spark's FP-growth mines combinations of URL tokens (host, its parts and parent
domains, path words, file ending, names of query fields, scheme) together with the label. A rule is a
combination with enough support whose confidence for "block" is high enough; a rule is pruned when a
part of it is at least as confident. Rules are indexed by their rarest token: a URL meets only the
rules that start from one of its tokens, and a rule fits when the URL has all its tokens. URLs with
the same tokens are matched once.

Everything is Spark's own functions. Defined cases: a null URL, or one without "://", has an empty host
and path, no rule and the verdict "allow"; labels of pages that are missing or null are not learned
from; without labels nothing is mined; pages that repeat stay as they are. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import ascii_lower, stage

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Given rules are part of the plan; longer lists belong into a table.
MAX_RULES = 1000
_BLOCK = "verdict=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def given_rule(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} given rules")
    rule = verdict = None
    for kind, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL; numbers in paths are left out."""
    parts = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(parts)
    ends = F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda k: F.concat(F.lit("under="), F.array_join(F.slice(parts, n - k + 1, k), "."))))
    words = F.filter(F.split(ascii_lower(path), r"[/._-]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fields = F.filter(F.split(query, "&"), lambda x: x != "")
    none = F.array().cast("array<string>")
    scheme = F.array(F.concat(F.lit("scheme="), ascii_lower(F.regexp_extract(url, r"^([^:/?#]*)://", 1))))
    every = F.concat(
        scheme,
        F.transform(parts, lambda x: F.concat(F.lit("host="), x)),
        F.coalesce(ends, none),
        F.transform(words, lambda x: F.concat(F.lit("path="), x)),
        F.transform(fields, lambda x: F.concat(F.lit("field="), F.split_part(x, F.lit("="), F.lit(1)))),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(none),
    )
    return F.array_sort(F.array_distinct(every))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``labelled`` has tokens and block (boolean). Gives antecedent, confidence, support, lift."""
    items = labelled.where("block IS NOT NULL AND size(tokens) > 0").select(
        F.when(F.col("block"), F.concat("tokens", F.array(F.lit(_BLOCK)))).otherwise(F.col("tokens")).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(stage(items, "items"))
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(_BLOCK)))
    rules = stage(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support"), "rules")
    # a part of the rule, one token shorter, that is at least as confident makes the rule needless
    shorter = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).select(
        F.col("antecedent").alias("whole"), F.col("confidence").alias("mine"), F.array_remove("antecedent", F.col("token")).alias("antecedent")
    )
    needless = shorter.join(rules.select("antecedent", "confidence"), "antecedent").where("confidence >= mine").select(F.col("whole").alias("antecedent")).distinct()
    return stage(rules.join(needless, "antecedent", "left_anti"), "rules")


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``token_sets`` has distinct arrays tokens. Gives tokens, confidence of the best rule, antecedent."""
    seen = token_sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    keys = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(seen, "token")
    index = keys.groupBy("antecedent", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = stage(index, "index")
    hits = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("tokens").agg(F.max("confidence").alias("confidence"), F.max_by("antecedent", F.struct("confidence", "antecedent")).alias("antecedent"))


def judge(
    pages: DataFrame, labelled: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence and antecedent of the mined
    rule. ``labelled`` has url and block (boolean)."""
    def parts(df: DataFrame, url: str) -> DataFrame:
        return df.withColumn("host", host_and_path(F.col(url))[0]).withColumn("path", host_and_path(F.col(url))[1])

    known = parts(labelled.select("url", "block"), "url").where("host <> ''")
    known = known.select("block", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine(known, min_support, min_confidence)
    rows = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url")
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    tokens = F.when(F.col("host") != "", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    rows = rows.withColumn("rule", rule).withColumn("given", verdict).withColumn("tokens", tokens)
    best = matched(rows.where("rule IS NULL AND tokens IS NOT NULL").select("tokens").distinct(), mined)
    best = stage(best, "matched")
    out = rows.alias("r").join(best.alias("b"), (F.col("r.tokens") == F.col("b.tokens")) & F.col("r.rule").isNull(), "left")
    mined_verdict = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", mined_verdict).alias("verdict"), "confidence", "antecedent")


def labels_of_pages(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """Pages are shown under the number of their document, the last number of the path: url, block
    (low quality or toxic)."""
    rows = pages.select(F.col(url_col).alias("url"))
    number = F.regexp_extract(host_and_path(F.col("url"))[1], r"(\d{1,18})[^0-9]*$", 1)
    rows = rows.select("url", F.when(number != "", number).try_cast("long").alias("doc_id"))
    known = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return rows.join(known, "doc_id").select("url", "block")
