"""URL filter: host and path rules, and rules mined from the URLs that those decide.

A listed rule names a host and a path prefix. It fits the host and its subdomains if the path
starts with its own; of several the longest decides. URLs that no listed rule fits are judged by
association rules: the URLs that are decided are the labelled examples, FP-growth finds the
combinations of URL tokens (labels of the host, segments of the path, keys of the query) that come with a verdict,
and those with enough support and confidence become rules, unless a rule with fewer tokens says
the same with no less confidence. An inverted index files each rule under its rarest token, so a
URL meets only rules that share a token with it. The most confident rule decides, then the one
with more support, then the first in order; a URL that no rule fits is allowed.

All examples count. Both mining and matching work on sets of tokens, each counted or matched
once however many URLs have it, and verdicts join back on the set's key.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no tokens;
repeated rows and other columns pass through; without examples there are no mined rules; an
empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tarnish.llm.texts import fresh
from tarnish.session import materialise

#: Least share of the examples (and least number) that a rule's tokens must have, and its confidence.
SUPPORT, EXAMPLES, CONFIDENCE = 0.005, 3, 0.9


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host):]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column, query: Column) -> Column:
    """Host labels, path segments and query keys, numbers alike, as a sorted set."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    keys = F.transform(F.split(query, "[&;]"), lambda x: F.substring_index(x, "=", 1))

    def named(kind: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))
    parts = F.concat(named("path:", F.split(path, "/")), named("query:", keys))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.when(host != "", labels).otherwise(none), parts)))


def listed(rules: list[UrlRule], host: Column, path: Column) -> Column:
    """``(rule, verdict)`` of the longest listed rule that fits, or null."""
    found = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        found = F.when(r.fits(host, path), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found.cast("struct<rule:string,verdict:string>")


def mine(examples: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules ``(tokens, verdict, confidence, support)`` from ``(items, verdict)``, redundant ones left
    out, and the ``(token, class)`` that their tokens stand for.

    A token is frequent only if a share of ``support`` of all examples has it, so at most tokens
    per URL / ``support`` are, whatever the number of URLs. FP-growth writes every combination of
    frequent tokens that enough examples share, so what can't make a difference is taken out first:

    * Tokens of the same examples (the segments of a deep common path) are one item, their class,
      named by its first token. A URL has a class if it has any of its tokens, for each of them
      alone would have made the same rules.
    * A token whose examples all have one verdict is a rule by itself, of confidence 1, and any
      longer rule with it would be redundant.
    """
    n = examples.count()
    least = max(support, EXAMPLES / max(n, 1)) * n
    sets = materialise(examples.groupBy("items", "verdict").agg(F.count(F.lit(1)).alias("n")), "sets")
    # tokens with the same examples agree in the number, the sum and the exclusive or of their sets' hashes
    h = F.xxhash64("items", "verdict")
    tokens = sets.select("verdict", "n", h.alias("h"), F.explode("items").alias("token")).groupBy("token").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets"), F.sum(F.col("h").cast("decimal(20,0)")).alias("sum"),
        F.bit_xor("h").alias("xor"), F.min("verdict").alias("verdict"), (F.min("verdict") == F.max("verdict")).alias("pure"))
    tokens = materialise(tokens.where(F.col("n") >= least - 1e-9), "tokens")
    pure = tokens.where("pure").select(F.array("token").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), (F.col("n") / F.lit(float(max(n, 1)))).alias("support"))
    mixed = tokens.where("not pure")
    classes = mixed.groupBy("sets", "sum", "xor").agg(F.min("token").alias("class"), F.collect_list("token").alias("tokens"))
    members = materialise(classes.select(F.explode("tokens").alias("token"), "class").union(
        tokens.where("pure").select("token", F.col("token").alias("class"))), "members")
    kept = members.join(mixed.select("token"), "token", "left_semi")
    of_set = sets.select("items").distinct().select("items", F.explode("items").alias("token")).join(kept, "token").groupBy("items").agg(
        F.collect_set("class").alias("classes"))
    label = F.concat(F.lit("is:"), F.col("verdict"))
    baskets = examples.join(of_set, "items").select(F.array_append("classes", label).alias("items"))
    schema = "tokens array<string>, verdict string, confidence double, support double"
    if of_set.isEmpty():
        return materialise(pure.select(*[c.split()[0] for c in schema.split(", ")]), "pruned"), members
    # FP-growth takes its shares from the baskets it is given
    given = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / given), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("is:")).select(
        F.array_sort("antecedent").alias("tokens"), F.substr(F.col("consequent")[0], F.lit(4)).alias("verdict"),
        "confidence", (F.col("support") * (given / n)).alias("support"))
    rules = materialise(rules, "rules")
    # a shorter rule inside a longer one, with the same verdict and no less confidence
    longer = rules.select(F.col("tokens").alias("items"), F.col("verdict").alias("own"), F.col("confidence").alias("own_confidence"))
    redundant = matches(longer, index(rules)).where(
        (F.size("tokens") < F.size("items")) & (F.col("verdict") == F.col("own")) & (F.col("confidence") >= F.col("own_confidence")))
    redundant = redundant.select(F.col("items").alias("tokens"), F.col("own").alias("verdict")).distinct()
    return materialise(rules.join(redundant, ["tokens", "verdict"], "left_anti").unionByName(pure), "pruned"), members


def index(rules: DataFrame) -> DataFrame:
    """The rules, each filed under the token that the fewest rules have."""
    each = rules.withColumn("token", F.explode("tokens"))
    common = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(common, "token").groupBy("tokens", "verdict", "confidence", "support").agg(
        F.min(F.struct("n", "token")).alias("by"))
    return materialise(rarest.select(F.col("by.token").alias("token"), "tokens", "verdict", "confidence", "support"), "index")


def matches(sets: DataFrame, filed: DataFrame) -> DataFrame:
    """Every set of tokens (``items``) with every rule whose tokens it has."""
    met = sets.withColumn("token", F.explode("items")).join(filed, "token").drop("token")
    return met.where(F.size(F.array_except("tokens", "items")) == 0)


def decide(pages: DataFrame, rules: list[UrlRule], url: str = "url", support: float = SUPPORT,
           confidence: float = CONFIDENCE, default: str = "allow", out: str = "decision") -> DataFrame:
    """``pages`` with a struct ``out``: ``host``, ``path``, ``rule`` (listed, or null), ``verdict``,
    and ``mined``, the tokens of the mined rule that decided."""
    columns = [c for c in pages.columns if c != out]
    u = F.col(f"`{url}`").cast("string")
    own = fresh("_url", columns)
    seen = pages.select(*[F.col(f"`{c}`") for c in columns], F.struct(host_of(u).alias("host"), path_of(u).alias("path")).alias(own))
    host, path = F.col(f"{own}.host"), F.col(f"{own}.path")
    l, t = fresh("_listed", [*columns, own]), fresh("_tokens", [*columns, own])
    seen = seen.withColumn(l, listed(rules, host, path)).withColumn(t, tokens_of(host, path, query_of(u)))
    facts = materialise(seen.select(F.col(f"{l}.verdict").alias("verdict"), F.col(t).alias("items")), "urls")
    mined, members = mine(facts.where("verdict is not null"), support, confidence)
    # a set's classes, and the token by which it has each of them
    undecided = facts.where("verdict is null").select("items").distinct().select("items", F.explode("items").alias("token"))
    by_class = undecided.join(members, "token").groupBy("items", "class").agg(F.min("token").alias("token"))
    undecided = by_class.groupBy(F.col("items").alias("urls")).agg(
        F.collect_list("class").alias("items"), F.map_from_entries(F.collect_list(F.struct("class", "token"))).alias("by"))
    own_tokens = F.array_sort(F.transform("tokens", lambda c: F.col("by")[c])).alias("tokens")
    best = matches(undecided, index(mined)).groupBy(F.col("urls").alias("items")).agg(F.min(F.struct(
        (-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), own_tokens, "verdict")).alias("best"))
    m = fresh("_mined", [*columns, own, l, t])
    found = materialise(best.select(F.struct("items", F.col("best.tokens").alias("tokens"), F.col("best.verdict").alias("verdict")).alias(m)), "verdicts")
    return seen.join(found, F.col(f"{l}.verdict").isNull() & (F.col(t) == F.col(f"{m}.items")), "left").select(
        *[F.col(f"`{c}`") for c in columns], F.struct(
            host.alias("host"), path.alias("path"), F.col(f"{l}.rule").alias("rule"),
            F.coalesce(F.col(f"{l}.verdict"), F.col(f"{m}.verdict"), F.lit(default)).alias("verdict"),
            F.col(f"{m}.tokens").alias("mined")).alias(out))
