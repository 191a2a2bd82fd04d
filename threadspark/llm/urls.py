"""URL filters: pattern rules found through their rarest literal token.

A rule's whole tokens are known before any URL is read. The corpus counts of these tokens name the rarest one of
each rule; a URL's tokens fetch the rules indexed under them, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import UPPER, LOWER


@dataclass(frozen=True)
class Rule:
    """``host/path`` fits the host and its subdomains when the path starts so; with ``word`` set, any URL with that word in its host."""

    name: str
    verdict: str
    layer: int = 0  # rules of a lower layer win over those of a higher one

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, path = self.name.partition("/")
        return host.translate(str.maketrans(UPPER, LOWER)), slash + path

    @property
    def regex(self) -> str:
        """Matches the hosts; a host may hold any characters, line feeds included."""
        host, _ = self.parts
        if host.startswith("*"):
            return rf"(?s)(?<![a-z0-9]){_literal(host.strip('*'))}(?![a-z0-9])"
        return rf"(?s)^(?:.*\.)?{_literal(host)}\z"

    @property
    def tokens(self) -> list[str]:
        """Lower-case tokens that every URL the rule fits has as whole tokens."""
        host, path = self.parts
        whole = path[: max(path.rfind(c) for c in "/.-_") + 1] if re.search("[/._-]", path) else ""
        return sorted(set(re.findall("[a-z0-9]+", host + " " + whole.lower())))


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\n])", r"\\\1", text)


#: The rules of the query.
RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
#: The method's own list: words of hosts that sell or cheat.
OWN_RULES = tuple(
    Rule(f"*{word}*", "block", 1)
    for word in ("casino", "cheap-pills", "click-bait", "free-money", "porn", "spam-farm", "viagra", "warez", "xxx")
)
TOKENS = "[^a-z0-9]+"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    lowered = F.translate(F.concat_ws(" ", host, path), UPPER, LOWER)
    return F.array_distinct(F.array_remove(F.split(lowered, TOKENS), ""))


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...], default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, layer.

    Of the rules that fit, the lowest layer wins, then the longest name, then block before allow, then the name. Without
    one the verdict is ``default`` and rule is null. Null URLs and URLs without ``://`` have an empty host and path and
    are judged alike; repeated rows and ids are judged each. Other columns are not read. The rules are
    given in code and become one literal map from token to rules.
    """
    host, path = split_url(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    words = sorted({t for r in rules for t in r.tokens})
    counts = dict.fromkeys(words, 0)
    if words:
        seen = split.select(F.explode(F.array_intersect(_tokens(F.col("host"), F.col("path")), F.array(*map(F.lit, words)))).alias("token"))
        counts.update({r["token"]: r["count"] for r in seen.groupBy("token").count().collect()})  # one row per token of a rule at most
    index: dict[str, list[Rule]] = {}
    always = []
    for rule in rules:
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts[t], t)), []).append(rule)
        else:
            always.append(rule)

    def packed(some: list[Rule]) -> Column:
        return F.array(*(
            F.struct(F.lit(r.layer).alias("layer"), F.lit(-len(r.name)).alias("order"), F.lit(r.verdict != "block").alias("second"),
                     F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.parts[1]).alias("path"))
            for r in some
        ))

    kind = "array<struct<layer:int,order:int,second:boolean,rule:string,verdict:string,regex:string,path:string>>"
    everywhere = packed(always) if always else F.array().cast(kind)
    if index:
        lookup = F.create_map(*(x for token, some in index.items() for x in (F.lit(token), packed(some))))
        fetched = F.flatten(F.filter(
            F.transform(_tokens(F.col("host"), F.col("path")), lambda t: F.try_element_at(lookup, t)), lambda x: x.isNotNull()
        ))
        judged = split.withColumn("candidates", F.concat(fetched, everywhere))
    else:
        judged = split.withColumn("candidates", everywhere)
    fits = F.filter("candidates", lambda r: F.regexp_like(F.col("host"), r["regex"]) & F.startswith(F.col("path"), r["path"]))
    best = F.array_min(F.transform(fits, lambda r: F.struct(r["layer"], r["order"], r["second"], r["rule"], r["verdict"])))
    return judged.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.layer").alias("layer"),
    )
