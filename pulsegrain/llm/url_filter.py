r"""URL rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path``. Its literal tokens are runs of ``[A-Za-z0-9]`` that every
matching URL holds as whole tokens. The rule is filed under the one that fewest URLs of the table hold. A URL looks
its own tokens up, and only the rules found there run their expressions. Rules without a whole literal token
run on every URL; they should be few.

Up to ``IN_PLAN`` rules the index is a constant of the plan, and rows are judged where they are read, without a shuffle.
A longer list becomes a table: the distinct URLs' tokens are joined with the rules filed under them, and the first
match of each URL is joined to its rows. Verdicts are the same.

Defined cases: a NULL url or one without ``://`` has an empty host and path, and so only rules that match the empty
string. Equal urls get equal verdicts; row ids are not used, other columns pass through. Among fitting host rules
the longest decides; where none fits, the first pattern rule that matches; else ``default``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrain.llm.common import ascii_lower, fresh

TOKEN = "[A-Za-z0-9]+"
IN_PLAN = 256
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    action: str
    pattern: str
    tokens: tuple[str, ...]
    name: str | None = None  # host rules only


def host_rule(action: str, name: str) -> Rule:
    """``name`` is host and path prefix: it fits the host, its subdomains, and paths that start so."""
    quoted = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", name)
    # The last token of the path may go on in a url, unless something that ends it follows.
    return Rule(action, rf"^([^/]*\.)?{quoted}", tuple(re.findall(rf"{TOKEN}(?=[^A-Za-z0-9])", name)), name)


def pattern_rule(action: str, pattern: str, *tokens: str) -> Rule:
    """``tokens``: whole tokens that every match holds (the caller's promise)."""
    return Rule(action, pattern, tokens)


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, SPLIT, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def own_tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(target, F.lit(TOKEN), F.lit(0)))


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, tuple[int, int]]:
    """For each wanted token: how many rows hold it, and its hash. Its size is that of the rule list."""
    names = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    held = urls.select(F.explode("tokens").alias("token"))
    found = held.join(names, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rows = names.join(found, "token", "left").select("token", "n", F.xxhash64("token").alias("h")).collect()
    return {r.token: (r.n or 0, r.h) for r in rows}


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", in_plan: int = IN_PLAN) -> DataFrame:
    """Add host, path, rule (of a host rule, else NULL) and verdict; existing columns of these names are replaced."""
    rules = sorted((r for r in rules if r.name is not None), key=lambda r: (-len(r.name), r.name)) + [
        r for r in rules if r.name is None]
    if not rules:
        raise ValueError("no rules")
    host, path = host_and_path(F.col(f"`{url}`"))
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = token_counts(pages.select(own_tokens(F.concat(host, path)).alias("tokens")), wanted) if wanted else {}
    filed = [min(r.tokens, key=lambda t: (counts[t][0], t)) if r.tokens else None for r in rules]
    out = pages.withColumn("host", host).withColumn("path", path)
    if len(rules) > in_plan:
        return _judged_by_join(out, rules, filed, default)

    size = 1 << max(1, len(rules)).bit_length()
    slots: list[list[int]] = [[] for _ in range(size)]
    for i, token in enumerate(filed):
        if token is not None:
            slots[counts[token][1] % size].append(i + 1)
    index, always = F.array(*map(_ints, slots)), _ints([i + 1 for i, t in enumerate(filed) if t is None])
    keys, patterns = F.array(*(F.lit(t) for t in filed)), F.array(*(F.lit(r.pattern) for r in rules))

    def filed_under(token: Column) -> Column:
        slot = F.element_at(index, (F.pmod(F.xxhash64(token), F.lit(size)) + 1).cast("int"))
        return F.filter(slot, lambda i: F.element_at(keys, i) == token)

    target = F.concat("host", "path")
    found = F.concat(always, F.flatten(F.transform(own_tokens(target), filed_under)))
    # 0 stands for no rule.
    first = F.coalesce(F.array_min(F.filter(found, lambda i: F.regexp_like(target, F.element_at(patterns, i)))), F.lit(0))
    actions, names = F.array(*(F.lit(r.action) for r in rules)), F.array(*(F.lit(r.name) for r in rules)).cast("array<string>")
    # The matched rule becomes a column of a one-row generator, so that its expressions run once per url.
    one = fresh(out, "_matched_rule")
    out = out.select("*", F.explode(F.array(F.struct(first.alias("i")))).alias(one))
    matched = F.col(f"{one}.i")
    told = F.greatest(matched, F.lit(1))
    return (out.withColumn("rule", F.when(matched > 0, F.element_at(names, told)))
            .withColumn("verdict", F.when(matched > 0, F.element_at(actions, told)).otherwise(F.lit(default))).drop(one))


def _ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<int>")


def _judged_by_join(out: DataFrame, rules: list[Rule], filed: list[str | None], default: str) -> DataFrame:
    """``out`` (with host and path) judged by an index that is a table of (token, number, pattern, action, name)."""
    spark = out.sparkSession
    rows = [(t, i, r.pattern, r.action, r.name) for i, (t, r) in enumerate(zip(filed, rules)) if t is not None]
    index = spark.createDataFrame(rows, "token string, i int, pattern string, action string, name string")
    targets = out.select(F.concat("host", "path").alias("target")).distinct()
    told = F.struct("i", "action", "name")
    found = (targets.select("target", F.explode(own_tokens(F.col("target"))).alias("token")).join(index, "token")
             .where(F.regexp_like("target", F.col("pattern"))).groupBy("target").agg(F.min(told).alias("best")))
    for i, r in enumerate(rules):
        if filed[i] is None:
            one = F.struct(F.lit(i).alias("i"), F.lit(r.action).alias("action"), F.lit(r.name).cast("string").alias("name"))
            hits = targets.where(F.regexp_like("target", F.lit(r.pattern))).select("target", one.alias("best"))
            found = found.unionByName(hits)
    if None in filed:
        found = found.groupBy("target").agg(F.min("best").alias("best"))
    key, best = fresh(out, "_target"), fresh(out, "_best")
    joined = out.withColumn(key, F.concat("host", "path")).join(found.select(F.col("target").alias(key), F.col("best").alias(best)), key, "left")
    verdict = F.coalesce(F.col(f"{best}.action"), F.lit(default))
    joined = joined.withColumn("rule", F.col(f"{best}.name")).withColumn("verdict", verdict)
    return joined.select([*(f"`{c}`" for c in out.columns if c not in ("rule", "verdict")), "rule", "verdict"])
