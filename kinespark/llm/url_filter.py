"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over "host path" (host, one space, path) with the literal tokens that
any match must hold whole. The corpus counts how often each such token occurs; each rule is filed under
its rarest one. The tokens of a URL fetch the candidate rules, and only those run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile(r"[^./\s?#&=_\-]+")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    pattern: str  # a regular expression over "host path"
    tokens: tuple[str, ...] = field(default=())  # literals of which any match holds each as a whole token
    weight: int = 0  # of the rules that fit, the heaviest wins; then that of the greatest name, then block before allow

    @staticmethod
    def prefix(verdict: str, text: str) -> Rule:
        """host/path: fits the host and all its subdomains where the path starts with the rule's."""
        host, slash, rest = text.partition("/")
        path = slash + rest
        literal = TOKEN.findall(host) + TOKEN.findall(path[: max((path.rfind(c) for c in "/._-&="), default=-1) + 1])
        # no host holds a slash and every path starts with one, so the host of the pattern is the end of the URL's host
        return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)} (?=/|\Z){re.escape(path)}", tuple(literal), len(text))


#: The method's own rules, for URLs that no list rule fits: paths of adult, gambling, tracking and parked pages.
METHOD_RULES = tuple(Rule(f"~{word}", "block", rf"(?:^|[./\s_\-=&]){word}(?:$|[./\s_\-=&])", (word,)) for word in ("porn", "xxx", "casino", "betting", "viagra", "adserver", "doubleclick", "clickbank", "warez", "torrents"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first "://" up to / ? # or the end, A-Z lower-cased; then up to ? or #."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rarest_tokens(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by their rarest token in ``urls(host, path)``; '' holds those without any."""
    wanted = sorted({t for r in rules for t in r.tokens})
    spark = urls.sparkSession
    counts: dict[str, int] = {}
    if wanted:
        tokens = F.split(F.concat_ws(" ", "host", "path"), r"[./\s?#&=_\-]+")
        small = spark.createDataFrame([(t,) for t in wanted], "token string")  # as many rows as the rules have literals
        seen = urls.select(F.explode(F.array_distinct(tokens)).alias("token")).join(F.broadcast(small), "token")
        counts = {r[0]: r[1] for r in seen.groupBy("token").count().collect()}
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(rarest, []).append(rule)
    return index


def judge(host: str, path: str, index: dict[str, list[Rule]], compiled: dict[str, re.Pattern]) -> Rule | None:
    """The winning rule: heaviest, then of the greatest name, then block before allow."""
    line = f"{host} {path}"
    best = None
    for token in dict.fromkeys([*TOKEN.findall(line), ""]):
        for rule in index.get(token, ()):
            if (best is None or (rule.weight, rule.name, rule.verdict) > (best.weight, best.name, best.verdict)) and compiled[rule.pattern].search(line):
                best = rule
    return best


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url", *, method_rules: tuple[Rule, ...] = METHOD_RULES, default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """One row for each row of ``pages``: ``id_col``, host, path, rule (of ``rules``, else null), verdict
    (the rule's; else that of a method rule that fits, else ``default``) and method_rule (its name, or null).

    A null URL or one without "://" has an empty host and path and fits no rule. Of rules of equal weight the greatest name
    wins, and block of one name. Rows that repeat are returned each; other columns are ignored. The rules travel
    with the task, so their number is checked against ``max_rules``.
    """
    if len(rules) + len(method_rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} travel with each task")
    host, path = url_parts(F.col(url_col))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    lists, own = rarest_tokens(base, rules), rarest_tokens(base, method_rules)

    def run(batches):
        compiled = {r.pattern: re.compile(r.pattern) for r in (*rules, *method_rules)}
        for batch in batches:
            out: list[list] = [[], [], []]
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rule = judge(h, p, lists, compiled)
                method = judge(h, p, own, compiled) if rule is None else None
                out[0].append(rule and rule.name)
                out[1].append((rule or method).verdict if rule or method else default)
                out[2].append(method and method.name)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.string()) for x in out]], ["id", "host", "path", "rule", "verdict", "method_rule"])

    kind = dict(pages.dtypes)[id_col]
    return base.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, method_rule string").withColumnRenamed("id", id_col)
