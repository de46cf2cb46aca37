"""URL verdicts: host and path rules, and pattern rules indexed by their rarest literal token.

Pattern rules are written as in public block lists: ``||`` anchors at a host or one of its subdomains, ``|`` at either end,
``*`` is any run, ``^`` a separator or the end, a leading ``@@`` marks an exception. Each rule is filed under that one of its literal
tokens which the fewest pages of the corpus hold. A url's tokens fetch the rules filed under them, and only those run
their regular expression. The index is a constant of the plan: its size is that of the rule list, not of the data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The host rules of the contract, as (verdict, host, path).
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

PATTERN_RULES = (
    "||ads.*^",
    "||track.*^",
    "||tracker.*^",
    "||m.*.example.net/de/",
    "/adserver/",
    "/banner/*.gif|",
    "/doorway/",
    "/popunder^",
    "/redirect?url=",
    "/sponsored/",
    "?sessionid=",
    "&sessionid=",
    "?page=*&ref=x|",
    "?utm_source=feed|",
    "?replytocom=",
    "/wp-login.php",
    ".exe|",
    ".zip|",
    "@@||blog.*^utm_source=feed|",
    "@@/robots.txt|",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_TOKEN = ""  # the key of rules without any literal token: every url fetches them


@dataclass(frozen=True)
class PatternRule:
    text: str
    regex: str
    tokens: tuple[str, ...]
    exception: bool


def parse_pattern(text: str) -> PatternRule:
    """A rule of the list as a regular expression over lower-cased urls, with the tokens any url it matches must hold whole."""
    body, exception = (text[2:], True) if text.startswith("@@") else (text, False)
    body = body.translate(str.maketrans(_UPPER, _LOWER))
    begin, end = "", ""
    if body.startswith("||"):
        body, begin = body[2:], r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, begin = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    parts = {"*": "[^\n]*", "^": "(?:[^a-z0-9_.%-]|$)"}
    regex = begin + "".join(parts.get(c, c if c.isalnum() else "\\" + c) for c in body) + end
    whole = []
    for run in re.finditer("[a-z0-9]+", body):
        left = begin != "" if run.start() == 0 else body[run.start() - 1] != "*"
        right = end != "" if run.end() == len(body) else body[run.end()] != "*"
        if left and right:
            whole.append(run.group())
    return PatternRule(text, regex, tuple(dict.fromkeys(whole)), exception)


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered(url), F.lit("[a-z0-9]+"), F.lit(0)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(pages: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many urls hold each of the given tokens, over all pages. One row per token of the rule list comes back."""
    held = pages.select(F.explode(F.array_intersect(url_tokens(F.col("url")), F.lit(tokens))).alias("token"))
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}


def rule_index(rules: list[PatternRule], counts: dict[str, int]) -> dict[str, list[PatternRule]]:
    """Every rule under its rarest token (ties: the longer, then the first in the alphabet)."""
    index: dict[str, list[PatternRule]] = {}
    for rule in rules:
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=_NO_TOKEN)
        index.setdefault(key, []).append(rule)
    return index


def _matches(url: Column, index: dict[str, list[PatternRule]], exception: bool) -> Column:
    """Whether a fetched rule of the given kind matches."""
    filed = {k: [r.regex for r in rules if r.exception == exception] for k, rules in index.items()}
    filed = {k: v for k, v in filed.items() if v}
    if not filed:
        return F.lit(False)
    shelf = F.create_map(*[x for k, v in filed.items() for x in (F.lit(k), F.lit(v))])
    none = F.lit([""]).cast("array<string>")
    keys = F.concat(url_tokens(url), F.lit([_NO_TOKEN]))
    fetched = F.flatten(F.transform(keys, lambda t: F.coalesce(F.element_at(shelf, t), F.slice(none, 1, 0))))
    return F.exists(fetched, lambda regex: F.rlike(lowered(url), regex))


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    The longest fitting host rule decides. Without one, a page is blocked if a pattern rule matches its url and no exception
    rule does. A null url, or one without ``://``, has an empty host and path and no rule; a null url is allowed. Rows
    are judged one by one: repeated rows come back as often, an empty table gives no rows, other columns are ignored.
    """
    parsed = [parse_pattern(t) for t in pattern_rules]
    pages = pages.select("page_id", "url")
    index = rule_index(parsed, token_counts(pages, sorted({t for r in parsed for t in r.tokens})))
    host, path = host_and_path(F.col("url"))
    fits = [
        F.when(
            ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    ]
    by_rule = F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")
    by_pattern = F.when(_matches(F.col("url"), index, False) & ~_matches(F.col("url"), index, True), "block").otherwise("allow")
    return (
        pages.withColumns({"host": host, "path": path})
        .withColumn("_fit", by_rule)
        .select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), by_pattern).alias("verdict"))
    )


def check_sql(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> str:
    """The same by running every rule on every url, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(v)}, {quote(h)}, {quote(p)})" for v, h, p in host_rules)
    lower = f"translate(url, '{_UPPER}', '{_LOWER}')"
    parsed = [parse_pattern(t) for t in pattern_rules]
    any_of = lambda kind: " or ".join(f"regexp_matches({lower}, {quote(r.regex)})" for r in parsed if r.exception == kind) or "false"
    return f"""
        with rules(verdict, h, p) as (values {rows}),
        cut as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
        parts as (
            select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path, row_number() over () n
            from cut),
        fit as (
            select n, arg_max(h || p, length(h || p)) rule, arg_max(verdict, length(h || p)) verdict
            from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by n)
        select page_id, host, path, fit.rule as rule,
               coalesce(fit.verdict, case when ({any_of(False)}) and not ({any_of(True)}) then 'block' else 'allow' end) as verdict
        from parts left join fit using (n)"""
