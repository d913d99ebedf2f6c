"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens that each URL it can match must hold. The
rule is filed under the one of them that the fewest URLs hold, counted over
all URLs. A rule of alternatives is filed under a token of each. The tokens of a URL fetch the rules filed under them, and only
those rules run their regular expressions. All of it is one projection of
built-in functions: the index is a literal of hash buckets, so no URL is
exploded, shuffled or joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, without

MAX_RULES = 5000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host + path (``scope`` place) or on the whole URL (``scope`` url).

    The place is what stands behind the first ``://``, so no other one in a
    query counts. ``tokens``: lower-case alphanumeric runs that stand, as whole runs, in
    every URL that the pattern fits. Where the pattern has alternatives,
    ``any_of`` has a run of each instead: one of them stands in every such
    URL, and the rule is filed under all. ``kind`` site: the longest fitting
    name decides; pattern: asked where no site rule fits.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    kind: str = "pattern"
    scope: str = "url"
    any_of: tuple[str, ...] = ()


def site_rule(verdict: str, host: str, path: str) -> UrlRule:
    """Fits the host and its subdomains where the URL's path starts with ``path``."""
    whole = host + path
    tokens = re.findall(r"[a-z0-9]+", host.lower()) + [t for t in re.findall(r"[a-z0-9]+(?=/)", path.lower()) if path.endswith("/")]
    return UrlRule(whole, verdict, r"^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", whole), tuple(tokens), "site", "place")


SITE_RULES = (
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
)

PATTERN_RULES = (
    UrlRule("ad-host", "block", r"(?i)^(?:[^/]*\.)?(?:ads|adserver|doubleclick)\.", (), scope="place", any_of=("ads", "adserver", "doubleclick")),
    UrlRule("adserver-host", "block", r"(?i)^(?:[^/]*\.)?adserver\.", ("adserver",), scope="place"),
    UrlRule("archive-file", "block", r"(?i)\.(?:zip)(?:$|[?#])", ("zip",)),
    UrlRule("binary-file", "block", r"(?i)\.(?:exe)(?:$|[?#])", ("exe",)),
    UrlRule("login-page", "block", r"(?i)/login(?:$|/)", ("login",), scope="place"),
    UrlRule("session-link", "block", r"(?i)[?&](?:sessionid)=", ("sessionid",)),
    UrlRule("casino-site", "block", r"(?i)\bcasino\b", ("casino",), scope="place"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the URL is null or has no ``://``."""
    host = F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(url), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens, over all URLs; at most one row a token comes back."""
    wanted = F.array(*[F.lit(t) for t in tokens])
    found = urls.select(F.explode(F.array_intersect(url_tokens(F.col(f"`{url}`")), wanted)).alias("token"))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def _entry(rule: UrlRule, token: str, number: int) -> Column:
    parts = {"token": token, "number": number, "name": rule.name, "verdict": rule.verdict, "pattern": rule.pattern, "kind": rule.kind, "scope": rule.scope}
    return F.struct(*[F.lit(v).alias(k) for k, v in parts.items()])


def rule_index(rules: tuple[UrlRule, ...], counts: dict[str, int]) -> tuple[Column, int]:
    """Hash buckets of rules by their rarest token (ties: the alphabetically first), or by each of ``any_of``."""
    n = max(16, 2 * len(rules))
    buckets: list[list[Column]] = [[] for _ in range(n)]
    by_token: dict[str, list[tuple[UrlRule, int]]] = {}
    for number, rule in enumerate(rules):
        filed = (min(rule.tokens, key=lambda t: (counts.get(t, 0), t)),) if rule.tokens else dict.fromkeys(rule.any_of)
        for token in filed:
            by_token.setdefault(token, []).append((rule, number))
    # The same hash in Python and in the plan: a sum of code points by place.
    for token, own in by_token.items():
        buckets[_place(token, n)] += [_entry(r, token, number) for r, number in own]
    empty = F.filter(F.array(_entry(rules[0], "", 0)), lambda _: F.lit(False))
    return F.array(*[F.array(*b) if b else empty for b in buckets]), n


def _place(token: str, n: int) -> int:
    return (ord(token[0]) * 31 + ord(token[-1]) * 7 + len(token)) % n


def _place_column(token: Column, n: int) -> Column:
    return (F.ascii(token) * 31 + F.ascii(F.substring(token, -1, 1)) * 7 + F.length(token)) % n


def judge_urls(df: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = SITE_RULES + PATTERN_RULES, default: str = "allow", counts: dict[str, int] | None = None) -> DataFrame:
    """Adds host, path, rule, verdict and fired (names of all fitting rules, sorted).

    rule: the longest fitting site rule (ties: the greater name), else null.
    verdict: that rule's; else block where a block pattern fits, else allow
    where an allow pattern fits, else ``default``. A null or empty URL, or
    one without ``://``, has empty host and path and gets ``default`` unless a
    pattern fits. Input columns with these names (in any case) are replaced;
    others, repeated rows and ties pass through; an empty table gives an
    empty result. At most ``MAX_RULES`` rules; each needs a token.
    """
    if len(rules) > MAX_RULES or not all(r.tokens or r.any_of for r in rules):
        raise ValueError(f"at most {MAX_RULES} rules, each with a literal token")
    if counts is None:
        counts = token_counts(df, url, sorted({t for r in rules for t in r.tokens}))
    index, n = rule_index(rules, counts)
    u = F.col(f"`{url}`")
    host, path = url_parts(u)
    base = without(df, *({"host", "path", "rule", "verdict", "fired"} - {url.lower()}))
    columns = [f"c{i}" for i in range(len(base.columns))]
    out = base.select(F.coalesce(u, F.lit("")), host, path, *[F.col(f"`{c}`") for c in base.columns]).toDF("_url", "_host", "_path", *columns)
    fetched = F.flatten(F.transform(F.filter(url_tokens(F.col("_url")), lambda t: t != ""), lambda t: F.filter(F.get(index, _place_column(t, n)), lambda e: e["token"] == t)))
    fits = lambda e: F.regexp_like(F.when(e["scope"] == "url", F.col("_url")).otherwise(F.concat("_host", "_path")), e["pattern"])
    # A rule filed under several tokens of the URL is fetched by each and counts once.
    once = F.array_distinct(F.transform(fetched, lambda e: e.dropFields("token")))
    out = out.withColumn("_fired", F.filter(once, fits))
    site = F.array_max(F.transform(F.filter("_fired", lambda e: e["kind"] == "site"), lambda e: F.struct(F.length(e["name"]).alias("n"), e["name"].alias("name"), e["verdict"].alias("verdict"))))
    other = F.transform(F.filter("_fired", lambda e: e["kind"] != "site"), lambda e: e["verdict"])
    out = out.withColumns({"_site": site, "_other": other})
    verdict = F.coalesce(F.col("_site.verdict"), F.when(F.array_contains("_other", "block"), "block").when(F.size("_other") > 0, "allow").otherwise(default))
    keep = [F.col(p).alias(c) for p, c in zip(columns, base.columns, strict=True)]
    return out.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_site.name").alias("rule"), verdict.alias("verdict"), F.array_join(F.array_sort(F.transform("_fired", lambda e: e["name"])), ",").alias("fired"))


ORACLE_OP4 = r"""
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(name, host, path, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
patterns(name, place, pattern) AS (VALUES ('ad-host', true, '(?i)^([^/]*\.)?(ads|adserver|doubleclick)\.'), ('adserver-host', true, '(?i)^([^/]*\.)?adserver\.'),
  ('archive-file', false, '(?i)\.(zip)($|[?#])'), ('binary-file', false, '(?i)\.(exe)($|[?#])'), ('login-page', true, '(?i)/login($|/)'),
  ('session-link', false, '(?i)[?&](sessionid)='), ('casino-site', true, '(?i)\bcasino\b')),
numbered AS (SELECT row_number() OVER () AS k, * FROM p),
site AS (SELECT k, arg_max(r.name, (length(r.name), r.name)) AS rule, arg_max(r.verdict, (length(r.name), r.name)) AS verdict, string_agg(r.name, ',') AS names
  FROM numbered n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY k),
pat AS (SELECT k, string_agg(q.name, ',') AS names FROM numbered n JOIN patterns q ON regexp_matches(CASE WHEN q.place THEN n.host || n.path ELSE coalesce(n.url, '') END, q.pattern) GROUP BY k)
SELECT n.page_id, n.host, n.path, s.rule, coalesce(s.verdict, CASE WHEN t.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(array_to_string(list_sort(string_split(concat_ws(',', s.names, t.names), ',')), ','), '') AS fired
FROM numbered n LEFT JOIN site s ON n.k = s.k LEFT JOIN pat t ON n.k = t.k
"""
