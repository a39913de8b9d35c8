"""URL filters: longest-match rules, and block decisions carried over redirect and canonical-link edges."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together; of equal ones an allow) that fits: struct(rule, verdict), null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def node_of(url: Column) -> Column:
    """A URL without scheme and fragment, its host in lower case: what redirects and canonical links are matched by."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(url), path_of(url), F.coalesce(query, F.lit("")))


_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)(\?[^#]*)?", re.S)


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for p in parts:
        if p == "..":
            out = out[:-1]
        elif p != ".":
            out.append(p)
    return "/" + "/".join(out) + ("/" if parts[-1] in (".", "..") and out else "")


def resolved(base: str, to: str) -> str | None:
    """The absolute URL that `to` means on a page of the URL `base` (which holds ://), as RFC 3986 resolves it; null if it is no
    place on a host (mailto:, javascript: and the like). What is absolute already stays as written."""
    to = to.strip()
    scheme, _, rest = base.partition("://")
    if lead := _SCHEME.match(to):
        return to if to.startswith("//", lead.end()) else None
    if to.startswith("//"):
        return f"{scheme}:{to}"
    host, path, query = _PARTS.match(rest).groups()
    to = to.split("#", 1)[0]
    if not to or to.startswith("?"):
        return f"{scheme}://{host}{path}{to or query or ''}"
    target, mark, asked = to.partition("?")
    if not target.startswith("/"):
        target = path[: path.rfind("/") + 1] + target if path else target
    return f"{scheme}://{host}{_without_dots(target if target.startswith('/') else '/' + target)}{mark}{asked}"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, to, base, marked): to against base (itself against url) or url; entities are decoded where it comes from HTML."""
    for b in batches:
        out = []
        for url, to, base, marked in zip(*(c.to_pylist() for c in b.columns)):
            read = html.unescape if marked else str
            on = (resolved(url, read(base)) if base else None) or url
            out.append(resolved(on, read(to)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["url", "to"])


def edges_of(targets: DataFrame) -> DataFrame:
    """(a, b) of the rows (url, to, base, marked) whose URL is absolute and whose target is a place."""
    known = targets.where("instr(url, '://') > 0 and to is not null and to <> ''").select("url", "to", "base", "marked")
    return known.mapInArrow(_resolve, "url string, to string").where("to is not null").select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): from each page's URL to the URLs of its canonical links and refresh redirects. Relative ones are resolved against the
    page's URL, or its <base href>."""
    near = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", "html")
    base = F.regexp_extract("html", r"(?is)<base\s[^>]*?\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    tags = near.select("url", base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*['\"]?\s*([^\"'\s>]+)", 1))
    return edges_of(tags.select("url", F.coalesce(canonical, refresh).alias("to"), "base", F.lit(True).alias("marked")))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, html).

    A rule's own verdict always stands: an explicit allow wins over any block that aliases carry. A page that no rule fits is
    blocked if a URL that it is equivalent to (over canonical links, refresh redirects and the rows (from_url, to_url) of
    `redirects`, in either direction and over any number of steps, also by URLs that no page has) is blocked by a rule, and
    allowed otherwise. Null URLs and those without :// have empty host and path, no rule and no alias; repeated rows are judged
    alike; an empty table gives an empty one."""
    src = pages.select("page_id", "url", "html")
    edges = page_edges(src)
    if redirects is not None:
        edges = edges.unionByName(edges_of(redirects.select(F.col("from_url").alias("url"), F.col("to_url").alias("to"), F.lit("").alias("base"), F.lit(False).alias("marked"))))
    groups = written(components(edges), "aliases")
    bare = F.concat(F.lit("://"), F.col("node"))
    verdicts = groups.select("component", rule_of(host_of(bare), path_of(bare), rules)["verdict"].alias("v"))
    blocked = verdicts.where("v = 'block'").select("component").distinct()
    aliases = groups.join(blocked, "component", "left_semi").select("node").withColumn("__blocked", F.lit(True))
    url = F.col("url")
    out = src.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.instr(url, "://") > 0, node_of(url)).alias("node"))
    out = out.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).join(aliases, "node", "left")
    carried = F.when(F.col("__blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", carried).alias("verdict"))


SQL = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
rules(verdict, h, p, rule) AS (VALUES ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'), ('allow', 'www.example.com', '/en/', 'www.example.com/en/'),
             ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')),
m AS (SELECT p.page_id, p.host, p.path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
      FROM p LEFT JOIN rules ON (p.host = rules.h OR ends_with(p.host, '.' || rules.h)) AND starts_with(p.path, rules.p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""
