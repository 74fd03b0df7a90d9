"""URL filtering with redirect equivalence.

Explicit rules judge a url first. Urls that are aliases of each other -- the same address up to scheme, ``www.``, tracking
parameters, fragment, trailing slash or ``.html``, or tied by a page's canonical link or redirect -- form components,
found by distributed connected components. A url without a rule of its own takes its component's decision: block if some
alias is blocked, unless some alias is explicitly allowed; allow if there is neither.

Targets may be relative and hold character references; they are resolved against the page's own url.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, is alias to nothing and is
allowed. Null html has no links. Repeated rows, and rows of one id, are judged each; a null id is kept. Urls and html of
any length are read whole. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import pin
from timberline.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def alias_key(url: Column) -> Column:
    """One name for all spellings of an address; null without ``://``."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|gclid|fbclid)(=|$)")))
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    place = F.regexp_replace(path(url), r"(/index)?(\.html?)?/*$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(name, place, F.lit("?"), F.array_join(kept, "&")))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, without quotes; empty without one."""
    found = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.trim(F.concat(*(F.regexp_extract(tag, found, k) for k in (1, 2, 3))))


def _unescaped(text: Column) -> Column:
    for name, c in (("&quot;|&#34;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;|&#38;|&#x26;", "&")):
        text = F.regexp_replace(text, f"(?i){name}", c)
    return text


def link_targets(html: Column) -> Column:
    """Targets of canonical links (``rel`` holds the word) and meta refreshes (``http-equiv`` is the word), as they are written."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), F.lit(0))

    def target(tag: Column) -> Column:
        canonical = tag.rlike("(?i)^<link") & _attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
        refresh = tag.rlike("(?i)^<meta") & _attribute(tag, "http-equiv").rlike("(?i)^refresh$")
        later = F.regexp_extract(_attribute(tag, "content"), r"""(?i)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"']+)""", 1)
        return _unescaped(F.trim(F.when(canonical, _attribute(tag, "href")).when(refresh, later).otherwise("")))

    maybe = html.rlike(r"(?i)<(link|meta)\s[^>]*(canonical|refresh)")
    return F.when(maybe, F.filter(F.transform(tags, target), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def resolved(target: Column, page: Column) -> Column:
    """The target as an absolute address, seen from a page's url; null where that isn't one. ``<base>`` isn't looked at."""
    scheme, rest = F.substring_index(page, "://", 1), _rest(page)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(rest, r"^([^/?#]*)", 1))
    place = path(page)
    folder = F.when(place == "", "/").otherwise(F.regexp_replace(place, r"[^/]*$", ""))
    whole = (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#"), F.lit(None))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, place, target))
        .otherwise(F.concat(site, folder, target))
    )
    whole = F.when(F.instr(page, "://") > 0, whole).when(F.instr(target, "://") > 0, target)
    return without_dots(whole)


def without_dots(url: Column) -> Column:
    """An absolute address without ``.`` and ``..`` in its path: its segments are taken one by one, each ``..`` drops one."""
    cut = r"^([^?#]*?://[^/?#]*)([^?#]*)([\s\S]*)$"
    head, place, tail = (F.regexp_extract(url, cut, k) for k in (1, 2, 3))
    segments = F.split(F.regexp_replace(place, r"(^|/)\.\.?$", "$0/"), "/")  # a last dot stands for a folder

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(s == "..", up).when(s == ".", acc).otherwise(F.array_append(acc, s))

    folded = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    return F.when(place.rlike(r"(^|/)\.\.?(/|$)"), F.concat(head, folded, tail)).otherwise(url)


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``redirects(source, target)`` adds edges between urls."""
    targets = F.coalesce(link_targets(F.col("html").cast("string")), F.array().cast("array<string>"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"), targets.alias("written"))
    urls = urls.withColumn("targets", F.when(F.size("written") > 0, F.filter(F.transform("written", lambda t: resolved(t, F.col("url"))), lambda t: t.isNotNull())).otherwise(F.col("written")))
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = rule_of(h, p, rules)
    key = alias_key(F.col("url"))
    urls = urls.select(
        "page_id", h.alias("host"), p.alias("path"), rule.alias("rule"), verdict.alias("own"), F.xxhash64(key).alias("hash"), key.alias("key"), "targets"
    ).withColumn("node", F.when(F.col("key").isNotNull(), F.col("hash"))).drop("hash", "key")
    urls = pin(urls)
    # Rows without an address of their own are alias to nothing.
    nowhere = urls.where("node is null")
    urls = urls.where("node is not null")
    ends = urls.select("node", F.explode("targets").alias("target"))
    target_node = F.when(alias_key(F.col("target")).isNotNull(), F.xxhash64(alias_key(F.col("target"))))
    target_own = rule_of(host(F.col("target")), path(F.col("target")), rules)[1]
    links = ends.select(F.col("node").alias("a"), target_node.alias("b"), target_own.alias("own"))
    judged = urls.select("node", "own").union(links.select("b", "own"))
    if redirects is not None:
        src, dst = F.col("source"), F.col("target")
        more = redirects.select(
            F.xxhash64(alias_key(src)).alias("a"), F.xxhash64(alias_key(dst)).alias("b"),
            rule_of(host(src), path(src), rules)[1].alias("own_a"), rule_of(host(dst), path(dst), rules)[1].alias("own_b"),
        ).where(alias_key(src).isNotNull() & alias_key(dst).isNotNull())
        links = links.select("a", "b").union(more.select("a", "b"))
        judged = judged.union(more.select("a", "own_a")).union(more.select("b", "own_b"))
    found = components(links.select("a", "b"))
    judged = judged.where("node is not null").groupBy("node").agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed"))
    judged = judged.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    decided = judged.groupBy("component").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    decided = decided.where("blocked and not coalesce(allowed, false)").select("component", F.lit("block").alias("from_alias"))
    # Only nodes of blocked components need a row; a common url is one row here however many pages have it.
    nodes = judged.select("node", "component").join(decided, "component").select("node", "from_alias")
    out = urls.join(nodes, "node", "left").unionByName(nowhere.withColumn("from_alias", F.lit(None).cast("string")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "from_alias", F.lit("allow")).alias("verdict"))
