"""URL filters: rules by host and path, and block decisions that follow redirects and canonical links.

Everything is DataFrame expressions. A page's own rule decides first: of the rules that fit its url, the longest. Pages
without one take part in the redirect equivalence: nodes are urls in a normal form, so spellings of one address are one
node; edges are the redirects and canonical links that pages declare (`meta` refresh, `link` canonical, `og:url`) and those
of a table of redirects. Connected components of these edges are found with DataFrames. A component that holds
a node with a block rule is blocked, unless it holds one with an allow rule: an explicit allow takes precedence. Targets
that are not pages count as well. What is left is allowed.

The normal form drops the scheme, the fragment, a default port, a slash at the end and tracking parameters, and
sorts the other parameters. A null url, or one without ``://``, has empty host and path, fits no rule, has no aliases and
is allowed. Ties of rules of one length: allow, then the rule first in order. Repeated rows are each kept; repeated rules
and edges change nothing; an empty table of pages gives an empty result, one of rules allows all; other columns are not
read. Hosts and pages may be of any length; commented-out tags, scripts and templates declare nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import materialise
from lodestone.llm.components import components

#: Rows of a broadcast side, at most.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that say where a visitor came from, not which page it is.
TRACKING = r"utm_[^=&]*|gclid|fbclid|msclkid|mc_eid|ref"


def _steps(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Columns one after the other, so that each is computed once however often the later ones use it."""
    for name, c in columns.items():
        df = df.withColumn(name, F.expr(c) if isinstance(c, str) else c)
    return df


def with_address(df: DataFrame, url: str, host: str = "host", path: str = "path", node: str | None = None) -> DataFrame:
    """df with a url's host (after the first :// up to /, ?, # or the end, A-Z lower-cased), its path (then up to ?, # or the
    end) and, if wanted, its node: the normal form, null where there is no host."""
    after = F.when(F.instr(url, "://") > 0, F.substr(F.col(url), F.instr(url, "://") + 3)).otherwise(F.lit(""))
    df = _steps(df, _after=after, _raw=F.regexp_extract("_after", "^[^/?#]*", 0), _rest=F.substr(F.col("_after"), F.length("_raw") + 1))
    df = _steps(df, **{host: F.translate("_raw", UPPER, LOWER), path: F.regexp_extract("_rest", "^[^?#]*", 0)})
    if node:
        asked = F.split(F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1), "&")
        kept = F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
        whole = F.concat(F.regexp_replace(host, ":(80|443)?$", ""), F.regexp_replace(path, "/$", ""), F.when(F.size("_kept") > 0, "?").otherwise(""), F.array_join("_kept", "&"))
        df = _steps(df, _kept=kept, **{node: F.when(F.col(host) != "", whole)}).drop("_kept")
    return df.drop("_after", "_raw", "_rest")


def _attribute(name: str) -> Column:
    """The value of an attribute of `tag`, with references of & decoded; empty if it isn't there."""
    at = rf"(?i)[\s\"'/]{name}\s*=\s*"
    quoted = [F.regexp_extract("tag", at + v, 1) for v in ('"([^"]*)"', "'([^']*)'", r"""([^\s"'>]+)""")]
    return F.regexp_replace(F.trim(F.concat(*quoted)), "(?i)&(amp|#38|#x26);", "&")


def resolved(links: DataFrame) -> DataFrame:
    """links (src, a whole url, and link) with dst: the link as a whole url, as seen from src. Null for schemes other than
    http and https."""
    df = _steps(with_address(links, "src", "_host", "_path"), _scheme=F.lower(F.regexp_extract("src", "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), _start=F.regexp_extract("src", "^[^:]*://[^/?#]*", 0))
    df = _steps(df, _target=F.regexp_replace("link", "#.*$", ""), _bare=F.regexp_extract("_target", "^[^?]*", 0), _asked=F.regexp_extract("_target", r"\?.*$", 0))
    folder = F.when(F.col("_path") == "", "/").otherwise(F.regexp_extract("_path", "^(.*/)?", 0))
    bare = F.col("_bare")
    df = _steps(df, _whole=F.when(bare == "", F.col("_path")).when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare)), _parts=F.split("_whole", "/"))
    none = F.array().cast("array<string>")
    walked = F.aggregate("_parts", none, lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    end = F.when(F.element_at("_parts", -1).isin(".", ".."), "/").otherwise("")
    df = _steps(df, _tidy=F.when(F.col("_whole").rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(walked, "/"), end)).otherwise(F.col("_whole")))
    link = F.col("link")
    dst = F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("//"), F.concat("_scheme", F.lit(":"), link)).when(~link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat("_start", "_tidy", "_asked"))
    return df.select(*links.columns, F.when(F.col("_start") != "", dst).alias("dst"))


def _without(df: DataFrame, begin: str, end: str) -> DataFrame:
    """html without what lies between begin and end; what is not ended goes on to the end. One walk, whatever is open."""
    kept = F.transform(F.slice("_parts", F.lit(2), F.size("_parts")), lambda p: F.coalesce(F.try_element_at(F.split(p, end, 2), F.lit(2)), F.lit("")))
    return _steps(df, _parts=F.split("html", begin), html=F.concat(F.element_at("_parts", 1), F.array_join(kept, ""))).drop("_parts")


def declared_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, kind: the redirects and canonical links in pages, as whole urls."""
    some = pages.select(F.col(url).alias("src"), F.col(html).alias("html")).filter("src IS NOT NULL AND html RLIKE '(?i)canonical|refresh|og:url'")
    for begin, end in (("<!--", "-->"), (r"(?i)<script(?=[\s/>])", "(?i)</script"), (r"(?i)<template(?=[\s/>])", "(?i)</template")):
        some = _without(some, begin, end)
    tags = some.select("src", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta)[\s/][^<>]*+>"), 0)).alias("tag"))
    tags = _steps(tags, **{f"_{a}": _attribute(n) for a, n in (("rel", "rel"), ("href", "href"), ("content", "content"), ("equiv", "http-equiv"), ("property", "(?:property|name)"))})
    link = F.col("tag").rlike("(?i)^<link")
    kind = F.when(link & F.array_contains(F.split(F.lower("_rel"), r"\s+"), "canonical"), "canonical").when(~link & (F.lower("_equiv") == "refresh"), "redirect").when(~link & (F.lower("_property") == "og:url"), "same")
    after = F.regexp_extract("_content", r"""(?i)^[\s\d.]*[;,]\s*(?:url\s*=)?\s*["']?([^"']*)""", 1)
    found = _steps(tags, kind=kind, link=F.trim(F.when(F.col("kind") == "canonical", F.col("_href")).when(F.col("kind") == "redirect", after).when(F.col("kind") == "same", F.col("_content"))))
    return resolved(found.select("src", "kind", "link").filter("link <> ''")).filter("dst IS NOT NULL").select("src", "dst", "kind")


def ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with host and path) and the rule that decides each: rule and decision, null where none fits. rules: host, path,
    verdict. A rule fits its host and all subdomains if the path starts with its path. Rules are looked up by
    distinct hosts, whose suffixes have no more labels than a rule's host."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("suffix"), F.coalesce("path", F.lit("")).alias("start"), "verdict").filter("suffix <> '' AND verdict IN ('allow', 'block')").distinct()
    whole = F.concat("suffix", "start")
    rule = F.struct(F.length(whole).alias("size"), (F.col("verdict") == "allow").cast("int").alias("allow"), whole.alias("rule"), "start", "verdict")
    by_host = materialise(rules.groupBy("suffix").agg(F.collect_set(rule).alias("rules"), F.max(F.size(F.split("suffix", r"\."))).alias("labels")))
    most, n = by_host.agg(F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.sum(F.size("rules")), F.lit(0))).first()
    labels = F.slice(F.split("host", r"\."), F.greatest(-F.size(F.split("host", r"\.")), F.lit(-max(most, 1))), F.lit(max(most, 1)))
    hosts = rows.filter("host <> ''").select("host").distinct().select("host", labels.alias("labels"))
    ends = hosts.select("host", F.explode(F.transform("labels", lambda _, i: F.array_join(F.slice("labels", i + 1, F.size("labels")), "."))).alias("suffix"))
    small = n <= BROADCAST_ROWS
    fits = ends.join(F.broadcast(by_host) if small else by_host, "suffix").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    fits = materialise(fits)
    size = fits.agg(F.coalesce(F.sum(F.size("rules")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(fits) if size <= BROADCAST_ROWS else fits, "host", "left")
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])), lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    # of equal length and verdict the first in order: array_max takes the last, so those are looked for by size
    first = F.array_min(F.transform(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]) & (r["size"] == F.col("best.size")) & (r["allow"] == F.col("best.allow"))), lambda r: r["rule"]))
    return joined.withColumn("best", best).withColumn("rule", first).withColumn("decision", F.col("best.verdict")).drop("rules", "best")


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, and by: what decided, 'rule', 'alias' or 'default'.

    redirects: src and dst, whole urls, beside the links that the pages' html declares (html=None: those are not read)."""
    named = with_address(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), "url", node="node")
    rows = materialise(ruled(named.drop("url"), rules))
    links = [] if html is None else [declared_links(pages, url, html).select("src", "dst")]
    links += [] if redirects is None else [redirects.select("src", "dst")]
    opinions = rows.filter("decision IS NOT NULL").select("node", "decision")
    part = None
    if links:
        both = links[0] if len(links) == 1 else links[0].unionByName(links[1])
        ends = materialise(with_address(with_address(both.select("src", "dst").distinct(), "src", "host", "path", "u"), "dst", "host2", "path2", "v"))
        ends = ends.filter("u <> v")
        if not ends.isEmpty():
            urls = ends.select("host", "path", F.col("u").alias("node")).union(ends.select("host2", "path2", "v")).distinct()
            urls = ruled(urls, rules)
            opinions = opinions.unionByName(urls.filter("decision IS NOT NULL").select("node", "decision"))
            part = components(ends.select("u", "v"), kind="string")
    by_node = opinions.groupBy("node").agg(F.bool_or(F.col("decision") == "allow").alias("allow"), F.bool_or(F.col("decision") == "block").alias("block"))
    if part is not None:
        group = F.coalesce("component", by_node["node"])
        by_group = by_node.join(part, by_node["node"] == part["node"], "left").groupBy(group.alias("group")).agg(F.bool_or("allow").alias("allow"), F.bool_or("block").alias("block"))
        shut = materialise(by_group.filter("block AND NOT allow").select("group"))
        members = shut.join(part, shut["group"] == part["component"], "left").select(F.coalesce("node", "group").alias("node"))
        blocked = materialise(members.union(shut).distinct())
    else:
        blocked = materialise(by_node.filter("block AND NOT allow").select("node"))
    blocked = blocked.withColumn("shut", F.lit(True))
    out = rows.join(F.broadcast(blocked) if blocked.count() <= BROADCAST_ROWS else blocked, "node", "left")
    verdict = F.coalesce("decision", F.when(F.col("shut"), "block"), F.lit("allow"))
    by = F.when(F.col("decision").isNotNull(), "rule").when(F.col("shut"), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("by"))
