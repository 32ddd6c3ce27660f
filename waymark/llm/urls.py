"""URL filter by redirect equivalence. Native: DataFrame functions only.

Rules allow or block a host, its subdomains and a path prefix; the longest fitting rule
decides a url. Urls without a rule take the decision of their aliases. Aliases are the
connected components over canonical links and redirects: every url links to its own normal form
(scheme, ``www.``/``m.`` hosts, tracking parameters, fragment, trailing slash and
``.html`` dropped), to the target of ``<link rel=canonical>`` and of a refresh redirect in its
page, and along given redirects. Rules judge the targets and given redirects too, whether or not
they are pages. A component with an allowed url is allowed, else one with a blocked url is
blocked, else it is allowed.

Normal forms take most of the work, as a column; components are computed over the links
between different normal forms only.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, has no
alias and is allowed; a rule with an empty path fits every path; of rules of one length the first
listed wins; relative targets are resolved against the page's own url (``<base>`` is not read), and
those of other kinds, like ``mailto:``, are ignored; repeated rows are judged each; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.text import ascii_lower
from waymark.plans.components import connected_components
from waymark.plans.scratch import materialize

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: So many rules are part of the plan; more are joined by host.
MOST_RULES = 1000
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)="


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        own, slash, start = rule.partition("/")
        # its host itself or after a dot, and its path at the start
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_fit(rows: DataFrame, rules: tuple[tuple[str, str], ...] | DataFrame) -> DataFrame:
    """``rows`` (with host and path) and ``fit``, their longest fitting rule. A table of rules (rule, verdict), or a long list, is joined by host.

    Of rules of one length the first listed wins; a table lists them by its column ``place``, and without one, or at equal places, allow goes before block.
    """
    if isinstance(rules, tuple) and len(rules) <= MOST_RULES:
        return rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    table = rules if isinstance(rules, DataFrame) else rows.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rules)], "rule string, verdict string, place long")
    place = F.col("place") if "place" in table.columns else F.lit(0)
    table = table.select("rule", "verdict", place.cast("long").alias("_place"), F.substring_index("rule", "/", 1).alias("_own"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("_start"))
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    own = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = places.withColumn("_own", F.explode(own)).join(table, "_own").where(F.col("path").startswith(F.col("_start")))
    best = found.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), "_place", "verdict", "rule")).alias("fit"))
    return rows.join(best, ["host", "path"], "left")


def normal_form(url: Column) -> Column:
    """The form that aliases of one page share: host, path and the parameters that matter; null without ``://``."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def resolved(target: Column, url: Column) -> Column:
    """``target`` as seen from ``url``; null if it is empty, of a kind without ``://``, or relative to no url."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(url)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    full = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(F.when(path == "", "/").otherwise(path), r"(?s)^(.*/)", 1), own))
    steps = F.slice(F.split(full, "/"), 2, F.length(full) + 1)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
                       .when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    end = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    plain = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, end).otherwise(""))
    return (F.when(target == "", None)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | ~F.contains(url, F.lit("://")), None)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(own == "", F.concat(root, path, F.when(rest.startswith("?"), rest).otherwise(F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1))))
            .otherwise(F.concat(root, plain, rest)))


def links_of(html: Column, url: Column) -> Column:
    """Targets of canonical links and refresh redirects in a page at ``url``, as whole urls."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    link = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)rel\s*=\s*[\"']?canonical\b")),
                       lambda t: F.regexp_extract(t, r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b")),
                          lambda t: F.regexp_extract(t, r"(?i)url\s*=\s*'?([^\"'\s>]+)", 1))
    return F.filter(F.transform(F.concat(link, refresh), lambda t: resolved(t, url)), lambda u: u.isNotNull())


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] | DataFrame = RULES, redirects: DataFrame | None = None,
               key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, host, path, rule, verdict, and alias (the component's smallest normal form). redirects: (src, dst) urls."""
    u = F.col(url)
    read = materialize(pages.select(F.col(key).alias("key"), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"),
                                    normal_form(u).alias("form"), links_of(F.col(html), u).alias("links")), "urls")
    ends = read.select(F.col("form").alias("src"), F.explode("links").alias("to"))
    edges = ends.select("src", normal_form(F.col("to")).alias("dst"))
    named = ends.select("to")
    if redirects is not None:
        moved = redirects.select("src", resolved(F.col("dst"), F.col("src")).alias("dst"))
        edges = edges.unionByName(moved.select(normal_form(F.col("src")).alias("src"), normal_form(F.col("dst")).alias("dst")))
        named = named.union(moved.select("src")).union(moved.select("dst"))
    to = F.col("to")
    named = with_fit(named.distinct().select(normal_form(to).alias("form"), host_of(to).alias("host"), path_of(to).alias("path")), rules).select("form", "fit").where("form is not null and fit is not null")
    groups = connected_components(edges).toDF("node", "alias")
    fitted = with_fit(read, rules)
    formed = fitted.where("form is not null")  # urls without a form have no aliases, so they stay out of the joins
    rows = formed.join(groups, F.col("form") == F.col("node"), "left").withColumn("alias", F.coalesce("alias", "form"))
    # one row per blocked component: an explicit allow anywhere in it takes precedence
    judged = (rows.where("fit is not null and alias is not null").select("alias", "fit")
              .unionByName(named.join(groups, F.col("form") == F.col("node"), "left").select(F.coalesce("alias", "form").alias("alias"), "fit")))
    blocked = (judged.groupBy("alias")
               .agg(F.bool_or(F.col("fit.verdict") == "allow").alias("allowed")).where("not allowed").select(F.col("alias").alias("_blocked")))
    rows = rows.join(blocked, rows["alias"] == blocked["_blocked"], "left")
    rows = rows.unionByName(fitted.where("form is null"), allowMissingColumns=True)
    verdict = F.coalesce("fit.verdict", F.when(F.col("_blocked").isNotNull(), "block").otherwise("allow"))
    return rows.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "alias")
