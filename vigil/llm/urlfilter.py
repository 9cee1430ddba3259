"""Operator 4: URL filter with redirect equivalence.

Allow and block rules name a host (with all its subdomains) and a path prefix;
the longest rule that fits a URL decides.  A URL without a rule follows its
aliases: pages joined by redirect (``meta refresh``) and canonical-link edges
form components, and a component with a blocked member is blocked unless an
explicit allow stands in it.  Everything is DataFrame work: regular
expressions for the edges, the large-star/small-star rounds of
:mod:`vigil.llm.components`, joins by node.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no
rule, takes part in no edge and is allowed; null or empty html has no edges;
repeated pages each get a row; a very long page is searched whole for its links;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.llm.components import connected_components

#: (verdict, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ATTR = r"""\s*=\s*["']?"""
_CANONICAL = rf"""(?is)<link\b[^>]*\brel{_ATTR}canonical\b[^>]*>"""
_REFRESH = rf"""(?is)<meta\b[^>]*\bhttp-equiv{_ATTR}refresh\b[^>]*>"""
_HREF = rf"""(?is)\bhref{_ATTR}([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds ``rule`` (text) and ``_own`` (verdict) of the longest rule that fits
    the columns ``host`` and ``path``, else nulls; of equally long ones allow wins."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    fits = [((F.col("host") == rh) | F.col("host").endswith("." + rh)) & F.col("path").startswith(rp) for _, rh, rp in longest]
    which = F.coalesce(*[F.when(f, F.lit(i + 1)) for i, f in enumerate(fits)], F.lit(0))
    names = F.array(*[F.lit(v) for v in [None, *[rh + rp for _, rh, rp in longest]]])
    kinds = F.array(*[F.lit(v) for v in [None, *[k for k, _, _ in longest]]])
    return (df.withColumn("_which", which).withColumn("rule", F.get(names, F.col("_which")))
            .withColumn("_own", F.get(kinds, F.col("_which"))).drop("_which"))


def without_dots(at: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` segments; an
    empty one as it is."""
    segments = F.split(at, "/", -1)
    left = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done).when(
        s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    folder = at.rlike(r"/\.\.?\z") & (F.size(left) > 0)
    plain = F.concat(F.lit("/"), F.array_join(left, "/"), F.when(folder, "/").otherwise(""))
    return F.when(at.rlike(r"/\.\.?(?:/|\z)"), plain).otherwise(at)


def node(url: Column) -> Column:
    """A URL as a node of the alias graph: host, path without dot segments and
    query, without scheme and fragment; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*([^#]*)", 1)
    rest = F.concat(without_dots(path(url)), query)
    return F.when(url.contains("://") & (host(url) != ""), F.concat(host(url), F.when(rest == "", "/").otherwise(rest)))


def resolve(base: Column, link: Column) -> Column:
    """A link's target as an absolute URL, for the forms that links take; dot
    segments stay, :func:`node` removes them."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    folder = F.regexp_extract(path(base), r"(?s)^(.*/)", 1)
    top = F.concat(scheme, F.lit("://"), host(base))
    return (F.when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(top, link))
            .when(link.startswith("?"), F.concat(top, F.when(path(base) == "", "/").otherwise(path(base)), link))
            .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), link))
            .otherwise(F.concat(top, F.when(folder == "", "/").otherwise(folder), link)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes joined by a canonical link or a redirect; repeated, null or
    equal ends are left to the component search."""
    tags = F.concat(F.regexp_extract_all("html", F.lit(_CANONICAL), F.lit(0)), F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0)))
    found = (pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)"))
             .select("url", F.explode(tags).alias("tag")))
    link = F.when(F.col("tag").rlike(r"(?i)^<link"), F.regexp_extract("tag", _HREF, 1)).otherwise(F.regexp_extract("tag", _TARGET, 1))
    return (found.withColumn("link", link).where("link <> ''")
            .withColumn("target", resolve(F.col("url"), F.col("link")))
            .select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every page."""
    own = with_rule(pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                                 node(F.col("url")).alias("_node")), rules)
    members = connected_components(stored(alias_edges(pages.select("url", "html")), "alias-edges"))
    as_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = with_rule(members.select("node", "component", host(as_url).alias("host"), path(as_url).alias("path")), rules)
    decided = ruled.groupBy("component").agg(
        F.when(F.max(F.col("_own") == "allow"), "allow").when(F.max(F.col("_own") == "block"), "block").otherwise("allow").alias("_group"))
    alias = members.join(decided, "component").select(F.col("node").alias("_node"), "_group")
    out = own.join(alias, "_node", "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("_own", "_group", F.lit("allow")).alias("verdict"))
