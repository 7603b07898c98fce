"""URL filters whose decisions reach a page's aliases.

Block and allow rules decide urls by host and path. A redirect or canonical link makes two urls names of one page, so the urls of a connected
component of such links share what the rules decide for any of them: an allow rule anywhere in the component wins over block rules. A url that a rule
fits keeps that rule's verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, UPPER, cut, read_table
from millrace.llm.graph import connected_components

NAME = "op7_url_filter"

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: An attribute's name follows white space, a quote or a slash, so that data-href is not href.
_HREF = r"(?is)[\s\"'/]href\s*=\s*[\"']?\s*([^\"'\s>]+)"

#: (tags, what makes one a link, where its target stands)
_LINKS = (
    (r"(?is)<link\b[^>]*>", r"(?is)[\s\"'/]rel\s*=\s*(?:canonical(?:[\s/>]|$)|\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?')", _HREF),
    (r"(?is)<meta\b[^>]*>", r"(?is)[\s\"'/]http-equiv\s*=\s*[\"']?\s*refresh\b", r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"),
)
_BASE = r"(?is)<base\b[^>]*?" + _HREF.removeprefix("(?is)")

#: Ways to write a character of urls in html; &amp; comes last, as what it makes is not read again.
_ENTITIES = ((r"(?i)&#(?:58|x3a);", ":"), (r"(?i)&#(?:47|x2f);", "/"), (r"(?i)&#(?:63|x3f);", "?"), (r"(?i)&#(?:61|x3d);", "="), (r"(?i)&(?:amp|#38|#x26);", "&"))


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty where there is none."""
    return F.translate(_after(url, r"^([^/?#]*)"), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return _after(url, r"^[^/?#]*([^?#]*)")


def _after(url: Column, pattern: str) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), f"(?s){pattern}", 1)).otherwise("")


def rule_of(hosts: Column, paths: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null. A rule fits its host, that host's subdomains, and paths that start with its own."""
    whens = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((hosts == h) | hosts.endswith(f".{h}")) & paths.startswith(p)
        then = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        whens = F.when(fits, then) if whens is None else whens.when(fits, then)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if whens is None else whens


#: What a url has before its path, and up to the last / of its path.
_ORIGIN, _FOLDER = r"(?s)^(.*?://[^/?#]*)", r"(?s)^(.*?://[^/?#]*/(?:[^?#]*/)?)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often use names it; written in place, nested uses would multiply the plan."""
    return F.transform(F.array(value), use)[0]


def without_dots(path_: Column) -> Column:
    """A path whose segments . and .. are followed: a .. takes the segment before it away, and does nothing where there is none."""

    def followed(p: Column) -> Column:
        kept = F.aggregate(
            F.split(F.substring(p, 2, F.length(p)), "/"), F.lit(""),
            lambda done, x: F.when(x == ".", done).when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x)),
        )
        return F.when(p.contains("/."), F.concat(kept, F.when(p.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(p)

    return _once(path_, followed)


def node(url: Column) -> Column:
    """What stands for a url among links: without a fragment, scheme and host in lower case (A-Z), dots in the path followed, / for an empty path."""

    def made(u: Column) -> Column:
        places = _once(path(u), lambda p: F.when(p == "", "/").otherwise(without_dots(p)))
        whole = F.concat(F.translate(F.regexp_extract(u, _ORIGIN, 1), UPPER, LOWER), places, F.regexp_extract(_after(u, "(.*)"), r"(?s)^[^?#]*(\?[^#]*)", 1))
        return F.when(F.locate("://", u) > 0, whole).otherwise(F.regexp_extract(u, "(?s)^([^#]*)", 1))

    return _once(url, made)


def resolve(base: Column, target: Column) -> Column:
    """The absolute url of a target found on the page base; null where there is none, as for a mere fragment or another kind of scheme.

    Entities for & : / ? = are read. Targets may start with a scheme and ://, with //, /, ? or a name; node() follows the dots in what this returns."""
    for written, char in _ENTITIES:
        target = F.regexp_replace(target, written, char)

    def made(b: Column, t: Column) -> Column:
        origin = F.regexp_extract(b, _ORIGIN, 1)
        folder = F.when(path(b) == "", F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(b, _FOLDER, 1))
        relative = (
            F.when(t.startswith("//"), F.concat(F.regexp_extract(b, r"(?s)^(.*?:)//", 1), t))
            .when(t.startswith("/"), F.concat(origin, t))
            .when(t.startswith("?"), F.concat(F.regexp_extract(b, r"(?s)^([^?#]*)", 1), t))
            .when((t == "") | t.startswith("#") | t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .otherwise(F.concat(folder, t))
        )
        return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(F.locate("://", b) > 0, relative)

    return _once(F.struct(base.alias("b"), target.alias("t")), lambda x: made(x["b"], x["t"]))


def links(pages: DataFrame) -> DataFrame:
    """(url, other), as nodes, for all canonical links and meta refreshes that the html of pages holds, resolved against the page's first base, itself
    resolved against the page's url, or else that url; a link to itself doesn't count. canonical may stand anywhere among the words of rel."""

    def targets(tag: str, mark: str, at: str) -> Column:
        marked = F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(mark))
        return F.transform(marked, lambda t: F.regexp_extract(t, at, 1))

    base = F.regexp_extract("html", _BASE, 1)
    found = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", base.alias("base"), F.explode(F.concat(*[targets(*x) for x in _LINKS])).alias("target"))
    based = found.select("url", "target", F.coalesce(F.when(F.col("base") != "", resolve(F.col("url"), F.col("base"))), "url").alias("base"))
    return based.select(node(F.col("url")).alias("url"), node(resolve(F.col("base"), F.col("target"))).alias("other")).where("other IS NOT NULL AND other <> url").distinct()


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict and by (rule, alias or default) for every row of pages (page_id, url, html).

    redirects (url, other) adds redirects known from crawling to the links found in html. Urls that differ in their fragments alone, or in the case of
    scheme and host, or in dots of their paths, are one node of the links. Targets that are no page of their own count as members too,
    and the rules decide them. Null urls, and urls without ://, have an empty host and path and the default verdict; null html has no links;
    rows that repeat a url get the same verdict; further columns are ignored; an empty table gives no rows.
    """
    both = links(pages)
    if redirects is not None:
        known = redirects.where("url IS NOT NULL AND other IS NOT NULL").select(node(F.col("url")).alias("url"), node(F.col("other")).alias("other"))
        both = both.unionByName(known.where("url <> other")).distinct()
    component = cut(connected_components(both.select(F.col("url").alias("src"), F.col("other").alias("dst"))))
    member = rule_of(host(F.col("node")), path(F.col("node")), rules)["verdict"]
    decided = component.select("component", member.alias("verdict")).where("verdict IS NOT NULL").groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"))
    alias = component.join(decided, "component").select(F.col("node").alias("__node"), F.when(F.col("allowed"), "allow").otherwise("block").alias("__alias"))
    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    joined = own.join(cut(alias), node(F.col("url")) == F.col("__node"), "left")
    return joined.select(
        "page_id", "url", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", "__alias", F.lit(default)).alias("verdict"),
        F.when(F.col("__rule").isNotNull(), "rule").when(F.col("__alias").isNotNull(), "alias").otherwise("default").alias("by"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(host_: str, path_: str, column: int) -> str:
    cases = [f"WHEN ({host_} = '{h}' OR ends_with({host_}, '.{h}')) AND starts_with({path_}, '{p}') THEN '{(h + p, verdict)[column]}'" for verdict, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))]
    return f"CASE {' '.join(cases)} END"


_HOST_SQL = "translate(CASE WHEN strpos({0}, '://') > 0 THEN regexp_extract(substr({0}, strpos({0}, '://') + 3), '^([^/?#]*)', 1) ELSE '' END, '" + UPPER + "', '" + LOWER + "')"
_PATH_SQL = "CASE WHEN strpos({0}, '://') > 0 THEN regexp_extract(substr({0}, strpos({0}, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _resolve_sql(b: str, t: str) -> str:
    return f"""CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {t}
      WHEN strpos({b}, '://') = 0 THEN NULL
      WHEN starts_with({t}, '//') THEN regexp_extract({b}, '(?s)^(.*?:)//', 1) || {t}
      WHEN starts_with({t}, '/') THEN regexp_extract({b}, '{_ORIGIN}', 1) || {t}
      WHEN starts_with({t}, '?') THEN regexp_extract({b}, '(?s)^([^?#]*)', 1) || {t}
      WHEN {t} = '' OR starts_with({t}, '#') OR regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN {_PATH_SQL.format(b)} = '' THEN regexp_extract({b}, '{_ORIGIN}', 1) || '/' || {t}
      ELSE regexp_extract({b}, '{_FOLDER}', 1) || {t} END"""


def _node_sql(u: str) -> str:
    path_ = f"({_PATH_SQL.format(u)})"
    followed = f"""list_reduce(list_prepend('', string_split(substr({path_}, 2), '/')), lambda done, x:
        CASE x WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END)"""
    return f"""CASE WHEN strpos({u}, '://') = 0 THEN regexp_extract({u}, '(?s)^([^#]*)', 1)
      ELSE translate(regexp_extract({u}, '{_ORIGIN}', 1), '{UPPER}', '{LOWER}')
        || CASE WHEN {path_} = '' THEN '/' WHEN NOT contains({path_}, '/.') THEN {path_}
                ELSE {followed} || CASE WHEN regexp_matches({path_}, '/\\.\\.?$') THEN '/' ELSE '' END END
        || regexp_extract(substr({u}, strpos({u}, '://') + 3), '(?s)^[^?#]*(\\?[^#]*)', 1) END"""


def _tags_sql() -> str:
    each = [f"SELECT url, base, unnest(regexp_extract_all(html, {_quoted(tag)})) AS tag, {_quoted(mark)} AS mark, {_quoted(at)} AS place FROM based" for tag, mark, at in _LINKS]
    return " UNION ALL ".join(each)


def _target_sql() -> str:
    cases = " ".join(f"WHEN {_quoted(at)} THEN regexp_extract(tag, {_quoted(at)}, 1)" for _, _, at in _LINKS)
    marks = " ".join(f"WHEN {_quoted(mark)} THEN regexp_matches(tag, {_quoted(mark)})" for _, mark, _ in _LINKS)
    return f"CASE WHEN CASE mark {marks} END THEN CASE place {cases} END END"


def _decoded_sql(t: str) -> str:
    for written, char in _ENTITIES:
        t = f"regexp_replace({t}, {_quoted(written)}, '{char}', 'g')"
    return t


ORACLE_SQL = f"""
WITH RECURSIVE raw AS (SELECT url, html, {_decoded_sql(f"regexp_extract(html, {_quoted(_BASE)}, 1)")} AS b FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
based AS (SELECT url, html, coalesce(CASE WHEN b <> '' THEN {_resolve_sql("url", "b")} END, url) AS base FROM raw),
tags AS ({_tags_sql()}),
targets AS (SELECT url, base, {_decoded_sql(_target_sql())} AS t FROM tags),
resolved AS (SELECT url, {_resolve_sql("base", "t")} AS target FROM targets WHERE t IS NOT NULL),
links AS (SELECT DISTINCT * FROM (SELECT {_node_sql("url")} AS url, {_node_sql("target")} AS other FROM resolved WHERE target IS NOT NULL) WHERE other <> url),
edges AS (SELECT url AS a, other AS b FROM links UNION SELECT other, url FROM links),
reach AS (SELECT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
members AS (SELECT a, {_HOST_SQL.format("b")} AS h, {_PATH_SQL.format("b")} AS p FROM reach),
alias AS (SELECT a, max(CASE v WHEN 'allow' THEN 2 WHEN 'block' THEN 1 END) AS v FROM (SELECT a, {_rule_sql("h", "p", 1)} AS v FROM members) GROUP BY a),
own AS (SELECT page_id, {_node_sql("url")} AS node, {_HOST_SQL.format("coalesce(url, '')")} AS host, {_PATH_SQL.format("coalesce(url, '')")} AS path FROM pages)
SELECT page_id, host, path, {_rule_sql("host", "path", 0)} AS rule,
       coalesce({_rule_sql("host", "path", 1)}, CASE v WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict
FROM own LEFT JOIN alias ON own.node = alias.a
"""
