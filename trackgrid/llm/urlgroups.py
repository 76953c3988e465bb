"""URL filter whose block decisions reach the aliases of a page.

Redirects and canonical links make URLs equivalent. Rules judge single URLs; the
connected components over those links carry a block to the URLs that no rule fits,
unless the component holds a URL that a rule allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgrid.llm.common import Scratch
from trackgrid.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules ``(action, "host/path")`` as a table ``(rule_host, rule_path, action)``."""
    parts = [(a, *r.partition("/")[::2]) for a, r in rules]
    items = [F.struct(F.lit(h).alias("rule_host"), F.lit("/" + p).alias("rule_path"), F.lit(a).alias("action")) for a, h, p in parts]
    return spark.range(1).select(F.explode(F.array(*items)).alias("r")).select("r.*")


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Entities by name that addresses hold.
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def decoded(text: Column) -> Column:
    """Text with ``&amp;``, the other entities of XML and numeric ones decoded once; the rest stays."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);|[^&]+|&)"), F.lit(1))

    def one(piece: Column) -> Column:
        code = F.when(piece.rlike("^&#[0-9]+;$"), F.regexp_extract(piece, "([0-9]+)", 1).cast("int")).when(
            piece.rlike("^&#[xX][0-9A-Fa-f]+;$"), F.conv(F.regexp_extract(piece, "[xX]([0-9A-Fa-f]+)", 1), 16, 10).cast("int"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # chr() of Spark only knows bytes, so a code point becomes the UTF-32 bytes of its character.
        out = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, sign in _NAMED.items():
            out = F.when(piece == f"&{name};", F.lit(sign)).otherwise(out)
        return F.coalesce(out, piece)

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..``; the parts above the root are dropped."""
    parts = F.split(path, "/")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    last = F.element_at(parts, -1)

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    # A path that ends in dots is a directory.
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolve(base: Column, target: Column) -> Column:
    """Absolute form of ``target`` on the page ``base``, as browsers join them; NULL if the base has no host or the target is of another kind (``mailto:``)."""
    part = r"^((?s:.*?)://)([^/?#]*)([^?#]*)(\?[^#]*)?"
    scheme, host, path, query = (F.coalesce(F.regexp_extract(base, part, i), F.lit("")) for i in (1, 2, 3, 4))
    site = F.concat(scheme, host)
    target = F.regexp_replace(target, "(?s)#.*$", "")
    own, more = F.regexp_extract(target, r"^([^?]*)", 1), F.regexp_extract(target, r"(?s)^[^?]*(\?.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)(.*)$"
    under = F.regexp_extract(target, whole, 2)
    absolute = F.concat(F.regexp_extract(target, whole, 1), _without_dots(F.regexp_extract(under, r"^([^?]*)", 1)), F.regexp_extract(under, r"(?s)^[^?]*(\?.*)$", 1))
    sibling = F.concat(F.regexp_replace(scheme, "//$", ""), target)
    sibling = F.concat(F.regexp_extract(sibling, whole, 1), _without_dots(F.regexp_extract(sibling, r"(?s)://[^/?]*([^?]*)", 1)), F.regexp_extract(sibling, r"(?s)^[^?]*(\?.*)$", 1))
    based = base.contains("://")
    return (F.when(target.rlike(whole), absolute)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | ~based, F.lit(None).cast("string"))
            .when(target.startswith("//"), sibling)
            .when(target.startswith("/"), F.concat(site, _without_dots(own), more))
            .when(target == "", F.concat(site, path, query))
            .when(own == "", F.concat(site, path, more))
            .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), more)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``(a, b)`` from a page to the targets of its canonical links and refreshes.

    Entities in targets are decoded; all relative targets are made absolute against the page's URL.
    """
    tags = pages.select(F.col(url).alias("a"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_TAG), F.lit(0))).alias("tag"))
    tags = tags.where(F.lower("tag").rlike("canonical|refresh"))
    rel, kind = F.lower(_attribute("rel")), F.lower(F.trim(_attribute("http-equiv")))
    canonical = F.array_contains(F.split(rel, r"\s+"), "canonical")
    refresh = F.regexp_extract(_attribute("content"), r"(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"'>\s]+)", 1)
    is_link = F.lower(F.substring("tag", 2, 4)) == "link"
    target = F.when(is_link & canonical, F.trim(_attribute("href"))).when(~is_link & (kind == "refresh"), refresh)
    # Generated columns are computed once, however often the next step names them.
    found = tags.select("a", F.explode(F.array(target)).alias("t")).where("t <> ''")
    found = found.select("a", F.explode(F.array(decoded(F.col("t")))).alias("t"))
    return found.select("a", F.explode(F.array(resolve(F.col("a"), F.col("t")))).alias("b")).where("a is not null and b is not null")


#: A link or meta tag whose values may hold angle brackets, and one attribute of a tag.
_TAG = r"""(?is)<(?:link|meta)\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
_ATTRIBUTE = r"""(?s)(?<=[\s"'/])([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _attribute(name: str) -> Column:
    """Value of the first attribute of that name in ``tag``, without its quotes; NULL if there is none."""
    names, values = (F.regexp_extract_all(F.col("tag"), F.lit(_ATTRIBUTE), F.lit(k)) for k in (1, 2))
    at = F.array_position(F.transform(names, F.lower), name)
    return F.regexp_replace(F.get(values, (at - 1).cast("int")), r"(?s)^([\"'])(.*)\1$", "$2")


def without_fragment(url: Column) -> Column:
    """The URL up to the first ``#`` behind its ``://``; texts without ``://`` as they are."""
    return F.regexp_replace(url, r"^((?s:.*?)://[^#]*)(?s:#.*)$", "$1")


def node_of(url: Column) -> Column:
    """One form for URLs that name the same place: scheme and host in lower case, no default port, no fragment."""
    part = r"^((?s:.*?))://([^/?#]*)((?s:[^#]*))"
    scheme, host, rest = F.lower(F.regexp_extract(url, part, 1)), F.lower(F.regexp_extract(url, part, 2)), F.regexp_extract(url, part, 3)
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443").otherwise("")
    host = F.when((port != "") & host.endswith(port), F.substring(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host, F.when(rest == "", "/").otherwise(rest))).otherwise(url)


def _judged(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each URL of the distinct ``nodes(node)``: ``(node, rule, action)``.

    A URL meets the rules through the parents of its host, so the table of rules may
    be of any size; rules that tie are taken in the order of action, then text.
    """
    host = host_of(F.col("node"))
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = nodes.select("node", path_of(F.col("node")).alias("path"), F.explode(parents).alias("rule_host"))
    fits = spread.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.when(F.col("action") == "allow", 1).otherwise(0).alias("allow"), rule.alias("rule")))
    return fits.groupBy("node").agg(best.alias("m")).select("node", "m.rule", F.when(F.col("m.allow") == 1, "allow").otherwise("block").alias("action"))


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, *, id_col: str = "page_id",
               url: str = "url", html: str = "html") -> DataFrame:
    """Verdict of every page: ``(id, host, path, rule, verdict, class_size)``.

    The rule that fits a URL decides for it. A URL without one is blocked if its
    component holds a URL that a rule blocks and none that a rule allows. URLs that differ
    only in their fragment, the case of scheme and host or a default port are one node.
    ``redirects(from_url, to_url)`` adds observed redirects.

    NULL URLs and texts without ``://`` have empty host and path, fit no rule, have no
    aliases and are allowed. NULL or empty HTML has no links. Repeated rows give
    repeated rows, an empty table an empty result; other columns are ignored. URLs and HTML of any
    length are read whole; rules that tie are taken in the order of action, then text.
    """
    plain = without_fragment(F.col(url))
    pages = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), plain.alias("plain"), node_of(plain).alias("node"), F.col(html).alias("html"))
    edges = page_links(pages, "plain")
    if redirects is not None:
        edges = edges.union(redirects.select("from_url", "to_url"))
    edges = edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
    scratch = Scratch(pages.sparkSession, "urls")
    roots = components(edges, scratch)
    # Pages outside all components are classes of their own, so they need no root.
    # Rules see a page's own host, which may name a port, and aliases in their one form.
    own = pages.select("plain", "node").where("plain is not null")
    nodes = own.select(F.col("plain").alias("node")).union(own.select("node")).union(roots.select("node")).distinct()
    judged = _judged(nodes, rules)
    classes = roots.join(judged, "node", "left").groupBy("root").agg(
        F.count("*").alias("class_size"), F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    shared = roots.join(classes, "root").select("node", "class_size", (F.col("blocked") & ~F.coalesce("allowed", F.lit(False))).alias("shut"))
    out = pages.select("id", "url", "plain", "node").join(judged.withColumnRenamed("node", "plain"), "plain", "left").join(shared, "node", "left")
    inherited = F.when(F.coalesce("shut", F.lit(False)), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
                      F.coalesce("action", inherited).alias("verdict"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
