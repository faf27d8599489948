"""Text audits of HTML pages: inline content against a security policy, URLs, user agents.

Pages are cut into tags by ``tags``, and rules ask for attributes by their names; policies are map columns,
so every page can have its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An attribute list: quoted values may hold any character.
_LIST = r"""((?:[^>"']|"[^"]*"|'[^']*')*)"""
_ATTRIBUTE = r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?"""
#: Script types that are data and never run (fixed values).
DATA_TYPES = ["application/json", "application/ld+json", "importmap"]


def attributes(text: Column) -> Column:
    """Names (lower case) and values (without quotes) of an attribute list, in order: an array of structs."""
    names = F.transform(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), 1), F.lower)
    values = F.transform(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), 2), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    return F.arrays_zip(names.alias("name"), values.alias("value"))


def has_attribute(text: Column, name: str) -> Column:
    return F.exists(attributes(text), lambda a: a["name"] == name)


def attribute(text: Column, name: str) -> Column:
    """The first value of an attribute, null where there is none."""
    return F.get(F.filter(attributes(text), lambda a: a["name"] == name), F.lit(0))["value"]


def elements(pages: DataFrame, tag: str, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, ordinal, attributes, body) of every element of a raw-text tag such as script or style."""
    pattern = F.lit(rf"(?is)<{tag}(?=[\s/>]){_LIST}>(.*?)</{tag}\s*>")
    found = F.arrays_zip(F.regexp_extract_all(html, pattern, 1).alias("attributes"), F.regexp_extract_all(html, pattern, 2).alias("body"))
    return pages.select(id, F.posexplode(found).alias("ordinal", "b")).select(id, "ordinal", "b.attributes", "b.body")


def inline_scripts(pages: DataFrame, **names) -> DataFrame:
    """Script elements that run what they hold: without a source, and not of a data type."""
    kind = F.lower(F.trim(F.coalesce(attribute(F.col("attributes"), "type"), F.lit(""))))
    return elements(pages, "script", **names).where(~has_attribute(F.col("attributes"), "src") & ~kind.isin(DATA_TYPES))


def inline_styles(pages: DataFrame, **names) -> DataFrame:
    return elements(pages, "style", **names)


def has_style_attribute(html: Column) -> Column:
    """Whether any tag has the attribute style."""
    return F.exists(F.regexp_extract_all(html, F.lit(rf"(?s)<[A-Za-z][^\s/>]*{_LIST}>"), 1), lambda t: has_attribute(t, "style"))


def parse_policy(policy: Column) -> Column:
    """Directive (lower case) -> sources; of a directive given twice the last counts."""
    words = F.filter(F.transform(F.split(policy, ";"), lambda p: F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), " ")), lambda p: F.get(p, F.lit(0)) != "")
    name = lambda p: F.lower(F.get(p, F.lit(0)))
    last = F.filter(words, lambda p, k: ~F.exists(F.slice(words, k + 2, F.size(words)), lambda q: name(q) == name(p)))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(name(p).alias("key"), F.slice(p, 2, F.size(p)).alias("value"))))


def sources_for(policy: Column, *directives: str) -> Column:
    """Sources of the first directive that the policy map has, else of default-src, else none."""
    return F.coalesce(*[F.try_element_at(policy, F.lit(d)) for d in (*directives, "default-src")], F.array().cast("array<string>"))


def _begins(sources: Column, prefix: str) -> Column:
    return F.exists(sources, lambda s: F.lower(s).startswith(prefix))


def allows_all_inline(sources: Column) -> Column:
    """'unsafe-inline', which is void next to a hash or a nonce."""
    strict = _begins(sources, "'sha256-") | _begins(sources, "'sha384-") | _begins(sources, "'sha512-") | _begins(sources, "'nonce-")
    return F.exists(sources, lambda s: F.lower(s) == "'unsafe-inline'") & ~strict


def permitted(sources: Column) -> Column:
    """Whether sources allow an inline element with the columns attributes and body, by a SHA-256 of its body or a nonce."""
    digest = F.concat(F.lit("'sha256-"), F.base64(F.unhex(F.sha2("body", 256))), F.lit("'"))
    hashed = F.exists(sources, lambda s: F.concat(F.lower(F.substring(s, 1, 8)), F.substring(s, 9, 200)) == digest)
    return allows_all_inline(sources) | hashed | (_begins(sources, "'nonce-") & has_attribute(F.col("attributes"), "nonce"))


def _elements_of(html: Column, tag: str) -> Column:
    """(kind, ordinal, attributes, body) of every element of a raw-text tag, as an array."""
    pattern = F.lit(rf"(?is)<{tag}(?=[\s/>]){_LIST}>(.*?)</{tag}\s*>")
    found = F.arrays_zip(F.regexp_extract_all(html, pattern, 1).alias("attributes"), F.regexp_extract_all(html, pattern, 2).alias("body"))
    return F.transform(found, lambda b, k: F.struct(F.lit(tag).alias("kind"), k.alias("ordinal"), b["attributes"].alias("attributes"), b["body"].alias("body")))


def findings(pages: DataFrame, id: str = "page_id", html: str = "html", policy: str = "policy") -> DataFrame:
    """(id, kind, ordinal, preview) of all that each page's policy (a column of text) would block.

    A page without a policy blocks nothing. Pages are read once: a page's elements leave it with its policy.
    """
    text = F.col(html)
    attributed = F.array(F.struct(F.lit("style_attribute").alias("kind"), F.lit(0).alias("ordinal"), F.lit("").alias("attributes"), F.lit("").alias("body")))
    none = F.filter(attributed, lambda _: F.lit(False))
    parts = F.concat(_elements_of(text, "script"), _elements_of(text, "style"), F.when(has_style_attribute(text), attributed).otherwise(none))
    found = pages.where(F.col(policy).isNotNull()).select(id, parse_policy(F.col(policy)).alias("_p"), F.explode(parts).alias("_f")).select(id, "_p", "_f.*")
    data = F.lower(F.trim(F.coalesce(attribute(F.col("attributes"), "type"), F.lit("")))).isin(DATA_TYPES)
    rules = lambda *directives: sources_for(F.col("_p"), *directives)
    blocked = (
        F.when(F.col("kind") == "script", ~has_attribute(F.col("attributes"), "src") & ~data & ~permitted(rules("script-src-elem", "script-src")))
        .when(F.col("kind") == "style", ~permitted(rules("style-src-elem", "style-src")))
        .otherwise(~allows_all_inline(rules("style-src-attr", "style-src")))
    )
    return found.where(blocked).select(id, "kind", "ordinal", F.regexp_replace(F.substring("body", 1, 48), r"\s+", " ").alias("preview"))


def boundary_errors(policy: Column) -> Column:
    """Which directives of a page without network, workers or WebAssembly allow too much: an array of names."""
    p = parse_policy(policy)
    has = lambda word, *d: F.exists(sources_for(p, *d), lambda s: F.lower(s) == word)
    rules = [(~has("'none'", "connect-src"), "connect-src"), (~has("'none'", "worker-src", "child-src"), "worker-src"), (has("'wasm-unsafe-eval'", "script-src"), "script-src")]
    return F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for wrong, name in rules]))


def forbidden_tokens(text: Column, tokens: list[str]) -> Column:
    """The tokens that a text contains, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in tokens]))


def header_policy(config: Column, header: str = "Content-Security-Policy") -> Column:
    """The header's value in the first header rule of a hosting configuration (a JSON document) that has it."""
    rules = F.from_json(config, "headers array<struct<source:string,headers:array<struct<key:string,value:string>>>>")["headers"]
    values = F.flatten(F.transform(rules, lambda r: F.filter(r["headers"], lambda h: F.lower(h["key"]) == header.lower())))
    return F.get(values, F.lit(0))["value"]


def origin_or_default(domain: Column, default: str) -> Column:
    """https://<domain> where that is a bare host (and port), else the default origin."""
    d = F.trim(domain)
    bare = d.rlike(r"^[A-Za-z0-9]([A-Za-z0-9.-]*[A-Za-z0-9])?(:[0-9]{1,5})?/?$")
    return F.when(bare, F.concat(F.lit("https://"), F.lower(F.regexp_replace(d, "/$", "")))).otherwise(default)


def platform_of(user_agent: Column, platform: Column) -> Column:
    ua, pf = F.lower(user_agent), F.lower(platform)
    mobile = ua.contains("iphone") | ua.contains("ipad") | ua.contains("android") | ua.contains("mobile")
    return F.when(mobile, "other").when(ua.contains("windows") | pf.startswith("win"), "windows").when(ua.contains("mac") | pf.startswith("mac"), "macos").otherwise("other")
