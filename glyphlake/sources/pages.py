"""Folders of exported pages, their hosting configuration, and table functions over pages for SQL.

``register(spark)`` makes two table functions for LATERAL joins: ``inline_elements(html)`` gives (kind, ordinal,
attributes, body) of every script and style element, ``blocked_elements(html, policy)`` gives (kind, ordinal, preview) of
what a policy would block, as ``operators.web_audit.findings`` does for DataFrames. Their arguments are checked when the
statement is analysed.

Defined cases: a null page or policy gives no rows; a folder without pages gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from glyphlake.operators import web_audit as A

ELEMENT = {tag: re.compile(rf"<{tag}(?=[\s/>]){A._LIST}>(.*?)</{tag}\s*>", re.S | re.I) for tag in ("script", "style")}
TAG = re.compile(rf"<[A-Za-z][^\s/>]*{A._LIST}>", re.S)
ATTRIBUTE = re.compile(A._ATTRIBUTE)


def page_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of all pages below a folder, each as one text."""
    pages = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    return pages.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def hosting_policy(spark: SparkSession, path: str) -> DataFrame:
    """(policy) of a hosting configuration: one row, the policy of its first header rule that has one."""
    config = spark.read.text(path, wholetext=True)
    return config.select(A.header_policy(F.col("value")).alias("policy"))


def _attributes(text: str) -> dict[str, str | None]:
    """The first value of each attribute, without quotes."""
    out: dict[str, str | None] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), re.sub("^[\"']|[\"']$", "", value))
    return out


def _policy(text: str) -> dict[str, list[str]]:
    words = [part.split() for part in text.split(";")]
    return {w[0].lower(): w[1:] for w in words if w}


def _allowed(policy: dict[str, list[str]], *directives: str) -> list[str]:
    return next((policy[d] for d in (*directives, "default-src") if d in policy), [])


def _open(sources: list[str]) -> bool:
    """Whether they allow everything inline: hashes and nonces make that word void."""
    low = [s.lower() for s in sources]
    return "'unsafe-inline'" in low and not any(s.startswith(("'sha256-", "'sha384-", "'sha512-", "'nonce-")) for s in low)


def _permits(sources: list[str], attributes: str, body: str) -> bool:
    digest = base64.b64encode(hashlib.sha256(body.encode()).digest()).decode()
    hashed = any(s[:8].lower() + s[8:] == f"'sha256-{digest}'" for s in sources)
    return _open(sources) or hashed or (any(s.lower().startswith("'nonce-") for s in sources) and "nonce" in _attributes(attributes))


def _of_strings(names: str, *arguments: AnalyzeArgument) -> AnalyzeResult:
    for a in arguments:
        if not isinstance(a.dataType, StringType):
            raise ValueError(f"pages and policies are strings, not {a.dataType.simpleString()}")
    out = StructType()
    for name in names.split():
        out = out.add(name, IntegerType() if name == "ordinal" else StringType())
    return AnalyzeResult(out)


@udtf
class InlineElements:
    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        return _of_strings("kind ordinal attributes body", html)

    def eval(self, html: str):
        for kind, pattern in ELEMENT.items():
            for k, found in enumerate(pattern.finditer(html or "")):
                yield kind, k, found[1], found[2]


@udtf
class BlockedElements:
    @staticmethod
    def analyze(html: AnalyzeArgument, policy: AnalyzeArgument) -> AnalyzeResult:
        return _of_strings("kind ordinal preview", html, policy)

    def eval(self, html: str, policy: str):
        if html is None or policy is None:
            return
        rules = _policy(policy)
        for kind, pattern in ELEMENT.items():
            sources = _allowed(rules, f"{kind}-src-elem", f"{kind}-src")
            for k, found in enumerate(pattern.finditer(html)):
                told = _attributes(found[1])
                runs = kind == "style" or ("src" not in told and (told.get("type") or "").strip().lower() not in A.DATA_TYPES)
                if runs and not _permits(sources, found[1], found[2]):
                    yield kind, k, re.sub(r"[ \t\n\x0b\f\r]+", " ", found[2][:48])
        if not _open(_allowed(rules, "style-src-attr", "style-src")) and any("style" in _attributes(t[1]) for t in TAG.finditer(html)):
            yield "style_attribute", 0, ""


def register(spark: SparkSession) -> None:
    spark.udtf.register("inline_elements", InlineElements)
    spark.udtf.register("blocked_elements", BlockedElements)
