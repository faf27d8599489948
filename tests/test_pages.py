"""A folder of pages and its hosting file to findings in one statement."""

import json

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import web_audit as A
from glyphlake.plans import table_queries
from glyphlake.sources import pages
from tests.conftest import SF


def test_folder_to_findings_in_sql(spark, tmp_path):
    pages.register(spark)
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    for r in rows:
        place = tmp_path / "out" / str(r["page_id"] % 3) / "deep"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{r['page_id']}.html").write_text(r["html"], encoding="utf-8", newline="")
        (place / "other.txt").write_text("<script>no()</script>")
    policy = "script-src 'self' 'unsafe-inline'; style-src 'none'; style-src-attr 'nonce-x'"
    config = {"headers": [{"source": "/", "headers": [{"key": "X-A", "value": "b"}, {"key": "Content-Security-Policy", "value": policy}]}]}
    (tmp_path / "hosting.json").write_text(json.dumps(config, indent=2))
    pages.page_folder(spark, str(tmp_path / "out")).createOrReplaceTempView("exported")
    pages.hosting_policy(spark, str(tmp_path / "hosting.json")).createOrReplaceTempView("hosting")
    got = spark.sql("select cast(regexp_extract(path, '([0-9]+)[.]html$', 1) as long) as page_id, f.* from exported cross join hosting, lateral blocked_elements(html, policy) f")
    table = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html", F.lit(policy).alias("policy"))
    want = A.findings(table)
    key = lambda df: sorted((r["page_id"], r["kind"], r["ordinal"], r["preview"]) for r in df.collect())
    assert key(got) == key(want) and len(key(want)) > 20


def test_table_functions_equal_the_operators(spark):
    pages.register(spark)
    table_queries._policies(spark, SF).createOrReplaceTempView("with_policies")
    got = spark.sql("select page_id, f.kind, count(*) as findings, min(f.preview) as preview from with_policies, lateral blocked_elements(html, policy) f group by page_id, f.kind")
    key = lambda df: sorted(map(str, df.select("page_id", "kind", "findings", "preview").collect()))
    assert key(got) == key(table_queries.csp_findings(spark, SF))
    odd = spark.createDataFrame([(1, "<SCRIPT Type=' importmap '>{}</script ><script src=a></script><style nonce>x{}</style><p style=a>"), (2, None), (3, "<script>1</script><script\n>é  b</script>")], "page_id long, html string")
    odd.createOrReplaceTempView("odd")
    rows = spark.sql("select page_id, e.* from odd, lateral inline_elements(html) e")
    want = A.elements(odd, "script").withColumn("kind", F.lit("script")).unionByName(A.elements(odd, "style").withColumn("kind", F.lit("style")))
    plain = lambda df: sorted((r["page_id"], r["kind"], r["ordinal"], r["attributes"], r["body"]) for r in df.collect())
    assert plain(rows) == plain(want) and len(plain(want)) == 5
    for policy in ("default-src 'none'", "style-src 'nonce-a'; script-src 'unsafe-inline' 'sha256-x'", ""):
        both = odd.withColumn("policy", F.lit(policy))
        both.createOrReplaceTempView("both")
        found = spark.sql("select page_id, f.* from both, lateral blocked_elements(html, policy) f")
        assert sorted(map(str, found.select("page_id", "kind", "ordinal", "preview").collect())) == sorted(map(str, A.findings(both).collect()))
    with pytest.raises(Exception, match="strings"):
        spark.sql("select * from odd, lateral inline_elements(page_id) e").collect()
