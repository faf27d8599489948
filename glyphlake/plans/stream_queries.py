"""Queries of the sink, of keyed state and of runs in waves, over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.sources.folders import work_folder
from glyphlake.streaming.admission import AdmissionLog, admit
from glyphlake.streaming.lines import line_streams as lines_of
from glyphlake.streaming.progress import BatchRun


def line_streams(spark, d):
    """Documents as base64 streams: some broken, some ended early, some without an end, some with a wrong count."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").selectExpr("doc_id", "split(text, '\\n') as ls", "octet_length(replace(text, '\\n', '')) as n")
    coded = F.transform(F.expr("ls"), lambda x: F.regexp_replace(F.base64(F.encode(x, "utf-8")), r"\s", ""))
    broken = F.transform(coded, lambda x, k: F.when((F.col("doc_id") % 11 == 0) & (k == 1), "?!").when((F.col("doc_id") % 5 == 0) & (k == 3), "__END__").otherwise(x))
    whole = F.when(F.col("doc_id") % 13 == 0, broken).otherwise(F.concat(broken, F.array(F.lit("__END__"))))
    lines = docs.select(F.col("doc_id").cast("string").alias("stream"), F.posexplode(whole).alias("number", "line"), F.expr("n + if(doc_id % 7 = 0, 1, 0)").alias("expected"))
    return lines_of(lines).where("status is not null").selectExpr("cast(stream as long) as doc_id", "status", "total", "lines")


def admission_log(spark, d):
    """Customers' files, offered as a stream: what was taken and why the rest wasn't."""
    schema = spark.read.parquet(f"{d}/customer.parquet").schema
    customers = spark.readStream.schema(schema).parquet(f"{d}/customer.parque[t]")  # a glob: streams take folders or globs
    files = customers.selectExpr("c_custkey as at", "concat(if(c_custkey % 3 = 0, upper(c_mktsegment), lower(c_mktsegment)), c_custkey % 1300, if(c_custkey % 7 = 0, '.gif', '.jpg')) as path")
    place = work_folder(spark, "admission")
    log = AdmissionLog(f"{place}/log", most=500)
    admit(files, log, f"{place}/checkpoint").awaitTermination()
    return log.rows(spark).select(F.col("at").alias("c_custkey"), "reason")


def sink_waves(spark, d):
    """Customers as photos through a run of four waves into the transactional sink, and read back with their files."""
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("path"), "c_name", "c_nationkey")

    def work(photos):
        status = F.when(F.col("c_nationkey") % 6 == 5, "failed").otherwise("succeeded")
        failed = F.when(status == "failed", F.lit("no date was found"))
        report = F.to_json(F.struct("path", "c_nationkey"))
        return photos.select(F.col("path").alias("stem"), status.alias("status"), F.col("path").alias("source"), F.encode("c_name", "utf-8").alias("png"), report.alias("report"), failed.alias("error"))

    place = work_folder(spark, "waves")
    BatchRun(customers, work, place, waves=4).run()
    rows = spark.read.format("photo_batch").option("files", "true").load(place)
    return rows.select(F.col("source").cast("long").alias("c_custkey"), "status", F.sha2("png", 256).alias("sha256"), F.get_json_object("report_json", "$.c_nationkey").cast("long").alias("nation"), "error")


QUERIES = {f.__name__: f for f in (line_streams, admission_log, sink_waves)}
ORACLES = {
    "line_streams": """with w as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
c as (select *, doc_id % 11 = 0 and len(ls) > 1 as broken, doc_id % 5 = 0 and len(ls) > 3 as early from w),
t as (select *, case when broken then ls[:1] when early then ls[:3] else ls end as kept from c where broken or early or doc_id % 13 <> 0),
b as (select *, octet_length(encode(array_to_string(kept, ''))) as total, octet_length(encode(array_to_string(ls, ''))) + (doc_id % 7 = 0)::int as expected from t)
select doc_id, case when broken then 'broken' when total = expected then 'whole' else 'short' end as status, total::bigint as total, len(list_filter(kept, lambda x: x <> ''))::bigint as lines from b""",
    "admission_log": """with f as (select c_custkey, lower(c_mktsegment) || (c_custkey % 1300) as path, c_custkey % 7 = 0 as other from customer),
k as (select c_custkey, row_number() over (partition by path order by c_custkey) = 1 as first from f where not other),
n as (select c_custkey, row_number() over (order by c_custkey) as n from k where first)
select f.c_custkey, case when other then 'unsupported' when not first then 'repeated' when n > 500 then 'over_limit' else 'accepted' end as reason
from f left join k using (c_custkey) left join n using (c_custkey)""",
    "sink_waves": """select c_custkey, if(c_nationkey % 6 = 5, 'failed', 'succeeded') as status, if(c_nationkey % 6 = 5, null, sha256(c_name)) as sha256,
  if(c_nationkey % 6 = 5, null, c_nationkey)::bigint as nation, if(c_nationkey % 6 = 5, 'no date was found', null) as error from customer""",
}
