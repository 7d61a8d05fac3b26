"""Queries for configuration, files, checks, selection, reports and the composed engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia import engine
from provenia.operators import dedup, providers, quality, retrieval, sinks
from provenia.plans.registry import query, table
from provenia.sources import config, files


@query("""with e as (select c_custkey, case c_custkey % 4 when 0 then 'AU1' when 1 then '' else 'SG' end as iso, case c_custkey % 5 when 0 then 0 when 1 then 1 else 2 end as langs, c_custkey % 3 as portals from customer)
    select c_custkey, concat_ws('; ', case when iso = 'AU1' then 'invalid iso_code ''AU1''' end, case when langs = 0 then 'languages must not be empty' end, case when langs = 1 then 'invalid language code' end, case when portals = 0 then 'at least one portal is required' end) as wrong from e""")
def config_violations(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, d, "customer", "c_custkey").select(
        "c_custkey", F.when(key % 4 == 0, "AU1").when(key % 4 == 1, "").otherwise("SG").alias("iso_code"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 5 == 1, F.array(F.lit("en"), F.lit("English"))).otherwise(F.array(F.lit("en"))).alias("languages"),
        F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (key % 3).cast("int")).alias("portals"),
    )
    return rows.select("c_custkey", F.array_join(config.economy_violations(), "; ").alias("wrong"))


@query("""select l_orderkey, l_linenumber, 'P' || (6 + l_partkey % 2) || '-I' || (1 + l_orderkey % 7) as indicator_id from lineitem where 1 + l_orderkey % 7 <= 5""")
def taxonomy_valid_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('P', 6 + l_partkey % 2, '-I', 1 + l_orderkey % 7) as indicator_id")
    ids = spark.range(10).selectExpr("concat('P', 6 + id % 2, '-I', 1 + id div 2) as indicator_id")
    return config.with_valid_ids(rows, ids).select("l_orderkey", "l_linenumber", "indicator_id")


@query("""select distinct 'P' || (6 + p_size % 2) as indicator_id, lower(p_brand) as act, section from (select p_size, p_brand, (p_size % 4)::varchar as section from part union all select s_suppkey, 'Brand#11', (s_suppkey % 9)::varchar from supplier)""")
def seed_facade(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "part", "p_size", "p_brand").selectExpr("concat('P', 6 + p_size % 2) as indicator_id", "lower(p_brand) as act", "cast(p_size % 4 as string) as section")
    two = table(spark, d, "supplier", "s_suppkey").selectExpr("concat('P', 6 + s_suppkey % 2) as indicator_id", "'brand#11' as act", "cast(s_suppkey % 9 as string) as section")
    return config.seeds(one, two)


@query("""select l_orderkey, l_linenumber, case when l_quantity < 40 then case when l_linenumber % 3 = 0 then 'x; Recommend human review — OCR/translation source' else 'Recommend human review — OCR/translation source' end when l_linenumber % 3 = 0 then 'x' when l_linenumber % 3 = 1 then 'Recommend human review — OCR/translation source' else '' end as notes from lineitem""")
def confidence_note(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    notes = F.when(n == 0, "x").when(n == 1, quality.REVIEW_NOTE).otherwise("")
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", quality.with_review_note(notes, F.col("l_quantity").cast("double") / 50).alias("notes"))


@query("""select p_partkey, p_partkey % 5 not in (0, 1) as has_act, p_partkey % 3 = 0 or p_partkey % 7 = 0 as is_null from part""")
def null_row_flags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    act = F.when(k % 5 == 0, " N/A ").when(k % 5 == 1, F.lit(None)).otherwise(F.col("p_name"))
    article = F.when(k % 3 == 0, " n/a").otherwise("Section 1")
    snippet = F.when(k % 7 == 0, " [No qualifying provision]").otherwise("text")
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", quality.has_act(act).alias("has_act"), quality.is_null_row(article, snippet).alias("is_null"))


@query("""select doc_id, doc_id % 7 = 3 or contains(lower(coalesce(text, '')), 'thion') as target from documents""")
def probe_target(spark: SparkSession, d: str) -> DataFrame:
    article = F.concat((F.col("doc_id") % 7).cast("string"), F.lit("a"))
    target = quality.is_target(article, F.coalesce("text", F.lit("")), F.lit("3A"), F.array(F.lit("THION")))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", target.alias("target"))


@query("""select e.event_id, s.v as size from events e left join (select user_id, max(value) as v from events where event_type = 'purchase' group by 1) s using (user_id)""")
def content_by_url(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "user_id", "event_type", "value").withColumnRenamed("user_id", "source_url")
    blobs = rows.where("event_type = 'purchase'").groupBy("source_url").agg(F.max("value").alias("content"))
    return quality.with_content(rows.select("event_id", "source_url"), blobs).select("event_id", F.col("content").alias("size"))


@query("""with c as (select user_id as run, event_type as component, count(*) as calls, round(sum(abs(value)) / 1000, 6) as cost from (select *, value::double as v from events) group by all)
    select run, count(*) as components, sum(calls)::bigint as calls from c group by run""")
def cost_report(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events", "user_id", "event_type", "value").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("component"), F.lit(10).alias("tokens_in"), F.lit(5).alias("tokens_out"), F.lit(1).alias("pages"),
        F.abs("value").alias("latency_ms"), (F.abs("value") / 1000).alias("cost_usd"),
    )
    made = sinks.cost_reports(calls, ["run"]).select("run", F.from_json(F.get_json_object("report", "$.components"), "map<string, struct<calls: long>>").alias("c"))
    total = F.aggregate(F.map_values("c"), F.lit(0).cast("long"), lambda a, x: a + x["calls"])
    return made.select("run", F.size("c").cast("long").alias("components"), total.alias("calls"))


@query("""select o_orderstatus as economy, count(*) as n, count(*) as listed from orders where o_totalprice > 300000 group by 1""")
def diagnostics_report(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").where("o_totalprice > 300000").withColumnRenamed("o_orderstatus", "economy")
    made = sinks.diagnostics(found, ["economy"], ["o_orderkey", "o_totalprice"], "missing")
    return made.select("economy", "n", F.json_array_length(F.get_json_object("json", "$.missing")).cast("long").alias("listed"))


@query("""select event_id, event_type from events""")
def log_json_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = sinks.log_lines(table(spark, d, "events", "ts", "event_id", "event_type"), "ts")
    return lines.select(F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), F.get_json_object("line", "$.event_type").alias("event_type"))


@query()
def round_robin_shared(spark: SparkSession, d: str) -> DataFrame:
    """Parts by price for two brands each, so that a part stands in several queues; some parts have no brand of a group."""
    parts = table(spark, d, "part", "p_partkey", "p_brand", "p_retailprice", "p_name").select(F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("url"), (-F.col("p_retailprice")).alias("rank"), "p_brand")
    groups = parts.where("p_brand < 'Brand#4'").select(F.explode(F.array(F.col("p_brand"), F.lit("Brand#99"))).alias("grp"), "title")
    return dedup.round_robin(parts.select("title", "url", "rank"), groups, 25).select("title", "url")


@query("""select conv_id, turn, case when turn % 3 <> 0 then 'plain' when turn % 2 = 0 then 'headers' end as rung from conversations""")
def transport_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first of two fetches that has text; a blank page is no answer."""
    turn = F.col("turn")
    plain, headers = F.when(turn % 3 != 0, F.concat(F.lit("page "), turn)).otherwise(""), F.when(turn % 2 == 0, F.concat(F.lit("page "), turn))
    body, rung = providers.first_real([("plain", plain), ("headers", headers)], lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    return table(spark, d, "conversations", "conv_id", "turn").select("conv_id", "turn", rung.alias("rung"))


@query("""select s_suppkey, 'Data Privacy Act ' || s_suppkey as title from supplier""")
def title_of_file(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("file:/acts/data_privacy-ACT_"), F.col("s_suppkey"), F.lit(".pdf"))
    return table(spark, d, "supplier", "s_suppkey").select("s_suppkey", files.title_of_file(path).alias("title"))


@query("""select min(o_orderkey) as first_seen, o_custkey from orders group by o_custkey""")
def restore_order(spark: SparkSession, d: str) -> DataFrame:
    kept = dedup.keep_best(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice"), [F.col("o_custkey")], [F.col("o_totalprice")], "o_orderkey")
    return dedup.in_order(kept).select("first_seen", "o_custkey")


@query()
def engine_extract(spark: SparkSession, d: str) -> DataFrame:
    """The whole engine over every document with the offline stand-in as its model."""
    docs = table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", "text", F.concat(F.lit("Act "), F.col("doc_id"), F.lit(" 2012")).alias("title"), F.concat(F.lit("https://e.org/Act/"), "doc_id").alias("source_url"), F.lit("AU").alias("economy"),
    )
    questions = spark.createDataFrame([("P6-I1", "the with and", ["thion"]), ("P7-I2", "der und die", [])], "query string, question string, keywords array<string>")
    known = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("act "), "doc_id").alias("act"), F.lit("1").alias("section"))
    return engine.extract(docs, questions, known, [providers.EchoProvider()]).drop("rec_no")


@query("""with k as (select distinct 6 + l_partkey % 2 as p, 1 + l_orderkey % 5 as i from lineitem where l_quantity > 49)
    select 'P' || p as pillar, 5::bigint as known_total, count(*)::bigint as known_matched, 0::bigint as new_discovered, round(count(*) / 5.0 * 40, 1)::double as total_score from k group by p""")
def engine_evaluate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("concat('P', 6 + l_partkey % 2, '-I', 1 + l_orderkey % 5) as indicator_id", "l_quantity")
    written = rows.where("l_quantity > 49").select("indicator_id", F.lit("Section 1").alias("article"), F.lit("text").alias("verbatim_snippet"), F.lit("KNOWN").alias("discovery_tag"), F.lit("Act X").alias("law_name"))
    empty = rows.select("indicator_id", F.lit("N/A").alias("article"), F.lit("[No qualifying").alias("verbatim_snippet"), F.lit("KNOWN").alias("discovery_tag"), F.lit("Act X").alias("law_name"))
    truth = rows.select("indicator_id").distinct()
    keys = spark.createDataFrame([("act x", "section 1")], "law_key string, art_key string")
    return engine.evaluate(written.unionByName(empty), truth, keys).select("pillar", "known_total", "known_matched", F.col("new_discovered").cast("long").alias("new_discovered"), "total_score")
