"""Queries for joins, aggregations, windows, de-duplication and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenia.functions import text as T
from provenia.functions import urls as U
from provenia.operators import dedup, identity, quality, scoring
from provenia.plans.registry import query, table

#: Provisions made from line items: (name, Spark expression, SQL expression) is the same text in both dialects.
_PROVISIONS = {
    "rec_no": "l_orderkey * 10 + l_linenumber", "act": "'act ' || l_suppkey", "section": "cast(l_linenumber as varchar)",
    "indicator_id": "'P' || cast(6 + l_partkey % 2 as varchar) || '-I' || cast(1 + l_orderkey % 5 as varchar)",
    "tag": "case when l_orderkey % 3 = 0 then 'NEW' else 'KNOWN' end", "confidence": "cast(l_quantity as double) / 50",
    "snippet": "'text ' || l_linestatus || ' ' || l_returnflag", "law_name": "'Act ' || upper(l_linestatus)",
    "source_url": "case when l_partkey % 3 = 0 then 'https://e.org/Act/' else 'https://e.org/acts-supp/' end || l_partkey",
    "location_reference": "case when l_linenumber % 2 = 0 then 'unknown' else 'Page ' || l_linenumber end",
}
_PROV_SQL = "(select " + ", ".join(f"{v} as {k}" for k, v in _PROVISIONS.items()) + " from lineitem)"


#: Rows of a task where they are sorted.
_ROWS = 500_000


def provisions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.selectExpr(*[f"{_PROVISIONS[c].replace('as varchar', 'as string')} as {c}" for c in (columns or _PROVISIONS)])


_SEED_SQL = "(select 'P' || (6 + ps % 2) || '-I' || (1 + ps % 5) as indicator_id, 'act ' || s_suppkey as act, ps::varchar as section from supplier, (select unnest(range(1, 8)) as ps) where (s_suppkey + ps) % 3 = 0)"


def seed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier", "s_suppkey").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("ps")).where("(s_suppkey + ps) % 3 = 0")
    return rows.selectExpr("concat('P', 6 + ps % 2, '-I', 1 + ps % 5) as indicator_id", "concat('act ', s_suppkey) as act", "cast(ps as string) as section")


# -- joins ------------------------------------------------------------------------------------------------------------


@query("""select o_orderkey, case when o_custkey % 7 = 0 or c.c_nationkey % 5 = 0 then 'KNOWN' else 'NEW' end as tag from orders join customer c on o_custkey = c_custkey""")
def join_known_tag(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer", "c_custkey", "c_nationkey")
    nation = F.concat(F.lit("Nation "), F.col("c_nationkey"), F.lit(" of"))
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", F.concat(F.lit("https://E.org/"), F.col("o_custkey"), F.lit("/?lang=en")).alias("url"), F.concat(nation, F.lit(" 2012")).alias("title"))
    urls = customers.where("c_custkey % 7 = 0").select(F.concat(F.lit("https://e.org/"), F.col("c_custkey"), F.lit("/")).alias("url_norm"))
    titles = customers.where("c_nationkey % 5 = 0").select(T.normalise_title(nation).alias("title_norm")).distinct()
    return identity.tag_known(rows, urls, titles).select("o_orderkey", "tag")


_DOMAIN = "regexp_extract(lower(url), '([a-z0-9-]+[.][a-z0-9-]+)(?:[/?#:]|$)', 1)"


@query(f"""with p as (select {_DOMAIN} as domain, page_id from pages), f as (select domain, min(page_id) as portal from p group by domain)
    select p.domain, f.portal, count(*) as n from p left join f using (domain) group by all""")
def join_portal_audit(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages", "page_id", "url")
    portals = pages.select(U.registered_domain(F.col("url")).alias("domain"), F.col("page_id").alias("portal"), F.col("page_id").alias("pos"))
    return identity.first_portal(pages, portals).groupBy("domain", "portal").agg(F.count("*").alias("n"))


_FUZZY_STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOPWORDS)


@query(f"""with k as (select distinct lower(p_name) as key from part), n as (select distinct p_name || ' Act 2012' as name, lower(p_name) || ' act' as norm from part),
    kw as (select key, list_distinct(list_filter(regexp_extract_all(key, '[a-z0-9]+'), lambda w: w not in ({_FUZZY_STOP}))) as b from k),
    nw as (select name, norm, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: w not in ({_FUZZY_STOP}) and not regexp_matches(w, '^[0-9]+$'))) as a from n),
    j as (select name, key, case when norm = key then 0 when len(list_intersect(a, b)) = least(len(a), len(b)) and least(len(a), len(b)) >= 2 then 3
        when len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double >= 0.6 then 4 end as rule from nw, kw),
    r as (select *, row_number() over (partition by name order by rule, key) as n from j where rule is not null)
    select name, key, rule from r where n = 1""")
def join_fuzzy_title(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part", "p_name").select(F.concat("p_name", F.lit(" Act 2012")).alias("name"))
    keys = table(spark, d, "part", "p_name").select(F.lower("p_name").alias("key"))
    return identity.match_titles(names, keys)


@query(f"""select l_orderkey, l_linenumber, case when (l_suppkey + l_linenumber) % 3 = 0 then 'KNOWN' else 'NEW' end as tag from lineitem""")
def join_provision_tag(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").withColumns({
        "law_name": F.concat(F.lit("Act "), F.col("l_suppkey"), F.lit(" 2012")), "article": F.concat(F.lit("Section "), F.col("l_linenumber"), F.lit("(1)")),
        "source_url": F.concat(F.lit("https://e.org/"), F.col("l_suppkey"), F.lit("?WholeDoc=1")), "doc_tag": F.lit("KNOWN"),
    })
    known = seed(spark, d).select("act", "section")
    anchors = table(spark, d, "supplier", "s_suppkey").select(F.concat(F.lit("https://e.org/"), F.col("s_suppkey"), F.lit("#pr99-")).alias("anchor"))
    return identity.tag_provisions(rows, known, anchors).select("l_orderkey", "l_linenumber", "tag")


@query("""with m as (select b.item_id, d.doc_id, row_number() over (partition by b.item_id order by d.doc_id) as n from benchmark b join documents d on contains(d.text, b.text))
    select b.item_id, m.doc_id from benchmark b left join m on b.item_id = m.item_id and n = 1""")
def join_snippet_chunk(spark: SparkSession, d: str) -> DataFrame:
    """First document that contains a snippet: blocked on the longest word inside it instead of testing all pairs. A snippet of one or two words has none and is not looked for."""
    items = table(spark, d, "benchmark", "item_id", "text")
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), 0)
    longest = F.max_by(F.col("w"), F.struct(F.length("w"), F.col("w")))
    listed = items.withColumn("ws", words(F.trim("text"))).where("size(ws) > 2")
    inner = listed.select("item_id", "text", F.explode(F.slice("ws", F.lit(2), F.size("ws") - 2)).alias("w")).groupBy("item_id", "text").agg(longest.alias("w"))
    docs = table(spark, d, "documents", "doc_id", "text").withColumnRenamed("text", "body")
    blocked = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("body")))).alias("w")).join(inner, "w").select("doc_id", "item_id", "text")
    found = blocked.join(docs, "doc_id").where(F.contains("body", F.col("text"))).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    return items.select("item_id").join(found, "item_id", "left")


@query("""select c_custkey, n_name as un_name from customer join nation on c_nationkey = n_nationkey""")
def join_iso_name(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation", "n_nationkey", "n_name")
    return table(spark, d, "customer", "c_custkey", "c_nationkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("un_name"))


@query("""with e as (select n_nationkey % 10 as ind, count(*) as n from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 = 0 group by 1), t as (select range as ind from range(12))
    select t.ind, coalesce(e.n, 0) as n, case when e.n is null then 'missing' when t.ind % 2 = 0 then 'agrees' else 'extra' end as verdict from t left join e using (ind)""")
def join_round1_compare(spark: SparkSession, d: str) -> DataFrame:
    truth = spark.range(12).select(F.col("id").alias("ind"))
    engine = table(spark, d, "supplier", "s_suppkey", "s_nationkey").where("s_suppkey % 3 = 0").groupBy((F.col("s_nationkey") % 10).cast("long").alias("ind")).agg(F.count("*").alias("n"))
    verdict = F.when(F.col("n").isNull(), "missing").when(F.col("ind") % 2 == 0, "agrees").otherwise("extra")
    return truth.join(engine, "ind", "left").select("ind", F.coalesce("n", F.lit(0)).alias("n"), verdict.alias("verdict"))


@query(f"""with e as (select distinct act, section, indicator_id from {_PROV_SQL} where tag = 'KNOWN'), s as (select distinct * from {_SEED_SQL})
    select s.act, s.section, s.indicator_id, case when e.act is not null then 'found' when s.act in (select act from e) then 'provision_missing' else 'act_missing' end as status
    from s left join e using (act, section, indicator_id)""")
def audit_recall(spark: SparkSession, d: str) -> DataFrame:
    return scoring.recall_audit(seed(spark, d), provisions(spark, d, "act", "section", "indicator_id", "tag").where("tag = 'KNOWN'"))


@query("""select 'P7-I' || c as indicator_id, 'Act ' || c as law_name, 'N/A' as article, 'KNOWN' as discovery_tag, '[No qualifying provision identified — assessed as no barrier]' as verbatim_snippet
    from (select distinct c_nationkey as c from customer) where c not in (select s_nationkey from supplier where s_suppkey % 4 = 0)""")
def anti_null_rows(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.concat(F.lit("P7-I"), F.col(c)).alias("indicator_id")
    assessed = table(spark, d, "customer", "c_nationkey").select(of("c_nationkey"), F.concat(F.lit("act "), F.col("c_nationkey")).alias("title"))
    return scoring.null_rows(assessed, table(spark, d, "supplier", "s_suppkey", "s_nationkey").where("s_suppkey % 4 = 0").select(of("s_nationkey")))


@query("""select l_orderkey, l_linenumber from lineitem where l_orderkey % 3 = 0 and not (l_suppkey % 5 = 0 and l_linenumber <= 3) and l_suppkey % 11 <> 0""")
def anti_genuine_new(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").withColumns({
        "discovery_tag": F.when(F.col("l_orderkey") % 3 == 0, " new").otherwise("KNOWN"), "law_name": F.concat(F.lit("Act  "), F.col("l_suppkey")), "article": F.concat(F.lit("Section "), F.col("l_linenumber")),
    })
    acts = table(spark, d, "supplier", "s_suppkey").select("s_suppkey", F.concat(F.lit("act "), F.col("s_suppkey")).alias("law_key"))
    exact = acts.where("s_suppkey % 5 = 0").select("law_key", F.explode(F.array(*[F.lit(f"section {i}") for i in (1, 2, 3)])).alias("art_key"))
    known = exact.unionByName(acts.where("s_suppkey % 11 = 0").select("law_key", F.lit("").alias("art_key")))
    return scoring.genuine_new(rows, known).select("l_orderkey", "l_linenumber")


@query("""select o_orderkey, length(o_orderpriority) as n, upper(o_orderpriority) as probe from orders""")
def dedup_apply_join(spark: SparkSession, d: str) -> DataFrame:
    probed = lambda keys: keys.select("o_orderpriority", F.length("o_orderpriority").alias("n"), F.upper("o_orderpriority").alias("probe"))
    return quality.dedup_apply_join(table(spark, d, "orders", "o_orderkey", "o_orderpriority"), "o_orderpriority", probed).select("o_orderkey", "n", "probe")


# -- aggregations -----------------------------------------------------------------------------------------------------


@query("""with w as (select p_brand, unnest(string_split(p_name, ' ')) as k, p_partkey, generate_subscripts(string_split(p_name, ' '), 1) as i from part),
    f as (select p_brand, k, min(p_partkey * 100 + i) as pos from w group by 1, 2)
    select p_brand, string_agg(k, ',' order by pos) as keywords from f group by 1""")
def agg_keywords_ordered(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part", "p_brand", "p_partkey", "p_name").select("p_brand", "p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "k"))
    first = words.groupBy("p_brand", "k").agg(F.min(F.struct("p_partkey", "i")).alias("at"))
    return first.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "k"))), lambda x: x["k"]), ",").alias("keywords"))


@query(f"""select indicator_id, act, string_agg(section, ',' order by section) as sections from (select distinct * from {_SEED_SQL}) group by 1, 2""")
def agg_sections_multimap(spark: SparkSession, d: str) -> DataFrame:
    return seed(spark, d).groupBy("indicator_id", "act").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))


@query("""with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) as w, lang from documents),
    s as (select lang, count(*) as n, avg(len(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'))) as avgdl from documents group by lang),
    df as (select lang, w, count(distinct doc_id) as df from t group by 1, 2), r as (select df.*, ln(n - df + 0.5) - ln(df + 0.5) as raw from df join s using (lang)),
    m as (select lang, avg(raw) as m, count(*) as terms from r group by lang)
    select lang, s.n, round(s.avgdl, 6) as avgdl, m.terms, round(sum(case when raw < 0 then 0.25 * m.m else raw end), 4) as idf_sum from r join m using (lang) join s using (lang) group by all""")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    from provenia.operators import lexical

    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    stats = lexical.statistics(docs, ["lang"], "text")
    idf = lexical.inverse_frequencies(lexical.document_terms(docs, ["lang"], "text"), stats, ["lang"])
    sums = idf.groupBy("lang").agg(F.count("*").alias("terms"), F.round(F.sum("idf"), 4).alias("idf_sum"))
    return stats.join(sums, "lang").select("lang", "n", F.round("avgdl", 6).alias("avgdl"), "terms", "idf_sum")


@query(f"""select indicator_id, count(*) as n, count(*) filter (tag = 'KNOWN') as known, count(distinct act) as acts, count(distinct act) filter (tag = 'KNOWN') as known_acts from {_PROV_SQL} group by 1""")
def report_acts(spark: SparkSession, d: str) -> DataFrame:
    """Acts are counted over one row an act, so nothing is gathered a group but a map-side partial."""
    acts = provisions(spark, d, "indicator_id", "act", "tag").groupBy("indicator_id", "act").agg(F.count("*").alias("n"), F.count_if(F.col("tag") == "KNOWN").alias("known"))
    return acts.groupBy("indicator_id").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.count("*").alias("acts"), F.count_if(F.col("known") > 0).alias("known_acts"))


@query("""select coalesce(event_type, 'total') as component, count(*) as calls, round(sum(value / 1000 * 0.003), 6) as cost from (select event_type, value::double as value from events) group by rollup(event_type)""")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    rolled = table(spark, d, "events", "event_type", "value").rollup("event_type").agg(F.count("*").alias("calls"), F.round(F.sum(F.col("value").cast("double") / 1000 * 0.003), 6).alias("cost"))
    return rolled.select(F.coalesce("event_type", F.lit("total")).alias("component"), "calls", "cost")


_PROVIDER = "case event_id % 4 when 0 then 'anthropic' when 1 then 'gemini' when 2 then 'ollama' else 'other' end"


@query(f"""select event_id, {_PROVIDER} as provider, round(case event_id % 4 when 0 then value / 1000 * 0.003 + 0.5 * 0.015 when 1 then value / 1000 * 0.0003 + 0.5 * 0.0025 else 0 end, 8) as cost from (select event_id, value::double as value from events)""")
def llm_cost(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events", "event_id", "value").select("event_id", F.expr(_PROVIDER).alias("provider"), F.col("value").cast("double").alias("tokens_in"), F.lit(500).alias("tokens_out"))
    return scoring.llm_cost(calls).select("event_id", "provider", F.round("cost_usd", 8).alias("cost"))


@query(f"""with c as (select user_id, event_id, {_PROVIDER} as provider, event_type, value::double as value from events), f as (select user_id, arg_min(provider, event_id) as first, arg_max(value, event_id) as last_value from c group by 1)
    select c.user_id, count(*) as calls, round(sum(value), 4) as tokens, any_value(f.first) as first_provider, bool_or(provider <> f.first) as fell_back, any_value(f.last_value) as last_tokens from c join f using (user_id) group by 1""")
def cost_llm_entry(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events", "user_id", "event_id", "value").select("user_id", "event_id", F.expr(_PROVIDER).alias("provider"), F.col("value").cast("double").alias("value"))
    g = c.groupBy("user_id").agg(
        F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("tokens"), F.min_by("provider", "event_id").alias("first_provider"),
        F.min("provider").alias("_a"), F.max("provider").alias("_b"), F.max_by("value", "event_id").alias("last_tokens"),
    )
    return g.withColumn("fell_back", F.col("_a") != F.col("_b")).drop("_a", "_b")


@query("""select event_type, count(*) as total, count(*) filter (value > 100) as ok, count(*) filter (value <= 100) as broken, count(*) filter (value is null) as missing from events group by 1""")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("value") > 100).alias("ok"), F.count_if(F.col("value") <= 100).alias("broken"), F.count_if(F.col("value").isNull()).alias("missing")
    )


_EVAL = """known as (select c_nationkey % 2 + 6 as pillar, c_nationkey as ind from customer group by all), engine as (select s_nationkey % 2 + 6 as pillar, s_nationkey as ind from supplier where s_suppkey % 2 = 0 group by all),
    fresh as (select s_nationkey % 2 + 6 as pillar, count(*) as n from supplier where s_suppkey % 17 = 0 group by 1),
    c as (select known.pillar, count(*) as known_total, count(engine.ind) as known_matched from known left join engine using (pillar, ind) group by 1),
    f as (select c.*, coalesce(n, 0) as new_discovered from c left join fresh using (pillar))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    pillar = lambda c: (F.col(c) % 2 + 6).cast("long").alias("pillar")
    suppliers = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    known = table(spark, d, "customer", "c_nationkey").select(pillar("c_nationkey"), F.col("c_nationkey").alias("indicator_id"))
    engine = suppliers.where("s_suppkey % 2 = 0").select(pillar("s_nationkey"), F.col("s_nationkey").alias("indicator_id"))
    return scoring.scores(known, engine, suppliers.where("s_suppkey % 17 = 0").select(pillar("s_nationkey")))


_POINTS = "round(known_matched / known_total * 40, 1) as known_score, round(least(new_discovered * 4, 20)::double, 1) as new_score, round(known_matched / known_total * 40 + least(new_discovered * 4, 20), 1) as total_score"


@query(f"""with {_EVAL} select *, {_POINTS} from f""")
def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@query(f"""with {_EVAL}, r as (select pillar, sum(known_total)::bigint as known_total, sum(known_matched)::bigint as known_matched, sum(new_discovered)::bigint as new_discovered from f group by rollup(pillar))
    select pillar, known_total, known_matched, new_discovered, {_POINTS} from r""")
def eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("known_total", "known_matched", "new_discovered")]
    return scoring.with_points(_scored(spark, d).rollup("pillar").agg(*sums))


@query("""select 'act ' || s_suppkey as law, case when s_suppkey % 3 = 0 then '' else 'section ' || s_suppkey end as art from supplier""")
def eval_known_keys(spark: SparkSession, d: str) -> DataFrame:
    """Anchored URLs name a section, bare ones the law as a whole."""
    url = F.concat(F.lit("https://e.org/act "), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("#pr"), F.col("s_suppkey"), F.lit("-"))))
    rows = table(spark, d, "supplier", "s_suppkey").select(F.explode(F.split(F.concat(url, F.lit(";")), ";")).alias("u")).where("u != ''")
    section = F.regexp_extract(U.fragment_of(F.col("u")), r"pr(\d+[a-z]?)-", 1)
    return rows.select(F.regexp_extract("u", r"org/([^#]*)", 1).alias("law"), F.when(section != "", F.concat(F.lit("section "), section)).otherwise("").alias("art"))


@query("""select doc_id, round(sum(length(l))::double / any_value(length(text)), 6) as coverage from (select doc_id, text, unnest(string_split(text, chr(10))) as l from documents) where length(l) >= 80 group by doc_id""")
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 80)
    share = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.length("text")
    return table(spark, d, "documents", "doc_id", "text").where(F.size(lines) > 0).select("doc_id", F.round(share, 6).alias("coverage"))


@query("""with t as (select user_id, event_type, sum(value)::double as ms from events group by all) select user_id, event_type, round(100 * ms / sum(ms) over (partition by user_id), 6) as pct from t""")
def stage_timing_pct(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.sum("value").cast("double").alias("ms"))
    return t.select("user_id", "event_type", F.round(100 * F.col("ms") / F.sum("ms").over(Window.partitionBy("user_id")), 6).alias("pct"))


@query("""select source, round(avg(c), 6) as cer, avg(c) >= 0.05 as gated from (select source, (doc_id % 13) / 100.0::double as c from documents) group by source""")
def cer_gate(spark: SparkSession, d: str) -> DataFrame:
    mean = table(spark, d, "documents", "doc_id", "source").groupBy("source").agg(F.avg((F.col("doc_id") % 13) / 100).alias("m"))
    return mean.select("source", F.round("m", 6).alias("cer"), (F.col("m") >= quality.CER_GATE).alias("gated"))


@query("""select lang, round(avg((doc_id % 13) / 100.0::double), 6) as cer from documents group by lang""")
def cer_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "lang").groupBy("lang").agg(F.round(F.avg((F.col("doc_id") % 13) / 100), 6).alias("cer"))


@query("""select source, count(*) filter (trim(text) = '' or length(text) < 100)::double / count(*) > 0.3 as scanned, round(count(*) filter (trim(text) = '' or length(text) < 100)::double / count(*), 6) as share from documents group by source""")
def doc_empty_page_ratio(spark: SparkSession, d: str) -> DataFrame:
    share = F.count_if(F.length("text") < 100) / F.count("*")
    return table(spark, d, "documents", "source", "text").groupBy("source").agg((share > 0.3).alias("scanned"), F.round(share, 6).alias("share"))


# -- windows, de-duplication, top-k -----------------------------------------------------------------------------------


@query(f"""with k as (select *, upper(source_url) like '%/ACT/%' and upper(source_url) not like '%/ACTS-SUPP/%' as c from {_PROV_SQL}),
    r as (select *, row_number() over (partition by lower(law_name), indicator_id, section, lower(snippet) order by c desc, confidence desc, (location_reference not like '%unknown%') desc, rec_no) as n,
        min(rec_no) over (partition by lower(law_name), indicator_id, section, lower(snippet)) as first_seen from k)
    select rec_no, first_seen from r where n = 1""")
def dedup_cross_doc(spark: SparkSession, d: str) -> DataFrame:
    rows = provisions(spark, d).withColumnRenamed("section", "article").withColumnRenamed("snippet", "verbatim_snippet")
    return dedup.across_documents(rows).select("rec_no", "first_seen")


@query(f"""with r as (select *, row_number() over (partition by indicator_id, section, substring(snippet, 1, 80) order by confidence desc, rec_no) as n, min(rec_no) over (partition by indicator_id, section, substring(snippet, 1, 80)) as first_seen from {_PROV_SQL})
    select rec_no, first_seen from r where n = 1""")
def dedup_mapper(spark: SparkSession, d: str) -> DataFrame:
    rows = provisions(spark, d, "rec_no", "indicator_id", "section", "snippet", "confidence").withColumnRenamed("section", "article").withColumnRenamed("snippet", "verbatim_snippet")
    return dedup.within_document(rows).select("rec_no", "first_seen")


@query(f"""select min(rec_no) as rec_no from {_PROV_SQL} group by section, substring(snippet, 1, 50)""")
def dedup_response(spark: SparkSession, d: str) -> DataFrame:
    rows = provisions(spark, d, "rec_no", "section", "snippet").withColumnRenamed("section", "article").withColumnRenamed("snippet", "verbatim_snippet")
    return dedup.within_response(rows).select("rec_no")


@query(f"""with s as (select distinct * from {_SEED_SQL}), p as (select p.*, p.tag = 'KNOWN' and exists (select 1 from s where s.act = p.act and s.section = p.section) as truth,
        exists (select 1 from s where s.act = p.act and s.section = p.section and s.indicator_id = p.indicator_id) as ok from {_PROV_SQL} p),
    f as (select *, truth and not ok as outside, max((truth and ok)::int) over (partition by act, section) as any_in from p)
    select rec_no, outside, outside and any_in = 1 as dropped from f""")
def prune_known(spark: SparkSession, d: str) -> DataFrame:
    return dedup.prune_known(provisions(spark, d, "rec_no", "act", "section", "indicator_id", "tag"), seed(spark, d)).select("rec_no", "outside", "dropped")


@query(f"""select page_id from (select page_id, row_number() over (partition by regexp_extract(lower(rtrim(url, '/')), '^([^?#]*)', 1) order by page_id) as n from pages) where n = 1""")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages", "page_id", "url").withColumn("key", U.before_query(U.normalise_url(F.col("url"))))
    return identity.first_of(rows, "key", "page_id").select("page_id")


@query("""with r as (select o_orderkey, o_orderpriority as grp, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rn from orders)
    select o_orderkey, grp, rn from r order by rn, grp limit 12""")
def topk_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """The next best of each group in turn, up to a cap. Each group gives at most the cap, so the final sort is small."""
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").withColumn("rn", rank).where("rn <= 12")
    return rows.select("o_orderkey", F.col("o_orderpriority").alias("grp"), F.col("rn").cast("long").alias("rn")).orderBy("rn", "grp").limit(12)


@query("""with r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as rn from orders)
    select o_orderkey, o_orderstatus, rn from r where rn <= case o_orderstatus when 'F' then 12 when 'O' then 8 else 3 end""")
def topk_per_tag_cap(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").withColumn("rn", rank).where("rn <= 12")
    cap = F.when(F.col("o_orderstatus") == "F", 12).when(F.col("o_orderstatus") == "O", 8).otherwise(3)
    return rows.where(F.col("rn") <= cap).select("o_orderkey", "o_orderstatus", F.col("rn").cast("long").alias("rn"))


@query("""with s as (select conv_id, turn, length(text) // 4 as t from conversations), r as (select *, sum(t) over (partition by conv_id order by turn) as used from s)
    select conv_id, turn, used::bigint as used from r where turn = 0 or used <= 300""")
def win_token_budget(spark: SparkSession, d: str) -> DataFrame:
    used = F.sum(F.expr("length(text) div 4")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations", "conv_id", "turn", "text").withColumn("used", used).where("turn = 0 or used <= 300").select("conv_id", "turn", "used")


@query("""select conv_id, role, arg_max(turn, length(text) * 1000 - turn) as turn, max(length(text)) as n from conversations group by all""")
def argmax_section(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by("turn", F.struct(F.length("text"), -F.col("turn")))
    return table(spark, d, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id", "role").agg(best.alias("turn"), F.max(F.length("text")).cast("long").alias("n"))


@query("""select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as pillar from events""")
def win_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, d, "events", "event_id", "user_id", "event_type").select("event_id", F.last(marked, ignorenulls=True).over(w).alias("pillar"))


@query("""select o_custkey, arg_max(o_orderkey, o_orderdate::varchar || lpad(o_orderkey::varchar, 12, '0')) as newest from orders group by 1""")
def src_latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("""with g as (select l_orderkey, l_linenumber, l_quantity, sum(case when l_quantity >= 10 or l_linenumber = 1 then 1 else 0 end) over (partition by l_orderkey order by l_linenumber) as seg from lineitem)
    select l_orderkey, min(l_linenumber)::bigint as first_line, max(l_linenumber)::bigint as last_line, sum(l_quantity)::double as pages from g group by l_orderkey, seg""")
def win_merge_short(spark: SparkSession, d: str) -> DataFrame:
    """A short segment joins the one before it."""
    starts = F.when((F.col("l_quantity") >= 10) | (F.col("l_linenumber") == 1), 1).otherwise(0)
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    dealt = lines.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // _ROWS), "l_orderkey")  # a number, as few bytes make very many rows
    rows = dealt.withColumn("seg", F.sum(starts).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    return rows.groupBy("l_orderkey", "seg").agg(F.min("l_linenumber").cast("long").alias("first_line"), F.max("l_linenumber").cast("long").alias("last_line"), F.sum("l_quantity").cast("double").alias("pages")).drop("seg")


@query("""select p_partkey, round(p_retailprice::double / max(p_retailprice::double) over (partition by p_brand), 6) as norm from part""")
def win_norm_score(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("p_retailprice").cast("double")
    return table(spark, d, "part", "p_partkey", "p_brand", "p_retailprice").select("p_partkey", F.round(price / F.max(price).over(Window.partitionBy("p_brand")), 6).alias("norm"))


@query("""select conv_id, turn, last_value(case when role = 'user' then 'PART ' || turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as part from conversations""")
def win_part_context(spark: SparkSession, d: str) -> DataFrame:
    heading = F.when(F.col("role") == "user", F.concat(F.lit("PART "), F.col("turn")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations", "conv_id", "turn", "role").select("conv_id", "turn", F.last(heading, ignorenulls=True).over(w).alias("part"))


# -- sorts and sets ---------------------------------------------------------------------------------------------------


@query("""select o_orderkey, o_totalprice::double as price from orders order by o_totalprice desc, o_orderkey limit 30""")
def sort_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)
    return rows.select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))


@query("""select s_nationkey as k, 'supplier' as src from supplier union all select c_nationkey, 'customer' from customer""")
def set_union_seeds(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "supplier", "s_nationkey").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("src"))
    return one.unionByName(table(spark, d, "customer", "c_nationkey").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("src")))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "orders", "o_custkey").select(F.col("o_custkey").alias("k")), table(spark, d, "customer", "c_custkey").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))


@query("""select o_custkey as k from orders intersect select c_custkey from customer where c_custkey % 2 = 0""")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.intersect(b)


@query("""select o_custkey as k from orders except select c_custkey from customer where c_custkey % 2 = 0""")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.subtract(b)


@query("""with t as (select p_partkey, string_split(p_name, ' ') as a, string_split(p_type, ' ') || string_split(p_name, ' ')[1:2] as b from part)
    select p_partkey, round(len(list_intersect(a, b))::double / len(list_distinct(a || b)), 6) as jaccard from t""")
def set_jaccard(spark: SparkSession, d: str) -> DataFrame:
    a = F.split("p_name", " ")
    b = F.concat(F.split("p_type", " "), F.slice(a, 1, 2))
    return table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6).alias("jaccard"))
