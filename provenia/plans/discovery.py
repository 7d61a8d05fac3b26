"""Queries for discovery: probes in rounds, suffix rules, volumes, and the driver that puts portals together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.operators import discovery, hosts, probing, volumes
from provenia.plans.registry import query, table

_ASKED = "case when page_id % 20 = 0 then 'file:///tmp/' || page_id when page_id % 3 = 0 then 'https://a.org/x?n=' || page_id else 'http://b.example.com?n=' || page_id end"
_CASE = "(n * 7 + {attempt} * 5) % 13"
_CODE = "case {k} when 3 then 404 when 4 then 410 when 5 then 403 when 6 then 429 when 7 then 500 when 8 then 503 when 9 then 302 when 10 then null when 11 then null else 200 end"
_FAILURE = "case {k} when 10 then 'timeout' when 11 then 'connection' end"


def _answer(still: DataFrame, attempt: int) -> DataFrame:
    """What servers say, told by the number in a URL and the round."""
    numbered = still.withColumn("n", F.regexp_extract("url", r"n=(\d+)$", 1).cast("long")).withColumn("k", F.expr(_CASE.format(attempt=attempt)))
    return numbered.select(
        *still.columns, F.expr(_CODE.format(k="k")).alias("code"), F.expr(_FAILURE.format(k="k")).alias("failure"),
        F.when(F.col("k") == 2, "https://elsewhere.org/").otherwise(F.col("url")).alias("final_url"), F.when(F.col("k") == 1, "Page not found").otherwise("fine").alias("body"),
        F.when(F.col("n") % 3 == 0, 7.0).alias("retry_after"),
    )


@query(f"""with recursive u as (select page_id, page_id as n, {_ASKED} as url from pages),
    t(page_id, url, n, attempt, code, failure, status, waited) as (
        select page_id, url, n, 0, null::int, null::varchar, case when url like 'file:%' then 'ok' end, 0.0::double from u
        union all select page_id, url, n, attempt + 1, coalesce(c, code), f,
            case when f = 'connection' or c in (404, 410, 403, 302) then 'broken' when f = 'timeout' or c in (429, 500, 503) then case when attempt = 2 then 'error' end
                when k = 1 then 'soft_404' when k = 2 then 'redirected' else 'ok' end,
            waited + case when c = 429 then case when n % 3 = 0 then 7 else 30 end when (f = 'timeout' or c >= 500) and attempt < 2 then 2 ** attempt else 0 end
        from (select *, {_CODE.format(k="k")} as c, {_FAILURE.format(k="k")} as f from (select *, {_CASE.format(attempt="(attempt + 1)")} as k from t where status is null)))
    select page_id, status, code as http_status, attempt::bigint as tries, waited from t where status is not null""")
def url_status_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Every URL probed until it has a status: at most three rounds, each over what is still open."""
    asked = table(spark, d, "pages", "page_id").select("page_id", F.expr(_ASKED).alias("url"))
    found = probing.probe(asked, _answer)
    return found.select("page_id", "status", "http_status", F.size("attempts").cast("long").alias("tries"), "waited")


#: Some rules as the public list writes them, and hosts for them.
RULES = ("com", "net", "org", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "// a comment", "")
ENDS = ("com", "co.uk", "gov.ck", "www.ck", "kobe.jp", "city.kobe.jp", "ck", "unknown", "b.c.kobe.jp", "example.org.")
_URLS = "select s_suppkey as id, case when s_suppkey % 4 = 0 then 'https://' || e when s_suppkey % 4 = 1 then 'https://a' || s_suppkey || '.' || e || ':8080/x' else 'http://u@www.n' || s_suppkey || '.' || e || '?q=1' end as url from (select s_suppkey, ({ends})[{at}] as e from supplier) union all select -1 - page_id, url from pages"


@query(f"""with u as ({_URLS.format(ends="[" + ", ".join(f"'{e}'" for e in ENDS) + "]", at=f"1 + s_suppkey % {len(ENDS)}")}),
    h as (select id, string_split(rtrim(lower(regexp_extract(url, '^[a-zA-Z0-9+.-]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '.') as l from u),
    r as (select ltrim(r, '!*.') as s, starts_with(r, '!') as ex, len(string_split(ltrim(r, '!*.'), '.')) + case when starts_with(r, '!') then -1 when starts_with(r, '*.') then 1 else 0 end as reach from (select unnest([{", ".join(f"'{r}'" for r in RULES if r and "/" not in r)}]) as r)),
    m as (select id, l, arg_max(reach, (ex::int * 1000 + reach)) as reach from (select h.id, l, ex, reach from h join r on list_contains(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.')), s) where reach <= len(l)) group by all)
    select h.id, case when len(h.l) > coalesce(reach, 1) then array_to_string(h.l[len(h.l) - coalesce(reach, 1):], '.') end as domain from h left join m on m.id = h.id""")
def domain_by_rules(spark: SparkSession, d: str) -> DataFrame:
    """Registered domains by suffix rules, wildcards and exceptions among them."""
    table(spark, d, "supplier", "s_suppkey").createOrReplaceTempView("_hosts_supplier")
    table(spark, d, "pages", "page_id", "url").createOrReplaceTempView("_hosts_pages")
    ends = "array(" + ", ".join(f"'{e}'" for e in ENDS) + ")"
    rows = spark.sql(_URLS.format(ends=ends, at=f"s_suppkey % {len(ENDS)}").replace("supplier)", "_hosts_supplier)").replace("from pages", "from _hosts_pages"))
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    return hosts.with_registered_domain(rows, rules).select("id", "domain")


_PAGES = "5 + user_id % 90"
_TEXT = "case when user_id % 6 = 0 then 'body' when event_id % 7 = 0 then 'Act ' || event_id when event_id % 7 = 1 then 'Undang-Undang ' || event_type when event_id % 7 = 2 then '  ' when event_id % 7 = 3 then ' chapter 5 ' || event_id when event_id % 7 = 4 then null else 'body ' || event_id end"


@query(f"""with s as (select user_id as volume, event_id % ({_PAGES}) as page, event_id as no, (event_id * 13 % 100)::double as y, 100.0 as height, (8 + event_id % 11)::double as size, trim(coalesce({_TEXT}, '')) as t from events),
    v as (select distinct user_id as volume, {_PAGES} as pages from events),
    p as (select volume, page, arg_max(t, size * 1e9 - no) filter (t <> '') as title, bool_or(size >= 14 and t <> '' and y <= 20 and (regexp_matches(t, '(?i)^(act|chapter)\\s+\\d') or regexp_matches(t, '(?i)^undang-undang\\s'))) as header from s group by all),
    f as (select volume, count(*) as n from p where header and page > 0 group by 1),
    b as (select volume, 0 as page, pages, false as fb from v where volume in (select volume from f) union all select volume, page, pages, false from p join v using (volume) where header and page > 0
        union all select volume, unnest(range(0, pages, 50)), pages, true from v where volume not in (select volume from f)),
    e as (select *, coalesce(lead(page) over w, pages) - 1 as last, row_number() over w as i from b window w as (partition by volume order by page)),
    g as (select *, sum((i = 1 or last - page + 1 >= 3)::int) over (partition by volume order by page) - 1 as segment from e),
    a as (select volume, segment, min(page) as page, max(last) as last, bool_or(fb) as fb from g group by all)
    select a.volume, segment::int as segment, case when fb or title is null then 'Segment ' || segment::int else title end as title, a.page::int as start_page, last::int as end_page, fb as fallback from a left join p on p.volume = a.volume and p.page = a.page""")
def volume_acts(spark: SparkSession, d: str) -> DataFrame:
    """Acts of volumes: large header lines at the top of a page, short ones merged, fixed parts where there are none."""
    events = table(spark, d, "events", "user_id", "event_id", "event_type")
    spans = events.select(
        F.col("user_id").alias("volume"), F.expr(f"event_id % ({_PAGES})").alias("page"), F.col("event_id").alias("no"), F.expr("cast(event_id * 13 % 100 as double)").alias("y"),
        F.lit(100.0).alias("height"), F.expr("cast(8 + event_id % 11 as double)").alias("size"), F.expr(_TEXT).alias("text"),
    )
    return volumes.acts_of_volumes(spans, events.select(F.col("user_id").alias("volume"), F.expr(_PAGES).alias("pages")).distinct())


_STRATEGIES = ("TBD", "seed_only", "index", "api", "sitemap", "auto")
_KNOWN_CAP, _NEW_CAP = 40, 30


@query(f"""with portals as (select 'E' || s_nationkey % 5 as economy, s_suppkey as portal, s_suppkey % 6 as strategy, 'p' || s_suppkey % 9 || '.gov.sg' as domain from supplier where s_suppkey % 6 <> 0),
    c as (select distinct economy, portal, l_partkey as pos, p_name as title, 'https://p' || portal % 9 || '.gov.sg/act/' || l_partkey % 300 as url, p_retailprice / 2500 as score
        from lineitem join portals on l_suppkey = portal join part on l_partkey = p_partkey where strategy > 1 and l_suppkey % 4 <> 3),
    known as (select distinct 'E' || c_nationkey % 5 as economy, 'https://p' || c_custkey % 11 || '.gov.sg/act/' || c_custkey % 500 as url from customer),
    titles as (select distinct 'E' || p_partkey % 5 as economy, p_name as title from part where p_partkey % 10 = 0),
    remap as (select 'E' || p_partkey % 5 as economy, 'https://p' || p_partkey % 9 || '.gov.sg/act/' || p_partkey % 300 as source, min('https://laws.org/' || p_partkey % 20) as target from part where p_partkey % 50 = 7 group by all),
    lost as (select * from portals where (economy, portal) not in (select economy, portal from c)),
    found as (select economy, portal, -score as r, pos, title, url, case when (economy, url) in (select economy, url from known) or (economy, title) in (select economy, title from titles) then 'KNOWN' when score >= 0.5 then 'NEW' end as tag from c where not contains(title, 'red')),
    own as (select l.economy, portal, 0.0 as r, 0 as pos, '' as title, url, 'KNOWN' as tag from lost l join known k on k.economy = l.economy and regexp_extract(url, '//([^/]*)', 1) = domain),
    bare as (select economy, min(portal) as portal from lost where (economy, portal) not in (select economy, portal from own) group by 1),
    every as (select * from found where tag is not null union all select * from own union all select b.economy, b.portal, 0.0, 0, '', url, 'KNOWN' from bare b join known k on k.economy = b.economy
        union all select economy, {2**62}, 0.0, 0, '', url, 'KNOWN' from known),
    moved as (select e.economy, portal, r, pos, title, coalesce(target, url) as url, tag from every e left join remap m on m.economy = e.economy and source = url),
    acts as (select * from moved qualify row_number() over (partition by economy, url order by portal, r, pos, title, tag) = 1),
    ranked as (select *, row_number() over (partition by economy, tag order by portal, r, pos, url) as n from acts)
    select economy, row_number() over (partition by economy order by tag, n) as pos, title, url, tag from ranked where n <= case tag when 'KNOWN' then {_KNOWN_CAP} else {_NEW_CAP} end""")
def discover_acts(spark: SparkSession, d: str) -> DataFrame:
    """Portals of several economies, their candidates and known acts, to the list of acts to read."""
    economy = lambda c: F.concat(F.lit("E"), (F.col(c) % 5).cast("string")).alias("economy")
    address = lambda host, n, act, m: F.concat(F.lit("https://p"), F.col(host) % n, F.lit(".gov.sg/act/"), F.col(act) % m)
    named = F.element_at(F.array(*[F.lit(s) for s in _STRATEGIES]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    portals = table(spark, d, "supplier", "s_suppkey", "s_nationkey").select(economy("s_nationkey"), F.col("s_suppkey").alias("portal"), named.alias("strategy"), F.concat(F.lit("https://www.p"), F.col("s_suppkey") % 9, F.lit(".gov.sg/")).alias("url"))
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_retailprice")
    sold = table(spark, d, "lineitem", "l_suppkey", "l_partkey").where("l_suppkey % 4 <> 3").distinct()
    offered = sold.join(portals.select("economy", "portal"), F.col("l_suppkey") == F.col("portal")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    offered = offered.select("economy", "portal", F.col("l_partkey").alias("pos"), F.col("p_name").alias("title"), address("portal", 9, "l_partkey", 300).alias("url"), (F.col("p_retailprice") / 2500).alias("score"))
    known = table(spark, d, "customer", "c_custkey", "c_nationkey").select(economy("c_nationkey"), address("c_custkey", 11, "c_custkey", 500).alias("url"))
    titles = parts.where("p_partkey % 10 = 0").select(economy("p_partkey"), F.concat("p_name", F.lit(" 2010")).alias("title"))
    remap = parts.where("p_partkey % 50 = 7").select(economy("p_partkey"), address("p_partkey", 9, "p_partkey", 300).alias("source"), F.concat(F.lit("https://laws.org/"), F.col("p_partkey") % 20).alias("target"))
    return discovery.discover(portals, offered, known, titles, remap, excludes=("Red",), least_score=0.5, most_known=_KNOWN_CAP, most_new=_NEW_CAP)
