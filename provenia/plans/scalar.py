"""Queries for the scalar functions and predicates. Inputs are columns of the tables, or strings made from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.functions import text as T
from provenia.functions import urls as U
from provenia.plans.registry import query, table

_STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOPWORDS)
_PHRASES = " or ".join(f"contains(lower(html), '{p}')" for p in T.ERROR_PHRASES)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Page URLs, and the same with a query made from the key."""
    base = U.before_query(F.col("url"))
    made = F.concat(base, F.lit("?Lang=en&id="), F.col("page_id"), F.lit("&viewtype=Full&empty=&id=b"), F.when(F.col("page_id") % 3 == 0, "#Top").otherwise(""))
    return table(spark, d, "pages", "page_id", "url").withColumn("made", made)


_MADE = "(select page_id, url, regexp_extract(url, '^([^?#]*)', 1) || '?Lang=en&id=' || page_id || '&viewtype=Full&empty=&id=b' || case when page_id % 3 = 0 then '#Top' else '' end as made from pages)"


@query(f"""select page_id, regexp_extract(lower(made), '^([^?#]*)', 1) || '?id=' || page_id || '&id=b&viewtype=full'
    || case when page_id % 3 = 0 then '#top' else '' end as u, rtrim(regexp_extract(lower(rtrim(url, '/')), '^([^?#]*)', 1)) as plain from {_MADE}""")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d)
    return rows.select("page_id", U.normalise_url(F.col("made")).alias("u"), U.before_query(U.normalise_url(F.col("url"))).alias("plain"))


@query(f"""with h as (select page_id, string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '.') as l from pages),
    t as (select *, array_to_string(l[greatest(len(l) - 1, 1):], '.') as two, array_to_string(l[greatest(len(l) - 2, 1):], '.') as three from h)
    select page_id, case when two in ({", ".join(f"'{s}'" for s in U.TWO_LABEL_SUFFIXES)}) then three else two end as domain from t""")
def url_registered_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "url").select("page_id", U.registered_domain(F.col("url")).alias("domain"))


@query("""select page_id, page_id % 4 in (0, 1) as asset from pages""")
def url_skip_filter(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(x) for x in ("/a.CSS", "/b.woff2?x=1", "/c.html", "/d")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages", "page_id", "url").select("page_id", F.coalesce(U.is_asset(F.concat(F.lit("https://e.org"), ending)), F.lit(False)).alias("asset"))


@query("""select page_id, case when page_id % 2 = 0 then 'c' || lpad((page_id % 9999)::varchar, 4, '0') || 'a' || lpad(page_id::varchar, 5, '0')
    else 'http://e.org/act/' || page_id end as key from pages""")
def url_canonical_key(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat(F.lit("C"), F.lpad((F.col("page_id") % 9999).cast("string"), 4, "0"), F.lit("A"), F.lpad(F.col("page_id").cast("string"), 5, "0"))
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.legislation.gov.au/Details/"), number, F.lit("/latest"))).otherwise(F.concat(F.lit("HTTP://e.org/Act/"), F.col("page_id"), F.lit("/")))
    return table(spark, d, "pages", "page_id").select("page_id", U.canonical_act_key(url).alias("key"))


@query("""select p_partkey, replace(p_name, '-', ' ') as title from part""")
def url_slug_title(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://e.org/acts/"), F.regexp_replace("p_name", " ", "-"), F.lit("/?x=1"))
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", U.title_from_slug(url).alias("title"))


@query(f"""select page_id, url || case when contains(url, '?') then '&' else '?' end || 'WholeDoc=1' as view from pages where not contains(url, '#')""")
def url_view_suffix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages", "page_id", "url").where(~F.contains("url", F.lit("#")))
    return rows.select("page_id", U.with_view_suffix(F.col("url"), F.lit("?WholeDoc=1")).alias("view"))


@query(f"""select page_id, regexp_extract(made, '^([^?#]*)', 1) || '?Lang=en&id=' || page_id || '&id=b' || case when page_id % 3 = 0 then '#Top' else '' end as u from {_MADE}""")
def url_strip_params(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", U.strip_params(F.col("made")).alias("u"))


@query("""with r as (select page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) as p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as q from pages)
    select page_id, coalesce(nullif(substring(trim(regexp_replace(p || case when q <> '' then '_' || q else '' end, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 1, 120), ''), 'archive') as slug from r""")
def url_safe_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "url").select("page_id", U.safe_slug(F.col("url")).alias("slug"))


@query("""select p.page_id, case when p.page_id % 10 = 0 then 'https://archive.example/' || p.page_id else p.url end as u from pages p""")
def url_remap(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages", "page_id", "url")
    remap = pages.where("page_id % 10 = 0").select("url", F.concat(F.lit("https://archive.example/"), F.min("page_id").over(_by("page_id"))).alias("to"), "page_id")
    return pages.join(remap.drop("url"), "page_id", "left").select("page_id", F.coalesce("to", "url").alias("u"))


def _by(*c: str):
    from pyspark.sql import Window

    return Window.partitionBy(*c)


@query("""select page_id, case when page_id % 3 = 0 then 'PDF' else 'HTML' end as kind, regexp_extract(lower(url), '^([a-z]+)://', 1) as scheme from pages""")
def url_fetch_kind(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://e.org/a"), F.when(F.col("page_id") % 3 == 0, ".PDF?x=1").otherwise("?f=x.pdf"))
    return table(spark, d, "pages", "page_id", "url").select("page_id", U.fetch_kind(url).alias("kind"), F.regexp_extract(F.lower("url"), "^([a-z]+)://", 1).alias("scheme"))


@query("""select p_partkey, lower(p_name) as title from part""")
def title_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", T.normalise_title(F.concat(F.lit("  "), F.initcap("p_name"), F.lit("  2012 "))).alias("title"))


@query("""select p_partkey, 3 as n, p_name as first, 'Act ' || p_partkey as last from part""")
def title_split(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(F.regexp_replace("p_name", " ", "\n"), F.lit(" ;; Code\n \nAct  "), F.col("p_partkey"), F.lit("; "))
    titles = T.split_titles(cell)
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.size(titles).alias("n"), titles[0].alias("first"), F.element_at(titles, -1).alias("last"))


@query(f"""select p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' Act of ' || p_brand), '[a-z0-9]+'),
    lambda w: w not in ({_STOP}) and not regexp_matches(w, '^[0-9]+$')))), ' ') as tokens from part""")
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" Act of "), "p_brand")
    return table(spark, d, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", F.array_join(F.array_sort(T.title_tokens(title)), " ").alias("tokens"))


@query("""with w as (select p_partkey, list_transform(string_split(lower(p_name), ' '), lambda x: substring(x, 1, 1)) as i from part)
    select p_partkey, array_to_string(i, '') || 'a' as whole, array_to_string(i, '') as short from w""")
def title_acronyms(spark: SparkSession, d: str) -> DataFrame:
    both = T.title_acronyms(F.concat("p_name", F.lit(" Act 2012")))
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", both[0].alias("whole"), both[1].alias("short"))


@query("""select p_partkey, p_partkey::varchar || ',a' || p_size as numbers from part where p_partkey::varchar <> 'a' || p_size""")
def title_act_numbers(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" (Act "), F.col("p_partkey"), F.lit(") amended by ACT  A"), F.col("p_size"))
    return table(spark, d, "part", "p_partkey", "p_name", "p_size").select("p_partkey", F.array_join(T.act_numbers(title), ",").alias("numbers"))


_CITED = "'See Section ' || l_linenumber || 'B, s. ' || l_partkey || ' and § ' || l_suppkey || '(2)'"


@query(f"""select l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(regexp_extract_all(lower({_CITED}), '(?:section|sec\\.?|s\\.|§)\\s*(\\d+[a-z]?)\\b', 1))), ',') as tokens from lineitem""")
def sec_tokens_prose(spark: SparkSession, d: str) -> DataFrame:
    cited = F.concat(F.lit("See Section "), F.col("l_linenumber"), F.lit("B, s. "), F.col("l_partkey"), F.lit(" and § "), F.col("l_suppkey"), F.lit("(2)"))
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.array_sort(T.section_tokens(cited)), ",").alias("tokens"))


@query("""select o_orderkey, nullif(regexp_extract(lower(case when o_orderkey % 5 = 0 then 'Preamble' else 'Art. ' || o_custkey || 'A(2)' end), '\\b(\\d+[a-z]?)', 1), '') as token from orders""")
def sec_token_first(spark: SparkSession, d: str) -> DataFrame:
    article = F.when(F.col("o_orderkey") % 5 == 0, "Preamble").otherwise(F.concat(F.lit("Art. "), F.col("o_custkey"), F.lit("A(2)")))
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", T.first_section(article).alias("token"))


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then null else '#pr' || o_custkey || '-' end as anchor from orders""")
def sec_anchor(spark: SparkSession, d: str) -> DataFrame:
    article = F.when(F.col("o_orderkey") % 5 == 0, "Preamble").otherwise(F.concat(F.lit("Reg. "), F.col("o_custkey"), F.lit("(1)(b)")))
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", T.section_anchor(article).alias("anchor"))


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then null else 'P' || (6 + o_custkey % 2) || '-I' || (1 + o_orderkey % 5) end as id,
    'P' || (6 + o_custkey % 2) || '-I' || (1 + o_orderkey % 5) as kit from orders""")
def id_bridge(spark: SparkSession, d: str) -> DataFrame:
    pillar, n = 6 + F.col("o_custkey") % 2, 1 + F.col("o_orderkey") % 5
    raw = F.when(F.col("o_orderkey") % 4 == 0, pillar.cast("string")).otherwise(F.concat(pillar.cast("string"), F.lit("."), n.cast("string")))
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", T.engine_id(raw).alias("id"), T.kit_id(pillar, pillar + n / 10).alias("kit"))


@query("""select o_orderkey, 1 + (o_orderkey % 2)::int as n, 'https://e.org/' || o_orderkey as first from orders""")
def ref_urls(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(F.lit("https://e.org/"), F.col("o_orderkey"), F.lit("; see note\n"), F.when(F.col("o_orderkey") % 2 == 1, "http://x.org/b").otherwise("none"))
    urls = F.filter(F.transform(F.split(cell, "[;\n]"), lambda u: F.trim(u)), lambda u: u.startswith("http"))
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", F.size(urls).alias("n"), urls[0].alias("first"))


@query("""select n_nationkey, case lower(n_name) when 'indonesia' then 'ID' when 'vietnam' then 'VN' else substring(upper(n_name), 1, 2) end as code from nation""")
def economy_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation", "n_nationkey", "n_name").select("n_nationkey", T.economy_code(F.concat(F.lit(" "), F.initcap("n_name"))).alias("code"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'P' || o_custkey when 1 then 'P6+P' || o_custkey when 2 then '' else 'GENERAL' end as pillar from orders""")
def pillar_canon(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(F.concat(F.lit("Pillar "), F.col("o_custkey")), F.concat(F.lit("6 + "), F.col("o_custkey")), F.lit(" "), F.lit("general")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", T.canonical_pillar(raw).alias("pillar"))


@query("""select o_orderkey, 2400 + o_orderkey % 199 as be, 1857 + o_orderkey % 199 as ce, 'In ' || (1857 + o_orderkey % 199) || ' and 1999, ' || (1857 + o_orderkey % 199) || '.' as converted from orders""")
def be_years(spark: SparkSession, d: str) -> DataFrame:
    year = 2400 + F.col("o_orderkey") % 199
    text = F.concat(F.lit("In "), year, F.lit(" and 1999, "), year, F.lit("."))
    first = T.be_years(text)[0]
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", first["be"].cast("long").alias("be"), first["ce"].cast("long").alias("ce"), T.convert_be_years(text).alias("converted"))


@query("""select o_orderkey, 'Act No. ' || o_orderkey || '/2024' as ref from orders""")
def law_ref_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", T.clean_reference(F.concat(F.lit("Act  No.   "), F.col("o_orderkey"), F.lit("/2024  b.e."))).alias("ref"))


#: Texts, titles and addresses of laws from a key; the same expressions in both dialects.
_LAW_TITLE = "case when o_orderkey % 2 = 0 then concat('Personal Data Protection Act 2012 (Act A', o_custkey % 1000, ')') else 'Straits Code' end"
_LAW_TEXT = """concat(case when o_orderkey % 3 = 0 then concat('Amended by Act 9 of 2012. Act 8 of 2012 is another. Act ', o_custkey, ' of 2012 is the Personal Data one. Act 77 of 2015. ') else 'Nothing. ' end,
    case when o_orderkey % 5 = 0 then concat('It is No. ', o_custkey, ', 2020. ') else '' end, case when o_orderkey % 7 = 0 then concat('Under Law No. ', o_custkey, '/2022 so. ') else '' end,
    case when o_orderkey % 11 = 0 then '2020 Rev. Ed.' else '' end)"""
_AMENDED_TEXT = """concat('Cover. ', case when o_orderkey % 2 = 0 then concat('1 June ', 1990 + o_orderkey % 17, ' Amended by Act 5 of ', 2000 + o_orderkey % 9, '. 3 May ', 1990 + o_custkey % 19, ' amended by Act 6 of 2001. ') else '' end,
    case when o_orderkey % 3 = 0 then concat('Last amended on 4 July ', 1980 + o_orderkey % 30, ' and ', 1980 + o_custkey % 30, '. ') else '' end, case when o_orderkey % 5 = 0 then concat('Amended by Act A7 of ', 2000 + o_custkey % 20) else '' end)"""
_AMENDED_URL = """case when o_orderkey % 7 = 0 then concat('https://e.org/Act/X?ProvIds=1&DocDate=', 1995 + o_orderkey % 25, '0101') when o_orderkey % 7 = 1 then concat('https://e.org/C2/', 2001 + o_custkey % 20, '-06-04/', 2001 + o_custkey % 20, '-06-04/text/pdf')
    when o_orderkey % 7 = 2 then 'https://e.org/C2/2020-06-04/2021-06-04/text' else 'https://e.org/x' end"""


@query("""select o_orderkey, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'Act 8 of 2012' when o_orderkey % 3 = 0 then 'Act 8 of 2012'
    when o_orderkey % 5 = 0 then 'No. ' || o_custkey || ', 2020' when o_orderkey % 7 = 0 then 'Law No. ' || o_custkey || '/2022' when o_orderkey % 2 = 0 then 'Act A' || o_custkey % 1000
    when o_orderkey % 11 = 0 then '2020 Rev. Ed.' end as ref from orders""")
def law_number_ref(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", T.law_number(F.expr(_LAW_TITLE), F.expr(_LAW_TEXT)).alias("ref"))


@query(rf"""with t as (select o_orderkey, {_AMENDED_TEXT} as t, {_AMENDED_URL} as u from orders)
    select o_orderkey, coalesce(list_max(regexp_extract_all(t, '(?i)\d+ (?:june|may|july) (\d{{4}}) amended by', 1)),
        list_max(flatten(list_transform(regexp_extract_all(t, '(?i)last amended on(.{{0,260}})', 1), lambda c: regexp_extract_all(c, '(?:19|20)\d\d')))),
        list_max(regexp_extract_all(t, '(?i)amended by act [a-z]?\d+ of (\d{{4}})', 1)),
        nullif(regexp_extract(u, 'DocDate=(\d{{4}})', 1), ''), case when regexp_extract(u, 'C2/(\d{{4}})', 1) = regexp_extract(u, '/(\d{{4}})-06-04/text', 1) then nullif(regexp_extract(u, 'C2/(\d{{4}})', 1), '') end) as year from t""")
def last_amended_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", T.last_amended(F.expr(_AMENDED_TEXT), F.expr(_AMENDED_URL)).alias("year"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'Privacy Act ' || p_partkey when 1 then 'The Privacy Act ' || p_partkey else 'X' || p_partkey end as title from part""")
def derive_title(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\n Privacy Act "), F.col("p_partkey"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("\nTHE PRIVACY ACT "), F.col("p_partkey"))).otherwise("")
    text = F.concat(F.lit("REVISED EDITION OF THE ACT\n  hi\n"), "p_name", line, F.lit("\nend"))
    url = F.concat(F.lit("https://e.org/acts/x"), F.col("p_partkey"), F.lit("?a=1"))
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", T.derived_title(text, url).alias("title"))


@query("""select doc_id, sha256(trim(regexp_replace(lower(replace(replace(replace(replace(replace(coalesce(text, ''), '—', '-'), '–', '-'), '’', ''''), '‘', ''''), '…', '...') || ' five iv k2'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')) as form from documents""")
def text_norm(spark: SparkSession, d: str) -> DataFrame:
    """Every text, with a ligature, a Roman numeral and full-width letters at its end."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" ﬁve Ⅳ Ｋ２"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(T.collapse(T.quoted_form(text)).cast("binary"), 256).alias("form"))


@query("""select doc_id, case when trim(text) = '' then 1.0 else least(len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]'))::double / length(text), 1.0) end as cer from documents""")
def cer_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.unreadable_share(F.col("text")).alias("cer"))


@query("""select user_id, round(1 - avg(value / 1000.0), 6) as cer from (select user_id, least(abs(value), 1000)::double as value from events) group by user_id""")
def cer_from_conf(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "user_id", "value").select("user_id", (F.least(F.abs("value"), F.lit(1000)).cast("double") / 1000).alias("c"))
    return rows.groupBy("user_id").agg(F.round(1 - F.avg("c"), 6).alias("cer"))


@query("""select page_id, coalesce(nullif(lower(regexp_extract(substring(html, 1, 2048), '(?i)<meta[^>]*charset=["'']?([A-Za-z0-9_-]+)', 1)), ''), 'utf-8') as charset from pages""")
def html_charset(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract(F.substring("html", 1, 2048), r"""(?i)<meta[^>]*charset=["']?([A-Za-z0-9_-]+)""", 1)
    return table(spark, d, "pages", "page_id", "html").select("page_id", F.coalesce(T.absent(F.lower(found)), F.lit("utf-8")).alias("charset"))


@query("""select conv_id, string_agg('--- Page ' || (n) || ' ---' || chr(10) || text, chr(10) || chr(10) order by n) as whole from
    (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from conversations) group by conv_id""")
def pages_assemble(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations", "conv_id", "turn", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", T.assembled_pages(F.transform("t", lambda t: t["text"])).alias("whole"))


@query("""select doc_id, substring(sha256(source), 1, 12) || '_' || lpad((doc_id % 10000)::varchar, 4, '0') as chunk_id from documents""")
def chunk_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "source").select("doc_id", T.chunk_id(F.col("source").cast("binary"), F.col("doc_id") % 10000).alias("chunk_id"))


@query("""select o_orderkey, nullif(concat_ws(' | ', case when o_orderkey % 3 <> 0 then 'Art. ' || o_custkey end, case when o_orderkey % 2 = 0 then 'Page ' || (o_orderkey % 50 + 1) end), '') as loc from orders""")
def loc_string(spark: SparkSession, d: str) -> DataFrame:
    article, page = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 50)
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", T.citation(article, page).alias("loc"))


@query("""with t as (select doc_id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), lambda w: length(w) >= 4) as l from documents),
    u as (select doc_id, unnest(l) as w, generate_subscripts(l, 1) as i from t), f as (select doc_id, w, min(i) as i from u group by doc_id, w),
    r as (select *, row_number() over (partition by doc_id order by i) as n from f)
    select doc_id, string_agg(w, ' ' order by i) as terms from r where n <= 12 group by doc_id""")
def tok_terms(spark: SparkSession, d: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.slice(F.array_distinct(F.filter(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) >= 4)), 1, 12)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(terms, " ").alias("terms")).where("terms != ''")


@query("""select doc_id, case when length(text) > 300 then substring(text, 1, 297) || '...' else text end as rationale from documents""")
def truncate_rationale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.shortened(F.col("text")).alias("rationale"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then 'review' when 1 then 'review; old' else 'old; review' end as notes from orders""")
def notes_append(spark: SparkSession, d: str) -> DataFrame:
    old = F.element_at(F.array(F.lit(None).cast("string"), F.lit("review; old"), F.lit("old")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", T.append_note(old, F.lit("review")).alias("notes"))


@query("""select o_orderkey, 'economy' || (o_orderkey % 3) as economy, 'P7' as pillar, '20250101' as day from orders""")
def parse_run_name(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("economy"), F.col("o_orderkey") % 3, F.lit("_P7_20250101.csv"))
    part = lambda i: F.regexp_extract(name, r"^(.+)_(P\d(?:\+P\d)*)_(\d{8})\.csv$", i)
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", part(1).alias("economy"), part(2).alias("pillar"), part(3).alias("day"))


@query("""with c as (select p_brand, p_type, count(*) as n from part group by 1, 2), r as (select *, row_number() over (partition by p_brand order by n desc, p_type) as k from c)
    select p_brand, p_type as category, array_to_string(list_filter(string_split(lower(p_type), ' '), lambda w: w not in ('standard', 'small'))[:2], ' ') as hint from r where k = 1""")
def pillar_hint(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part", "p_brand", "p_type").groupBy("p_brand", "p_type").count()
    best = counts.groupBy("p_brand").agg(F.min(F.struct((-F.col("count")).alias("n"), "p_type"))["p_type"].alias("category"))
    words = F.filter(F.split(F.lower("category"), " "), lambda w: ~w.isin("standard", "small"))
    return best.select("p_brand", "category", F.array_join(F.slice(words, 1, 2), " ").alias("hint"))


@query("""select doc_id, case lang when 'en' then 'tesseract' when 'zh' then 'paddle' else 'tesseract' end as engine, case lang when 'en' then 'eng' when 'de' then 'deu' when 'fr' then 'fra' when 'es' then 'spa' end as code, lang = 'en' as english from documents""")
def lang_route(spark: SparkSession, d: str) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for k, v in {"en": "eng", "de": "deu", "fr": "fra", "es": "spa"}.items() for x in (k, v)])
    root = F.lower(F.substring_index("lang", "-", 1))
    return table(spark, d, "documents", "doc_id", "lang").select("doc_id", F.when(root == "zh", "paddle").otherwise("tesseract").alias("engine"), codes[root].alias("code"), (root == "en").alias("english"))


@query("""select o_orderkey, case o_orderkey % 4 when 3 then null else o_orderkey end as a from orders""")
def json_recover(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit('{"a": '), F.col("o_orderkey"), F.lit("}"))
    answers = F.array(body, F.concat(F.lit("<think>x {</think>```json\n"), body, F.lit("\n```")), F.concat(F.lit("Here: "), body, F.lit(" done")), F.lit("no answer"))
    found = T.recovered_json(F.element_at(answers, (F.col("o_orderkey") % 4 + 1).cast("int")))
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", F.get_json_object(found, "$.a").cast("long").alias("a"))


@query("""select doc_id, contains(lower(text), 'the ') or contains(lower(text), 'und ') as hit from documents""")
def pred_any_term(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.any_term(F.col("text"), F.array(F.lit("THE "), F.lit("und "))).alias("hit"))


@query(f"""select page_id, ({_PHRASES}) or page_id % 50 = 0 as soft_404 from pages""")
def pred_soft404(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat("html", F.when(F.col("page_id") % 50 == 0, " Error 404 ").otherwise(""))
    return table(spark, d, "pages", "page_id", "html").select("page_id", T.is_error_page(html).alias("soft_404"))
