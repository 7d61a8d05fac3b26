"""Queries written in SQL with the registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provenia import surface
from provenia.plans.documents import _LISTS
from provenia.plans.registry import query, table


@query(f"with {_LISTS} select g, k, round(score, 9) as score, rank from r where rank <= 30")
def sql_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Two top lists for each priority, fused by a table function that is partitioned by priority."""
    surface.register(spark)
    table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey").createOrReplaceTempView("provenia_orders")
    return spark.sql("""
        with lists as (
            select o_orderpriority as g, 'lexical' as list, o_orderkey as k, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rank from provenia_orders
            union all select o_orderpriority, 'dense', o_orderkey, row_number() over (partition by o_orderpriority order by o_custkey, o_totalprice desc, o_orderkey) from provenia_orders where o_totalprice > 200000)
        select g, k, round(score, 9) as score, cast(rank as bigint) as rank from provenia_fuse(table(select * from lists where rank <= 30) partition by g)""")


@query("""select p_partkey, length(p_comment_) // 4 as tokens, coalesce(1.0::double / (60 + nullif(p_size, 0)), 0) as share, case when p_partkey % 3 = 0 then 'PDF' else 'HTML' end as kind, p_name as title
    from (select *, p_name || ' ' || p_type as p_comment_ from part)""")
def sql_scalars(spark: SparkSession, d: str) -> DataFrame:
    surface.register(spark)
    table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size").createOrReplaceTempView("provenia_part")
    return spark.sql("""
        select p_partkey, cast(provenia_token_estimate(p_name || ' ' || p_type) as bigint) as tokens, provenia_rrf(cast(p_size as int)) as share,
            provenia_fetch_kind('https://e.org/' || case when p_partkey % 3 = 0 then 'a.PDF?x=1' else 'a.html' end) as kind, provenia_normalise_title(upper(p_name) || '  2012') as title
        from provenia_part""")


@query()
def sql_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of all documents, from SQL."""
    surface.register(spark)
    table(spark, d, "documents", "doc_id", "text").createOrReplaceTempView("provenia_documents")
    return spark.sql("select id as doc_id, seq, strategy, part, section, text from provenia_chunks(table(provenia_documents))")


@query()
def sql_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of all pages, from SQL."""
    surface.register(spark)
    table(spark, d, "pages", "page_id", "url", "html").createOrReplaceTempView("provenia_pages")
    return spark.sql("select id as page_id, link, title, snippet from provenia_links(table(provenia_pages))")
