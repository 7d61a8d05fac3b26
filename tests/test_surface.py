"""Functions called from SQL text against the DataFrame operators."""

import pytest

from provenia import plans, surface
from provenia.operators import chunking


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_chunks_and_links_are_those_of_the_operators(spark, data):
    built = plans.queries()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert rows(built["sql_chunks"](spark, data)) == rows(chunking.chunk_documents(docs).select("id", "seq", "strategy", "part", "section", "text"))
    from provenia.operators.html import links, parse_pages

    pages = spark.read.parquet(f"{data}/pages.parquet")
    assert rows(built["sql_links"](spark, data)) == rows(parse_pages(pages, lambda p, u, h: links(p, u), "link string, title string, snippet string"))


def test_columns_are_checked_when_a_query_is_planned(spark):
    assert len(surface.register(spark)) == 7
    spark.createDataFrame([("a", "Section 1. " + "word " * 80, "My Act"), ("b", None, None)], "k string, body string, name string").createOrReplaceTempView("t_docs")
    got = spark.sql("select * from provenia_chunks(table(t_docs), id => 'k', text => 'body', title => 'name')")
    assert got.schema["id"].dataType.simpleString() == "string" and [r.id for r in got.collect()] == ["a"]
    with pytest.raises(Exception, match="no column 'nope'"):
        spark.sql("select * from provenia_chunks(table(t_docs), id => 'nope')").collect()
    fused = spark.sql("select * from provenia_fuse(table(values ('q', 'lexical', 1, 1), ('q', 'lexical', 2, 2), ('q', 'dense', 2, 1), ('q', 'dense', 3, 2), ('z', 'dense', 9, 1) as t(q, list, seq, rank)) partition by q, most => 2)")
    assert [(r.q, r.seq, r["rank"]) for r in fused.orderBy("q", "rank").collect()] == [("q", 2, 1), ("q", 1, 2), ("z", 9, 1)]
    assert spark.sql("select provenia_normalise_title('  The  Act 2012 ') t").first().t == "the act"
