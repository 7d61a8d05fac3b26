"""The operators by name, for SQL: scalar functions, and table functions over a ``TABLE`` argument.

```sql
select * from provenia_chunks(table(docs), id => 'doc_id', text => 'text', title => 'source')
select * from provenia_links(table(pages), id => 'page_id', url => 'url', html => 'html')
select * from provenia_fuse(table(select g, list, k, rank from ranked) partition by g)
```

Scalar functions are SQL functions, so that Spark inlines their expressions. Table functions say
their result's columns by ``analyze``, from the table they are given. Their work on a row is that
of the DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from provenia.operators import chunking, html, retrieval

#: Name and parameters, result type, expression.
SCALARS = (
    ("provenia_rrf(place int)", "double", f"coalesce(1.0d / ({retrieval.RRF} + place), 0.0d)"),
    ("provenia_token_estimate(text string)", "int", "length(text) div 4"),
    ("provenia_fetch_kind(url string)", "string", "case when lower(split_part(url, '?', 1)) like '%.pdf' or lower(split_part(url, '?', 1)) like '%/pdf' or lower(split_part(url, '?', 1)) like '%/pdf/%' then 'PDF' else 'HTML' end"),
    ("provenia_normalise_title(title string)", "string", r"trim(regexp_replace(lower(regexp_replace(trim(title), '\\s+\\d{4}\\s*$', '')), '\\s+', ' '))"),
)


def _column(rows: AnalyzeArgument, name: AnalyzeArgument | None, default: str) -> object:
    """Type of the column that an argument names, an error where there is none."""
    if not rows.isTable:
        raise ValueError("the first argument must be a TABLE")
    wanted = name.value if name is not None else default
    if wanted not in rows.dataType.fieldNames():
        raise ValueError(f"the table has no column {wanted!r}; it has {', '.join(rows.dataType.fieldNames())}")
    return rows.dataType[wanted].dataType


class Chunks:
    """Chunks of the texts of a table: ``id, seq, strategy, part, section, text``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, id: AnalyzeArgument | None = None, text: AnalyzeArgument | None = None, title: AnalyzeArgument | None = None) -> AnalyzeResult:
        out = StructType().add("id", _column(rows, id, "doc_id")).add("seq", IntegerType())
        _column(rows, text, "text")
        if title is not None:
            _column(rows, title, "")
        for name in ("strategy", "part", "section", "text"):
            out = out.add(name, StringType())
        return AnalyzeResult(out)

    def eval(self, rows: Row, id: str = "doc_id", text: str = "text", title: str | None = None) -> Iterator[tuple]:
        for n, c in enumerate(chunking.chunk(rows[text] or "", (rows[title] or "") if title else "", [])):
            yield (rows[id], n, *c)


class Links:
    """Links of the pages of a table to pages of the same host: ``id, link, title, snippet``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, id: AnalyzeArgument | None = None, url: AnalyzeArgument | None = None, html: AnalyzeArgument | None = None) -> AnalyzeResult:
        out = StructType().add("id", _column(rows, id, "page_id"))
        for argument, default in ((url, "url"), (html, "html")):
            _column(rows, argument, default)
        for name in ("link", "title", "snippet"):
            out = out.add(name, StringType())
        return AnalyzeResult(out)

    def eval(self, rows: Row, id: str = "page_id", url: str = "url", html: str = "html") -> Iterator[tuple]:
        for link in page_links(rows[html] or "", rows[url] or ""):
            yield (rows[id], *link)


def page_links(text: str, base: str) -> list[tuple[str, str, str]]:
    return html.links(html.Page(text), base)


class Fuse:
    """Reciprocal-rank fusion of a partition's two lists: rows ``scope, list, key, rank`` in this order, ``list`` being ``lexical`` or ``dense``.

    Gives ``scope, key, score, rank``, the best ``most`` of each partition. A partition is the two
    top lists of one question, so what is held is bounded by their lengths.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) != 4:
            raise ValueError("the argument must be a TABLE of scope, list, key and rank")
        scope, _, key, _ = rows.dataType.fields
        return AnalyzeResult(StructType().add(scope.name, scope.dataType).add(key.name, key.dataType).add("score", DoubleType()).add("rank", IntegerType()))

    def __init__(self) -> None:
        self.scope, self.most, self.ranks = None, retrieval.FUSED, {}

    def eval(self, rows: Row, most: int = retrieval.FUSED) -> None:
        scope, name, key, rank = rows
        self.scope, self.most = scope, most
        self.ranks.setdefault(key, {})[name] = int(rank)

    def terminate(self) -> Iterator[tuple]:
        share = lambda r: 1.0 / (retrieval.RRF + r) if r is not None else 0.0
        scored = [(share(r.get("lexical")) + share(r.get("dense")), r.get("lexical"), r.get("dense"), key) for key, r in self.ranks.items()]
        scored.sort(key=lambda x: (-round(x[0], 12), x[1] if x[1] is not None else 1_000_000 + (x[2] or 0)))
        for n, (score, _, _, key) in enumerate(scored[: self.most], 1):
            yield self.scope, key, score, n


TABLES = {"provenia_chunks": Chunks, "provenia_links": Links, "provenia_fuse": Fuse}


def register(spark: SparkSession) -> list[str]:
    """Register all functions with a session; their names."""
    for signature, kind, body in SCALARS:
        spark.sql(f"create or replace temporary function {signature} returns {kind} return {body}")
    for name, made in TABLES.items():
        spark.udtf.register(name, udtf(made))
    return [s.partition("(")[0] for s, _, _ in SCALARS] + list(TABLES)
