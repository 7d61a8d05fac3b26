"""Sinks: the table as CSV, the JSON envelope, partitioned Parquet, and the report of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.operators.quality import COLUMNS, violations
from provenia.operators.settled import settled

#: The byte-order mark.
MARK = "\ufeff"


def csv_rows(records: DataFrame) -> DataFrame:
    """The columns of the table in order, as text; nulls are empty, the confidence has two digits."""
    def shown(c: str) -> Column:
        value = F.format_string("%.2f", F.col(c).cast("double")) if c == "confidence" else F.col(c).cast("string")
        return F.coalesce(F.when(F.col(c).isNotNull(), value), F.lit("")).alias(c)

    return records.select(*[shown(c) for c in COLUMNS])


class ColumnOrder(ValueError):
    """What was written does not have the columns of the table."""


def write_csv(records: DataFrame, path: str) -> None:
    """Parts of CSV with a header each, whose first name carries the byte-order mark for spreadsheets. The header is read again and checked."""
    rows = csv_rows(records)
    rows.toDF(MARK + COLUMNS[0], *COLUMNS[1:]).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, encoding="UTF-8")
    spark = records.sparkSession
    written = [c.lstrip(MARK) for c in spark.read.csv(path, header=True, escape='"').columns]
    if written and written != list(COLUMNS):
        raise ColumnOrder(f"{path}: {written}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_csv` wrote; empty fields are empty texts."""
    schema = ", ".join(f"`{c}` string" for c in COLUMNS)
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=True, enforceSchema=True).na.fill("")


def cost_reports(calls: DataFrame, by: list[str]) -> DataFrame:
    """``by.., total_cost_usd, report``: one JSON text a run from calls with ``component, tokens_in, tokens_out, pages, latency_ms, cost_usd``."""
    whole = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    parts = calls.groupBy(*by, "component").agg(
        F.count("*").alias("calls"), whole("tokens_in").alias("input_tokens"), whole("tokens_out").alias("output_tokens"), whole("pages").alias("pages_processed"),
        F.round(whole("cost_usd"), 6).alias("cost_usd"), F.round(whole("latency_ms"), 1).alias("latency_ms"),
    )
    fields = F.struct("calls", "input_tokens", "output_tokens", "pages_processed", "cost_usd", "latency_ms")
    runs = parts.groupBy(*by).agg(F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("component"), fields.alias("cost"))))).alias("components"))
    return runs.select(*by, "total_cost_usd", F.to_json(F.struct(*by, "total_cost_usd", "components")).alias("report"))


def diagnostics(found: DataFrame, by: list[str], fields: list[str], name: str) -> DataFrame:
    """``by.., n, json``: the findings of a check (mis-filed rows, missed answers) of each run as one JSON text. A run's findings are few."""
    rows = found.groupBy(*by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return rows.select(*by, "n", F.to_json(F.struct(*by, name)).alias("json"))


def snapshots(documents: DataFrame, path: str) -> DataFrame:
    """Keep the fetched bytes under their hash and return ``source_url, archive_url``; documents without bytes have none.

    Only what the archive lacks is written: the hashes of the documents are joined against those
    it lists, contents are read for the rest alone. Running it again adds no file, and a run that
    broke off has added nothing, so it is safe to repeat.
    """
    spark = documents.sparkSession
    named = documents.select("source_url", F.sha2("content", 256).alias("sha"))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    begun = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    wanted = named.where("sha is not null").select("sha").distinct()
    lacking = wanted.join(spark.read.schema("sha string, content binary").parquet(path).select("sha"), "sha", "left_anti") if begun else wanted
    lacking = settled(lacking)
    if not lacking.isEmpty():
        kept = documents.where("content is not null").select(F.sha2("content", 256).alias("sha"), "content").join(lacking, "sha", "left_semi")
        kept.groupBy("sha").agg(F.first("content").alias("content")).write.mode("append").parquet(path)
    return named.select("source_url", F.when(F.col("sha").isNotNull(), F.concat(F.lit(f"{path}#"), "sha")).alias("archive_url"))


def log_lines(events: DataFrame, time: str, level: str = "INFO") -> DataFrame:
    """Events as JSON lines: time, level, then all other fields."""
    rest = [c for c in events.columns if c != time]
    return events.select(F.to_json(F.struct(F.col(time).cast("string").alias("time"), F.lit(level).alias("level"), *rest)).alias("line"))


def envelopes(records: DataFrame, document: list[str], provision: list[str], key: str = "source_url", order: str = "rec_no") -> DataFrame:
    """``key, first_rec, n, json``: one JSON text a document, in order of first appearance; its own fields are those of its first row."""
    grouped = records.groupBy(key).agg(
        F.min(order).alias("first_rec"), F.count("*").alias("n"), F.min_by(F.struct(*document), order).alias("document"),
        F.sort_array(F.collect_list(F.struct(order, *provision))).alias("provisions"),
    )
    return grouped.select(key, "first_rec", "n", F.to_json(F.struct(key, "document", "provisions")).alias("json"))


def split_valid(records: DataFrame, indicators: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records that may be written, and the rest with what is wrong."""
    checked = records.withColumn("violations", violations(indicators))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def write_parquet(records: DataFrame, path: str, by: tuple[str, ...] = ("economy", "pillar")) -> None:
    """Partitioned, so that a reader of one economy and pillar reads nothing else."""
    records.write.mode("overwrite").partitionBy(*by).parquet(path)


def with_placeholder(runs: DataFrame, costs: DataFrame, key: str = "run") -> DataFrame:
    """Each run with its newest cost report, or a placeholder."""
    latest = costs.groupBy(key).agg(F.max_by("cost", "at").alias("cost"))
    return runs.join(latest, key, "left").withColumn("placeholder", F.col("cost").isNull()).withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def report_lines(scores: DataFrame, by: str = "pillar") -> DataFrame:
    """Markdown lines of a score table."""
    cells = [F.col(by).cast("string"), *[F.format_string("%.1f", F.col(c)) for c in ("known_score", "new_score", "total_score")]]
    return scores.select(by, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def report(scores: DataFrame, title: str, by: str = "pillar") -> str:
    """The score table as Markdown. It has a line a pillar, so the driver may hold it."""
    lines = [r[1] for r in report_lines(scores, by).orderBy(by).collect()]
    return "\n".join([f"# {title}", "", f"| {by} | known | new | total |", "|---|---|---|---|", *lines, ""])
