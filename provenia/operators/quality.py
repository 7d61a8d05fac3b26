"""Validation of records, review flags, the URL status table and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions import text as T

#: Required columns, and all columns of the table that is written, in order.
REQUIRED = ("economy", "law_name", "indicator_id", "article", "discovery_tag", "verbatim_snippet", "source_url")
COLUMNS = (
    "economy", "law_name", "law_number_ref", "last_amended", "indicator_id", "article", "discovery_tag", "location_reference",
    "verbatim_snippet", "mapping_rationale", "source_url", "confidence", "notes",
)
REVIEW_BELOW, RATIONALE, CER_GATE = 0.80, 300, 0.05
#: What makes a record worth a look, as patterns of the law's name, the article and the snippet; and a name's least length.
ABBREVIATION, SHORT_NAME = "^[A-Z]{2,8}$", 20
BARE_ARTICLE = r"^(Art\.|s\.|Section|Reg\.)\s*\d+$"
CROSS_REFERENCE = r"(?i)\b(see also|pursuant to|as defined in|referred to in section|under [A-Z][a-z]+ Act)\b"
DELEGATED = r"\b(Regulations|Order|Rules|Subsidiary Legislation|Direction)\b"


def listed(*checks: tuple[Column, Column | str]) -> Column:
    """The messages of the conditions that hold, in order."""
    messages = [F.when(cond, m if isinstance(m, Column) else F.lit(m)) for cond, m in checks]
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def violations(indicators: list[str]) -> Column:
    """What keeps an output record from being written."""
    return listed(
        *[(blank(c), f"required field '{c}' is empty") for c in REQUIRED],
        (~F.col("confidence").between(0.0, 1.0), "confidence out of range [0, 1]"),
        (~F.coalesce("indicator_id", F.lit("")).isin(*indicators), F.concat(F.lit("invalid indicator_id '"), "indicator_id", F.lit("'"))),
        (~F.coalesce("discovery_tag", F.lit("")).isin("KNOWN", "NEW"), "discovery_tag must be 'KNOWN' or 'NEW'"),
        (F.length("mapping_rationale") > RATIONALE, "mapping_rationale exceeds 300 chars"),
        (F.col("doc_type").isin("TEXT_PDF", "SCANNED_PDF") & blank("location_reference"), "location_reference required for PDF sources"),
    )


def document_violations() -> Column:
    return listed(
        (blank("source_url"), "source_url empty"), (blank("economy"), "economy empty"), (blank("raw_text"), "raw_text empty"),
        (F.col("cer") > CER_GATE, "cer above gate"), (F.col("page_count") < 1, "page_count below 1"),
    )


def provision_violations() -> Column:
    return listed(
        (blank("indicator_id"), "indicator_id empty"), (blank("article"), "article empty"), (blank("verbatim_snippet"), "snippet empty"),
        (~F.col("confidence").between(0.0, 1.0), "confidence out of range"), (F.length("mapping_rationale") > RATIONALE, "rationale too long"),
    )


def review_flags() -> Column:
    """Reasons for a human to look."""
    snippet, law = F.coalesce("verbatim_snippet", F.lit("")), F.coalesce("law_name", F.lit(""))
    return listed(
        (F.col("confidence") < REVIEW_BELOW, "low_confidence"),
        ((law != "") & (law.rlike(ABBREVIATION) | (F.length(law) < SHORT_NAME)), "law_name_possibly_abbreviated"),
        (F.col("article").rlike(BARE_ARTICLE), "article_missing_paragraph"),
        (F.col("portal_type") == "secondary", "non_primary_source"),
        (F.col("untestable"), "discovery_tag_unresolvable"),
        (snippet.rlike(CROSS_REFERENCE), "cross_reference"),
        (law.rlike(DELEGATED), "delegated_legislation"),
    )


def url_status(status: Column, body: Column, host: Column, final_host: Column) -> Column:
    """Outcome of a probe."""
    ok = F.when(T.is_error_page(body), "soft_404").when(host != final_host, "redirected").otherwise("ok")
    return F.when(status == 200, ok).when(status == 429, "retry_after").when(status.between(400, 499), "broken").when(status >= 500, "retry").otherwise("error")


def in_portals(rows: DataFrame, portals: DataFrame, host: str = "host") -> DataFrame:
    """Add ``in_portal``: the host, or a domain it lies under, is a portal of its economy.

    The host's own suffixes are exploded, so this is an equi-join and not a test of all portals.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = rows.select("economy", host, F.explode(suffixes).alias("portal")).distinct().join(portals.select("economy", "portal").distinct(), ["economy", "portal"])
    flagged = hit.select("economy", host).distinct().withColumn("in_portal", F.lit(True))
    return rows.join(flagged, ["economy", host], "left").withColumn("in_portal", F.coalesce("in_portal", F.lit(False)))


def gate(rows: DataFrame, pillar: str, least_confidence: float, mode: str = "warn") -> bool:
    """Whether a pillar has a row that is confident enough. ``fail`` raises instead of returning False."""
    passed = not rows.where((F.col("pillar") == pillar) & (F.col("confidence") >= least_confidence)).limit(1).isEmpty()
    if mode == "fail" and not passed:
        raise ValueError(f"no row of {pillar} reaches confidence {least_confidence}")
    return passed or mode == "off"


def dedup_apply_join(rows: DataFrame, key: str, apply) -> DataFrame:
    """Run a costly function of one column once for each distinct value, then join its result back.

    ``apply`` maps a frame of the distinct values to one with more columns. Spark decides by
    size whether the result is broadcast.
    """
    return rows.join(apply(rows.select(key).distinct()), key, "left")


#: The note on unsure records, what stands for no act, and how a no-barrier row begins.
REVIEW_NOTE = "Recommend human review — OCR/translation source"
NO_ACT, NO_ARTICLE, NO_FINDING = ("", "nan", "none", "—", "-", "n/a"), ("", "N/A"), "[No qualifying"


def with_review_note(notes: Column, confidence: Column, note: str = REVIEW_NOTE) -> Column:
    """The note once on records below the threshold; records without a confidence are left alone."""
    return F.when(confidence < REVIEW_BELOW, T.append_note(notes, F.lit(note))).otherwise(notes)


def has_act(c: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*NO_ACT)


def is_null_row(article: Column, snippet: Column) -> Column:
    """Whether a row only says that an indicator was assessed."""
    return F.upper(F.trim(F.coalesce(article, F.lit("")))).isin(*NO_ARTICLE) | F.trim(F.coalesce(snippet, F.lit(""))).startswith(NO_FINDING)


def is_target(article: Column, text: Column, section: Column, phrases: Column) -> Column:
    """Whether a chunk is the one a probe looks for: by its section, or by a phrase it holds."""
    return (F.lower(F.coalesce(article, F.lit(""))) == F.lower(section)) | T.any_term(text, phrases)


def with_content(rows: DataFrame, blobs: DataFrame, url: str = "source_url") -> DataFrame:
    """The bytes fetched for each row's URL, where there are any."""
    return rows.join(blobs.select(url, "content"), url, "left")
