"""Column functions on titles, citations and running text. All stay in the JVM unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of titles that carry no identity.
TITLE_STOPWORDS = (
    "act", "the", "of", "and", "a", "an", "for", "to", "on", "in", "law", "laws", "regulation", "regulations", "rules", "rule",
    "order", "orders", "no", "cap", "chapter", "ordinance", "code", "bill", "amendment", "revised", "edition",
)
#: Economies by name.
ECONOMIES = {
    "singapore": "SG", "malaysia": "MY", "thailand": "TH", "australia": "AU", "indonesia": "ID", "vietnam": "VN",
    "philippines": "PH", "cambodia": "KH", "myanmar": "MM",
}
#: Characters that count as one another in a quotation.
QUOTED_ALIKE = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), ("­", ""))
#: What an error page says.
ERROR_PHRASES = (
    "page not found", "404 not found", "file not found", "this page cannot be found", "no longer available", "does not exist",
    "resource not found", "error 404", "the requested url was not found",
)
#: Words that mark a line as a title, and phrases of cover pages that do not.
TITLE_MARKERS = ("ACT", "CODE", "ORDINANCE", "DECREE", "LAW", "STATUTE", "REGULATION", "RULES", "BILL")
TITLE_SKIP = (
    "STATUTES OF", "REVISED EDITION", "LAW REVISION", "REPUBLIC OF", "PREPARED AND PUBLISHED", "UNDER THE AUTHORITY", "TABLE OF",
    "ARRANGEMENT OF", "AN ACT TO", "CHAPTER", "FOLLOWING ACT", "PASSED BY PARLIAMENT", "ASSENTED TO", "BE IT ENACTED", "ENACTED BY",
)

#: Patterns of citations. Acts and sections in prose, a section number, Buddhist-era years and their marks.
ACT_NUMBER, SECTION_TOKEN, SECTION_NUMBER = r"\bact\s+([a-z]?\d+[a-z]?)\b", r"(?:section|sec\.?|s\.|§)\s*(\d+[a-z]?)\b", r"\b(\d+[A-Za-z]?)"
BE_YEAR, BE_MARK, BE_MARK_THAI, NUMBER_MARK = r"\b(2[45]\d{2})\b", r"(?i)\s*B\.E\.?\s*$", r"\s*พ\.ศ\.\s*$", r"\bNo\.?\s*(\d)"
#: Forms of a law's number, in order of precedence after an act of a year.
ACT_OF_YEAR = r"\bAct\s+([A-Z]?\d+)\s+of\s+(\d{4})\b"
NO_COMMA_YEAR = r"(?i)\b(?:Act\s+)?No\.?\s*(\d+)\s*,\s*(\d{4})\b"
NO_OF_YEAR = r"(?i)\bNo\.?\s*(\d+)\s+of\s+(\d{4})\b"
LAW_NO = r"(?i)\bLaw\s+No\.?\s*([A-Z0-9.-]+(?:/\d{2,4})?)\b"
BE_REFERENCE = r"(?i)\bB\.?\s*E\.?\s*(25\d{2})\b"
TITLE_REFERENCE = r"(?i)\(\s*Act\s+([A-Z]?\d{1,4})\s*\)"
SIMPLE_ACT = r"(?i)\bAct\s+([A-Z]\d{1,4}|\d{1,3})\b(?!\s+of\b)"
REVISED_EDITION = r"(?i)\b(\d{4})\s*(?:Rev\.?\s*)?(?:Ed\.?|Edition)\b"
#: Evidence of an amendment, the words of titles that do not link a reference, and what is looked at.
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
EFFECTIVE = rf"(?i)\d{{1,2}}\s+(?:{MONTHS})\s+(\d{{4}})\s+Amended\s+by\b"
STATED = r"(?is)(?:latest\s+amendment\s+made\s+by|includes\s+amendments?\s*:|incorporat(?:es|ing)\s+all\s+amendments\s+up\s+to(?:\s+and\s+including)?|last\s+amended(?:\s+on)?)(.{0,260})"
AMENDING_ACT = r"(?i)\bAmended\s+by\s+Act\s+[A-Z]?\d+\s+of\s+(\d{4})\b"
YEAR = r"\b(?:19|20)\d{2}\b"
UNLINKED = ("statutes", "online", "singapore")
META_CHARS, STATED_CHARS, EDITION_CHARS, COVER_CHARS = 100_000, 20_000, 10_000, 1000


def absent(c: Column) -> Column:
    """Null for an empty match."""
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise_title(c: Column) -> Column:
    """Without a year at the end, lower case, single blanks."""
    return collapse(F.lower(F.regexp_replace(F.trim(c), r"\s+\d{4}\s*$", "")))


def split_titles(c: Column) -> Column:
    """Titles of a cell that packs several, parted by ``;`` or blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r";|\n\s*\n"), collapse), lambda t: t != "")


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def title_tokens(c: Column) -> Column:
    """Distinct words that carry identity."""
    return F.array_distinct(F.filter(words_of(c), lambda w: ~w.isin(*TITLE_STOPWORDS) & ~w.rlike(r"^\d+$")))


def title_acronyms(c: Column) -> Column:
    """Initials of the words, with and without a last ``act``."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(c), r"\d{4}", ""), F.lit("[a-z]+"), 0)
    whole = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    short = F.when(F.try_element_at(words, F.lit(-1)) == "act", whole.substr(F.lit(1), F.length(whole) - 1))
    return F.array_distinct(F.filter(F.array(whole, short), lambda a: a.isNotNull() & (a != "")))


def act_numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(ACT_NUMBER), 1))


def section_tokens(c: Column) -> Column:
    """Section numbers cited in prose, distinct, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(SECTION_TOKEN), 1))


def first_section(c: Column) -> Column:
    return absent(F.lower(F.regexp_extract(c, SECTION_NUMBER, 1)))


def section_anchor(c: Column) -> Column:
    return F.concat(F.lit("#pr"), first_section(c), F.lit("-"))


def engine_id(c: Column) -> Column:
    """``7.3`` to ``P7-I3``; null for anything else."""
    pillar, number = (F.regexp_extract(c, r"^\s*(\d+)\.(\d+)", i) for i in (1, 2))
    return F.when(pillar != "", F.concat(F.lit("P"), pillar.try_cast("int"), F.lit("-I"), number.try_cast("int")))


def kit_id(pillar: Column, raw: Column) -> Column:
    """A pillar and a decimal such as 6.4 to ``P6-I4``; null for whole numbers."""
    tenth = F.round((raw % 1) * 10).cast("int")
    return F.when(tenth != 0, F.concat(F.lit("P"), pillar.cast("int"), F.lit("-I"), tenth))


def economy_code(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in ECONOMIES.items() for x in (k, v)])
    return F.coalesce(names[F.lower(F.trim(c))], F.substring(F.upper(F.trim(c)), 1, 2))


def canonical_pillar(c: Column) -> Column:
    """``7``, ``p7``, ``Pillar 7`` to ``P7``; ``6+7`` to ``P6+P7``; others in upper case."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    numbers = F.regexp_extract_all(t, F.lit(r"\d+"), 0)
    named = F.transform(numbers, lambda n: F.concat(F.lit("P"), n.try_cast("int")))
    return F.when(F.size(numbers) == 0, F.upper(t)).when(F.contains(t, F.lit("+")), F.array_join(named, "+")).otherwise(F.get(named, F.lit(0)))


def be_years(c: Column) -> Column:
    """Buddhist-era years in a text, each with its Gregorian year."""
    found = F.filter(F.regexp_extract_all(c, F.lit(BE_YEAR), 1), lambda y: y.cast("int").between(2400, 2599))
    return F.transform(found, lambda y: F.struct(y.alias("be"), (y.cast("int") - 543).alias("ce")))


def convert_be_years(c: Column) -> Column:
    """The text with its Buddhist-era years replaced: the parts between the years, zipped with the new years."""
    parts, years = F.split(c, BE_YEAR), F.regexp_extract_all(c, F.lit(BE_YEAR), 0)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce((F.get(years, i).cast("int") - 543).cast("string"), F.lit("")))), "")


def clean_reference(c: Column) -> Column:
    c = F.trim(F.regexp_replace(c, BE_MARK, ""))
    c = F.trim(F.regexp_replace(c, BE_MARK_THAI, ""))
    return F.regexp_replace(F.regexp_replace(c, NUMBER_MARK, "No. $1"), r"\s+", " ")


_TURN = 64  # texts that are Python strings at one time


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode compatibility form; Spark has no function for it. A batch stays in Arrow, so that little more than its texts and the new ones are held."""
    turns = (texts.slice(at, _TURN).to_pylist() for at in range(0, len(texts), _TURN))
    parts = [pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in turn], pa.string()) for turn in turns]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def quoted_form(c: Column) -> Column:
    """Lower case, in compatibility form, with typographic quotes, dashes, ellipses and soft hyphens as their plain forms.

    Only texts with a character beyond ASCII leave the JVM.
    """
    folded = F.coalesce(nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
    for a, b in QUOTED_ALIKE:
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.lower(folded)


@F.pandas_udf(StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """A capital after every character that is no letter, as titles of cover pages want it; ``initcap`` differs."""
    return texts.map(lambda t: None if t is None else t.title())


def contains_verbatim(snippet: Column, text: Column) -> Column:
    """Single blanks, then no blanks, then the first 80 characters without blanks."""
    snippet, text = quoted_form(snippet), quoted_form(text)
    bare, bare_text = (F.regexp_replace(c, r"\s+", "") for c in (snippet, text))
    loose = F.contains(bare_text, bare) | ((F.length(bare) > 80) & F.contains(bare_text, F.substring(bare, 1, 80)))
    return (bare != "") & (F.contains(collapse(text), collapse(snippet)) | loose)


def unreadable_share(c: Column) -> Column:
    """Share of control, surrogate, private and unassigned characters; 1 for a blank text."""
    bad = F.regexp_count(c, F.lit(r"[\p{Cc}\p{Cs}\p{Co}\p{Cn}&&[^\n\t\r]]"))
    return F.when(F.coalesce(F.trim(F.regexp_replace(c, r"\s+", "")), F.lit("")) == "", F.lit(1.0)).otherwise(F.least(bad / F.length(c), F.lit(1.0)))


def any_term(c: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(F.lower(c), F.lower(t)))


def is_error_page(c: Column) -> Column:
    return any_term(c, F.array(*[F.lit(p) for p in ERROR_PHRASES]))


def title_line(c: Column) -> Column:
    """The first of 25 lines that looks like a title, as it stands; null if none does."""
    lines = F.transform(F.slice(F.split(c, r"\r\n|\r|\n"), 1, 25), lambda x: F.trim(x))
    skip = "|".join(TITLE_SKIP)
    marks = r"\b(" + "|".join(TITLE_MARKERS) + r")\b"
    return F.get(F.filter(lines, lambda x: F.length(x).between(4, 99) & ~F.upper(x).rlike(skip) & F.upper(x).rlike(marks)), F.lit(0))


def derived_title(text: Column, url: Column) -> Column:
    """The title line, capitals as title case; else the last part of the URL's path in capitals; empty without either."""
    line = title_line(text)
    shouted = (F.upper(line) == line) & (F.lower(line) != line)
    slug = F.upper(F.substring_index(F.element_at(F.split(F.rtrim(F.coalesce(url, F.lit("")), F.lit("/")), "/"), -1), "?", 1))
    return F.coalesce(title_case(F.when(shouted, line)), line, slug)


def version_year(url: Column) -> Column:
    """Year of a version's address: of its date parameter, or of the date that ends its path twice over."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    asked = F.coalesce(*[absent(F.regexp_extract(query, rf"(?:^|&){name}=(\d{{4}})", 1)) for name in ("DocDate", "ValidDate")])
    dates = F.regexp_extract_all(F.regexp_extract(url, r"^[^?#]*", 0), F.lit(r"/(\d{4})-\d{2}-\d{2}(?=/)"), 1)
    last, before = F.try_element_at(dates, F.lit(-1)), F.try_element_at(dates, F.lit(-2))
    return F.coalesce(asked, F.when(last == before, last))


def last_amended(text: Column, url: Column) -> Column:
    """Latest year of amendment: of dates before an amendment note, else of stated amendments, else of amending acts, else of the version's address."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, META_CHARS)
    stated = F.regexp_extract_all(F.substring(head, 1, STATED_CHARS), F.lit(STATED), 1)
    years = F.flatten(F.transform(stated, lambda c: F.regexp_extract_all(c, F.lit(YEAR), 0)))
    return F.coalesce(
        F.array_max(F.regexp_extract_all(head, F.lit(EFFECTIVE), 1)), F.array_max(years),
        F.array_max(F.regexp_extract_all(head, F.lit(AMENDING_ACT), 1)), version_year(F.coalesce(url, F.lit(""))),
    )


def act_of_year(title: Column, text: Column) -> Column:
    """``Act n of year``, amending acts left out.

    With a year in the title only acts of that year count, first those whose surroundings share
    two words with the title (one, if it has only one); without it the first act.
    """
    cited = rf"(?i)(?<!Amended\s{{1,20}}by\s{{0,20}}){ACT_OF_YEAR}(?=([\s\S]{{0,180}}))"
    number, year, after = (F.regexp_extract_all(text, F.lit(cited), i) for i in (1, 2, 3))
    acts = F.arrays_zip(number.alias("number"), year.alias("year"), after.alias("after"))
    own_year = F.try_element_at(F.regexp_extract_all(title, F.lit(YEAR), 0), F.lit(-1))
    same = F.filter(acts, lambda a: own_year.isNull() | (a["year"] == own_year))
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(title), F.lit("[a-z]{4,}"), 0), lambda w: ~w.isin(*UNLINKED)))
    near = lambda a: F.size(F.array_intersect(terms, F.regexp_extract_all(F.lower(a["after"]), F.lit("[a-z]{4,}"), 0)))
    linked = F.filter(same, lambda a: own_year.isNotNull() & (F.size(terms) > 0) & (near(a) >= F.least(F.size(terms), F.lit(2))))
    best = F.coalesce(F.try_element_at(linked, F.lit(1)), F.try_element_at(same, F.lit(1)))
    return F.concat(F.lit("Act "), F.upper(best["number"]), F.lit(" of "), best["year"])


def law_number(title: Column, text: Column) -> Column:
    """Reference of a law, by precedence of the forms it may take in the text, then in the title, on the cover, and as a revised edition."""
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    part = lambda c, pattern, i=1: absent(F.regexp_extract(c, pattern, i))
    cover, head = F.substring(text, 1, COVER_CHARS), F.substring(text, 1, EDITION_CHARS)
    return F.coalesce(
        act_of_year(title, text),
        F.concat(F.lit("No. "), part(text, NO_COMMA_YEAR), F.lit(", "), part(text, NO_COMMA_YEAR, 2)),
        F.concat(F.lit("No. "), part(text, NO_OF_YEAR), F.lit(" of "), part(text, NO_OF_YEAR, 2)),
        F.concat(F.lit("Law No. "), part(text, LAW_NO)),
        F.concat(F.lit("B.E. "), part(text, BE_REFERENCE)),
        F.concat(F.lit("Act "), F.upper(part(title, TITLE_REFERENCE))),
        F.concat(F.lit("Act "), F.upper(part(cover, SIMPLE_ACT))),
        F.concat(part(head, REVISED_EDITION), F.lit(" Rev. Ed.")),
    )


def cer_from_confidence(confidences: Column) -> Column:
    """One minus the mean confidence; 1 without any."""
    n = F.size(confidences)
    return F.when(n > 0, 1 - F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(1.0))


def assembled_pages(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), p)), "\n\n")


def chunk_id(document: Column, seq: Column) -> Column:
    return F.concat(F.substring(F.sha2(document, 256), 1, 12), F.lit("_"), F.lpad(seq.cast("string"), 4, "0"))


def citation(article: Column, page: Column) -> Column:
    """``Art. X | Page n`` (pages count from 0), of what there is; null without either."""
    return absent(F.concat_ws(" | ", F.concat(F.lit("Art. "), article), F.concat(F.lit("Page "), (page + 1).cast("string"))))


def shortened(c: Column, most: int = 300) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def append_note(notes: Column, note: Column) -> Column:
    """Once, after ``; ``."""
    notes = F.coalesce(notes, F.lit(""))
    return F.when(F.contains(notes, note), notes).when(notes == "", note).otherwise(F.concat(notes, F.lit("; "), note))


def recovered_json(c: Column) -> Column:
    """The JSON text inside a model's answer: without reasoning, without fences, else from the first to the last bracket."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", ""))
    inner = F.regexp_extract(plain, r"(?s)(\[.*\]|\{.*\})", 1)
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.rlike(r"^\s*[\[{]"), x)
    return F.coalesce(ok(plain), ok(inner))
