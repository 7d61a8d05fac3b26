"""Column functions on URLs. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only choose a rendering, extensions that are assets, suffixes of two labels.
LANGUAGE_PARAMS = ("lang", "language", "locale")
RENDER_PARAMS = ("wholedoc", "viewtype", "transactionid")
SKIP_EXTENSIONS = (".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".map")
TWO_LABEL_SUFFIXES = (
    "com.au", "gov.au", "net.au", "org.au", "edu.au", "com.sg", "gov.sg", "edu.sg", "org.sg", "com.my", "gov.my", "org.my",
    "co.th", "go.th", "or.th", "co.id", "go.id", "or.id", "com.vn", "gov.vn", "com.ph", "gov.ph", "co.uk", "gov.uk", "org.uk", "ac.uk",
    "co.nz", "govt.nz", "co.jp", "go.jp", "com.kh", "gov.kh", "com.mm", "gov.mm",
)


def before_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment_of(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def _glue(base: Column, query: Column, fragment: Column) -> Column:
    with_query = F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))
    return F.when(fragment == "", with_query).otherwise(F.concat(with_query, F.lit("#"), fragment))


def _key(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def normalise_url(url: Column) -> Column:
    """Lower case, no trailing slash, no language parameters, no blank parameters; repeated keys stand together."""
    u = F.rtrim(F.lower(url), F.lit("/"))
    pairs = F.filter(F.split(query_of(u), "&"), lambda p: p.rlike("^[^=]*=.") & ~_key(p).isin(*LANGUAGE_PARAMS))
    encoded = F.transform(pairs, lambda p: F.concat(_key(p), F.lit("="), F.url_encode(F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")))))
    keys = F.array_distinct(F.transform(encoded, _key))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(encoded, lambda p: _key(p) == k)))
    return _glue(before_query(u), F.array_join(grouped, "&"), fragment_of(u))


def strip_params(url: Column, names: tuple[str, ...] = RENDER_PARAMS) -> Column:
    """The URL without the named query parameters (any case) and without blank ones."""
    pairs = F.filter(F.split(query_of(url), "&"), lambda p: p.rlike("^[^=]*=.") & ~F.lower(_key(p)).isin(*names))
    return _glue(before_query(url), F.array_join(pairs, "&"), fragment_of(url))


def registered_domain(url: Column) -> Column:
    """The host's public suffix and one label before it; the host itself if it has no more."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def is_asset(url: Column) -> Column:
    extension = F.regexp_extract(F.lower(path_of(url)), r"[^/.](\.[^./]*)$", 1)
    return extension.isin(*SKIP_EXTENSIONS)


def canonical_act_key(url: Column, register_host: str = "legislation.gov.au") -> Column:
    """A register's own id where the URL is of that register and has one, else the normalised URL."""
    found = F.regexp_extract(F.lower(url), r"[cf]\d{4}[a-z]\d{5}", 0)
    return F.when(F.contains(F.lower(url), F.lit(register_host)) & (found != ""), found).otherwise(normalise_url(url))


def title_from_slug(url: Column) -> Column:
    slug = F.element_at(F.split(F.rtrim(path_of(url), F.lit("/")), "/"), -1)
    return F.trim(F.regexp_replace(slug, r"[-_]+", " "))


def with_view_suffix(url: Column, suffix: Column) -> Column:
    joined = F.concat(F.regexp_replace(F.substring(suffix, 1, 1), r"\?", "&"), F.substring(suffix, 2, 1000))
    return F.concat(url, F.when(query_of(url) != "", joined).otherwise(suffix))


def safe_slug(url: Column, most: int = 120) -> Column:
    raw = F.concat(path_of(url), F.when(query_of(url) != "", F.concat(F.lit("_"), query_of(url))).otherwise(""))
    slug = F.trim(F.regexp_replace(raw, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.substring(slug, 1, most), F.lit("")), F.lit("archive"))


def fetch_kind(url: Column) -> Column:
    return F.when(F.lower(path_of(url)).rlike(r"\.pdf$|/pdf(/|$)"), "PDF").otherwise("HTML")
