"""From what portals offer to the list of acts to read: fallback, ranking, tags, caps, for many economies in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.functions import text as T
from provenia.functions import urls as U
from provenia.operators import dedup, lexical

#: Ways of discovery that have an adapter, the one that is not there yet, least score of a new act, caps of known and new acts.
ADAPTERS = ("index", "api", "sitemap", "auto")
UNDECIDED = "TBD"
LEAST_SCORE, MOST_KNOWN, MOST_NEW = 0.2, 12, 8


def title_scores(candidates: DataFrame, terms: DataFrame, by: Sequence[str] = ("economy", "portal"), key: str = "pos", title: str = "title") -> DataFrame:
    """Add ``score``: BM25 of the title within its portal, divided by the portal's best; 0 where nothing matches. ``terms`` has a column ``term``."""
    scored = lexical.bm25(candidates, terms.select(F.lit("q").alias("query"), "term").distinct(), list(by), key, title).select(*by, key, F.col("score").alias("_raw"))
    best = scored.groupBy(*by).agg(F.max("_raw").alias("_best"))
    part = F.when(F.col("_best") > 0, F.col("_raw") / F.col("_best")).otherwise(0.0)
    scored = scored.join(best, list(by)).select(*by, key, part.alias("score"))
    return candidates.join(scored, [*by, key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _remap_key(url: Column) -> Column:
    return U.normalise_url(F.coalesce(F.try_url_decode(url), url))


def discover(
    portals: DataFrame, candidates: DataFrame, known: DataFrame, titles: DataFrame, remap: DataFrame, groups: DataFrame | None = None,
    excludes: Sequence[str] = (), least_score: float = LEAST_SCORE, most_known: int = MOST_KNOWN, most_new: int = MOST_NEW,
) -> DataFrame:
    """``economy, pos, title, url, tag``: the acts of each economy, known ones first.

    ``portals``: ``economy, portal`` (their order)``, strategy, url``; ``candidates``: ``economy,
    portal, pos, title, url, score`` as adapters found them; ``known``: ``economy, url``;
    ``titles``: ``economy, title``; ``remap``: ``economy, source, target``; ``groups``: ``economy, grp,
    title`` (normalised).

    A portal whose adapter found nothing, or that has none, falls back to the known URLs of its
    domain, and to all known URLs of its economy where there are none. Candidates are ranked by score; excluded
    titles go, even known ones; KNOWN is what has a known URL or title, NEW what scores enough.
    URLs are remapped; the first of an act (by portal and rank) stays; known URLs that no portal
    offered come last. Known acts are capped by taking turns over the groups, new ones by rank.
    """
    live = portals.where(F.col("strategy") != UNDECIDED)
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as few bytes make very many rows
    offered = candidates.repartition(n, "economy", "portal", "pos").join(live.where(F.col("strategy").isin(*ADAPTERS)).select("economy", "portal"), ["economy", "portal"], "left_semi")
    empty = live.join(offered.select("economy", "portal").distinct(), ["economy", "portal"], "left_anti")

    lower = F.lower("title")
    banned = F.lit(False)
    for term in excludes:
        banned = banned | lower.contains(term.lower())
    known = known.select("economy", "url").distinct()
    by_url = known.select("economy", U.normalise_url(F.col("url")).alias("_u"), F.lit(True).alias("_by_url")).distinct()
    by_title = titles.select("economy", T.normalise_title(F.col("title")).alias("_t"), F.lit(True).alias("_by_title")).distinct()
    ranked = offered.where(~F.coalesce(banned, F.lit(False))).withColumn("_u", U.normalise_url(F.col("url"))).withColumn("_t", T.normalise_title(F.coalesce("title", F.lit(""))))
    ranked = ranked.join(by_url, ["economy", "_u"], "left").join(by_title, ["economy", "_t"], "left")
    is_known = F.coalesce("_by_url", F.lit(False)) | F.coalesce("_by_title", F.lit(False))
    place = lambda *more: F.struct(F.col("portal").cast("long").alias("portal"), *more)
    found = ranked.withColumn("tag", F.when(is_known, "KNOWN").when(F.col("score") >= least_score, "NEW")).where("tag is not null").select(
        "economy", place((-F.col("score")).cast("double").alias("rank"), F.col("pos").cast("long").alias("pos")).alias("at"), "title", "url", "tag"
    )

    # Known URLs of a portal's own domain; portals without any share one copy of the economy's, at the first of them.
    none, seed = F.lit(0.0), [F.lit("").alias("title"), "url", F.lit("KNOWN").alias("tag")]
    domains = known.withColumn("domain", U.registered_domain(F.col("url")))
    wanted = empty.select("economy", "portal", U.registered_domain(F.col("url")).alias("domain"))
    # the first portal of a domain stands for all of them: of an act only the first portal counts
    own = wanted.groupBy("economy", "domain").agg(F.min("portal").alias("portal")).join(domains, ["economy", "domain"])
    lost = wanted.join(domains.select("economy", "domain").distinct(), ["economy", "domain"], "left_anti").groupBy("economy").agg(F.min("portal").alias("portal"))
    at = place(none.alias("rank"), F.lit(0).cast("long").alias("pos")).alias("at")
    last = F.struct(F.lit(2**62).alias("portal"), none.alias("rank"), F.lit(0).cast("long").alias("pos")).alias("at")
    every = found.unionByName(own.select("economy", at, *seed)).unionByName(lost.join(known, "economy").select("economy", at, *seed)).unionByName(known.select("economy", last, *seed))

    targets = remap.select("economy", _remap_key(F.col("source")).alias("_k"), "target").groupBy("economy", "_k").agg(F.min("target").alias("target"))
    every = every.withColumn("_k", _remap_key(F.col("url"))).join(targets, ["economy", "_k"], "left").withColumn("url", F.coalesce("target", "url"))
    row = F.struct("at", F.coalesce("url", F.lit("")).alias("url"), "title", "tag")
    acts = every.groupBy("economy", U.canonical_act_key(F.col("url")).alias("_act")).agg(F.min(row).alias("r")).select("economy", "r.*")

    order = F.row_number().over(Window.partitionBy("economy", "tag").orderBy("at", "url"))
    fresh = acts.where("tag = 'NEW'").withColumn("rank", order).where(F.col("rank") <= most_new)
    if groups is None:
        old = acts.where("tag = 'KNOWN'").withColumn("rank", order).where(F.col("rank") <= most_known)
    else:
        old = acts.where("tag = 'KNOWN'").withColumn("_name", T.normalise_title(F.coalesce("title", F.lit(""))))
        old = dedup.round_robin(old.withColumnRenamed("at", "rank"), groups.withColumnRenamed("title", "_name"), most_known, "_name", "url", "rank", ["economy"], "_turn")
        old = old.withColumn("rank", F.col("_turn"))
    both = old.select("economy", F.lit(0).alias("_first"), "rank", "title", "url", "tag").unionByName(fresh.select("economy", F.lit(1).alias("_first"), "rank", "title", "url", "tag"))
    pos = F.row_number().over(Window.partitionBy("economy").orderBy("_first", "rank"))
    return both.withColumn("pos", pos.cast("long")).select("economy", "pos", "title", "url", "tag")
