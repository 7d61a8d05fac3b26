"""URL filter: rules on hosts and paths, and gradient-boosted trees on lexical features for the rest.

Everything is made of DataFrame functions. The trees are grown from histograms: each level of a
tree is one aggregation of gradients by node, feature and bin over the labelled sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import discard, stored

#: Host, beginning of the path, verdict. A rule fits its host and all subdomains.
Rules = tuple[tuple[str, str, str], ...]
RULES: Rules = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled URLs that the trees are fitted on, about: different URLs are drawn by hash so that so many are expected.
SAMPLE_ROWS = 20_000
#: Trees, levels of a tree, bins of a feature, shrinkage of a tree, ridge of a leaf.
TREES, DEPTH, BINS, RATE, RIDGE = 10, 3, 16, 0.3, 1.0
#: A suffix needs so many labelled URLs to count, and so many at the overall share are added to it. There are at most ``SAMPLE_ROWS / LEAST_SEEN`` suffixes of a kind.
LEAST_SEEN, PRIOR_SEEN = 5, 10
#: Gradients are summed as whole numbers of this unit, so that sums do not depend on their order.
UNIT = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters")
SUFFIXES = ("top", "domain", "section")
FEATURES = LEXICAL + tuple(f"{s}_share" for s in SUFFIXES)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules = RULES) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null where none does. The rules are a parameter, a branch each."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits: sorted, they fall into runs of one character each."""
    letters = F.array_join(F.array_sort(F.split(text, "")), "")
    runs = F.regexp_extract_all(letters, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    part = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.length(r) * F.log2(F.length(r).cast("double")))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.log2(n) - part / n


def with_features(urls: DataFrame) -> DataFrame:
    """``urls`` (``url, host, path``) with the lexical features and the keys of the suffix statistics."""
    url, digits = F.coalesce("url", F.lit("")), F.lit("0123456789")
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    lexical = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")), "labels": F.size(F.split("host", r"\.")),
        "digit_ratio": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n,
        "hyphens": F.length("host") - F.length(F.translate("host", "-", "")), "entropy": _entropy(F.col("host")),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
    }
    keys = {
        "top": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
        "section": F.regexp_extract("path", r"(?s)^/([^/]*)/", 1),
    }
    return urls.select("*", *[c.cast("double").alias(k) for k, c in lexical.items()], *[c.alias(k) for k, c in keys.items()])


@dataclass
class UrlModel:
    """Shares of blocked URLs by suffix (small frames, by their bound) and trees over ``FEATURES``.

    A tree is a list of inner nodes ``{node: (feature, threshold)}`` and leaves ``{node: value}``;
    the children of node ``i`` are ``2 * i + 1`` (at most the threshold) and ``2 * i + 2``.
    """

    prior: float
    base: float
    shares: dict[str, DataFrame] = field(default_factory=dict)
    trees: list[tuple[dict[int, tuple[str, float]], dict[int, float]]] = field(default_factory=list)

    def with_shares(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the share of blocked URLs that their suffixes have; the overall share for a suffix without one."""
        for name, share in self.shares.items():
            rows = rows.join(F.broadcast(share), name, "left").withColumn(f"{name}_share", F.coalesce(f"{name}_share", F.lit(self.prior)))
        return rows

    def margin(self) -> Column:
        """Log odds that a URL is to be blocked."""
        out = F.lit(self.base)
        for nodes, leaves in self.trees:
            out = out + _walk(nodes, leaves)
        return out


def _walk(nodes: dict[int, tuple[str, float]], leaves: dict[int, float | int], at: int = 0) -> Column:
    if at not in nodes:
        return F.lit(leaves[at])
    name, threshold = nodes[at]
    return F.when(F.col(name) <= threshold, _walk(nodes, leaves, 2 * at + 1)).otherwise(_walk(nodes, leaves, 2 * at + 2))


def _best_split(hist: dict[tuple[int, int], tuple[int, int]], bins: list[int]) -> tuple[float, int, int, list[float], list[float]] | None:
    """Feature and bin of the split that gains most, and its sides' sums; ``hist`` has the sums of gradient and curvature by feature and bin."""
    best = None
    for f, size in enumerate(bins):
        total = [sum(hist.get((f, b), (0, 0))[k] for b in range(size + 1)) / UNIT for k in (0, 1)]
        left = [0.0, 0.0]
        for b in range(size):
            left = [x + y / UNIT for x, y in zip(left, hist.get((f, b), (0, 0)), strict=True)]
            right = [t - x for t, x in zip(total, left, strict=True)]
            gain = sum(g * g / (h + RIDGE) for g, h in (left, right)) - total[0] ** 2 / (total[1] + RIDGE)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                best = gain, f, b, left, right
    return best


def fit_urls(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """Trees and suffix statistics from labelled URLs: ``labelled`` has ``url`` and ``blocked`` (0 or 1).

    About ``sample_rows`` different URLs are drawn by their hash (all, if there are fewer); all
    that is learned comes from them. A URL with both labels counts once for each. Without labelled
    URLs the model allows everything.
    """
    rows = labelled.where("url is not null").select("url", F.col("blocked").cast("int").alias("blocked"))
    n = rows.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    bound = int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < bound).distinct()
    drawn = drawn.select("url", "blocked", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    sample = stored(with_features(drawn), "urls")
    count, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    if not count:
        discard(sample)
        return UrlModel(0.0, -1.0)
    prior = blocked / count
    clipped = min(max(prior, 0.01), 0.99)
    model = UrlModel(prior, log(clipped / (1 - clipped)))
    for name in SUFFIXES:
        share = (F.sum("blocked") + PRIOR_SEEN * prior) / (F.count("*") + PRIOR_SEEN)
        by = sample.groupBy(name).agg(share.alias(f"{name}_share"), F.count("*").alias("seen")).where(f"seen >= {LEAST_SEEN}").drop("seen")
        model.shares[name] = stored(by.coalesce(1), f"shares_{name}")
    edges = model.with_shares(sample).agg(*[F.percentile(f, F.array(*[F.lit(b / BINS) for b in range(1, BINS)])).alias(f) for f in FEATURES]).first()
    cuts = [sorted(set(edges[f])) for f in FEATURES]
    binned = [sum((F.col(f) > c).cast("int") for c in own) if own else F.lit(0) for f, own in zip(FEATURES, cuts, strict=True)]
    # One bounded file: its sums need no exchange.
    train = stored(model.with_shares(sample).select("blocked", *FEATURES, F.array(*binned).alias("bins")).coalesce(1), "url_bins").coalesce(1)
    for _ in range(TREES):
        odds = F.lit(1.0) / (1 + F.exp(-model.margin()))
        nodes: dict[int, tuple[str, float]] = {}
        leaves: dict[int, float] = {0: 0.0}
        open_nodes = {0}
        for _ in range(DEPTH):
            sums = _histograms(train, odds, nodes, {n: n for n in leaves})
            for node in sorted(open_nodes):
                split = _best_split({(f, b): gh for (at, f, b), gh in sums.items() if at == node}, [len(c) for c in cuts])
                if split:
                    _, f, b, *sides = split
                    nodes[node] = FEATURES[f], float(cuts[f][b])
                    del leaves[node]
                    leaves |= {2 * node + k: RATE * g / (h + RIDGE) for k, (g, h) in enumerate(sides, 1)}
            open_nodes = {c for node in open_nodes if node in nodes for c in (2 * node + 1, 2 * node + 2)}
            if not open_nodes:
                break
        if not nodes:
            break
        model.trees.append((nodes, leaves))
    for frame in (sample, train):
        discard(frame)
    return model


def _histograms(train: DataFrame, odds: Column, nodes: dict, numbers: dict[int, int]) -> dict[tuple[int, int, int], tuple[int, int]]:
    """Sums of gradient and curvature by node, feature and bin: one aggregation, a few hundred numbers."""
    unit = lambda c: F.round(c * UNIT).cast("long")
    rows = train.select(
        _walk(nodes, numbers).alias("node"), unit(F.col("blocked") - odds).alias("g"), unit(odds * (1 - odds)).alias("h"), F.posexplode("bins").alias("feature", "bin")
    )
    sums = rows.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return {(r.node, r.feature, r.bin): (r.g, r.h) for r in sums.collect()}


def judge_urls(pages: DataFrame, model: UrlModel | None = None, rules: Rules = RULES) -> DataFrame:
    """Every row of ``pages`` judged by its ``url``: ``page_id, url, host, path, rule, score, verdict``.

    The longest rule that fits decides; else the model, which blocks at a probability (``score``)
    over one half. Without a model it is fitted on the URLs that the rules decide. A null URL, or
    one without ``://``, has an empty host and path, fits no rule, and is left to the model.
    A pass over ``pages`` with joins to tables of a proven bound, no shuffle; repeated rows and ids
    stay, extra columns are left aside.
    """
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    if model is None:
        model = fit_urls(ruled.where("by is not null").select("url", (F.col("by.verdict") == "block").cast("int").alias("blocked")))
    scored = model.with_shares(with_features(ruled)).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    verdict = F.coalesce("by.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", F.col("by.rule").alias("rule"), "score", verdict.alias("verdict"))
