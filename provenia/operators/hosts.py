"""Registered domains by a table of public suffix rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions import urls as U


def suffix_rules(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """``suffix, exception, reach`` of rules as the public list writes them: ``com``, ``*.ck`` (any label before it), ``!www.ck`` (no suffix after all).

    ``suffix`` is what a host is matched by, ``reach`` the number of labels of the public suffix it then has. Comments (``//``) and blank lines are left out.
    """
    text = F.lower(F.regexp_extract(rule, r"^\s*(\S*)", 1))
    rows = rules.select(text.alias("r")).where((F.col("r") != "") & ~F.col("r").startswith("//")).distinct()
    bare = F.regexp_replace("r", r"^(!|\*\.|\.)", "")
    own = F.size(F.split(bare, r"\."))
    exception = F.col("r").startswith("!")
    return rows.select(bare.alias("suffix"), exception.alias("exception"), F.when(exception, own - 1).when(F.col("r").startswith("*."), own + 1).otherwise(own).alias("reach"))


def _last(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def with_registered_domain(rows: DataFrame, rules: DataFrame, url: str = "url", out: str = "domain", rule: str = "rule") -> DataFrame:
    """Add the registered domain of a URL: the host's public suffix and one label more.

    Each different host meets the rules by an equi-join on its own suffixes; an exception wins,
    else the longest rule, else the last label is the suffix. Null for a host that is a suffix
    itself, an address of numbers, or no host. Rules of any number: Spark picks the join.
    """
    host = F.regexp_replace(U.host_of(F.col(url)), r"\.+$", "")
    named = rows.withColumn("_host", F.when((host == "") | host.rlike(r"^[\d.]+$|^\["), None).otherwise(host))
    hosts = named.where("_host is not null").select("_host").distinct().withColumn("_labels", F.split("_host", r"\."))
    n = F.size("_labels")
    each = hosts.select("_host", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("i"), "_labels").select("_host", "n", _last(F.col("_labels"), F.col("i")).alias("suffix"))
    met = each.join(suffix_rules(rules, rule), "suffix").where("reach <= n")
    best = met.groupBy("_host").agg(F.max(F.struct("exception", "reach"))["reach"].alias("_reach"))
    reach = F.coalesce("_reach", F.lit(1))
    domains = hosts.join(best, "_host", "left").select("_host", F.when(n > reach, _last(F.col("_labels"), reach + 1)).alias(out))
    return named.join(domains, "_host", "left").drop("_host")
