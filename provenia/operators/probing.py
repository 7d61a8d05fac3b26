"""Are URLs alive: rounds of probes over what is still open, with waits and a last word."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions import text as T
from provenia.operators.settled import settled

#: Tries of a URL, seconds to wait where a server says "later" without saying when.
TRIES, WAIT = 3, 30.0
ATTEMPT = "struct<attempt:int,code:int,failure:string,wait:double>"

#: Open URLs (``url`` and the columns given) and the number of the round; the same rows with ``code int, failure string`` (``timeout``
#: or ``connection``; null for an answer), ``final_url string, body string, retry_after double``.
Answer = Callable[[DataFrame, int], DataFrame]


def _server(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^/]*//([^/]*)", 1), F.lit(""))


def outcome(url: Column, attempt: Column, tries: int = TRIES) -> tuple[Column, Column]:
    """Status after a probe and the seconds to wait before the next one; a null status means: try again.

    Reads ``code, failure, final_url, body, retry_after``. An answer of 200 is ``soft_404`` if its
    page says so, ``redirected`` if another server gave it, else ``ok``. 429 waits as long as the
    server asks; 5xx and timeouts wait 1, 2, 4 ... seconds; after the last try they are an
    ``error``. Any other answer, and a failed connection, is ``broken``.
    """
    code, failure = F.col("code"), F.coalesce("failure", F.lit(""))
    moved = (_server(url) != "") & (_server(F.col("final_url")) != "") & (_server(url) != _server(F.col("final_url")))
    page = F.when(T.is_error_page(F.coalesce("body", F.lit(""))), "soft_404").when(moved, "redirected").otherwise("ok")
    slow = (failure == "timeout") | (code >= 500)
    last = F.when(attempt >= tries, "error")
    status = F.when(slow | ((failure == "") & (code == 429)), last).when((failure == "") & (code == 200), page).otherwise("broken")
    wait = F.when((failure == "") & (code == 429), F.coalesce("retry_after", F.lit(WAIT))).when(slow & (attempt < tries), F.pow(F.lit(2.0), attempt - 1)).otherwise(0.0)
    return status, wait


def probe(urls: DataFrame, answer: Answer, url: str = "url", tries: int = TRIES) -> DataFrame:
    """``urls`` with ``status``, ``http_status``, ``waited`` and ``attempts`` (an array, in order).

    Works in ``tries`` rounds; only rows that are still open are asked again, and each round is
    written down, so that no URL is asked twice for one try. Each different URL is asked once and
    its answers are joined back. Local files are ``ok`` without a probe, a null URL is ``broken``.
    """
    asked = urls.select(url).distinct().withColumn("attempts", F.array().cast(f"array<{ATTEMPT}>")).withColumn("http_status", F.lit(None).cast("int"))
    local = asked.where(F.col(url).startswith("file://")).withColumn("status", F.lit("ok"))
    done, still = [local], asked.where(F.col(url).isNotNull() & ~F.col(url).startswith("file://"))
    for number in range(1, tries + 1):
        status, wait = outcome(F.col(url), F.lit(number), tries)
        told = answer(still, number).withColumn("status", status).withColumn("_wait", wait)
        tried = F.struct(F.lit(number).alias("attempt"), "code", "failure", F.col("_wait").alias("wait"))
        told = told.withColumn("attempts", F.concat("attempts", F.array(tried))).withColumn("http_status", F.coalesce("code", "http_status"))
        told = settled(told.select(url, "attempts", "http_status", "status"))
        done.append(told.where("status is not null"))
        still = told.where("status is null").drop("status")
    ended = done[0]
    for part in done[1:]:
        ended = ended.unionByName(part)
    ended = ended.withColumn("waited", F.aggregate("attempts", F.lit(0.0), lambda s, a: s + a["wait"]))
    joined = urls.join(ended, url, "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("broken"))).withColumn("waited", F.coalesce("waited", F.lit(0.0)))
