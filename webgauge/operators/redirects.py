"""Redirect chains from single captured hops, by pointer jumping.

A hop says where one address leads.  Each round joins every open chain with the chain that begins where it ends, so that
chains double: a limit of six redirects takes three rounds, whatever the number of addresses.  Only addresses that
redirect move; where many lead to the same next address, the join's large side is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.constants import MAX_REDIRECTS
from webgauge.functions import urls
from webgauge.runtime import discard, materialize

CHAIN = "array<struct<url:string,status:int,location:string>>"
LOOP, TOO_MANY, MISSING = "loop", "too many redirects", "target not captured"


def is_redirect(status: Column, location: Column) -> Column:
    return (status >= 300) & (status < 400) & (F.coalesce(location, F.lit("")) != "")


def hops_of(captures: DataFrame) -> DataFrame:
    """(url, status, location) of captured answers: one for each address, the location made absolute; null where the
    answer is no redirect.  Of several answers of an address the last fetched counts, then the largest."""
    moved = is_redirect(F.col("status"), F.col("location"))
    location = F.when(moved, F.coalesce(urls.resolve(F.col("location"), F.col("url")), F.col("location")))
    order = F.struct(*([F.col("fetched_at")] if "fetched_at" in captures.columns else []), F.col("status"), location)
    answer = F.struct(F.col("status").cast("int").alias("status"), location.alias("location"))
    return captures.where("url IS NOT NULL").groupBy("url").agg(F.max_by(answer, order).alias("a")).select("url", "a.*")


def redirect_chains(hops: DataFrame, limit: int = MAX_REDIRECTS) -> DataFrame:
    """(url, final_url, final_status, hops, chain, error) of every address of hops (url, status, location).

    ``chain`` lists the redirects followed, at most ``limit``.  An address that doesn't redirect ends its own chain.
    ``error`` names chains that come back to an address of theirs, that go on beyond the limit, and that lead to an
    address nobody captured; their final status is null, and the final address is the last one reached.  A loop is named
    as one where the limit lets it close.  Addresses are compared without fragments; of several hops of an address the
    largest status counts.
    """
    whole = lambda c: F.regexp_replace(c, "#.*$", "")
    known = hops.select(whole(F.col("url")).alias("url"), "status", "location").groupBy("url").agg(F.max_by(F.struct("status", "location"), F.struct("status", "location")).alias("h"))
    known = materialize(known.select("url", "h.status", F.col("h.location").alias("location")), "hops")
    moved = known.where("location IS NOT NULL")
    step = F.struct("url", "status", "location")
    # one redirect more than the limit shows that a chain goes on
    chains = materialize(moved.select("url", whole(F.col("location")).alias("end"), F.array(step).cast(CHAIN).alias("chain")), "chains")
    length = 1
    while length < limit + 1:
        ahead = chains.select(F.col("url").alias("end"), F.col("end").alias("next_end"), F.col("chain").alias("next_chain"))
        joined = chains.join(ahead, "end", "left")
        longer = F.slice(F.concat("chain", F.coalesce("next_chain", F.array().cast(CHAIN))), 1, limit + 1)
        doubled = joined.select("url", F.coalesce("next_end", "end").alias("end"), longer.alias("chain"))
        doubled = materialize(doubled, "chains")
        discard(chains)
        chains, length = doubled, length * 2
    last = known.select(F.col("url").alias("end"), F.col("status").alias("end_status"), F.lit(True).alias("captured"))
    reached = whole(F.element_at("chain", -1)["location"])
    chains = chains.withColumn("end", reached).join(last, "end", "left")
    visited = F.transform(F.col("chain"), lambda x: x["url"])
    # the chain without what comes after it first returns
    again = F.size(F.array_distinct(F.concat(visited, F.array("end")))) < F.size("chain") + 1
    error = F.when(again, LOOP).when(F.size("chain") > limit, TOO_MANY).when(F.col("captured").isNull(), MISSING)
    kept = F.slice("chain", 1, limit)
    found = chains.select("url", F.element_at(kept, -1)["location"].alias("final_url"), F.when(error.isNull(), F.col("end_status")).alias("final_status"), F.size(kept).alias("hops"), kept.alias("chain"), error.alias("error"))
    own = known.where("location IS NULL").select("url", F.col("url").alias("final_url"), F.col("status").alias("final_status"), F.lit(0).alias("hops"), F.array().cast(CHAIN).alias("chain"), F.lit(None).cast("string").alias("error"))
    return found.unionByName(own)


def identities(chains: DataFrame) -> DataFrame:
    """(site_key, url, identity) of addresses that end at another one, for the crawl frontier, in canonical form."""
    ends = chains.where("hops > 0 AND error IS NULL").select(urls.host(F.col("url")).alias("site_key"), urls.canonical(F.col("url")).alias("url"), urls.canonical(F.col("final_url")).alias("identity"))
    return ends.where("url <> identity").groupBy("site_key", "url").agg(F.min("identity").alias("identity"))


def followed(captures: DataFrame, limit: int = MAX_REDIRECTS) -> DataFrame:
    """A capture for each address of captured answers (url, status, location, ...) whose chain ends: the answer at the
    chain's end, with the address asked for, the address it came from and the redirects between."""
    chains = materialize(redirect_chains(hops_of(captures), limit), "redirects")
    whole = F.regexp_replace("url", "#.*$", "")
    order = F.struct(*([F.col("fetched_at")] if "fetched_at" in captures.columns else []), F.col("status"))
    answers = captures.where("url IS NOT NULL").withColumn("_end", whole).groupBy("_end").agg(F.max_by(F.struct(*captures.columns), order).alias("a")).select("_end", "a.*")
    ends = chains.where("error IS NULL").select(F.regexp_replace("final_url", "#.*$", "").alias("_end"), F.col("url").alias("requested_url"), F.col("chain").alias("redirect_chain"))
    kept = [c for c in captures.columns if c not in ("requested_url", "redirect_chain")]
    return ends.join(answers.select("_end", *kept), "_end").drop("_end")
