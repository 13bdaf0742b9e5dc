"""Operators with sequential state per key: token buckets and caches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_bucket(requests: DataFrame, per_minute: float, key: str = "user_id", ts: str = "ts", endpoint: str | None = None, limits: dict[str, float] | None = None, idle: float = 3600.0) -> DataFrame:
    """Replay of token buckets: event_id, key, allowed, refused_by, left, reset.

    A bucket starts full and refills at per_minute / 60 a second. A request takes a token of the key's global bucket first, and
    then one of its endpoint's bucket, where `limits` has the endpoint; a request that the endpoint refuses has spent its global
    token. refused_by is `global` or `endpoint`; left is the least of the whole tokens that remain, reset the seconds until the
    global bucket is full. A bucket that is idle for `idle` seconds is dropped, and is full when it comes back. A key's state
    is four numbers for each endpoint; rows of a key are sorted by Spark and read in batches, so no key has to fit in memory.
    """
    limits = limits or {}
    columns = [F.col(key).cast("string").alias("k"), "event_id", (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"), (F.col(endpoint) if endpoint else F.lit(None).cast("string")).alias("endpoint")]
    rows = requests.select(*columns, F.col(key)).repartition("k").sortWithinPartitions("k", "at", "event_id")

    def replay(batches):
        owner, buckets = None, {}

        def taken(name, capacity, at):
            tokens, last = buckets.get(name, (capacity, at))
            tokens = capacity if at - last > idle else min(capacity, tokens + (at - last) * capacity / 60)
            ok = tokens >= 1
            buckets[name] = (tokens - ok, at)
            return ok

        for pdf in batches:
            out = []
            for k, event, at, end in zip(pdf["k"], pdf["event_id"], pdf["at"], pdf["endpoint"], strict=True):
                if k != owner:
                    owner, buckets = k, {}
                refused = None if taken(None, per_minute, at) else "global"
                if refused is None and end in limits and not taken(end, limits[end], at):
                    refused = "endpoint"
                left = buckets[None][0]
                least = min(left, buckets[end][0]) if end in buckets and end in limits else left
                out.append((event, refused is None, refused, int(least), (per_minute - left) / (per_minute / 60)))
            allowed = pd.DataFrame(out, columns=["event_id", "allowed", "refused_by", "left", "reset"])
            allowed.insert(1, key, pdf[key].to_numpy())
            yield allowed

    kind = requests.schema[key].dataType.simpleString()
    return rows.mapInPandas(replay, f"event_id long, {key} {kind}, allowed boolean, refused_by string, left long, reset double")


def endpoint_limits(per_minute: int) -> dict[str, float]:
    return {"query": per_minute, "retrieval": per_minute * 2, "llm": per_minute // 2}


def cache_replay(requests: DataFrame, ttl_seconds: float, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Replay of a cache with a fixed time to live: a request hits if the last miss of its key is at most ttl old.

    The state of a key is one time; rows of a key are sorted by Spark and read in batches.
    """
    rows = requests.select("event_id", key, F.col(key).cast("string").alias("k"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))

    def replay(batches):
        owner, expires = None, None
        for pdf in batches:
            hits = []
            for k, at in zip(pdf["k"], pdf["at"], strict=True):
                owner, expires = (k, None) if k != owner else (owner, expires)
                hits.append(expires is not None and at <= expires)
                expires = expires if hits[-1] else at + ttl_seconds
            yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), key: pdf[key].to_numpy(), "hit": hits})

    kind = requests.schema[key].dataType.simpleString()
    return rows.repartition("k").sortWithinPartitions("k", "at", "event_id").mapInPandas(replay, f"event_id long, {key} {kind}, hit boolean")


def bounded_cache_replay(requests: DataFrame, ttl_seconds: float, capacity: int, cache: str, key: str, ts: str = "ts") -> DataFrame:
    """Replay of caches of bounded size: event_id, hit, size. A column `cache` names the cache, `key` what is asked of it.

    A hit touches its entry. A miss sets it: an expired entry goes when it is read, and a new one at capacity evicts the entry
    that was used longest ago. Entries that a model answered with null (value_null) are never served. A cache's state is its
    entries, `capacity` at most.
    """
    none = F.col("value_null") if "value_null" in requests.columns else F.lit(False)
    rows = requests.select(F.col(cache).cast("string").alias("c"), F.col(key).cast("string").alias("k"), "event_id", (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"), none.alias("none"))

    def replay(batches):
        owner, held = None, {}
        for pdf in batches:
            out = []
            for c, k, event, at, is_null in zip(pdf["c"], pdf["k"], pdf["event_id"], pdf["at"], pdf["none"], strict=True):
                if c != owner:
                    owner, held = c, {}
                entry = held.pop(k, None)
                if entry is not None and at > entry[0]:
                    entry = None
                hit = entry is not None and not entry[1]
                if entry is None and len(held) >= capacity:
                    held.pop(next(iter(held)))  # the dict is in order of use
                held[k] = entry if hit else (at + ttl_seconds, bool(is_null))
                out.append((event, hit, len(held)))
            yield pd.DataFrame(out, columns=["event_id", "hit", "size"])

    return rows.repartition("c").sortWithinPartitions("c", "at", "event_id").mapInPandas(replay, "event_id long, hit boolean, size long")


def cache_statistics(entries: DataFrame, now) -> DataFrame:
    """total, expired and active entries of a table of entries with expires_at."""
    gone = F.count(F.when(F.lit(now) > F.col("expires_at") if not hasattr(now, "_jc") else now > F.col("expires_at"), 1))
    return entries.agg(F.count("*").alias("total"), gone.alias("expired"), (F.count("*") - gone).alias("active"))


def idle_buckets(last_use: DataFrame, now, idle: float = 3600.0) -> DataFrame:
    """The keys whose bucket is dropped: not used for `idle` seconds (key, last_use as seconds)."""
    return last_use.where(now - F.col("last_use") > idle)
