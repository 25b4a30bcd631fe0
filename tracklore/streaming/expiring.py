"""Entries with a time to live on streams: revoked tokens and cached payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.streaming.run import fold_stream


class Revocation:
    """The newest revocation of a token answers checks until it expires; after that nothing has to be kept."""

    SCHEMA = "check_id long, is_revoked boolean"

    def __init__(self) -> None:
        self.expires = 0

    def step(self, values) -> list[tuple]:
        at, side, expires, check_id = values
        if side == 0:
            self.expires = expires
            return []
        return [(check_id, self.expires >= at)]

    def until(self) -> int:
        return self.expires // 1000 + 1


class CacheEntry:
    """The newest payload of a key; a row when it is set, and one when it has expired before another replaced it."""

    SCHEMA = "payload string, expires_at timestamp, event string"

    def __init__(self) -> None:
        self.entry, self.expires = None, 0

    def step(self, values) -> list[tuple]:
        at, payload, expires_at, expires = values
        ended = self.finish() if self.entry and self.expires < at else []
        self.entry, self.expires = (payload, expires_at), expires
        return [*ended, (*self.entry, "set")]

    def until(self) -> int:
        return self.expires // 1000 + 1

    def finish(self) -> list[tuple]:
        return [(*self.entry, "expired")]


def revoked_stream(checks: DataFrame, revocations: DataFrame, late: str = "1 minute") -> DataFrame:
    """``stateless.revoked`` on two streams: token, check_id and is_revoked of every check that the watermark has passed.

    Both sides of a token are folded in the order of their times, so a revocation that arrives after a check of a later
    time still counts for it; rows later than ``late`` are dropped. The state of a token is purged when the
    watermark passes its newest expiry, also where no further row arrives. ``check_id`` is a number.
    """
    none = F.lit(0).cast("long")
    r = revocations.where("expires_at is not null").select("token", F.col("revoked_at").alias("at"), F.lit(0).alias("side"), F.unix_micros("expires_at").alias("expires"), none.alias("check_id"))
    c = checks.select("token", F.col("checked_at").alias("at"), F.lit(1).alias("side"), none.alias("expires"), F.col("check_id").cast("long").alias("check_id"))
    both = r.unionByName(c).withColumn("at_micros", F.unix_micros("at"))
    return fold_stream(both, "token", ["at", "side", "check_id"], ["at_micros", "side", "expires", "check_id"], Revocation, event_time="at", late=late)


def cache_live_stream(entries: DataFrame, key: str, late: str = "1 minute") -> DataFrame:
    """Log of a cache: every entry in the order of its time, and ``expired`` when the newest of a key has run out.

    The newest ``set`` row of a key with ``expires_at`` after now is what :func:`stateless.cache_live` serves. An entry for a key
    that has expired sets it again; an entry that is older than one already passed by the watermark is dropped as late.
    """
    e = entries.where("expires_at is not null").withColumn("expires_micros", F.unix_micros("expires_at")).withColumn("at_micros", F.unix_micros("created_at"))
    return fold_stream(e, key, ["created_at", "payload"], ["at_micros", "payload", "expires_at", "expires_micros"], CacheEntry, event_time="created_at", late=late)
