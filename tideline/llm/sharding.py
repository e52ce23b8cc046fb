"""Rendezvous hashing of record keys over weighted shards.

Each shard draws an exponential waiting time from the hash of (key, shard), at a rate of its
weight; the shortest wait wins. A shard therefore gets keys in proportion to its weight, and a
new shard only ever takes keys into itself, because the other draws do not change. No state
and no shuffle are needed to place a row.

Edge cases: equal keys share a shard, and so do all null keys. Null and empty texts have size 1
and checksum 0. Repeated rows are placed alike and get a slot each. An empty table gives no
rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import rank_in_groups, utf8_length

_UNIT = 2.0**-53


def wait(key: Column, shard: Column, weight: Column) -> Column:
    """The draw of one shard for one key; a smaller one wins."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard), 11)
    return -F.log((bits + F.lit(0.5)) * F.lit(_UNIT)) / weight


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard that wins ``key``; ``weights`` maps shard numbers to positive weights."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("every shard needs a positive weight")
    shards = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in weights.items()])
    draws = F.transform(
        shards, lambda s: F.struct(wait(key, s["shard"], s["weight"]).alias("wait"), s["shard"].alias("shard"))
    )
    return F.array_min(draws)["shard"]


def place(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot in the shard (by key) and the shard under ``grown`` for each row.

    Slots are gapless from 0; they follow key, checksum and size.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (utf8_length(F.col(text)) + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
    return rank_in_groups(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")
