"""Exact deduplication against a history, by a minimal perfect hash over the history's distinct digests.

The history's digests are dealt into shards of bounded size by their first bytes. In each shard a minimal perfect
hash is built in levels: at each level a digest that has its bit to itself is settled there, the others go on to the
next; a digest's slot is the rank of its bit. A slot holds the whole digest and the locator (smallest doc_id) of its
winner, so that a lookup compares all bytes and never mistakes a stranger for a member. Digests of the new rows that
are members take the winner's locator; the others are grouped among themselves.

Defined cases: a null text counts as empty; runs of blank characters count as one space; a null doc_id loses against
any other and a group of none but null ids keeps a null locator; rows that repeat both doc_id and text share their
fate; an empty history or empty new rows are fine; doc_id must be an integer (another type is an error); only doc_id and
text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

SHARD_ROWS, GAMMA = 20_000, 2.0


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _parts(digest: list[bytes]) -> np.ndarray:
    """The digests as rows of four 64-bit words."""
    return np.frombuffer(b"".join(digest), "<u8").reshape(-1, 4)


def _place(parts: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = (parts[:, level % 4] ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def build_hash(parts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits, and the slot of each key. Keys are distinct, so each is settled after a few levels."""
    levels, slot, left, taken = [], np.zeros(len(parts), np.int64), np.arange(len(parts)), 0
    while len(left):
        bits = max(64, int(GAMMA * len(left)))
        at = _place(parts[left], len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        rank = np.cumsum(alone) - 1
        settled = alone[at]
        slot[left[settled]] = taken + rank[at[settled]]
        taken += int(alone.sum())
        levels.append(alone)
        left = left[~settled]
    return levels, slot


def find_slots(levels: list[np.ndarray], parts: np.ndarray) -> np.ndarray:
    """A slot for every key, -1 for some strangers; other strangers get a member's slot, so bytes must be compared."""
    slot, left, taken = np.full(len(parts), -1, np.int64), np.arange(len(parts)), 0
    for k, level in enumerate(levels):
        at = _place(parts[left], k, len(level))
        hit = level[at]
        slot[left[hit]] = taken + (np.cumsum(level) - 1)[at[hit]]
        taken += int(level.sum())
        left = left[~hit]
    return slot


def _groups(rows: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return rows.groupBy("sha").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).withColumn("shard", shard)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard: the levels' bits, the slots' digests, the winners' locators (null where every id is null)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = _parts(pdf["sha"].tolist())
        levels, slot = build_hash(parts)
        held, keep, null = np.empty_like(parts), np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int8)
        held[slot] = parts
        keep[slot] = pdf["keep"].fillna(0).astype(np.int64)
        null[slot] = pdf["keep"].isna()
        return pd.DataFrame({"shard": [pdf["shard"].iat[0]], "widths": [[len(x) for x in levels]], "levels": [[np.packbits(x).tobytes() for x in levels]], "slots": [held.tobytes()], "winners": [keep.tobytes()], "nulls": [null.tobytes()]})

    return _groups(history, shards).groupBy("shard").applyInPandas(build, "shard int, widths array<int>, levels array<binary>, slots binary, winners binary, nulls binary")


def look_up(index: DataFrame, groups: DataFrame) -> DataFrame:
    """sha, keep, n of the groups, member (found in the history) and winner (its locator)."""
    schema = "sha binary, keep bigint, n bigint, member boolean, winner bigint"

    def probe(shard: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"sha": [], "keep": pd.array([], "Int64"), "n": [], "member": [], "winner": pd.array([], "Int64")})
        member, winner = np.zeros(len(pdf), bool), pd.array([None] * len(pdf), "Int64")
        if len(shard):
            row = shard.iloc[0]
            levels = [np.unpackbits(np.frombuffer(x, np.uint8))[:w].astype(bool) for x, w in zip(row["levels"], row["widths"], strict=True)]
            parts = _parts(pdf["sha"].tolist())
            held = np.frombuffer(row["slots"], "<u8").reshape(-1, 4)
            slot = find_slots(levels, parts)
            member = (slot >= 0) & (held[np.maximum(slot, 0)] == parts).all(1)
            known = member & (np.frombuffer(row["nulls"], np.int8)[np.maximum(slot, 0)] == 0)
            winner[known] = np.frombuffer(row["winners"], np.int64)[slot[known]]
        return pd.DataFrame({"sha": pdf["sha"], "keep": pdf["keep"].astype("Int64"), "n": pdf["n"], "member": member, "winner": winner})

    return index.groupBy("shard").cogroup(groups.groupBy("shard")).applyInPandas(probe, schema)


def exact_dedup(new: DataFrame, history: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of both tables."""
    column = lambda df, old: df.select("doc_id", "text", F.lit(old).alias("old"))
    return exact_dedup_at(column(new, False).unionByName(column(history, True)), F.col("old"))


def exact_dedup_at(docs: DataFrame, old: Column) -> DataFrame:
    """The same where `old` marks the history's rows within one table, which is then read once."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer")
    digest = F.unhex(F.sha2(normalised().cast("binary"), 256))
    return _dedup(materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(old, F.lit(False)).alias("old"), digest.alias("sha"))))


def _dedup(rows: DataFrame) -> DataFrame:
    past, fresh = rows.where("old"), rows.where(~F.col("old"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))  # both sides meet in them, and either may be the larger
    index = materialise(build_index(past, shards))
    found = look_up(index, _groups(fresh, shards))
    members = found.where("member").select("sha", F.least("keep", "winner").alias("keep"), "n")
    strangers = found.where(~F.col("member")).select("sha", "keep", "n")
    settled = materialise(members.unionByName(strangers))
    whole = _groups(past, shards).select("sha", "keep", "n").unionByName(settled).groupBy("sha").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("group_size"))
    whole = materialise(whole)  # the join then has plain shuffles on both sides, so that Spark can split a large group
    return rows.join(whole, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
