"""Filling fixed-capacity containers by best-two-fit.

A bin is filled greedily with the largest item that fits; then its smallest item gives way to two
unpacked items that fill the expanded gap more tightly, if there are such. Items are dealt to shards at
random, each shard packs alone, and what lies in loosely filled bins is dealt and packed again in fewer
shards, so the waste of shard borders vanishes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.runtime import Scratch

#: Items of a shard; the number of shards follows from the items alone, so containers are the same on any cluster.
SHARD_ITEMS = 10_000
#: A bin filled less than this is opened again in the next round.
TIGHT = 0.995
#: Rounds go on until one shard is left, or a round leaves more than this share of its items in loose bins.
LEAST_GAIN = 0.9


class _Unpacked:
    """Items by size; a bitmap of the sizes at hand gives the largest one up to a limit."""

    def __init__(self, sizes: list[int]):
        self.items: dict[int, list[int]] = {}
        self.bits = 0
        for i in range(len(sizes) - 1, -1, -1):
            self.give(sizes[i], i)

    def give(self, size: int, item: int) -> None:
        self.items.setdefault(size, []).append(item)
        self.bits |= 1 << size

    def take(self, size: int) -> int:
        own = self.items[size]
        item = own.pop()
        if not own:
            self.bits &= ~(1 << size)
        return item

    def largest(self, limit: int) -> int:
        """The largest size at hand of at most ``limit``; 0 if none (items of size 0 are not kept here)."""
        return (self.bits & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and self.bits & ((1 << (limit + 1)) - 1) else 0

    def best_pair(self, limit: int, least: int) -> tuple[int, int] | None:
        """Two sizes at hand with the greatest sum within (least, limit]."""
        best = None
        a = self.largest(limit)
        while 2 * a > least:
            room = limit - a
            b = self.largest(min(a, room))
            if b == a and len(self.items[a]) < 2:
                b = self.largest(a - 1)
            if b and a + b > least:
                best, least = (a, b), a + b
                if least == limit:
                    break
            a = self.largest(a - 1)
        return best


def best_two_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin number of each item (sizes within 1..capacity)."""
    bins = [-1] * len(sizes)
    left, packed, number = _Unpacked(sizes), 0, 0
    while packed < len(sizes):
        own: list[int] = []
        gap = capacity
        while gap and (s := left.largest(gap)):
            own.append(left.take(s))
            gap -= s
        if gap:
            smallest = min(own, key=lambda i: sizes[i])
            pair = left.best_pair(gap + sizes[smallest], sizes[smallest])
            if pair:
                own.remove(smallest)
                own += [left.take(pair[0]), left.take(pair[1])]
                left.give(sizes[smallest], smallest)
        for i in own:
            bins[i] = number
        packed += len(own)
        number += 1
    return bins


def pack(items: DataFrame, key: str, size: str, targets: dict[str, int], scratch: Scratch) -> DataFrame:
    """``(target_name, container_id, key, piece, start_token, tokens)``: every item of ``items`` for every target.

    Items longer than the capacity are cut into whole containers and a rest; all others stay whole, as
    piece 0. Null sizes count as 0. Items of size 0 take no room and share one container per target,
    ``empty``. An empty table gives an empty result. ``items`` must be cheap to read again.
    """
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()
    out = f"target_name string, container_id string, `{key}` {kind}, piece int, start_token long, tokens long"
    if not targets:
        return spark.createDataFrame([], out)
    named = F.explode(F.create_map(*[F.lit(x) for t, c in sorted(targets.items()) for x in (t, c)])).alias("target_name", "_cap")
    sized = items.select(key, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size")).select("*", named)
    pieces = sized.select(
        "target_name", key, "_size", F.col("_cap").cast("long").alias("_cap"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_size") / F.col("_cap")) - 1).cast("int"))).alias("piece"),
    )
    start = (F.col("piece").cast("long") * F.col("_cap")).alias("start_token")
    pieces = pieces.select("target_name", key, "piece", start, F.least(F.col("_cap"), F.col("_size") - F.col("piece") * F.col("_cap")).alias("tokens"), "_cap")
    full = F.col("tokens") == F.col("_cap")
    columns = ["target_name", "container_id", key, "piece", "start_token", "tokens"]
    done = [
        pieces.where(full).withColumn("container_id", F.concat(F.lit("whole-"), F.col(key).cast("string"), F.lit("-"), F.col("piece"))).select(columns),
        pieces.where("tokens = 0").withColumn("container_id", F.lit("empty")).select(columns),
    ]
    open_ = pieces.where(~full & (F.col("tokens") > 0)).select("target_name", key, "piece", "start_token", "tokens")
    turn, before = 0, None
    while counts := dict(open_.groupBy("target_name").count().collect()):
        items = max(counts.values())
        shards = -(-items // SHARD_ITEMS)
        final = shards == 1 or (before is not None and items > LEAST_GAIN * before)
        dealt = open_.withColumn("_shard", F.pmod(F.xxhash64(key, F.col("piece"), F.lit(turn)), F.lit(shards)).cast("int"))
        packed = scratch.write(dealt.groupBy("target_name", "_shard").applyInPandas(_filler(key, targets, turn, final, columns), out + ", loose boolean"), f"packed{turn}")
        done.append(packed.where("NOT loose").select(columns))
        if final:
            break
        open_, turn, before = packed.where("loose").select("target_name", key, "piece", "start_token", "tokens"), turn + 1, items
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def _filler(key: str, targets: dict[str, int], turn: int, final: bool, columns: list[str]):
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", key, "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        capacity, shard = targets[pdf["target_name"].iloc[0]], pdf["_shard"].iloc[0]
        bins = pd.Series(best_two_fit(pdf["tokens"].tolist(), capacity))
        used = pdf["tokens"].groupby(bins).transform("sum")
        pdf["container_id"] = f"r{turn}-s{shard}-" + bins.astype(str)
        pdf["loose"] = (used < TIGHT * capacity) & (not final)
        return pdf[[*columns, "loose"]]

    return fill
