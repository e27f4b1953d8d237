"""Filling fixed-capacity containers with items: bounded-space online best fit.

Items stream through slices of bounded size, spread by hash so that no source or length gathers in one.  A slice holds
at most OPEN_BINS open containers, found by free space in a bitset; the fullest closes first.  What is still open when
a slice ends goes through one more round with far fewer slices, so part-filled containers stay rare at any scale.

An item is split only if it alone exceeds the capacity: into full pieces and a rest, which is packed like any item.
Null texts are not items; an empty text is an item of size 0; equal texts are separate items.  A capacity below 1 or a
null one gives no containers; a null separator counts as 0.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_BINS = 64
#: Items per slice: bounds what one task holds, whatever the data.
SLICE_ITEMS = 20_000
PLACED = "spec_id string, container_id string, position int, doc_id bigint, piece int, first_token bigint, tokens bigint, open boolean"


class BestFit:
    """Open bins by free space.  Bit `f` of `free` is set while some open bin has `f` tokens left."""

    def __init__(self, capacity: int, separator: int, bins: int = OPEN_BINS):
        self.capacity, self.separator, self.bins = capacity, separator, bins
        self.free, self.at, self.n_open = 0, {}, 0
        self.closed: list[list[int]] = []

    def _put(self, room: int, items: list[int]) -> None:
        if room <= self.separator:
            self.closed.append(items)
            return
        self.at.setdefault(room, []).append(items)
        self.free |= 1 << room
        self.n_open += 1

    def _take(self, room: int) -> list[int]:
        stack = self.at[room]
        items = stack.pop()
        if not stack:
            del self.at[room]
            self.free ^= 1 << room
        self.n_open -= 1
        return items

    def add(self, item: int, size: int) -> None:
        need = size + self.separator
        above = self.free >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            items = self._take(room)
            items.append(item)
            self._put(room - need, items)
            return
        if self.n_open >= self.bins:
            self.closed.append(self._take((self.free & -self.free).bit_length() - 1))
        self._put(self.capacity - size, [item])

    def still_open(self) -> list[list[int]]:
        return [items for room in sorted(self.at) for items in self.at[room]]


def _pack_slice(last: bool):
    def pack(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        spec, part = key
        pdf = pdf.sort_values(["order", "doc_id", "piece"], ignore_index=True)
        fit = BestFit(int(pdf.capacity.iloc[0]), int(pdf.separator.iloc[0]))
        for i, size in enumerate(pdf.tokens.tolist()):
            fit.add(i, size)
        rows = []
        for n, (items, is_open) in enumerate([(x, False) for x in fit.closed] + [(x, not last) for x in fit.still_open()]):
            rows += [(i, f"{spec}-{'b' if last else 'a'}{part}-{n}", k, is_open) for k, i in enumerate(items)]
        out = pd.DataFrame(rows, columns=["i", "container_id", "position", "open"]).set_index("i")
        return pdf.join(out)[["spec_id", "container_id", "position", "doc_id", "piece", "first_token", "tokens", "open"]]

    return pack


def _specs(specs: DataFrame) -> list[tuple[str, int, int]]:
    """The usable specs; a fixed table of a few rows."""
    rows = specs.where("capacity_tokens >= 1 and spec_id is not null").select("spec_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator")).distinct()
    return sorted((r["spec_id"], r["capacity_tokens"], max(0, r["separator"])) for r in rows.collect())


def items(sized: DataFrame, specs: list[tuple[str, int, int]]) -> DataFrame:
    """Pieces of every document for every spec."""
    each = [F.struct(F.lit(i).alias("spec_id"), F.lit(c).alias("capacity"), F.lit(s).alias("separator")) for i, c, s in specs]
    rows = sized.withColumn("_s", F.explode(F.array(*each) if each else F.array().cast("array<struct<spec_id:string,capacity:int,separator:int>>"))).select("doc_id", "tokens", "_s.*")
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    first = F.col("piece").cast("bigint") * F.col("capacity")
    return rows.select("spec_id", "capacity", "separator", "doc_id", "piece", first.alias("first_token"), F.least(F.col("capacity").cast("bigint"), F.col("tokens") - first).alias("tokens"))


def _round(rows: DataFrame, n_items: int, last: bool) -> DataFrame:
    parts = -(-n_items // SLICE_ITEMS)
    rows = rows.withColumn("order", F.xxhash64("doc_id", "piece")).withColumn("slice", F.pmod(F.col("order"), F.lit(max(1, parts))).cast("int"))
    return rows.groupBy("spec_id", "slice").applyInPandas(_pack_slice(last), PLACED)


def pack(sized: DataFrame, specs: DataFrame, cut) -> DataFrame:
    """Every piece with its container.  `sized` has doc_id and tokens; `cut(df, name)` writes and rereads a table."""
    known = _specs(specs)
    first = items(sized, known)
    full = F.col("tokens") == F.col("capacity")
    # a full piece is a container by itself
    alone = first.where(full).select("spec_id", F.concat_ws("-", "spec_id", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("container_id"), F.lit(0).alias("position"), "doc_id", "piece", "first_token", "tokens")
    rest = first.where(~full)
    n = cut(sized.agg(F.count("*").alias("n")), "pack-count").first()["n"]
    one = cut(_round(rest, n, last=False), "pack-first")
    sizes = {i: (c, s) for i, c, s in known}
    of = lambda k: F.create_map(*[F.lit(x) for i, v in sizes.items() for x in (i, v[k])])[F.col("spec_id")] if sizes else F.lit(1)
    left = one.where("open").select("spec_id", "doc_id", "piece", "first_token", "tokens", of(0).alias("capacity"), of(1).alias("separator"))
    two = _round(left, left.count(), last=True)
    return one.where(~F.col("open")).drop("open").unionByName(two.drop("open")).unionByName(alone)


def utilisation(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, items, tokens and filled share of each spec; separators count as used."""
    boxes = placed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    known = F.broadcast(specs.select("spec_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("sep")))
    boxes = boxes.join(known, "spec_id").withColumn("used", F.col("tokens") + F.col("sep") * (F.col("items") - 1))
    return boxes.groupBy("spec_id", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"),
        F.max("used").alias("fullest"), (F.sum("used") / (F.count("*") * F.first("capacity_tokens"))).alias("filled"),
    )
