"""Filling fixed-capacity containers with items: bounded-space online best-fit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.plans.scale import cut, join_small

#: Containers a task keeps open for each kind.
OPEN = 64


class Bins:
    """Open bins of one capacity, found by free space in a bitset; the fullest closes when there are too many.

    ``put`` returns the bins closed by it. A bin is (free space, its items).
    """

    def __init__(self, capacity: int, most: int = OPEN) -> None:
        self.capacity, self.most, self.bits, self.count = capacity, most, 0, 0
        self.at: dict[int, list[list]] = {}

    def _take(self, size: int) -> tuple[int, list] | None:
        """The bin with the least free space that holds ``size``, taken out."""
        left = self.bits >> size
        if not left:
            return None
        free = size + (left & -left).bit_length() - 1
        stack = self.at[free]
        items = stack.pop()
        if not stack:
            del self.at[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return free, items

    def put(self, size: int, item: list) -> list[tuple[int, list]]:
        free, items = self._take(size) or (self.capacity, [])
        items.extend(item)
        free -= size
        closed = []
        if free == 0:
            closed.append((0, items))
        else:
            self.at.setdefault(free, []).append(items)
            self.bits |= 1 << free
            self.count += 1
            if self.count > self.most:
                closed.append(self._take(0))
        return closed

    def rest(self) -> list[tuple[int, list]]:
        found = [(free, items) for free, stack in self.at.items() for items in stack]
        self.at, self.bits, self.count = {}, 0, 0
        return found


def pack(items: DataFrame, item_id: str, size: str, kinds: DataFrame, kind: str, capacity: str, open_bins: int = OPEN, merge_of: int = 64) -> DataFrame:
    """Items in containers of every kind: rows (kind, container_id, item_id, piece, start, tokens).

    ``kinds`` is a short list (kind, capacity), read by the driver. An item that fits is never split; one
    longer than the capacity gives full containers for its leading pieces, each of the capacity, and
    its tail is packed as an item. ``piece`` counts an item's pieces from 1, ``start`` is the offset of
    the piece in it. Items of size 0 or null take no space and go to a container that has any. Kinds
    with a capacity under 1 or null get nothing. ``container_id`` is unique within a kind; a repeated
    item id is packed as often as it occurs.

    Each task packs the items it reads, one after another, into at most ``open_bins`` open containers a
    kind: the one with the least sufficient space gets the item, and the fullest closes when one too
    many is open. What a task still holds open at its end goes, container by container, through
    the same packing again in one task per ``merge_of`` of them (whole contents as one item), and again until
    one task did it, so the unfilled rest is that of ``open_bins`` containers a kind in all. Containers
    are arrays of references to items; no task holds more than its open ones.
    """
    caps = [(str(r[0]), int(r[1])) for r in kinds.select(kind, capacity).collect() if r[1] is not None and r[1] > 0]
    piece = T.StructType([T.StructField("id", items.schema[item_id].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("tokens", T.LongType())])
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("free", T.LongType()), T.StructField("closed", T.BooleanType()), T.StructField("seq", T.LongType()), T.StructField("items", T.ArrayType(piece))])

    def rows(found: list, closed: bool, k: str, seq: list[int]) -> Iterator[tuple]:
        for free, its in found:
            seq[0] += 1
            yield k, free, closed, seq[0], its

    columns = ["kind", "free", "closed", "seq", "items"]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = {k: Bins(c, open_bins) for k, c in caps}
        seq = [0]
        for batch in batches:
            out: list[tuple] = []
            for i, n in zip(batch["id"].tolist(), batch["n"].tolist()):
                for k, c in caps:
                    b, start, p = bins[k], 0, 1
                    while n - start > c:
                        out.extend(rows([(0, [(i, p, start, c)])], True, k, seq))
                        start, p = start + c, p + 1
                    if closed := b.put(n - start, [(i, p, start, n - start)]):
                        out.extend(rows(closed, True, k, seq))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([r for k, b in bins.items() for r in rows(b.rest(), False, k, seq)], columns=columns)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size_of = dict(caps)
        bins = {k: Bins(c, open_bins) for k, c in caps}
        seq = [0]
        for batch in batches:
            out: list[tuple] = []
            for k, free, its in zip(batch["kind"], batch["free"].tolist(), batch["items"]):
                its = [(x["id"], x["piece"], x["start"], x["tokens"]) for x in its]
                out.extend(rows(bins[k].put(size_of[k] - free, its), True, k, seq))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([r for k, b in bins.items() for r in rows(b.rest(), False, k, seq)], columns=columns)

    narrow = items.select(F.col(item_id).alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    stage = 0
    packed = cut(narrow.mapInPandas(first, schema).withColumn("origin", F.concat_ws("-", F.lit(str(stage)), F.spark_partition_id())))
    done = [packed.where("closed")]
    rest = packed.where("not closed")
    while True:
        n = rest.count()
        if not n:
            break
        stage += 1
        tasks = max(1, n // (merge_of * open_bins * max(1, len(caps))))
        packed = cut(rest.select("kind", "free", "closed", "seq", "items").coalesce(tasks).mapInPandas(again, schema).withColumn("origin", F.concat_ws("-", F.lit(str(stage)), F.spark_partition_id())))
        done.append(packed.where("closed"))
        rest = packed.where("not closed")
        if tasks == 1:
            done.append(rest)
            break
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    each = every.select(F.col("kind").alias(kind), F.concat_ws("-", "origin", "seq").alias("container_id"), F.explode("items").alias("i"))
    return each.select(kind, "container_id", F.col("i.id").alias(item_id), F.col("i.piece").alias("piece"), F.col("i.start").alias("start"), F.col("i.tokens").alias("tokens"))


def fill_report(packed: DataFrame, kinds: DataFrame, kind: str, capacity: str) -> DataFrame:
    """By kind: containers, tokens, and the share of the space that is used."""
    by_kind = packed.groupBy(kind, "container_id").agg(F.sum("tokens").alias("t")).groupBy(kind).agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    return join_small(by_kind, kinds.select(kind, capacity), [kind], "inner").select(kind, "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col(capacity))).alias("used_share"))


def usage(packed: DataFrame, names: Sequence[str]) -> DataFrame:
    """Containers with their load."""
    return packed.groupBy(*names, "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
