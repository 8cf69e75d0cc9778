"""Rasters as pixel tables (image, x, y, r, g, b): differences, masks, components, regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import round_to
from strataloom.operators.graph import connected
from strataloom.session import saved

CHANNELS = "rgb"
TILE = 256


def channel_gaps() -> list[Column]:
    return [F.abs(F.col(f"{c}_new") - F.col(f"{c}_old")) for c in CHANNELS]


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    side = lambda frame, s: frame.select("image", "x", "y", *(F.col(c).alias(f"{c}_{s}") for c in CHANNELS))
    return side(old, "old").join(side(new, "new"), ["image", "x", "y"], "full_outer")


def outside(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """Pixels in none of the masks (x0, y0, x1, y1), which are few and broadcast by size."""
    m = masks.select("x0", "y0", "x1", "y1")
    return rows.join(m, (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")), "left_anti")


def pixel_diff(old: DataFrame, new: DataFrame, masks: DataFrame | None = None, threshold: int = 16, most_pct: float = 0.1) -> DataFrame:
    """Share of pixels with a channel that moved by more than the threshold; a pixel of one side only has changed."""
    both = paired(old, new)
    both = outside(both, masks) if masks is not None else both
    changed = F.coalesce(F.greatest(*channel_gaps()) > threshold, F.lit(True))
    out = both.groupBy("image").agg(F.count("*").alias("pixels"), F.count_if(changed).alias("changed"))
    pct = round_to(F.col("changed") / F.col("pixels") * 100.0, 3)
    return out.withColumn("changed_pct", pct).withColumn("passed", F.col("changed_pct") <= most_pct)


def changed_mask(old: DataFrame, new: DataFrame, least_sum: int = 78, least_max: int = 26) -> DataFrame:
    gaps = channel_gaps()
    return paired(old, new).filter((sum(gaps[1:], gaps[0]) >= least_sum) & (F.greatest(*gaps) >= least_max)).select("image", "x", "y")


PART = "image {image}, label struct<ty: long, tx: long, k: int>, x0 int, y0 int, x1 int, y1 int, pixels long, border array<struct<x: int, y: int>>"


def label_tile(tile: int):
    """The 4-connected parts of one tile: box, pixels, and their pixels on the tile's border. Runs, not pixels, are joined."""

    def solve(table: pa.Table) -> pa.Table:
        tx, ty = table.column("tx")[0].as_py(), table.column("ty")[0].as_py()
        grid = np.zeros((tile, tile + 2), np.int8)
        grid[table.column("y").to_numpy() - ty * tile, table.column("x").to_numpy() - tx * tile + 1] = 1
        step = np.diff(grid, axis=1)
        row, start = np.nonzero(step == 1)
        end = np.nonzero(step == -1)[1] - 1
        parent = list(range(len(row)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        first = np.searchsorted(row, np.arange(tile + 1))
        for i in range(len(row)):  # the runs above that overlap this one are neighbours of each other
            above = slice(first[row[i] - 1], first[row[i]]) if row[i] else slice(0, 0)
            low = above.start + int(np.searchsorted(end[above], start[i]))
            high = above.start + int(np.searchsorted(start[above], end[i], "right"))
            for j in range(low, high):
                parent[root(j)] = root(i)
        names, label = np.unique([root(i) for i in range(len(row))], return_inverse=True)
        n = len(names)
        out = {"x0": np.full(n, tile), "y0": np.full(n, tile), "x1": np.full(n, -1), "y1": np.full(n, -1), "pixels": np.zeros(n, np.int64)}
        for name, values, f in (("x0", start, np.minimum), ("y0", row, np.minimum), ("x1", end, np.maximum), ("y1", row, np.maximum), ("pixels", end - start + 1, np.add)):
            f.at(out[name], label, values)
        border: list[list[dict]] = [[] for _ in range(n)]
        for k, y, x0, x1 in zip(label.tolist(), row.tolist(), start.tolist(), end.tolist()):
            xs = range(x0, x1 + 1) if y in (0, tile - 1) else {x for x in (x0, x1) if x in (0, tile - 1)}
            border[k] += [{"x": x + tx * tile, "y": y + ty * tile} for x in xs]
        labels = pa.array([{"ty": ty, "tx": tx, "k": k} for k in range(n)], pa.struct([("ty", pa.int64()), ("tx", pa.int64()), ("k", pa.int32())]))
        shift = {"x0": tx, "x1": tx, "y0": ty, "y1": ty}
        boxes = {c: pa.array((v + shift[c] * tile).astype(np.int32)) if c in shift else pa.array(v) for c, v in out.items()}
        image = table.column("image").combine_chunks().take(pa.array(np.zeros(n, np.int64)))
        return pa.table({"image": image, "label": labels, **boxes, "border": pa.array(border, pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))})

    return solve


def components(mask: DataFrame, least: int = 36, tile: int = TILE) -> DataFrame:
    """Boxes of 4-connected pixels (image, x0, y0, x1, y1, pixels), of at least `least` pixels.

    Tiles of `tile` x `tile` pixels are labelled each in its task; where two tiles meet, pixels side by side join their
    labels, and the joined labels find their common one by rounds over all tasks. So an image of any size is spread,
    and no task holds more than a tile. A pixel given twice is one.
    """
    at = lambda c: F.floor(F.col(c) / tile)
    pixels = mask.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).withColumns({"tx": at("x"), "ty": at("y")})
    parts = saved(pixels.groupBy("image", "tx", "ty").applyInArrow(label_tile(tile), PART.format(image=mask.schema["image"].dataType.simpleString())))
    node = F.struct("image", "label").alias("node")
    border = parts.select(node, F.explode("border").alias("p")).select("node", F.col("node.image").alias("image"), "p.x", "p.y")
    last = lambda c: F.pmod(F.col(c), F.lit(tile)) == tile - 1
    right = border.filter(last("x")).select("image", (F.col("x") + 1).alias("x"), "y", F.col("node").alias("a"))
    below = border.filter(last("y")).select("image", "x", (F.col("y") + 1).alias("y"), F.col("node").alias("a"))
    links = right.unionByName(below).join(border.withColumnRenamed("node", "b"), ["image", "x", "y"]).select("a", "b").distinct()
    joined = connected(links)
    whole = parts.drop("border").withColumn("node", node).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    out = whole.groupBy("component").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("pixels").alias("pixels"))
    return out.filter(F.col("pixels") >= least).select("component.image", "x0", "y0", "x1", "y1", "pixels")


def region_rank(regions: DataFrame, top: int = 8) -> DataFrame:
    """The largest regions of each image."""
    from pyspark.sql import Window

    area = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    w = Window.partitionBy("image").orderBy(F.desc("area"), F.desc("pixels"), "y0", "x0")
    return regions.withColumn("area", area).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
