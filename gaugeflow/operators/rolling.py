"""Totals and means over trailing days, days without activity included.

Entities and days are packed into numpy blocks: a row is one entity in one time tile, a column a day of the tile or of
the halo of days before it. A block times a banded 0/1 operator gives all trailing totals of all its days at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import DAY_US, finite, need, steps_of

#: Days of a tile and entities of a block: with 30 days, a block of doubles has 256 x 157 cells, under half a MB.
TILE_DAYS = 128
BLOCK_ENTITIES = 256


def band(halo: int, tile: int, days: int) -> np.ndarray:
    """(halo + tile, tile) operator that sums the `days` days ending with each day of the tile."""
    source, target = np.arange(halo + tile)[:, None], np.arange(tile)[None, :] + halo
    return ((source <= target) & (source > target - days)).astype(float)


def _trailing_sums(block: np.ndarray, op: np.ndarray) -> np.ndarray:
    """block @ op, where an overflowed (infinite) or undefined (NaN) day counts in its own windows only."""
    wild = ~np.isfinite(block)
    if not wild.any():
        return block @ op
    out = np.where(wild, 0.0, block) @ op
    up, down = (block == np.inf) @ op > 0, (block == -np.inf) @ op > 0
    out[up], out[down] = np.inf, -np.inf
    out[(up & down) | (np.isnan(block) @ op > 0)] = np.nan
    return out


def rolling_totals(daily: DataFrame, periods: DataFrame, windows: tuple[int, ...] = (7, 30), tile_days: int = TILE_DAYS, block_entities: int = BLOCK_ENTITIES) -> DataFrame:
    """(entity, day, n_day, and for each window w: n_w, total_w, mean_w) for every day of the entity's periods.

    daily: (entity, day INT since 1970, n BIGINT, total DOUBLE), any number of rows a day. periods: (entity, first_day
    INT, last_day INT, inclusive); they may overlap, every day comes once. Activity outside the periods counts in the
    windows that reach it. n counts activity; mean is total/n, null without activity. Entities without period give no
    row, periods without activity give zeros. Null entities and days are left out; null n and
    total count as 0; a NaN total (or infinities of both signs) makes total and mean of the windows that hold its day null, and no others.

    One shuffle of partly aggregated days by (entity, tile); a hot entity spreads over its tiles.
    """
    halo = max(windows) - 1
    if halo > tile_days:
        raise ValueError("a tile must be as long as the longest window, less a day")
    d = need(daily, "entity", "day", "n", "total").filter("entity IS NOT NULL AND day IS NOT NULL")
    tile = steps_of(F.col("day").cast("bigint"), tile_days)
    day_tiles = F.array_distinct(F.array(tile, steps_of(F.col("day").cast("bigint") + halo, tile_days)))
    facts = d.withColumn("tile", F.explode(day_tiles)).select("entity", "tile", (F.col("day") - F.col("tile") * tile_days).cast("int").alias("at"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), F.lit(None).cast("int").alias("until"))
    facts = facts.groupBy("entity", "tile", "at", "until").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    p = need(periods, "entity", "first_day", "last_day").filter("entity IS NOT NULL AND first_day <= last_day").distinct()
    first, last = F.col("first_day").cast("bigint"), F.col("last_day").cast("bigint")
    spans = p.withColumn("tile", F.explode(F.sequence(steps_of(first, tile_days), steps_of(last, tile_days))))
    spans = spans.select("entity", "tile", F.greatest(first - F.col("tile") * tile_days, F.lit(0)).cast("int").alias("at"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("total"), F.least(last - F.col("tile") * tile_days, F.lit(tile_days - 1)).cast("int").alias("until"))
    columns = ["entity", "tile", "at", "until", "n", "total"]
    rows = facts.select(columns).unionByName(spans.select(columns)).repartition("entity", "tile").sortWithinPartitions("entity", "tile")
    kind = dict(daily.dtypes)["entity"]
    schema = f"entity {kind}, day int, n_day bigint" + "".join(f", n_{w} bigint, total_{w} double, mean_{w} double" for w in windows)
    ops = [band(halo, tile_days, w) for w in windows]

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if frame.empty:
                rest = None
                continue
            new = (frame["entity"].to_numpy()[1:] != frame["entity"].to_numpy()[:-1]) | (frame["tile"].to_numpy()[1:] != frame["tile"].to_numpy()[:-1])
            starts = np.r_[0, np.flatnonzero(new) + 1]
            rest = frame.iloc[starts[-1] :]  # it may go on in the next batch
            yield from packed(frame, starts)
        if rest is not None and len(rest):
            yield from packed(rest, np.array([0, len(rest)]))

    def packed(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(starts) - 1, block_entities):
            edges = starts[lo : lo + block_entities + 1]
            part = frame.iloc[edges[0] : edges[-1]]
            e = len(edges) - 1
            row = np.repeat(np.arange(e), np.diff(edges))
            at, until = part["at"].to_numpy(), part["until"].to_numpy(float)
            span = ~np.isnan(until)
            n, total = np.zeros((e, halo + tile_days)), np.zeros((e, halo + tile_days))
            np.add.at(n, (row[~span], at[~span] + halo), part["n"].to_numpy()[~span])
            np.add.at(total, (row[~span], at[~span] + halo), part["total"].to_numpy()[~span])
            edge = np.zeros((e, tile_days + 1))
            np.add.at(edge, (row[span], at[span]), 1)
            np.add.at(edge, (row[span], until[span].astype(int) + 1), -1)
            r, c = np.nonzero(edge.cumsum(axis=1)[:, :-1] > 0)
            if not len(r):
                continue
            heads = part.iloc[edges[:-1] - edges[0]]
            out = {"entity": heads["entity"].to_numpy()[r], "day": (heads["tile"].to_numpy()[r] * tile_days + c).astype("int32"), "n_day": n[r, c + halo].astype("int64")}
            for w, op in zip(windows, ops):
                nw, tw = (n @ op)[r, c], _trailing_sums(total, op)[r, c]
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = np.where(nw > 0, tw / nw, np.nan)
                out |= {f"n_{w}": nw.astype("int64"), f"total_{w}": tw, f"mean_{w}": mean}
            yield pd.DataFrame(out)

    out = rows.mapInPandas(blocks, schema)
    return out.select("entity", "day", "n_day", *[c for w in windows for c in (f"n_{w}", f"total_{w}", F.when(F.col(f"n_{w}") > 0, F.col(f"mean_{w}")).alias(f"mean_{w}"))])


def station_rolling_totals(readings: DataFrame, periods: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """rolling_totals of usable readings (station_ref, us, value) over the UTC days that deployments (station_ref,
    starts_us, ends_us exclusive) touch; columns as there, with station_ref for entity."""
    r = need(readings, "station_ref", "us", "value").select("station_ref", "us", finite("value").alias("value")).filter("value IS NOT NULL AND us IS NOT NULL")
    day = steps_of(F.col("us"), DAY_US).cast("int")
    daily = r.groupBy(F.col("station_ref").alias("entity"), day.alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    p = need(periods, "station_ref", "starts_us", "ends_us").filter("starts_us < ends_us")
    p = p.select(F.col("station_ref").alias("entity"), steps_of(F.col("starts_us"), DAY_US).cast("int").alias("first_day"), steps_of(F.col("ends_us") - 1, DAY_US).cast("int").alias("last_day"))
    return rolling_totals(daily, p, windows).withColumnRenamed("entity", "station_ref")
