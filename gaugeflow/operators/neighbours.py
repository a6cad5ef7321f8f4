"""Row windows over long series without one task per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.columns import need
from gaugeflow.session import materialize

#: Rows of a tile: what one window holds at most, besides its neighbours.
TILE_ROWS = 8192


def in_order(rows: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """(key, at, values, place): rows, unique by (key, at), with their place from 0 in the order of both over all keys.

    Sorted by range partitions and written once; the number of rows before each partition makes places of them. However
    many rows a key or a time has, they are split evenly. Rows with a null key or place are left out.
    """
    r = need(rows, key, at, *values).filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    r = r.repartitionByRange(key, at).sortWithinPartitions(key, at).withColumn("_id", F.monotonically_increasing_id())
    r = materialize(r, "ordered").withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = r.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("_part", before.alias("_before"))  # a row a partition
    return r.join(F.broadcast(base), "_part").select(key, at, *values, (F.col("_before") + F.col("_at")).alias("place"))


def with_neighbours(rows: DataFrame, key: str, at: str, values: list[str], reach: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """rows (key, at, values), unique by (key, at), with tile and is_core.

    A tile is tile_rows rows in the order of (key, at). Each tile also gets copies, not is_core, of the `reach` rows right
    before and right after it. Rows are placed by (tile, key), and windows partitioned by these are then exact for core rows as far as they look at most
    `reach` rows away; no window holds more than a tile and its neighbours, whatever the density of a series.
    """
    if tile_rows < reach:
        raise ValueError("a tile must have as many rows as a window reaches")
    tile, place = F.call_function("div", F.col("place"), F.lit(tile_rows)), F.pmod("place", F.lit(tile_rows))
    copies = F.when(place < reach, F.array(tile, tile - 1)).when(place >= tile_rows - reach, F.array(tile, tile + 1)).otherwise(F.array(tile))
    if tile_rows < 2 * reach:  # a row may be near both ends
        copies = F.array_distinct(F.array(tile, F.when(place < reach, tile - 1).otherwise(tile), F.when(place >= tile_rows - reach, tile + 1).otherwise(tile)))
    near = in_order(rows, key, at, values).withColumn("tile", F.explode(copies))
    near = near.withColumn("is_core", F.col("tile") == tile).drop("place")
    # a given number: windows cost more than their bytes, which is all that adaptive execution would see in joining partitions
    return near.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile", key)
