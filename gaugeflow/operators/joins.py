"""Lookups of a small table by a large one that hold up when the small one isn't small or one key holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table is sent whole to every executor only if it is measured to be below this.
BROADCAST_BYTES = 16 << 20
SALTS = 16


def measured_bytes(df: DataFrame) -> int:
    """Rough size of df in memory: 16 bytes a value and the texts' lengths; arrays with 32 bytes an element."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    arrays = [F.coalesce(F.size(c), F.lit(0)) * 32 for c, t in df.dtypes if t.startswith("array")]
    width = sum(texts + arrays, F.lit(16 * len(df.columns)))
    return df.agg(F.sum(width).alias("b")).first()["b"] or 0


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """big joined (inner, left, left_semi or left_anti) with small on equal, non-null keys.

    small is broadcast if its measured size is within max_bytes. Else both sides are shuffled, big's rows of one key
    spread over `salts` partitions and small repeated as often, so that a key with a third of big's rows isn't one task.
    Null keys match nothing. Columns other than the keys must differ in name.
    """
    clash = (set(big.columns) & set(small.columns)) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    if measured_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")
