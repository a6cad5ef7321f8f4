"""A selection in which each source has its target share of all tokens, small sources repeated up to a cap.

Records get hash-random keys. The tokens of a source are summed by the key's leading bits; prefix sums over these few
buckets tell for every bucket but one whether it lies within the source's budget, and only that one bucket is sorted by
key and summed record by record. Repetition is by whole epochs, the last one cut.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from fractions import Fraction
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.columns import need
from gaugeflow.operators.joins import lookup_join
from gaugeflow.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern by which this vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Leading bits of the keys: 4096 buckets a source, so that the sorted bucket holds 1/4096 of a source's records.
BUCKET_BITS = 12
#: Sources that targets may name: their totals are planned on the driver.
MOST_SOURCES = 10_000


@cache
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | Column, tokenizer: str = TOKENIZER) -> Column:
    """Column function: tokens of a text by the tokenizer's rank file, the whole text read; null has null."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(tokenizer).encode_ordinary
        return texts.map(lambda t: len(encode(t)), na_action="ignore").astype("Int64")

    return count(text)


@dataclass(frozen=True)
class Share:
    """What one source is to give: whole epochs, and a cut one of so many tokens."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    epochs: int
    rest: int


def plan_shares(targets: dict[str, tuple[float, int]], available: dict[str, int], total: int | None = None) -> list[Share]:
    """Budgets by source. targets: source to (share, most repeats); available: source to tokens.

    Shares count among the sources that have tokens and may be used at least once; the others give nothing. Without a
    total, it is the largest for which every such source reaches its share. With one, a source that can't reach its share
    gives all it may. Exact integers, no rounding of large sums; a share is the decimal number it is written as.
    """
    usable = {s: (Fraction(str(w)), r) for s, (w, r) in targets.items() if w > 0 and r > 0 and available.get(s, 0) > 0}
    weight = sum(w for w, _ in usable.values())
    if total is None and usable:
        total = min(r * available[s] * weight / w for s, (w, r) in usable.items()).__floor__()
    out = []
    for s, (w, r) in targets.items():
        have, epochs, rest = available.get(s, 0), 0, 0
        if s in usable:
            budget = min((usable[s][0] / weight * total).__floor__(), r * have)
            epochs, rest = divmod(budget, have)
        out.append(Share(s, w, r, have, epochs, rest))
    return out


def mix_sources(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, size: Column | None = None, bucket_bits: int = BUCKET_BITS) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of records (doc_id, text, source) by targets (source, target_share, max_repeats).

    selection: (doc_id, source, n_tokens, copies), copies from 1 to the source's max_repeats. report: (source,
    target_share, max_repeats, available_tokens, selected_tokens, actual_share), a row for each target; actual_share is
    of all selected tokens, null if there are none. A source's selected tokens are at most one record short of its
    budget, see plan_shares, and never over it. size: tokens of a record, token_count('text') by default.

    Records without id, source or size, of no target, or of zero tokens are left out; a target without source, share or
    repeats is none; of a source named twice the larger share stands. The same seed gives the same selection.
    """
    spark = records.sparkSession
    goals = need(targets, "source", "target_share", "max_repeats").dropna().groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.target_share", "t.max_repeats")
    named = {r["source"]: (r["target_share"], r["max_repeats"]) for r in goals.limit(MOST_SOURCES + 1).collect()}
    if len(named) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = lookup_join(need(records, "doc_id", "text", "source").filter("doc_id IS NOT NULL AND source IS NOT NULL"), goals.select("source"), ["source"], "left_semi")
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)
    rows = rows.select("doc_id", "source", (token_count("text") if size is None else size).cast("bigint").alias("n_tokens"), key.alias("key")).filter("n_tokens > 0")
    rows = materialize(rows, "tokens").withColumn("bucket", F.shiftright("key", 63 - bucket_bits).cast("int"))

    sums = materialize(rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")), "buckets")
    available = {r["source"]: int(r["tokens"]) for r in sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    shares = plan_shares(named, available, total)
    plan = spark.createDataFrame([(s.source, s.epochs, s.rest) for s in shares], "source string, epochs bigint, rest bigint")

    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    marked = sums.withColumn("upto", upto).join(F.broadcast(plan), "source")  # a row a target
    marked = marked.select("source", "bucket", "epochs", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"), (F.col("upto") <= F.col("rest")).alias("within"))
    marked = marked.filter("epochs > 0 OR room > 0")
    placed = lookup_join(rows, marked, ["source", "bucket"])
    whole = placed.filter("within OR room <= 0").withColumn("in_cut", F.col("within"))
    so_far = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = placed.filter("NOT within AND room > 0").withColumn("in_cut", so_far <= F.col("room"))
    picked = whole.unionByName(cut).withColumn("copies", F.col("epochs") + F.col("in_cut").cast("int")).filter("copies > 0")
    selection = picked.select("doc_id", "source", "n_tokens", F.col("copies").cast("int").alias("copies"))

    stated = spark.createDataFrame([(s.source, float(s.target_share), int(s.max_repeats), s.available) for s in shares], "source string, target_share double, max_repeats int, available_tokens bigint")
    got = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("selected_tokens"))
    report = stated.join(got, "source", "left").withColumn("selected_tokens", F.coalesce("selected_tokens", F.lit(0)))
    everything = F.sum("selected_tokens").over(Window.partitionBy())  # over a row a target
    return selection, report.withColumn("actual_share", F.when(everything > 0, F.col("selected_tokens") / everything))
