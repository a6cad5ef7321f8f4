"""Queries p6 to p8 over the tables of a directory, and SQL for what it can judge of them.

SQL can express no tokenizer, alignment or look-alike, so the pairs and leaks themselves are held against brute force in the
tests. Of the selection, shares, cleaned and consistent documents it checks what must hold whatever those say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.confusables import confusables, consistent_findings, same_looking_classes, same_looking_pairs
from gaugeflow.llm.leakage import leaked_passages, without_leaks
from gaugeflow.llm.mixing import mix_sources, plan_shares
from gaugeflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage, with the items leaked."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked stretch: its words and edits, and where it stands."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents, with the leaked spans cut out."""
    return without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Of the leaks found, those whose passage stands in the text character by character."""
    documents, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    found = leaked_passages(documents, items).select("doc_id", "item_id").distinct()
    pairs = found.join(documents.select("doc_id", "text"), "doc_id").join(items.select("item_id", "passage"), "item_id")
    return pairs.filter(F.expr("contains(text, passage)")).select("doc_id", "item_id")


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture and how often each comes."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The mixture by characters: what each source has, its budget, and whether the selection is short of that by less
    than one record and not over it."""
    documents = table(spark, d, "documents")
    targets = table(spark, d, "mix_targets")
    size = F.length("text")
    report = mix_sources(documents, targets, size=size)[1]
    longest = {r["source"]: r["n"] for r in documents.groupBy("source").agg(F.max(size).alias("n")).join(targets.select("source").distinct(), "source").collect()}  # a row a target
    got = report.collect()  # a row a target
    plan = {s.source: s for s in plan_shares({r["source"]: (r["target_share"], r["max_repeats"]) for r in got}, {r["source"]: r["available_tokens"] for r in got})}
    rows = []
    for r in got:
        s = plan[r["source"]]
        budget = s.epochs * s.available + s.rest
        rows.append((r["source"], r["max_repeats"], r["available_tokens"], budget, budget - (longest.get(r["source"]) or 0) < r["selected_tokens"] <= budget or budget == r["selected_tokens"]))
    return spark.createDataFrame(rows, "source string, max_repeats int, available bigint, budget bigint, kept boolean")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose texts look the same and differ in characters."""
    return same_looking_pairs(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that another looks like in other characters: class and number of links, a row each."""
    return same_looking_classes(table(spark, d, "documents"))


def p8_consistent_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents in consistent characters, and how many tokens were mixed or wholly of another script."""
    t = table(spark, d, "documents").select("doc_id", consistent_findings("text", confusables(spark)).alias("found"))
    return t.select("doc_id", "found.text", "found.mixed", "found.whole")


def p8_plain_documents(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of texts of plain characters only: theirs, but for line breaks and tabs."""
    return p8_consistent_documents(spark, d).join(table(spark, d, "documents").filter(F.col("text").rlike(PLAIN)).select("doc_id"), "doc_id").select("doc_id", F.md5("text").alias("form"), "mixed", "whole")


#: Texts of ASCII, composed letters of Latin-1 and a few signs, none of which looks like another.
PLAIN = "^[\\x00-\\x7FÀ-ÖØ-öø-ÿ°²½©–’]*$"
QUERIES: dict[str, Query] = {f.__name__: f for f in (p6_found, p6_leaks, p6_verbatim, p6_clean_documents, p7_selection, p7_shares, p7_budgets, p8_found, p8_plain_documents, p8_classes, p8_consistent_documents)}
SQL: dict[str, str] = {
    "p6_verbatim": "SELECT DISTINCT doc_id, item_id FROM documents, eval_items WHERE contains(text, passage)",
    "p7_budgets": """WITH held AS (
  SELECT t.source, max_repeats, round(target_share * 1000000000)::HUGEINT AS w, coalesce(sum(length(text)), 0)::HUGEINT AS available FROM mix_targets t LEFT JOIN documents d ON d.source = t.source AND d.doc_id IS NOT NULL GROUP BY ALL
), usable AS (SELECT *, sum(w) OVER () AS all_w FROM held WHERE available > 0 AND w > 0 AND max_repeats > 0
), whole AS (SELECT min((max_repeats * available * all_w)::HUGEINT // w) AS total FROM usable)
SELECT h.source, h.max_repeats, h.available::BIGINT AS available, coalesce(least((u.w * total)::HUGEINT // u.all_w::HUGEINT, h.max_repeats * h.available), 0)::BIGINT AS budget, TRUE AS kept
FROM held h CROSS JOIN whole LEFT JOIN usable u USING (source)""",
    "p8_plain_documents": """SELECT doc_id, md5(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' ')) AS form, 0::INT AS mixed, 0::INT AS whole
FROM documents WHERE regexp_full_match(text, '(?s)[\\x00-\\x7FÀ-ÖØ-öø-ÿ°²½©–’]*')""",
}
