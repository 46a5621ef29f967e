"""Registered queries of many patterns in many texts, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.many_patterns import find_patterns, symbol_dependencies
from .queries import Inputs, query

_WORDS = "w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark)"


@query("c25_symbol_dependencies", f"WITH {_WORDS}, d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')) AS word FROM documents), i AS (SELECT doc_id, word FROM documents, (SELECT DISTINCT word FROM w) z WHERE contains('crate/' || source, word)) SELECT DISTINCT concat('sib', item_id % 9) AS sibling, concat('doc', doc_id) AS local_symbol, word AS remote_symbol FROM (SELECT * FROM d UNION SELECT * FROM i) u JOIN w USING (word) WHERE length(word) > 3")
def _(t: Inputs) -> DataFrame:
    docs = t.table("documents")
    files = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"), F.array(F.concat(F.lit("crate/"), "source")).alias("imports"), F.array().cast("array<string>").alias("exports"))
    words = t.table("benchmark").select(F.concat(F.lit("sib"), F.col("item_id") % 9).alias("sibling"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("symbol"))
    return symbol_dependencies(files, docs.select(F.col("doc_id").alias("path"), F.concat(F.lit("doc"), "doc_id").alias("symbol_name")), words.where(F.char_length("symbol") > 3))


@query("j24_line_patterns", "WITH l AS (SELECT item_id, unnest(string_split(text, '. ')) AS sentence FROM benchmark) SELECT DISTINCT doc_id, item_id, sentence FROM documents JOIN (SELECT DISTINCT * FROM l WHERE sentence <> '') z ON contains(text, sentence)")
def _(t: Inputs) -> DataFrame:
    sentences = t.table("benchmark").select("item_id", F.explode(F.split("text", r"\. ")).alias("sentence")).distinct()
    return find_patterns(t.table("documents").select("doc_id", "text"), sentences, "doc_id", "text", "sentence").select("doc_id", "item_id", "sentence").distinct()
