"""Registered queries of the persisted search index, over the documents in two writes, with deletions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.search_index import SearchIndex
from .queries import Inputs, query
from .session import shared_folder

# What is live: documents of one language are written first, all others then with those of one source again; documents of another source are deleted.
_PATH = "concat(source, '/', lang, '.md')"
_TOKENS = "regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([\\p{{Ll}}])([\\p{{Lu}}])', '\\1 \\2', 'g'), '([\\p{{Lu}}])([\\p{{Lu}}][\\p{{Ll}}])', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+')"
_LIVE = f"""live AS (SELECT doc_id AS doc, coalesce(text, '') AS content, coalesce({_PATH}, '') AS path FROM documents WHERE doc_id IS NOT NULL AND coalesce(source, '') <> 'src3'),
tk AS (SELECT * FROM (SELECT 'content' AS field, doc, unnest({_TOKENS.format("content")}) AS term FROM live UNION ALL SELECT 'path', doc, unnest({_TOKENS.format("path")}) FROM live) z WHERE term <> ''),
dl AS (SELECT f.field, l.doc, count(term) AS l FROM live l CROSS JOIN (SELECT unnest(['content', 'path']) AS field) f LEFT JOIN tk ON tk.doc = l.doc AND tk.field = f.field GROUP BY 1, 2),
st AS (SELECT field, count(*) AS n, avg(l) AS m FROM dl GROUP BY 1)"""
_BM25 = """tf AS (SELECT field, doc, term, count(*) AS tf FROM tk WHERE term IN ({0}) GROUP BY 1, 2, 3), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1, 2),
sc AS (SELECT tf.doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) AS score FROM tf JOIN df USING (field, term) JOIN dl USING (field, doc) JOIN st USING (field) GROUP BY 1)"""


def _built(t: Inputs, **tables: bool) -> SearchIndex:
    """tables: which ones of an index are asked."""
    docs = t.table("documents").select("doc_id", "text", "lang", "source", F.expr(_PATH).alias("path"))
    index = SearchIndex.create(t.spark, f"{shared_folder(t.spark)}/skarn-index-{uuid.uuid4().hex}", buckets=8, **tables)
    first = F.coalesce(F.col("lang") == "en", F.lit(False))
    index.add(docs.where(first).withColumn("text", F.concat(F.lit("old version "), F.coalesce("text", F.lit("")))), path="path")
    index.add(docs, path="path")
    index.delete(docs.where("source = 'src3'"))
    return index


@query("x6_index_ranked", f"WITH {_LIVE}, {_BM25.format("'license', 'apache', 'web', 'version'")} SELECT doc, path, round(score, 5) AS score, CAST(len(string_split(content, chr(10))) - CASE WHEN content = '' OR content LIKE ('%' || chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_count FROM sc JOIN live USING (doc) ORDER BY round(score, 9) DESC, doc LIMIT 10")
def _(t: Inputs) -> DataFrame:
    return _built(t, neighbourhoods=False, trigrams=False).search("Apache license web version").select("doc", "path", F.round("score", 5).alias("score"), "line_count")


@query("x7_index_fuzzy", f"WITH {_LIVE} SELECT term, damerau_levenshtein(term, 'lciense') AS distance, count(DISTINCT doc) AS docs FROM tk WHERE field = 'content' AND damerau_levenshtein(term, 'lciense') <= 2 GROUP BY 1, 2")
def _(t: Inputs) -> DataFrame:
    found = _built(t, trigrams=False).fuzzy("lciense", None)
    return found.groupBy("term", F.col("distance").cast("long").alias("distance")).agg(F.count_distinct("doc").alias("docs"))


_LINES = "ln AS (SELECT doc, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM live)"


@query("x9_index_regex", f"WITH {_LIVE}, {_LINES} SELECT doc, i AS line, trim(l) AS content FROM ln WHERE strlen(l) <= 1000 AND regexp_matches(l, '[Ll]icensed under (the|CC)')")
def _(t: Inputs) -> DataFrame:
    return _built(t, words=False).regex("[Ll]icensed under (the|CC)", longest_line=1000).select("doc", F.col("line").cast("long").alias("line"), "content")
