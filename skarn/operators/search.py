"""Text search over an inverted index that is a set of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_tokens, jaccard, pattern_trigrams, trigrams, words

K1, B = 1.2, 0.75


@dataclass
class Index:
    """docs(doc, path, content, length), postings(term, doc, tf), grams(gram, doc); write the three to keep an index. source(doc, text): what an index was built from that
    nobody keeps; it is asked in one pass over the texts, with the same answers, instead of making all their postings or grams for each question."""

    docs: DataFrame
    postings: DataFrame
    grams: DataFrame
    source: DataFrame | None = None

    @classmethod
    def build(cls, rows: DataFrame, doc: str = "doc_id", content: str = "text", path: str | None = None) -> Index:
        text = F.coalesce(F.col(content), F.lit("")) if path is None else F.concat_ws("\n", F.col(path), F.col(content))
        docs = rows.select(F.col(doc).alias("doc"), (F.col(path) if path else F.lit(None).cast("string")).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"), F.size(code_tokens(text)).cast("long").alias("length"))
        source = rows.select(F.col(doc).alias("doc"), text.alias("text"))
        postings = source.select("doc", F.explode(code_tokens(F.col("text"))).alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))
        grams = source.select("doc", F.explode(trigrams(F.lower("text"))).alias("gram"))
        return cls(docs, postings, grams, source)

    def bm25(self, query: str, limit: int | None = 10, prefilter: bool = False) -> DataFrame:
        """(doc, score) of documents that hold any query term; ties by doc. prefilter: only documents with all trigrams of the query."""
        terms = _query_tokens(query)
        if self.source is not None:
            return self._bm25_pass(sorted(set(terms)), query, limit, prefilter)
        stats = self.docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
        hits = self.postings.where(F.col("term").isin(terms))
        if prefilter and query.isalnum() and len(query) >= 3:
            hits = hits.join(self.candidates([query.lower()[i : i + 3] for i in range(len(query) - 2)]), "doc", "left_semi")
        frequency = self.postings.where(F.col("term").isin(terms)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        scored = hits.join(F.broadcast(frequency), "term").join(self.docs.select("doc", "length"), "doc").crossJoin(F.broadcast(stats))
        idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf").cast("double")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        out = scored.groupBy("doc").agg(F.sum(part).alias("score")).orderBy(F.desc(F.round("score", 9)), "doc")
        return out if limit is None else out.limit(limit)

    def _bm25_pass(self, terms: list[str], query: str, limit: int | None, prefilter: bool) -> DataFrame:
        """:meth:`bm25` of the source: texts are tokenised once and go as counts to their documents, which give the statistics and the scores."""
        tf = [f"tf{i}" for i in range(len(terms))]
        each = _counted(self.source, "doc", F.col("text"), terms).groupBy("doc").agg(F.collect_list("length").alias("lengths"), *[F.sum(c).alias(c) for c in tf])
        lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
        stats = each.agg(F.sum(F.size("lengths")).alias("n"), F.sum(lengths).alias("all"), *[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in tf])
        stats = stats.select("n", (F.col("all").cast("double") / F.col("n")).alias("mean"), *[f"d{c}" for c in tf])
        # A condition on the id alone would move below the grouping and part what both sides share.
        found = reduce(lambda a, c: a | (F.when(F.col("doc").isNull(), 0).otherwise(F.col(c)) > 0), tf, F.lit(False))
        hits = each.where(found)
        if prefilter and query.isalnum() and len(query) >= 3:
            hits = hits.join(self.candidates([query.lower()[i : i + 3] for i in range(len(query) - 2)]), "doc", "left_semi")
        one = lambda n: reduce(lambda a, c: a + F.coalesce(_bm25_part(F.col(c), F.col(f"d{c}"), n), F.lit(0.0)), tf, F.lit(0.0))
        score = F.aggregate("lengths", F.lit(0.0), lambda a, n: a + one(n))
        out = hits.crossJoin(F.broadcast(stats)).select("doc", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "doc")  # one row
        return out if limit is None else out.limit(limit)

    def all_terms(self, query: str) -> DataFrame:
        """(doc): documents that hold every query term."""
        terms = sorted(set(_query_tokens(query)))
        return self.postings.where(F.col("term").isin(terms)).groupBy("doc").agg(F.count_distinct("term").alias("_n")).where(F.col("_n") == len(terms)).select("doc")

    def candidates(self, grams: list[str]) -> DataFrame:
        """(doc): documents that hold all trigrams; all documents if there are none to ask for."""
        wanted = sorted(set(grams))
        if not wanted:
            return self.docs.select("doc")
        if self.source is not None and all(len(g) == 3 for g in wanted):
            held = self.source.select("doc", *[F.lower("text").contains(g).alias(f"g{i}") for i, g in enumerate(wanted)])
            held = held.where(reduce(lambda a, i: a | F.col(f"g{i}"), range(len(wanted)), F.lit(False)))
            by_doc = held.groupBy("doc").agg(*[F.max(f"g{i}").alias(f"g{i}") for i in range(len(wanted))])
            return by_doc.where(reduce(lambda a, i: a & F.col(f"g{i}"), range(len(wanted)), F.lit(True))).select("doc")
        return self.grams.where(F.col("gram").isin(wanted)).groupBy("doc").agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(wanted)).select("doc")

    def regex(self, pattern: str, limit: int | None = None, longest_line: int = 1000) -> DataFrame:
        """(doc, line, content): trimmed lines that match; lines of more bytes than ``longest_line`` are skipped, as the feature is defined."""
        if self.source is not None:
            return regex_scan(self.docs.where(F.col("doc").isNotNull()), pattern, limit, "doc", "content", longest_line)
        docs = self.docs.join(self.candidates(pattern_trigrams(pattern)), "doc", "left_semi")
        return _matching_lines(docs.select("doc", "content"), pattern, limit, longest_line)

    def fuzzy(self, term: str, distance: int = 2, limit: int | None = 10) -> DataFrame:
        """(doc, term, distance): terms within an edit distance, nearest first; a transposition is two edits."""
        vocabulary = self.postings.select("term").distinct().withColumn("distance", F.levenshtein("term", F.lit(term.lower()), distance)).where("distance >= 0")
        out = self.postings.join(vocabulary, "term").select("doc", "term", "distance").orderBy("distance", "term", "doc")
        return out if limit is None else out.limit(limit)

    def hybrid(self, query: str, pattern: str, limit: int = 10) -> DataFrame:
        """(doc, line): ranked hits first, then regex hits; the first of a (doc, line) stays."""
        ranked = self.bm25(query, limit).select("doc", F.lit(1).alias("line"), F.lit(0).alias("kind"))
        matched = self.regex(pattern, limit).select("doc", "line", F.lit(1).alias("kind"))
        return ranked.unionByName(matched).groupBy("doc", "line").agg(F.min("kind").alias("kind")).orderBy("kind", "doc", "line")


def _query_tokens(query: str) -> list[str]:
    import re

    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", " ", query))
    return [t for t in re.split(r"[^\w]+|_", spaced.lower()) if t]


def _matching_lines(docs: DataFrame, pattern: str, limit: int | None, longest_line: int | None) -> DataFrame:
    """All lines that match, or those of ``longest_line`` bytes at most."""
    lines = docs.select("doc", F.posexplode(F.split("content", r"\r?\n")).alias("p", "l"))
    short = F.lit(True) if longest_line is None else F.octet_length("l") <= longest_line
    out = lines.where(short & F.col("l").rlike(pattern)).select("doc", (F.col("p") + 1).alias("line"), F.trim("l").alias("content"))
    return out if limit is None else out.orderBy("doc", "line").limit(limit)


def regex_scan(rows: DataFrame, pattern: str, limit: int | None = None, doc: str = "doc_id", content: str = "text", longest_line: int = 1000) -> DataFrame:
    """:meth:`Index.regex` for one pattern, without an index: a single pass, in which texts without the pattern's trigrams are left out before they are split."""
    text = F.lower(F.col(content))
    held = reduce(lambda a, g: a & text.contains(g), sorted(set(pattern_trigrams(pattern))), F.lit(True))
    return _matching_lines(rows.where(held).select(F.col(doc).alias("doc"), F.coalesce(F.col(content), F.lit("")).alias("content")), pattern, limit, longest_line)


def _counted(rows: DataFrame, doc: str, text: Column, terms: list[str]) -> DataFrame:
    """``doc, length, tf0..`` of each row: its tokens, and how often each term is among them. The generator keeps the optimiser from tokenising anew for each column."""
    count = lambda ts: F.struct(F.size(ts).cast("long").alias("length"), *[(F.size(ts) - F.size(F.array_remove(ts, term))).alias(f"tf{i}") for i, term in enumerate(terms)])
    # An alias to the same name would part plans that are otherwise shared.
    return rows.select(F.col(doc) if doc == "doc" else F.col(doc).alias("doc"), F.inline(F.transform(F.array(code_tokens(text)), count)))


def _bm25_part(tf: Column, df: Column, length: Column) -> Column:
    """A term's part of a score; null where it is missing."""
    idf = F.log(F.lit(1.0) + (F.col("n") - df + 0.5) / (df + 0.5))
    return F.when(tf > 0, idf * tf.cast("double") * (K1 + 1) / (tf.cast("double") + K1 * (1 - B + B * length / F.col("mean"))))


def bm25_scan(rows: DataFrame, query: str, limit: int | None = 10, doc: str = "doc_id", content: str = "text") -> DataFrame:
    """:meth:`Index.bm25` for one query, without an index: one pass for the statistics, one for the scores of texts that hold a term; only a row of statistics is shuffled."""
    terms = sorted(set(_query_tokens(query)))
    counted = lambda df: _counted(df, doc, F.coalesce(F.col(content), F.lit("")), terms)
    stats = counted(rows).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    # A token is a piece of the lower-cased text; lower-casing depends on neighbours for a few other letters, so only ASCII terms are looked up in it.
    lower = F.lower(F.col(content))
    held = reduce(lambda a, term: a | lower.contains(term), terms, F.lit(False)) if all(map(str.isascii, terms)) else F.lit(True)
    scored = counted(rows.where(held)).crossJoin(F.broadcast(stats))  # one row
    part = lambda i: _bm25_part(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("length"))
    found = reduce(lambda a, i: a | (F.col(f"tf{i}") > 0), range(len(terms)), F.lit(False))
    score = reduce(lambda a, i: a + F.coalesce(part(i), F.lit(0.0)), range(len(terms)), F.lit(0.0))
    out = scored.where(found).select("doc", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "doc")
    return out if limit is None else out.limit(limit)


def search(index: Index, query: str, limit: int = 10) -> DataFrame:
    """Ranked search with the fuzzy fallback when it finds nothing."""
    ranked = index.bm25(query, limit)
    if not ranked.isEmpty():
        return ranked
    return index.fuzzy(query, 2, None).groupBy("doc").agg((-F.min("distance")).cast("double").alias("score")).orderBy(F.desc("score"), "doc").limit(limit)


def ledger_search(entries: DataFrame, query: str, category: str | None = None, since: Column | None = None, breaking: bool = False, limit: int = 20, offset: int = 0) -> DataFrame:
    """Entries whose entity, summary and reason hold all terms, by rank, then newest."""
    kept = entries
    if category:
        kept = kept.where(F.col("category") == category)
    if since is not None:
        kept = kept.where(F.col("committed_at") >= since)
    if breaking:
        kept = kept.where("is_breaking")
    index = Index.build(kept.select("id", F.concat_ws("\n", "entity", "summary", "reason").alias("text")), "id")
    scores = index.bm25(query, None).join(index.all_terms(query), "doc", "left_semi")
    return kept.join(scores.withColumnRenamed("doc", "id"), "id").orderBy(F.desc(F.round("score", 9)), F.desc("committed_at"), "id").offset(offset).limit(limit)


def choose_chunks(chunks: DataFrame, k: int, least: float = 0.3, duplicate: float = 0.95) -> DataFrame:
    """(id, content, similarity): greedy choice by similarity, leaving out near-repeats of what is chosen by word Jaccard.
    The order matters, so the best 3 k chunks (a bounded number) are folded in one task."""
    import pandas as pd

    best = chunks.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(3 * k)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, seen = [], []
        for row in pdf.sort_values(["similarity", "id"], ascending=[False, True]).itertuples(index=False):
            mine = set(row.content.split())
            if all(not (mine | other) or len(mine & other) / len(mine | other) <= duplicate for other in seen):
                kept.append(row)
                seen.append(mine)
            if len(kept) == k:
                break
        return pd.DataFrame(kept, columns=pdf.columns)

    return best.select("id", "content", "similarity").groupBy().applyInPandas(fold, "id long, content string, similarity double")


def greedy_budget(rows: DataFrame, budget: int, order: list[Column], cost: str = "tokens", by: list[str] | None = None) -> DataFrame:
    """The prefix in ``order`` whose costs stay within the budget (it stops at the first that does not fit)."""
    run = F.sum(cost).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_sum", run).where(F.col("_sum") <= budget).drop("_sum")


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)))


def markdown_chunks(rows: DataFrame, path: str = "file_path", text: str = "content", tokens: int = 512, overlap: int = 64, least: int = 50) -> DataFrame:
    """(file_path, chunk_index, heading, content, token_count): heading sections; short ones are dropped, long ones split at blank lines,
    else where they must be, each piece beginning with the end of the one before."""
    import pandas as pd

    def sections(body: str) -> list[tuple[str, str]]:
        out: list[tuple[str, list[str]]] = [("", [])]
        for line in body.split("\n"):
            if line.startswith("#") and line.lstrip("#")[:1] == " ":
                out.append((line.lstrip("#").strip(), []))
            else:
                out[-1][1].append(line)
        return [(h, "\n".join(ls).strip()) for h, ls in out]

    def pieces(body: str) -> list[str]:
        size, over = tokens * 4, overlap * 4
        out, at = [], 0
        while at < len(body):
            end = at + size
            if end < len(body):
                cut = max(body.rfind("\n\n", at + size // 2, end), body.rfind("\n", at + size // 2, end) if body.rfind("\n\n", at + size // 2, end) < 0 else -1, -1)
                end = cut if cut > at else end
            out.append(body[at:end].strip())
            if end >= len(body):
                break
            at = max(end - over, at + 1)
        return out

    def run(batches):
        for pdf in batches:
            found = []
            for p, body in zip(pdf[path], pdf[text], strict=True):
                index = 0
                for heading, section in sections(body or ""):
                    for piece in pieces(section) if len(section.encode()) > tokens * 4 else [section]:
                        count = -(-len(piece.encode()) // 4)
                        if count >= least:
                            found.append((p, index, heading, piece, count))
                            index += 1
            yield pd.DataFrame(found, columns=["file_path", "chunk_index", "heading", "content", "token_count"])

    return rows.select(path, text).mapInPandas(run, "file_path string, chunk_index int, heading string, content string, token_count int")
