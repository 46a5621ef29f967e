"""A persisted inverted index: segments, tombstones and merges, block-max ranked search, snippets, and fuzzy terms by deletion neighbourhoods.

Every :meth:`SearchIndex.add` writes a segment: documents by hash of their id, posting lists of two fields (content, path) by hash of the term and in its order, with summaries of blocks of documents, each document's trigrams
by hash of the trigram, and the deletion neighbourhood of its vocabulary. A query reads the hash partitions of its own terms. An index may go without words or without trigrams: without words it answers regular
expressions only; without trigrams what would ask them reads the texts, with the same answers. A manifest, written last, says which segments are
live, so a writer that dies changes nothing; there is one writer at a time. A document that is added again or deleted gets a tombstone with the
number of the write, which hides it in all older segments; :meth:`SearchIndex.merge` writes what is live as one segment and drops tombstones.

Ranking is BM25 over content and path (each with its own lengths and frequencies; the scores are added), exact over live documents. A block's
greatest frequency and least length bound the score of all its documents, so that blocks whose bound stays below the k-th best score of the best blocks are never scored.

A fuzzy lookup is an equi-join: two terms within two edits (a transposition is one) share a string that is left when each loses two characters at most, and so do their first ``PREFIX`` characters: as
far as both prefixes are aligned, an edit takes one character of each at most, and the rest of one prefix is as long as what the other has lost beyond it. Terms above
``LONG`` characters have no neighbourhood; those are compared directly, for queries of about that length.

Defined cases: null content and path are empty; null ids are dropped; of an id that occurs twice in one write, the row with the greatest content stays; an empty query finds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import code_tokens, pattern_trigrams
from .search import B, K1, _matching_lines, _query_tokens
from .search_passes import LISTS, NOT_SIMPLE, POSTING, SUMMARY, gram_bucket, grams_by_bucket, posting_lists, unpacked

_DOCS = "doc long, path string, content string, line_count long, segment long, bucket int"
_POSTINGS = f"{LISTS}, segment long, bucket int"
_GRAMS = "doc long, terms array<string>, segment long, bucket int"
_NEAR = "variant long, term string, segment long, bucket int"
_LONG = "term string, segment long"
_TOMBS = "doc long, below long"
_MANIFEST = "version long, segment long, tombs long"
#: Documents of a block; blocks that are scored before others are ruled out; longest term with a neighbourhood; edits.
BLOCK, WAVE, LONG, EDITS = 128, 16, 32, 2
#: Characters of a term that its neighbourhood is of; a term has 37 strings at most.
PREFIX = 8
#: Ids that the driver may hold.
HELD = 1 << 18
#: Characters of a snippet.
SNIPPET = 150
#: A token of ``code_tokens`` in place.
_WORD = regex.compile(r"[\p{L}\p{N}]+?(?=[^\p{L}\p{N}]|\Z|(?<=\p{Ll})\p{Lu}|(?<=\p{Lu})\p{Lu}\p{Ll})")


def deletions(term: Column, edits: int = EDITS) -> Column:
    """The strings that are left when a term loses up to ``edits`` characters, itself included."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.char_length(w))))
    found = level = F.array(term)
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda w: F.char_length(w) > 0), without)))
        found = F.array_union(found, level)
    return found


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and transpositions of neighbours, none of them within another."""
    before, now = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, now = before, now, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            now.append(cost)
    return now[-1]


def _impact(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


@dataclass
class SearchIndex:
    """An index of documents ``(doc, path, content)`` below ``path``."""

    spark: SparkSession
    path: str
    buckets: int = 32
    #: Whether vocabularies get neighbourhoods; without, fuzzy lookups compare with all terms.
    neighbourhoods: bool = True
    #: Whether there are posting lists and trigrams.
    words: bool = True
    trigrams: bool = True

    # Manifest

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 32, neighbourhoods: bool = True, words: bool = True, trigrams: bool = True) -> SearchIndex:
        index = cls(spark, path.rstrip("/"), buckets, neighbourhoods, words, trigrams)
        index._publish(0, [], [])
        return index

    def _publish(self, version: int, segments: list[int], tombs: list[int]) -> None:
        rows = [(version, s, None) for s in segments] + [(version, None, t) for t in tombs] + [(version, None, None)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version-{version}")

    def _state(self) -> tuple[int, list[int], list[int]]:
        """The last version, its segments and its tombstone files: a few numbers a write since the last merge."""
        rows = self.spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")
        last = rows.groupBy().agg(F.max("version").alias("version"))
        found = rows.join(F.broadcast(last), "version").collect()
        return found[0]["version"], sorted(r["segment"] for r in found if r["segment"] is not None), sorted(r["tombs"] for r in found if r["tombs"] is not None)

    def _bucket(self, *keys: str | Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, table: str, numbers: list[int], schema: str) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(f"{schema}, part int").option("basePath", f"{self.path}/{table}")
        return read.parquet(*[f"{self.path}/{table}/part={n}" for n in numbers]).drop("part")

    def _write(self, rows: DataFrame, table: str, number: int, *order: str, deal: bool = True) -> None:
        """deal: rows of a bucket go together first; else each task writes its own rows of all buckets."""
        # Adaptive execution splits the partition of a term that very many documents hold.
        dealt = rows.hint("rebalance", F.col("bucket")) if deal and "bucket" in rows.columns else rows
        dealt = dealt.sortWithinPartitions("bucket", *order) if "bucket" in rows.columns else dealt
        writer = dealt.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("bucket") if "bucket" in rows.columns else writer).parquet(f"{self.path}/{table}/part={number}")

    # Writes

    def _segment(self, rows: DataFrame, number: int) -> None:
        """Writes documents ``(doc, path, content)`` as a segment."""
        segment = F.lit(number).cast("long").alias("segment")
        lines = (F.char_length("content") - F.char_length(F.replace("content", F.lit("\n"), F.lit(""))) + F.when(F.col("content").endswith("\n") | (F.col("content") == ""), 0).otherwise(1)).cast("long")
        self._write(rows.select("doc", "path", "content", lines.alias("line_count"), segment, self._bucket("doc")), "docs", number, "doc")
        docs = self._read("docs", [number], _DOCS)
        if self.trigrams:
            buckets = self.buckets
            grams = docs.select("doc", F.lower("content").alias("content")).mapInArrow(lambda batches: grams_by_bucket(batches, buckets), "doc long, terms array<string>, bucket int")
            self._write(grams.select("doc", "terms", segment, "bucket"), "grams", number, "doc", deal=False)
        if not self.words:
            return
        # The tokens of a document are in one row, so lists are made there, of many documents at a time; only finished ones are dealt out.
        odd = lambda text: F.when(F.col(text).rlike(NOT_SIMPLE), code_tokens(F.col(text)))
        block = BLOCK

        def lists(batches):
            from pyspark import TaskContext

            return posting_lists(batches, TaskContext.get().partitionId(), block)

        postings = docs.select("doc", "content", "path", odd("content").alias("contents"), odd("path").alias("paths")).mapInArrow(lists, LISTS)
        self._write(postings.select("*", segment, self._bucket("field", "term")), "postings", number, "field", "term")
        postings = self._read("postings", [number], _POSTINGS)
        vocabulary = postings.where("field = 'content' AND term <> ''").select("term").distinct()
        longest = LONG if self.neighbourhoods else 0
        near = vocabulary.where(F.char_length("term") <= longest).select(F.explode(deletions(F.substring("term", 1, PREFIX))).alias("v"), "term").select(F.xxhash64("v").alias("variant"), "term", segment)
        self._write(near.select("*", self._bucket("variant")), "near", number, "variant")
        self._write(vocabulary.where(F.char_length("term") > longest).select("term", segment), "long", number)

    def add(self, rows: DataFrame, doc: str = "doc_id", content: str = "text", path: str | None = None) -> int:
        """Adds or replaces documents; the number of the write."""
        version, segments, tombs = self._state()
        number, text = version + 1, F.coalesce(F.col(content).cast("string"), F.lit(""))
        name = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
        self._segment(self._once(rows.select(F.col(doc).cast("long").alias("doc"), name.alias("path"), text.alias("content")).where("doc IS NOT NULL")), number)
        if segments:
            older = self._read("docs", segments, _DOCS).select("doc").distinct()
            self._bury(older.join(self._read("docs", [number], _DOCS).select("doc"), "doc", "left_semi"), number)
            tombs = [*tombs, number]
        self._publish(number, [*segments, number], tombs)
        return number

    def _once(self, docs: DataFrame) -> DataFrame:
        """``doc, path, content`` with one row an id. Only texts of ids that occur again are dealt out and compared; the driver knows these ids, unless they are very many."""
        one = lambda rows: rows.groupBy("doc").agg(F.max(F.struct("content", "path")).alias("_v")).select("doc", "_v.path", "_v.content")
        again = docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc").limit(HELD + 1).toArrow()
        if again.num_rows > HELD:
            return one(docs)
        if not again.num_rows:
            return docs
        ids = F.broadcast(self.spark.createDataFrame(again))
        return docs.join(ids, "doc", "left_anti").unionByName(one(docs.join(ids, "doc", "left_semi")))

    def delete(self, docs: DataFrame, doc: str = "doc_id") -> int:
        version, segments, tombs = self._state()
        self._bury(docs.select(F.col(doc).cast("long").alias("doc")).where("doc IS NOT NULL").distinct(), version + 1)
        self._publish(version + 1, segments, [*tombs, version + 1])
        return version + 1

    def _bury(self, docs: DataFrame, number: int) -> None:
        self._write(docs.select("doc", F.lit(number).cast("long").alias("below")), "tombs", number)

    def merge(self) -> int:
        """Writes all live documents as one segment."""
        state = self._state()
        self._segment(self._live("docs", _DOCS, state).select("doc", "path", "content"), state[0] + 1)
        self._publish(state[0] + 1, [state[0] + 1], [])
        return state[0] + 1

    # Reads

    def _live(self, table: str, schema: str, state: tuple[int, list[int], list[int]], where: Column | None = None) -> DataFrame:
        """Rows of live documents; posting lists are taken apart to ``field, term, doc, tf, length, block, segment``."""
        rows = self._read(table, state[1], schema)
        rows = rows if where is None else rows.where(where)
        if table == "postings":
            packed = rows.select("field", "term", "segment", "postings")
            rows = packed.mapInArrow(lambda batches: unpacked(batches, POSTING), "field string, term string, segment long, doc long, tf long, length long, block long")
        return self._alive(rows, state)

    def _alive(self, rows: DataFrame, state: tuple[int, list[int], list[int]]) -> DataFrame:
        """The rows ``doc, segment, ..`` of live documents."""
        if not state[2]:
            return rows
        dead = self._read("tombs", state[2], _TOMBS).groupBy("doc").agg(F.max("below").alias("below"))
        return rows.join(dead, "doc", "left").where("below IS NULL OR segment >= below").drop("below")

    def documents(self) -> DataFrame:
        """``doc, path, content, line_count`` of live documents."""
        return self._live("docs", _DOCS, self._state()).select("doc", "path", "content", "line_count")

    def _of(self, field: str, terms: list[str]) -> Column:
        """The postings of terms, which lie in a partition each."""
        numbers = [r[0] for r in self.spark.createDataFrame([(field, t) for t in terms], "field string, term string").select(self._bucket("field", "term")).distinct().collect()]
        return F.col("bucket").isin(numbers) & (F.col("field") == field) & F.col("term").isin(terms)

    def _scored(self, terms: list[str], parts: DataFrame, state: tuple, blocks: DataFrame | None, keep: DataFrame | None) -> DataFrame:
        """``doc, score`` of live documents with a term, of the given blocks only; parts: of :meth:`_weights`."""
        hits = self._live("postings", _POSTINGS, state, self._of("content", terms) | self._of("path", terms))
        if blocks is not None:
            hits = hits.join(blocks, ["segment", "block"], "left_semi")
        if keep is not None:
            hits = hits.join(keep, "doc", "left_semi")
        one = hits.join(F.broadcast(parts), ["field", "term"])  # a row for each term of the query and field
        return one.groupBy("doc").agg(F.sum(F.col("idf") * _impact(F.col("tf").cast("double"), F.col("length"), F.col("mean"))).alias("score"))

    def _weights(self, terms: list[str], state: tuple) -> DataFrame:
        """``field, term, idf, mean`` over live documents; a field's mean length counts empty ones too."""
        found = self._live("postings", _POSTINGS, state, self._of("content", ["", *terms]) | self._of("path", ["", *terms])).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("length"))
        counts = {(r["field"], r["term"]): (r["df"], r["length"]) for r in found.collect()}  # two rows a term of the query; computed once for all that uses them
        rows = []
        for (field, term), (df, _) in counts.items():
            n, length = counts[field, ""]
            if term:
                rows.append((field, term, math.log(1.0 + (n - df + 0.5) / (df + 0.5)), max(length / n, 1e-9)))
        return self.spark.createDataFrame(rows, "field string, term string, idf double, mean double")

    def candidates(self, grams: list[str], state: tuple | None = None) -> DataFrame | None:
        """``doc`` of live documents that hold all trigrams; None where there are none to ask for."""
        held = self._holding(grams, state or self._state())
        return None if held is None else held.select("doc")

    def _holding(self, grams: list[str], state: tuple) -> DataFrame | None:
        """:meth:`candidates` with their segments."""
        wanted: dict[int, list[str]] = {}
        for g in sorted(set(grams)):
            wanted.setdefault(gram_bucket(g, self.buckets), []).append(g)
        if not wanted:
            return None
        every = lambda tests: reduce(lambda a, b: a & b, tests)
        if not self.trigrams:
            text = F.lower("content")
            return self._alive(self._read("docs", state[1], _DOCS).where(every([text.contains(g) for gs in wanted.values() for g in gs])).select("doc", "segment"), state)
        # A write's document has one row a bucket, and must have all that are asked of each.
        all_of = reduce(lambda a, b: a | b, [(F.col("bucket") == n) & every([F.array_contains("terms", g) for g in gs]) for n, gs in wanted.items()])
        rows = self._read("grams", state[1], _GRAMS).where(F.col("bucket").isin(sorted(wanted)) & all_of)
        return self._alive(rows.groupBy("doc", "segment").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("doc", "segment"), state)

    def ranked(self, query: str, limit: int = 10, prefilter: bool = True) -> DataFrame:
        """``doc, score`` of the best documents; ties by doc. prefilter: for a query of letters, digits and underscores, documents must hold all its trigrams."""
        terms, state = sorted(set(_query_tokens(query))), self._state()
        self._need_words()
        if not terms or not state[1]:
            return self.spark.createDataFrame([], "doc long, score double")
        word = prefilter and len(query) >= 3 and query.replace("_", "a").isalnum()
        keep = self.candidates([query.lower()[i : i + 3] for i in range(len(query) - 2)], state) if word else None
        best = lambda scored: scored.orderBy(F.desc(F.round("score", 9)), "doc").limit(limit)
        bound = F.col("idf") * _impact(F.col("tf").cast("double"), F.col("length"), F.col("mean"))
        parts = self._weights(terms, state)
        lists = self._read("postings", state[1], _POSTINGS).where(self._of("content", terms) | self._of("path", terms))
        summaries = lists.select("field", "term", "segment", "summary").mapInArrow(lambda batches: unpacked(batches, SUMMARY), "field string, term string, segment long, block long, tf long, length long")
        bounds = summaries.join(F.broadcast(parts), ["field", "term"]).groupBy("segment", "block").agg(F.sum(bound).alias("bound"))
        first = [(r["segment"], r["block"]) for r in bounds.orderBy(F.desc("bound"), "segment", "block").limit(WAVE + 1).collect()]
        if len(first) <= WAVE:
            return best(self._scored(terms, parts, state, None, keep))
        wave = F.broadcast(self.spark.createDataFrame(first[:WAVE], "segment long, block long"))
        found = [(r["doc"], r["score"]) for r in best(self._scored(terms, parts, state, wave, keep)).collect()]  # at most ``limit`` rows
        rest = bounds.join(wave, ["segment", "block"], "left_anti")
        rest = rest.where(F.col("bound") >= found[-1][1] - 1e-9) if len(found) == limit else rest
        more = best(self._scored(terms, parts, state, rest.select("segment", "block"), keep))
        return best(self.spark.createDataFrame(found, "doc long, score double").unionByName(more))

    def search(self, query: str, limit: int = 10, prefilter: bool = True) -> DataFrame:
        """``doc, path, line_count, score, snippet, highlighted, line``: :meth:`ranked` with, of each content, the piece of about ``SNIPPET`` characters that holds the query's heaviest
        terms, these in bold, and its line. Null where only the path matches. Without any hit: documents with a term near the query's, see :meth:`fuzzy`."""
        state = self._state()
        hits = self.ranked(query, limit, prefilter).persist()
        try:
            terms = {t: 1.0 for t in _query_tokens(query)}
            if hits.isEmpty():
                near = self.fuzzy(query, limit).groupBy("doc").agg(F.min("distance").alias("distance"), F.collect_set("term").alias("terms")).persist()
                terms = {t: 1.0 for r in near.select("terms").collect() for t in r["terms"]}
                hits = near.select("doc", (-F.col("distance")).cast("double").alias("score"))
            else:
                terms |= {r["term"]: r["idf"] for r in self._weights(sorted(terms), state).where("field = 'content'").collect()}
            ids = [r["doc"] for r in hits.select("doc").collect()]
            numbers = [r[0] for r in hits.select(self._bucket("doc")).distinct().collect()]
            docs = self._live("docs", _DOCS, state, F.col("bucket").isin(numbers) & F.col("doc").isin(ids)).select("doc", "path", "line_count", "content")
            kept = self.spark.createDataFrame([(r["doc"], r["score"]) for r in hits.collect()], "doc long, score double")
        finally:
            hits.unpersist()
        return with_snippets(docs.join(kept, "doc"), terms).orderBy(F.desc(F.round("score", 9)), "doc")

    def regex(self, pattern: str, limit: int | None = None, longest_line: int | None = None) -> DataFrame:
        """``doc, line, content``: trimmed lines that match, of ``longest_line`` bytes at most if that is given; only documents with all trigrams of the pattern are read for."""
        state = self._state()
        held = self._holding(pattern_trigrams(pattern), state)
        if held is None:
            docs = self._live("docs", _DOCS, state)
        else:
            # They are few as a rule; texts are dealt out only where they are not.
            found = held.limit(HELD + 1).toArrow()
            held = F.broadcast(self.spark.createDataFrame(found)) if found.num_rows <= HELD else held
            docs = self._read("docs", state[1], _DOCS).join(held, ["doc", "segment"], "left_semi")
        return _matching_lines(docs.select("doc", "content"), pattern, limit, longest_line)

    def _need_words(self) -> None:
        if not self.words:
            raise ValueError("this index has no words")

    def terms_near(self, term: str, edits: int = EDITS) -> DataFrame:
        """``term, distance`` of all content terms of the segments within ``edits`` (2 at most)."""
        if not 0 <= edits <= EDITS:
            raise ValueError(f"at most {EDITS} edits")
        self._need_words()
        state, wanted, longest = self._state(), term.lower(), LONG if self.neighbourhoods else 0
        asked = self.spark.createDataFrame([(wanted,)], "w string").select(F.explode(deletions(F.substring("w", 1, PREFIX), edits)).alias("v")).select(F.xxhash64("v").alias("variant")).distinct()
        pairs = [(r["variant"], r["bucket"]) for r in asked.select("variant", self._bucket("variant")).collect()] if len(wanted) <= longest + edits else []
        near = self._read("near", state[1] if pairs else [], _NEAR).where(F.col("bucket").isin(sorted({b for _, b in pairs})))
        found = near.join(F.broadcast(self.spark.createDataFrame([(v,) for v, _ in pairs], "variant long")), "variant").select("term")
        if len(wanted) + edits > longest:
            found = found.unionByName(self._read("long", state[1], _LONG).where(F.abs(F.char_length("term") - len(wanted)) <= edits).select("term"))

        def measured(batches):
            for pdf in batches:
                pdf["distance"] = [edit_distance(t, wanted) for t in pdf["term"]]
                yield pdf[pdf["distance"] <= edits]

        return found.distinct().mapInPandas(measured, "term string, distance int")

    def fuzzy(self, term: str, limit: int | None = 10, edits: int = EDITS) -> DataFrame:
        """``doc, term, distance`` of live documents with a content term within ``edits``, nearest first."""
        near = [(r["term"], r["distance"]) for r in self.terms_near(term, edits).collect()]  # spellings of one word
        if not near:
            return self.spark.createDataFrame([], "doc long, term string, distance int")
        words = self.spark.createDataFrame(near, "term string, distance int")
        out = self._live("postings", _POSTINGS, self._state(), self._of("content", [t for t, _ in near])).join(F.broadcast(words), "term").select("doc", "term", "distance").orderBy("distance", "term", "doc")
        return out if limit is None else out.limit(limit)

    def hybrid(self, query: str, pattern: str, limit: int = 10) -> DataFrame:
        """``doc, line, kind``: ranked hits (0) at their snippets' lines, then lines that match the pattern (1); of the same line the first."""
        ranked = self.search(query, limit).select("doc", F.coalesce("line", F.lit(1)).alias("line"), F.lit(0).alias("kind"))
        matched = self.regex(pattern, limit).select("doc", "line", F.lit(1).alias("kind"))
        return ranked.unionByName(matched).groupBy("doc", "line").agg(F.min("kind").alias("kind")).orderBy("kind", "doc", "line")


def with_snippets(docs: DataFrame, terms: dict[str, float], size: int = SNIPPET, bold: tuple[str, str] = ("\x1b[1m", "\x1b[0m")) -> DataFrame:
    """docs without ``content``, with ``snippet, highlighted, line``. A content's pieces are runs of words, each until ``size`` characters are passed; the heaviest one counts, the first of those."""
    rest = [f for f in docs.schema.fields if f.name != "content"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", snippet string, highlighted string, line int"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = [best_piece(text, terms, size, bold) for text in pdf["content"]]
            out = pdf[[f.name for f in rest]].copy()
            out["snippet"], out["highlighted"] = [f[0] for f in found], [f[1] for f in found]
            out["line"] = pd.array([f[2] for f in found], "Int32")
            yield out

    return docs.mapInPandas(run, schema)


def best_piece(text: str, terms: dict[str, float], size: int = SNIPPET, bold: tuple[str, str] = ("\x1b[1m", "\x1b[0m")) -> tuple[str | None, str | None, int | None]:
    """A text's heaviest piece, its terms in bold, and its line."""
    best, begin, end, weight, marks = (0.0, 0, 0, []), None, 0, 0.0, []
    for m in _WORD.finditer(text):
        if begin is not None and m.end() - begin > size:
            best = max(best, (weight, begin, end, marks), key=lambda p: p[0])
            begin, weight, marks = None, 0.0, []
        begin = m.start() if begin is None else begin
        end = m.end()
        if m.group().lower() in terms:
            weight += terms[m.group().lower()]
            marks.append(m.span())
    if begin is not None:
        best = max(best, (weight, begin, end, marks), key=lambda p: p[0])
    weight, begin, end, marks = best
    if not weight:
        return None, None, None
    shown, at = "", begin
    for a, b in marks:
        shown += text[at:a] + bold[0] + text[a:b] + bold[1]
        at = b
    return text[begin:end], shown + text[at:end], text.count("\n", 0, begin) + 1
