"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

``LineRuns`` keeps, for line keys seen so far, runs of ``(h1, h2, n)`` sorted by hash (n: documents that hold the key) in levels,
and one run of saturated keys, those found in at least ``min_docs`` documents. A new batch merge-anti-joins the saturated run
(saturated keys need no further counting), adds a run of what is left at level 0, and whenever ``fanout`` runs stand on a level they are
compacted into one run of the next level; keys that reach ``min_docs`` then move to the saturated run. ``filter`` merges documents
against the saturated run.

Defined cases: null text counts as empty; an empty text is one empty line; empty keys are never counted; a repeated row is another
document; doc_id may be null or repeated (rows are matched by id and text, and equal rows have equal results); extra columns are carried
through, those named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, ascii_lower, hash128, unused, without


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: stripped of ASCII white space at both ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda line: F.btrim(line, F.lit(ASCII_SPACE)))


def _pair(key: Column) -> Column:
    h1, h2 = hash128(key)
    return F.struct(h1.alias("h1"), h2.alias("h2"))


class LineRuns:
    """Levelled runs over batches of documents. ``min_docs``: documents from which a key is frequent; ``min_chars``: shortest key that
    counts; ``fanout``: runs of one level that are compacted into the next."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 2) -> None:
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.scratch = Scratch(spark, "lines")
        self.levels: list[list[DataFrame]] = []
        self.saturated: list[DataFrame] = []

    def add(self, batch: DataFrame, text: str = "text") -> None:
        """Counts a batch of documents, each key once a document."""
        keys = F.array_distinct(F.filter(line_keys(F.col(text)), lambda k: F.char_length(k) >= max(1, self.min_chars)))
        lines = batch.select(F.explode(F.transform(keys, _pair)).alias("k")).select("k.h1", "k.h2")
        run = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for known in self.saturated:
            run = run.join(known, ["h1", "h2"], "left_anti")
        self._place(0, self._sorted(run))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._compact(runs, level + 1)
            level += 1

    def finish(self) -> DataFrame:
        """Compacts all levels; the saturated keys ``(h1, h2)``."""
        runs = [r for level in self.levels for r in level]
        self.levels = []
        if runs:
            self._compact(runs, 0)
        return self._union(self.saturated).select("h1", "h2") if self.saturated else self.spark.createDataFrame([], "h1 long, h2 long")

    def filter(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """documents with ``n_lines``, ``n_dropped`` and ``kept_text``: without the lines whose key is saturated."""
        frequent = self.finish()
        source = without(documents, ["n_lines", "n_dropped", "kept_text"])
        one, two, gone, parts, ends = unused(source, "_k1", "_k2", "_dropped", "_lines", "_cuts")
        k1, k2 = hash128(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
        keyed = source.withColumns({one: k1, two: k2})
        lines = keyed.select(one, two, F.posexplode(F.transform(line_keys(F.col(text)), _pair)).alias("pos", "k")).select(F.col(one).alias("k1"), F.col(two).alias("k2"), "pos", "k.h1", "k.h2")
        dropped = lines.join(frequent, ["h1", "h2"], "left_semi").groupBy(F.col("k1").alias(one), F.col("k2").alias(two)).agg(F.sort_array(F.collect_set("pos")).alias(gone))
        joined = keyed.join(dropped, [one, two], "left")
        split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
        # Kept lines are the slices between neighbouring dropped positions, so the work is linear in the lines of a text.
        cuts = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.col("n_lines").cast("int")))
        between = lambda j: F.slice(F.col(parts), F.element_at(F.col(ends), j) + 2, F.element_at(F.col(ends), j + 1) - F.element_at(F.col(ends), j) - 1)
        out = joined.withColumn(parts, split).withColumn("n_lines", F.size(parts).cast("long")).withColumn(ends, cuts)
        kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(gone) + 1), between)), "\n")
        out = out.withColumn("kept_text", F.when(F.col(gone).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept))
        return out.withColumn("n_dropped", F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")).drop(one, two, gone, parts, ends)

    def _sorted(self, run: DataFrame) -> DataFrame:
        return self.scratch.table(run.sortWithinPartitions("h1", "h2"), "run")

    def _place(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def _compact(self, runs: list[DataFrame], level: int) -> None:
        merged = self.scratch.table(self._union(runs).groupBy("h1", "h2").agg(F.sum("n").alias("n")).sortWithinPartitions("h1", "h2"), "merged")
        self.saturated.append(merged.where(F.col("n") >= self.min_docs).select("h1", "h2"))
        if len(self.saturated) > self.fanout:  # these runs compact, too
            self.saturated = [self._sorted(self._union(self.saturated).distinct())]
        self._place(level, merged.where(F.col("n") < self.min_docs))


def batches(documents: DataFrame, count: int, doc_id: str = "doc_id") -> list[DataFrame]:
    """A table dealt into ``count`` arrival batches by a hash of the id."""
    return [documents.where(F.pmod(F.xxhash64(F.lit("arrival"), F.col(doc_id)), F.lit(count)) == b) for b in range(count)] if count > 1 else [documents]


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, arrivals: int = 3) -> DataFrame:
    """All of ``documents`` without the lines whose key is found in ``min_docs`` documents or more, the table arriving in ``arrivals`` batches."""
    runs = LineRuns(documents.sparkSession, min_docs, min_chars)
    for batch in batches(documents, arrivals, doc_id):
        runs.add(batch, text)
    return runs.filter(documents, doc_id, text)
