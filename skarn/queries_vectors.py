"""Registered queries of the vector cells: nearest vectors of a set of queries, and pairs above a similarity, over all embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.vector_cells import Cells
from .queries import Inputs, query
from .session import shared_folder


def _built(t: Inputs) -> Cells:
    return Cells.build(t.table("embeddings"), f"{shared_folder(t.spark)}/skarn-cells-{uuid.uuid4().hex}", "vec_id")


_SIMILARITY = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5)"


@query("t3_cells_nearest", f"SELECT query, rank, id, similarity FROM (SELECT a.vec_id AS query, b.vec_id AS id, {_SIMILARITY} AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS INT) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label = 4) z WHERE rank <= 10")
def _(t: Inputs) -> DataFrame:
    found = _built(t).nearest(t.table("embeddings").where("label = 4"), 10, "vec_id")
    return found.select("query", "rank", "id", F.round("similarity", 5).alias("similarity"))


@query("j18_cells_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, {_SIMILARITY} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.35")
def _(t: Inputs) -> DataFrame:
    return _built(t).pairs(0.35).select("a", "b", F.round("similarity", 5).alias("similarity"))
