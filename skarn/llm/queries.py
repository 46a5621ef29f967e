"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    """The vocabulary of the packing query; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), tokenizer_path(), temper=0.7).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf_langid import held_out, predict, train

    docs = _documents(spark, sf_dir)
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_runs import dedup_lines

    return dedup_lines(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .latent_decontam import contaminated

    found = contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "cosine", "lcs", "answer")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_bootstrap import KINDS, find_pii

    found = find_pii(_documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_shards import shard

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.select("doc_id", "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    return shard(docs, carry=["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vp_simhash import near_duplicates

    found = near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_levels import remove_repeats

    return remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import neighbours

    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .notice_search import scan_notices

    found = scan_notices(_documents(spark, sf_dir))
    exact, fuzzy = F.transform("exact", lambda x: x["label"]), F.transform("fuzzy", lambda x: x["label"])
    some = F.size("exact") > 0
    best = F.greatest(F.lit(0.0), F.array_max(F.transform("fuzzy", lambda x: x["similarity"])))
    return found.select(
        "doc_id", "n_words", F.size("exact").cast("long").alias("n_base"),
        F.when(some, F.array_min(F.transform("exact", lambda x: x["first"]))).alias("first_word"),
        F.when(some, F.array_max(F.transform("exact", lambda x: x["first"]))).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(exact)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(exact, fuzzy))), ",").alias("labels"),
        F.when(some, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet_search import rank_documents

    return rank_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_monoid import decode, encode, read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = decode(encode(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_KEY = r"translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": f"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            e AS (SELECT r, doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM d),
            k AS (SELECT r, doc_id, i, l, {_KEY} AS k FROM e),
            f AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
            SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
                   sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
            FROM k LEFT JOIN f USING (k) GROUP BY r""",
        "op12_ranked_search": f"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest({_TERMS}) AS t FROM documents),
            n AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY r),
            s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
            f AS (SELECT r, t, count(*) AS tf FROM d GROUP BY r, t),
            w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY t),
            b AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
            p AS (SELECT q, item_id, n.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM b JOIN w USING (t) JOIN f USING (t) JOIN n ON n.r = f.r, s GROUP BY q, item_id, n.r, doc_id)
            SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10""",
        # crc32 as a fold over the id's digits, eight bits each. A path is its turns' hashes, 64 characters a turn.
        "op11_prefix_trie": """
            WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS x, length(coalesce(text, '')) AS len FROM conversations WHERE conv_id IS NOT NULL),
            c AS (SELECT c, count(*) AS total, c - c % 100 AS base, CAST(c AS VARCHAR) AS s FROM t GROUP BY c),
            h AS (SELECT c, total, base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(substr(s, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) % 6 AS h FROM c),
            m AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(b.total, 0)) AS m, least(h.h, coalesce(b.total, 0)) + greatest(h.total - h.h, 0) AS n FROM h LEFT JOIN h b ON h.base = b.c),
            r AS (SELECT m.c, t.pos + 1 AS d, t.x, t.len, m.n FROM m JOIN t ON t.c = m.base WHERE t.pos < m.m UNION ALL SELECT m.c, t.pos - m.h + m.m + 1, t.x, t.len, m.n FROM m JOIN t ON t.c = m.c WHERE t.pos >= m.h),
            p AS (SELECT c, d, string_agg(x, '') OVER (PARTITION BY c ORDER BY d) AS k, len, n FROM r UNION ALL SELECT c, 0, '', 0, n FROM m),
            q AS (SELECT d, k, min(c) AS c, count(*) AS n_convs, max(len) AS len, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '') AS ends FROM p GROUP BY d, k),
            u AS (SELECT q.d, q.k, q.c, q.n_convs, q.len, q.ends, o.c AS parent, (SELECT count(*) FROM q y WHERE y.d = q.d + 1 AND left(y.k, 64 * q.d::INT) = q.k) AS n_children FROM q LEFT JOIN q o ON q.d > 0 AND o.d = q.d - 1 AND o.k = left(q.k, 64 * (q.d::INT - 1)))
            SELECT any_value(u.c) AS conv_id, u.d AS depth, any_value(u.parent) AS parent_conv_id, any_value(u.n_convs) AS n_convs, any_value(u.n_children) AS n_children,
                   count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, CAST(sum((v.n_convs - 1) * v.len) AS BIGINT) AS saved_tokens, sha256(any_value(u.ends)) AS ends_sha256
            FROM u JOIN u v ON starts_with(v.k, u.k) GROUP BY u.d, u.k""",
    }
