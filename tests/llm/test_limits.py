"""What lies beyond former limits: many labels, short items, zero weights, hot ids, clashing columns."""

from __future__ import annotations

import random

import numpy as np
from llm_fixtures import SCHEMA, frame, prose
from pyspark.sql import functions as F


def _tongue(k: int, seed: int, words: int = 40) -> str:
    """Words of an invented language."""
    own, rng = random.Random(k), random.Random(seed)
    vocabulary = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(own.randrange(3, 8))) for _ in range(60)]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


def test_every_label_is_learned_and_hot_ids_do_not_hide_a_label(spark):
    from skarn.llm.crf_langid import predict, train

    rows = [(100 * k + i, _tongue(k, 1000 * k + i), f"l{k}", "s") for k in range(70) for i in range(12)]
    docs = frame(spark, rows)
    model = train(docs)
    assert len(model.labels) == 70
    tests = frame(spark, [(i, _tongue(i % 70, 900_000 + i), None, None) for i in range(140)])
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % 70}" for r in predict(tests, model).collect()) > 130
    one_id = frame(spark, [(4, _tongue(k, i), f"l{k}", "s") for k in (0, 1) for i in range(600)])
    hot = train(one_id, sample_per_label=50)
    assert hot.labels == ["l0", "l1"]


def test_short_items_match_word_for_word(spark, none):
    from skarn.llm.latent_decontam import contaminated, decontaminate

    items = spark.createDataFrame([(1, "Quiz?"), (2, "the seven small words of one item"), (2, "blue moon"), (3, ""), (4, None), (5, prose(900, 25))], "item_id long, text string")
    rows = [(1, prose(1, 80) + " the SEVEN small, words of one item! " + prose(2, 80), "en", "a"), (2, "the seven small old words of one item", "en", "a"), (3, "a quiz", "en", "a"), (4, "blue " + prose(5, 9) + " moon", "en", "a"), (5, "once in a blue\nmoon", "en", "a"), (6, prose(900, 25) + " x", "en", "a"), (7, prose(3, 300), "en", "a"), (8, None, None, None)]
    docs = frame(spark, rows).withColumns({"_l1": F.lit(3), "_l2": F.lit(4), "h1": F.lit("h")})
    assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()) == [(1, 2), (3, 1), (5, 2), (6, 5)]
    left = decontaminate(docs, items).collect()
    assert {r["doc_id"] for r in left} == {2, 4, 7, 8} and {(r["_l1"], r["_l2"], r["h1"]) for r in left} == {(3, 4, "h")}
    assert decontaminate(none, items).collect() == []


def test_a_weight_of_zero_and_other_targets(spark):
    from skarn.llm.packing import Schedule, pack
    from skarn.llm.queries import tokenizer_path

    schedule = Schedule([5000, 300_000, 70], [1.0, 0.0, 1e-9], window=64)
    queue, first, n = np.array([0, 1, 1, 2]), np.array([0, 0, 150_000, 0]), np.array([5000, 150_000, 150_000, 70])
    doc, start, length, window, offset = schedule.place(queue, first, n)
    at = window * 64 + offset
    order = np.argsort(at)
    assert at[order][0] == 0 and (at[order][1:] == (at + length)[order][:-1]).all() and length.sum() == 305_070
    for d in range(4):
        own = np.sort(start[doc == d])
        assert own[0] == 0 and length[doc == d].sum() == n[d]
    rows = [(i, prose(i, 300), "en", "big" if i % 10 else "small") for i in range(200)]
    docs = frame(spark, rows)
    even = pack(docs, tokenizer_path(), weights={"big": 1.0, "small": 1.0}).collect()
    head = [r for r in even if r["sequence_id"] < 5]
    share = sum(r["length"] for r in head if r["source"] == "small") / sum(r["length"] for r in head)
    assert 0.49 < share < 0.51
    milder = [r for r in pack(docs, tokenizer_path(), temper=0.5).collect() if r["sequence_id"] < 5]
    assert 0.22 < sum(r["length"] for r in milder if r["source"] == "small") / sum(r["length"] for r in milder) < 0.28
    assert sum(r["length"] for r in pack(docs, tokenizer_path(), weights={"big": 1.0, "small": 0.0}).collect()) == sum(r["length"] for r in even)


def test_shards_of_any_size_have_the_links_of_brute_force():
    from skarn.llm.vp_simhash import spanning_tree

    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    every = np.unique(np.concatenate([seeds ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 300)).astype(np.uint64), axis=0) if k else seeds for k in range(6)]))
    rng.shuffle(every)
    home, visitors = every[:1300], every[1300:]

    def groups(pairs):
        up = {int(x): int(x) for x in every}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[top(int(a))] = top(int(b))
        return {frozenset(int(y) for y in every if top(int(y)) == r) for r in {top(int(x)) for x in every}}

    close = np.bitwise_count(home[:, None] ^ every[None, :]) <= 3
    want = groups((home[i], every[k]) for i, k in zip(*np.nonzero(close), strict=True))
    for rows in (20, 100, 5000):
        assert groups((a, b) for x, y in spanning_tree(home, visitors, 3, rows) for a, b in zip(x, y, strict=True)) == want


def test_lines_carry_columns_named_like_their_own(spark):
    from skarn.llm.line_runs import LineRuns, dedup_lines

    docs = frame(spark, [(i, f"common\nown {i}", "en", "a") for i in range(12)]).withColumns({c: F.lit(5) for c in ("_lines", "_cuts", "_k1", "_k2", "_dropped", "k1", "pos")})
    got = dedup_lines(docs).collect()
    assert {r["kept_text"] for r in got} == {f"own {i}" for i in range(12)} and {r[c] for r in got for c in ("_lines", "_cuts", "_k1", "_k2", "_dropped", "k1", "pos")} == {5}
    runs = LineRuns(spark, min_docs=2)
    for k in range(8):
        runs.add(frame(spark, [(i, f"a {k // 2}\nb {k}", "en", "a") for i in range(2)]))
    assert len(runs.saturated) <= 3 and runs.finish().distinct().count() == 12


def test_a_worse_notice_before_the_best_is_reported():
    from skarn.llm.notice_search import Notices

    found = Notices().search("relesed undr the mit license released under the mit license and releasd under the mit licence")[2]
    assert [(a, b) for a, b, label, _ in found if label == "mit"] == [(0, 5), (5, 10), (11, 16)]
    similar = [s for _, _, label, s in found if label == "mit"]
    assert similar[1] == 1.0 and max(similar[0], similar[2]) < 1.0
    inserted, deleted = Notices().search("it is released under the m it license")[2], Notices().search("licensed under the gnu general public licens version 3")[2]
    assert [x[2] for x in inserted] == ["mit"] and [x[2] for x in deleted] == ["gpl-3"]


def test_secrets_with_a_key_and_values_like_them_are_found(spark):
    from skarn.llm.pii_bootstrap import find_pii

    rng = random.Random(4)
    value = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    secrets = [value() for _ in range(30)]
    rows = [(i, f'{prose(i, 20, 300)} token = "{s}" {prose(i + 500, 20, 300)}', "en", "a") for i, s in enumerate(secrets)] + [(100 + i, prose(i, 60, 300) + " see page 12 of 2004", "en", "a") for i in range(30)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in find_pii(frame(spark, rows)).collect()}
    for i, s in enumerate(secrets):
        at = rows[i][1].index(s)
        assert got[i] == [("secret", at, at + 40)]
    assert all(got[100 + i] == [] for i in range(30))


def test_pipeline_stages_keep_odd_rows_and_columns(spark, odd, none, tmp_path):
    """Nulls, repeated rows and ids, empty tables and columns named like the operators' own go through every stage."""
    import corpus_pipeline

    extra = {c: F.lit("mine") for c in ("lang_pred", "lang_score", "n_lines", "n_dropped", "kept_text", "_l1", "_lines", "_row", "h1", "row", "size")}
    spark.createDataFrame([(1, prose(9, 30, 20000)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = odd.unionByName(frame(spark, [(i, _tongue(i % 2, i), ("en", "de")[i % 2], "s") for i in range(200, 240)])).withColumns(extra)
    for k, docs in enumerate((more, none.withColumns(extra))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            before = docs.count()
            out.write.parquet(f"{tmp_path}/{k}{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}{name}")
            assert docs.count() <= before and docs.where(" or ".join(f"{c} <> 'mine' or {c} is null" for c in extra)).isEmpty(), name
            if name == "lines":
                assert docs.where("text is null and n_chars is not null").isEmpty()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert none.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
