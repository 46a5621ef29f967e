from __future__ import annotations

from llm_fixtures import frame, prose

import __spark_entry__ as entry


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline
    from test_text_operators import _speak

    common = "a line that everybody has"
    texts = [(i, common + "\n" + _speak(lang, i, 120), lang, f"s{i % 2}") for i, lang in enumerate(["en", "de"] * 40)]
    item = prose(9, 30, 20000)
    rows = [*texts, (500, "123 456 !!!", "en", "s0"), (501, texts[0][1], "en", "s1"), (502, _speak("en", 777, 80) + " " + item, "en", "s0")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = {r[0] for r in rows}
    assert {r["doc_id"] for r in seen["language"]} == every - {500}
    assert all(common not in r["text"] and r["n_chars"] == len(r["text"]) for r in seen["lines"])
    assert {r["doc_id"] for r in seen["near_copies"]} == every - {500, 501}
    assert {r["doc_id"] for r in seen["benchmark"]} == every - {500, 501, 502}
    assert {r["doc_id"] for r in seen["packing"]} == every - {500, 501, 502}
    tokens = lambda rows: {(r["doc_id"], r["doc_tokens"]) for r in rows}  # noqa: E731  the order of rows, and so the cuts, may differ
    assert tokens(corpus_pipeline.run(spark, str(tmp_path)).collect()) == tokens(seen["packing"])


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_by_similarity_against_brute_force(spark, none):
    import random

    import corpus_pipeline

    rng, rows = random.Random(3), []
    for i in range(40):
        words = prose(3000 + i, 60 + 3 * i).split()
        rows.append((10 * i, " ".join(words), "en", "s"))
        for k in range(1, 6):
            for at in rng.sample(range(len(words)), rng.randrange(1, 7)):
                words[at] = f"edit{i}x{k}"
            rows.append((10 * i + k, " ".join(words), "en", "s"))
    shared = prose(77, 40)
    rows += [(1000 + i, f"{prose(5000 + i, 50)} {shared}", "en", "s") for i in range(30)]
    rng.shuffle(rows)
    sets, group = [_shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k]) and group[i] != group[k]:
                group = [group[k] if g == group[i] else g for g in group]
    want = sorted(min(r[0] for r, g in zip(rows, group, strict=True) if g == one) for one in set(group))
    assert 80 < len(want) < len(rows) - 50
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, frame(spark, rows), "").collect()) == want
    assert corpus_pipeline.near_copies(spark, none, "").collect() == []


def test_near_copies_link_by_fingerprints_and_the_exact_join_finds_the_rest(spark, monkeypatch):
    import corpus_pipeline
    from skarn.llm import set_copies

    close, far = prose(21, 900).split(), prose(22, 60).split()
    rows = [(1, " ".join(close), "en", "s"), (2, " ".join(close[:-1]), "en", "s"), (3, " ".join(far), "en", "s"), (4, " ".join([*far[:-3], "x", "y", "z"]), "en", "s")]
    bits = [set_copies._fingerprint(set_copies.shingles(t)) for _, t, _, _ in rows]
    assert (bits[0] ^ bits[1]).bit_count() <= 3 < ((bits[2] ^ bits[3]) & (2**64 - 1)).bit_count()
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, frame(spark, rows), "").collect())
    assert kept() == [1, 3]
    prefixes = set_copies._prefixes
    monkeypatch.setattr(set_copies, "_prefixes", lambda *a: prefixes(*a).where("false"))
    assert kept() == [1, 3, 4]


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    import corpus_pipeline

    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (None, b + " end", "en", "s"), (None, c, "en", "s"), (None, c, "en", "t")]
    kept = corpus_pipeline.near_copies(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, a), (2, b), (0, c)])


def test_near_copies_of_very_long_texts_link_beside_a_text_that_holds_both(spark, monkeypatch):
    import random

    import corpus_pipeline
    from skarn.llm import set_copies
    from skarn.llm.set_copies import _hash, shingles

    monkeypatch.setattr(set_copies, "REPEATED", 1)  # else the sample, which holds all of so few texts, keeps the longer one out of the others' keys
    rng, base = random.Random(8), prose(4242, 30_000, 10**9).split()
    texts = []
    for k in range(2):
        words = list(base)
        for at in rng.sample(range(len(words)), 140):
            words[at] = f"edit{k}x{at}"
        texts.append(" ".join(words))
    a, b = map(_shingles, texts)
    assert 0.89 < len(a & b) / len(a | b) < 0.92
    nodes = [_hash(shingles(t)) for t in texts]
    longer = next(t for s in range(200) if _hash(shingles(t := " ".join(base) + " " + prose(9000 + s, 28_000, 10**9))) < min(nodes))
    docs = frame(spark, [(1, texts[0], "en", "s"), (2, texts[1], "en", "s"), (3, longer, "en", "s")])
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == [1, 3]
