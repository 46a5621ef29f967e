from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import frame, prose
from pyspark.sql import functions as F

from skarn.llm import crf_langid, latent_decontam, notice_search, pii_bootstrap
from skarn.llm.queries import _joined

WORDS = {"en": "the and of to in that is was for with".split(), "de": "der die und in den von zu das mit sich".split(), "fr": "le de un et la les des en du que".split()}


def _speak(lang, seed, n=60):
    rng = np.random.default_rng(seed)
    ends = {"en": ["ing", "tion", "ly"], "de": ["ung", "keit", "lich"], "fr": ["eux", "ment", "aux"]}[lang]
    return " ".join(str(rng.choice(WORDS[lang])) if rng.random() < 0.4 else "".join(rng.choice(list("abdefglmnoprst"), 3)) + str(rng.choice(ends)) for _ in range(n))


def test_languages_and_switches(spark, odd, none):
    docs = frame(spark, [(i, _speak(lang, i), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)])
    model = crf_langid.train(docs)
    assert model.labels == ["de", "en", "fr"]
    stay = np.exp(model.transitions - model.transitions.max(axis=1, keepdims=True))
    assert (np.diag(stay) == 1).all()
    rows = crf_langid.predict(docs, model).where(crf_langid.held_out(F.col("doc_id"))).collect()
    assert rows and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    mixed = frame(spark, [(1, _speak("en", 900, 30) + " " + _speak("de", 901, 30), None, None)])
    spans = crf_langid.predict(mixed, model, with_spans=True).first()["lang_spans"]
    assert {s["lang"] for s in spans} >= {"en", "de"} and len(spans) <= 6
    got = {(r["doc_id"], r["text"]): r for r in crf_langid.predict(odd.withColumn("lang_pred", F.lit(3)), model).collect()}
    assert len(got) == len({(r["doc_id"], r["text"]) for r in odd.collect()})
    for (_, text), r in got.items():
        letters = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["lang_score"] <= 1
    assert crf_langid.predict(none, model).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in crf_langid.predict(docs, crf_langid.train(unlabelled)).collect()} == {"und"}


def test_posteriors_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    crf = crf_langid.Crf(["a", "b", "c"], np.zeros((1 << crf_langid.BITS, 3), np.float32), rng.normal(size=(3, 3)), rng.normal(size=3), {}, np.zeros((3, 3), np.float32))
    scores = rng.normal(size=(5, 3))
    crf.table = np.exp(scores)
    sequences = [np.array([0, 1, 2, 3]), np.array([4]), np.array([2, 2, 1])]
    for i, got in crf.posteriors(sequences):
        want = np.zeros((len(sequences[i]), 3))
        for path in itertools.product(range(3), repeat=len(sequences[i])):
            p = np.exp(crf.start[path[0]] + sum(scores[w, k] for w, k in zip(sequences[i], path, strict=True)) + sum(crf.transitions[a, b] for a, b in itertools.pairwise(path)))
            for t, k in enumerate(path):
                want[t, k] += p
        np.testing.assert_allclose(got, want / want.sum(axis=1, keepdims=True), rtol=1e-6)


def _plain_base(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 14 <= len(d) <= 19 and pii_bootstrap.luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("ab@._%+-0123456789 ()é\n"), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii_bootstrap.base_spans(text) == _plain_base(text)


def test_luhn():
    assert pii_bootstrap.luhn("4111111111111111") and not pii_bootstrap.luhn("4111111111111112")


def test_bootstrapping_finds_unseen_identifiers(spark, odd, none):
    rows = [(i, f"please contact user{i}@example.com today or contact +1 (212) 555-{1000 + i} today", "en", "a") for i in range(30)]
    rows += [(100 + i, f"please contact ZX{i}Q7K4M9P2T8 today but version 2.{i} is out", "en", "a") for i in range(6)]
    found = {r["doc_id"]: r for r in pii_bootstrap.find_pii(frame(spark, rows)).select("doc_id", _joined(F.col("spans")).alias("spans")).collect()}
    assert found[3]["spans"] == "email:15:32,phone:50:67"
    assert all(found[100 + i]["spans"].startswith("secret:15:") and "," not in found[100 + i]["spans"] for i in range(6))
    assert pii_bootstrap.find_pii(odd.withColumn("row", F.lit(1))).count() == odd.count()
    assert pii_bootstrap.find_pii(none).collect() == []


def test_notices_exact_and_fuzzy(spark, odd, none):
    finder = notice_search.Notices()
    n, exact, fuzzy = finder.search("This is Released under the MIT License. CC-BY-NC, cc by nc!")
    assert n == 13 and exact == [(3, 4, "mit"), (7, 3, "cc-by-nc"), (10, 3, "cc-by-nc")]
    assert (2, 7, "mit", 1.0) in fuzzy
    _, exact, fuzzy = finder.search("x released undr the MIT licence y")
    assert exact == [] and [f[2] for f in fuzzy] == ["mit"] and 0.8 < fuzzy[0][3] < 1
    assert finder.search("the license was not granted to anyone under any public terms")[2] == []
    text = " ".join(["under the mit license"] * 3 + [prose(1, 200)])
    tokens = re.findall(r"[0-9a-z]+", text.lower())
    assert [p[0] for p in finder.search(text)[1]] == [i for i in range(len(tokens)) if tokens[i : i + 4] == "under the mit license".split()]
    rows = notice_search.scan_notices(odd.withColumn("exact", F.lit(1))).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in rows) == sorted((str(r["doc_id"]), len(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")))) for r in odd.collect())
    assert notice_search.scan_notices(none).collect() == []


def test_every_notice_within_its_errors_is_found():
    import random

    rng = random.Random(4)
    finder = notice_search.Notices()
    for (_, label, length, errors), notice in zip(finder.patterns, notice_search.NOTICES, strict=True):
        for _ in range(20):
            edited = list(notice)
            for _ in range(rng.randrange(errors + 1)):
                edited[rng.randrange(len(edited))] = rng.choice("abcxyz")
            found = finder.search(f"{prose(rng.randrange(99), 6)} {''.join(edited)} tail")[2]
            assert label in {f[2] for f in found} and length == len(notice)


def test_lcs_and_singular_vectors():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 5, 30).tolist(), rng.integers(0, 5, 12).tolist()
        table = np.zeros((31, 13), int)
        for i in range(30):
            for k in range(12):
                table[i + 1, k + 1] = table[i, k] + 1 if a[i] == b[k] else max(table[i, k + 1], table[i + 1, k])
        assert latent_decontam.lcs(a, b) == table[-1, -1]
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 60)) * 5 + rng.normal(size=(200, 60)) * 0.01
    test = np.linalg.qr(rng.standard_normal((60, 8)))[0]
    _, values = latent_decontam.singular_vectors(x.T @ x @ test, test, 3)
    np.testing.assert_allclose(values, np.linalg.svd(x)[1][:3], rtol=1e-3)


def test_benchmark_items_and_paraphrases(spark, odd, none):
    items = [(i, prose(500 + i, 30, 20000) + ". " + prose(600 + i, 6, 20000)) for i in range(8)]
    bench = spark.createDataFrame([*items, (98, None), (99, "too short")], "item_id long, text string")
    rows = [(i, prose(i, 200, 20000), "en", "a") for i in range(40)]
    rows[5] = (5, f"{prose(5, 90, 20000)} {items[2][1]} {prose(55, 90, 20000)}", "en", "a")
    words = items[3][1].split()
    rows[6] = (6, f"{prose(6, 50, 20000)} {' '.join(w for i, w in enumerate(words) if i % 6)} {prose(56, 90, 20000)}", "en", "a")
    docs = frame(spark, rows)
    found = latent_decontam.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(5, 2), (6, 3)}
    clean = latent_decontam.decontaminate(docs.withColumn("h1", F.lit(1)), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i in range(40) if i not in (5, 6)] and "h1" in clean.columns
    assert latent_decontam.contaminated(odd, bench).collect() == []
    assert latent_decontam.contaminated(none, bench).collect() == []
    assert latent_decontam.contaminated(docs, bench.where("false")).collect() == []


def test_benchmark_items_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(common, k=10 + i))) for i in range(12)]
    rows = []
    for i in range(90):
        words = [rng.choice(common) if rng.random() < 0.3 else f"r{rng.randrange(10**6)}" for _ in range(rng.choice([20, 150, 1300]))]
        if i % 3:
            copy = items[i % 12][1].split()
            copy = copy if i % 3 == 1 else [w for w in copy if rng.random() < 0.8]
            at = rng.randrange(len(words))
            words[at:at] = [*(f"r{rng.randrange(10**6)}" for _ in range(20)), *copy, *(f"r{rng.randrange(10**6)}" for _ in range(20))]
        rows.append((i, " ".join(words), "en", "a"))
    held = [set(text.split()) for _, text, _, _ in rows]
    idf = lambda w: np.log((1 + len(rows)) / (1 + sum(w in h for h in held))) + 0.01
    want = set()
    for item_id, item in items:
        item = item.split()
        weight, m, tail = np.array([idf(w) for w in item]), len(item), latent_decontam.answer_words(" ".join(item))
        assert tail == 0
        for doc_id, text, _, _ in rows:
            words = text.split()
            for a in range(0, max(1, len(words) - 16), 16):
                region = words[max(0, a - m) : min(a + 32, len(words)) + m]
                got = np.isin(item, region)
                if got.mean() >= 0.6 and weight[got].sum() >= 0.6 * weight.sum() and latent_decontam.lcs(region, item) >= 0.75 * m:
                    want.add((doc_id, item_id))
    assert len(want) > 40
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in latent_decontam.contaminated(frame(spark, rows), bench).collect()} == want


def test_windows_of_an_item_are_confirmed_by_falling_cosine():
    item = prose(31, 40, 20000)
    words = [w for i, w in enumerate(item.split()) if i % 5]
    text = f"{prose(32, 100, 20000)} {' '.join(words)} {prose(33, 120, 20000)} {item} {prose(34, 100, 20000)}"
    vectors = np.random.default_rng(1).standard_normal((latent_decontam.FEATURES, 24)).astype(np.float32)
    idf = np.ones(latent_decontam.FEATURES, np.float32)
    ((found, cosine, share, _),) = latent_decontam.search(latent_decontam.word_hashes(text), latent_decontam.Items([(7, item)], idf, vectors, 8, 0.6), idf, vectors, 0.6, 0.75)
    assert (found, share) == (7, 1.0) and cosine > 0.7  # the whole copy, not the earlier one that lacks every fifth word


def test_near_notices_take_time_in_proportion_to_the_text():
    import time

    finder = notice_search.Notices()
    took = []
    for k in (500, 4000):
        start = time.process_time()
        _, _, fuzzy = finder.search("relesed under the mit licence " * k)
        took.append(time.process_time() - start)
        assert len(fuzzy) == k and {f[2] for f in fuzzy} == {"mit"} and {round(f[3], 3) for f in fuzzy} == {0.933}
    assert took[1] < 30 * took[0]  # 8 times the text
