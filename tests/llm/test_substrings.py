from __future__ import annotations

import random

from llm_fixtures import frame, prose
from pyspark.sql import functions as F

from skarn.llm.suffix_levels import SuffixLevels, remove_repeats


def _brute(rows, length):
    raw = [(r["text"] or "").encode() for r in rows]
    seen = {}
    for b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for r, b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r["doc_id"], len(b), sum(gone), spans, kept))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()), key=str)


def _documents(spark):
    rng = random.Random(3)
    shared = [prose(100 + i, 40) for i in range(6)]
    rows = [(i, prose(i, rng.randrange(5, 60)) + " " + rng.choice(shared)[rng.randrange(50) :] + " é " + prose(1000 + i, rng.randrange(20)), "en", "a") for i in range(60)]
    rows += [(100 + i, ("ab" if i % 2 else "a") * 150, "en", "a") for i in range(4)] + [(200, "xyz" * 100 + "!" + "xyz" * 100, "en", "a"), (201, shared[0], "en", "a"), (202, shared[0], "en", "a")]
    return frame(spark, rows)


def test_both_paths_against_brute_force(spark):
    docs = _documents(spark)
    for crowd in (200, 1):
        assert _got(remove_repeats(docs, length=80, gram=24, crowd=crowd)) == _brute(docs.collect(), 80)
    assert _got(remove_repeats(docs, length=80, gram=24, arrivals=7)) == _brute(docs.collect(), 80)


def test_texts_above_the_block_and_the_segment(spark):
    """Texts of many blocks and segments, with repeats across their borders, one text twice under one id, and one id for two texts."""
    long_one, long_two = prose(50, 2500), prose(51, 1500)
    rows = [(1, long_one, "en", "a"), (2, long_two + long_one[3000:9000], "en", "a"), (2, "é" + long_two[500:700] * 3, "en", "a"), (3, prose(52, 900), "en", "a"), (3, prose(52, 900), "en", "a"), (None, prose(52, 900), "en", "a"), (4, long_one[100:4200], "en", "a")]
    docs = frame(spark, rows)
    want = _brute(docs.collect(), 90)
    for block, segment in ((1 << 17, 1 << 18), (700, 1000), (256, 301)):
        assert _got(remove_repeats(docs, length=90, gram=30, block=block, segment=segment)) == want


def test_odd_rows(odd, none):
    small = odd.where("text is null or length(text) < 5000")
    assert _got(remove_repeats(small.withColumn("h1", F.lit("x")).withColumn("kept", F.lit(1)), length=60, gram=20)) == _brute(small.collect(), 60)
    assert {r["doc_id"]: r["n_removed"] > 0.99 * r["n_bytes"] - 410 for r in remove_repeats(odd).collect() if r["doc_id"] in (3, 4)} == {3: True, 4: True}
    assert remove_repeats(none).collect() == []


def test_levels_merge_geometrically(spark):
    from skarn.llm.common import Scratch

    family = SuffixLevels(spark, Scratch(spark, "levels"))
    schema = "h1 long, h2 long, pos long, lo long, hi long, s1 long, s2 long, s3 long, lead long, context long"
    batch = lambda *leads, own: spark.createDataFrame([(own, 0, i, 0, 0, lead, 0, 0, lead, 0) for i, lead in enumerate(leads)], schema)
    told = [sorted({r["lead"] for r in family.add(batch(*leads, own=k)).collect()}) for k, leads in enumerate([(1, 99), (2, 99), (3, 1, 1), (4, 2), (5, 4)])]
    assert told == [[], [99], [1], [2], [4]]  # from a merge, from the scan of a higher level, from a merge of all
    assert [x is not None for x in family.levels] == [True, False, True]
    assert sorted(r["lead"] for r in family.repeated().collect()) == [1, 2, 4, 99]
    run = [tuple(r)[:4] for r in family.levels[2].coalesce(1).sortWithinPartitions(*family.KEY).collect()]
    assert run == sorted(run) and len(run) == len(set(run)) == 5


def test_runs_are_in_suffix_order():
    import numpy as np

    from skarn.llm.suffix_levels import order_keys

    data = np.frombuffer(("zebra \u00e9t\u00e9 a " + prose(4, 80)).encode(), np.uint8)
    pos = np.arange(len(data) - 40)
    keys = list(zip(*(k.tolist() for k in order_keys(data, pos, 32)), strict=True))
    raw = [data[p : p + 24].tobytes() for p in pos]
    assert sorted(range(len(raw)), key=lambda i: (raw[i], i)) == sorted(range(len(raw)), key=lambda i: (keys[i], i))
