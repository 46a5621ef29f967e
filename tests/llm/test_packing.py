from __future__ import annotations

import numpy as np
from llm_fixtures import frame, prose

from skarn.llm.packing import Schedule, WordIds, pack
from skarn.llm.queries import tokenizer_path


def _ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 1]


def _check(rows, docs, window=2048):
    by = {}
    for r in rows:
        by.setdefault((r["sequence_id"]), []).append(r)
    position = 0
    for s in sorted(by):
        offset = 0
        for r in sorted(by[s], key=lambda r: r["offset"]):
            assert r["offset"] == offset and r["length"] > 0
            assert r["length"] * 4 == len(r["ids"])
            offset += r["length"]
        assert offset == window or s == max(by)
        position += offset
    assert position == sum(len(_ids(d["text"])) for d in docs)


def test_pieces_are_whole_and_windows_full(spark):
    docs = frame(spark, [(i, prose(i, 5 + 37 * i % 900), "en", f"s{i % 3}") for i in range(60)])
    rows = pack(docs, tokenizer_path()).collect()
    _check(rows, docs.collect())
    for d in docs.collect():
        pieces = sorted((r for r in rows if r["doc_id"] == d["doc_id"]), key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist() == _ids(d["text"])
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces[:-1]]).tolist()


def test_windows_hold_sources_in_proportion(spark):
    docs = frame(spark, [(i, prose(i, 400), "en", "big" if i % 4 else "small") for i in range(120)])
    rows = pack(docs, tokenizer_path()).collect()
    total = sum(r["length"] for r in rows)
    share = sum(r["length"] for r in rows if r["source"] == "big") / total
    for s in range(max(r["sequence_id"] for r in rows)):
        own = sum(r["length"] for r in rows if r["sequence_id"] == s and r["source"] == "big")
        assert abs(own - share * 2048) <= 4


def test_targets(spark):
    docs = frame(spark, [(i, prose(i, 400), "en", "big" if i % 4 else "small") for i in range(120)])
    rows = pack(docs, tokenizer_path(), weights={"big": 1, "small": 1}).collect()
    _check(rows, docs.collect())
    first = [r for r in rows if r["sequence_id"] == 0]
    assert abs(sum(r["length"] for r in first if r["source"] == "small") - 1024) <= 3


def test_odd_rows(odd, none):
    rows = pack(odd.withColumn("ids", odd.doc_id).withColumn("part", odd.doc_id), tokenizer_path()).collect()
    _check(rows, odd.collect())
    assert pack(none, tokenizer_path()).collect() == []


def test_word_cache_equals_the_tokenizer(odd):
    encoder = WordIds(tokenizer_path())
    texts = [r["text"] for r in odd.collect()] + ["A.B!! (c) d's ..e", "x y", "é́ ﬁ"]
    for _ in range(2):
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [_ids(t)[:-1] for t in texts]


def test_schedule_serves_everything_once():
    rng = np.random.default_rng(0)
    totals = rng.integers(1, 5000, 7).tolist()
    schedule = Schedule(totals, rng.random(7).tolist(), 64)
    queue = np.arange(7)
    _, _, length, window, offset = schedule.place(queue, np.zeros(7, np.int64), np.array(totals))
    cover = np.zeros(sum(totals), int)
    for n, w, o in zip(length, window, offset, strict=True):
        cover[w * 64 + o : w * 64 + o + n] += 1
    assert (cover == 1).all()
