"""Searches without an index equal those with one."""

from __future__ import annotations

from skarn.operators import search as q

ROWS = [(1, "Apache License\nLicensed under the Apache License, Version 2.0"), (2, "no notice"), (3, None), (4, ""), (5, "apacheLicense HTTPServer\r\nLICENSED UNDER THE"), (6, "Licensed under the x\n" + "y" * 1001), (6, "apache")]


def test_scans_equal_index(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    index = q.Index.build(docs)
    for pattern in ("Licensed under", "(?i)licensed", "^no", "y+"):
        assert sorted(map(tuple, q.regex_scan(docs, pattern).collect())) == sorted(map(tuple, index.regex(pattern).collect()))
    unique = docs.where("doc_id <> 6")
    index = q.Index.build(unique)
    for query in ("apache license", "server", "Übung apache", "missing", "--"):
        want = [(r.doc, round(r.score, 9)) for r in index.bm25(query).collect()]
        assert [(r.doc, round(r.score, 9)) for r in q.bm25_scan(unique, query).collect()] == want


def test_an_index_that_nobody_keeps_answers_in_one_pass(spark):
    """Repeated, null and path-bearing documents give what the kept tables give, without grams and with one pass of tokens."""
    rows = [*ROWS, (None, "apache license"), (7, "the Apache-like"), (7, None), (8, "li ce"), (8, "cense lic")]
    docs = spark.createDataFrame([(i, f"src/apache{n}.rs", t) for n, (i, t) in enumerate(rows)], "doc_id long, path string, text string")
    for path in (None, "path"):
        built = q.Index.build(docs, path=path)
        kept = q.Index(built.docs, built.postings, built.grams)
        for query in ("apache license", "Apache", "under version", "missing", "--", "Apache license apache"):
            for prefilter in (False, True):
                a, b = ([(r.doc, round(r.score, 9)) for r in i.bm25(query, prefilter=prefilter).collect()] for i in (built, kept))
                assert a == b, (path, query, prefilter)
        for grams in (["lic", "ice", "cen"], ["lic"], ["li"], ["apa", "li"], []):
            assert sorted(built.candidates(grams).collect(), key=str) == sorted(kept.candidates(grams).collect(), key=str), (path, grams)
        for pattern in ("Licensed under", "^no", "apache", "[Ll]icense|cense"):
            assert sorted(map(tuple, built.regex(pattern).collect())) == sorted(map(tuple, kept.regex(pattern).collect()))
        assert built.hybrid("Apache license", "Licensed under", 5).collect() == kept.hybrid("Apache license", "Licensed under", 5).collect()
        plan = built.hybrid("Apache license", "Licensed under", 5)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "explode" not in plan.replace("posexplode", "")


def test_hybrid_tokenises_once(spark):
    built = q.Index.build(spark.createDataFrame(ROWS, "doc_id long, text string"))
    found = built.hybrid("Apache license", "Licensed under", 5)
    assert len(found.collect()) > 2
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
