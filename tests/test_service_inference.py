"""Inferred services: small repositories by hand, random ones against plain loops."""

from __future__ import annotations

import random

from skarn.plans import service_inference as s
from skarn.plans.services import assign_in_order


def frames(spark, routes, calls, models, roots, declared):
    make = spark.createDataFrame
    return (make(routes, "path string, handler string"), make(calls, "caller_name string, caller_file string, callee_name string, callee_file string"), make(models, "path string, model string"), make([(r,) for r in roots], "dir string"), make(declared, "root string, name string"))


def test_names_and_folders(spark):
    routes = [("services/pay/src/api/routes.rs", "charge"), ("src/main.rs", None), ("main.rs", "home"), (None, "lost"), ("a/b/c/d/e.py", "deep"), ("ship\\web\\x.ts", "post")]
    r, c, m, t, d = frames(spark, routes, [("work", "jobs/run.py", "charge", None)], [("services/pay/models.rs", "Card"), ("nowhere/m.rs", "Ghost")], ["services/pay"], [("jobs", "worker"), ("idle", "idle one")])
    services, members = s.infer_services(r, c, m, t, d)
    got = {x["directory"]: (x["name"], x["declared"], x["routes"], x["models"]) for x in services.collect()}
    assert got == {"services/pay": ("pay", False, 1, 1), "src": ("src", False, 0, 0), "": ("unnamed-service-1", False, 1, 0), "a/b/c": ("c", False, 1, 0), "jobs": ("worker", True, 1, 0), "idle": ("idle one", True, 0, 0), "ship/web": ("web", False, 1, 0)}
    assert [tuple(x) for x in s.service_calls(c, services, members).collect()] == [("worker", "pay", 1)]
    top, _ = s.infer_services(r, c, m, t.unionAll(spark.createDataFrame([(".",)], "dir string")), d)
    assert {x["name"] for x in top.where("directory in ('', 'src', 'a/b/c')").collect()} == {"root"}
    named, _ = s.infer_services(r, c, m, t, d, spark.createDataFrame([("", "shop")], "dir string, package string"))
    assert "shop" in {x["name"] for x in named.collect()}


def test_calls_equal_plain_loops(spark):
    rng = random.Random(7)
    folders = ["a", "a/b", "a/b/c", "d", "d/e", ""]
    file = lambda: f"{rng.choice(folders)}/f{rng.randrange(3)}.py".lstrip("/")
    routes = [(file(), f"s{rng.randrange(14)}") for _ in range(12)]
    calls = [(f"s{rng.randrange(14)}", file(), f"s{rng.randrange(14)}", rng.choice([None, file()])) for _ in range(60)]
    r, c, m, t, d = frames(spark, routes, calls[:0] + calls, [], ["a", "a/b/c"], [])
    services, members = s.infer_services(r, c.limit(0), m, t, d)
    held: dict[str, set] = {}
    for x in members.collect():
        held.setdefault(x["directory"], set()).add(x["symbol"])
    names = {x["directory"]: x["name"] for x in services.collect()}

    def owner(symbol, path):
        inside = [k for k in held if symbol in held[k] and path is not None and (("/" not in path) if k == "" else path == k or path.startswith(k + "/"))]
        anywhere = [k for k in held if symbol in held[k]]
        return names[max(inside, key=len)] if inside else names[anywhere[0]] if len(anywhere) == 1 else None

    want: dict[tuple, int] = {}
    for a, af, b, bf in calls:
        pair = owner(a, af), owner(b, bf)
        if None not in pair and pair[0] != pair[1]:
            want[pair] = want.get(pair, 0) + 1
    assert want and {(x[0], x[1]): x[2] for x in s.service_calls(c, services, members).collect()} == want


def test_many_services_in_order(spark):
    files = spark.createDataFrame([("src/x.rs",), ("srcs/y.rs",), ("é/z",), (None,)], "path string")
    services = spark.createDataFrame([("b", "src"), ("a", "srcs/"), ("c", "é"), ("zz", "src/")] + [(f"s{i}", f"n{i}/") for i in range(500)], "service string, root string")
    assert sorted(map(tuple, assign_in_order(files, services).collect())) == [("src/x.rs", "b"), ("srcs/y.rs", "a"), ("é/z", "c")]


def test_calls_meet_folders_once_a_file(spark):
    """A file has one base, however many folders hold members above it; odd paths and missing ends are placed as by the folders themselves."""
    make = spark.createDataFrame
    held = make([("", "s"), ("a", "s"), ("a/b", "s"), ("a/b", "t"), ("/x", "u"), ("top", "t"), ("a/b/c", "v")], "directory string, symbol string")
    services = make([(d, f"<{d}>") for d in ("", "a", "a/b", "a/b/c", "/x", "top")], "directory string, name string")
    files = ["a/b/c/f.py", "a/b/f.py", "a\\b\\g.py", "f.py", "top", "top/f.py", "/x/f.py", "/y/f.py", "z/f.py"]
    bases = {r["file"]: (r["base"], r["top"]) for r in s._bases(make([(f,) for f in files * 3 + [None]], "file string"), held).collect()}
    assert bases == {"a/b/c/f.py": ("a/b/c", False), "a/b/f.py": ("a/b", False), "a\\b\\g.py": ("a/b", False), "f.py": ("", True), "top": ("top", True), "top/f.py": ("top", False), "/x/f.py": ("/x", False), "/y/f.py": ("", False), "z/f.py": (None, False)}
    uses = make([(symbol, f) for symbol in "stuvw" for f in [*files, None]] + [(None, "f.py")], "symbol string, file string")
    got = {(r["symbol"], r["file"]): r["service"] for r in s.symbol_services(uses, services, held).collect()}
    own = {("s", "a/b/c/f.py"): "<a/b>", ("s", "a/b/f.py"): "<a/b>", ("s", "a\\b\\g.py"): "<a/b>", ("s", "f.py"): "<>", ("s", "top"): "<>", ("s", "/x/f.py"): "<>", ("s", "/y/f.py"): "<>"}
    own |= {("t", f): "<a/b>" for f in files[:3]} | {("t", f): "<top>" for f in files[4:6]}
    assert got == own | {(k, f): d for k, d in (("u", "</x>"), ("v", "<a/b/c>")) for f in [*files, None]}
    calls = make([("s", "a/b/f.py", "u", None), ("s", "a/b/f.py", "u", None), ("t", None, "u", "f.py"), ("t", "top", "v", "z/f.py"), (None, None, "u", None)], "caller_name string, caller_file string, callee_name string, callee_file string")
    assert {tuple(r) for r in s.service_calls(calls, services, held).collect()} == {("<a/b>", "</x>", 2), ("<top>", "<a/b/c>", 1)}
