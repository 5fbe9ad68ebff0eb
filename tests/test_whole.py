"""Queries over whole tables: no row is thinned away, results agree with brute force."""

import collections
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from quern.operators import graph, resolve, sessions
from quern.sources import extract

SMALL = "/root/testdata/sf0.001"


def load(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_j20_overlaps_of_every_key(spark):
    day = lambda t: (t.date() if hasattr(t, "date") else t).toordinal()
    spans = collections.defaultdict(set)
    for r in load("lineitem"):
        spans[r["l_suppkey"]].add((r["l_orderkey"] * 10 + r["l_linenumber"], day(r["l_shipdate"]), day(r["l_shipdate"]) + int(r["l_quantity"])))
    want = collections.Counter()
    for o in load("orders"):
        a = day(o["o_orderdate"])
        want.update((o["o_orderkey"], i) for i, start, stop in spans[o["o_custkey"] % 100] if a <= stop and start <= a + 7)
    assert bag(entry.queries()["graph_j20_overlap"](spark, SMALL)) == want


def test_resolve_asks_for_every_row(spark):
    q = lambda name: entry.queries()[name](spark, SMALL)
    parts, customers = {str(r["p_partkey"]) for r in load("part")}, {str(r["c_custkey"]) for r in load("customer")}
    assert {r.ref_id[1:] for r in q("resolve_e6_best_match").collect()} == parts
    shared = collections.Counter((r["p_type"], r["p_name"]) for r in load("part"))
    alone = {str(r["p_partkey"]) for r in load("part") if shared[r["p_type"], r["p_name"]] == 1}
    assert alone and {r.ref_id[1:] for r in q("resolve_e4_qualified").collect()} == alone
    # These two leave references without a near candidate unresolved, whatever their id.
    best = {r.ref_id for r in q("resolve_e6_best_match").filter("n = 1 OR score > -1").collect()}
    assert {r.ref_id for r in q("resolve_e3_exact_name").collect()} == best and len(best) > len(parts) / 7 + 1
    ladder = [r.ref_id for r in q("resolve_e1_ladder").collect()]
    assert set(ladder) >= best and sum(r.n for r in q("resolve_a26_by_method").collect()) == len(ladder)
    assert {r.source[1:] for r in q("resolve_e10_edge_creation").collect()} == parts
    assert {r.ref_id[1:] for r in q("resolve_e8_lower_name").collect()} == customers


def test_e25_takes_the_methods_of_every_order(spark, tmp_path):
    lines, owner = load("lineitem")[:400], {o["o_orderkey"]: o["o_custkey"] for o in load("orders")}
    lines = [r | {"l_suppkey": r["l_orderkey"] % 300} for r in lines]
    (tmp_path / "orders.parquet").symlink_to(f"{SMALL}/orders.parquet")
    stubs, impls = collections.defaultdict(set), collections.defaultdict(set)
    for r in lines:
        stubs[r["l_suppkey"]].add(r["l_partkey"] % 50)
        impls[owner[r["l_orderkey"]]].add(r["l_partkey"] % 50)
    stubs[-1] = stubs[-2] = {lines[0]["l_partkey"] % 50}
    lines += [lines[0] | {"l_suppkey": k} for k in (-1, -2)]
    pq.write_table(pa.Table.from_pylist(lines, pq.read_schema(f"{SMALL}/lineitem.parquet")), tmp_path / "lineitem.parquet")
    want = collections.Counter((s, i) for s, need in stubs.items() for i, has in impls.items() if s != i and need <= has)
    assert want and bag(entry.queries()["resolve_e25_stub_impl"](spark, str(tmp_path))) == want


def test_e5_method_calls(spark):
    m = lambda i, name, q, path, lang, kind="method": (i, name, q, path, lang, kind, True, 1)
    symbols = spark.createDataFrame([
        m("t1", "go", "a::Bo::go", "x/a/Bo.java", "java"), m("t2", "go", "b::Bo::go", "x/b/Bo.java", "java"), m("c1", "Engine", "Engine", "e.ts", "ts", "class"), m("e1", "run", "Engine::run", "e.ts", "ts"), m("o1", "run", "Other::run", "o.ts", "ts"),
        m("u1", "solo", "Far::solo", "f.ts", "ts"), m("r1", "check", "PermissionRuleEngine::check", "p.ts", "ts"), m("r2", "check", "Cache::check", "q.ts", "ts"), m("g1", "other", "Lone::other", "g.go", "go"),
        m("w1", "scan", "TokenTreeReader::scan", "w.go", "go"), m("w2", "scan", "Disk::scan", "w.go", "go"),
    ], "id string, name string, qualified_name string, file_path string, language string, kind string, is_exported boolean, start_line int")
    asked = [
        ("1", "svc.go", "java", "Bo", "b.Bo"), ("2", "svc.go", "java", "Bo", None), ("3", "Engine.run", "ts", None, None), ("4", "engine.run", "ts", None, None), ("5", "x.solo", "ts", None, None),
        ("6", "permissionEngine.check", "ts", None, None), ("7", "zz.check", "ts", None, None), ("8", "x.other", "ts", None, None), ("9", "tokenTree.scan", "ts", None, None), ("10", "tokenBox.scan", "ts", None, None), ("11", "a.b.go", "java", None, None),
    ]
    refs = spark.createDataFrame([(i, n, "s/q.x", lang, "calls", 1, t, imp) for i, n, lang, t, imp in asked], "ref_id string, name string, file_path string, language string, kind string, line int, receiver_type string, receiver_import string")
    want = {
        "1": ("t2", 0.9, "instance-method"), "2": ("t1", 0.9, "instance-method"), "3": ("e1", 0.85, "qualified-name"), "4": ("e1", 0.8, "instance-method"), "5": ("u1", 0.7, "instance-method"),
        "6": ("r1", 0.65, "instance-method"), "9": ("w1", 0.65, "instance-method"),
    }
    assert {r.ref_id: (r.id, r.confidence, r.by) for r in resolve.by_method(refs, symbols).collect()} == want
    assert {r.ref_id: (r.id, r.confidence, r.by) for r in resolve.resolve(refs, symbols).collect()} == want
    # The registered ladder has dotted references, each found by its method.
    dotted = entry.queries()["resolve_e1_ladder"](spark, SMALL).filter("ref_id LIKE 'd%'").collect()
    assert len({r.ref_id for r in dotted}) > 100 and {r.confidence for r in dotted} >= {0.9, 0.85, 0.8}


def test_s4_symbols_of_every_language(spark):
    files = {(r["project_id"], r["path"], r["language"], r["content"]) for r in load("source_files") if r["content"] is not None}
    want = collections.Counter()
    for project, path, language, text in files:
        for no, line in enumerate(text.split("\n"), 1):
            hit = next(((kind, m[1]) for lang, kind, p in extract.DEFINITIONS if lang == language and (m := re.search(p, line, re.A))), None)
            want.update([(project, path, *hit, no)] if hit else [])
    assert bag(entry.queries()["io_s4_symbols"](spark, SMALL)) == want
    language = {(project, path): lang for project, path, lang, _ in files}
    assert {language[k[:2]] for k in want} >= {"javascript", "typescript", "java", "c"}


def test_traversals_have_no_depth_limit(spark):
    chain = spark.range(36).selectExpr("'n' || id source", "'n' || (id + 1) target", "'extends' kind")
    start = spark.createDataFrame([("n0",)], "id string")
    assert [tuple(r) for r in graph.shortest_path(chain, "n0", "n20").orderBy("step").collect()] == [(i, f"n{i}") for i in range(21)]
    assert graph.shortest_path(chain, "n20", "n0").collect() == [] and graph.shortest_path(chain, "n0", "n20", 19).collect() == []
    assert {tuple(r) for r in graph.type_hierarchy(chain, start, ["extends"]).collect()} == {(f"n{i}", "above") for i in range(1, 37)}
    ring = spark.range(8).selectExpr("'n' || id src", "'n' || (id + 1) % 8 dst")
    assert [r[0] for r in graph.simple_cycles(ring).collect()] == [[f"n{i}" for i in range(8)]] and graph.simple_cycles(ring, 5).collect() == []


def test_sequences_with_repeats_are_broken(spark):
    groups = {"a": [0, 1, 1, 4, 5, 5, 6, 6, 8], "b": [3, 4, 5], "c": [1, 1], "d": [2**62, 2**62 + 1], "e": [1, None], "f": [None], "g": [1, 3]}
    df = spark.createDataFrame([(g, n) for g, ns in groups.items() for n in ns], "g string, n long")
    assert {r["g"]: r["whole"] for r in sessions.sequence_gaps(df, "g", "n").collect()} == {"a": False, "b": True, "c": False, "d": True, "e": False, "f": False, "g": False}


def test_imports_find_their_files(spark):
    files = ["src/a/m.ts", "src/a/util.ts", "src/lib/index.ts", "src/x.js", "pkg/mod/one.py", "pkg/mod/two.py", "pkg/__init__.py", "inc/b.h", "inc/c.c"]
    known = spark.createDataFrame([("p", f) for f in files] + [("q", "src/a/only.ts")], "project_id string, path string")
    asked = [("src/a/m.ts", "typescript", "./util"), ("src/a/m.ts", "typescript", "../lib"), ("src/a/m.ts", "typescript", "../x.js"), ("src/a/m.ts", "typescript", "./only"), ("src/a/m.ts", "typescript", "react"), ("pkg/mod/one.py", "python", ".two"), ("pkg/mod/one.py", "python", "pkg.mod.two"), ("pkg/mod/one.py", "python", "pkg"), ("pkg/mod/one.py", "python", "..mod.two"), ("inc/c.c", "c", "b.h"), ("inc/c.c", "c", None)]
    refs = spark.createDataFrame([("p", *a) for a in asked], "project_id string, path string, language string, name string")
    got = {(r["name"], r["target"]) for r in resolve.import_targets(refs, known).collect()}
    assert got == {("./util", "src/a/util.ts"), ("../lib", "src/lib/index.ts"), ("../x.js", "src/x.js"), (".two", "pkg/mod/two.py"), ("pkg.mod.two", "pkg/mod/two.py"), ("pkg", "pkg/__init__.py"), ("..mod.two", "pkg/mod/two.py"), ("b.h", "inc/b.h")}


def joined(df):
    """The most rows that a join of df gave when it was collected."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("numOutputRows").get().value() if "Join" in kind else 0
        return max([own, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def alike_parts(folder, n):
    """A part table of n rows of one name, type and brand."""
    part = load("part")[0]
    pq.write_table(pa.Table.from_pylist([part | {"p_partkey": k, "p_size": k % 50 + 1} for k in range(n)], pq.read_schema(f"{SMALL}/part.parquet")), folder / "part.parquet")
    return str(folder)


def test_e4_one_name_makes_no_pairs(spark, tmp_path):
    df = entry.queries()["resolve_e4_qualified"](spark, alike_parts(tmp_path, 1000))
    assert df.collect() == [] and joined(df) <= 2000


def test_e4_agrees_with_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab:::.") for _ in range(rng.randint(1, 8)))
    last = lambda name: re.search(r"[^:.]*\Z", name)[0]
    symbols = [(f"s{i:03}", last(q) if i % 9 else "a", q) for i, q in enumerate(word() for _ in range(500))] + [("n1", None, "a::b"), ("n2", "b", None), ("n3", "x", "a:::x"), ("n4", "x", "b::c::x"), ("n5", "x", "c::x"), ("n6", "x", "c::x")]
    refs = [(f"r{i:03}", word()) for i in range(500)] + [("x1", ":x"), ("x2", "c::x"), ("x3", "b::c::x"), ("x4", None), ("x5", "a::b"), ("x5", "a::b")]
    want = {}
    for ref in {r for r, _ in refs}:
        met = [(i, q == name, q.endswith("::" + name)) for r, name in refs if r == ref and name and ("::" in name or "." in name) for i, n, q in symbols if n == last(name) and q is not None]
        exact, ends = [i for i, e, _ in met if e], [i for i, _, e in met if e]
        if len(exact) == 1 or ends:
            want[ref] = (exact[0], 0.95) if len(exact) == 1 else (min(ends), 0.85)
    got = resolve.by_qualified(spark.createDataFrame(refs, "ref_id string, name string"), spark.createDataFrame(symbols, "id string, name string, qualified_name string")).collect()
    assert {r.ref_id: (r.id, r.confidence) for r in got} == want and len(got) == len(want)
    assert {c for _, c in want.values()} == {0.95, 0.85} and want["x2"] == ("n4", 0.85)


def test_a26_one_name_makes_no_pairs(spark, tmp_path):
    n = 1000
    df = entry.queries()["resolve_a26_by_method"](spark, alike_parts(tmp_path, n))
    got = {r.by: r.n for r in df.collect()}
    # Every part is a reference by name and one by a method, and all are found.
    assert sum(got.values()) == 2 * n and got["exact-match"] == n
    assert joined(df) <= 60 * n


def test_e1_one_name_makes_no_pairs(spark, tmp_path):
    n = 1000
    df = entry.queries()["resolve_e1_ladder"](spark, alike_parts(tmp_path, n))
    assert {r.ref_id for r in df.collect()} == {f"{mark}{k}" for mark in "rd" for k in range(n)}
    assert joined(df) <= 60 * n


def test_e1_reads_its_parts_once_for_all_tiers(spark, tmp_path):
    n = 200
    df = entry.queries()["resolve_e1_ladder"](spark, alike_parts(tmp_path, n))
    assert len(df.collect()) == 2 * n
    # After the cuts: one scan for the symbols' lines, two for the references.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 3


def test_ladder_agrees_with_brute_force(spark):
    """Names without a qualifier: the tiers of exact and of lower names, over symbols and references with alike ones among them."""
    rng = random.Random(1)
    path = lambda: rng.choice(["a/b/x.ts", "a/b/y.ts", "a/c/x.ts", "d/x.ts", "x.ts"])
    language, name = lambda: rng.choice(["ts", "go", "py", None]), lambda: rng.choice(["one", "One", "two", "six", "SIX", None])
    line = lambda: rng.choice([0, None, *range(-10, 900, 70)])
    symbols = [(f"s{i}", name(), f"q{i % 3}", path(), language(), rng.choice(["function", "class", "struct", "interface", "field", "method"]), rng.random() < 0.5, line()) for i in range(150)] + [("z1", "lone", "lone", "d/x.ts", "go", "class", True, 3), ("z2", "Late", "Late", "x.ts", "py", "class", True, 3)]
    refs = [(f"r{i}", rng.choice(["lone", "late", name()]), path(), language(), rng.choice(["calls", "instantiates", "decorates", "uses", None]), line()) for i in range(600)]
    refs += [(f"c{i}", *r[1:]) for i, r in enumerate(refs[:300])]
    dirs = lambda p: p.split("/")[:-1]

    def points(r, s):
        shared = next((i for i, (a, b) in enumerate(zip(dirs(r[2]), dirs(s[3]))) if a != b), min(len(dirs(r[2])), len(dirs(s[3]))))
        own = r[3] is not None and r[3] == s[4]
        call, kind = s[5] in ("function", "method"), s[5] in ("class", "interface")
        by_kind = 25 if r[4] == "calls" and call or r[4] == "instantiates" and (kind or s[5] == "struct") or r[4] == "decorates" and call else 15 if r[4] == "decorates" and kind else 0
        near = (100 + (max(0.0, 20 - abs(s[7] - r[5]) / 10) if r[5] is not None and s[7] else 0.0) * (s[7] is not None and s[7] > 0)) if r[2] == s[3] else 0
        return -round(near + min(80, 15 * shared) + (50 if own else -80) + by_kind + (10 if s[6] else 0), 6), s[0], shared, own

    want = {}
    for r in refs:
        met = [points(r, s) for s in symbols if r[1] is not None and s[1] == r[1]]
        score, best, shared, own = min(met, default=(9, None, 0, False))
        low = [s for s in symbols if r[1] is not None and s[1] is not None and s[1].lower() == r[1].lower() and s[5] in ("function", "method", "class")]
        of = [s for s in low if r[3] is not None and s[4] == r[3]]
        if len(met) == 1 or met and -score > -1:
            want[r[0]] = (best, (0.9 if own else 0.5) if len(met) == 1 else 0.7 if 15 * shared >= 30 else 0.4, "exact-match")
        elif len(of or low) == 1:
            want[r[0]] = ((of or low)[0][0], 0.5 if of else 0.3, "fuzzy")
    asked, known = spark.createDataFrame(refs, "ref_id string, name string, file_path string, language string, kind string, line int"), spark.createDataFrame(symbols, "id string, name string, qualified_name string, file_path string, language string, kind string, is_exported boolean, start_line int")
    got = resolve.resolve(asked, known).collect()
    assert {r.ref_id: (r.id, r.confidence, r.by) for r in got} == want and len(got) == len(want)
    assert {by for _, _, by in want.values()} == {"exact-match", "fuzzy"} and {c for _, c, _ in want.values()} == {0.9, 0.7, 0.5, 0.4, 0.3}
    best = {r.ref_id: (round(-r.score, 6), r.id) for r in resolve.best_match(asked, known).collect()}
    assert best == {r[0]: min(points(r, s) for s in symbols if s[1] == r[1])[:2] for r in refs if r[1] in {s[1] for s in symbols} - {None}}
