"""Functions and operators on literal cases."""

import pytest
from pyspark.sql import functions as F

from quern.functions import python_text, ranking
from quern.functions import text as T
from quern.operators import components, graph, keyed, resolve, search, sessions


def values(spark, column, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(column).collect()]


def test_secrets(spark):
    hexes, mixed = "a1" * 30, "gH3" * 20
    texts = ["password: hunter22x", "Authorization: Bearer abc.def", f"id {hexes}", f"id {mixed} end", "key AKIA" + "A1" * 8, "sk-" + "a" * 20, "no secret", None, 'api_key="abcdefgh1"', "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"]
    assert values(spark, T.redact_secrets(F.col("t")), *texts) == [
        "password: [REDACTED]", "Authorization: Bearer [REDACTED]", f"id {hexes}", "id [REDACTED] end", "key [REDACTED]", "[REDACTED]", "no secret", None, "api_key=[REDACTED]", "[REDACTED]",
    ]
    assert values(spark, T.contains_secret(F.col("t")), *texts) == [True, True, False, True, True, True, False, None, True, True]


def test_estimates_and_cleaning(spark):
    assert values(spark, T.token_estimate(F.col("t")), "", "a", "ab", "abcde", "abcdef") == [0, 0, 1, 1, 2]
    assert values(spark, T.token_ceiling(F.col("t")), "", "a", "abcd", "abcde") == [0, 1, 1, 2]
    assert values(spark, T.clean_text(F.col("t"), 5), " a\x01\n b  c d ", None) == ["a b c", None]
    assert values(spark, T.supported_by(F.col("t"), F.lit("The Cursor moved")), "cursor gone", "none here", "abc") == [True, False, True]


def test_head_lines(spark):
    got = values(spark, T.head_lines(F.col("t"), 2, 10), "a\nb\nc", "abc\ndefghijkl", "x", "é" * 9)
    assert [tuple(r) for r in got] == [("a\nb", 1, "lines"), ("abc", 10, "bytes"), ("x", 0, "lines"), ("", 18, "bytes")]


def test_identifiers_and_terms(spark):
    assert values(spark, T.words_of(F.col("t")), "parseHTTPResponse_v2", "a") == [["parse", "http", "response", "v2"], []]
    assert values(spark, F.array_sort(T.stem_variants(F.col("t"))), "running", "caching", "indexes", "flies", "parsed", "grass") == [["run", "runn", "runne"], ["cach", "cache"], ["index"], ["fly"], ["pars", "parse"], []]
    assert values(spark, T.search_terms(F.col("t"), False), "find getUserName in my_file") == [["getusername", "my_file", "find", "get", "user", "name"]]
    assert values(spark, T.is_distinctive(F.col("t")), "getUser", "user", "a1", "", None) == [True, False, True, False, False]


@pytest.mark.parametrize(
    ("path", "test"),
    [("src/a.test.ts", True), ("test_a.py", True), ("a/tests/b.go", True), ("FooTest.java", True), ("src/latest.ts", False), ("contest/a.ts", False), ("examples/a.ts", True), ("src/FooSpec/x.kt", True), ("src/attest.go", False)],
)
def test_test_files(spark, path, test):
    assert values(spark, T.is_test_file(F.col("t")), path) == [test]


def test_citations(spark):
    text = "kept <memory-citation version=1><entries>\nproject/a.md:3-5 | note=[x]\nproject/b.md:5-3 | note=[y]\n</entries></memory-citation>  "
    assert values(spark, T.strip_citations(F.col("t")), text, "plain ") == ["kept", "plain "]
    assert [tuple(e) for e in values(spark, T.citation_entries(F.col("t")), text)[0]] == [("project/a.md", 3, 5, "x")]


def test_python_text(spark):
    assert python_text.html_to_text("<p>a &amp; b<script>no()</script><b>c</b></p>") == "a & bc" and python_text.html_to_text(None) is None
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (1, "--"), (2, "--"), (3, None)], "n int, l string")
    a, b, c, d, e = (r[0] for r in df.select(python_text.line_hash("n", "l")).collect())
    assert a == b and c != d and e is None


def test_query_parser():
    q = search.parse_query('kind:class lang:Go path:"a b" name:x foo:bar kind:nope plain kind: "open', {"class"}, {"go"})
    assert (q.kinds, q.languages, q.paths, q.names) == (["class"], ["go"], ["a b"], ["x"]) and q.text == 'foo:bar kind:nope plain kind: "open'
    assert search.parse_query("", set(), set()).text == ""


def test_search_cases(spark):
    nodes = spark.createDataFrame([("1", "function", "parseQuery", "a::parseQuery", "src/a.ts"), ("2", "class", "Parser", "b::Parser", "src/tests/b.ts"), ("3", "field", "query_text", None, "src/c.ts")], "id string, kind string, name string, qualified_name string, file_path string")
    ids = lambda q: [r.id for r in search.search(nodes, q, 10).orderBy(F.desc("score")).collect()]
    assert ids("parseQuery")[0] == "1" and ids("arse") == ["1", "2"] and ids("parsr") == ["2"] and ids("kind:field") == ["3"] and ids("query path:c.ts") == ["3"] and ids("zzzzzzzz") == []
    assert [r.id for r in search.by_glob(nodes, "?::*Query").collect()] == ["1"]


def test_find_sequence(spark):
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(["x", "y  ", "“z”", "x", "y"])], "doc string, no int, line string")
    assert [tuple(r) for r in search.find_sequence(lines, ["x", "y"]).collect()] == [("a", 3, 0)]
    assert [tuple(r) for r in search.find_sequence(lines, ["y", '"z"']).collect()] == [("a", 1, 3)]


def test_components_and_numbers(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "d"), (None, "a"), ("e", "f"), ("f", "g"), ("g", "e")], "u string, v string")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e", "g": "e"}
    chain = spark.range(60).selectExpr("cast(id as string) u", "cast(id + 1 as string) v")
    assert components.components(chain).select("component").distinct().count() == 1
    df = spark.range(1000).selectExpr("id % 3 g", "id o")
    assert sorted(tuple(r) for r in ranking.numbered(df, ["g"], ["o"], "n").collect()) == sorted((i % 3, i, i // 3) for i in range(1000))
    assert components.components(links.limit(0)).count() == 0


def test_graph_cases(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("m", "a", "contains"), ("m", "x", "contains"), ("y", "x", "calls")], "source string, target string, kind string")
    nodes = spark.createDataFrame([(i, "module" if i == "m" else "function") for i in "abcmxy"], "id string, kind string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in graph.bfs(edges, start, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.id, r.depth) for r in graph.impact_radius(nodes, edges, start, 1, ["module"]).collect()} == {("a", 0), ("c", 1), ("m", 1), ("x", 1)}
    assert [r.id for r in graph.shortest_path(edges, "a", "c").orderBy("step").collect()] == ["a", "b", "c"] and graph.shortest_path(edges, "c", "y").count() == 0
    assert [r.cycle for r in graph.simple_cycles(edges.selectExpr("source src", "target dst"), 4).collect()] == [["a", "b", "c"]]
    loop = spark.createDataFrame([("p", "q", "contains"), ("q", "p", "contains")], "source string, target string, kind string")
    assert [tuple(r) for r in graph.ancestors(loop, spark.createDataFrame([("p",)], "id string")).collect()] == [("p", "q", 1)]


def test_sessions_and_keyed(spark):
    df = spark.createDataFrame([("s", i, 10) for i in range(5)] + [("t", 0, 99)], "s string, t int, n int")
    assert sorted(tuple(r)[:2] for r in sessions.tail_within(df, "s", ["t"], F.col("n"), 25).collect()) == [("s", 3), ("s", 4)]
    gaps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 3), ("b", 4), ("c", 1), ("c", 1), ("c", 3)], "g string, q long")
    assert {tuple(r) for r in sessions.sequence_gaps(gaps, "g", "q").collect()} == {("a", False), ("b", True), ("c", False)}
    cursor = spark.range(1).select(sessions.encode_cursor(F.lit(5), F.lit("a?>b")).alias("c"))
    assert "=" not in cursor.first()[0] and tuple(cursor.select(sessions.decode_cursor(F.col("c"), "p0 long, p1 string").alias("p")).first().p) == (5, "a?>b")
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(2, None), (3, "c"), (1, "b")], "k int, v string")
    assert {tuple(r) for r in keyed.snapshot_diff(old, new, ["k"], ["v"]).collect()} == {(1, "modified"), (3, "added")}


def test_resolution_tiers(spark):
    symbols = spark.createDataFrame([("f", "b.ts", "b.ts", "x/b.ts", "ts", "file", True, 0), ("m", "run", "A::run", "x/a.ts", "ts", "method", True, 5), ("n", "run", "B::run", "y/c.py", "py", "method", False, 9), ("c", "Only", "Only", "z.ts", "ts", "class", True, 1)], "id string, name string, qualified_name string, file_path string, language string, kind string, is_exported boolean, start_line int")
    refs = spark.createDataFrame([("1", "x/b.ts", "q.ts", "ts", "imports", 1), ("2", "A::run", "q.ts", "ts", "calls", 1), ("3", "run", "y/q.py", "py", "calls", 1), ("4", "ONLY", "q.ts", "ts", "calls", 1), ("5", "Only", "q.py", "py", "calls", 1), ("6", "none", "q.py", "py", "calls", 1)], "ref_id string, name string, file_path string, language string, kind string, line int")
    got = {r.ref_id: (r.id, r.confidence, r.by) for r in resolve.resolve(refs, symbols).collect()}
    assert got == {"1": ("f", 0.95, "file-path"), "2": ("m", 0.95, "qualified-name"), "3": ("n", 0.4, "exact-match"), "4": ("c", 0.5, "fuzzy"), "5": ("c", 0.5, "exact-match")}
