"""Problems 1, 3, 5, 6 against brute force, and their defined edge cases."""

import json
import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators import change_feed, hierarchy, nested_records, schema_drift
from quern.plans import p_general
from quern.plans.checkpoints import cut


def rows(df):
    return {tuple(r) for r in df.collect()}


def load(data, name):
    return pq.read_table(f"{data}/{name}.parquet").to_pylist()


def parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def kind(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def flat(rec, at=""):
    for k, v in rec.items():
        p = f"{at}.{k}" if at else k
        if isinstance(v, dict):
            yield p, "object", None
            yield from flat(v, p)
        elif v is not None:
            yield p, kind(v), v


def brute_p1(lines):
    files = defaultdict(lambda: defaultdict(list))
    at = {}
    for r in lines:
        files[(r["exporter"], r["entity"])][r["dump_file"]].append(parsed(r["record_json"]))
        at[r["dump_file"]] = r["exported_at"]
    out = set()
    for stream in files.values():
        order = sorted(stream, key=lambda f: (at[f], f))
        for before, after in zip(order, order[1:]):
            sides = []
            for f in (before, after):
                types, values = defaultdict(set), defaultdict(dict)
                for rec in stream[f]:
                    if isinstance(rec, dict):
                        for p, t, v in flat(rec):
                            types[p].add(t)
                            if t != "object":
                                values[p].setdefault(rec.get("id"), set()).add(json.dumps(v, sort_keys=True))
                sides.append((types, values))
            (t0, v0), (t1, v1) = sides
            turned = {p for p in t0.keys() & t1.keys() if t0[p] != t1[p]}
            out |= {(after, "retyped", p, p) for p in turned}
            objects = {p for p in turned if "object" in t0[p] | t1[p]}
            hidden = lambda p: any(p.startswith(o + ".") for o in objects)
            gone = {p for p in v0 if p not in t1 and not hidden(p)}
            new = {p for p in v1 if p not in t0 and not hidden(p)}
            used = set()
            for g in gone:
                for n in new:
                    both = v0[g].keys() & v1[n].keys() - {None}
                    if both and all(len(v0[g][i] | v1[n][i]) == 1 for i in both):
                        out.add((after, "renamed", g, n))
                        used |= {g, n}
            out |= {(after, "added", "", p) for p in new - used} | {(after, "removed", p, "") for p in gone - used}
    return out


def test_p1_found_is_brute_force(spark, data):
    assert rows(p_general.p1_found(spark, data)) == brute_p1(load(data, "dump_record"))


DUMP = "dump_file string, exporter string, entity string, exported_at timestamp, line_no int, record_json string, path string"


def _dump(spark, *files):
    out = []
    for i, (name, lines) in enumerate(files):
        out += [(name, "e", "part", f"2024-01-0{i + 1} 00:00:00", k, t, "clash") for k, t in enumerate(lines)]
    return spark.createDataFrame(out, DUMP.replace("timestamp", "string")).selectExpr("dump_file", "exporter", "entity", "cast(exported_at as timestamp) exported_at", "line_no", "record_json", "path")


def test_p1_cases(spark):
    df = _dump(
        spark,
        ("b", ['{"id":"1","x":5,"o":{"k":1},"n":null}', '{"id":"2","x":6}', "{bad", None, "", "[1]"]),
        ("a", ['{"id":"1","y":5,"o":"t","n":[{}]}', '{"id":"1","y":5,"o":"t","n":[{}]}', '{"id":null,"y":7}']),
        ("c", ["null"]),
    )
    got = rows(schema_drift.changes(df).select("dump_file", "change", "old_path", "new_path"))
    assert got == {("a", "renamed", "x", "y"), ("a", "retyped", "o", "o"), ("a", "added", "", "n"), ("c", "removed", "id", ""), ("c", "removed", "y", ""), ("c", "removed", "o", ""), ("c", "removed", "n", "")}
    typed = {r["dump_file"] + str(r["line_no"]): r.asDict() for r in schema_drift.unify(df)["part"].collect()}
    # A line stored twice is one row, a record without id is a row; x is called y, which is whole; o and n are text.
    assert {k: v["y"] for k, v in typed.items()} == {"b0": 5, "b1": 6, "a0": 5, "a2": 7}
    assert typed["b0"]["o.k"] == 1 and typed["a0"]["o"] == "t" and typed["a0"]["n"] == "[{}]" and "x" not in typed["b0"] and typed["a2"]["id"] is None
    assert schema_drift.unify(df.limit(0)) == {}
    assert rows(schema_drift.changes(df.limit(0))) == set()


def test_p1_typed_tables_hold_every_value(spark, data):
    lines = load(data, "dump_record")
    order = defaultdict(dict)
    for r in lines:
        order[r["exporter"], r["entity"]][r["dump_file"]] = r["exported_at"]
    no = {f: i for files in order.values() for i, f in enumerate(sorted(files, key=lambda f: (files[f], f)))}
    stream = {r["dump_file"]: (r["exporter"], r["entity"]) for r in lines}
    renames = defaultdict(list)
    for f, change, old, new in brute_p1(lines):
        if change == "renamed":
            renames[stream[f], old].append((no[f], new))
    for entity in ("message", "part", "file_semantics"):
        got = {(r["dump_file"], r["line_no"]): {k: v for k, v in r.asDict().items() if v is not None} for r in schema_drift.unify(spark.read.parquet(f"{data}/dump_record.parquet"))[entity].collect()}
        want, seen = {}, set()
        for r in sorted(lines, key=lambda r: r["line_no"]):
            rec = parsed(r["record_json"])
            if r["entity"] != entity or not isinstance(rec, dict) or (r["dump_file"], r["record_json"]) in seen:
                continue
            seen.add((r["dump_file"], r["record_json"]))
            row = {"exporter": r["exporter"], "dump_file": r["dump_file"], "line_no": r["line_no"]}
            for path, t, v in flat(rec):
                at = no[r["dump_file"]]
                while t != "object" and (later := min(((n, new) for n, new in renames[(r["exporter"], entity), path] if n > at), default=None)):
                    at, path = later
                if t != "object":
                    row[path] = v
            want[r["dump_file"], r["line_no"]] = row
        assert set(got) == set(want)
        text = lambda v: v if isinstance(v, str) else json.dumps(v)
        for k, row in want.items():
            assert set(got[k]) == set(row)
            assert all(got[k][c] == v or got[k][c] == text(v) for c, v in row.items())


def brute_p3(events):
    by = defaultdict(dict)
    for e in sorted(events, key=lambda e: (e["received_at"], e["id"]), reverse=True):
        by[e["aggregate_id"]][e["seq"]] = e
    out = set()
    for agg, chain in by.items():
        S, M, P = {}, {}, {}
        for seq in sorted(chain):
            e = chain[seq]
            op, d = e["type"].rsplit(".", 1)[0], json.loads(e["data"])
            info, part = d.get("info") or {}, d.get("part") or {}
            sid = d.get("sessionID") or info.get("sessionID") or part.get("sessionID") or info.get("id")
            mid = d.get("messageID") or part.get("messageID")
            pid = d.get("partID") or part.get("id")
            if op == "session.created" or (op == "session.updated" and sid in S):
                S[sid] = seq
            elif op == "session.deleted":
                S.pop(sid, None)
                M = {k: v for k, v in M.items() if v[1] != sid}
                P = {k: v for k, v in P.items() if v[1] in M}
            elif op == "message.updated" and sid in S:
                M[info["id"]] = (seq, sid)
            elif op == "message.removed":
                M.pop(mid, None)
                P = {k: v for k, v in P.items() if v[1] != mid}
            elif op == "message.part.updated" and mid in M:
                P[pid] = (seq, mid)
            elif op == "message.part.removed":
                P.pop(pid, None)
        out |= {(agg, k, v) for k, v in S.items()} | {(agg, k, v[0]) for x in (M, P) for k, v in x.items()}
    return out


def test_p3_found_is_replay(spark, data):
    assert rows(p_general.p3_found(spark, data)) == brute_p3(load(data, "sync_event"))


def test_p3_cases(spark):
    def ev(i, seq, kind, data, at="2024-01-01 00:00:00"):
        return (f"e{i}", "a", seq, kind, data, at, "clash")

    s, m, p = '{"sessionID":"a","info":{"id":"a"}}', '{"sessionID":"a","info":{"id":"m"}}', '{"sessionID":"a","part":{"id":"p","messageID":"m"}}'
    feed = [
        ev(1, 1, "message.updated.1", m), ev(2, 2, "session.created.1", s), ev(3, 3, "message.part.updated.2", p), ev(4, 4, "message.updated.1", m), ev(5, 5, "message.part.updated.2", p),
        ev(6, 6, "message.removed.1", '{"sessionID":"a","messageID":"m"}'), ev(7, 7, "message.updated.1", m), ev(8, 9, "session.updated.1", s), ev(9, 9, "session.deleted.1", s, "2024-01-01 00:00:01"),
        ev(10, None, "session.deleted.1", s), ev(11, 11, "session.deleted.1", "{cut"), ev(12, 12, "message.updated.1", None),
    ]
    df = spark.createDataFrame(feed, "id string, aggregate_id string, seq long, type string, data string, received_at string, last_seq string")
    for df in (df, df.unionAll(df), df.orderBy("id", ascending=False)):
        assert rows(change_feed.apply_changes(df).select("kind", "record_id", "parent_id", "last_seq")) == {("session", "a", None, 9), ("message", "m", "a", 7)}
    assert rows(change_feed.apply_changes(df.limit(0))) == set()


def test_p3_base_rows(spark):
    base = spark.createDataFrame([("a", "session", "a", None), ("a", "message", "m", "a"), ("a", "message", "n", "a"), ("a", "part", "p", "m"), ("b", "session", "b", None), ("c", "message", "lost", "c")], "aggregate_id string, kind string, record_id string, parent_id string")
    feed = [("e1", "a", 0, "message.removed.1", '{"sessionID":"a","messageID":"m"}'), ("e2", "a", 1, "message.part.updated.1", '{"sessionID":"a","part":{"id":"q","messageID":"n"}}'), ("e3", "b", 0, "session.updated.1", '{"sessionID":"b","info":{}}')]
    df = spark.createDataFrame([(*f, "2024-01-01 00:00:00") for f in feed], "id string, aggregate_id string, seq long, type string, data string, received_at string")
    got = rows(change_feed.apply_changes(df, base=base).select("record_id", "last_seq"))
    assert got == {("a", -3), ("n", -2), ("q", 1), ("b", 0)}
    # The state after a feed, taken as the base of the next one, stands as it is.
    again = change_feed.apply_changes(df.limit(0), base=change_feed.apply_changes(df, base=base))
    assert {r[0] for r in again.select("record_id").collect()} == {"a", "n", "q", "b"}


def test_p3_a_late_change_brings_nothing_back(spark):
    made, said, late = ("session.created.1", 1, '{"sessionID":"a","info":{"id":"a"}}'), ("message.updated.1", 2, '{"sessionID":"a","info":{"id":"m"}}'), ("message.updated.1", 3, '{"sessionID":"a","info":{"id":"m"}}')
    gone = ("message.removed.1", 5, '{"sessionID":"a","messageID":"m"}')
    feed = lambda *ops: spark.createDataFrame([(f"e{n}", "a", n, op, data, "2024-01-01 00:00:00") for op, n, data in ops], "id string, aggregate_id string, seq long, type string, data string, received_at string")
    before = change_feed.retained(feed(made, said, gone))
    after = change_feed.retained(feed(late), before)
    assert rows(change_feed.live(after).select("record_id", "last_seq")) == {("a", 1)}
    base = spark.createDataFrame([("a", "message", "b", "a", "{}")], "aggregate_id string, kind string, record_id string, parent_id string, payload string")
    assert rows(change_feed.live(change_feed.retained(feed(made, late), base=base), True).select("record_id", "last_seq", "payload")) == {("a", 1, '{"id":"a"}'), ("m", 3, '{"id":"m"}')}


@pytest.mark.parametrize("seed", [1, 2])
def test_p3_every_split_of_a_feed_gives_the_whole(spark, seed):
    rnd = random.Random(seed)
    feed = []
    for i in range(400):
        s, m, p = (f"{k}{rnd.randint(0, n)}" for k, n in (("s", 2), ("m", 5), ("p", 9)))
        op = rnd.choice(["session.created", "session.updated", "message.updated", "message.updated", "message.part.updated", "message.part.updated", "message.removed", "message.part.removed", "session.deleted" if rnd.random() < 0.3 else "session.created"])
        data = {"sessionID": s, "info": {"id": m if op.startswith("message.u") else s, "n": i}, "messageID": m, "part": {"id": p, "messageID": m, "n": i}}
        if op.startswith("session.") or op == "message.updated":
            data.pop("messageID"), data.pop("part")
        feed.append((f"e{i}", f"a{rnd.randint(0, 2)}", i, op + ".1", json.dumps(data), f"2024-01-01 00:00:{rnd.randint(10, 59)}"))
    feed += rnd.sample(feed, 60)
    rnd.shuffle(feed)
    df = lambda part: spark.createDataFrame(part, "id string, aggregate_id string, seq long, type string, data string, received_at string")
    whole = rows(change_feed.apply_changes(df(feed), True))
    assert len(whole) > 5
    kept = None
    for n in range(4):
        kept = change_feed.retained(df(feed[n::4]), kept)
    assert rows(change_feed.live(kept, True)) == whole
    assert kept.count() < len(feed) - 60


def test_p5_cases(spark):
    links = [("r", None, 1), ("a", "r", 1), ("b", "a", 1), ("b", "r", 0), ("c", "x", 1), ("e", "", 1), ("l", "l", 1), ("m", "l", 1), ("n", "m", 1), (None, "r", 1), ("a", "r", 1), ("p", "q", 1), ("q", "p", 1)]
    df = spark.createDataFrame([(*x, "clash") for x in links], "id string, parent_id string, time_updated long, path string")
    nodes = hierarchy.nested_sets(hierarchy.latest_links(df))
    got = {r[0]: tuple(r)[1:] for r in nodes.select("id", "state", "root_id", "depth", "path", "descendants").collect()}
    assert got["b"] == ("tree", "r", 2, "r/a/b", 0) and got["r"] == ("tree", "r", 0, "r", 2) and got["c"][:4] == ("tree", "c", 0, "c") and got["e"][0] == "tree"
    assert {k for k, v in got.items() if v[0] == "on_cycle"} == {"l", "p", "q"} and {k for k, v in got.items() if v[0] == "below_cycle"} == {"m", "n"}
    assert rows(hierarchy.descendants(nodes, spark.createDataFrame([("r",), ("a",)], "id string"))) == {("r", "a", 1), ("r", "b", 2), ("a", "b", 1)}
    assert rows(hierarchy.ancestors(nodes, spark.createDataFrame([("b",), ("l",), ("b",)], "id string"))) == {("b", "a", 1), ("b", "r", 2)}
    assert rows(hierarchy.nested_sets(hierarchy.latest_links(df.limit(0)))) == set()


def test_p5_a_long_chain_takes_few_rounds(spark, monkeypatch):
    jobs = []
    monkeypatch.setattr(hierarchy, "cut", lambda df: (jobs.append(1), cut(df))[1])
    n = 3000
    df = spark.range(n).selectExpr("cast(id as string) id", "case when id % 1000 > 0 then cast(id - 1 as string) end parent_id", "1L time_updated").unionByName(spark.createDataFrame([("x", "y", 1), ("y", "x", 1), ("0", "2999", 2), ("1000", "999", 2)], "id string, parent_id string, time_updated long"))
    sizes, left, rounds = hierarchy.subtree_sizes(hierarchy.latest_links(df))
    # 0 to 1999 hang under 2999, a chain of 3000 nodes; x and y are a cycle.
    got = dict(sizes.collect())
    assert got["2000"] == 3000 and got["0"] == 2000 and got["1999"] == 1 and rows(left.select("id")) == {("x",), ("y",)} and rounds == 12 and len(jobs) < 18


def test_p5_blocks_make_up_the_range(spark):
    rnd = random.Random(3)
    spans = [(1, 1), (0, 15), (1, 4096), (5, 4), (16, 271)] + [(a, a + rnd.randint(0, 10 ** rnd.randint(0, 4))) for a in (rnd.randint(0, 5000) for _ in range(200))]
    ranges = spark.createDataFrame([("r", a, b, i) for i, (a, b) in enumerate(spans)], "root_id string, lo long, hi long, n int")
    points = sorted({rnd.randint(0, 16000) for _ in range(400)})
    got = [tuple(r) for r in hierarchy.contained(ranges, spark.createDataFrame([("r", p, p) for p in points] + [("q", 3, 3)], "root_id string, at long, p long")).select("n", "p").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, p) for i, (a, b) in enumerate(spans) for p in points if a <= p <= b}


def test_p5_wide_parent(spark):
    df = spark.range(500).selectExpr("cast(id as string) id", "case when id > 0 then '0' end parent_id", "1L time_updated")
    nodes = hierarchy.nested_sets(hierarchy.latest_links(df))
    assert sorted(r[0] for r in nodes.select("lft").collect()) == list(range(500))


def cases(v, at="", up=""):
    v = parsed(v) if isinstance(v, str) and isinstance(parsed(v), (dict, list)) else v
    if isinstance(v, dict):
        for k, x in v.items():
            yield from cases(x, f"{at}.{k}" if at else k, up)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            x = parsed(x) if isinstance(x, str) and isinstance(parsed(x), (dict, list)) else x
            here = f"{at}[{i}]"
            if isinstance(x, dict):
                yield up, here
                yield from cases(x, here, here)
            else:
                yield from cases(x, here, up)


def test_p6_found_is_brute_force(spark, data):
    want = set()
    for name, rid, col, version in p_general.NESTED:
        newest = {}
        for r in load(data, name):
            if version:
                newest[r[rid]] = max(newest.get(r[rid], r), r, key=lambda x: x[version])
            else:
                newest[len(newest)] = r
        for r in newest.values():
            v = parsed(r[col])
            want |= {(name, col, r[rid], *c) for c in cases(v)}
    assert rows(p_general.p6_found(spark, data)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('[{"a":[null,{"b":[[1],[{"c":1}]]}]}]', {("", "[0]"), ("[0]", "[0].a[1]"), ("[0].a[1]", "[0].a[1].b[1][0]")}),
        ('"[{\\"a\\":1}]"', {("", "[0]")}),
        ('{"f":"[{\\"x\\":{\\"y\\":[{}]}}]"}', {("", "f[0]"), ("f[0]", "f[0].x.y[0]")}),
        ("[NaN]", set()), ('[{"a"', set()), ("", set()), (None, set()), ("[" * 500_000, set()), ('[{"n":NaN}]', set()),
    ],
)
def test_p6_cases(spark, text, want):
    df = spark.createDataFrame([("r", text, "clash"), ("r", text, "clash")], "id string, j string, parent_path string")
    assert rows(nested_records.flatten(df, "id", "j").select("parent_path", "child_path")) == want
    assert rows(nested_records.flatten(df.limit(0), "id", "j")) == set()


def test_p3_random_feeds(spark):
    """Many small random feeds in random order, one of them with a third of all rows, give what replaying them gives."""
    import datetime
    import random

    r = random.Random(5)
    t0 = datetime.datetime(2024, 1, 1)
    feed = []
    for a in range(240):
        agg = f"s{a}"
        length = 4000 if a == 0 else r.randrange(1, 45)
        for k in range(length):
            m, p = f"m{r.randrange(3 if a else 200)}", None
            p = f"{m}p{r.randrange(2)}"
            kind, data = r.choice(
                [("session.created", {"info": {"id": agg}}), ("session.updated", {"info": {"x": 1}}), ("session.deleted", {"info": {"id": agg}})] * (1 if a else 0)
                + [("message.updated", {"info": {"id": m}}), ("message.removed", {"messageID": m}), ("message.part.updated", {"part": {"id": p, "messageID": m}}), ("message.part.removed", {"messageID": m, "partID": p}), ("session.idle", {})] * 2
            ) if k or a else ("session.created", {"info": {"id": agg}})
            seq = k if r.random() < 0.9 else r.randrange(length)
            feed.append({"id": f"e{len(feed)}", "aggregate_id": agg, "seq": seq, "type": f"{kind}.{r.choice('12')}", "data": json.dumps({"sessionID": agg, **data}), "received_at": t0 + datetime.timedelta(seconds=r.randrange(10**6), microseconds=len(feed))})
    r.shuffle(feed)
    df = spark.createDataFrame(feed, "id string, aggregate_id string, seq long, type string, data string, received_at timestamp").repartition(7)
    assert rows(change_feed.apply_changes(df).select("aggregate_id", "record_id", "last_seq")) == brute_p3(feed)


def test_p5_random_links(spark):
    """Random links with loops, and a chain of 200, give what walking up from each node gives."""
    import random

    r = random.Random(6)
    parent = {f"n{i}": r.choice([None, "", "gone", *[f"n{r.randrange(400)}" for _ in range(9)]]) for i in range(400)}
    parent |= {f"c{i}": f"c{i - 1}" if i else None for i in range(200)}
    df = spark.createDataFrame([(k, v, 1) for k, v in parent.items()], "id string, parent_id string, time_updated long")

    def walk(n):
        path = [n]
        while (up := parent[path[-1]]) in parent:
            if up in path:
                return "on_cycle" if up == n else "below_cycle", "", -1, ""
            path.append(up)
        return "tree", path[-1], len(path) - 1, "/".join(reversed(path))

    def state(n):
        got = walk(n)
        seen, at = set(), n
        while parent[at] in parent and parent[at] not in seen:
            at = parent[at]
            seen.add(at)
        return ("on_cycle", "", -1, "") if got[0] != "tree" and n in seen else got

    nodes = hierarchy.nested_sets(hierarchy.latest_links(df)).collect()
    assert {n.id: (n.state, n.root_id, n.depth, n.path) for n in nodes} == {n: state(n) for n in parent}
    tree = [n for n in nodes if n.state == "tree"]
    for n in tree:
        below = {m.id for m in tree if m.root_id == n.root_id and n.lft < m.lft <= n.rgt}
        assert below == {m.id for m in tree if m.path.startswith(n.path + "/")} and len(below) == n.descendants


def fully_unwrapped(v):
    v = nested_records.unwrap(v)
    if isinstance(v, dict):
        return {k: fully_unwrapped(x) for k, x in v.items()}
    return [fully_unwrapped(x) for x in v] if isinstance(v, list) else v


JSON_VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(), max_size=8) | st.sampled_from(['{"a": [1, {"b": "[]"}]}', "[", "{x", " [null]"]),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(st.sampled_from("ab.[]0\ud800"), max_size=3), inner, max_size=4),
    max_leaves=20,
)


@settings(max_examples=200, deadline=None)
@given(JSON_VALUES)
def test_p6_tables_give_the_record_back(value):
    made = list(nested_records.node_rows(value))
    random.Random(1).shuffle(made)
    assert nested_records.rebuild(made) == fully_unwrapped(value)


def test_p6_tables_of_the_data_give_every_record_back(spark, data):
    got = defaultdict(list)
    for r in p_general.p6_tables(spark, data).collect():
        if r["table_name"] == "audit_run":
            got[r["column_name"], r["row_id"]].append(tuple(r)[3:])
    seen = defaultdict(set)
    for r in load(data, "audit_run"):
        for col in ("obligations_json", "payload_json"):
            if parsed(r[col]) is not None:
                seen[col, r["id"]].add(r[col])
    once = {k for k, texts in seen.items() if len(texts) == 1}
    assert len(once) > 30 and set(got) == set(seen)
    for k in once:
        assert nested_records.rebuild(got[k]) == fully_unwrapped(parsed(next(iter(seen[k]))))


def test_p6_rows_of_every_part(spark):
    text = json.dumps({"id": 1, "m": {"x": 2}, "arr": [1, 2], "items": [{"k": 1, "o": {"deep": 5}, "tags": ["a"]}], "e": [], "n": None})
    df = spark.createDataFrame([("r", text), ("cut", '{"a": ['), ("null", None), ("plain", "7"), ("half", '{"\\ud800": [{}]}')], "id string, j string")
    got = {(r["row_id"], r["schema_path"], r["path"], r["members"], r["value"]) for r in nested_records.nodes(df, "id", "j").collect()}
    want = {("", "", '{"id": 1, "n": null}', None), ("m", "m", '{"x": 2}', None), ("arr", "arr", None, None), ("arr[]", "arr[0]", None, "1"), ("arr[]", "arr[1]", None, "2"), ("items", "items", None, None), ("items[]", "items[0]", '{"k": 1}', None), ("items[].o", "items[0].o", '{"deep": 5}', None), ("items[].tags", "items[0].tags", None, None), ("items[].tags[]", "items[0].tags[0]", None, '"a"'), ("e", "e", None, None)}
    assert {g[1:] for g in got if g[0] == "r"} == want
    assert {g[1:] for g in got if g[0] == "plain"} == {("", "", None, "7")} and not {g for g in got if g[0] in ("cut", "null")} and {g[2] for g in got if g[0] == "half"} == {"", "\\ud800", "\\ud800[0]"}


def test_p6_brackets_written_as_escapes(spark):
    df = spark.createDataFrame([("r", '{"p":"\\u005b{}]"}'), ("s", '{"p":"\\u005cu005b{}]"}')], "id string, j string")
    assert rows(nested_records.flatten(df, "id", "j").select("row_id", "child_path")) == {("r", "p[0]")}
    assert df.filter(nested_records.may_hold_array("j")).count() == 2
