"""Problems 2, 4, 7, 8, 9, 10 against brute force or public tools, and their defined edge cases."""

import ast
import json
import random
import re
import shutil
import subprocess
import warnings
import xml.parsers.expat

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import conversations, invalid_source, leakage, provenance, queries, sentences, syntax, tokenization


def rows(df):
    return {tuple(r) for r in df.collect()}


def load(data, name):
    return pq.read_table(f"{data}/{name}.parquet").to_pylist()


# ------------------------------------------------------------------ problem 2


def _python_fails(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return False
        except (SyntaxError, ValueError):
            return True


def _xml_fails(text):
    try:
        xml.parsers.expat.ParserCreate().Parse(text.encode(), True)
        return False
    except xml.parsers.expat.ExpatError:
        return True


@pytest.mark.parametrize(("language", "fails"), [("python", _python_fails), ("xml", _xml_fails)])
def test_p2_agrees_with_the_standard_parsers(data, language, fails):
    for r in load(data.replace("sf0.01", "sf0.1"), "source_files"):
        if r["language"] == language:
            assert bool(syntax.first_error(language, r["content"])) == fails(r["content"]), r["path"]


@pytest.mark.skipif(not shutil.which("node"), reason="no node here")
def test_p2_agrees_with_node(data, tmp_path):
    texts = [r["content"] for r in load(data.replace("sf0.01", "sf0.1"), "source_files") if r["language"] == "javascript"]
    (tmp_path / "t.json").write_text(json.dumps(texts))
    (tmp_path / "t.js").write_text(
        "const vm=require('vm'),a=JSON.parse(require('fs').readFileSync(process.argv[2]));console.log(JSON.stringify(a.map(c=>{try{new vm.Script(c);return true}catch(e){};try{new vm.SourceTextModule(c);return true}catch(e){return false}})))"
    )
    out = subprocess.run(["node", "--experimental-vm-modules", tmp_path / "t.js", tmp_path / "t.json"], capture_output=True, text=True, timeout=120)
    assert [not syntax.first_error("javascript", t) for t in texts] == json.loads(out.stdout)


GOOD = {
    "javascript": [
        "", "a\n++b", "const f = async ({a = 1, ...r}, [b,,c]) => { for await (const x of y) z?.[x]?.(1) }", "x = `a${`b${c}`}d`; /[/]\\/re/g.test(y) / 2", "if (a) /re/.test(b)\nelse ;", "label: for (;;) { continue label }", "export default class extends B { static #p = 1; get x() { return this.#p } }\nimport d, * as n from 'm'",
        "let async = 1, of = 2\nreturn_ = of", "do x(); while (y) z()", "var o = { get, set: 1, async *g() {}, [k]: 2, 'q': 3 }", "a = b\n(c)", "throw new Error(`x`)", "for (var i in o);", "new.target", "x = function* () { yield* y; yield }",
    ],
    "typescript": [
        "type A<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] }", "let x: Array<Map<string, number>>= []", "abstract class C<T> extends D<T> implements E { private constructor(readonly a: string, b?: number) { super() } abstract m(): void; [k: string]: unknown }", "const f = <T,>(x: T): x is string => x as unknown as never",
        "enum E { A = 1, B }\ndeclare module 'm' { export function f(a: string): void }", "export type { T } from './t'\nimport type X from 'x'", "function f(this: Window, ...a: number[]): asserts a is any {}\nlet y = a! + <any>b", "interface I { (x: number): string; new (): I; m?(): void }", "let t: [a: string, b?: number, ...rest: X[]] = f<number>(1) satisfies Y",
    ],
    "python": [
        "", "match x:\n    case {'a': [1, *_]} | C(y=2) if z: pass\n", "async def f(*, a: int = 1, **k) -> None:\n\tasync with a as b, c: yield\n", "x = [*a, (y := 2)]\nprint(f'{a!r:>{w}} {{}}', *b, **c)\n", "if x:\n  pass\n# c\n  # d\nelse: y\n", "type X[T] = list[T]\nmatch = case = 1\n", "lambda *a, k=1: (yield)\n", "try: pass\nexcept* E as e: raise X from e\n", "x: int\na = b = c,\nd[1:2, ::3] += 1; del (e), f\n", "@d.e(1)\nclass A(B, metaclass=C): x = 1\n",
    ],
    "go": [
        "package p\nimport (\n\t\"a\"\n\tb \"c\"\n)\nfunc (r *R[T]) M(a, b int, c ...string) (x map[string][]int, err error) {\n\tif v, ok := x[\"k\"]; ok && !f(struct{}{}) {\n\t\treturn nil, err\n\t} else if y {\n\t}\n\tfor i := range 10 {\n\t}\n\tselect {\n\tcase <-ch:\n\tdefault:\n\t}\n\tgo func() {}()\n\treturn\n}\n",
        "package p\ntype A[T any, U ~int | string] struct {\n\tX, Y int `json:\"x\"`\n\t*E\n}\nvar x = []A[int]{{1, 2}, {X: 3}}\ntype I interface {\n\tM() error\n\tfmt.Stringer\n}\n", "package p; const ( A = iota; B )",
    ],
    "rust": [
        "#![allow(x)]\nuse a::{b, c::*};\nimpl<'a, T: Fn(&'a str) -> u8 + ?Sized> Tr for S<'a, T> where T: 'a { type O = Vec<Vec<u8>>; fn f(&mut self) -> Result<(), Box<dyn E>> { let Some(x) = y else { return Err(z)? }; match x { 1..=5 | 7 if a => {}, S { b, .. } => b(), _ => loop { break 'l 1 } } } }",
        "fn f() { let c = move |x: u8| -> u8 { x as u8 }; vec![1, 2; 3]; println!(\"{}\", r#\"a\"b\"#); for i in 0..n {} if let Some(_) = a && b {} &mut *x; a.0.1.await?; 'c' }", "macro_rules! m { ($x:expr) => { $x } }\npub(crate) const X: &[u8] = b\"x\";\n#[derive(A)] enum E { A(u8), B { c: u8 }, C = 1 }",
    ],
    "java": [
        "package a.b; import static c.D.*;\n@A(x = {1, 2}) public sealed class C<T extends D & E> extends F<T[]> implements G permits H { static { } int[] a = {1, 2}, b[]; <U> C(U u) throws X { this(); } record R(int x) {} enum E { A { }, B(1); } }",
        "class C { void f() { for (var x : y) { } int z = (int) -1 + (a < b ? c : d); Runnable r = () -> { }; List<Map<String, Integer>> l = new ArrayList<>(); Object o = switch (z) { case 1, 2 -> \"a\"; default -> { yield b; } }; String::new; } }".replace("String::new;", "g(String::new);"),
    ],
    "c": [
        "#include <x.h>\n#define A(x) \\\n  x\ntypedef struct s { int a : 3; union { long b; }; } t;\nstatic t *f(const char *fmt, int (*g)(void), ...) { t x = { .a = 1, [2] = {3} }; if (a) for (int i = 0; i < 3; i++) ; else goto end; end: return (t *)&x; }\n#if 0\n}}}\n#endif\n", "int a[] = {1,2,}, *b = &a[0];\nunsigned long long c(void);", "",
    ],
    "xml": ["<?xml version='1.0'?>\n<!-- c --><!DOCTYPE a [<!ENTITY e 'x'>]><a b='1' c=\"&lt;\"><![CDATA[<]]>&e;&#10;<d/><?p q?></a>\n"],
}
BAD = {
    "javascript": ["a b", "if (a) }", "const x = ;", "f(", "`a${b", "x = 'a\n'", "{\"a\": 1, \"b\": 2}", "let x: string = 1", "<<<<<<< HEAD\na\n", "return_ = => 1", "import json\nfrom x import y"],
    "typescript": ["interface {", "let x: = 1", "type A = {", "class C { private }}", "package main"],
    "python": ["def f()\n  pass\n", "x = (\n", "if x:\npass\n", "  x\n", "a b\n", "f'{'\n", "'abc\n", "print 'x'\n", "x = 1a\n", "if x:\n\ty\n        z\n", "try:\n  a\nb\n", "{1: 2, 3}\n", "x = [1, 2\n", "f'{}'\n"],
    "go": ["", "package range\n", "func f() {}\n", "package p\nfunc f() {\n", "package p\nvar x = \"a\n", "package p\nif x {}\n", "package p\nfunc f() { a b }\n"],
    "rust": ["fn f( {}", "fn f() { let x = }", "struct S { a u8 }", "fn f() { \"abc }", "import x", "fn f() {}}"],
    "java": ["class C { int x }", "class C { void f() { return }", "class C {", "class C { void f() { if x {} } }", "def x: pass"],
    "c": ["int f( { }", "int x", "int f(void) { return 1 }", "#if A\nint x;\n", "import x", "int a[] = {1,;"],
    "xml": ["", "<a>", "<a></b>", "<a b=1/>", "<a/><b/>", "<a b='1' b='2'/>", "<a>&nbsp;</a>", "<a><!-- -- --></a>", "text", "<a>]]></a>"],
}


@pytest.mark.parametrize(("language", "text", "good"), [(k, t, g) for g, d in ((True, GOOD), (False, BAD)) for k, ts in d.items() for t in ts])
def test_p2_grammars(language, text, good):
    assert (syntax.first_error(language, text) is None) == good


def test_p2_cases(spark):
    df = spark.createDataFrame(
        [("p", "a.py", "Python ", "x = (\n", 1), ("p", "a.py", "Python ", "x = (\n", 1), ("p", "b.py", "python", None, 1), ("p", "c.zig", "zig", "(((", 1), ("p", "d.py", None, "(((", 1), (None, "e.py", "python", "(" * 200_000, 1), ("p", "f.go", "go", "", 1)],
        "project_id string, path string, language string, content string, line int",
    )
    assert rows(invalid_source.invalid_files(df)) == {("p", "a.py"), (None, "e.py"), ("p", "f.go")}
    assert rows(invalid_source.error_rates(df)) == {("p", "Python ", 1, 1, 1.0), (None, "python", 1, 1, 1.0), ("p", "go", 1, 1, 1.0)}
    assert rows(invalid_source.invalid_files(df.limit(0))) == set()


def test_p2_one_branch_of_a_conditional():
    """Of #if, #elif and #else only one branch is kept, the first that isn't #if 0."""
    heads = "#if A\nint f(int a) {\n#elif B\nint f(long a) {\n#else\nint f(char a) {\n#endif\n  return 0;\n}\n"
    assert not syntax.first_error("c", heads)
    assert not syntax.first_error("c", heads.replace("#if A", "#if 0"))
    assert syntax.first_error("c", "#if 0\nint a;\n#elif B\nint = ;\n#else\nint b;\n#endif\n")


# ------------------------------------------------------------------ problem 4


def _object(text):
    try:
        v = json.loads(text)
    except (TypeError, ValueError):
        return None
    return v if isinstance(v, dict) else None


def brute_p4(messages, parts, sessions):
    def newest(table):
        out = {}
        for r in table:
            out[r["id"]] = max(out.get(r["id"], r), r, key=lambda x: x["time_updated"])
        return out.values()

    speak = set()
    for p in newest(parts):
        d = _object(p["data"]) or {}
        if d.get("type") == "text" and d.get("synthetic") is not True and d.get("ignored") is not True and any(c.isprintable() and not c.isspace() for c in d.get("text") or ""):
            speak.add(p["message_id"])
    by = {}
    for m in newest(messages):
        by.setdefault(m["session_id"], []).append((m["time_created"], m["id"], _object(m["data"]) or {}))
    out = set()
    for sid in {s["id"] for s in sessions} & by.keys():
        ms = sorted(by[sid], key=lambda x: x[:2])
        role = [str(d.get("role") or "").strip().lower() for *_, d in ms]
        place = {m[1]: i for i, m in enumerate(ms)}
        ok = role[0] == "user" and all(r in ("user", "assistant") for r in role)
        for i, (_, mid, d) in enumerate(ms):
            if role[i] == "assistant":
                j = place.get(d.get("parentID"), i)
                ok &= j < i and role[j] == "user"
            else:
                ok &= mid in speak and any(role[j] == "assistant" and ms[j][1] in speak and ms[j][2].get("error") is None and ms[j][2].get("parentID") == mid for j in range(i + 1, len(ms)))
        if ok:
            out |= {(sid, n, mid) for n, mid in enumerate(m[1] for m in ms if m[1] in speak)}
    return out


def test_p4_found_is_brute_force(spark, data):
    assert rows(queries.p4_found(spark, data)) == brute_p4(load(data, "agent_message"), load(data, "message_part"), load(data, "agent_session"))


def test_p4_cases(spark):
    def say(i, role, **more):
        return json.dumps({"role": role, **more})

    m = [
        ("u1", "s", 1, 1, say(1, " USER")), ("a1", "s", 2, 1, say(2, "Assistant ", parentID="u1")), ("a1", "s", 2, 0, "old{"), ("a1", "s", 2, 1, say(2, "Assistant ", parentID="u1")),
        ("x1", "e", 1, 1, say(1, "user")), ("y1", "e", 2, 1, say(2, "assistant", parentID="x1", error={})),
        ("q1", "z", 1, 1, say(1, "user")), ("w1", None, 2, 1, say(2, "assistant", parentID="q1")),
        ("n1", "g", 1, 1, "null"), (None, "s", 3, 1, "bad"), ("l1", "o", 1, 1, say(1, "user")), ("l2", "o", 1, 1, say(1, "assistant", parentID="l1")),
    ]
    messages = spark.createDataFrame([(*x, "clash") for x in m], "id string, session_id string, time_created long, time_updated long, data string, role string")
    text = '{"type":"text","text":"hi"}'
    p = [(f"p{i}", k, 1, text) for i, k in enumerate(["u1", "x1", "y1", "q1", "w1", "l1", "l2", "nobody"])] + [("pa", "a1", 1, '{"type":"text","text":"\\u200b \\n"}'), ("pa", "a1", 2, text), ("pb", "a1", 1, None)]
    parts = spark.createDataFrame(p, "id string, message_id string, time_updated long, data string")
    sessions = spark.createDataFrame([("s",), ("s",), ("e",), ("z",), ("o",), ("",), (None,)], "id string")
    assert rows(conversations.kept_turns(messages, parts, sessions)) == {("s", 0, "u1", "user"), ("s", 1, "a1", "assistant"), ("z", 0, "q1", "user"), ("z", 1, "w1", "assistant"), ("o", 0, "l1", "user"), ("o", 1, "l2", "assistant")}
    _, verdicts = conversations.conversations(messages, parts)
    assert {(r["session_id"], r["reason"]) for r in verdicts.collect()} >= {("s", ""), ("e", "no reply"), ("z", ""), ("g", "broken")}
    assert rows(conversations.kept_turns(messages.limit(0), parts, sessions)) == set()


# ------------------------------------------------------------------ problem 7

HAND = "import json\n\n\ndef {0}(rows, limit=3):\n    # keep the newest\n    out = [row for row in rows if row.get('{0}') is not None]\n    return out[:limit]\n"


def test_p7_cases(spark):
    blob = "X = [\n" + "".join(f"{i * 7 % 251}, " + "\n" * (i % 20 == 0) for i in range(600)) + "]\n"
    mini = "(function(e,t){" + "".join(f"var a{i}=t[{i}];if(!a{i}||e.k{i}(a{i}))return a{i};" for i in range(60)) + "})();"
    lib = HAND.format("third") * 5
    files = [
        ("p", "src/a.py", "python", HAND.format("alpha")), ("p", "src/vendors/b.py", "python", HAND.format("beta")), ("p", "src/gen.py", "python", "# Code generated by tool. DO NOT EDIT.\n" + HAND.format("gamma")),
        ("p", "src/late.js", "javascript", "let a = 1\n/*\n * <auto-generated> tool: x 1.2 </auto-generated>\n */\n"), ("p", "src/quote.py", "python", 'BANNER = "Code generated by x. DO NOT EDIT."\n' + HAND.format("delta")),
        ("p", "src/talk.py", "python", "# Tests for the generated output of the builder.\n# this file is not generated, edit it freely\n" + HAND.format("eps")), ("p", "vendor/x/lib.py", "python", lib), ("p", "src/copy.py", "python", lib), ("q", "src/copy.py", "python", lib),
        ("p", "src/blob.py", "python", blob), ("p", "src/m.js", "javascript", mini), ("p", "x.min.js", "javascript", mini), ("p", "src/prompt.py", "python", 'PROMPT = "' + "word and more " * 90 + '"\n' + HAND.format("zeta")),
        ("p", "src/null.py", "python", None), ("p", "dist/null.js", "javascript", None), ("p", "src/empty.py", None, ""), ("p", "src/a.py", "python", HAND.format("alpha")),
        ("p", "src/c.js", "javascript", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\nexports.a = 1;\n'), ("p", "src/mit.go", "go", "/*\n * Part of the abc project, release 1.2. Redistributed under BSD-3-Clause.\n */\npackage a\n"),
    ]
    # What tools signed teaches the forest what their output looks like; the hand-written files around it are its opposite.
    files += [("r", f"src/signed{k}.js", "javascript", mini.replace("t[", f"t{k}[") + f"\n//# sourceMappingURL=m{k}.js.map\n") for k in range(12)]
    files += [("r", f"src/hand{k}.{x}", lang, "".join(HAND.format(f"name_{k}_{j}") for j in range(2 + k % 5))) for k in range(40) for x, lang in [("py", "python")]]
    df = spark.createDataFrame([(*f, None, 1.0) for f in files], "project_id string, path string, language string, content string, node_count int, score double")
    found = {(r["project_id"], r["path"]): r["reason"] for r in provenance.provenance(df).collect()}
    assert {k for k, v in found.items() if v and k[0] != "r"} == {("p", x) for x in ("src/gen.py", "src/late.js", "vendor/x/lib.py", "src/copy.py", "src/blob.py", "src/m.js", "x.min.js", "dist/null.js", "src/c.js", "src/mit.go")}
    assert found["p", "src/copy.py"] == "copy" and found["p", "src/blob.py"] == "machine" and found["p", "src/m.js"] == "machine"
    assert {k for k, v in found.items() if v and k[0] == "r"} == {("r", f"src/signed{k}.js") for k in range(12)}
    assert rows(provenance.provenance(df.limit(0))) == set()


def plainly_machine_made(text, language):
    """A judge of its own for the test: one very long dense line, or hardly any words outside of literals."""
    code, _, inside = provenance.split_text(text, language)
    longest = max((len(x) for x in code.split("\n")), default=0)
    solid = len("".join(code.split())) + inside
    letters = sum(len(w) for w in re.findall(r"\b[^\W\d]\w*", code))
    return (longest >= 200 and sum(c.isspace() for c in code) < 0.2 * len(code)) or (solid >= 300 and letters < 0.3 * solid)


def test_p7_forest_finds_files_of_held_out_projects(spark, data):
    from pyspark.sql import functions as F

    half = F.pmod(F.xxhash64("project_id"), F.lit(2))
    files = spark.read.parquet(data.replace("sf0.01", "sf0.1") + "/source_files.parquet").dropDuplicates(["project_id", "path"])
    truth = {(r["project_id"], r["path"]): plainly_machine_made(r["content"] or "", r["language"]) for r in files.collect()}
    every = provenance.measured(files).cache()
    scored = provenance.score(every.filter(half == 1), every.filter(half == 0)).filter(F.col("mark") == "").select("project_id", "path", "score").collect()
    found = [truth[r[0], r[1]] for r in scored if r["score"] >= provenance.MACHINE]
    wanted = sum(truth[r[0], r[1]] for r in scored)
    assert wanted > 30 and sum(found) >= 0.9 * wanted and sum(found) >= 0.95 * len(found)


def test_p7_made_examples_are_no_texts_of_the_corpus():
    from quern.llm.made_data import made_data

    made = made_data(70)
    assert made == made_data(70) and len({m[1] for m in made}) == 8 and all(len(m[0]) > 300 for m in made)


# ------------------------------------------------------------------ problem 8


def reference_encoding():
    import base64

    import tiktoken

    with open(f"{tokenization.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenization.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_p8_ids_are_the_tokenizers(spark, data):
    enc = reference_encoding()
    got = {r["doc_id"]: list(r["ids"]) for r in queries.p8_ids(spark, data).collect()}
    want = {r["doc_id"]: enc.encode_ordinary(r["text"]) if r["text"] else [] for r in load(data, "documents")}
    assert got == want
    assert all(enc.decode(ids) == (r["text"] or "") for r in load(data, "documents") for ids in [got[r["doc_id"]]])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab", min_size=0, max_size=60), st.none()), max_size=8))
def test_p8_any_text(texts):
    enc = reference_encoding()
    worker = tokenization.encoder(f"{tokenization.TOKENIZER_DIR}/{tokenization.VOCABULARY}")
    assert worker.encode(texts) == [enc.encode_ordinary(t) if t else [] for t in texts]


@pytest.mark.parametrize("name", ["letters", "blob", "same", "pair", "joined words", "no spaces"])
def test_p8_long_words(data, name):
    rnd = random.Random(name)
    texts = [r["text"] for r in load(data, "documents") if r["text"]]
    word = {
        "letters": lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)),
        "blob": lambda: "".join(rnd.choice("abcXYZ0189+/qwEF") for _ in range(200_000)),
        "same": lambda: "a" * 1_000_000,
        "pair": lambda: "=-" * 100_000,
        "joined words": lambda: "".join(w for t in texts[:200] for w in t.split() if w.isalpha() and w.isascii()),
        "no spaces": lambda: "".join(c for t in texts for c in t if ord(c) > 0x3000)[:60_000],
    }[name]()
    worker = tokenization.encoder(f"{tokenization.TOKENIZER_DIR}/{tokenization.VOCABULARY}")
    assert worker.encode([word, None, word[:70]]) == [reference_encoding().encode_ordinary(word), [], reference_encoding().encode_ordinary(word[:70])]
    assert not [w for w in worker.known if len(w) > tokenization.LONG]


def test_p8_forgets_and_goes_on(monkeypatch):
    enc = reference_encoding()
    monkeypatch.setattr(tokenization, "REMEMBERED", 3)
    worker = tokenization.Encoder(f"{tokenization.TOKENIZER_DIR}/{tokenization.VOCABULARY}")
    texts = ["one two three four", "four five <|endoftext|>", "a" * 20_000, "one six"]
    for _ in range(2):
        assert worker.encode(texts) == [enc.encode_ordinary(t) for t in texts]


# ------------------------------------------------------------------ problem 9


def brute_p9(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = leakage.words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leakage.words(t or "")] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def test_p9_found_is_brute_force(spark, data):
    docs, items = [(r["doc_id"], r["text"]) for r in load(data, "documents")], [(r["item_id"], r["item_text"]) for r in load(data, "eval_item")]
    assert rows(queries.p9_found(spark, data)) == brute_p9(docs, items)


def test_p9_longest_match(spark, data):
    docs, items = [(r["doc_id"], r["text"]) for r in load(data, "documents")], dict((r["item_id"], r["item_text"]) for r in load(data, "eval_item"))
    texts = dict(docs)
    found = leakage.leaks(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_item.parquet")).collect()
    for r in found:
        a, b = leakage.words(texts[r["doc_id"]]), leakage.words(items[r["item_id"]])
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, max(row))
        assert best == r["match_words"]


def test_p9_cases(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "x " + item.upper().replace(" ", ", ") + " y"), (2, item.replace("three", "thr\u00adee").replace("nine", "ni\u200bne")), (3, " ".join(item.split()[:11])), (4, None), (5, ""), (6, item.replace("four", "4")), (7, item + " " + item), (8, ("w " * 50_000) + item[:-9])]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, item), (2, item), (3, "too short"), (4, None), (None, item), (5, "caf\u00e9 " * 12)], "item_id long, item_text string")
    want = {(d, i) for d in (1, 2, 7, 8) for i in (1, 2)}
    for more in ({}, {"block_words": 13, "shard_words": 5}):
        assert {tuple(r)[:2] for r in leakage.leaks(df, items, **more).collect()} == want
    accents = spark.createDataFrame([(1, "cafe\u0301 " * 12), (2, "cafe " * 12)], "doc_id long, text string")
    assert {tuple(r) for r in leakage.leaks(accents, items).collect()} == {(1, 5, 12)}
    assert rows(leakage.leaks(df.limit(0), items)) == set() and rows(leakage.leaks(df, items.limit(0))) == set()
    assert {r[0] for r in leakage.clean(df, leakage.leaks(df, items)).select("doc_id").collect()} == {3, 4, 5, 6}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=3), min_size=1, max_size=6))
def test_p9_suffix_array_and_bounds(codes, probes):
    text = np.array(codes, dtype=np.int64)
    order = leakage.suffix_array(text, 3)
    assert sorted(order.tolist()) == list(range(len(codes)))
    assert all(codes[a : a + 3] <= codes[b : b + 3] for a, b in zip(order, order[1:]))
    lo, hi = leakage.bounds(text, order, np.array(probes, dtype=np.int64))
    for p, a, b in zip(probes, lo, hi):
        assert sorted(order[a:b].tolist()) == [i for i in range(len(codes)) if codes[i : i + 3] == p]


# ----------------------------------------------------------------- problem 10


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. No saw 3.5 MB vs. 4.1 MB. It failed?! Yes.", ["Dr. No saw 3.5 MB vs. 4.1 MB.", "It failed?!", "Yes."]),
        ("The answer is no. Run no. 3 of scope.py ends.The next, etc. begins.", ["The answer is no.", "Run no. 3 of scope.py ends.", "The next, etc. begins."]),
        ("“It is slow. It waits,” wrote Bo. The log said \"lost. Retrying...\" and then it ended.", ["“It is slow. It waits,” wrote Bo.", "The log said \"lost. Retrying...\" and then it ended."]),
        ("He asked “Why? How?” Then left.", ["He asked “Why? How?”", "Then left."]),
        ("An “open mark. It has no partner.\n\nThis” is another.", ["An “open mark.", "It has no partner.", "This” is another."]),
        ("# A head. Two\nBody\ngoes on. End\n\n- item one\n- item. Two\n1. three", ["A head.", "Two", "Body\ngoes on.", "End", "item one", "item.", "Two", "three"]),
        ("Am 8. Mai war z. B. der Puffer bzw. Nr. 6 usw. voll. „Alt. Das reicht“, schrieb er.", ["Am 8. Mai war z. B. der Puffer bzw. Nr. 6 usw. voll.", "„Alt. Das reicht“, schrieb er."]),
        ("写道：“很慢。它会重载。”缓存稳定。统计符号……然后停止。", ["写道：“很慢。它会重载。”", "缓存稳定。", "统计符号……然后停止。"]),
        ("X「遅いです。飛ばします。」と書きました。次です！", ["X「遅いです。飛ばします。」と書きました。", "次です！"]),
        ("ग्राफ “स्थिर है। वह है।” डॉ. X ने लिखा। क्या?", ["ग्राफ “स्थिर है। वह है।”", "डॉ. X ने लिखा।", "क्या?"]),
        ("ทำไมคิว แคชว่าง", ["ทำไมคิว", "แคชว่าง"]),
        ("¿Por qué? ¡La cola! El Sr. X, p. ej. Y.", ["¿Por qué?", "¡La cola!", "El Sr. X, p. ej. Y."]),
        ("См. рис. 3 и т. д. при А. Gallo. Почему?", ["См. рис. 3 и т. д. при А. Gallo.", "Почему?"]),
        ("a.\r\n\r\n```py\nx. Y. Z?\n\n# q\n```\nEnd. \n~~~\nopen. A", ["a.", "```py\nx. Y. Z?\n\n# q\n```", "End.", "~~~\nopen. A"]),
        ("It waits... and goes. logs, caches, etc. The end", ["It waits... and goes. logs, caches, etc.", "The end"]),
        ("The answer is no.Dr. Bo left, logs, etc.Set it.", ["The answer is no.", "Dr. Bo left, logs, etc.", "Set it."]),
        ("##\n\n- \n", []), ("", []), (" \n\u3000\t", []), ("no mark at all", ["no mark at all"]),
    ],
)
def test_p10_rules(text, want):
    assert [text[a:b] for a, b in sentences.spans(text)] == want


def test_p10_pieces_give_the_same(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    whole = rows(sentences.sentences(docs))
    assert rows(sentences.sentences(docs, 40)) == whole and rows(queries.p10_found(spark, data)) == whole


PIECES = st.lists(st.sampled_from(["A b. ", "“", "”", '"', "\n", "\n\n", "# H. x\n", "- i. Y\n", "```\n", "```ts\n", "etc. ", "no. 3 ", "Zz.Q ", "。", "ก ", "… ", "  ", "«", "»", "1. ", "т. д. ", "8. ", "Mai ", "\r\n", "   ", "\t"]), max_size=25).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES, st.integers(3, 30))
def test_p10_composition_is_exact(text, size):
    """Functions of the pieces, composed, give the state that reading the text gives."""
    kinds, starts, ends = sentences.tokens(text)
    joined = []
    for at, piece, fresh, heading in sentences.pieces(text, size):
        joined.append(sentences.tokens(piece, at, fresh, heading))
    shown = lambda ps: [(k, a) for p in ps for k, a in zip(p[0], p[1]) if k != sentences.CLASS["space"]]
    assert shown(joined) == shown([(kinds, starts)])
    sentences.pair(kinds)
    state = int(sentences.transition(kinds)[0])
    f = np.arange(len(sentences.machine()[0]))
    for i in range(0, len(kinds), 3):
        f = sentences.transition(kinds[i : i + 3])[f]
    assert int(f[0]) == state


def test_p10_long_texts_need_no_id_of_their_own(spark):
    text = "One is here. Two is “there. Here” too. " * 6 + "Last"
    other = "Another one. It is long enough to be cut. " * 4
    df = spark.createDataFrame([(None, text), (1, text), (1, other), (1, text)], "doc_id long, text string")
    whole = sorted(map(str, sentences.sentences(df).collect()))
    assert sorted(map(str, sentences.sentences(df, 40).collect())) == whole and len([r for r in whole if "doc_id=None" in r]) * 3 < len(whole)


def test_p10_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "One. Two.", 5), (4, "One. Two.", 5), (5, "Long one. " * 20_000, 5), (6, "x" * 200_000, 5)], "doc_id long, text string, char_start int")
    got = sentences.sentences(df)
    assert got.filter("doc_id = 5").count() == 20_000 and rows(got.filter("doc_id = 6")) == {(6, 0, 200_000)}
    assert rows(got.filter("doc_id < 5")) == {(d, a, b) for d in (3, 4) for a, b in ((0, 4), (5, 9))}
    assert rows(sentences.sentences(df.limit(0))) == set()


def test_p4_random_sessions(spark):
    """Random sessions, one with a third of all messages, give what checking them one by one gives."""
    import random

    r = random.Random(4)
    messages, parts = [], []
    for s in range(150):
        users = []
        for k in range(400 if s == 0 else r.randrange(0, 7)):
            mid = f"m{len(messages)}"
            clean = s == 0 or r.random() < 0.8
            role = ("user" if k % 2 == 0 else "assistant") if clean else "user" if not users or r.random() < 0.4 else r.choice(["assistant"] * 12 + ["system"])
            data = {"role": r.choice([role, role.upper(), f" {role}"])}
            if role == "assistant":
                data["parentID"] = users[-1] if clean and users else r.choice(users[-2:] + ["gone"])
                if not clean and r.random() < 0.3:
                    data["error"] = r.choice([None, {}])
            else:
                users.append(mid)
            text = json.dumps(data) if clean or r.random() < 0.9 else json.dumps(data)[:-2]
            for version in range(r.choice([1, 1, 2])):
                messages.append({"id": mid, "session_id": f"s{s}", "time_created": k if clean else k // 2, "time_updated": version, "data": text})
            for p in range(r.choice([1, 1, 1, 2]) if clean or r.random() < 0.9 else 0):
                odd = 0 if clean else 1
                body = {"type": r.choice(["text"] * 4 + ["tool"] * odd), "text": r.choice(["hi"] * 4 + [" ​"] * odd), **r.choice([{}] * 4 + [{"synthetic": True}] * odd)}
                parts.append({"id": f"{mid}p{p}", "message_id": mid, "session_id": f"s{s}", "time_created": k, "time_updated": 1, "data": json.dumps(body)})
    sessions = [{"id": f"s{s}"} for s in range(150) if s % 9 or s == 0]
    ddl = "id string, session_id string, time_created long, time_updated long, data string"
    m = spark.createDataFrame(messages, ddl).repartition(5)
    p = spark.createDataFrame(parts, "id string, message_id string, session_id string, time_created long, time_updated long, data string")
    got = rows(conversations.kept_turns(m, p, spark.createDataFrame(sessions, "id string")).select("session_id", "turn_no", "message_id"))
    want = brute_p4(messages, parts, sessions)
    assert got == want and len({x[0] for x in want}) > 20
