"""Search and text queries over the fixture graph's names and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import python_text
from quern.functions import text as T
from quern.operators import search
from quern.plans.registry import registry
from quern.sources.fixture_graph import NODES_SQL, nodes
from quern.sources.tables import table

QUERIES, ORACLE, query = registry()

_N = NODES_SQL.rstrip().rstrip(",")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")


def _bm25_sql(prefixes: list[str]) -> str:
    values = ", ".join(f"('{p}')" for p in prefixes)
    words = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return rf"""t AS (SELECT id, {words('name')} AS a, {words('qualified_name')} AS b FROM nodes), s AS (SELECT id, a, b, list_distinct(list_filter(list_concat(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'),
 regexp_split_to_array(lower(regexp_replace(regexp_replace(qualified_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+')), lambda x: length(x) >= 2)) AS c FROM t JOIN nodes USING (id)),
l AS (SELECT id, len(a) + len(b) + len(c) AS len FROM s), p AS (SELECT * FROM (VALUES {values}) v(prefix)),
h AS (SELECT id, prefix, 20.0 * len(list_filter(a, lambda x: starts_with(x, prefix))) + 5.0 * len(list_filter(b, lambda x: starts_with(x, prefix))) + 3.0 * len(list_filter(c, lambda x: starts_with(x, prefix))) AS f FROM s, p),
n AS (SELECT prefix, count(*) AS n FROM h WHERE f > 0 GROUP BY 1), g AS (SELECT count(*) AS nn, avg(len) AS av FROM l),
bm AS (SELECT id, sum(greatest(ln((nn - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))) AS score, list(prefix) AS met FROM h JOIN n USING (prefix) JOIN l USING (id), g WHERE f > 0 GROUP BY id)"""


@query("search_x3_bm25", f"WITH {_N}, {_bm25_sql(['red', 'wid'])} SELECT id, round(score, 6) AS score FROM (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 100)")
def x3(spark, d):
    return search.bm25(search.with_search_text(nodes(spark, d)), "red wid", 20).select("id", F.round("score", 6).alias("score"))


def _described(spark, d):
    n = search.with_search_text(nodes(spark, d))
    return n.withColumns({"signature": F.concat("name", F.lit("("), "kind", F.lit(")")), "docstring": F.concat(F.lit("red of "), "file_path")})


#: The same with the words of signature (2) and docstring (1).
_FIVE = (
    _bm25_sql(["red", "wid"]).replace("AS b FROM nodes)", "AS b, list_filter(regexp_split_to_array(lower(name || '(' || kind || ')'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS sg, list_filter(regexp_split_to_array(lower('red of ' || file_path), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS dc FROM nodes)")
    .replace("SELECT id, a, b, list_distinct", "SELECT id, a, b, sg, dc, list_distinct").replace("len(a) + len(b) + len(c)", "len(a) + len(b) + len(c) + len(sg) + len(dc)")
    .replace("AS f FROM s, p", "+ 2.0 * len(list_filter(sg, lambda x: starts_with(x, prefix))) + 1.0 * len(list_filter(dc, lambda x: starts_with(x, prefix))) AS f FROM s, p")
)


@query("search_x3_bm25_five_columns", f"WITH {_N}, {_FIVE} SELECT id, round(score, 6) AS score FROM (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 100)")
def x3_five(spark, d):
    return search.bm25(_described(spark, d), "red wid", 20).select("id", F.round("score", 6).alias("score"))


@query("search_x2_prefix_groups", f"WITH {_N}, {_bm25_sql(['redwidget', 'red', 'widget'])} SELECT id FROM (SELECT id, score FROM bm WHERE list_contains(met, 'redwidget') OR (list_contains(met, 'red') AND list_contains(met, 'widget')) ORDER BY score DESC, id LIMIT 100)")
def x2(spark, d):
    return search.bm25(search.with_search_text(nodes(spark, d)), "redWidget", 20).select("id")


@query("search_t5_rescored_top", f"""WITH {_N}, {_bm25_sql(['red', 'wid'])}, f AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 100)
SELECT id, round(score + CASE kind WHEN 'function' THEN 10 WHEN 'method' THEN 10 WHEN 'class' THEN 8 WHEN 'field' THEN 3 WHEN 'module' THEN 4 ELSE 0 END
 + CASE WHEN contains(lower(name), 'red') AND contains(lower(name), 'wid') AND NOT starts_with(lower(name), 'redwid') THEN 15 WHEN starts_with(lower(name), 'redwid') THEN 40 ELSE 0 END, 6) AS score
FROM f JOIN nodes USING (id) ORDER BY score DESC, id LIMIT 20""")
def t5(spark, d):
    n = search.with_search_text(nodes(spark, d))
    return search.rescored(n, search.bm25(n, "red wid", 20), "red wid", 20).select("id", F.round("score", 6).alias("score"))


@query("search_x4_like", f"WITH {_N} SELECT id, CAST(CASE WHEN name ILIKE 'idge%' THEN 0.9 WHEN name ILIKE '%idge%' THEN 0.8 WHEN qualified_name ILIKE '%idge%' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS score FROM nodes WHERE name ILIKE '%idge%' OR qualified_name ILIKE '%idge%' ORDER BY score DESC, length(name), id LIMIT 40")
def x4(spark, d):
    return search.like(nodes(spark, d), "idge", 40)


@query("search_x5_fuzzy", f"WITH {_N}, c AS (SELECT DISTINCT name, levenshtein(lower(name), 'red widgit') AS d FROM nodes), r AS (SELECT id, name, d, row_number() OVER (PARTITION BY name ORDER BY id) AS p FROM nodes JOIN (SELECT * FROM c WHERE d <= 2 ORDER BY d, name LIMIT 60) USING (name)) SELECT id, 1.0::DOUBLE / (1 + d) AS score FROM r WHERE p <= 5 ORDER BY d, name, id LIMIT 30")
def x5(spark, d):
    return search.fuzzy(nodes(spark, d), "red widgit", 30)


@query("search_x6_edit_distance", "SELECT p_partkey, CASE WHEN levenshtein(p_name, 'blue ring') <= 4 THEN levenshtein(p_name, 'blue ring') END AS distance FROM part")
def x6(spark, d):
    distance = F.levenshtein("p_name", F.lit("blue ring"), 4)
    return table(spark, d, "part").select("p_partkey", F.when(distance >= 0, distance).cast("long").alias("distance"))


@query("search_x15_exact_names", f"WITH {_N}, m AS (SELECT id, lower(name) AS n, file_path FROM nodes WHERE lower(name) IN ('nation_3', 'red widget')), f AS (SELECT DISTINCT n, file_path FROM m), r AS (SELECT n FROM f GROUP BY n HAVING count(*) < 10), k AS (SELECT DISTINCT file_path FROM f JOIN r USING (n)), s AS (SELECT id, n, 1.0 + CASE WHEN k.file_path IS NULL THEN 0 ELSE 20 END AS score FROM m LEFT JOIN k USING (file_path)), w AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS p FROM s) SELECT id, CAST(score AS DOUBLE) AS score FROM w WHERE p <= 15 ORDER BY score DESC, id LIMIT 30")
def x15(spark, d):
    return search.exact_names(nodes(spark, d), ["NATION_3", "red widget"], 30)


@query("search_x1_ladder")
def x1(spark, d):
    """Three queries that stop at different steps of the ladder: words, substring, edit distance."""
    n = nodes(spark, d)
    runs = [search.search(n, q, 10).withColumn("query", F.lit(q)) for q in ("red widget kind:field", "idge path:brand#1", "NATIOM_7")]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("query", "id", F.round("score", 6).alias("score"))


@query("search_p2_filters_only", f"WITH {_N} SELECT id FROM nodes WHERE kind IN ('class', 'module') ORDER BY name, id LIMIT 15")
def p2(spark, d):
    return nodes(spark, d).filter("kind IN ('class', 'module')").orderBy("name", "id").limit(15).select("id")


@query("search_p4_lower_name", f"WITH {_N} SELECT id FROM nodes WHERE lower(name) = 'nation_4'")
def p4(spark, d):
    return nodes(spark, d).filter(F.lower("name") == "nation_4").select("id")


@query("search_p5_substring", f"WITH {_N} SELECT id FROM nodes WHERE name ILIKE '%ri%' AND name NOT ILIKE 'ri%' ORDER BY length(name), id LIMIT 30")
def p5(spark, d):
    return search.by_substring(nodes(spark, d), "ri", 30, beyond_prefix=True)


@query("search_p6_glob", f"WITH {_N} SELECT id FROM nodes WHERE regexp_full_match(qualified_name, 'ECONOMY::.*w.dget')")
def p6(spark, d):
    return search.by_glob(nodes(spark, d), "ECONOMY::*w?dget").select("id")


@query("search_p14_low_value", f"WITH {_N} SELECT id FROM nodes WHERE regexp_matches(lower(file_path), '(?:^|/)(?:tests?|__tests?__|spec)/')")
def p14(spark, d):
    return nodes(spark, d).filter(T.is_low_value(F.col("file_path"))).select("id")


@query("search_p15_test_files", f"WITH {_N} SELECT id FROM nodes WHERE starts_with(file_path, 'tests/')")
def p15(spark, d):
    return nodes(spark, d).filter(T.is_test_file(F.col("file_path"))).select("id")


@query("search_x9_identifier_words", r"SELECT p_partkey, array_to_string(list_distinct_ordered, ' ') AS words FROM (SELECT p_partkey, list_filter(regexp_split_to_array(lower(replace(p_brand, '#', 'No') || p_type), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS list_distinct_ordered FROM part)")
def x9(spark, d):
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("no")), F.lower("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.words_of(name), " ").alias("words"))


@query("search_x10_search_text", f"WITH {_N} SELECT id, replace(lower(name), '#', ' ') AS t FROM nodes WHERE kind = 'method'")
def x10(spark, d):
    return nodes(spark, d).filter("kind = 'method'").select("id", T.search_text(F.col("name"), F.lit(None).cast("string")).alias("t"))


@query("search_x12_name_bonus", f"WITH {_N} SELECT id, CAST(CASE WHEN lower(name) = 'nation_1' THEN 80 WHEN starts_with(lower(name), 'nation_1') THEN floor(10 + 30 * 8 / length(name) + 0.5) WHEN contains(lower(name), 'nation') AND contains(lower(name), '1') AND false THEN 15 WHEN contains(lower(name), 'nation_1') THEN 10 ELSE 0 END AS BIGINT) AS bonus FROM nodes WHERE kind = 'class'")
def x12(spark, d):
    return nodes(spark, d).filter("kind = 'class'").select("id", search.name_bonus(F.col("name"), "NATION_1").cast("long").alias("bonus"))


@query("search_x13_kind_bonus", f"WITH {_N} SELECT kind, CAST(CASE kind WHEN 'module' THEN 4 WHEN 'class' THEN 8 WHEN 'method' THEN 10 WHEN 'function' THEN 10 WHEN 'field' THEN 3 END AS INTEGER) AS bonus FROM nodes GROUP BY kind")
def x13(spark, d):
    return nodes(spark, d).select("kind").distinct().select("kind", T.kind_bonus(F.col("kind")).alias("bonus"))


@query("search_x14_distinctive", f"WITH {_N} SELECT id FROM nodes WHERE regexp_matches(name, '[_0-9]') OR regexp_matches(name, '^.+[A-Z]')")
def x14(spark, d):
    return nodes(spark, d).filter(T.is_distinctive(F.col("name"))).select("id")


@query("search_x11_path_relevance", f"WITH {_N} SELECT DISTINCT file_path, CAST(CASE WHEN contains(lower(regexp_extract(file_path, '[^/]*$')), 'nation') THEN 10 ELSE 0 END + CASE WHEN contains(lower(regexp_replace(file_path, '/[^/]*$', '')), 'asia') THEN 5 WHEN contains(lower(file_path), 'asia') THEN 3 ELSE 0 END + CASE WHEN contains(lower(regexp_extract(file_path, '[^/]*$')), 'asia') THEN 10 ELSE 0 END + CASE WHEN contains(lower(regexp_replace(file_path, '/[^/]*$', '')), 'nation') THEN 5 WHEN contains(lower(file_path), 'nation') THEN 3 ELSE 0 END - CASE WHEN starts_with(file_path, 'tests/') THEN 15 ELSE 0 END AS INTEGER) AS score FROM nodes")
def x11(spark, d):
    return nodes(spark, d).select("file_path").distinct().select("file_path", T.path_relevance(F.col("file_path"), ["nation", "asia"], False).alias("score"))


def _stems_sql() -> str:
    cut = lambda k: f"left(w, length(w) - {k})"
    doubled = lambda b: f"CASE WHEN length({b}) >= 2 AND right({b}, 1) = left(right({b}, 2), 1) THEN left({b}, length({b}) - 1) END"
    ing, er, ed = "(w LIKE '%ing' AND length(w) > 5)", "(w LIKE '%er' AND length(w) > 4)", "(w LIKE '%ed' AND w NOT LIKE '%eed' AND length(w) > 4)"
    when = lambda c, x: f"CASE WHEN {c} THEN {x} END"
    forms = [
        when(ing, cut(3)), when(ing, cut(3) + " || 'e'"), when(ing, doubled(cut(3))), when("(w LIKE '%tion' OR w LIKE '%sion') AND length(w) > 5", cut(3)), when("w LIKE '%ment' AND length(w) > 6", cut(4)),
        f"CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN {cut(3)} || 'y' WHEN w LIKE '%es' AND length(w) > 4 THEN {cut(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 4 THEN {cut(1)} END",
        when(ed, cut(1)), when(ed, cut(2)), when(f"{ed} AND w LIKE '%ied' AND length(w) > 5", cut(3) + " || 'y'"), when(er, cut(2)), when(er, cut(2) + " || 'e'"), when(er, doubled(cut(2))),
    ]
    return f"""WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT w, list_filter([{", ".join(forms)}], lambda v: v IS NOT NULL AND length(v) >= 3 AND v <> w) AS l FROM t WHERE regexp_full_match(w, '[a-z]+'))
SELECT w, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ' ') AS stems FROM f WHERE len(l) > 0"""


@query("search_x7_stems", _stems_sql())
def x7(spark, d):
    words = documents(spark, d).select(F.explode(search.terms(F.col("text"))).alias("w")).filter(F.col("w").rlike("^[a-z]+$")).distinct()
    return words.select("w", F.array_join(T.stem_variants(F.col("w")), " ").alias("stems")).filter("stems <> ''")


@query("search_x8_terms")
def x8(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(T.search_terms(F.col("text")), " ").alias("terms"))


@query("search_x19_low_confidence", f"WITH {_N} SELECT kind, NOT bool_or(regexp_matches(name, '[_0-9]') OR regexp_matches(name, '^.+[A-Z]')) AS low FROM nodes WHERE name ILIKE '%a%' GROUP BY 1")
def x19(spark, d):
    return nodes(spark, d).filter(F.col("name").ilike("%a%")).groupBy("kind").agg((~F.max(T.is_distinctive(F.col("name")))).alias("low"))


@query("search_x21_retrieval_quality", f"""WITH {_N}, e AS (SELECT * FROM (VALUES ('red', 'part:1'), ('red', 'part:4'), ('blue', 'part:2')) v(q, id)), h AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY id) AS rank FROM (SELECT 'red' AS q, id FROM nodes WHERE name ILIKE 'red%' UNION ALL SELECT 'blue', id FROM nodes WHERE name ILIKE 'blue%'))
SELECT e.q, round(count(h.id) * 1.0 / count(*), 4) AS recall, round(coalesce(max(1.0 / h.rank), 0), 6) AS mrr FROM e LEFT JOIN h ON h.q = e.q AND h.id = e.id GROUP BY 1""")
def x21(spark, d):
    from pyspark.sql import Window

    expected = spark.createDataFrame([("red", "part:1"), ("red", "part:4"), ("blue", "part:2")], "q string, id string")
    n = nodes(spark, d)
    hits = n.filter(F.col("name").ilike("red%")).select(F.lit("red").alias("q"), "id").unionByName(n.filter(F.col("name").ilike("blue%")).select(F.lit("blue").alias("q"), "id"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("id")))
    return expected.join(ranked, ["q", "id"], "left").groupBy("q").agg(F.round(F.count("rank") / F.count(F.lit(1)), 4).alias("recall"), F.round(F.coalesce(F.max(1 / F.col("rank")), F.lit(0.0)), 6).alias("mrr"))


@query("search_x22_sequence", """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS no, unnest(x) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\n') AS x FROM documents WHERE text IS NOT NULL)), w AS (SELECT doc_id, no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY no) AS nxt FROM l),
p AS (SELECT doc_id, no, CASE WHEN line = '# done. Next. Run?' AND nxt = '```' THEN 0 WHEN rtrim(line, chr(13) || ' ' || chr(9)) = '# done. Next. Run?' AND rtrim(nxt, chr(13) || ' ' || chr(9)) = '```' THEN 1 END AS pass FROM w)
SELECT doc_id AS doc, CAST(arg_min(no, (pass, no)) AS INTEGER) AS "at", CAST(min(pass) AS INTEGER) AS pass FROM p WHERE pass IS NOT NULL GROUP BY 1""")
def x22(spark, d):
    lines = documents(spark, d).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return search.find_sequence(lines, ["# done. Next. Run?", "```"])


@query("search_s14_line_search", """SELECT doc_id, CAST(no AS INTEGER) AS no, line FROM (SELECT doc_id, unnest(range(len(x))) AS no, unnest(x) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\n') AS x FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(line, 'retry [a-z]+ after|v[0-9]+\\.[0-9]+')""")
def s14(spark, d):
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.filter(F.col("line").rlike(r"retry [a-z]+ after|v[0-9]+\.[0-9]+"))


@query("search_t7_grep_newest", """WITH h AS (SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n')) AS line FROM documents WHERE text IS NOT NULL) WHERE contains(line, 'cursor') GROUP BY 1)
SELECT doc_id, hits, (SELECT count(*) FROM h) - 25 AS hidden FROM h JOIN documents USING (doc_id) ORDER BY created_at DESC, doc_id LIMIT 25""")
def t7(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", "created_at")
    hits = docs.select("doc_id", "created_at", F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("cursor")))).cast("long").alias("hits")).filter("hits > 0")
    total = hits.agg((F.count(F.lit(1)) - 25).alias("hidden"))
    return hits.orderBy(F.desc("created_at"), "doc_id").limit(25).join(F.broadcast(total)).select("doc_id", "hits", "hidden")


@query("text_f1_token_estimate", "SELECT doc_id, CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def f1(spark, d):
    return documents(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("text_f2_token_ceiling", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def f2(spark, d):
    return documents(spark, d).select("doc_id", T.token_ceiling(F.col("text")).alias("tokens"))


@query("text_a19_prompt_blocks", "SELECT doc_kind, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, min(substr(sha256(text), 1, 16)) AS fingerprint FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a19(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter("text IS NOT NULL").groupBy("doc_kind").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.length(t)).alias("chars"), F.sum(F.octet_length(t)).alias("bytes"), F.sum(T.token_ceiling(t)).alias("tokens"), F.min(F.substring(F.sha2(t, 256), 1, 16)).alias("fingerprint")
    )


@query("text_f3_redaction")
def f3(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(T.redact_secrets(F.col("text")), 256).alias("redacted"))


@query("text_f4_secret_detection", r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\bauthorization\s*[:=]\s*(?:bearer\s+)?[^\s,;]+') OR regexp_matches(text, '(?i)\b(?:api[_-]?key|client[_-]?secret|password|passwd|secret|session[_-]?token|access[_-]?token|refresh[_-]?token)\b\s*[:=]\s*["'']?[^\s,"'';]{8,}')
OR regexp_matches(text, '\b(?:sk-[A-Za-z0-9_-]{16,}|github_pat_[A-Za-z0-9_]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16}|xox[baprs]-[A-Za-z0-9-]{10,})\b')
OR len(list_filter(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{40,}'), lambda x: NOT regexp_full_match(x, '[A-Fa-f0-9]+') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]'))) > 0""")
def f4(spark, d):
    return documents(spark, d).filter(T.contains_secret(F.col("text"))).select("doc_id")


@query("text_f5_clean", r"SELECT doc_id, sha256(substr(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')), 1, 300)) AS cleaned FROM documents WHERE text IS NOT NULL")
def f5(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("cleaned"))


@query("text_f6_provenance", r"""SELECT d.doc_id, len(list_filter(regexp_extract_all(lower(e.item_text), '[\p{L}\p{N}_-]{4,}'), lambda x: contains(lower(d.text), x))) > 0 AS supported FROM documents d, (SELECT min(item_text) AS item_text FROM eval_item) e WHERE d.text IS NOT NULL""")
def f6(spark, d):
    item = table(spark, d, "eval_item").agg(F.min("item_text").alias("item"))
    return documents(spark, d).join(F.broadcast(item)).select("doc_id", T.supported_by(F.col("item"), F.col("text")).alias("supported"))


@query("text_f8_citations", r"""WITH t AS (SELECT doc_id, text, text || chr(10) || '<memory-citation version=1><entries>' || chr(10) || 'project/a.md:3-5 | note=[x]' || chr(10) || '/bad:1-2 | note=[y]' || chr(10) || '</entries></memory-citation>' || chr(10) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_replace(regexp_replace(t, '(?is)<memory-citation\b[^>]*>.*?(?:</memory-citation\s*>|\z)', '', 'g'), '[ \t\n\x0b\f\r]+\z', '') = regexp_replace(text, '[ \t\n\x0b\f\r]+\z', '') AS restored,
CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\s*(global|project)/[^\r\n:]*:[0-9]+-[0-9]+\s*\|\s*note=\[[^\r\n]*\]\s*$'))) AS INTEGER) AS entries FROM t""")
def f8(spark, d):
    t = F.concat("text", F.lit("\n<memory-citation version=1><entries>\nproject/a.md:3-5 | note=[x]\n/bad:1-2 | note=[y]\n</entries></memory-citation>\n"))
    return documents(spark, d).select("doc_id", (T.strip_citations(t) == F.regexp_replace("text", r"\s+\z", "")).alias("restored"), F.size(T.citation_entries(t)).alias("entries"))


@query("text_f9_head_lines", """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, i, sum(strlen(ls[i]) + CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS bytes FROM l, unnest(range(1, len(ls) + 1)) t(i)),
k AS (SELECT doc_id, count(*) FILTER (i <= 20 AND bytes <= 500) AS n, coalesce(max(bytes) FILTER (i <= 20 AND bytes <= 500), 0) AS b, coalesce(bool_or(bytes > 500) FILTER (i <= 20), false) AS hit FROM x GROUP BY 1)
SELECT doc_id, CAST(length(array_to_string(ls[1:n], chr(10))) AS INTEGER) AS kept, CAST(CASE WHEN hit THEN strlen(text) - b ELSE len(ls) - n END AS INTEGER) AS removed, CASE WHEN hit THEN 'bytes' ELSE 'lines' END AS unit FROM l JOIN k USING (doc_id)""")
def f9(spark, d):
    return documents(spark, d).select("doc_id", T.head_lines(F.col("text"), 20, 500).alias("h")).select("doc_id", F.length("h.kept").alias("kept"), "h.removed", "h.unit")


@query("text_f10_line_hash")
def f10(spark, d):
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.select("doc_id", "no", python_text.line_hash("no", "line").alias("hash"))


@query("text_f11_file_hash", "SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS hash FROM documents WHERE text IS NOT NULL")
def f11(spark, d):
    return documents(spark, d).select("doc_id", T.file_hash(F.col("text")).alias("hash"))


@query("text_f12_html_text")
def f12(spark, d):
    """Documents wrapped as pages; the text comes back without the script."""
    page = F.concat(F.lit("<html><script>var x = 1 < 2</script><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></html>"))
    return documents(spark, d).select("doc_id", F.sha2(python_text.html_text(page), 256).alias("hash"))
