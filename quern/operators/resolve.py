"""Resolution of references to symbols: tiers of matches, first hit wins.

Candidates of a reference are never all paired with it. For names that many
symbols bear, candidates are reduced to the best one per (name, directory
prefix, language, callable) before the join, so a reference meets as many rows
as its path has directories, whatever the number of symbols of its name.

Symbols may have a column times: how many symbols the row stands for, of which
it has the least id; without it each row is one symbol.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.checkpoints import cut

CALLABLE = ("function", "method")
TYPES = ("class", "struct", "interface")
# What a reference's hit depends on, besides the symbols, and what all tiers but the lines of by_name ask of a symbol.
ASKED = ("name", "file_path", "language", "kind", "line", "receiver_type", "receiver_import")
LOOKED_AT = ("name", "qualified_name", "file_path", "language", "kind", "is_exported")
# Fixed size of the filter by hashes, which is broadcast.
SLOTS = 1 << 16


def directories(path: Column) -> Column:
    return F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)


def prefixes(path: Column) -> Column:
    """Every leading run of directories, the empty one included."""
    dirs = directories(path)
    return F.transform(F.sequence(F.lit(0), F.size(dirs)), lambda i: F.array_join(F.slice(dirs, F.lit(1), i), "/"))


def proximity(shared: Column) -> Column:
    """Points for so many shared leading directories."""
    return F.least(shared * 15, F.lit(80))


def kind_points(ref_kind: Column, kind: Column) -> Column:
    callable_, type_ = kind.isin(*CALLABLE), kind.isin(*TYPES)
    return F.when((ref_kind == "calls") & callable_, 25).when((ref_kind == "instantiates") & type_, 25).when((ref_kind == "decorates") & callable_, 25).when((ref_kind == "decorates") & kind.isin("class", "interface"), 15).otherwise(0)


def best_match(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, id, score, shared, n: the candidate of the greatest score per reference, ties by the least id; n candidates bear the name.

    refs: ref_id, name, file_path, language, kind, line; symbols: id, name, file_path, language, kind, is_exported, start_line.
    """
    return _best(refs, symbols).select("ref_id", "id", "score", "shared", "n")


def _counted(symbols: DataFrame) -> DataFrame:
    return symbols if "times" in symbols.columns else symbols.withColumn("times", F.lit(1))


def _near(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """rows without most of those that equal no row of other in on; some of them stay, as only hashes are compared.

    Drops them before the shuffle of a later join, whatever the size of other.
    """
    slot = F.pmod(F.xxhash64(*on), F.lit(SLOTS))
    return rows.withColumn("_slot", slot).join(F.broadcast(other.select(slot.alias("_slot")).distinct()), "_slot", "left_semi").drop("_slot")


def _best(refs: DataFrame, symbols: DataFrame, lined: DataFrame | None = None) -> DataFrame:
    """best_match with own: whether the languages are equal. lined: the symbols with their lines, if symbols has them without.

    Only references and candidates that differ in what gives points meet, each kind of reference once.
    """
    symbols, lined = _counted(symbols), symbols if lined is None else lined
    group = F.when(F.col("kind").isin(*CALLABLE), "callable").when(F.col("kind").isin("class", "interface"), "type").when(F.col("kind") == "struct", "struct").otherwise("other")
    sample = {"callable": "function", "type": "class", "struct": "struct", "other": "other"}
    named = symbols.join(refs.select("name").distinct(), "name", "left_semi").withColumn("group", group)
    kind = F.coalesce(*[F.when(F.col("group") == g, F.lit(k)) for g, k in sample.items()])
    own = F.col("language") == F.col("s_language")
    language = F.when(own, 50).otherwise(-80)
    exported = F.when(F.col("exported"), 10).otherwise(0)
    # Of a candidate that is met by several prefixes the longest gives the most, of equal scores the least id is kept.
    least = lambda points, shared: F.min(F.struct((-points.cast("double")).alias("s"), "id", (-shared).alias("h"), own.alias("own")))
    # The best of each (name, prefix, language, group): exported before not, then the least id.
    far = named.withColumn("prefix", F.explode(prefixes(F.col("file_path")))).groupBy("name", "prefix", "language", "group").agg(F.min(F.struct((~F.col("is_exported")).alias("hidden"), "id")).alias("best"))
    far = far.select("name", "prefix", F.col("language").alias("s_language"), "group", F.col("best.id").alias("id"), (~F.col("best.hidden")).alias("exported"))
    place = refs.withColumn("places", prefixes(F.col("file_path")))
    shared = F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", "/")))
    apart = place.select("name", "places", "language", "kind").distinct().withColumn("prefix", F.explode("places")).join(far, ["name", "prefix"])
    apart = apart.groupBy("name", "places", "language", "kind").agg(least(proximity(shared) + language + kind_points(F.col("kind"), kind) + exported, shared).alias("far"))
    apart = apart.join(named.groupBy("name").agg(F.sum("times").alias("n")), "name")
    # Candidates in the reference's own file get their points by line, at most one of each line, language, group and visibility.
    # There any of its own language beats all others, so it meets either only these or, if there are none, the rest without regard to language.
    asked = ["name", "file_path", "language", "kind", "line"]
    every = refs.select(*asked).distinct()
    lines = _near(lined, every, ["name", "file_path"]).withColumn("s_language", F.explode(F.array(F.struct("language"), F.lit(None).cast("struct<language:string>"))))
    lines = lines.filter("s_language IS NULL OR language IS NOT NULL").groupBy("name", "file_path", F.col("s_language.language").alias("s_language"), group.alias("group"), F.col("is_exported").alias("exported"), "start_line").agg(F.min("id").alias("id"))
    spoken = named.select("name", "file_path", "language").filter("language IS NOT NULL").distinct().withColumn("spoken", F.col("language"))
    every = every.join(spoken, ["name", "file_path", "language"], "left").withColumn("s_language", F.col("spoken")).drop("spoken")
    close = F.greatest(F.lit(0.0), 20 - F.abs(F.col("start_line") - F.col("line")) / 10)
    own_dirs = F.size(directories(F.col("file_path")))
    points = 100 + proximity(own_dirs) + language + kind_points(F.col("kind"), kind) + exported + F.when(F.col("start_line") > 0, close).otherwise(0.0)
    beside = _join(every, lines, ["name", "file_path"], ["s_language"]).groupBy(*asked).agg(least(points, own_dirs).alias("near"))
    met = _join(_join(place, apart, ["name", "places"], ["language", "kind"]), beside, ["name", "file_path"], ["language", "kind", "line"], "left")
    best = met.groupBy("ref_id").agg(F.min(F.least("far", "near")).alias("m"), F.sum("n").alias("n"))
    return best.select("ref_id", F.col("m.id").alias("id"), (-F.col("m.s")).alias("score"), (-F.col("m.h")).alias("shared"), "n", F.col("m.own").alias("own"))


def _join(rows: DataFrame, other: DataFrame, on: list[str], nullable: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of other on equal keys, among which those of nullable are also equal if both are null."""
    other = other.withColumnsRenamed({c: f"_{c}" for c in on + nullable})
    cond = reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in on] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in nullable])
    return rows.join(other, cond, how).drop(*[f"_{c}" for c in on + nullable])


def by_path(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Tier of references with a slash: the file itself (.95), one that ends so (.85), the only one of the name (.7)."""
    asked = refs.filter(F.contains("name", F.lit("/"))).withColumn("base", F.substring_index("name", "/", -1)).filter("base <> ''")
    met = asked.join(_counted(files).select("id", "times", F.col("name").alias("base"), F.col("file_path").alias("f_path")), "base")
    of = lambda cond: F.min(F.when(cond, F.col("id")))
    one = met.groupBy("ref_id").agg(of(F.col("f_path") == F.col("name")).alias("a"), of(F.endswith("f_path", F.col("name"))).alias("b"), F.when(F.sum("times") == 1, F.min("id")).alias("c"))
    return one.select("ref_id", F.coalesce("a", "b", "c").alias("id"), F.when(F.col("a").isNotNull(), 0.95).when(F.col("b").isNotNull(), 0.85).otherwise(0.7).alias("confidence"), F.lit("file-path").alias("by")).filter("id IS NOT NULL")


def by_qualified(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tier of qualified names: the only symbol of it (.95), else one whose qualified name ends so (.85).

    Symbols are reduced to one row per qualified name and per tail of it before the join, which is on the whole name, so
    a reference meets one row at most, whatever the number of symbols of its last word.
    """
    asked = refs.filter(F.contains("name", F.lit("::")) | F.contains("name", F.lit("."))).select("ref_id", "name", F.regexp_extract("name", r"([^:.]+)$", 1).alias("last"))
    alike = _counted(symbols).groupBy(F.col("name").alias("last"), "qualified_name").agg(F.sum("times").alias("n"), F.min("id").alias("id"))
    # What follows each '::', cut behind every one, also where they overlap; only a tail that is qualified itself can be asked for.
    pieces = F.split("qualified_name", "(?<=::)")
    tails = F.transform(F.sequence(F.lit(2), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), ""))
    tails = F.filter(tails, lambda t: F.contains(t, F.lit("::")) | F.contains(t, F.lit(".")))
    ends = alike.filter(F.size(pieces) > 1).select("last", F.explode(tails).alias("name"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("a"), F.col("id").alias("b"))
    known = alike.select("last", F.col("qualified_name").alias("name"), "n", F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(ends)
    known = known.groupBy("last", "name").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.min("b").alias("b"))
    one = asked.join(known, ["last", "name"]).groupBy("ref_id").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.min("b").alias("b"))
    sole = F.col("n") == 1
    return one.select("ref_id", F.when(sole, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(sole, 0.95).otherwise(0.85).alias("confidence"), F.lit("qualified-name").alias("by")).filter("id IS NOT NULL")


def words(text: Column) -> Column:
    """Words of more than one letter of a camel-case or qualified name, in lower case."""
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[\s._:/\\\\]+"), lambda w: F.length(w) > 1)


def by_method(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tier of receiver.method and Class::method: first hit of a method of the receiver's given type (.9), of the class so
    named (.85) or so named with a capital (.8), the only method of the language (.7), the one whose qualified name shares
    most words with the receiver, at least two with one for the language (.65); ties by the least id.

    refs may have receiver_type, the type inferred for the receiver, and receiver_import, the dotted name it is imported by.
    """
    for c in ("receiver_type", "receiver_import"):
        refs = refs if c in refs.columns else refs.withColumn(c, F.lit(None).cast("string"))
    form = r"^(\w+)(\.|::)(\w+)$"
    part = lambda i: F.regexp_extract("name", form, i)
    of_dot = F.when(part(2) == ".", F.col("receiver_type"))
    asked = refs.filter(F.col("name").rlike(form)).select("ref_id", "language", part(1).alias("receiver"), part(3).alias("method"), of_dot.alias("type"), "receiver_import")
    capital = F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)"))
    methods = _counted(symbols).filter("kind = 'method'").select(F.col("id").alias("m_id"), "times", F.col("name").alias("method"), "qualified_name", "file_path", F.col("language").alias("m_language")).join(asked.select("method").distinct(), "method", "left_semi")
    # 1: the type's own method; of several the one in the file that the import names.
    of_type = methods.select("m_id", "method", "file_path", F.col("m_language").alias("language"), F.regexp_extract("qualified_name", r"(?:^|::)([^:]+)::[^:]+$", 1).alias("type"), F.regexp_extract("qualified_name", "([^:]+)$", 1).alias("own")).filter("own = method")
    of_type = of_type.groupBy("type", "method", "language", "file_path").agg(F.min("m_id").alias("m_id"))
    path = F.concat(F.replace("receiver_import", F.lit("."), F.lit("/")), F.when(F.col("language") == "kotlin", ".kt").otherwise(".java"))
    typed = asked.filter("type IS NOT NULL")
    imports = typed.select("type", "method", "language", "receiver_import").distinct().join(of_type, ["type", "method", "language"])
    imports = imports.groupBy("type", "method", "language", "receiver_import").agg(F.min(F.when(F.endswith("file_path", path), F.col("m_id"))).alias("a"), F.min("m_id").alias("b"))
    told = _join(typed, imports, ["type", "method", "language"], ["receiver_import"]).groupBy("ref_id").agg(F.coalesce(F.min("a"), F.min("b")).alias("id"))
    # The other steps don't ask for more than receiver, method and language, so each call so written is looked up once.
    call = ["receiver", "method", "language"]
    calls = asked.select(*call).distinct()
    # 2, 3: methods in the file of a class whose qualified name holds the class's; a file's classes of one name count once, as do its methods of one.
    classes = symbols.filter(F.col("kind").isin(*TYPES)).groupBy(F.col("name").alias("class"), "file_path", "language").agg(F.min("id").alias("c_id"))
    classes = classes.join(calls.select(F.explode(F.array("receiver", capital)).alias("class")).distinct(), "class", "left_semi")
    own = methods.groupBy("file_path", "method", "qualified_name").agg(F.min("m_id").alias("m_id"))
    members = classes.join(own, "file_path").filter(F.contains("qualified_name", F.col("class"))).groupBy("class", "language", "method").agg(F.min(F.struct("c_id", "m_id"))["m_id"].alias("id"))
    named = calls.select(*call, F.posexplode(F.array_distinct(F.array("receiver", capital))).alias("no", "class")).join(members, ["class", "language", "method"])
    # 4: the only one of the language.
    per = methods.groupBy("method", F.col("m_language").alias("language")).agg(F.sum("times").alias("n"), F.min("m_id").alias("id"))
    only = calls.join(per.filter("n = 1"), ["method", "language"])
    # 5: a match shares a word at least, so methods meet on words; alike ones are reduced to the least id.
    alike = methods.groupBy("method", "m_language", F.array_sort(F.array_distinct(words(F.col("qualified_name")))).alias("ws")).agg(F.min("m_id").alias("m_id"))
    said = calls.select(*call, F.explode(words(F.col("receiver"))).alias("word"))
    score = F.count(F.lit(1)) + F.max(F.when(F.col("language") == F.col("m_language"), 1).otherwise(0))
    met = said.join(alike.withColumn("word", F.explode("ws")), ["method", "word"]).groupBy(*call, "m_language", "m_id").agg(score.alias("score"))
    # Methods of other languages count only where the language has none, and then only if there are several.
    count = methods.groupBy("method").agg(F.sum("times").alias("every"))
    open_ = met.join(per.select("method", "language", "n"), ["method", "language"], "left").join(count, "method").filter("score >= 2 AND every > 1 AND (n IS NULL OR m_language = language)")
    most = open_.groupBy(*call).agg(F.min(F.struct((-F.col("score")).alias("s"), "m_id"))["m_id"].alias("id"))
    hit = lambda df, keys, no, confidence, by: df.select(*keys, F.struct(F.lit(no).alias("step"), F.col("id"), F.lit(confidence).alias("confidence"), F.lit(by).alias("by")).alias("m"))
    steps = [hit(df, call, no, confidence, by) for no, (df, confidence, by) in enumerate([(named.filter("no = 0"), 0.85, "qualified-name"), (named.filter("no = 1"), 0.8, "instance-method"), (only, 0.7, "instance-method"), (most, 0.65, "instance-method")], 1)]
    # Cut, since the driver would hold the plan of all steps and tiers at once.
    found = cut(reduce(DataFrame.unionByName, steps).groupBy(*call).agg(F.min("m").alias("m")))
    rest = _join(asked, found, ["receiver", "method"], ["language"]).select("ref_id", "m")
    best = hit(told, ["ref_id"], 0, 0.9, "instance-method").unionByName(rest).groupBy("ref_id").agg(F.min("m").alias("m"))
    return best.select("ref_id", "m.id", "m.confidence", "m.by")


def by_name(refs: DataFrame, symbols: DataFrame, lined: DataFrame | None = None) -> DataFrame:
    """Tier of exact names: the only one (.9, .5 across languages), else the best (.7 if near, .4 if not). lined: as for _best."""
    best = _best(refs, symbols, lined)
    sole = F.when(F.col("own"), 0.9).otherwise(0.5)
    many = F.when(proximity(F.col("shared")) >= 30, 0.7).otherwise(0.4)
    kept = best.filter((F.col("n") == 1) | (F.col("score") > -1))
    return kept.select("ref_id", "id", F.when(F.col("n") == 1, sole).otherwise(many).alias("confidence"), F.lit("exact-match").alias("by"))


def by_lower_name(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tier of names without case among callables: the only one of the language (.5), else the only one (.3)."""
    low = _counted(symbols).filter(F.col("kind").isin("function", "method", "class")).select("id", "times", F.lower("name").alias("low"), F.col("language").alias("s_language"))
    per = low.groupBy("low", "s_language").agg(F.sum("times").alias("n"), F.min("id").alias("id"))
    every = low.groupBy("low").agg(F.sum("times").alias("every_n"), F.min("id").alias("every_id"))
    asked = refs.select("ref_id", F.lower("name").alias("low"), "language")
    met = asked.join(every, "low").join(per, (asked.low == per.low) & (asked.language == per.s_language), "left")
    own = F.col("n").isNotNull()
    return met.select("ref_id", F.when(own & (F.col("n") == 1), F.col("id")).when(~own & (F.col("every_n") == 1), F.col("every_id")).alias("id"), F.when(own, 0.5).otherwise(0.3).alias("confidence"), F.lit("fuzzy").alias("by")).filter("id IS NOT NULL")


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, id, confidence, by: the hit of the first tier that has one.

    References that ask for the same go through the tiers once, and symbols alike but for their line are one row. Both
    are cut, as every tier reads them.
    """
    of = [c for c in ASKED if c in refs.columns]
    asks = cut(refs.select(*of).distinct().withColumn("ref_id", F.monotonically_increasing_id()))
    alike = cut(_counted(symbols).groupBy(*LOOKED_AT).agg(F.min("id").alias("id"), F.sum("times").alias("times")))
    tiers = [by_path(asks, alike.filter("kind = 'file'")), by_qualified(asks, alike), by_method(asks, alike), by_name(asks, alike, symbols), by_lower_name(asks, alike)]
    ranked = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)])
    first = lambda df: df.groupBy("ref_id").agg(F.min(F.struct("tier", "id", "confidence", "by")).alias("m")).select("ref_id", "m.*")
    ask = F.struct(*of)  # fields that are both null are equal in structs
    found = asks.select("ref_id", ask.alias("ask")).join(first(ranked), "ref_id").drop("ref_id")
    return first(refs.select("ref_id", ask.alias("ask")).join(found.hint("shuffle_hash"), "ask")).drop("tier")


def arbitrate(options: DataFrame) -> DataFrame:
    """Of ref_id, id, confidence, strategy(no): the first strategy of .9 or more, else the most confident, ties by strategy."""
    sure = F.min(F.when(F.col("confidence") >= 0.9, F.struct("strategy", "id", "confidence")))
    most = F.min(F.struct((-F.col("confidence")).alias("c"), "strategy", "id", "confidence"))
    one = options.groupBy("ref_id").agg(sure.alias("a"), most.alias("b"))
    return one.select("ref_id", F.coalesce("a.id", "b.id").alias("id"), F.coalesce("a.confidence", "b.confidence").alias("confidence"), F.coalesce("a.strategy", "b.strategy").alias("strategy"))


def channel_edges(registered: DataFrame, dispatched: DataFrame, cap: int) -> DataFrame:
    """source, target, channel of dispatchers and handlers that meet on a channel; a channel with more than cap of either has none."""
    few = lambda df: df.groupBy("channel").agg(F.count_distinct("id").alias("n")).filter(F.col("n") <= cap).select("channel")
    on = registered.select("channel", F.col("id").alias("target")).distinct().join(few(registered), "channel", "left_semi")
    emit = dispatched.select("channel", F.col("id").alias("source")).distinct().join(few(dispatched), "channel", "left_semi")
    return emit.join(on, "channel").filter("source <> target").select("source", "target", "channel")


def first_family(families: list[DataFrame]) -> DataFrame:
    """source, target, family: the union of edge families, of an edge in several the first family's."""
    every = reduce(DataFrame.unionByName, [f.select("source", "target").withColumn("family", F.lit(i)) for i, f in enumerate(families)])
    return every.groupBy("source", "target").agg(F.min("family").alias("family"))


def containing_sets(stubs: DataFrame, candidates: DataFrame, shortest: int = 1) -> DataFrame:
    """stub, impl of the candidates whose set of method names holds all of the stub's; both (owner, method).

    Counts shared methods by joining on the method; a stub's pairs are the
    candidates that share its rarest method, so common names make no pairs.
    Stubs of the same methods are matched as one.
    """
    every = stubs.select(F.col("owner").alias("stub"), "method").distinct()
    c = candidates.select(F.col("owner").alias("impl"), "method").distinct()
    sets = every.groupBy("stub").agg(F.sort_array(F.collect_list("method")).alias("methods"), F.count(F.lit(1)).alias("need")).filter(F.col("need") >= shortest)
    alike = sets.groupBy("methods", "need").agg(F.min("stub").alias("first"))
    of = sets.select("stub", "methods").join(alike, "methods").select("stub", "first", "need")
    s = alike.select("first", F.explode("methods").alias("method"))
    often = c.groupBy("method").agg(F.count(F.lit(1)).alias("often"))
    rarest = s.join(often, "method").groupBy("first").agg(F.min(F.struct("often", "method"))["method"].alias("method"))
    pairs = rarest.join(c, "method").select("first", "impl")
    met = pairs.join(s, "first").join(c, ["impl", "method"]).groupBy("first", "impl").agg(F.count(F.lit(1)).alias("met"))
    return met.join(of, "first").filter("met = need AND stub <> impl").select("stub", "impl")


# What is tried after the path that an import names.
MODULE_ENDINGS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", ".py", "/__init__.py")


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, path, name, target of imports(project_id, path, language, name) whose file is in the project files(project_id, path).

    Relative names (./, ../, Python's leading dots, C's quoted includes) are taken from the importing file's folder, the
    rest from the project's root; of several endings that exist the first counts. Each import is a few candidate paths
    and one equi-join, whose other side is the file list.
    """
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    dots = F.length(F.regexp_extract("name", r"^\.*", 0))
    dotted = F.replace(F.regexp_replace("name", r"^\.+", ""), F.lit("."), F.lit("/"))
    # Python's first dot is the folder itself, each further one a step up.
    python = F.when(dots == 0, dotted).otherwise(F.concat_ws("/", folder, F.expr("repeat('../', length(regexp_extract(name, '^[.]*', 0)) - 1)"), dotted))
    here = F.concat_ws("/", folder, "name")
    raw = F.when(F.col("language") == "python", python).when(F.col("language") == "java", dotted).when(F.col("name").startswith(".") | (F.col("language") == "c"), here).otherwise(F.col("name"))
    step = lambda done, part: F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))
    plain = F.array_join(F.aggregate(F.split(raw, "/"), F.array().cast("array<string>"), step), "/")
    endings = F.array(*[F.lit(e) for e in (*MODULE_ENDINGS, ".java", ".go", ".rs", ".h")])
    tried = imports.select("project_id", "path", "name", plain.alias("at")).distinct().select("*", F.posexplode(endings).alias("n", "ending")).withColumn("target", F.concat("at", "ending"))
    known = files.select("project_id", F.col("path").alias("target")).distinct()
    met = tried.filter("target <> path").join(known, ["project_id", "target"])
    return met.groupBy("project_id", "path", "name").agg(F.min(F.struct("n", "target")).alias("one")).select("project_id", "path", "name", "one.target")
