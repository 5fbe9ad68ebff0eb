"""Source files that nobody on the project wrote by hand (problem 7).

1. Marks: notices in comments (of generators, bundlers and third parties),
   marked paths and names, and the prologue of compiled modules.
2. A random forest on statistics of the text (compression ratio, token
   entropy, identifier lengths, comment density, line shape), from which
   comments with notices are removed. Its labels are the notices alone: files
   that a tool signed in a comment against files without any mark; paths and
   notices of third parties, whose code somebody did write, label nothing. As
   no tool signs data written as code, made examples of it (MADE) join the
   labelled. Unmarked files aren't all hand-written: those that a first forest
   suspects are left out when the second is fitted. Both are fitted on a
   bounded sample (TRAIN_ROWS); every file is scored.
3. Found are marked files, exact copies of a third party's file within a
   project, and every file that the forest scores MACHINE or more.

Only fixed-size statistics leave the Arrow pass, never texts; copies meet by
hash.

Defined results: a null content has only its path to show; an empty text is
hand-written unless its path says otherwise; null node counts are a value of
their own; repeated rows give one row; without any unmarked file there is
nothing to learn and every score is 0.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT  # noqa: F401  (registers the vector type)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.made_data import made_data
from quern.plans.checkpoints import cut
from quern.plans.partitioning import spread

#: Rows of each label that the forest is fitted on, in expectation.
TRAIN_ROWS = 20_000
#: Made examples of data written as code.
MADE = 500
#: Weight of the made examples as a share of the unmarked files'.
MADE_SHARE = 0.25
#: Score of the first forest from which an unmarked file is no example of hand-written code.
SUSPECT = 0.2
#: Score from which a file is found; chosen on held-out projects.
MACHINE = 0.5
#: Texts with fewer characters are too short for their statistics to say anything.
SHORT = 200

# Words by which tools and third parties sign their files.
GENERATED_NOTICE = re.compile(
    r"(?i)^(?:code generated\b.*do not edit|generated by\b|generated from\b|@generated\b|@autogenerated\b|auto-?generated (?:file|on|by|from|code)\b|autogenerated$|<auto-?generated>|"
    r"(?:this (?:file|code|module|class) (?:was|is|has been) )(?:auto(?:matically)?[- ]?)?generated\b|do not edit\b|do not modify\b|automatisch (?:erzeugt|generiert) (?:von|durch|aus)\b|"
    r"produced by\b.*edits? (?:are|will be) lost|machine[- ](?:written|generated) by\b|[#@] ?sourcemappingurl=|bundled (?:by|with)\b|minified (?:by|with)\b|compiled (?:by|from|with)\b|transpiled (?:by|from)\b)"
)
THIRD_PARTY_NOTICE = re.compile(
    r"(?i)(?:^part of the \S+ project, release\b.*redistributed\b|^copied unchanged from\b|\bupstream copy\b|^\S+ v?\d[\w.\-]* \| \(c\)|^vendored from\b|^copied verbatim from\b|^@license \S+ v?\d)"
)
THIRD_PARTY_DIRS = frozenset("vendor vendored third_party third-party thirdparty node_modules bower_components external deps site-packages jspm_packages godeps".split())
GENERATED_DIRS = frozenset("__generated__ generated build dist".split())
GENERATED_NAME = re.compile(r"(?i)(?:[.\-_]min\.(?:js|mjs|cjs|ts|css)|\.(?:g|gen|generated|designer)\.\w+|_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.\w+|\.bundle\.js|\.chunk\.js|[._]generated\.\w+)$")
COMPILED = re.compile(r"""\A\s*(?:["']use strict["'];?\s*)?(?:Object\.defineProperty\(\s*exports\s*,\s*["']__esModule["']|var __create = Object\.create|/\*{6}/ ?\(\(\) => \{)""")

_C_LIKE = re.compile(r"""(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<com>//[^\n]*|/\*.*?(?:\*/|\Z))""", re.S)
_PY_LIKE = re.compile(r"""(?P<str>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<com>\#[^\n]*)""", re.S)
_XML_LIKE = re.compile(r"(?P<com><!--.*?(?:-->|\Z))", re.S)
_COMMENT_EDGE = re.compile(r"^[\s/*#!;<\-]*|[\s*/\->]*$")
_WORD = re.compile(r"\b[^\W\d]\w*")
_TOKEN = re.compile(r"\w+|[^\w\s]")

FEATURES = [
    "log_size", "compression", "char_entropy", "token_entropy", "word_length", "short_words", "comment_density", "longest_line", "mean_line", "space_share", "digit_share", "word_share", "string_share", "nodes_per_kb", "distinct_words",
]
_NUMBERS = [(f, pa.float64()) for f in FEATURES]
_SCHEMA = pa.schema([("project_id", pa.string()), ("path", pa.string()), ("mark", pa.string()), ("noticed", pa.bool_()), ("digest", pa.binary()), *_NUMBERS])
_DDL = "project_id string, path string, mark string, noticed boolean, digest binary, " + ", ".join(f"{f} double" for f in FEATURES)


def _entropy(counts: Counter) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def notice(comment: str) -> str:
    """'generated', 'third_party' or '' for the text of one comment."""
    for line in comment.split("\n"):
        said = _COMMENT_EDGE.sub("", line) if not line.lstrip("/*# !").startswith("<") else line.strip("/*# !")
        if GENERATED_NOTICE.search(said) or GENERATED_NOTICE.search("#" + said if said.lower().startswith("sourcemappingurl=") else said):
            return "generated"
        if THIRD_PARTY_NOTICE.search(said):
            return "third_party"
    return ""


def path_mark(path: str | None) -> str:
    *dirs, name = (path or "").replace("\\", "/").split("/")
    low = {d.lower() for d in dirs}
    if low & THIRD_PARTY_DIRS:
        return "third_party"
    return "generated" if low & GENERATED_DIRS or GENERATED_NAME.search(name) else ""


def split_text(text: str, language: str | None) -> tuple[str, list[str], int]:
    """(code with strings emptied, comments, characters of strings without white space, which aren't prose)."""
    kind = (language or "").strip().lower()
    pattern = _PY_LIKE if kind == "python" else _XML_LIKE if kind == "xml" else _C_LIKE
    comments: list[str] = []
    inside = 0

    def take(m: re.Match) -> str:
        nonlocal inside
        if m.lastgroup == "com":
            comments.append(m[0])
            return ""
        body = m[0].strip("\"'`")
        inside += 0 if any(map(str.isspace, body)) else len(body)
        return m[0][:1] * 2

    return pattern.sub(take, text), comments, inside


def measure(text: str, language: str | None, nodes: int | None) -> tuple[str, bool, list[float]]:
    """(mark, whether a tool's notice gave it, features) of a text."""
    code, comments, inside = split_text(text, language)
    said = [notice(c) for c in comments]
    mark = next((m for m in ("third_party", "generated") if m in said), "")
    noticed = mark == "generated"
    shown = text
    for c, m in zip(comments, said):
        if m:
            shown = shown.replace(c, "")
    if mark == "" and COMPILED.search(code_head(text)):
        mark = "generated"
    lines = [x for x in code.split("\n") if x.strip()]
    longest = max(map(len, lines), default=0)
    words = _WORD.findall(code)
    solid = len(re.sub(r"\s+", "", code)) + inside
    letters = sum(map(len, words))
    n = max(len(shown), 1)
    raw = shown.encode("utf-8", "surrogatepass")
    spaces = sum(map(str.isspace, code)) / max(len(code), 1)
    features = [
        math.log1p(len(shown)), len(zlib.compress(raw, 6)) / max(len(raw), 1), _entropy(Counter(shown)), _entropy(Counter(_TOKEN.findall(code))), letters / max(len(words), 1), sum(len(w) <= 2 for w in words) / max(len(words), 1),
        sum(len(c) for c, m in zip(comments, said) if not m) / n, float(longest), sum(map(len, lines)) / max(len(lines), 1), spaces, sum(map(str.isdigit, shown)) / n, letters / max(solid, 1), inside / n,
        -1.0 if nodes is None else nodes * 1000 / n, len(set(words)) / max(len(words), 1),
    ]
    return mark, noticed, features


def code_head(text: str) -> str:
    """The text without its leading comments."""
    return re.sub(r"\A(?:\s+|//[^\n]*|/\*.*?\*/)+", "", text, flags=re.S)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _SCHEMA]
        for project, path, language, nodes, text in zip(*(c.to_pylist() for c in batch.columns)):
            mark, noticed, features = measure(text or "", language, nodes)
            by_path = path_mark(path)
            both = "third_party" if "third_party" in (by_path, mark) else mark or by_path
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest() if text and text.strip() else None
            for c, x in zip(out, (project, path, both, noticed, digest, *features)):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA)], schema=_SCHEMA)


def measured(files: DataFrame) -> DataFrame:
    """One row per file and distinct text: project_id, path, mark, noticed, digest and the features."""
    return spread(files.select("project_id", "path", "language", "node_count", "content")).mapInArrow(_measure, _DDL)


@lru_cache(maxsize=1)
def _made() -> list[tuple]:
    return [(1.0, *measure(text, language, nodes)[2]) for text, language, nodes in made_data(MADE)]


def _forest(sample: DataFrame, trees: int) -> RandomForestClassificationModel:
    # Shallow trees with full leaves: notices on code like any other are noise that deeper trees would learn by heart.
    return RandomForestClassifier(numTrees=trees, maxDepth=5, minInstancesPerNode=5, seed=7, subsamplingRate=0.8, labelCol="label", featuresCol="features", weightCol="weight").fit(sample.select("label", "features", "weight"))


def score(rows: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """rows with score, the probability that a file is machine-made by a forest fitted on train (else on rows)."""
    enough = F.col("log_size") > math.log1p(SHORT)
    labelled = (rows if train is None else train).filter(enough & (F.col("noticed") | (F.col("mark") == ""))).withColumn("label", F.col("noticed").cast("double"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}
    if 0.0 not in sizes:
        return rows.withColumn("score", F.lit(0.0))
    # The lowest hashes are a sample that doesn't depend on the order of rows; their share follows from the counts.
    order = F.abs(F.xxhash64("project_id", "path")) / F.lit(float(2**63))
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, TRAIN_ROWS / n))) for k, n in sizes.items()])
    made = rows.sparkSession.createDataFrame(_made(), "label double, " + ", ".join(f"{f} double" for f in FEATURES))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # However many unmarked files of that kind there are in the sample, the made ones outweigh them.
    weight = max(1.0, MADE_SHARE * min(sizes[0.0], TRAIN_ROWS) / MADE)
    known = labelled.filter(order <= share).select("label", *FEATURES, F.lit(1.0).alias("weight")).unionByName(made.withColumn("weight", F.lit(weight)))
    sample = cut(assembler.transform(known).select("label", "features", "weight").coalesce(4))
    first = _forest(sample, 30).transform(sample)
    model = _forest(first.filter((F.col("label") == 1) | (vector_to_array("probability")[1] < SUSPECT)), 30)
    scored = model.transform(assembler.transform(rows)).withColumn("score", F.when(enough, vector_to_array("probability")[1]).otherwise(F.lit(0.0)))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def provenance(files: DataFrame) -> DataFrame:
    """project_id, path, reason ('' for hand-written), score; one row per path."""
    rows = cut(measured(files))
    scored = score(rows)
    theirs = rows.filter((F.col("mark") == "third_party") & F.col("digest").isNotNull()).select("project_id", "digest").distinct().withColumn("copied", F.lit(True))
    seen = scored.join(theirs, ["project_id", "digest"], "left")
    reason = F.when(F.col("mark") != "", F.col("mark")).when(F.col("copied"), F.lit("copy")).when(F.col("score") >= MACHINE, F.lit("machine")).otherwise(F.lit(""))
    return seen.withColumn("reason", reason).groupBy("project_id", "path").agg(F.max("reason").alias("reason"), F.round(F.max("score"), 6).alias("score"))
