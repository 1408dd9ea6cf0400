"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame and SQL functions and Spark's own random forest only. A candidate is a value behind a
telling key (``password=...``) or a run of at least LEAST letters, digits and ``_-+/``. The forest
sees a candidate's length, its changes between classes of characters, its digits, capitals and
repeated characters, the share of it that words of the corpus cover, the path of its document and,
hashed, the words left and right of it. It is trained from labelled findings. Where none are given, the key and
the format label: what a telling key announces or a provider's format shows counts as a secret,
all else as none. Neither key nor format is an input, so the forest has to tell by the rest, and
carries it over to values that nothing announces and to announced ones that look like words.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.session import materialised

LEAST, BESIDE = 16, 40
#: Bound of the training data: labelled rows of each class.
MAX_LABELLED = 20_000
#: A word of WORD_SIZES letters in at least this share of all documents (and in two) is in the dictionary.
WORD_SHARE, WORD_SIZES = 0.002, (3, 8)
TREES, DEPTH, SEED = 24, 6, 11
#: Places of the hashed words on each side.
SIDE = 64

#: Keys that announce a secret, and formats of keys that providers publish.
TELLING = "password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key|credential|auth"
PROVIDERS = (
    "AKIA[0-9A-Z]{16}", "ASIA[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36,}", "xox[abprs]-[A-Za-z0-9-]{10,}",
    "sk_live_[A-Za-z0-9]{16,}", "AIza[A-Za-z0-9_-]{35}",
)

_RUN = rf"[\p{{L}}0-9_+/-]{{{LEAST},}}={{0,2}}"
#: A key with a value behind it, or a run. It starts where no run goes on and never backs into
#: what it has read, so a text is read once, without a test of words at every character.
_FOUND = rf"(?<![\p{{L}}0-9_+/-])(?:[A-Za-z][A-Za-z0-9_-]*+[ ]{{0,2}}+[:=][ ]{{0,2}}+[\"']?[^\s\"']{{8,}}+|{_RUN.replace(',}', ',}+', 1)})"
_KEYED = r"^([A-Za-z][A-Za-z0-9_-]*+[ ]{0,2}+[:=][ ]{0,2}+[\"']?)(.*)$"
SHAPE = ("length", "changes", "digits", "capitals", "hex_only", "distinct", "covered", "vowels", "path_depth", "test_path")


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, n (from 0), candidate, announced, left, right: each candidate with its neighbours.

    Behind a telling key the whole value is one; behind another key, and elsewhere, each run is.
    ``left`` and ``right`` are the text around it, without a key that announces it. Null and empty
    texts have none. Without a column ``source`` the path is empty.
    """
    pattern, keyed, run, telling = map(_sql_text, (_FOUND, _KEYED, _RUN, f"(?i)({TELLING})"))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    cut = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source.alias("source"), "text").where(f"text rlike {pattern}")
    cut = cut.select("doc_id", "source", F.expr(f"regexp_extract_all(text, {pattern}, 0)").alias("found"), F.expr(f"split(text, {pattern}, -1)").alias("gaps"))
    each = F.expr(
        f"transform(found, (c, i) -> struct(c as found, regexp_extract(c, {keyed}, 1) as key, right(gaps[i], {BESIDE}) as left, left(gaps[i + 1], {BESIDE}) as right))"
    )
    told, behind = f"f.key rlike {telling}", "substr(f.found, length(f.key) + 1)"
    values = f"case when {told} then array({behind}) when f.key = '' then array(f.found) else regexp_extract_all({behind}, {run}, 0) end"
    left = f"if(f.key = '' or {told}, f.left, right(concat(f.left, f.key), {BESIDE}))"
    parts = f"flatten(transform(each, f -> transform({values}, v -> struct(v as candidate, {told} as announced, {left} as left, f.right as right))))"
    return cut.select("doc_id", "source", each.alias("each")).select("doc_id", "source", F.posexplode(F.expr(parts)).alias("n", "p")).select("doc_id", "source", "n", "p.*")


def dictionary(docs: DataFrame, share: float = WORD_SHARE) -> DataFrame:
    """``(word)``: words in at least a share of all documents and in two. A document has a bounded number of different
    words on average, so there are at most that number divided by the share."""
    total = docs.count()
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"))
    low, high = WORD_SIZES
    counted = words.where(F.length("word").between(low, high)).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return counted.where(F.col("df") >= max(2.0, share * total)).select("word")


def coverage(values: DataFrame, words: DataFrame) -> DataFrame:
    """``(candidate, covered)``: the share of a candidate's characters inside dictionary words in it."""
    low, high = WORD_SIZES
    pieces = F.expr(
        f"flatten(transform(sequence(1, length(candidate) - {low - 1}), i -> transform(sequence({low}, least({high}, length(candidate) - i + 1)), k -> struct(i as i, substr(low, i, k) as word))))"
    )
    listed = values.select("candidate").distinct().where(F.length("candidate") >= low).withColumn("low", F.lower("candidate"))
    hit = listed.select("candidate", F.inline(pieces)).where(r"word rlike '^\\p{L}+$'").join(words, "word")
    inside = hit.select("candidate", F.explode(F.sequence("i", F.col("i") + F.length("word") - 1)).alias("at")).distinct()
    return inside.groupBy("candidate").agg((F.count(F.lit(1)) / F.length("candidate")).alias("covered"))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with their shape ``f_*``, ``provider``, and the words beside them as lists."""
    c = F.col("candidate")
    size = F.length(c)

    def share(pattern: str):
        return F.length(F.regexp_replace(c, pattern, "")) / size

    changes = F.size(F.split(c, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^\p{L}0-9])(?=[\p{L}0-9])")) - 1
    columns = {
        "length": size, "changes": changes / size, "digits": share("[^0-9]"), "capitals": share(r"[^\p{Lu}]"),
        "hex_only": c.rlike("^[0-9a-fA-F]+$"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "covered": F.col("covered"), "vowels": share("[^aeiouAEIOU]"), "path_depth": F.size(F.split("source", "/")),
        "test_path": F.lower("source").rlike("test|example|fixture|sample|mock"),
    }
    # Telling words would give the label away, wherever they stand.
    beside = {s: F.filter(F.split(F.regexp_replace(F.lower(s), f"[a-z0-9_-]*({TELLING})[a-z0-9_-]*", " "), r"[^\p{L}0-9]+"), lambda w: w != "") for s in ("left", "right")}
    return found.join(coverage(found, words), "candidate", "left").select(
        "doc_id", "source", "n", "candidate", "announced", c.rlike("^(" + "|".join(PROVIDERS) + ")$").alias("provider"),
        F.slice(F.reverse(beside["left"]), 1, 3).alias("words_left"), F.slice(beside["right"], 1, 3).alias("words_right"),
        *[F.coalesce(columns[k].cast("double"), F.lit(0.0)).alias(f"f_{k}") for k in SHAPE],
    )


def rule_labels(found: DataFrame) -> DataFrame:
    """Labels by key and format: neither is an input of the forest."""
    return found.withColumn("label", (F.col("announced") | F.col("provider")).cast("double"))


def _vectors(found: DataFrame) -> DataFrame:
    for side in ("left", "right"):
        found = HashingTF(numFeatures=SIDE, binary=True, inputCol=f"words_{side}", outputCol=f"hashed_{side}").transform(found)
    names = [f"f_{k}" for k in SHAPE]
    return VectorAssembler(inputCols=[*names, "hashed_left", "hashed_right"], outputCol="features").transform(found)


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED):
    """The forest from labelled findings (features and ``label``), or None with one class only.

    At most about ``max_rows`` of each class are used, taken by hash.
    """
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    take = F.lit(None)
    for label, n in counts.items():
        take = F.when(F.col("label") == label, min(1.0, max_rows / n)).otherwise(take)
    at = F.pmod(F.xxhash64("candidate", "doc_id", "n"), F.lit(1 << 30))
    # Both classes weigh alike, however rare secrets are.
    weight = F.lit(None)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, 1.0 / min(n, max_rows)).otherwise(weight)
    rows = _vectors(labelled.where(at < take * (1 << 30)).withColumn("weight", weight))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", weightCol="weight")
    return forest.fit(rows.select("features", "label", "weight"))


def classify(found: DataFrame, model) -> DataFrame:
    """Findings with ``probability`` of a secret. A provider's format is certain; without a model so
    is what a telling key announces, and nothing else counts."""
    if model is None:
        return found.withColumn("probability", (F.col("announced") | F.col("provider")).cast("double"))
    scored = model.transform(_vectors(found)).withColumn("probability", vector_to_array("probability")[1])
    return scored.withColumn("probability", F.when(F.col("provider"), 1.0).otherwise(F.col("probability")))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, n, candidate, probability of all candidates that the forest takes for secrets.

    ``docs`` needs doc_id and text; ``findings`` (doc_id, n, label 0/1) are labelled candidates of
    these documents (``candidates`` numbers them); without them key and format label. Whole texts are
    scanned; repeated rows and ties give repeated findings; null texts and empty tables give none; with
    labels of one class only, announced values and providers' formats are the findings.
    """
    found = materialised(features(candidates(docs), dictionary(docs)), "secret-candidates")
    labelled = rule_labels(found) if findings is None else found.join(findings.select("doc_id", "n", F.col("label").cast("double").alias("label")), ["doc_id", "n"])
    scored = classify(found, train(labelled))
    return scored.where(F.col("probability") >= threshold).select("doc_id", "n", "candidate", "probability")
