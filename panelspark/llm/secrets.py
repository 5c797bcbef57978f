"""Operator 8: secret scan with a random forest that removes false positives, in DataFrame operations only.

A candidate is a run of at least ``SHORTEST`` characters of which keys and tokens are made. Long words, numbers and paths are candidates too; the
forest tells them apart by length, transitions between kinds of characters, coverage by a dictionary, the path of the document and the neighbouring words. The
dictionary is counted over the whole corpus. The forest is trained on labelled findings, at most about ``SAMPLE`` of each label.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import materialize

SHORTEST = 16
#: Findings of each label to train on, and words of each language in the dictionary.
SAMPLE, DICTIONARY = 20_000, 400
TREES, DEPTH, SEED = 40, 8, 7

_SPACE = "[\\x20\\x09-\\x0D]+"
#: Characters next to a candidate that are kept of a neighbouring word or of the text before it in its own word; more matters only in words without white space.
CONTEXT = 256
_CANDIDATE = f"[A-Za-z0-9+/_=.-]{{{SHORTEST},}}"
#: Words before a value that name a credential.
_CREDENTIAL = "(?i)(token|secret|passw|pwd|api.?key|apikey|auth|credential|private|access.?key|bearer)"
#: Paths of examples and tests.
_EXAMPLE = "(?i)(test|example|sample|mock|fixture|doc)"


def every_candidate(documents: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, place (of the word), run (its number in the word), value, lead and the neighbouring words of every candidate in the whole texts.

    ``lead`` is the text before the candidate in its word, from the candidate before it on. A null text has none. Repeated rows each give their candidates.
    """
    words = F.split("text", _SPACE)
    found = F.filter(F.transform("w", lambda w, i: F.when((F.length(w) >= SHORTEST) & w.rlike(_CANDIDATE), i)), lambda i: i.isNotNull())
    near = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    last = lambda c: F.right(c, F.lit(CONTEXT))
    hit = F.transform(found, lambda i: F.struct(i.cast("long").alias("place"), near(i).alias("word"), last(near(i - 1)).alias("before"), last(near(i - 2)).alias("before2"),
                                                F.left(near(i + 1), F.lit(CONTEXT)).alias("after")))
    split = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), words.alias("w"))
    kept = ["doc_id", "path", "place", "before", "before2", "after"]
    rows = split.select("doc_id", "path", F.explode(hit).alias("h")).select("doc_id", "path", "h.*").select(
        *kept, F.regexp_extract_all("word", F.lit(_CANDIDATE), F.lit(0)).alias("runs"), F.split("word", _CANDIDATE, -1).alias("between"))
    # whole arrays are zipped, so a long word is searched once however many candidates it has
    zipped = F.arrays_zip(F.col("runs").alias("value"), F.col("between"), F.concat(F.array(F.lit("")), "runs").alias("previous"))
    each = rows.select(*kept, F.posexplode(zipped).alias("run", "z")).where("z.value is not null")
    return each.select(*kept, F.col("run").cast("long").alias("run"), F.col("z.value").alias("value"), last(F.concat("z.previous", "z.between")).alias("lead"))


def candidates(documents: DataFrame, path: str = "source") -> DataFrame:
    """The first candidate of every word that has one; ``scan`` covers every candidate."""
    return every_candidate(documents, path).where("run = 0")


def dictionary(documents: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The words of three to eight letters in most documents, counted over all of them: ``size`` of each language if there is a column ``lang``, else of all together."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in documents.columns else F.lit("")
    words = documents.select(lang.alias("lang"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("\\b[a-z]{3,8}\\b"), F.lit(0)))).alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    return sorted({r.w for r in counts.withColumn("place", place).where(F.col("place") <= size).select("w").collect()})


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with the features as columns f_*."""
    v = F.col("value")
    n = F.length(v).cast("double")
    covered = F.lit(0.0) if not words else 1 - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(words, key=lambda w: (-len(w), w))), "")) / n
    flag = lambda c: c.cast("double")
    return found.withColumns({
        "f_length": n,
        "f_digits": _count(v, "[0-9]") / n,
        "f_upper": _count(v, "[A-Z]") / n,
        "f_hex": _count(v, "[0-9a-f]") / n,
        "f_marks": _count(v, "[+/_=.-]") / n,
        "f_digit_letter": _count(v, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / n,
        "f_case": _count(v, "(?<=[a-z])(?=[A-Z])") / n,
        "f_runs": _count(v, "(?<=[^aeiouAEIOU])(?=[aeiouAEIOU])") / n,
        "f_dictionary": covered,
        "f_path_example": flag(F.col("path").rlike(_EXAMPLE)),
        "f_path_slashes": _count(F.col("path"), "/"),
        "f_assigned": flag(F.col("before").rlike("[=:]$") & (F.col("run") == 0) | F.col("lead").rlike("[=:][\"']*$") | v.rlike("^[A-Za-z_.-]+=")),
        "f_credential": flag(F.concat_ws(" ", F.when(F.col("run") == 0, F.concat_ws(" ", "before2", "before")), "lead", F.regexp_extract(v, "^[^=]*=", 0)).rlike(_CREDENTIAL)),
        "f_quoted": flag(F.col("lead").rlike("[\"']$")),
        "f_number_near": flag(F.col("before").rlike("[0-9]") | F.col("after").rlike("[0-9]")),
        "f_example_near": flag(F.concat_ws(" ", "before2", "before", "after").rlike(_EXAMPLE)),
    })


FEATURES = ("f_length f_digits f_upper f_hex f_marks f_digit_letter f_case f_runs f_dictionary f_path_example f_path_slashes f_assigned f_credential "
            "f_quoted f_number_near f_example_near").split()


def train(labelled: DataFrame, sample: int = SAMPLE) -> PipelineModel | None:
    """A forest from findings with features and ``label`` (0.0 or 1.0); None where a label is missing.

    At most about ``sample`` of each label are used, chosen by a hash of the value and its place.
    """
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    part = F.pmod(F.xxhash64("doc_id", "place", "run", "value"), F.lit(1_000_000)) / 1_000_000.0
    share = F.when(F.col("label") == 1.0, min(1.0, sample / sizes[1.0])).otherwise(min(1.0, sample / sizes[0.0]))
    weight = {k: sum(min(x, sample) for x in sizes.values()) / (2 * min(x, sample)) for k, x in sizes.items()}
    chosen = labelled.where(part < share).withColumn("weight", F.when(F.col("label") == 1.0, weight[1.0]).otherwise(weight[0.0]))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(chosen.select(*FEATURES, "label", "weight"))


def scan(documents: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """Every candidate of ``documents`` (doc_id, text and the path column; others are ignored) with ``probability`` and ``is_secret``.

    ``labelled``: findings as made by ``every_candidate`` with ``label``; without it, findings are labelled from the corpus (``weak_labels``). Without findings of both
    labels nothing is told apart and all candidates stay secrets, with probability 1. Null texts have no candidates, an empty table gives no row.
    """
    words = dictionary(documents)
    found = materialize(features(every_candidate(documents, path), words))
    model = train(weak_labels(found) if labelled is None else features(labelled, words))
    if model is None:
        probability = F.lit(1.0)
        scored = found
    else:
        scored, probability = model.transform(found), vector_to_array("probability")[1]
    return scored.select("doc_id", "path", "place", "run", "value", probability.alias("probability"), (probability >= threshold).alias("is_secret"))


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings labelled by rules of high precision; others are left out.

    1: a value of mixed digits and letters that is assigned to the name of a credential. 0: a value without digits, a number, or one whose letters are mostly dictionary words.
    """
    mixed = (F.col("f_digits") > 0) & (F.col("f_digits") < 1)
    yes = mixed & (F.col("f_credential") == 1) & (F.col("f_assigned") == 1) & (F.col("f_example_near") == 0)
    no = (F.col("f_digits") == 0) | (F.col("f_digits") == 1) | (F.col("f_dictionary") > 0.6)
    return found.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).where("label is not null")
