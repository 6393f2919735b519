"""Secret scan with a random forest that removes false positives.

Candidates are strings that look like keys, all values assigned to a credential name, passwords
in URLs, and heads of private keys. A forest judges them by length, changes between kinds of characters, share of
dictionary words, path marks and neighbouring words. The dictionary is that of the corpus: words
by their document frequency. The forest is trained on labelled findings. Where there are none,
clear cases are labelled by their surroundings, and a forest that doesn't see these columns
learns from them what secrets look like and judges all candidates.
Everything runs on built-in expressions and the library's own forest.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import forget
from .tables import stored, text_of, wide_hash

#: A place after a credential name, with up to 24 more characters of the name, and an assignment.
#: The short tests before the long one let all other places of a text go at once.
ASSIGNED = (
    r"(?<=[=:>\s\"'`])(?=[^\s\"'`=:>])(?<=[=:]>?[ \t]{0,8}(?:(?i:bearer|basic|token)[ \t]{1,2})?\\?[\"'`]?)"
    r"(?<=(?i:api[_ -]?key|key|token|secret|pass|pwd|credential|auth|bearer|private)[A-Za-z0-9_.-]{0,24}"
    r"[\\\"'`)\] \t]{0,6}[=:]{1,2}>?[ \t]{0,8}(?:(?i:bearer|basic|token)[ \t]{1,2})?\\?[\"'`]?)"
    r"(?!(?i:bearer|basic|token)[ \t]{1,2}[^\s])"
)
#: Its value: up to the closing quote, else up to white space, a quote, closing marks or the next assignment.
VALUE = (
    r"(?:(?<=\\[\"'])[^\\\"'\r\n]++(?=\\[\"'])"
    r"|(?<=\")(?:[^\"\\\r\n]++|\\.)++(?=\")|(?<=')(?:[^'\\\r\n]++|\\.)++(?=')|(?<=`)[^`\r\n]++(?=`)"
    r"|(?:(?![&,;][A-Za-z_][A-Za-z0-9_.-]{0,40}[=:]|[,;)}\]>]{1,8}(?:[\s\"'`]|\z))[^\s\"'`])++)"
)
#: Values of credential names, passwords in URLs, long runs of key characters with a digit, private keys.
CANDIDATE = (
    ASSIGNED + VALUE
    + r"|(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/\"'`<>]+(?=@[^\s@])"
    + r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}={0,2}"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
)
MARK = "\x01"
#: Characters of the surroundings that are looked at on either side.
AROUND = 64
#: Names that credentials are assigned to, and words of harmless neighbourhoods.
CREDENTIAL = r"(?i)(api[_ -]?key|key|token|secret|passw(?:or)?d?|pwd|credential|auth|bearer|private)"
HARMLESS = r"(?i)(example|sample|test|dummy|placeholder|sha\d*|hash|commit|checksum|uuid|version|order|number|image|file)"
#: A word of the dictionary: a run of letters that stands alone, in this many rows of the corpus
#: and in this share of them. Runs inside of keys have digits beside them and don't count.
WORD = r"(?<![A-Za-z0-9_])[a-z]{4,24}(?![A-Za-z0-9_])"
LEAST_ROWS = 3
LEAST_SHARE = 1e-5
#: Labelled findings that the forest is trained on, at most.
TRAINING = 20_000
TREES = 24
DEPTH = 6
SEED = 11


def candidates(docs: DataFrame) -> DataFrame:
    """Every candidate: ``doc_id, start`` (code points from 0), ``value, before, after``.

    Null and empty texts have none. A row that repeats another has its own candidates.
    """
    marked = F.regexp_replace(F.translate(text_of(), MARK, " "), F.lit(CANDIDATE), F.lit(f"{MARK}$0{MARK}"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(marked, MARK, -1).alias("piece"))
    rows = rows.where(F.size("piece") > 1).withColumn("row", F.monotonically_increasing_id())
    piece = F.col("piece")
    at = F.sequence(F.lit(1), F.size(piece) - 1, F.lit(2))  # 1, 3, 5, ...: the candidates
    found = F.transform(
        at,
        lambda i: F.struct(
            i.alias("place"), F.get(piece, i).alias("value"), F.length(F.get(piece, i - 1)).alias("gap"),
            F.right(F.get(piece, i - 1), F.lit(AROUND)).alias("before"), F.left(F.get(piece, i + 1), F.lit(AROUND)).alias("after"),
        ),
    )
    each = rows.select("doc_id", "row", F.inline(found))
    # lengths of what stands before, added up along the document
    width = F.col("gap") + F.length("value")
    along = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("start", (F.sum(width).over(along) - F.length("value")).cast("long")).select(
        "doc_id", "start", "value", "before", "after"
    )


def _share(column: Column, pattern: str, of: Column) -> Column:
    return (of - F.length(F.regexp_replace(column, F.lit(pattern), F.lit("")))) / of


def dictionary(docs: DataFrame) -> DataFrame:
    """Words of the corpus, ``word, n_rows``: of at least LEAST_ROWS rows and LEAST_SHARE of all.

    A word counts once a row, whatever its case; counts combine map-side, so what is shuffled
    grows with the vocabulary.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_of()), F.lit(WORD), F.lit(0)))
    rows = docs.agg(F.count(F.lit(1))).first()[0]
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where(F.col("n_rows") >= max(LEAST_ROWS, math.ceil(LEAST_SHARE * rows)))


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``covered``: characters of the value in runs of letters that are words.

    A run ends where a capital follows a small letter. Every distinct value is looked up once;
    its 128-bit hash takes the count back to all its candidates.
    """
    apart = F.lower(F.regexp_replace("value", F.lit("([a-z])([A-Z])"), F.lit("$1 $2")))
    runs = F.explode(F.regexp_extract_all(apart, F.lit("[a-z]{4,}"), F.lit(0)))
    keyed = found.select("*", *wide_hash(F.col("value")))
    values = keyed.groupBy("h1", "h2").agg(F.first("value").alias("value"))
    covered = (
        values.select("h1", "h2", runs.alias("word")).join(words.select("word"), "word")
        .groupBy("h1", "h2").agg(F.sum(F.length("word")).alias("covered"))
    )
    return keyed.join(covered, ["h1", "h2"], "left").drop("h1", "h2").withColumn("covered", F.coalesce("covered", F.lit(0).cast("bigint")))


def features(found: DataFrame) -> DataFrame:
    """``found``, with ``covered``, and one double column per feature, all names starting with ``f_``."""
    value, size = F.col("value"), F.length("value").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        value, F.lit("[0-9]+"), F.lit("0")), F.lit("[a-z]+"), F.lit("a")), F.lit("[A-Z]+"), F.lit("A")), F.lit("[^0aA]+"), F.lit("-"))
    letters = F.array_distinct(F.split(value, ""))
    before, after = F.col("before"), F.col("after")
    flag = lambda c: c.cast("double")
    made = {
        "f_length": F.least(size, F.lit(256.0)),
        "f_transitions": F.length(kinds) / size,
        "f_digits": _share(value, "[0-9]", size),
        "f_upper": _share(value, "[A-Z]", size),
        "f_hex": _share(value, "[0-9a-f]", size),
        "f_distinct": F.size(letters) / F.least(size, F.lit(64.0)),
        "f_vowels": _share(value, "[aeiouAEIOU]", size),
        "f_dictionary": F.col("covered") / size,
        "f_slashes": _share(value, "/", size),
        "f_path": flag(before.rlike(r"(://|www\.|[/\\])\S*$") | after.rlike(r"^\.[a-z]{2,5}\b")),
        "f_assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "f_quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "f_credential": flag(before.rlike(CREDENTIAL + r"\W{0,6}$")),
        "f_credential_near": flag(before.rlike(CREDENTIAL)),
        "f_harmless": flag(before.rlike(HARMLESS) | after.rlike("^\\W{0,3}" + HARMLESS)),
        "f_known_form": flag(value.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^xox[abprs]-|^sk_live_|^AIza|^-----BEGIN")),
    }
    return found.withColumns({name: F.coalesce(column, F.lit(0.0)) for name, column in made.items()}).drop("covered")


#: What clear cases are labelled by; a forest trained on them gets none of these.
SURROUNDINGS = ("f_assigned", "f_quoted", "f_credential", "f_credential_near", "f_known_form")


def clear_cases(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1 for quoted values that are assigned to a credential name and for
    known key forms, 0 for values without assignment or credential name nearby, else null.

    The value itself has no say but for known forms, see SURROUNDINGS."""
    sure = (F.col("f_assigned") + F.col("f_quoted") + F.col("f_credential") == 3) | (F.col("f_known_form") == 1)
    harmless = (F.col("f_assigned") == 0) & (F.col("f_credential_near") == 0) & (F.col("f_known_form") == 0)
    return found.withColumn("label", F.when(sure, 1.0).when(harmless, 0.0))


def _inputs(found: DataFrame, hidden: tuple[str, ...]) -> list[str]:
    return [c for c in found.columns if c.startswith("f_") and c not in hidden]


def train(labelled: DataFrame, most: int = TRAINING, hidden: tuple[str, ...] = ()):
    """A forest fitted on the ``most`` findings with the smallest hash; None without both labels.

    ``labelled`` has the columns of ``features`` and ``label``; rows without label don't count.
    Columns ``hidden`` are kept from the forest.
    """
    rows = labelled.where("label is not null")
    kinds = rows.agg(F.min("label"), F.max("label")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:
        return None
    rows = rows.orderBy(F.xxhash64("value", "doc_id", "start"), "doc_id", "start").limit(most)
    names = _inputs(labelled, hidden)
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows.select("label", *names))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return forest.fit(ready)


def judge(found: DataFrame, forest, hidden: tuple[str, ...] = ()) -> DataFrame:
    """``found`` with ``probability`` of being a secret; without a forest, that of the clear cases."""
    if forest is None:
        return clear_cases(found).withColumn("probability", F.coalesce("label", F.lit(0.0))).drop("label")
    ready = VectorAssembler(inputCols=_inputs(found, hidden), outputCol="features").transform(found)
    out = forest.transform(ready)
    return out.withColumn("probability", F.element_at(vector_to_array("probability"), 2)).select(*found.columns, "probability")


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """All candidates of ``docs``: ``doc_id, start, length, value, probability, is_secret``.

    ``findings(doc_id, start, label)`` are findings judged by hand, learned with all features;
    without them the clear cases are the training data, without the columns that label them.
    Other columns of ``docs`` are not read.
    """
    raw = stored(candidates(docs), "secret-values")
    found = stored(features(coverage(raw, dictionary(docs))), "secret-candidates")
    forget(raw)
    if findings is None:
        labelled, hidden = clear_cases(found), SURROUNDINGS
    else:
        marks = findings.select("doc_id", "start", F.col("label").cast("double").alias("label")).dropDuplicates(["doc_id", "start"])
        labelled, hidden = found.join(marks, ["doc_id", "start"]), ()
    judged = judge(found, train(labelled, hidden=hidden), hidden)
    return judged.select(
        "doc_id", "start", F.length("value").cast("long").alias("length"), "value", "probability",
        (F.col("probability") >= 0.5).alias("is_secret"),
    )


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return scan(docs.select("doc_id", "text"))
