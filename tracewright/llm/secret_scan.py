"""Secret scans: a random forest removes false positives from candidate strings.

Everything is a DataFrame operation: candidates by patterns, dictionary and character transitions from the words of the
whole corpus, the forest from pyspark.ml. Candidates are keys of a known form, strings of 6 characters or more that are
assigned to a telling name or stand as the password of a URL, and all runs of 16 or more key characters; a key inside a
longer run is a candidate of its own beside the run. Length is a feature of the forest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import bounded, indices, saved, whole
from tracewright.llm.decontamination import plain_words
from tracewright.llm.spans import matches

#: Neighbouring words that tell a secret, and those that tell something else.
TELLING = "token|secret|passw|pwd|key|auth|credential|bearer"
OTHERWISE = "sha|commit|md5|uuid|digest|checksum|etag|example|dummy|test"
PATHS = "test|example|doc|sample|fixture|mock"
#: Public forms of keys (AWS, GitHub, Slack, Google, web tokens).
KEYS = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[opsu]_[A-Za-z0-9]{36}(?![A-Za-z0-9])|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"
    r"|eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
)
KEY = rf"(?<![A-Za-z0-9])(?:{KEYS})"
ASSIGNED = rf"(?<=[=:\x20\"'])(?<=[=:][\x20\"']{{0,3}}|[Rr]\x20)(?<=(?i:{TELLING})[A-Za-z_]{{0,16}}[\"']?\x20{{0,2}}[=:]\x20{{0,2}}[\"']?|(?i:bearer)\x20)[^\s\"'`<>,;]{{5,}}[^\s\"'`<>,;.)\]}}]"
IN_URL = r"(?<=:)(?<=://[^\s/:@]{1,40}:)[^\s/@]{6,}+(?=@)"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
NOT_SECRET = rf"(^|[^a-z])({OTHERWISE})[a-z0-9_]*\W*$"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: No form starts behind a letter or digit, which is told first.
CANDIDATE = f"(?<![A-Za-z0-9])(?:{KEYS}|{ASSIGNED}|{IN_URL}|{RUN})"
#: A word is in the dictionary from this share of all words on, so that it has at most the inverse number of entries.
DICTIONARY_SHARE, DICTIONARY_COUNT = 1e-6, 5
SAMPLE_ROWS, EXAMPLES, TREES, DEPTH, SEED = 10_000, 4_000, 30, 8, 7
FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_symbols", "f_hex", "f_uuid", "f_key", "f_distinct", "f_transitions", "f_dictionary", "f_path", "f_assigned", "f_telling", "f_otherwise", "f_quoted"]


def candidates(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """doc_id, start, end, value, before (40 characters), after (8), path of each candidate. Null texts have none."""
    text = whole(F.col("text"))
    where = F.coalesce(path.cast("string"), F.lit("")) if path is not None else F.lit("")
    found = matches(F.col("__text"), CANDIDATE)
    inner = F.when(F.col("__text").rlike(rf"[+/_-](?:{KEYS})"), F.array_distinct(F.concat(found, matches(F.col("__text"), KEY)))).otherwise(found)
    rows = docs.select("doc_id", text.alias("__text"), where.alias("path")).select("doc_id", "path", "__text", F.explode(inner).alias("s"))
    first = F.greatest(F.col("s.start") - 40, F.lit(0))
    return rows.select("doc_id", "path", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), F.substring("__text", first + 1, F.col("s.start") - first).alias("before"), F.substring("__text", F.col("s.end") + 1, F.lit(8)).alias("after"))


def dictionary(docs: DataFrame) -> DataFrame:
    """word, n: words of letters that make up enough of the corpus, counted over all texts."""
    counts = saved(docs.select(F.explode(plain_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= DICTIONARY_COUNT))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return counts.where((F.col("n") >= total * DICTIONARY_SHARE) & (F.length("word") >= 3) & F.col("word").rlike(r"^\p{L}+$"))


def transitions(words: DataFrame) -> DataFrame:
    """pair, logp: of a character after another in the dictionary's words, weighted by their counts."""
    pairs = words.select("n", F.explode(F.transform(indices(F.length("word") - 1), lambda i: F.substring("word", i + 1, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    firsts = counts.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("all"))
    return counts.withColumn("a", F.substring("pair", 1, 1)).join(firsts, "a").select("pair", F.log((F.col("n") + 0.5) / (F.col("all") + 32)).alias("logp"))


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with their features. What depends on the string alone is computed once for each distinct string."""
    value, n = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    strings = found.select("value").distinct()
    pairs = strings.select("value", F.explode(F.transform(indices(n - 1), lambda i: F.lower(F.substring(value, i + 1, F.lit(2))))).alias("pair"))
    smooth = pairs.join(bounded(transitions(words)), "pair", "left").groupBy("value").agg(F.avg(F.coalesce("logp", F.lit(-8.0))).alias("f_transitions"))
    runs = strings.select("value", F.explode(F.filter(F.split(F.lower(value), "[^a-z]+"), lambda w: F.length(w) >= 3)).alias("word"))
    covered = runs.join(bounded(words.select("word")), "word", "left_semi").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    own = strings.join(smooth, "value", "left").join(covered, "value", "left").select(
        "value",
        "f_transitions",
        F.log(n.cast("double")).alias("f_length"),
        share("[0-9]").alias("f_digits"),
        share("[A-Z]").alias("f_upper"),
        share("[a-z]").alias("f_lower"),
        share("[^A-Za-z0-9]").alias("f_symbols"),
        value.rlike("^[0-9a-fA-F]+$").cast("double").alias("f_hex"),
        value.rlike(UUID).cast("double").alias("f_uuid"),
        value.rlike(f"^(?:{KEYS})$").cast("double").alias("f_key"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40))).alias("f_distinct"),
        (F.coalesce("covered", F.lit(0)) / n).alias("f_dictionary"),
    )
    before = F.lower("before")
    near = found.withColumns({
        "f_path": F.lower("path").rlike(PATHS).cast("double"),
        "f_assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "f_telling": before.rlike(rf"({TELLING})[a-z_]*\W*$").cast("double"),
        "f_otherwise": before.rlike(NOT_SECRET).cast("double"),
        "f_quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
    })
    return near.join(bounded(own), "value")


def stated_findings(found: DataFrame) -> DataFrame:
    """Labels for candidates whose nature is plain, for corpora without reviewed findings; the forest decides on all others.
    1: keys of a known form, and strings with a digit that are assigned to a telling name. 0: UUIDs, what follows a word for
    something else (a digest, a commit, an example), plain words, paths and numbers."""
    value, before = F.col("value"), F.lower("before")
    other = value.rlike(UUID) | before.rlike(NOT_SECRET)
    named = before.rlike(rf"({TELLING})[a-z_]*[\"']?\s*[=:]\s*[\"']?$") & value.rlike("[0-9]")
    plain = value.rlike("^[A-Za-z_/-]+$|^[0-9-]+$")
    label = F.when(value.rlike(f"^(?:{KEYS})$"), 1).when(other, 0).when(named, 1).when(plain, 0)
    return found.withColumn("label", label.cast("int")).where(F.col("label").isNotNull())


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """n labelled findings made by a rule, so that the forest meets digests, commits, UUIDs, paths and placeholders as well as
    secrets of each kind, whatever the corpus holds. Columns of candidates() and label; the same at each run."""
    hexes = F.sha2(F.concat(F.lit("example:"), F.col("id").cast("string")), 256)
    letters = F.translate(F.base64(F.unhex(hexes)), "+/=", "xyz")
    part = lambda text, first, k: F.substring(text, first, k)
    joined = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    uuid = F.concat_ws("-", part(hexes, 1, 8), part(hexes, 9, 4), part(hexes, 13, 4), part(hexes, 17, 4), part(hexes, 21, 12))
    upper = F.upper(F.translate(hexes, "0189", "gjkm"))
    kinds = [
        (1, 'token = "', part(hexes, 1, 40), '" end', ""),
        (1, "secret: ", part(letters, 1, 24), " end", ""),
        (1, "password = '", joined(part(letters, 1, 6), "!", part(hexes, 1, 2)), "' end", ""),
        (1, "pwd=", joined(part(letters, 3, 5), "@", part(hexes, 5, 4)), " end", ""),
        (1, "api_key=", F.base64(F.unhex(hexes)), " end", ""),
        (1, "the id is ", joined("AKIA", part(upper, 1, 16)), " end", ""),
        (1, "log in with ", joined("ghp_", part(letters, 1, 36)), " end", ""),
        (1, "Authorization: Bearer ", joined("eyJ", part(letters, 1, 17), ".", part(letters, 9, 30), ".", letters), " end", ""),
        (1, "postgres://admin:", joined(part(letters, 1, 8), "9"), "@db.int", ""),
        (0, 'token = "', part(hexes, 1, 40), '" end', "tests/fixtures/login.json"),
        (0, 'example_token = "', part(hexes, 1, 40), '" end', ""),
        (0, "fixed in commit ", part(hexes, 1, 40), " by", ""),
        (0, "sha256: ", hexes, " end", ""),
        (0, 'md5 = "', part(hexes, 1, 32), '" end', ""),
        (0, "etag: ", part(hexes, 1, 32), " end", ""),
        (0, "uuid = ", uuid, " end", ""),
        (0, "request ", uuid, " end", ""),
        (0, "see ", joined("/usr/lib/python/", part(hexes, 1, 2), "/site-packages"), " end", ""),
        (0, "password: ", joined("your-password-here"), " end", ""),
        (0, "secret = ", F.repeat(F.lit("x"), 8 + F.col("id").cast("int") % 9), " end", ""),
        (0, "number ", F.conv(part(hexes, 1, 14), 16, 10), " end", ""),
    ]
    rows = [F.struct(F.lit(None).cast("long").alias("doc_id"), F.lit(path).alias("path"), F.col("id").cast("int").alias("start"), (F.col("id").cast("int") + F.length(value)).alias("end"), value.alias("value"), F.lit(before).alias("before"), F.lit(after).alias("after"), F.lit(label).alias("label")) for label, before, value, after, path in kinds]
    return spark.range(n).select(F.element_at(F.array(*rows), (F.col("id") % len(rows) + 1).cast("int")).alias("e")).select("e.*")


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, beside: DataFrame | None = None) -> PipelineModel | None:
    """The forest, from at most sample_rows labelled findings of each class, those with the least hash, and all of those
    beside. None without both classes."""
    order = [F.xxhash64("value", "before"), F.col("doc_id"), F.col("start")]
    parts = [labelled.where(F.col("label") == y).orderBy(*order).limit(sample_rows).select("label", *FEATURES) for y in (0, 1)]
    parts += [beside.select("label", *FEATURES)] if beside is not None else []
    sample = saved(reduce(DataFrame.unionByName, parts).coalesce(1).sortWithinPartitions("label", *FEATURES))
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(sample)


def scan(docs: DataFrame, path: Column | None = None, findings: DataFrame | None = None, train_on: Column | None = None) -> DataFrame:
    """doc_id, start, end, value, score and is_secret (score >= 0.5) of every candidate in every text.

    findings (doc_id, start, label) are reviewed findings to learn from, and then the only ones; without them the plain cases
    are labelled by stated_findings, with examples() beside them. train_on limits the candidates that may be learned from.
    Repeated rows give repeated findings; where the reviewed findings lack a class the score is null and nothing is removed
    (is_secret is true)."""
    own, none = candidates(docs, path), F.lit(None).cast("int")
    made = examples(docs.sparkSession).withColumn("doc_id", F.lit(None).cast(own.schema["doc_id"].dataType))
    every = saved(featured(saved(own.withColumn("label", none).unionByName(made)), saved(dictionary(docs))))
    found, beside = every.where("label IS NULL").drop("label"), every.where("label IS NOT NULL")
    pool = found if train_on is None else found.where(train_on)
    model = fit(stated_findings(pool), beside=beside) if findings is None else fit(pool.join(findings.select("doc_id", "start", "label"), ["doc_id", "start"]))
    if model is None:
        out = found.withColumn("score", F.lit(None).cast("double"))
    else:
        out = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return out.select("doc_id", "start", "end", "value", "score", (F.coalesce("score", F.lit(1.0)) >= 0.5).alias("is_secret"))
