"""Secret scanning: candidates by pattern, false positives removed by a random forest.

All of it is DataFrame functions and Spark ML in the JVM. A candidate is a
stretch of at least 12 key characters with a digit in it, or a value of any
length that is assigned to a word that announces a secret. Its features are its
length, how often its characters change class, how much of it (and of what
stands beside it) a dictionary covers, whether it stands in a path, and the
words next to it, hashed. The forest learns from labelled findings. Those that
labelled_findings() takes from well-known formats and announced assignments are
no features themselves: the forest sees characters and words, and so also
judges candidates that no rule labels.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import materialize, query

# What a candidate looks like, words that announce secrets, well-known key formats.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}={0,2}"
ANNOUNCES = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)"
# The value is group 1: to the closing quote, or, without quotes, to white space but for marks at its end.
ASSIGNED = ANNOUNCES.replace("(pass(", "(?:pass(?:") + r"[A-Za-z0-9_-]{0,16}[\"']?\s{0,8}[=:]{1,3}\s{0,8}[\"']?((?<=\")[^\"\n]+|(?<=')[^'\n]+|(?<![\"'])[^\s\"']*[^\s\"'.,;:)\]}])"
KEY_FORMATS = r"^(AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|xox[bap]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{24,})$"
PLACEHOLDER = r"(?i)(example|sample|placeholder|changeme|your[_-]|dummy|x{6,}|0{8,}|123456)"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
BEFORE, AFTER = 48, 24

FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_other", "f_switches", "f_distinct", "f_hex", "f_vowels",
    "f_covered", "f_context_covered", "f_path",
]
#: Places of the hashed neighbouring words among the forest's inputs.
WORD_PLACES = 64


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that later expressions read as they are. As plain columns, Spark would put their expressions into lambdas and work them out anew for each element."""
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select("*", made.alias("__made")).select(*df.columns, "__made.*")


def _places(df: DataFrame, pattern: str, group: int, shortest: int, block: int = 256) -> DataFrame:
    """doc_id and place (start, candidate, before, after) of every match of a pattern in column text; the group ends where the match ends.

    Contexts come from the matches and stretches next to a match, never by a
    count from the text's start, and ends are summed in blocks, so that no
    array is copied for each of its elements: the work is linear in the text. A
    match has at least `shortest` characters, which bounds how many a context holds.
    """
    text = F.col("text")
    work = _with(df, whole=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), part=F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), between=F.split(text, pattern, -1)).where(F.size("whole") > 0)
    add = lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n))
    work = _with(
        work.drop("text"),
        steps=F.transform("whole", lambda m, i: F.length(F.get("between", i)) + F.length(m)),
        # What stands before each match, and after it, no longer than a context.
        lefts=F.transform("between", lambda x: F.right(x, F.lit(BEFORE))),
        rights=F.transform("between", lambda x: F.left(x, F.lit(AFTER))),
    ).drop("between")
    work = _with(work, blocks=F.transform(F.sequence(F.lit(0), F.floor((F.size("steps") - 1) / block).cast("int")), lambda b: F.slice("steps", b * block + 1, F.lit(block))))
    work = _with(work, sums=F.aggregate(F.transform("blocks", lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)), F.array(F.lit(0)), add))
    ends = F.flatten(F.zip_with("blocks", F.slice("sums", F.lit(1), F.size("blocks")), lambda x, s: F.slice(F.aggregate(x, F.array(s), add), F.lit(2), F.size(x))))
    work = _with(work, ends=ends)
    nearest = lambda i, k: F.coalesce(F.when(i >= k, F.concat(F.get("lefts", i - k), F.get("whole", i - k))), F.lit(""))

    def before(i: Column, value: Column) -> Column:
        own = F.left(F.get("whole", i), F.length(F.get("whole", i)) - F.length(value))
        return F.right(F.concat(*[nearest(i, k) for k in range(BEFORE // shortest + 1, 0, -1)], F.get("lefts", i), own), F.lit(BEFORE))

    def after(i: Column) -> Column:
        later = [F.coalesce(F.concat(F.get("whole", i + k), F.get("rights", i + k + 1)), F.lit("")) for k in range(1, AFTER // shortest + 2)]
        return F.left(F.concat(F.get("rights", i + 1), *later), F.lit(AFTER))

    places = F.transform("part", lambda v, i: F.struct((F.get("ends", i) - F.length(v) + 1).alias("start"), v.alias("candidate"), before(i, v).alias("before"), after(i).alias("after")))
    return work.select("doc_id", F.explode(places).alias("place"))


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, start (1-based, in characters), candidate, before and after of every candidate of a text.

    Each place is a row with its own context. A value that both patterns find
    at one place is one row; a longer value and a part of it are two. Null and
    empty texts have none; repeated documents stay repeated. The work is linear
    in the length of a text, however many candidates it holds.
    """
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    runs = _places(texts.where(F.col("text").rlike(CANDIDATE)), CANDIDATE, 0, 12)
    # A value that starts where a key-like stretch starts, and is all of it, was found as one.
    run = CANDIDATE.removeprefix(r"(?<![A-Za-z0-9+/_-])")
    same = ~F.col("place.before").rlike("[A-Za-z0-9+/_-]$") & (F.regexp_extract(F.concat("place.candidate", "place.after"), f"^{run}", 0) == F.col("place.candidate"))
    assigned = _places(texts.where(F.col("text").rlike(ASSIGNED)), ASSIGNED, 1, 5).where(~same)
    return runs.unionByName(assigned).select("doc_id", "place.*")


def context_words(found: DataFrame, at_least: int = 3, size: int = 5000) -> DataFrame:
    """The dictionary: `size` most frequent words of three letters or more beside all candidates (word, n)."""
    text = F.lower(F.concat_ws(" ", "before", "after"))
    words = found.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).orderBy(F.desc("n"), "word").limit(size)


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """Add the forest's inputs to candidates."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    words = F.array(*[F.lit(w) for w in dictionary]) if dictionary else F.array().cast("array<string>")
    covered = lambda text: F.aggregate(
        F.array_intersect(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)), words), F.lit(0.0), lambda s, w: s + F.length(w)
    )
    context = F.concat_ws(" ", "before", "after")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return found.select(
        "*",
        n.alias("f_length"),
        (_count(c, "[0-9]") / n).alias("f_digits"),
        (_count(c, "[A-Z]") / n).alias("f_upper"),
        (_count(c, "[a-z]") / n).alias("f_lower"),
        (_count(c, "[^A-Za-z0-9]") / n).alias("f_other"),
        (_count(c, "(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])") / n).alias("f_switches"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("f_distinct"),
        flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")).alias("f_hex"),
        (_count(c, "(?i)[aeiou]") / n).alias("f_vowels"),
        (covered(c) / n).alias("f_covered"),
        (covered(context) / (F.length(context) + 1.0)).alias("f_context_covered"),
        flag(F.col("before").rlike(r"(://\S*|[/\\.])$") | F.col("after").rlike(r"^\.[a-z]{2,4}\b") | c.contains("/")).alias("f_path"),
        _neighbours().alias("f_neighbours"),
    )


def _neighbours(words_before: int = 3, words_after: int = 2) -> Column:
    """The words next to a candidate, each with its side."""
    found = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{2,}|[=:]"), F.lit(0))
    last, first = F.reverse(found("before")), found("after")
    return F.concat(F.transform(F.slice(last, 1, words_before), lambda w: F.concat(F.lit("<"), w)), F.transform(F.slice(first, 1, words_after), lambda w: F.concat(F.lit(">"), w)))


def _inputs(rows: DataFrame) -> DataFrame:
    """Rows of with_features() with the forest's vector `inputs`."""
    hashed = HashingTF(inputCol="f_neighbours", outputCol="f_words", numFeatures=WORD_PLACES, binary=True).transform(rows)
    return VectorAssembler(inputCols=[*FEATURES, "f_words"], outputCol="inputs").transform(hashed)


def labelled_findings(found: DataFrame, max_rows: int = 20000) -> DataFrame:
    """Candidates with a certain `label`: at most max_rows of each class, the first by the hash of the candidate.

    Well-known key formats, and announced, assigned values of mixed characters,
    are secrets. Plain numbers, UUIDs, placeholders and words
    with a number at the end that nothing announces are not. Candidates of neither kind get no label.
    """
    c = F.col("candidate")
    assigned = F.col("before").rlike(ANNOUNCES + r"\S{0,16}\s*[=:]\s*[\"']?$")
    no = c.rlike("^[0-9]+$") | c.rlike(UUID) | c.rlike(PLACEHOLDER) | (c.rlike("^[A-Za-z]+[-_]?[0-9]{1,4}$") & ~assigned)
    yes = c.rlike(KEY_FORMATS) | (assigned & c.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"))
    known = found.withColumn("label", F.when(no, 0.0).when(yes, 1.0)).where(F.col("label").isNotNull())
    order = (F.xxhash64("candidate"), F.col("candidate"), F.col("doc_id"), F.col("start"))
    return known.where("label = 1").orderBy(*order).limit(max_rows).unionByName(known.where("label = 0").orderBy(*order).limit(max_rows))


def train(labelled: DataFrame, trees: int = 30, depth: int = 6, seed: int = 11):
    """A random forest over FEATURES and neighbouring words from rows with `label`; None without rows."""
    if labelled.limit(1).count() == 0:
        return None
    return RandomForestClassifier(featuresCol="inputs", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(_inputs(labelled))


def scan(documents: DataFrame, threshold: float = 0.5, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, start, candidate, probability and is_secret of every candidate in all texts.

    findings: labelled candidates (candidate, before, after, label) to learn
    from; by default those of labelled_findings(). Without any, well-known key
    formats alone count as secrets. An empty table gives no rows.
    """
    found = materialize(candidates(documents), "candidates")
    # The dictionary is bounded by its size.
    dictionary = [r[0] for r in context_words(found).collect()]
    rows = with_features(found, dictionary)
    forest = train(materialize(with_features(findings, dictionary) if findings is not None else labelled_findings(rows), "findings"))
    if forest is None:
        scored = rows.withColumn("probability", F.col("candidate").rlike(KEY_FORMATS).cast("double"))
    else:
        scored = forest.transform(_inputs(rows))
        p = vector_to_array("probability")
        # A forest that saw one class has one probability.
        scored = scored.withColumn("probability", F.when(F.size(p) > 1, F.element_at(p, 2)).otherwise(0.0))
    return scored.select("doc_id", "start", "candidate", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(documents: DataFrame, scanned: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id") -> DataFrame:
    """Documents whose secrets are replaced by a mask, everywhere in the text; n_chars, where present, follows.

    A value is a secret of its text if it is one at any place. Announced values
    that are no key-like stretches are replaced where they stand as words of
    their own, as short ones also occur inside other words. Documents without
    secrets are returned as they are. Values of id_col must be distinct.
    """
    secrets = scanned.where("is_secret").groupBy(id_col).agg(F.array_sort(F.collect_set("candidate")).alias("__secrets"))
    joined = documents.join(secrets, id_col, "left")
    # Longer ones first, so that a secret inside another goes with it.
    ordered = F.array_sort("__secrets", lambda a, b: F.length(b) - F.length(a))
    alone = lambda s: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    masked = lambda t, s: F.when(s.rlike(f"^{CANDIDATE}$"), F.replace(t, s, F.lit(mask))).otherwise(F.regexp_replace(t, alone(s), F.lit(mask)))
    text = F.when(F.col("__secrets").isNull(), F.col("text")).otherwise(F.aggregate(ordered, F.col("text"), masked))
    out = joined.withColumn("text", text)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__secrets").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*documents.columns)


@query("op5_forest_secret_scan")
def op5_forest_secret_scan(spark, sf_dir):
    """Candidates of all documents with the forest's verdict; candidates are shown as digests."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "is_secret")
