"""Quality rules: counts per text, then a log-likelihood ratio of n-grams between trusted and raw text.

Runs of letters and digits and runs of other signs, alone and in pairs, are told apart by a 64-bit hash. Two multinomials
over them, one of the trusted documents and one of all documents, are smoothed by ``prior`` counts per n-gram
(scaled to each side's size) and give every n-gram a log ratio. A document's score is the mean ratio of its n-grams; it
is kept if the score reaches ``threshold``, the same fixed number at every size. Everything is built-in SQL functions:
one pass counts and stores a row per distinct n-gram, whatever their number; two passes look the ratios up. N-grams that make
up at least 1 / ``FREQUENT`` of all (so at most ``FREQUENT`` of them) are broadcast, all others meet their ratio in a shuffle,
where none of them is hot. Ratios are whole millionths, so sums don't depend on their order.

Defined results: null or empty text has no words, score 0 and fails the base rules; a repeated row is scored each time;
an empty table gives an empty table; without trusted documents all ratios are 0 and only the base rules decide.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loantriad.llm.common import WORD_GAP, table
from loantriad.llm.registry import corpus_query
from loantriad.session import materialise, settle

#: Different keys of n-grams: all 64-bit hashes.
BUCKETS = 1 << 64
FREQUENT = 1 << 18
PRIOR = 10
THRESHOLD = -0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SCALE = 1_000_000
#: Fixed by the contract of the counts.
SYMBOLS = "[#*$%&|<>]"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice: sort the windows, compare neighbours, count places."""
    n = F.greatest(F.size(w) - 2, F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(F.arrays_zip(
        F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"), places.alias("at")))
    pairs = F.arrays_zip(windows.alias("x"), F.slice(windows, 2, F.greatest(n - 1, F.lit(0))).alias("y"))
    same = F.filter(pairs, lambda p: (p.x.a == p.y.a) & (p.x.b == p.y.b) & (p.x.c == p.y.c))
    covered = F.flatten(F.transform(same, lambda p: F.array(
        p.x.at, p.x.at + 1, p.x.at + 2, p.y.at, p.y.at + 1, p.y.at + 2)))
    return F.size(F.array_distinct(covered)).cast("long")


def ngrams(text: Column) -> Column:
    """Each token with its successor (null after the last)."""
    w = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"))


def keys_of(g: str) -> list[Column]:
    """Hashes of a token and of its pair (null after the last)."""
    a, b = F.col(f"{g}.a"), F.col(f"{g}.b")
    return [F.when(a.isNotNull(), F.xxhash64(a)), F.when(b.isNotNull(), F.xxhash64(a, b))]


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each n-gram of each text."""
    grams = rows.select(*keep, F.explode(ngrams(F.col("text"))).alias("g"))
    return grams.select(*keep, F.explode(F.array(*keys_of("g"))).alias("gram")).where("gram is not null")


def log_ratios(docs: DataFrame, trusted: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(gram, ratio, frequent) for every n-gram that occurs; ratios in millionths.

    ``trusted`` holds the doc_id of trusted documents; a document counts once however often its id is listed.
    """
    marks = trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("good", F.lit(1))
    marked = docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id", "left")  # one plan at every size
    counts = materialise(exploded(marked, "good").groupBy("gram").agg(
        F.count("*").alias("raw"), F.count("good").alias("target")), "ngram-counts")
    target, raw = counts.agg(F.sum("target"), F.sum("raw")).first()
    share = target / raw if raw else 0.0
    ratio = F.log((F.col("target") + prior) / (F.col("raw") * share + prior))
    return counts.select("gram", F.round(ratio * SCALE).cast("long").alias("ratio"), (F.col("raw") * FREQUENT >= F.lit(raw or 0)).alias("frequent"))


def score(docs: DataFrame, ratios: DataFrame, threshold: float = THRESHOLD,
          min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_failed, llr (mean log ratio), kept."""
    rows = settle(docs.select("doc_id", "text"), "texts").withColumn("row", F.monotonically_increasing_id())
    frequent = ratios.where("frequent").select("gram", "ratio")  # at most FREQUENT rows
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = (
        rows.select("doc_id", text.alias("text"), "row")
        .select("doc_id", "row", "text", words(F.col("text")).alias("w"))
        .select(
            "doc_id", "row", "text", F.size("w").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            duplicate_lines(F.col("text")).alias("n_dup_lines"),
            repeated_words(F.col("w")).alias("n_repeat_words"),
        )
    )
    keys = ["doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    one, two = keys_of("g")
    grams = counted.select(*keys, F.explode_outer(ngrams(F.col("text"))).alias("g")).select(*keys, one.alias("one"), two.alias("two"))
    for key in ("one", "two"):
        grams = grams.join(F.broadcast(frequent.select(F.col("gram").alias(key), F.col("ratio").alias(f"{key}_ratio"))), key, "left")
    summed = grams.groupBy(*keys).agg(
        F.sum(F.coalesce("one_ratio", F.lit(0)) + F.coalesce("two_ratio", F.lit(0))).alias("total"), F.count("one").alias("tokens"))
    others = exploded(rows, "row").join(F.broadcast(frequent.select("gram")), "gram", "left_anti")
    others = others.join(ratios.where("not frequent").hint("merge"), "gram").groupBy("row").agg(F.sum("ratio").alias("others"))
    summed = summed.join(others.hint("merge"), "row", "left").withColumn("total", F.col("total") + F.coalesce("others", F.lit(0)))
    size = F.greatest(2 * F.col("tokens") - 1, F.lit(1))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    llr = F.col("total") / (size * SCALE)
    return summed.select(
        *[k for k in keys if k != "row"], failed.alias("base_failed"), llr.alias("llr"),
        (~failed & (llr >= threshold)).alias("kept"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score ``docs``, trusting those that ``labels`` gives quality 1."""
    return score(docs, log_ratios(docs, labels.where("quality = 1")), threshold)


@corpus_query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
