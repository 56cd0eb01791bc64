"""Quality rules: a table of thresholds compiled into one projection. DataFrame functions only.

Each rule bounds a share, in per cent, of one measure in another, or a measure by itself (``whole`` empty), for texts
of at least ``from_words`` words. ``measured`` adds the measures to documents, ``judge`` compiles the table and adds
``failed`` (the names of the rules that the text breaks, in the table's order) and ``kept``; nothing is shuffled.

The words of the five-word windows that a text repeats are found inside its row: 64-bit hashes of the windows, and
only where some of them are equal, a sort of them and one pass over the places that repeats begin at.

Cases: a null text has no words and no lines, as an empty one; words and lines are compared as they are written,
white space included in lines; ties and repeated rows are judged each by itself; an empty table gives an empty
result; other columns are carried along whatever their names, but for those that the result has itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, carried

#: Fixed values of the base rules: words of a window, least words, most words in repeated windows (per cent).
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
WORD, SYMBOL, BULLET, ELLIPSIS = r"[^\x20\x09-\x0D]", r"[#*$%&|<>]", r"^[\x20\x09-\x0D]*[-*•]", r"(\.\.\.|…)[\x20\x09-\x0D]*$"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "was", "on", "are", "as", "this", "by", "at", "from", "or", "an",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "ein", "eine", "nicht", "dem", "des", "auf", "für", "im", "sich", "auch", "als",
    "le", "la", "les", "et", "un", "une", "dans", "que", "qui", "pour", "du", "est", "sur", "au", "pas", "plus", "par", "aux",
    "el", "los", "las", "y", "de", "en", "se", "por", "con", "una", "para", "es", "del", "lo", "como", "su", "al",
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


@dataclass(frozen=True)
class Rule:
    name: str
    part: str
    whole: str = ""
    least: int | None = None
    most: int | None = None
    from_words: int = 0


#: The table: lengths, symbols, stop words, lines. Shares are in per cent of ``whole``.
RULES = (
    Rule("few_words", "n_words", least=LEAST_WORDS),
    Rule("repeated_words", "n_repeat_words", "n_words", most=MOST_REPEATED),
    Rule("word_length", "word_chars", "n_words", least=150, most=2500),
    Rule("symbols", "n_symbols", "n_words", most=60),
    Rule("stop_words", "n_stop_words", "n_words", least=1, from_words=100),
    Rule("dup_lines", "n_dup_lines", "n_lines", most=60),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=95, from_words=50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=50),
)
BASE = ("few_words", "repeated_words")


def repeated_words(words: Column, hashes: Column, sorted_windows: Column) -> Column:
    """Words inside windows whose hash occurs at least twice; the last two arguments are columns of their own."""
    alike = F.transform(
        sorted_windows,
        lambda w, k: F.when((w["h"] == F.get(sorted_windows, k - 1)["h"]) | (w["h"] == F.get(sorted_windows, k + 1)["h"]), w["at"]),
    )
    starts = F.array_sort(F.filter(alike, lambda at: at.isNotNull()))
    begun = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        starts, begun,
        lambda done, at: F.struct((done["covered"] + F.least(F.lit(WINDOW), at - done["last"])).alias("covered"), at.alias("last")),
        lambda done: done["covered"],
    )
    return F.when(F.size(sorted_windows) == 0, F.lit(0).cast("long")).otherwise(covered)


def measured(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """docs with MEASURES, all long."""
    rest = docs.drop(*MEASURES)
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    read = rest.select(carried(rest), text.alias("t"), words.alias("words"), F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("lines"))
    windows = F.when(F.size("words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    )
    hashed = read.withColumn("hashes", windows)
    repeats = F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    placed = hashed.withColumn("windows", F.coalesce(repeats, F.array().cast("array<struct<h: bigint, at: int>>")))
    count = lambda kept: F.size(kept).cast("long")
    return placed.select(
        "row",
        count(F.col("words")).alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("hashes"), F.col("windows")).alias("n_repeat_words"),
        count(F.filter("words", lambda w: w.isin(*stop_words))).alias("n_stop_words"),
        count(F.col("lines")).alias("n_lines"),
        count(F.filter("lines", lambda line: line.rlike(BULLET))).alias("n_bullet_lines"),
        count(F.filter("lines", lambda line: line.rlike(ELLIPSIS))).alias("n_ellipsis_lines"),
    ).select("row.*", *MEASURES)


def broken(rule: Rule) -> Column:
    """Whether a document breaks the rule; integer arithmetic only."""
    part = F.col(rule.part) * (100 if rule.whole else 1)
    whole = F.col(rule.whole) if rule.whole else F.lit(1).cast("long")
    bounds = [part < whole * rule.least] * (rule.least is not None) + [part > whole * rule.most] * (rule.most is not None)
    outside = F.lit(False)
    for bound in bounds:
        outside = outside | bound
    return outside & (F.col("n_words") >= rule.from_words) if rule.from_words else outside


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs (with their measures) with ``failed`` and ``kept``, by one projection compiled from the table."""
    unknown = {name for rule in rules for name in (rule.part, rule.whole) if name} - set(MEASURES)
    if unknown:
        raise ValueError(f"no such measures: {sorted(unknown)}")
    names = F.array(*[F.when(broken(rule), F.lit(rule.name)) for rule in rules]) if rules else F.array().cast("array<string>")
    kept = F.lit(True)
    for rule in rules:
        kept = kept & ~broken(rule)
    return docs.drop("failed", "kept").select("*", F.array_compact(names).alias("failed"), kept.alias("kept"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = judge(measured(docs))
    return judged.select("doc_id", *MEASURES[:5], F.arrays_overlap("failed", F.array(*map(F.lit, BASE))).alias("base_failed"), "kept")


OP11_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (
  SELECT doc_id, p, list_slice(words, p, p + {WINDOW - 1}) AS words
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM w)),
h AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS k FROM h) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, len(list_filter(words, lambda x: x IN ({', '.join(f"'{s}'" for s in STOP_WORDS)}))) AS stops, len(lines) AS n_lines,
         len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
         len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars * 100 BETWEEN n_words * 150 AND n_words * 2500 AND n_symbols * 100 <= n_words * 60
       AND (n_words < 100 OR stops * 100 >= n_words) AND n_dup_lines * 100 <= n_lines * 60
       AND (n_words < 50 OR bullets * 100 <= n_lines * 95) AND ellipses * 100 <= n_lines * 50 AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
"""
