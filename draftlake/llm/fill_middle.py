"""Fill-in-the-middle: a document's lines are cut in prefix, middle and suffix, and put in an order for infilling.

Where the lines end is found on whole batches of UTF-8 seen as 64-bit words: arithmetic marks the bytes that end a
unit, their number in each word is a bit count, the word of the k-th is found in the running sums of these counts, and
its byte inside the word by clearing lower marks. Code points are counted the same way, by marking the bytes that
continue one. Only places come back from Python; texts are put together, and restored, by Spark's functions.

A unit is ``[^\\n]*\\n|[^\\n]+``. Cuts and form follow from the first four 32-bit numbers of the sha256 of ``seed:doc_id``.
A text that is empty, holds a sentinel, or falls outside ``rate`` stays as it is (form ``plain``).

Cases: a null text is empty; a null doc_id counts as the empty string in the hash; rows that share a doc_id get the same
numbers, each for its own text; a text may be of any length; an empty table gives an empty result; other columns are
carried along whatever their names, but for those that the result has itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import carried
from .words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
RESULT = ("fim_units", "fim_form", "fim_text", "fim_prefix_chars", "fim_middle_chars")
PLACES = "units bigint, prefix bigint, middle bigint, prefix_chars bigint, middle_chars bigint"
_EACH, _LOW, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_ONE, _SEVEN = np.uint64(1), np.uint64(7)


class Marks:
    """Marked bytes (the high bit of each) of a buffer of 64-bit words: rank and select."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each place."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        below = (_ONE << (inside << np.uint64(3))) - _ONE
        return np.where(word > 0, self.upto[word - 1], 0) + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte, from 0."""
        word = np.searchsorted(self.upto, k, "right")
        mark = self.marks[word]
        left = k - np.where(word > 0, self.upto[word - 1], 0)
        for i in range(7):
            mark = np.where(left > i, mark & (mark - _ONE), mark)
        lowest = mark & (~mark + _ONE)
        return word * 8 + (np.bitwise_count(lowest - _ONE) >> 3).astype(np.int64)


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, with zeros after them and at least one word that is all zeros."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def unit_marks(words: np.ndarray, offsets: np.ndarray) -> Marks:
    """Newlines, and the last byte of each text that doesn't end with one."""
    rest = words ^ (_EACH * np.uint64(0x0A))
    marks = ~(((rest & _LOW) + _LOW) | rest | _LOW)
    last = offsets[1:][np.diff(offsets) > 0] - 1
    np.bitwise_or.at(marks, last >> 3, _ONE << (((last & 7).astype(np.uint64) << np.uint64(3)) + _SEVEN))
    return Marks(marks)


def continued(words: np.ndarray) -> Marks:
    """Bytes 10xxxxxx, which begin no code point."""
    return Marks(words & ~(words << _ONE) & _HIGH)


def places(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """Of each text: its units, the bytes and code points of its prefix and of its middle."""
    out = {k: np.zeros(len(texts), np.int64) for k in ("units", "prefix", "middle", "prefix_chars", "middle_chars")}
    for row, end, data, offsets in slices(texts):
        words = as_words(data)
        marks, tails = unit_marks(words, offsets), continued(words)
        before = marks.rank(offsets)
        units = np.diff(before)
        begin, cuts = offsets[:-1], []
        a, b = first[row:end] % (units + 1), second[row:end] % (units + 1)
        for taken in (np.minimum(a, b), np.maximum(a, b)):
            at = begin.copy()
            some = taken > 0
            at[some] = marks.select((before[:-1] + taken)[some] - 1) + 1
            cuts.append(at)
        chars = [np.diff(np.stack([p - tails.rank(p) for p in pair]), axis=0)[0] for pair in ((begin, cuts[0]), (cuts[0], cuts[1]))]
        for name, value in zip(out, (units, cuts[0] - begin, cuts[1] - cuts[0], *chars), strict=True):
            out[name][row:end] = value
    return out


def cut_places(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = places(text, first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(v) for v in found.values()], list(found))


def number(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")


def restored(text: Column, form: Column) -> Column:
    """The document's text from the output and its form."""
    parts = F.split(text, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(text)
    )


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with fim_units, fim_form (plain, psm, spm), fim_text, fim_prefix_chars and fim_middle_chars (null where plain)."""
    rest = docs.drop(*RESULT)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = rest.select(carried(rest), F.coalesce(F.col("text"), F.lit("")).alias("t"), digest.alias("digest"))
    cut = drawn.withColumn("at", arrow_udf(cut_places, PLACES)("t", number(F.col("digest"), 0), number(F.col("digest"), 1)))
    held = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("t", F.lit(sentinel))
    plain = (F.col("t") == "") | held | (number(F.col("digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(number(F.col("digest"), 3) % 100 < spm_rate, "spm").otherwise("psm")
    data, start = F.col("t").cast("binary"), F.lit(1).cast("bigint")
    piece = lambda begin, length: F.substring(data, (start + begin).cast("int"), length.cast("int")).cast("string")
    prefix, middle = piece(F.lit(0), F.col("at.prefix")), piece(F.col("at.prefix"), F.col("at.middle"))
    suffix = piece(F.col("at.prefix") + F.col("at.middle"), F.octet_length("t"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    formed = cut.withColumn("form", form)
    return formed.select(
        "row.*", F.col("at.units").alias("fim_units"), F.col("form").alias("fim_form"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t")).alias("fim_text"),
        F.when(F.col("form") != "plain", F.col("at.prefix_chars")).alias("fim_prefix_chars"),
        F.when(F.col("form") != "plain", F.col("at.middle_chars")).alias("fim_middle_chars"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    return made.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_text"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<P>|<S>|<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, least(a, b)), '') AS pre, array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), '') AS mid,
         array_to_string(list_slice(units, greatest(a, b) + 1, n), '') AS suf FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
