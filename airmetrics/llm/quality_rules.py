"""Operator 11: quality rules with distribution divergence. DataFrame code only.

Base measures of every whole text (words are runs of other characters than blanks): words, their
characters, symbols, repeated lines, words in repeated 8-word windows; a text fails the base rules
when it has fewer than 20 words or over 30 % of its words stand in repeated windows.

The others are compared with their language:

* Character classes: the histogram of capitals, small letters, digits, blanks, symbols, other ASCII and
  non-ASCII characters.
* Common words: per language the ``n_common`` words that stand in most documents, of those in at least
  ``common_share`` of them (so the candidates to rank are bounded by the length of texts, not by the corpus); a text's
  histogram counts each of them and, as one more bin, all other words.
* References are the summed histograms of all documents of the language with ``least_words`` words or more that pass the base rules.
* The distance is the root of the Jensen-Shannon divergence in bits (0 to 1), rounded to six digits so that
  the order of summation never decides. A text goes when one of its distances is above its limit.
  The default limits come from labelled documents: of those of good quality that pass the base rules, 99.8 % stay.
* Guards: a text under ``least_words`` words, and one whose reference holds under ``least_reference`` words, has no distance
  and is judged by the base rules alone.

Everything about one text is computed in its row; windows are compared by a 64-bit hash (a false repeat
within a text of n words has a chance of n^2 / 2^65), and a text pays for sorting them only when a hash repeats. Spark
shuffles (lang, word) counts after a map-side sum and the references, of which there is one row a language.

Defined results: null text has no words and fails the base rules; null lang counts as the language ''; rows repeated
with one id are judged each; equal document counts rank common words by UTF-8; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airmetrics.llm.common import stored, text_of
from airmetrics.operators.joins import bounded_broadcast

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8
MAX_LISTED = 20_000  # common words of all languages that reach the driver
CLASSES = ["small", "capitals", "digits", "blanks", "symbols", "wide", "other"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _chars(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda x: x != "")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words covered by windows of eight words that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        steps = let(let(ranked, places), lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.get(p, j + 1) - x)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def joined(step: int):
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def of(w: Column) -> Column:
        # hashes of 1, 2, 4 and 8 words from each place on; the last seven places hold no whole window
        eight = let(let(let(F.transform(w, lambda x: F.xxhash64(x)), joined(1)), joined(2)), joined(4))
        return F.when(F.size(w) < WINDOW, 0).otherwise(
            let(F.slice(eight, F.lit(1), F.size(w) - (WINDOW - 1)),
                lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))

    return let(words, of).cast("long")


def common_words(docs: DataFrame, n_common: int, common_share: float, text_col: str, lang_col: str) -> DataFrame:
    """(lang, common): per language its common words, most frequent first."""
    rows = docs.select(_lang(docs, lang_col), text_of(docs, text_col).alias("text"))
    n_docs = rows.groupBy("lang").agg(F.count("*").alias("n_docs"))
    found = (rows.select("lang", F.explode(F.array_distinct(words_of(F.lower("text")))).alias("word"))
             .groupBy("lang", "word").agg(F.count("*").alias("n")))
    ranked = (found.join(bounded_broadcast(n_docs), "lang").where(F.col("n") >= F.col("n_docs") * common_share)
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= n_common))
    return ranked.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("common"))


def _lang(docs: DataFrame, lang_col: str) -> Column:
    return F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang")


def _runs(words: Column, common: Column, listed: list[str] | None) -> Column:
    """array<struct<k, n>>: how often each common word (place k) stands in the text; 0 for all other words."""
    some = words if listed is None else F.filter(words, lambda w: w.isin(listed))
    places = lambda s: F.sort_array(F.filter(F.transform(s, lambda w: F.array_position(common, w).cast("int")), lambda k: k > 0))

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        return let(ends, lambda e: F.transform(e, lambda end, j: F.struct(
            F.get(s, end - 1).alias("k"), (end - F.coalesce(F.get(e, j - 1), F.lit(0))).cast("long").alias("n"))))

    def of(s: Column) -> Column:
        other = F.array(F.struct(F.lit(0).alias("k"), (F.size(words) - F.size(s)).cast("long").alias("n")))
        return F.when(F.size(s) > 0, F.concat(other, runs(s))).otherwise(other)

    return let(places(some), of)


def measures(docs: DataFrame, n_common: int = 40, common_share: float = 0.05, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """The written table of all measures: id, lang, base measures, ``classes`` (character counts) and ``runs``."""
    common = stored(common_words(docs, n_common, common_share, text_col, lang_col), "common-words")
    text = F.col("text")
    # one hash set of all common words spares most words the search in their language's list; beyond the bound there is none
    listed = [r[0] for r in common.select(F.explode("common")).distinct().limit(MAX_LISTED + 1).collect()]
    listed = listed if 0 < len(listed) <= MAX_LISTED else None
    rows = (docs.select(docs[id_col].alias("id"), _lang(docs, lang_col), text_of(docs, text_col).alias("text"))
            .join(bounded_broadcast(common), "lang", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>"))))
    # what several measures use stands in a projection of its own, so that Spark computes it once
    rows = rows.select("id", "lang", "common", "text", words_of(text).alias("words"), words_of(F.lower(text)).alias("low"),
                       _chars(text, BLANK).alias("n_blanks"), _chars(text, SYMBOLS).alias("n_symbols"), F.length(text).cast("long").alias("n_chars"))
    counts = [_chars(text, "[a-z]+"), _chars(text, "[A-Z]+"), _chars(text, "[0-9]+"), F.col("n_blanks"), F.col("n_symbols"), _chars(text, r"[^\x00-\x7F]+")]
    known = rows.select(
        "id", "lang", F.size("words").cast("long").alias("n_words"), (F.col("n_chars") - F.col("n_blanks")).alias("word_chars"), "n_symbols",
        repeated_lines(text).alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"), F.array(*counts).alias("c"), "n_chars",
        F.coalesce(_runs(F.col("low"), F.col("common"), listed), F.array().cast("array<struct<k:int,n:bigint>>")).alias("runs"))
    rest = F.col("n_chars") - F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stored(known.select("id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                               F.concat("c", F.array(rest)).alias("classes"), "runs"), "quality-measures")


def _distance(bins: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of the counts ``bins`` (struct k, n) and ``reference`` (map k -> share)."""
    total = F.aggregate(bins, F.lit(0).cast("long"), lambda a, x: a + x["n"]).cast("double")

    def part(x: Column, t: Column) -> Column:
        p, q = x["n"] / t, F.coalesce(F.try_element_at(reference, x["k"]), F.lit(0.0))
        # shares of the reference outside of the text's bins count 1/2 each: 1/2 q here is taken off the whole
        own = p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0) - q
        return F.when(p > 0, own / 2).otherwise(0.0)

    js = let(total, lambda t: F.aggregate(bins, F.lit(0.5), lambda a, x: a + part(x, t)))
    return F.round(F.sqrt(F.greatest(js, F.lit(0.0))), 6)


def _reference(known: DataFrame, bins: Column, name: str) -> DataFrame:
    """(lang, map bin -> share, words) of the documents that count for the references."""
    sums = known.select("lang", F.explode(bins).alias("x")).groupBy("lang", "x.k").agg(F.sum("x.n").alias("n")).where("n > 0")
    listed = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("bins"), F.sum("n").cast("double").alias("t"))
    return listed.select("lang", F.map_from_entries(F.transform("bins", lambda x: F.struct(x["k"], x["n"] / F.col("t")))).alias(name))


def judge(docs: DataFrame, class_limit: float = 0.25, word_limit: float = 0.37, least_words: int = 50, least_reference: int = 5_000,
          n_common: int = 40, common_share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, n_words, the four measures, base_failed, class_distance, word_distance (null where a guard holds) and kept."""
    known = measures(docs, n_common, common_share, id_col, text_col, lang_col)
    classes = F.transform("classes", lambda n, i: F.struct(i.alias("k"), n.alias("n")))
    used = known.where(f"not base_failed and n_words >= {least_words}")
    reference = (_reference(used, classes, "class_share").join(_reference(used, F.col("runs"), "word_share"), "lang")
                 .join(used.groupBy("lang").agg(F.sum("n_words").alias("reference_words")), "lang"))
    reference = stored(reference.where(F.col("reference_words") >= least_reference), "references")
    held = known.join(bounded_broadcast(reference), "lang", "left")
    guard = (F.col("n_words") >= least_words) & F.col("reference_words").isNotNull()
    judged = held.withColumn("class_distance", F.when(guard, _distance(classes, F.col("class_share")))).withColumn(
        "word_distance", F.when(guard, _distance(F.col("runs"), F.col("word_share"))))
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= class_limit) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return judged.select("id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance",
                         "word_distance", (~F.col("base_failed") & fits).alias("kept"))
