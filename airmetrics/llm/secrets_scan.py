"""Operator 5: secret scan whose false positives are removed by a random forest. DataFrame code only.

* Candidates: token-like strings (``TOKEN``: 16 or more characters of base-64, URL or hex
  alphabets, with a digit), and whatever their length and characters (``PLACED``) values assigned to a key word,
  passwords in links, the formats ``STRICT`` and private-key blocks. They are taken from every whole text with
  their exact spelling, the 60 characters before and the 30 after, and the path of the document where a column
  names one. A link assigned to a key word is no value; punctuation that ends an unquoted value is not part of it.
* Features, all native expressions: length; share of digits, capitals and small letters;
  character transitions (changes between letter, digit, capital and other); distinct
  characters; share of the candidate covered by dictionary words (its letter runs of three or
  more that are common words of the corpus: in ``least_docs`` documents or more); path kind; key
  words before the candidate; an assignment sign before it; known prefixes.
* Forest: Spark ML's random forest, fitted on labelled findings (candidate, neighbours, path
  and a 0/1 label). The fit takes a hash sample of at most about ``max_rows`` of them (a documented bound).
* ``labelled_findings`` makes such labels where none are given, from the tables at hand, by checks
  that are no features of their own: a candidate is a true finding if its whole spelling has one of the strict
  formats ``STRICT`` in its place, and a false one if it stands in a link, a mail address, or
  spells words with separators or a plain number. Candidates that neither check decides carry no label.

A document's findings are the candidates that the forest scores ``threshold`` or more.
``redact`` replaces them in the text, longest first; those under eight characters or of letters alone
and under 16 only where they are assigned or stand in a link, so that other words stay.

Defined results: null and empty texts have no candidates; a candidate that a document
repeats is one finding, with the neighbours of its most telling occurrence (assigned, then behind a key word); rows repeated with one id give the same findings; null paths count
as no path; without labelled findings of both kinds the strict check alone decides; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airmetrics.llm.common import stored, text_of

# fixed values: shapes of candidates, strict formats and key words
TOKEN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
STRICT = (r"^(?:AKIA|ASIA)[A-Z0-9]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36,}$", r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
          r"^AIza[A-Za-z0-9_\-]{35}$", r"^sk_(?:live|test)_[A-Za-z0-9]{16,}$", r"^eyJ[A-Za-z0-9_\-]{10,}$")
PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----"
KEY_WORDS = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private)"
ASSIGNED = KEY_WORDS + r"[A-Za-z0-9_\-]*[\"']?\s*(?::=|[:=])\s*[\"']?$"
LINK_USER = r"://[^\s:/@]*:"
ASSIGN = (rf"(?:{KEY_WORDS}" r"[A-Za-z0-9_\-]*[\"']?\s*(?::=|[:=])\s*(?:(?:bearer|basic)\s+)?[\"']?)")
# an unquoted value runs to the last character of its token that is no closing punctuation: one pass, however long it is
# groups: 1 and 5 stand before the candidate, the others are it
PLACED = (rf"(?:({ASSIGN})(?!-----BEGIN|\w+://)" r"(?:(?<=\")([^\"\n]++)(?=\")|(?<=')([^'\n]++)(?=')|([^\s\"'](?:\S*[^\s.,;:)\]}>\"'])?)))"
          rf"|({LINK_USER})([^\s/@]+)(?=@)"
          rf"|({PEM}" r"(?:[A-Za-z0-9+/=\s:,\\]*+(?:-(?!----)[A-Za-z0-9+/=\s:,\\]*+)*+-----END [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----|(?:\s+[A-Za-z0-9+/=]{20,}+)*+))"
          r"|(?<![A-Za-z0-9+/_\-])(" + "|".join(f"(?:{p[1:-1]})" for p in STRICT) + r")(?![A-Za-z0-9+/_\-])")
_OPEN, _SHUT = "\uFDD0", "\uFDD1"  # no characters of any text
FEATURES = ["f_length", "f_digits", "f_capitals", "f_small", "f_transitions", "f_distinct", "f_words", "f_path",
            "f_key_word", "f_assigned", "f_prefix"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, candidate, before, after, path): distinct candidates of each document with their neighbours."""
    path = docs[path_col].cast("string") if path_col else F.lit(None).cast("string")
    src = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"), path.alias("path"))
    placed = _placed(src)
    # cheap test first: most texts hold no token-like string with a digit
    src = src.where(F.col("text").rlike(TOKEN))
    pieces = F.split("text", rf"(?<![A-Za-z0-9+/_\-])(?={TOKEN})")
    part = src.select("id", "path", F.posexplode(F.arrays_zip(
        pieces.alias("piece"), F.concat(F.array(F.lit("")), F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("left"))))
    found = part.where("pos > 0").select(
        "id", "path", F.regexp_extract(F.col("col.piece"), f"^({TOKEN})", 1).alias("candidate"),
        F.substring(F.col("col.left"), -60, 60).alias("before"),
        F.substring(F.regexp_replace(F.col("col.piece"), f"^{TOKEN}", ""), 1, 30).alias("after"))
    found = found.where((F.length("candidate") >= 16) & F.col("candidate").rlike("[0-9]")).unionByName(placed)
    told = F.struct(_assigned().alias("assigned"), F.col("before").rlike(KEY_WORDS).alias("key_word"), "before", "after")
    return (found.groupBy("id", "candidate").agg(F.max(told).alias("told"), F.min("path").alias("path"))
            .select("id", "candidate", "told.before", "told.after", "path"))


def _assigned() -> Column:
    """The candidate is assigned to a key word, or is the password of a link."""
    return F.col("before").rlike(f"{ASSIGN}$") | _in_link()


def _in_link() -> Column:
    return F.col("before").rlike(f"{LINK_USER}$") & F.col("after").startswith("@")


def _placed(src: DataFrame) -> DataFrame:
    """Candidates known by their place or format: marks are put around them, and the text is split there."""
    src = src.where(F.col("text").rlike(PLACED))
    pieces = F.split(F.regexp_replace("text", PLACED, f"$1$5{_OPEN}$2$3$4$6$7$8{_SHUT}"), _OPEN)
    part = src.select("id", "path", F.posexplode(F.arrays_zip(
        pieces.alias("piece"), F.concat(F.array(F.lit("")), F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("left"))))
    return part.where("pos > 0").select(
        "id", "path", F.substring_index("col.piece", _SHUT, 1).alias("candidate"),
        F.substring(F.regexp_replace("col.left", _SHUT, ""), -60, 60).alias("before"),
        F.substring(F.substring_index("col.piece", _SHUT, -1), 1, 30).alias("after"))


def corpus_words(docs: DataFrame, runs: DataFrame, least_docs: int, text_col: str = "text") -> DataFrame:
    """Of the letter runs in ``runs`` (column ``word``), those that stand as words in ``least_docs`` documents or more."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_of(docs, text_col)), "[^a-z]+"))).alias("word"))
    # counted before the join: a task sends each of its words once, and the plan is the same at every size
    counted = words.where(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_docs).join(runs, "word", "left_semi").select("word")


def _kinds() -> Column:
    """The candidate with each character replaced by its kind: a, A, 0 or a dot."""
    known = F.translate(F.col("candidate"), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                        "a" * 26 + "A" * 26 + "0" * 10)
    return F.regexp_replace(known, "[^aA0]", ".")


def with_features(found: DataFrame, docs: DataFrame, least_docs: int = 20, text_col: str = "text") -> DataFrame:
    """Adds the feature columns."""
    runs = found.select("id", "candidate", F.explode(F.expr("regexp_extract_all(lower(candidate), '[a-z]{3,}', 0)")).alias("word"))
    known = corpus_words(docs, runs.select("word").distinct(), least_docs, text_col)
    covered = (runs.join(known, "word").groupBy("id", "candidate").agg(F.sum(F.length("word")).alias("covered"))
               .withColumnsRenamed({"id": "k_id", "candidate": "k_candidate"}))
    n = F.length("candidate").cast("double")
    kind = _kinds()
    share = lambda p: F.length(F.regexp_replace("candidate", p, "")) / n
    runs_of_kind = F.length(F.regexp_replace(kind, r"(.)\1*", "x")).cast("double")
    path = F.lower(F.coalesce("path", F.lit("")))
    return (found.join(covered, found["id"].eqNullSafe(F.col("k_id")) & (F.col("candidate") == F.col("k_candidate")), "left")
            .drop("k_id", "k_candidate").select(
                "id", "candidate", "before", "after", "path", n.alias("f_length"), share("[^0-9]").alias("f_digits"),
                share("[^A-Z]").alias("f_capitals"), share("[^a-z]").alias("f_small"), ((runs_of_kind - 1) / n).alias("f_transitions"),
                (F.size(F.array_distinct(F.split("candidate", ""))) / n).alias("f_distinct"),
                (F.coalesce("covered", F.lit(0)) / n).alias("f_words"),
                F.when(path.rlike(r"(test|example|sample|doc)"), 2.0).when(path == "", 0.0).otherwise(1.0).alias("f_path"),
                F.col("before").rlike(KEY_WORDS).cast("double").alias("f_key_word"),
                _assigned().cast("double").alias("f_assigned"),
                F.col("candidate").rlike(r"^(?:AKIA|ASIA|gh[pousr]_|xox|AIza|sk_|eyJ|-----BEGIN)").cast("double").alias("f_prefix")))


def _strict() -> Column:
    out = F.lit(False)
    for p in STRICT:
        out = out | F.col("candidate").rlike(p)
    out = out | F.col("candidate").rlike(f"^{PEM}") | _in_link()
    # hex of a fixed even width after an assignment to a key word
    return out | (F.col("candidate").rlike(r"^(?:[0-9a-f]{18}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") & F.col("before").rlike(ASSIGNED))


def labelled_findings(found: DataFrame) -> DataFrame:
    """Candidates with a label: 1 by a strict format, 0 by place or spelling; undecided ones are left out."""
    wrong = (F.col("before").rlike(r"(?i)(?:https?:/*\S*|www\.\S*|[\w.]+@[\w.]*)$") | F.col("after").rlike(r"^(?:@\w|\.(?:com|net|org|html?)\b)")
             | (F.col("candidate").rlike(r"^[0-9+/=_\-]+$") & ~_assigned()) | (F.col("candidate").rlike(r"^[A-Za-z]?[a-z]{1,14}$") & F.col("before").rlike(r":\s+$")) | F.col("candidate").rlike(r"^[A-Za-z]+(?:[/_\-][A-Za-z0-9]+){2,}$"))
    label = F.when(_strict(), 1.0).when(wrong, 0.0)
    return found.withColumn("label", label).where("label is not null")


def fit(labelled: DataFrame, max_rows: int = 20_000, trees: int = 40, depth: int = 6, seed: int = 7):
    """The fitted forest on feature columns and ``label``; None when a class is missing."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not counts.get(0.0) or not counts.get(1.0):
        return None
    share = {c: min(1.0, max_rows / 2 / n) for c, n in counts.items()}
    spread = F.xxhash64("id", "candidate").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    sample = labelled.where(spread < F.when(F.col("label") == 1.0, share[1.0]).otherwise(share[0.0]))
    total = sum(min(n, max_rows / 2) for n in counts.values())
    weight = F.when(F.col("label") == 1.0, total / 2 / min(counts[1.0], max_rows / 2)).otherwise(total / 2 / min(counts[0.0], max_rows / 2))
    data = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(sample.withColumn("weight", weight))
    return RandomForestClassifier(featuresCol="v", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth,
                                  seed=seed).fit(data.select("v", "label", "weight"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, max_rows: int = 20_000, least_docs: int = 20,
         id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """Every candidate: id, candidate, before, after, score, is_secret. ``labelled``: findings with the feature
    columns and ``label`` (see ``with_features``); made from the candidates themselves where none are given."""
    # the features read the candidates three times: written first, the two searches of all texts run once
    spots = stored(candidates(docs, id_col, text_col, path_col), "secret-spots")
    found = stored(with_features(spots, docs, least_docs, text_col), "secret-candidates")
    forest = fit(labelled if labelled is not None else labelled_findings(found), max_rows)
    if forest is None:
        score = _strict().cast("double")
        scored = found.withColumn("score", score)
    else:
        scored = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="v").transform(found)) \
            .withColumn("score", vector_to_array("probability")[1])
    return scored.select("id", "candidate", "before", "after", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns) with their findings replaced in the text; other documents are unchanged."""
    per = (findings.where("is_secret").groupBy("id").agg(F.collect_set("candidate").alias("s"))
           .select(F.col("id").alias("secret_of"), F.array_sort(
               F.col("s"), lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))
               .alias("secrets")))
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = kept.join(per, F.col("row")[id_col].eqNullSafe(F.col("secret_of")), "left")
    quoted = lambda s: F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    in_place = lambda s: F.concat(F.lit(f"({ASSIGN}|{LINK_USER})"), quoted(s), F.lit(r"(?![A-Za-z0-9])"))
    instead = F.lit("$1" + mark.replace("\\", "\\\\").replace("$", "\\$"))
    common = lambda s: (F.length(s) < 8) | s.rlike("^[A-Za-z]{1,15}$")
    clean = F.aggregate("secrets", F.col("row")[text_col], lambda t, s: F.when(
        common(s), F.regexp_replace(t, in_place(s), instead)).otherwise(F.replace(t, s, F.lit(mark))))
    text = F.when(F.col("secrets").isNull(), F.col("row")[text_col]).otherwise(clean)
    return joined.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
