"""Checks of records and corpus lines; a finding is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.sources.records import read_lines

REQUIRED = ("id", "url", "date_retrieved", "raw_text")


def line_problems(s: Column, labels: str = "module") -> Column:
    """Array of the problems of a line that is not blank, by ``corpus_format``'s labels."""
    double = F.array_contains(F.split(s, " ", -1), "")
    head, tail, tab, cr = s.startswith(" "), s.endswith(" "), s.contains("\t"), s.contains("\r")
    checks = (
        [(double, "multiple consecutive spaces"), (head, "leading space"), (tail, "trailing space"), (tab, "tab character"), (cr, "carriage return")]
        if labels == "module"
        else [(double, "double space"), (head | tail, "edge space"), (tab | cr, "tab or CR")]
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in checks)))


def corpus_format(lines: DataFrame, line_no: str = "line_no", value: str = "value", labels: str = "module") -> DataFrame:
    """(line_no, problem); one line may have several. Blank lines are skipped.

    ``labels``: ``module`` names five problems, ``notebook`` merges them into three.
    """
    s = F.col(value)
    return lines.where(F.length(s) > 0).select(line_no, F.explode(line_problems(s, labels)).alias("problem"))


def record_schema(lines: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """(*keep, problem) of JSON lines: bad JSON, missing keys, wrong types. Blank lines are skipped.

    ``id`` must be an integer (a boolean counts as one), the others strings; more keys are allowed.
    """
    v = F.try_parse_json(F.col(value))
    keys = F.array(*(F.lit(k) for k in REQUIRED))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    found = F.json_object_keys(F.col(value))
    there = lambda k: F.array_contains(found, k)
    missing = F.transform(F.array_except(keys, F.coalesce(found, F.array().cast("array<string>"))), lambda k: F.concat(F.lit("missing key: "), k))
    wrong = [F.when(there("id") & ~F.coalesce(kind("id").isin("BIGINT", "BOOLEAN"), F.lit(False)), F.lit("wrong type: id"))]
    wrong += [F.when(there(k) & ~F.coalesce(kind(k) == "STRING", F.lit(False)), F.lit(f"wrong type: {k}")) for k in REQUIRED[1:]]
    problems = F.when(v.isNull() | found.isNull(), F.array(F.lit("invalid JSON object"))).otherwise(F.concat(missing, F.array_compact(F.array(*wrong))))
    return lines.where(F.trim(F.col(value)) != "").select(*keep, F.explode(problems).alias("problem"))


def check_files(spark: SparkSession, glob: str) -> DataFrame:
    """(file, line_no, problem) of the JSON lines of all files of a glob."""
    return record_schema(read_lines(spark, glob), "value", "file", "line_no")


#: Quality checks of corpus lines: name -> condition over ``value``.
QA = {
    "english": r"(^| )(the|and|of|with|from)( |$)",
    "site_text": r"(?i)copyright|youversion|sign up|bible app|share|next chapter",
    "digit": r"\p{Nd}",
    "missing_letter": r"\x{FFFD}|[\p{L}ʼ][?*_][\p{L}ʼ]",
    "attached_punctuation": r"[^\s.,;:!?()\[\]{}\"][.,;:!?]",
    "short": r"^.{1,2}$",
}


def qa_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """(check, lines) over all lines, in one pass.

    ``missing_letter``: a replacement character, or a stand-in for a letter within a word.
    """
    sums = lines.agg(*(F.count_if(F.col(value).rlike(p)).alias(k) for k, p in QA.items()))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("lines")) for k in QA))))


# What a corpus and its models have to reach.
SENTENCES, EXPONENT, FIT, PERPLEXITY, STOP_WORDS, AUTHORS = 2500, (1.0, 2.0), 0.90, 1000, 30, 2


def thresholds(sentences: Column, s: Column, r2: Column, perplexity: Column, stop_words: Column) -> Column:
    """Array of (check, passed)."""
    checks = {
        "sentences": sentences >= SENTENCES,
        "zipf_exponent": s.between(*EXPONENT),
        "zipf_fit": r2 > FIT,
        "perplexity": (perplexity > 0) & (perplexity < PERPLEXITY),
        "stop_words": stop_words >= STOP_WORDS,
    }
    return F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()))


def submitted(paths: DataFrame, path: str = "path", folder: str = "submissions/", name: str = "HW1_assignment") -> DataFrame:
    """(path, language) of the changed files that are submissions; the language is what follows the number of the group's folder, else null."""
    is_one = F.col(path).startswith(folder) & F.col(path).contains(name)
    language = F.regexp_extract(F.col(path), r"(?:^|/)group_\p{Nd}+_([^/]+)/[^/]*$", 1)
    return paths.where(is_one).select(path, F.when(language != "", language).alias("language"))


def distinct_authors(log: DataFrame, line: str = "line") -> DataFrame:
    """One row: authors (distinct lines that are not blank) and whether they are enough."""
    found = log.agg(F.count_distinct(F.when(F.trim(line) != "", F.trim(line))).alias("authors"))
    return found.withColumn("enough", F.col("authors") >= AUTHORS)
