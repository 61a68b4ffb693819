"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are counted into cells (source, language, topic) by their tokens. The
cells' weights are raked until their sums meet three sets of target shares:
source, language and topic. A document is then drawn with the probability of its
cell, weight over tokens, scaled so that the drawn tokens meet the budget.

Languages and topics are declared categories (with ``other`` for the rest), so
their factors are a few numbers. Sources may be any number: they stay a table
with one row a source and one column a declared (language, topic). A round of
raking is one partial aggregation of that table, without any shuffle of it: the
factor of a source follows from its own row, and the sums over sources are one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import drop_tables, materialise, unit_hash

OTHER = "other"


@dataclass(frozen=True)
class Targets:
    """Shares of language and topic by name; of a source by its tokens to the power ``source_power``.

    Shares are scaled to sum 1; with no share for ``other`` what is not named gets none.
    """

    language: tuple[tuple[str, float], ...]
    topic: tuple[tuple[str, float], ...]
    source_power: float = 0.5
    budget: float = 0.5
    rounds: int = 30


DEFAULT = Targets(
    language=(("en", 0.5), ("de", 0.18), ("fr", 0.18), ("es", 0.12), (OTHER, 0.02)),
    topic=(("prose", 0.8), ("table", 0.08), ("notice", 0.06), ("symbols", 0.06)),
)

#: Topics by form: the first that fits. The patterns mean the same in Java and RE2; a
#: text that holds none of the strings in front cannot match, and is told so much faster.
TOPICS = (
    ("notice", ("icen", "opyright"), r"[Ll]icen[cs]ed? |[Cc]opyright"),
    ("table", (" | ",), r" \| .* \| "),
    ("symbols", (), r"[%#&*$]{3}"),
)
PROSE = "prose"


def tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\x0B\f]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    out = F.lit(PROSE)
    for name, parts, pattern in reversed(TOPICS):
        fits = text.rlike(pattern)
        if parts:
            fits = reduce(or_, (text.contains(p) for p in parts)) & fits
        out = F.when(fits, name).otherwise(out)
    return out


def _named(col: Column, names: list[str]) -> Column:
    return F.when(col.isin([n for n in names if n != OTHER]), col).otherwise(F.lit(OTHER))


def _shares(pairs: tuple[tuple[str, float], ...]) -> dict[str, float]:
    out = dict(pairs)
    out.setdefault(OTHER, 0.0)
    whole = sum(out.values())
    return {k: v / whole for k, v in out.items()}


def _total(columns: list[Column]) -> Column:
    return reduce(add, columns, F.lit(0.0))


def cells(features: DataFrame, targets: Targets) -> tuple[DataFrame, list[tuple[str, str]]]:
    """One row a source: ``source``, ``t0``.. tokens of each (language, topic), and the source's target ``want``."""
    langs, topics = list(_shares(targets.language)), list(_shares(targets.topic))
    grid = [(a, b) for a in langs for b in topics]
    long = features.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens"))
    wide = long.groupBy("source").agg(
        *(F.coalesce(F.sum(F.when((F.col("language") == a) & (F.col("topic") == b), F.col("tokens"))), F.lit(0)).cast("double").alias(f"t{k}") for k, (a, b) in enumerate(grid))
    )
    return materialise(wide.withColumn("want", F.pow(_total([F.col(f"t{k}") for k in range(len(grid))]), F.lit(targets.source_power))), "mix-cells"), grid


def rake(wide: DataFrame, grid: list[tuple[str, str]], targets: Targets) -> tuple[dict[tuple[str, str], float], float, float]:
    """Factors of the (language, topic) columns, the scale of the sources' targets, and the residual.

    At most ``targets.rounds`` rounds of source, language, topic; the last is one that
    changes no factor by more than 1e-12 of it. The residual is by how much, as a
    share, the last round still changed a factor: targets that no weights can meet
    together (a language without a topic that it would need) leave one behind. A
    category that has a target but no tokens is left out, as nothing can stand for it.
    """
    lang, top = _shares(targets.language), _shares(targets.topic)
    b, c = dict.fromkeys(lang, 1.0), dict.fromkeys(top, 1.0)
    whole = wide.agg(F.sum("want")).first()[0] or 0.0
    if not whole:
        return dict.fromkeys(grid, 0.0), 1.0, 0.0
    worst = 0.0
    for _ in range(targets.rounds):
        row_sum = _total([F.col(f"t{k}") * F.lit(b[x] * c[y]) for k, (x, y) in enumerate(grid)])
        factor = F.when(row_sum > 0, F.col("want") / F.lit(whole) / row_sum).otherwise(0.0)
        sums = wide.select(*(F.col(f"t{k}") for k in range(len(grid))), factor.alias("a")).agg(*(F.sum(F.col(f"t{k}") * F.col("a")) for k in range(len(grid)))).first()
        held = {g: (s or 0.0) * b[g[0]] * c[g[1]] for g, s in zip(grid, sums, strict=True)}
        worst = 0.0
        for shares, own, at in ((lang, b, 0), (top, c, 1)):
            have = dict.fromkeys(shares, 0.0)
            for g, s in held.items():
                have[g[at]] += s
            open_ = sum(v for k, v in shares.items() if have[k] > 0) or 1.0
            ratio = {k: (shares[k] / open_ / have[k] if have[k] > 0 else 0.0) for k in shares}
            for k in shares:
                own[k] *= ratio[k]
            worst = max([worst, *(abs(r - 1) for k, r in ratio.items() if have[k] > 0 and shares[k] > 0)])
            held = {g: s * ratio[g[at]] for g, s in held.items()}
        if worst < 1e-12:
            break
    return {(x, y): b[x] * c[y] for x, y in grid}, whole, worst


def calibrate(wide: DataFrame, grid: list[tuple[str, str]], factors: dict[tuple[str, str], float], whole: float, budget: float) -> DataFrame:
    """(source, language, topic, weight, prob): ``prob`` = min(1, scale * weight / tokens of the cell).

    The scale is solved so that the expected tokens are ``budget`` of all tokens:
    cells that reach probability 1 stay there and the rest is scaled again, until
    no further cell reaches it.
    """
    row_sum = _total([F.col(f"t{k}") * F.lit(factors[g]) for k, g in enumerate(grid)])
    long = materialise(
        wide.withColumn("a", F.when(row_sum > 0, F.col("want") / F.lit(whole) / row_sum).otherwise(0.0))
        .select(
            "source",
            F.explode(
                F.array(*(F.struct(F.lit(x).alias("language"), F.lit(y).alias("topic"), F.col(f"t{k}").alias("tokens"), (F.col("a") * F.lit(factors[x, y])).alias("rate")) for k, (x, y) in enumerate(grid)))
            ).alias("cell"),
        )
        .select("source", "cell.*")
        .where("tokens > 0"),
        "mix-rates",
    )
    want = budget * (long.agg(F.sum("tokens")).first()[0] or 0.0)
    scale = 0.0
    while True:  # each pass takes at least one more cell to probability 1
        full = F.col("rate") * F.lit(scale) >= 1
        held, rest = long.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("rate")))).first()
        new = (want - (held or 0.0)) / rest if rest else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return long.select("source", "language", "topic", (F.col("tokens") * F.col("rate")).alias("weight"), F.least(F.lit(1.0), F.col("rate") * F.lit(scale)).alias("prob"))


def _features(docs: DataFrame, targets: Targets) -> list[Column]:
    return [
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        _named(F.col("lang"), list(_shares(targets.language))).alias("_language"),
        _named(topic(F.coalesce("text", F.lit(""))), list(_shares(targets.topic))).alias("_topic"),
        tokens(F.col("text")).alias("_tokens"),
    ]


MADE = ["_source", "_language", "_topic", "_tokens", "_weight", "_prob", "_kept", "_residual"]


def mark(docs: DataFrame, targets: Targets = DEFAULT, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) and what the mix needs of each row, computed in one pass and written down."""
    keep = [c for c in (docs.columns if columns is None else columns) if c.lower() not in MADE]
    return materialise(docs.select(*(F.col(f"`{c}`") for c in keep), *_features(docs, targets)), "mix-marks")


def draw(marked: DataFrame, targets: Targets = DEFAULT, seed: int = 17) -> DataFrame:
    """``marked`` with _weight, _prob, _kept and _residual; see ``mix``."""
    narrow = materialise(marked.where("_tokens > 0").groupBy(F.col("_source").alias("source"), F.col("_language").alias("language"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens")), "mix-counts")
    wide, grid = cells(narrow, targets)
    factors, whole, residual = rake(wide, grid, targets)
    probs = materialise(calibrate(wide, grid, factors, whole, targets.budget), "mix-probs").toDF("_source", "_language", "_topic", "_weight", "_prob")
    drop_tables(marked.sparkSession, narrow, wide)
    joined = marked.join(probs, ["_source", "_language", "_topic"], "left")
    prob = F.when(F.col("_tokens") > 0, F.coalesce("_prob", F.lit(0.0))).otherwise(F.lit(targets.budget))
    return joined.select(
        *(F.col(f"`{c}`") for c in marked.columns if c not in MADE), "_source", "_language", "_topic", "_tokens",
        F.when(F.col("_tokens") > 0, F.coalesce("_weight", F.lit(0.0))).otherwise(0.0).alias("_weight"),
        prob.alias("_prob"),
        (unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), str(seed)) < prob).alias("_kept"),
        F.lit(residual).alias("_residual"),
    )


def mix(docs: DataFrame, targets: Targets = DEFAULT, seed: int = 17) -> DataFrame:
    """All rows and columns of ``docs`` plus _source, _language, _topic, _tokens, _weight, _prob, _kept and _residual.

    ``_weight`` is the raked share of the row's cell, ``_prob`` the probability of
    the row, ``_kept`` whether it is drawn: a hash of doc_id and ``seed`` lies below
    ``_prob``, so a run can be repeated and equal ids fare alike. ``_residual`` is
    the same on all rows: what raking left open (see ``rake``), 0 or next to it if
    the targets are met. Rows without tokens (null, empty, blank) weigh nothing in
    the mix and are kept with probability ``targets.budget``. Null sources are the
    source '', null or undeclared languages are ``other``. Columns of ``docs`` with
    any of these names are replaced.
    """
    return draw(mark(docs, targets), targets, seed)


def sql(targets: Targets = DEFAULT, seed: int = 17, passes: int = 25) -> str:
    """The same in DuckDB over ``documents``: doc_id, source, language, topic, tokens, weight, prob, kept, residual.

    Rounds of raking are a recursive table of one row, the factors as lists; so are the passes of the scale.
    """
    lang, top = _shares(targets.language), _shares(targets.topic)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    named = lambda col, names: f"CASE WHEN {col} IN ({', '.join(quote(n) for n in names if n != OTHER)}) THEN {col} ELSE 'other' END"
    form = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), {quote(p)}) THEN {quote(n)}" for n, _, p in TOPICS) + f" ELSE '{PROSE}' END"
    share = lambda shares: "(VALUES " + ", ".join(f"({quote(k)}, {v!r}::DOUBLE)" for k, v in shares.items()) + ")"
    steps = []
    before = "f0"
    steps.append(f"f0 AS MATERIALIZED (SELECT l.k AS language, t.k AS topic, 1.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM {share(lang)} l(k, v), {share(top)} t(k, v))")
    for r in range(1, targets.rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT source, CASE WHEN sum(tokens * b * c) > 0 THEN any_value(want) / sum(tokens * b * c) ELSE 0 END AS a FROM cells JOIN {before} USING (language, topic) GROUP BY source)""")
        steps.append(f"""s{r} AS MATERIALIZED (SELECT f.language, f.topic, b, c, coalesce(sum(tokens * a), 0) * b * c AS held FROM {before} f LEFT JOIN cells USING (language, topic) LEFT JOIN a{r} USING (source) GROUP BY f.language, f.topic, b, c)""")
        steps.append(f"""l{r} AS MATERIALIZED (SELECT k, CASE WHEN have > 0 THEN v / sum(CASE WHEN have > 0 THEN v END) OVER () / have ELSE 0 END AS ratio FROM (SELECT k, any_value(v) AS v, sum(held) AS have FROM s{r} JOIN {share(lang)} l(k, v) ON k = language GROUP BY k))""")
        steps.append(f"""m{r} AS MATERIALIZED (SELECT s.language, s.topic, b * ratio AS b, c, held * ratio AS held FROM s{r} s JOIN l{r} ON k = language)""")
        steps.append(f"""t{r} AS MATERIALIZED (SELECT k, CASE WHEN have > 0 THEN v / sum(CASE WHEN have > 0 THEN v END) OVER () / have ELSE 0 END AS ratio FROM (SELECT k, any_value(v) AS v, sum(held) AS have FROM m{r} JOIN {share(top)} t(k, v) ON k = topic GROUP BY k))""")
        steps.append(f"""f{r} AS MATERIALIZED (SELECT m.language, m.topic, b, c * ratio AS c FROM m{r} m JOIN t{r} ON k = topic)""")
        before = f"f{r}"
    steps.append(f"""rates AS MATERIALIZED (
  SELECT source, language, topic, tokens, CASE WHEN row_sum > 0 THEN want / row_sum ELSE 0 END * b * c AS rate
  FROM (SELECT *, sum(tokens * b * c) OVER (PARTITION BY source) AS row_sum FROM cells JOIN {before} USING (language, topic)))""")
    steps.append("z0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS z)")
    for p in range(1, passes + 1):
        steps.append(f"""z{p} AS MATERIALIZED (SELECT greatest(any_value(z), coalesce(({targets.budget!r} * sum(tokens) - coalesce(sum(tokens) FILTER (WHERE rate * z >= 1), 0)) / nullif(sum(tokens * rate) FILTER (WHERE rate * z < 1), 0), any_value(z))) AS z FROM rates, z{p - 1})""")
    return f"""
WITH marked AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, {named('lang', lang)} AS language, {named(f'({form})', top)} AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x0B\\f]+')) AS BIGINT) AS tokens
  FROM documents
), cells AS MATERIALIZED (
  SELECT source, language, topic, tokens, pow(own, {targets.source_power!r}) / (SELECT sum(pow(o, {targets.source_power!r})) FROM (SELECT sum(tokens) AS o FROM marked WHERE tokens > 0 GROUP BY source)) AS want
  FROM (SELECT *, sum(tokens) OVER (PARTITION BY source) AS own FROM (
    SELECT source, language, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM marked WHERE tokens > 0 GROUP BY ALL))
), {', '.join(steps)}, open AS (
  SELECT coalesce(max(abs(ratio - 1)), 0) AS residual FROM (SELECT ratio FROM l{targets.rounds} UNION ALL SELECT ratio FROM t{targets.rounds}) WHERE ratio > 0
), probs AS (
  SELECT source, language, topic, tokens * rate AS weight, least(1.0, rate * z) AS prob FROM rates, z{passes}
)
SELECT doc_id, source, language, topic, m.tokens, round(CASE WHEN m.tokens > 0 THEN weight ELSE 0 END, 9) AS weight,
       round(CASE WHEN m.tokens > 0 THEN prob ELSE {targets.budget!r} END, 9) AS prob,
       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT) / 4503599627370496.0
         < CASE WHEN m.tokens > 0 THEN prob ELSE {targets.budget!r} END AS kept, (SELECT round(residual, 6) FROM open) AS residual
FROM marked m LEFT JOIN probs USING (source, language, topic)
"""
