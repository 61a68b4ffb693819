"""URL filters: explicit rules first, then the empirical-Bayes reputation of the host.

Labelled pages are bad or good outcomes of their host. The bad rate of a host is
shrunk towards that of its registered domain, the domain's towards that of its
suffix and the suffix's towards the rate of all pages: every level is a
beta-binomial posterior whose prior has the mean of the level above and a
strength that the method of moments finds for the level. A host is blocked if the
lower bound of its posterior bad rate (mean less z standard deviations of the
beta) exceeds ``lift`` times the rate of all labelled pages; a host without any
labelled page has its domain's posterior, and so on upwards.

A reputation belongs to the name of a host, without user and port; an address
(IPv4 or in brackets) is its own domain and suffix.

Counts are combined on the map side, so a host with a third of all pages is one
row a task; the verdicts are joined to the pages by host, where AQE splits a hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import fold_ascii, materialise

# Second labels under which, below a country's two letters, names are registered; all other suffixes have one label.
SECOND = "ac co com edu firm gob gouv gov govt gv info ltd mil name ne net nhs nom or org plc police sch web".split()
TWO_LABELS = rf"(?:^|\.)(?:{'|'.join(SECOND)})\.[a-z][a-z]$"
ADDRESS = r"^(?:\[.*|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$"
#: The number of the document that a page shows, at the end of the path of its url.
NUMBER = r"/([0-9]{1,18})(?:\.html)?/?$"


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str  # host/path-prefix

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


@dataclass(frozen=True)
class Reputation:
    """``z``: width of the bound; ``lift``: how many times the rate of all pages a host's bound may be; strengths are kept in ``strength``."""

    z: float = 0.5
    lift: float = 1.0
    strength: tuple[float, float] = (1.0, 1000.0)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) columns; both empty for null or without ``://``."""
    pattern = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return fold_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """The host without user, port and trailing dots; an address in brackets keeps them."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def levels(name: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host's name."""
    last = lambda n: F.substring_index(name, ".", -n)
    two, address = name.rlike(TWO_LABELS), name.rlike(ADDRESS)
    domain, suffix = F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))
    return F.when(address, name).otherwise(domain), F.when(address, name).otherwise(suffix)


def shown(pages: DataFrame) -> DataFrame:
    """(page_id, name, doc_id) of the pages whose url ends in the number of a document."""
    host, path = split_url(F.col("url"))
    number = F.regexp_extract(path, NUMBER, 1)
    return pages.select("page_id", name_of(host).alias("name"), F.when(number != "", number).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull())


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of the pages that show a document with both its labels: bad if it is toxic or of low quality."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    marks = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return shown(pages).join(marks, "doc_id").select("page_id", "bad")


def _strength(groups: DataFrame, how: Reputation) -> float:
    """Strength of the beta prior of groups(n, k, mean): method of moments over groups with two or more outcomes.

    With group rates p = k / n, their excess variance over the binomial gives the
    intra-class correlation rho; the strength is 1 / rho - 1, kept within bounds.
    """
    low, high = how.strength
    many = groups.where("n >= 2")
    p = F.col("k") / F.col("n")
    got = many.agg(
        F.sum(F.col("n") * F.pow(p - F.col("mean"), 2)),
        F.sum(F.col("mean") * (1 - F.col("mean"))),
        F.sum((F.col("n") - 1) * F.col("mean") * (1 - F.col("mean"))),
    ).first()
    if got[0] is None or not got[2]:
        return high
    # E[n (p - m)^2] = m (1 - m) (1 + (n - 1) rho)
    rho = (got[0] - got[1]) / got[2]
    return high if rho <= 0 else min(high, max(low, 1 / rho - 1))


def reputation(hosts: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """(name, n, k, mean, bound, blocked) from ``hosts(name, n, k)``: pages with outcomes and bad ones among them."""
    domain, suffix = levels(F.col("name"))
    base = materialise(hosts.select("name", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    n, k = base.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    top = (k + 0.5) / (n + 1.0)

    def shrunk(groups: DataFrame, strength: float) -> Column:
        return (F.col("k") + F.lit(strength) * F.col("mean")) / (F.col("n") + F.lit(strength))

    add = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = base.groupBy("suffix").agg(*add).withColumn("mean", F.lit(top))
    s = _strength(suffixes, how)
    suffixes = suffixes.select("suffix", shrunk(suffixes, s).alias("mean"))
    domains = base.groupBy("suffix", "domain").agg(*add).join(suffixes, "suffix")
    d = _strength(domains, how)
    domains = domains.select("domain", "suffix", shrunk(domains, d).alias("mean"))
    own = base.join(domains, ["domain", "suffix"])
    h = _strength(own, how)
    alpha, beta = F.col("k") + h * F.col("mean"), F.col("n") - F.col("k") + h * (1 - F.col("mean"))
    mean = alpha / (alpha + beta)
    spread = F.sqrt(alpha * beta / (F.pow(alpha + beta, 2) * (alpha + beta + 1)))
    judged = own.select("name", "n", "k", mean.alias("mean"), (mean - how.z * spread).alias("bound"))
    return judged.withColumn("blocked", F.col("bound") > how.lift * top)


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, how: Reputation = Reputation()) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's ``bad_rate`` and ``bound``, for every row of ``pages``.

    ``outcomes(page_id, bad)``: 0 or 1 for labelled pages; several outcomes of a
    page count as bad if any is. Null outcomes say nothing. A null url or one
    without ``://`` has empty host and path and is judged as the host ''. Only
    page_id and url are read; repeated rows keep their own row; no pages, no rows.
    """
    host, path = split_url(F.col("url"))
    seen = materialise(pages.select("page_id", host.alias("host"), path.alias("path"), name_of(host).alias("name")), "urls")
    known = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts = (
        seen.join(known, "page_id", "left")
        .groupBy("name")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    )
    found = materialise(reputation(hosts, how), "reputation").select("name", F.col("mean").alias("bad_rate"), "bound", "blocked")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return seen.join(found, "name").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "bad_rate", "bound",
    )


#: DuckDB's ``name_of`` over a column ``host``.
NAME_SQL = "regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '\\.+$', '')"


def sql(rules: tuple[Rule, ...] = RULES, how: Reputation = Reputation()) -> str:
    """The same in DuckDB over ``pages`` and ``labels``."""
    pattern = "^[\\s\\S]*?://([^/?#]*)([^?#]*)"
    low, high = how.strength
    ordered = sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{what(r)}'" for r in ordered) + " END"
    strength = lambda t: f"""(SELECT CASE WHEN a IS NULL OR c = 0 OR (a - b) / c <= 0 THEN {high} ELSE least({high}, greatest({low}, 1 / ((a - b) / c) - 1)) END
      FROM (SELECT sum(n * pow(k / n - mean, 2)) AS a, sum(mean * (1 - mean)) AS b, sum((n - 1) * mean * (1 - mean)) AS c FROM {t} WHERE n >= 2))"""  # noqa: E731
    return f"""
WITH raw AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{pattern}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '{pattern}', 2) AS path FROM pages
), seen AS (
  SELECT *, {NAME_SQL} AS name, TRY_CAST(regexp_extract(path, '{NUMBER}', 1) AS BIGINT) AS doc_id FROM raw
), known AS (
  SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM seen JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1
), hosts AS (
  SELECT name, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM seen LEFT JOIN known USING (page_id) GROUP BY name
), parts AS (SELECT *, string_split(name, '.') AS p, regexp_matches(name, '{TWO_LABELS}') AS two, regexp_matches(name, '{ADDRESS}') AS address FROM hosts),
base AS (
  SELECT name, n, k, CASE WHEN address THEN name WHEN two THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
         CASE WHEN address THEN name WHEN two THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM parts
), top AS (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) AS rate FROM base),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT rate FROM top) AS mean FROM base GROUP BY suffix),
s1 AS (SELECT suffix, (k + s * mean) / (n + s) AS mean FROM s0, (SELECT {strength('s0')} AS s)),
d0 AS (SELECT domain, b.suffix, sum(n) AS n, sum(k) AS k, any_value(mean) AS mean FROM base b JOIN s1 USING (suffix) GROUP BY domain, b.suffix),
d1 AS (SELECT domain, suffix, (k + s * mean) / (n + s) AS mean FROM d0, (SELECT {strength('d0')} AS s)),
h0 AS (SELECT name, n, k, mean FROM base JOIN d1 USING (domain, suffix)),
h1 AS (SELECT name, k + s * mean AS a, n - k + s * (1 - mean) AS b FROM h0, (SELECT {strength('h0')} AS s)),
judged AS (SELECT name, a / (a + b) AS bad_rate, a / (a + b) - {how.z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS bound FROM h1)
SELECT page_id, host, path, {case(lambda r: r.rule)} AS rule,
       coalesce({case(lambda r: r.verdict)}, CASE WHEN bound > {how.lift} * (SELECT rate FROM top) THEN 'block' ELSE 'allow' END) AS verdict,
       round(bad_rate, 9) AS bad_rate, round(bound, 9) AS bound
FROM seen JOIN judged USING (name)
"""
