"""URL verdicts: explicit rules, and empirical-Bayes reputations of hosts for the rest.

Labelled page outcomes are shrunk along host, registered domain and public suffix. Every level is a
beta-binomial: its prior has the mean of the level above and a strength that is estimated, by the
method of moments, from how much its units differ. A host is blocked if the lower posterior bound of
its rate of bad pages exceeds what is allowed.

Strengths are kept in bounds: ``MOST_STRENGTH`` also stands for units that differ no more than chance
makes them, so without any difference every host has about the rate of all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.workspace import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Public suffixes of two labels.
LONG_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp",
    "or.jp", "co.kr", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "com.ar",
)
Z = 1.645
MAX_BAD = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 0.5, 1000.0


def with_host_and_path(pages: DataFrame, url_col: str) -> DataFrame:
    """``pages`` with ``host`` and ``path``; both empty for NULL and for urls without ``://``."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def matching_rule(
    rules: Sequence[tuple[str, str, str]], host: Column, path: Column
) -> Column:
    """``struct<size, verdict, rule>`` of the longest fitting ``(verdict, host, path)``, or NULL.

    Of rules of one length, ``block`` wins. Without any rule it is NULL everywhere.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    known = F.array(
        *[
            F.struct(
                F.lit(len(h) + len(p)).alias("size"),
                F.lit(verdict).alias("verdict"),
                F.lit(h + p).alias("rule"),
                F.lit(h).alias("host"),
                F.lit(p).alias("path"),
            )
            for verdict, h, p in rules
        ]
    )
    fitting = F.filter(
        known,
        lambda r: F.concat(F.lit("."), host).endswith(F.concat(F.lit("."), r["host"]))
        & path.startswith(r["path"]),
    )
    return F.array_max(fitting)


def suffix_of(host: Column) -> Column:
    """Last label, or the last two where they are a public suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more; an address of digits is its own domain."""
    two = F.substring_index(host, ".", -2)
    three = F.substring_index(host, ".", -3)
    named = F.when(two.isin(*LONG_SUFFIXES), three).otherwise(two)
    return F.when(host.rlike("^[0-9.]+$"), host).otherwise(named)


def _strength(units: DataFrame) -> DataFrame:
    """One row ``strength`` of units ``(n, bad, parent)``: how firmly the parent's rate holds.

    Under a beta-binomial of correlation rho, ``n (bad / n - parent)^2`` is on average
    ``parent (1 - parent) (1 + (n - 1) rho)``; the strength is ``1 / rho - 1``, kept in bounds.
    """
    noise = F.col("parent") * (1 - F.col("parent"))
    seen = units.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("parent"), 2)).alias("spread"),
        F.sum(noise).alias("alone"),
        F.sum(noise * (F.col("n") - 1)).alias("shared"),
    )
    rho = F.try_divide(F.col("spread") - F.col("alone"), F.col("shared"))
    strength = F.when(rho > 0, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), 1 / rho - 1)))
    return seen.select(F.coalesce(strength, F.lit(MOST_STRENGTH)).alias("strength"))


def _shrunk(units: DataFrame) -> DataFrame:
    """Units with the posterior ``alpha`` and ``beta`` of their bad rate and its mean ``rate``."""
    strength = F.broadcast(_strength(units))  # one row
    alpha = F.col("bad") + F.col("strength") * F.col("parent")
    beta = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("parent"))
    return (
        units.join(strength)
        .withColumns({"alpha": alpha, "beta": beta, "rate": alpha / (alpha + beta)})
        .drop("strength")
    )


def host_reputations(outcomes: DataFrame) -> DataFrame:
    """``(host, n, bad, rate, lower)`` of every host of ``outcomes(host, bad)``.

    ``bad`` is 1, 0 or NULL for pages without a known outcome; hosts without any outcome have the
    prior of their domain. ``lower`` is the bound ``mean - 1.645 standard deviations`` of the
    posterior. All outcomes unknown: the mean of all is one half.
    """
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    hosts = materialize(hosts, "hosts")  # every level reads its units twice
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(domains, "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("parent"))
    suffixes = _shrunk(suffixes.join(F.broadcast(overall)))  # one row
    above = suffixes.select("suffix", F.col("rate").alias("parent"))
    domains = _shrunk(domains.join(above, "suffix"))
    above = domains.select("domain", "suffix", F.col("rate").alias("parent"))
    hosts = _shrunk(hosts.join(above, ["domain", "suffix"]))
    total = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    return hosts.select("host", "n", "bad", "rate", (F.col("rate") - Z * deviation).alias("lower"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    id_col: str,
    url_col: str,
    rules: Sequence[tuple[str, str, str]],
    max_bad: float = MAX_BAD,
) -> DataFrame:
    """``(id, host, path, rule, verdict, n, rate, lower)`` of every page: its rule's verdict, else its
    host's, which has ``n`` known pages, the posterior mean ``rate`` and its bound ``lower``.

    ``outcomes`` is ``(id, bad)`` with one row per known page. An empty table of pages gives an empty
    result; without rules every verdict is the host's. NULL urls and urls without ``://``
    have an empty host, which has a reputation like any other. NULL ids have no outcome; repeated
    pages stay and count as often. Other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    rows = with_host_and_path(rows, "url").drop("url")
    known = outcomes.select(F.col("id"), F.col("bad").cast("int").alias("bad")).groupBy("id")
    known = known.agg(F.max("bad").alias("bad"))
    reputations = host_reputations(rows.join(known, "id", "left").select("host", "bad"))
    judged = rows.join(reputations.select("host", "n", "rate", "lower"), "host").withColumn(
        "found", matching_rule(rules, F.col("host"), F.col("path"))
    )
    own = F.when(F.col("lower") > max_bad, "block").otherwise("allow")
    return judged.select(
        "id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", own).alias("verdict"),
        "n",
        "rate",
        "lower",
    )


def judge_urls_sql(rules: Sequence[tuple[str, str, str]], max_bad: float = MAX_BAD) -> str:
    """The query over ``pages`` and ``labels`` as DuckDB SQL, rates rounded to six digits."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)

    def last(k: int) -> str:
        parts = "string_split(host, '.')"
        return f"array_to_string(list_slice({parts}, greatest(1, len({parts}) - {k - 1}), len({parts})), '.')"

    def shrunk(units: str, key: str) -> str:
        return f"""
        SELECT {key}, n, bad, parent, bad + strength * parent AS alpha,
            n - bad + strength * (1 - parent) AS beta,
            (bad + strength * parent) / (n + strength) AS rate
        FROM {units}, (
            SELECT coalesce(CASE WHEN rho > 0 THEN greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, 1 / rho - 1)) END,
                {MOST_STRENGTH}) AS strength
            FROM (SELECT (sum(n * pow(bad / n - parent, 2)) - sum(parent * (1 - parent)))
                / nullif(sum(parent * (1 - parent) * (n - 1)), 0) AS rho FROM {units} WHERE n > 0))"""

    return f"""
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0
            THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hosted AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path
        FROM cut),
    known AS (
        SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
        FROM labels GROUP BY doc_id),
    counted AS (
        SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
        FROM hosted LEFT JOIN known USING (page_id) GROUP BY host),
    hosts AS (
        SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host
                WHEN {last(2)} IN ({long}) THEN {last(3)} ELSE {last(2)} END AS domain,
            CASE WHEN {last(2)} IN ({long}) THEN {last(2)} ELSE {last(1)} END AS suffix
        FROM counted),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
    suffix_units AS (
        SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM suffixes) AS parent FROM suffixes),
    suffix_rates AS ({shrunk("suffix_units", "suffix")}),
    domain_units AS (
        SELECT d.*, s.rate AS parent FROM domains d JOIN suffix_rates s USING (suffix)),
    domain_rates AS ({shrunk("domain_units", "domain, suffix")}),
    host_units AS (
        SELECT h.*, d.rate AS parent FROM hosts h JOIN domain_rates d USING (domain, suffix)),
    host_rates AS ({shrunk("host_units", "host")}),
    bounds AS (
        SELECT host, n, rate, rate - {Z} * sqrt(alpha * beta
            / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS lower FROM host_rates),
    verdicts AS (
        SELECT *, CASE WHEN lower > {max_bad} THEN 'block' ELSE 'allow' END AS own FROM bounds),
    rules(verdict, rule_host, rule_path) AS (VALUES {listed}),
    fitting AS (
        SELECT host, path, rule_host || rule_path AS rule, verdict,
            row_number() OVER (PARTITION BY host, path
                ORDER BY length(rule_host || rule_path) DESC, verdict DESC, rule_host DESC) AS place
        FROM (SELECT DISTINCT host, path FROM hosted), rules
        WHERE ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path))
    SELECT page_id, hosted.host, hosted.path, f.rule, coalesce(f.verdict, own) AS verdict,
        n, round(rate, 6) AS rate, round(lower, 6) AS lower
    FROM hosted JOIN verdicts USING (host)
    LEFT JOIN fitting f ON f.host = hosted.host AND f.path = hosted.path AND f.place = 1
    """
