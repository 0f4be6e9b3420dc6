"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled pages are good or bad. Bad shares are shrunk from the top down: a
suffix's towards that of all pages, a registered domain's towards its suffix's, a
host's towards its domain's, each through a beta prior whose weight is fitted to
how far the groups of that level differ (the analysis-of-variance estimate of
the beta-binomial's intra-class correlation). A host is blocked if the lower
bound of its posterior bad share is above a limit: a host of which little is
known stays. The bound is the posterior's mean less CERTAINTY of its standard
deviations, a normal approximation of the beta quantile.

For reputations a host is known by its name, without user info, port and final dot.
An IP address is a registered domain of its own, and all of them share one suffix. Other
suffixes follow rules in the form of public suffix lists: a suffix, ``*.`` before one
whose every label is a suffix, ``!`` before an exception; the longest rule wins, an
exception wins over all, and without a rule the last label is the suffix. SUFFIX_RULES
holds the common ones of two labels; a full list may be passed instead.

Defined results: a null url, or one without ``://``, has an empty host and path;
the empty host has a reputation of its own; labels with a null id or without a
page count for nothing; several labels of one page count as bad if one is; rows
that repeat count repeatedly; without labels nothing is blocked but by rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from ._common import heavy_keys, looked_up, read


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Common public suffixes of two labels.
SUFFIX_RULES = tuple(
    """
    com.ar com.au net.au org.au edu.au gov.au *.bd com.br net.br org.br gov.br *.ck !www.ck com.cn net.cn org.cn gov.cn edu.cn
    com.co com.eg *.er com.es *.fk com.gr com.hk co.id or.id co.il co.in net.in org.in gov.in ac.in *.jm co.jp ne.jp or.jp ac.jp
    go.jp co.ke *.kh co.kr or.kr com.mx org.mx gob.mx *.mm com.my com.ng *.np co.nz net.nz org.nz govt.nz com.pe *.pg com.ph com.pk
    com.pl com.pt com.ru com.sa com.sg co.th com.tr gov.tr com.tw org.tw com.ua co.uk org.uk ac.uk gov.uk net.uk com.ve com.vn
    co.za org.za gov.za
    """.split()
)
#: A host is blocked if its bad share is above this with the given normal quantile of certainty.
MOST_BAD = 0.5
CERTAINTY = 1.645

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user info, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.?(:[0-9]*)?$", "")


_IP = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"


def _by_length(rules) -> dict[int, tuple[list[str], list[str], list[str]]]:
    """Number of labels to the suffixes, wildcards' bases and exceptions of that many,
    a wildcard's star counting as a label and an exception's first label as well."""
    out: dict[int, tuple[list[str], list[str], list[str]]] = {}
    for r in rules:
        kind, plain = (2, r[1:]) if r.startswith("!") else (1, r[2:]) if r.startswith("*.") else (0, r)
        out.setdefault(plain.count(".") + 1 + (kind == 1), ([], [], []))[kind].append(plain)
    return dict(sorted(out.items()))


def _labels(name: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(name, r"\."), -F.least(F.lit(n), F.size(F.split(name, r"\."))), F.lit(n)), ".")


def suffix_length(name: Column, rules=SUFFIX_RULES) -> Column:
    """Number of labels of a name's suffix; 0 for addresses."""
    size, length, exceptional = F.size(F.split(name, r"\.")), F.lit(1), []
    last = lambda n: F.substring_index(name, ".", -n)
    for n, (plain, wild, but) in _by_length(rules).items():
        fits = (last(n).isin(plain) if plain else F.lit(False)) | ((last(n - 1).isin(wild) & (size >= n)) if wild else F.lit(False))
        length = F.when(fits, n).otherwise(length)
        exceptional += [(last(n).isin(but), n - 1)] if but else []
    for fits, n in exceptional:
        length = F.when(fits, n).otherwise(length)
    return F.when(name.rlike(_IP), 0).otherwise(length)


def suffix_of(name: Column, rules=SUFFIX_RULES) -> Column:
    n = suffix_length(name, rules)
    return F.when(n == 0, F.lit("")).otherwise(_labels(name, n))


def domain_of(name: Column, rules=SUFFIX_RULES) -> Column:
    n = suffix_length(name, rules)
    return F.when(n == 0, name).otherwise(_labels(name, n + 1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _weight_of_prior(groups: DataFrame) -> float:
    """Pseudo-count of the beta prior for groups with ``n`` labels, ``bad`` of them bad."""
    p = F.col("bad") / F.col("n")
    seen = groups.filter("n > 0").agg(
        F.count("*").alias("g"),
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * p * p).alias("npp"),
    )
    r = seen.first()
    g, n = r["g"], float(r["n"] or 0)
    if g < 2 or n <= g:
        return 10.0
    mean = r["bad"] / n
    between = max(0.0, float(r["npp"]) - n * mean * mean) / (g - 1)
    within = max(1e-12, float(r["bad"]) - float(r["npp"])) / (n - g)
    size = (n - float(r["nn"]) / n) / (g - 1)
    alike = (between - within) / (between + (size - 1) * within)
    return min(1e6, max(1.0, 1 / alike - 1)) if alike > 0 else 1e6


def reputations(visited: DataFrame, scratch: Scratch, suffixes=SUFFIX_RULES) -> DataFrame:
    """From rows of ``name``, ``labelled`` and ``bad`` (0 or 1): a table of one row a
    name with ``share`` (posterior mean), ``low`` (its lower bound) and ``rows``."""
    hosts = scratch.keep(
        visited.groupBy("name")
        .agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("rows"))
        .withColumn("domain", domain_of(F.col("name"), suffixes))
        .withColumn("suffix", suffix_of(F.col("name"), suffixes))
    )
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("suffix").alias("suffix"))
    endings = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    all_ = endings.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    top = (float(all_["bad"] or 0) + 0.5) / (float(all_["n"] or 0) + 1)
    by_suffix, by_domain, by_host = (_weight_of_prior(x) for x in (endings, domains, hosts))

    def shrunk(weight: float, towards) -> Column:
        return (F.col("bad") + weight * towards) / (F.col("n") + weight)

    above = endings.select("suffix", shrunk(by_suffix, F.lit(top)).alias("towards"))
    middle = domains.join(above, "suffix").select("domain", shrunk(by_domain, F.col("towards")).alias("towards"))
    a = F.col("bad") + by_host * F.col("towards")
    b = F.col("n") - F.col("bad") + by_host * (1 - F.col("towards"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return scratch.keep(hosts.join(middle, "domain").select("name", "rows", (a / (a + b)).alias("share"), (a / (a + b) - CERTAINTY * deviation).alias("low")))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = MOST_BAD, id_col: str = "page_id", url_col: str = "url", suffixes=SUFFIX_RULES) -> DataFrame:
    """Id, ``host``, ``path``, ``rule``, ``verdict``, ``bad_share``, ``bad_low`` of
    every row of ``pages``; ``outcomes`` has the id column and ``bad`` (boolean)."""
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("name", name_of(F.col("host")))
    known = outcomes.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    # Pages without an id meet no label; they would all share one key.
    zero = F.lit(0).cast("long")
    labelled = parsed.filter("id is not null").select("id", "name").join(known, "id", "left")
    visited = labelled.select("name", F.col("bad").isNotNull().cast("long").alias("labelled"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))
    visited = visited.unionByName(parsed.filter("id is null").select("name", zero.alias("labelled"), zero.alias("bad")))
    with Scratch(pages.sparkSession) as scratch:
        reputation = reputations(visited, scratch, suffixes)
        total = reputation.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
        common = heavy_keys(reputation.withColumn("n", F.col("rows")), "name", total)
        scratch.returned(reputation)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return looked_up(parsed, "name", reputation, common).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("low") > most_bad, "block").otherwise("allow")).alias("verdict"),
        F.col("share").alias("bad_share"),
        F.col("low").alias("bad_low"),
    )


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page; labels with the page's id say which pages are bad."""
    labels = read(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(read(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def _prior_sql(level: str) -> str:
    """A row with ``k``, the weight of the prior at one level."""
    return f"""(SELECT CASE WHEN g < 2 OR n <= g THEN 10.0 WHEN alike > 0 THEN least(1e6, greatest(1.0, 1 / alike - 1)) ELSE 1e6 END AS k FROM (
      SELECT *, (between_ - within_) / (between_ + (size - 1) * within_) AS alike FROM (
        SELECT g, n, greatest(0, npp - n * (bad / n) * (bad / n)) / (g - 1) AS between_, greatest(1e-12, bad - npp) / (n - g) AS within_, (n - nn / n) / (g - 1) AS size
        FROM (SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS nn, sum(n * (bad / n) * (bad / n))::DOUBLE AS npp FROM {level} WHERE n > 0))))"""


def _suffix_sql() -> str:
    """Number of labels of the suffix of ``name``, whose labels are ``parts``."""
    listed = lambda x: ", ".join(f"'{v}'" for v in x)
    last = lambda n: f"array_to_string(parts[-{n} :], '.')"
    cases = []
    for n, (plain, wild, but) in _by_length(SUFFIX_RULES).items():
        cases += [(0, -n, f"{last(n)} IN ({listed(but)})", n - 1)] if but else []
        cases += [(1, -n, f"{last(n)} IN ({listed(plain)})", n)] if plain else []
        cases += [(1, -n, f"len(parts) >= {n} AND {last(n - 1)} IN ({listed(wild)})", n)] if wild else []
    return f"CASE WHEN regexp_matches(name, '{_IP}') THEN 0 {' '.join(f'WHEN {c} THEN {n}' for _, _, c, n in sorted(cases))} ELSE 1 END"


_FITS = [
    (r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))") for r in sorted(RULES, key=lambda r: -len(r.name))
]
OP4_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
known AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', '', 's'), '\\.?(:[0-9]*)?$', '') AS name FROM parsed),
counted AS (SELECT name, string_split(name, '.') AS parts, count(k.bad)::DOUBLE AS n, coalesce(sum(k.bad), 0)::DOUBLE AS bad FROM named LEFT JOIN known k ON page_id = doc_id GROUP BY 1),
hosts AS (
  SELECT name, n, bad, CASE WHEN w = 0 THEN name ELSE array_to_string(parts[-w - 1 :], '.') END AS domain, CASE WHEN w = 0 THEN '' ELSE array_to_string(parts[-w :], '.') END AS suffix
  FROM (SELECT *, {_suffix_sql()} AS w FROM counted)
),
domains AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, max(suffix) AS suffix FROM hosts GROUP BY 1),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1),
top AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS p FROM suffixes),
above AS (SELECT suffix, (bad + k * p) / (n + k) AS towards FROM suffixes, top, {_prior_sql("suffixes")}),
middle AS (SELECT domain, (bad + k * towards) / (n + k) AS towards FROM domains JOIN above USING (suffix), {_prior_sql("domains")}),
posterior AS (SELECT name, bad + k * towards AS a, n - bad + k * (1 - towards) AS b FROM hosts JOIN middle USING (domain), {_prior_sql("hosts")}),
bounds AS (SELECT name, a / (a + b) - {CERTAINTY} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM posterior),
ruled AS (SELECT *, CASE {" ".join(f"WHEN {fits} THEN '{r.name}'" for r, fits in _FITS)} END AS rule, CASE {" ".join(f"WHEN {fits} THEN '{r.verdict}'" for r, fits in _FITS)} END AS said FROM named)
SELECT page_id, ruled.host AS host, path, rule, coalesce(said, CASE WHEN low > {MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled JOIN bounds ON ruled.name = bounds.name
"""
