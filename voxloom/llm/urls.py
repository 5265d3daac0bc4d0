"""URL verdicts: fixed host and path rules, then empirical-Bayes reputation of hosts.

Only DataFrame functions.  Labelled page outcomes are counted per host; hosts, registered domains
and suffixes get beta-binomial posteriors, each level's prior centred on its parent's posterior mean.
A prior's strength is fitted by moments over all groups of its level (the weakest where none has two
labels) and cut by what is known of the parent: their variances add, ``1 / s = 1 / fitted + 1 / weight``.
A url without a rule is blocked when the lower bound of its host's posterior bad rate passes the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import write_table

#: Fixed values: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Block where the bad rate is above LIMIT with confidence Z standard errors (one-sided 95 %).
LIMIT, Z = 0.5, 1.645
#: Bounds of a prior's strength, in pages.
STRENGTH = (1.0, 200.0)
#: Public suffixes of two labels under which others register.
SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz ac.nz co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr co.in net.in org.in ac.in "
    "co.za org.za com.br net.br org.br gov.br com.cn net.cn org.cn com.mx org.mx com.ar com.tr org.tr com.tw com.hk com.sg com.my co.id co.th co.il com.ua com.pl "
    "com.es com.pt com.co com.pe com.ve github.io blogspot.com wordpress.com"
).split()
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is the url's or above it and whose path begins it."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _labels_above(host: Column) -> Column:
    """How many last labels make the host's public suffix: two if listed, else one."""
    return F.when(F.substring_index(host, ".", -2).isin(*SUFFIXES), 2).otherwise(1)


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and one label more."""
    return F.when(_labels_above(host) == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.when(_labels_above(host) == 2, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _posterior(groups: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows (keys, {name}_a, {name}_b) of groups (keys, n, bad, m, w): prior mean m, parent's weight w; written.

    Moments: with x = bad and prior mean m, var(x) = n m (1 - m) (1 + (n - 1) rho); summing over
    groups gives rho, and the fitted strength is 1 / rho - 1, within STRENGTH.
    """
    chance = F.col("n") * F.col("m") * (1 - F.col("m"))
    fit = groups.where("n > 1").agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("m"), 2)).alias("seen"), F.sum(chance).alias("base"), F.sum(chance * (F.col("n") - 1)).alias("more")
    ).first()  # one row
    rho = (fit.seen - fit.base) / fit.more if fit.more else 1.0
    fitted = 1 / min(1 / (1 + STRENGTH[0]), max(1 / (1 + STRENGTH[1]), rho)) - 1
    s = 1 / (1 / F.lit(fitted) + 1 / F.col("w"))
    return write_table(groups.select(*keys, (F.col("m") * s + F.col("bad")).alias(f"{name}_a"), ((1 - F.col("m")) * s + F.col("n") - F.col("bad")).alias(f"{name}_b")), f"url-{name}")


def _under(groups: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """Groups with the prior mean m (off 0 and 1) and weight w of their parent."""
    a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
    both = groups.join(parents, key)
    return both.withColumn("m", F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), a / (a + b)))).withColumn("w", a + b)


def reputations(outcomes: DataFrame) -> DataFrame:
    """Rows (host, host_a, host_b) for every host of ``outcomes`` (host, bad 0/1 or null if unlabelled).

    Pages are counted per host before anything is joined, so a hot host is one small row, and each level
    is written once.  Hosts without a label get a prior no stronger than what is known of their parents.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = write_table(hosts.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "url-hosts")
    domains = write_table(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-domains")
    suffixes = write_table(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-suffixes")
    whole = suffixes.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()  # one row
    top = suffixes.withColumn("m", F.lit((whole.bad + 1) / (whole.n + 2))).withColumn("w", F.lit(float(whole.n + 2)))
    by_suffix = _posterior(top, "suffix", ["suffix"])
    by_domain = _posterior(_under(domains, by_suffix, "suffix", "suffix"), "domain", ["domain"])
    return _posterior(_under(hosts, by_domain, "domain", "domain"), "host", ["host"])


def judge(pages: DataFrame, labels: DataFrame, url: str = "url", page: str = "page_id") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, bad_rate, bad_low), one per row of ``pages``.

    ``labels`` (doc_id, quality, toxic) hold outcomes of pages by id: bad is toxic or low quality; a
    page with several labels is bad if any is.  A null url, or one without ``://``, has an empty
    host and path, fits no rule, and is judged as a host of its own.  Rows with null or repeated
    ids are kept; all urls get a verdict.  Empty labels leave the prior alone (nothing is blocked).
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("page_id")).agg(
        F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)).alias("bad")
    )
    rows = pages.select(F.col(page).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputations(rows.join(marks, "page_id", "left").select("host", "bad"))
    a, b = F.col("host_a"), F.col("host_b")
    mean = a / (a + b)
    low = F.greatest(F.lit(0.0), mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1)))
    known = known.select("host", F.round(mean, 9).alias("bad_rate"), F.round(low, 9).alias("bad_low"))
    rows = rows.join(known, "host", "left").withColumn("fit", rule_of(F.col("host"), F.col("path")))
    verdict = F.coalesce("fit.verdict", F.when(F.col("bad_low") > LIMIT, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "bad_low")
