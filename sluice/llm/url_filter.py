"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame operations only.

A rule (host and path prefix) fits its host and every subdomain, where the URL's path begins
with the rule's; the longest fitting rule decides. Where none fits, the host's reputation
does: labelled page outcomes are counted by host, and each level's bad share is a
beta-binomial posterior whose prior mean is the posterior mean of the level above: host from
registered domain, domain from suffix, suffix from the whole table. Each level's prior
strength is estimated by moments from the spread of its units. A host is blocked if its
posterior mean less ``z`` posterior deviations exceeds ``threshold``.

Definitions: host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path what follows up to ``?``, ``#`` or the end; null or no ``://``: both empty.
The suffix is the host's last label, the registered domain its last two. Hosts without
labelled pages take their domain's mean. Outcomes with null are ignored; repeated rows each
count. Rules of equal length: the one later in the order of host and path decides. An empty table
gives an empty result. Hosts, domains and suffixes that hold many rows are joined apart from the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import join_on, save

#: (verdict, host, path) of the default rules (fixed values).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url) -> tuple[F.Column, F.Column]:
    """The host and the path of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """(rule as text, its verdict) of the longest fitting rule, else null. ``rules`` is a short list of the caller's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def _strength(units: DataFrame, base: float) -> float:
    """Prior strength of one level by moments: how little its units' shares spread beyond chance."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    row = units.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.sum(n * n).alias("square"), F.sum(n * (bad / n - base) * (bad / n - base)).alias("spread")).first()
    chance = base * (1 - base)
    room = chance * (row["all"] - row["square"] / row["all"] - (row["k"] - 1)) if row["k"] else 0
    rho = (row["spread"] - chance * (row["k"] - 1)) / room if room > 0 else 0.0
    rho = min(0.5, max(0.001, rho))
    return (1 - rho) / rho


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, mean, deviation) of each host's posterior bad share from a saved (host, n, bad)."""
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    named = hosts.withColumns({"domain": F.regexp_extract("host", r"[^.]*\.[^.]*$|^[^.]*$", 0), "suffix": F.regexp_extract("host", r"[^.]*$", 0)})
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = save(named.groupBy("domain", "suffix").agg(*sums), "url-domains")
    suffixes = save(domains.groupBy("suffix").agg(*sums), "url-suffixes")
    of_suffix, of_domain, of_host = (_strength(x, base) for x in (suffixes, domains, hosts))
    top = suffixes.select("suffix", ((F.col("bad") + of_suffix * base) / (F.col("n") + of_suffix)).alias("above"))
    middle = join_on(domains, save(top, "url-above"), "suffix").select("domain", ((F.col("bad") + of_domain * F.col("above")) / (F.col("n") + of_domain)).alias("above"))
    a, b = F.col("bad") + of_host * F.col("above"), F.col("n") - F.col("bad") + of_host * (1 - F.col("above"))
    posterior = join_on(named, save(middle, "url-means"), "domain").select("host", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return posterior.select("host", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, z: float = 1.64, threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, bad_share) for every page.

    ``outcomes``: (id, bad) with bad 0 or 1, for the labelled pages.
    """
    host, path = host_path(F.col(f"`{url}`"))
    parsed = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    marks = outcomes.toDF("of", "bad").where("of is not null and bad is not null").groupBy("of").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counted = parsed.select("id", "host").join(marks, F.col("id") == F.col("of"), "left")
    hosts = save(counted.groupBy("host").agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")), "url-hosts")
    known = save(reputation(hosts), "url-reputation")
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("mean") - z * F.col("deviation") > threshold, "block").otherwise("allow")
    joined = join_on(parsed, known, "host", hosts.select("host", F.col("pages").alias("n")), "left")
    return joined.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.round("mean", 6).alias("bad_share"))


#: The same in DuckDB SQL over ``pages`` and ``labels``, with the default parameters.
SQL = r"""
with p as (
  select page_id, case when url is not null and strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
m as (
  select doc_id, count(*) as n, sum(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels
  where doc_id is not null and quality is not null and toxic is not null group by doc_id),
h as (
  select host, coalesce(sum(n), 0)::double as n, coalesce(sum(bad), 0)::double as bad,
    regexp_extract(host, '[^.]*\.[^.]*$|^[^.]*$', 0) as domain, regexp_extract(host, '[^.]*$', 0) as suffix
  from q left join m on page_id = doc_id group by host),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by domain, suffix),
s as (select suffix, sum(n) as n, sum(bad) as bad from d group by suffix),
g as (select (sum(bad) + 1) / (sum(n) + 2) as base from h),
u as (select 'h' as lv, n, bad from h where n > 0 union all select 'd', n, bad from d where n > 0 union all select 's', n, bad from s where n > 0),
e as (
  select lv, count(*) as k, sum(n) as a, sum(n * n) as sq, sum(n * (bad / n - base) * (bad / n - base)) as spread, min(base * (1 - base)) as chance from u, g group by lv),
r as (
  select lv, least(0.5, greatest(0.001, case when chance * (a - sq / a - (k - 1)) > 0 then (spread - chance * (k - 1)) / (chance * (a - sq / a - (k - 1))) else 0 end)) as rho from e),
w as (
  select coalesce(max(case when lv = 'h' then (1 - rho) / rho end), 999.0) as wh, coalesce(max(case when lv = 'd' then (1 - rho) / rho end), 999.0) as wd,
    coalesce(max(case when lv = 's' then (1 - rho) / rho end), 999.0) as ws from r),
s2 as (select suffix, (bad + ws * base) / (n + ws) as above from s, g, w),
d2 as (select domain, (bad + wd * above) / (n + wd) as above from d join s2 using (suffix), w),
h2 as (select host, bad + wh * d2.above as a, n - bad + wh * (1 - d2.above) as b from h join d2 using (domain), w),
h3 as (select host, a / (a + b) as mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as deviation from h2)
select page_id, q.host, path, rule, coalesce(ruled, case when mean - 1.64 * deviation > 0.5 then 'block' else 'allow' end) as verdict, round(mean, 6) as bad_share
from (select *,
  case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
       when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
       when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
       when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
  case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'allow'
       when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'block'
       when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'allow'
       when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'block' end as ruled from q) q
join h3 on q.host = h3.host
"""
