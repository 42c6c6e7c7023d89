"""URL filter rules by hashed expressions.

Each URL is expanded into host-suffix and path-prefix expressions.  Their short
hash prefixes meet the rules' prefixes in an equi-join, full SHA-256 digests
confirm the hits, and the longest fitting rule decides.

Expressions are only made for label counts and path lengths that some rule has;
a rule of another shape cannot equal them, so nothing is lost.  Distinct (host,
path) pairs are judged once and joined back, so a URL held by a third of all
rows costs one lookup; Spark splits the skewed side of the join back.

Defined cases: a null URL or one without ``://`` has empty host and path and
gets the default verdict; repeated rows stay; rules of equal length: longer
host first, then block before allow; an empty page or rule table is fine;
input columns besides id and URL are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

#: Host, path, verdict of the registered query's rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def split_url(url):
    """(host, path) columns: host between the first ``://`` and ``/``, ``?`` or ``#``, A-Z lower-cased; path up to ``?`` or ``#``."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """Verdict per row of ``pages``: id, host, path, rule (null if none fits), verdict.

    ``rules`` has host, path, verdict; a rule fits its host and all subdomains
    when the URL's path starts with the rule's path.
    """
    host, path = split_url(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    # Distinct label counts and path lengths of the rules: a few small numbers whatever the number of rules.
    n_labels, lengths = rules.agg(F.max(F.size(F.split("host", r"\."))), F.sort_array(F.collect_set(F.length("path")))).first()
    hashed = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"), F.concat("host", "path").alias("rule"),
        F.length("host").alias("rule_host"), "verdict").withColumn("prefix", F.substring("rule_digest", 1, prefix_hex))

    labels = F.split("host", r"\.")
    most = F.least(F.size(labels), F.lit(n_labels or 0))
    suffixes = F.transform(F.sequence(F.lit(0), most), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    paths = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths or []]).cast("array<int>"),
                                 lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    spoken = (parsed.filter(F.col("host") != "").select("host", "path").distinct()
              .withColumn("suffix", F.explode(F.slice(suffixes, 2, 1 << 30)))
              .withColumn("start", F.explode(paths))
              .withColumn("digest", _digest(F.col("suffix"), F.col("start")))
              .withColumn("prefix", F.substring("digest", 1, prefix_hex)))
    rank = F.struct(F.length("rule").alias("n"), "rule_host", (F.col("verdict") == "block").alias("block"),
                    "rule", "verdict")
    judged = (spoken.join(hashed, "prefix").filter(F.col("digest") == F.col("rule_digest"))
              .groupBy("host", "path").agg(F.max(rank).alias("best")))
    return (parsed.join(judged, ["host", "path"], "left")
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def op10_url_expressions(spark, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` against the fixed rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP10_SQL = r"""
with p as (
  select page_id,
         case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as rest
  from pages),
q as (
  select page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from p),
rules(rhost, rpath, verdict) as (values
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit as (
  select q.page_id, q.host, q.path, r.rhost || r.rpath as rule, r.verdict,
         row_number() over (partition by q.page_id order by length(r.rhost || r.rpath) desc nulls last) as rn
  from q left join rules r
    on (q.host = r.rhost or ends_with(q.host, '.' || r.rhost)) and starts_with(q.path, r.rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fit where rn = 1
"""
