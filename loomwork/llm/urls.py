"""URL filtering: allow and block rules by host and path prefix, then a list of canonical URLs.

A blocked Bloom filter of the listed URLs (each URL sets bits in one 256-bit block of four longs) passes the possible
hits; only those are joined by hash with the list itself, which removes the false positives. Everything is made of
DataFrame functions.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is on no list, so it is
allowed. Repeated rows are judged alike. An empty list blocks nothing. Columns named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Filter
from .common import OWN, drop_clashing, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


#: The stated rules.
RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without a leading ``www.`` or ``m.``, default file names and endings, and slashes at the end."""
    host = F.regexp_replace(host, r"\A(www|m)\.|(:80|:443)\z", "")
    return F.concat(host, F.regexp_replace(path, r"(/index)?(\.html?|\.php)?/*\z", ""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``canonical``, ``rule`` and ``verdict``.

    ``listed`` has one string column of canonical URLs to block. A filter of them is broadcast while its size stays
    under BROADCAST_BYTES (about four million URLs), so that only the possible hits are shuffled; beyond that every page
    without a rule is. The hit rows of a hot URL are split by adaptive execution, as the list has each URL once.
    """
    rules = RULES if rules is None else rules
    made = ["host", "path", "canonical", "rule", "verdict"]
    host, path = host_of(F.col(url)), path_of(F.col(url))
    pages = drop_clashing(pages, [c for c in made if c != url]).withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"canonical": canonical(F.col("host"), F.col("path")), "rule": name, "verdict": verdict})

    key, maybe, names = f"{OWN}listed", f"{OWN}maybe", pages.columns
    listed = written(listed.select(F.col(listed.columns[0]).alias(key)).where(f"{key} <> ''").distinct(), "url-list")
    bloom = Filter(listed, key, listed.count())
    unruled = F.when(F.col("verdict").isNull(), F.col("canonical"))
    pages = bloom.marked(pages, unruled, maybe) if bloom.small else pages.withColumn(maybe, F.col("verdict").isNull())
    sure = pages.where(~F.col(maybe)).select(*names).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    hits = pages.where(maybe).select(*names).join(listed.hint("shuffle_hash"), F.col("canonical") == F.col(key), "left")
    hits = hits.withColumn("verdict", F.when(F.col(key).isNotNull(), "block").otherwise("allow")).select(*names)
    return sure.unionByName(hits)


#: Words of a host's name that put its pages on the list that the registered query uses.
BAD_HOST = r"(^|[.-])(cheap|pills|casino|viagra|porn|xxx|warez)([.-]|$)"


def query(spark, sf_dir: str) -> DataFrame:
    """Judges every page; the list is made of the canonical URLs that the table holds on hosts with BAD_HOST names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = host_of(F.col("url"))
    listed = pages.where(host.rlike(BAD_HOST)).select(canonical(host, path_of(F.col("url"))).alias("canonical"))
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE NULL END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(substr(rest, 1 + length(regexp_extract(rest, '^[^/?#]*'))), '^[^?#]*'), '') AS path
  FROM cut
), judged AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule,
    regexp_replace(regexp_replace(regexp_replace(host, '^(www|m)\.', ''), '(:80|:443)$', '') || path, '(/index)?(\.html?|\.php)?/*$', '') AS canonical
  FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM judged WHERE regexp_matches(host, '(^|[.-])(cheap|pills|casino|viagra|porn|xxx|warez)([.-]|$)')
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
