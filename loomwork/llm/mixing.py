"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

Sources are the leaves of a tree: domain, language, source. A budget of tokens flows down it by weights. A node can take
no more than its leaves hold in ``max_epochs`` passes; one of weight 0 takes nothing, so nothing below it counts either.
What one can't take goes to its siblings in proportion to their
weights; only when all of them are full does their parent take less, and then the parent's siblings take more. Each
family is levelled at once: sorted by capacity to weight, the nodes that are full form a beginning of that order, found
by running sums. All amounts are whole numbers, so any engine gets the same ones.

Each leaf puts its documents into an order of its own for every epoch, by a seeded hash. It takes whole epochs while
its budget lasts, and of the next one the beginning that reaches the budget: every document with fewer tokens than
the rest of the budget before it. Documents are dealt to buckets by the first bits of that hash, so only the bucket in
which the cut falls is put in order; a hot leaf has more buckets, not larger ones.

Defined results: null language, source or domain are leaves of their own. A null or blank text has no tokens and is
taken with its leaf's epochs. Rows with one doc_id in a leaf are equal in order and share one fate. An empty table gives
an empty table. Weights that are not given are those under ``None``. Columns named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import OWN, drop_clashing, null_join, table, written

#: Documents of a bucket at most, on average.
BUCKET_ROWS = 4096
HASH_BITS = 60


@dataclass(frozen=True)
class Mix:
    """Whole-number weights of each level (None: any other name), the budget as a share of all tokens in thousandths,
    the passes that a leaf allows, and the seed of the orders."""

    domains: dict = field(default_factory=lambda: {"web": 50, "books": 30, "code": 20, None: 10})
    languages: dict = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10, None: 5})
    sources: dict = field(default_factory=lambda: {None: 1})
    budget: int = 800
    max_epochs: int = 4
    seed: int = 42


def domain_of(source: Column) -> Column:
    """The domain of a source by the remainder of its number: web, books or code; ``other`` for one without a number."""
    number = F.try_to_number(F.regexp_extract(source, r"([0-9]{1,9})$", 1), F.lit("999999999"))
    return F.coalesce(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), (number.cast("int") % 3 + 1)), F.lit("other"))


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict) -> Column:
    out = F.lit(weights.get(None, 0))
    for k, w in weights.items():
        if k is not None:
            out = F.when(name == k, w).otherwise(out)
    return out.cast("decimal(38,0)")


def _place(key: Column, epoch: Column, seed: int) -> Column:
    """A whole number of HASH_BITS bits by which an epoch is ordered."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def levelled(nodes: DataFrame, family: list[str], name: str, given: str, capacity: str, weight: str, out: str) -> DataFrame:
    """``nodes`` with ``out``, their shares of what their family is ``given``: in proportion to weight, none above its
    capacity, and all of it used while any capacity is left (but for what rounding down leaves). Families are small."""
    cap, w = F.col(capacity), F.col(weight)
    ratio = F.when(w > 0, cap.cast("double") / w.cast("double")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*family).orderBy(ratio, name)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*family)
    zero = F.lit(0).cast("decimal(38,0)")
    nodes = nodes.withColumns({f"{OWN}cap": F.coalesce(F.sum(cap).over(before), zero), f"{OWN}w": F.coalesce(F.sum(w).over(before), zero), f"{OWN}all": F.sum(w).over(whole)})
    left, rest = F.col(given) - F.col(f"{OWN}cap"), F.col(f"{OWN}all") - F.col(f"{OWN}w")
    full = (w > 0) & (left * w >= cap * rest)
    nodes = nodes.withColumn(f"{OWN}full", full)
    used = F.sum(F.when(F.col(f"{OWN}full"), cap).otherwise(zero)).over(whole)
    heavy = F.sum(F.when(F.col(f"{OWN}full"), w).otherwise(zero)).over(whole)
    share = F.when(F.col(f"{OWN}full"), cap).when(F.col(f"{OWN}all") > heavy, F.floor((F.col(given) - used) * w / (F.col(f"{OWN}all") - heavy))).otherwise(zero)
    return nodes.withColumn(out, share.cast("decimal(38,0)")).drop(f"{OWN}cap", f"{OWN}w", f"{OWN}all", f"{OWN}full")


LEAF = ["domain", "language", "leaf"]


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (domain, language, leaf, rows, tokens) with ``budget``, whole ``epochs`` and ``rest``."""
    n = lambda c: F.col(c).cast("decimal(38,0)")
    able = F.when(F.col("w") > 0, F.col("capacity")).otherwise(F.lit(0)).cast("decimal(38,0)")
    sums = [F.sum("capacity").cast("decimal(38,0)").alias("capacity"), F.sum("tokens").alias("tokens")]
    leaves = leaves.withColumns({"capacity": n("tokens") * mix.max_epochs, "w": _weight(F.col("leaf"), mix.sources)}).withColumn("capacity", able)
    langs = leaves.groupBy("domain", "language").agg(*sums).withColumn("w", _weight(F.col("language"), mix.languages)).withColumn("capacity", able)
    tops = langs.groupBy("domain").agg(*sums).withColumn("w", _weight(F.col("domain"), mix.domains)).withColumn("capacity", able).withColumn("top", F.lit(0))
    tops = tops.withColumn("given", F.floor(F.sum(n("tokens")).over(Window.partitionBy("top")) * mix.budget / 1000).cast("decimal(38,0)"))
    tops = levelled(tops, ["top"], "domain", "given", "capacity", "w", "given_domain").select("domain", "given_domain")
    langs = null_join(langs, tops, ["domain"])
    langs = levelled(langs, ["domain"], "language", "given_domain", "capacity", "w", "given_language").select("domain", "language", "given_language")
    rows = null_join(leaves, langs, ["domain", "language"])
    rows = levelled(rows, ["domain", "language"], "leaf", "given_language", "capacity", "w", "budget")
    tokens = F.greatest(F.col("tokens"), F.lit(1))
    rows = rows.withColumn("budget", F.col("budget").cast("long")).withColumn("epochs", F.expr("int(budget div greatest(tokens, 1))"))
    return rows.withColumn("rest", F.col("budget") - F.col("epochs") * tokens).select(*LEAF, "rows", "tokens", "budget", "epochs", "rest")


def mix(docs: DataFrame, how: Mix | None = None, key: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source", domain: Column | None = None) -> DataFrame:
    """``docs``, each row once for each epoch that takes it, with ``domain``, ``tokens`` and ``epoch`` (from 0).

    Texts are read three times and never shuffled unless the table of leaves is too large to send along; the counts that
    the cuts need are taken from a narrow table of keys and token counts."""
    how = how or Mix()
    docs = drop_clashing(docs, [c for c in ("domain", "tokens", "epoch") if c not in (key, text, language, source)])
    lang_of, leaf_of, place = f"{OWN}language", f"{OWN}leaf", f"{OWN}place"
    docs = docs.withColumns({"domain": domain_of(F.col(source)) if domain is None else domain, "tokens": tokens_of(F.col(text)), lang_of: F.col(language), leaf_of: F.col(source)})
    slim = docs.select(F.col(key).alias("key"), "domain", F.col(lang_of).alias("language"), F.col(leaf_of).alias("leaf"), "tokens")
    slim = written(slim, "mix-documents")
    leaves = slim.groupBy(*LEAF).agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens"))
    plan = written(budgets(leaves, how), "mix-leaves")

    # the bucket in which each leaf's cut falls, then the place of the cut
    bits = F.least(F.lit(24), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("rows"), F.lit(1)) / BUCKET_ROWS)))).cast("int")
    cut = plan.where("rest > 0").withColumn("bits", bits).select(*LEAF, "epochs", "rest", "bits")
    part = null_join(slim, cut, LEAF)
    part = part.withColumn("place", _place(F.col("key"), F.col("epochs"), how.seed))
    part = part.withColumn("bucket", F.call_function("shiftright", F.col("place"), F.lit(HASH_BITS) - F.col("bits")))
    sums = part.groupBy(*LEAF, "bucket").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = written(sums.where("before < rest AND before + held >= rest").select(*LEAF, "bucket", "before"), "mix-cuts")
    inside = null_join(part, edge, [*LEAF, "bucket"])
    inside = inside.groupBy(*LEAF, "place").agg(F.sum("tokens").alias("tokens"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    over = Window.partitionBy(*LEAF).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.coalesce(F.sum("tokens").over(over), F.lit(0)) + F.col("before")).where("start < rest")
    last = inside.groupBy(*LEAF).agg(F.max("place").alias("last"))
    plan = null_join(plan, last, LEAF, "left").select(*LEAF, "epochs", F.coalesce("last", F.lit(-1).cast("long")).alias("last"))
    plan = written(plan, "mix-plan")

    names = docs.drop(lang_of, leaf_of).columns
    taken = docs.join(plan.withColumnsRenamed({x: f"{OWN}p_{x}" for x in [*LEAF, "epochs", "last"]}), [F.col(a).eqNullSafe(F.col(f"{OWN}p_{b}")) for a, b in zip(["domain", lang_of, leaf_of], LEAF, strict=True)])
    more = (_place(F.col(key), F.col(f"{OWN}p_epochs"), how.seed) <= F.col(f"{OWN}p_last")).cast("int")
    times = taken.withColumn(place, F.col(f"{OWN}p_epochs") + more).where(F.col(place) > 0)
    return times.select(*names, F.explode(F.sequence(F.lit(0), F.col(place) - 1)).alias("epoch"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def oracle_sql(how: Mix | None = None) -> str:
    how = how or Mix()
    quoted = lambda k: "'" + k.replace("'", "''") + "'"
    case = lambda column, weights: f"(CASE {' '.join(f'WHEN {column} = {quoted(k)} THEN {w}' for k, w in weights.items() if k is not None) or 'WHEN false THEN 0'} ELSE {weights.get(None, 0)} END)::HUGEINT"
    place = lambda epoch: f"('0x' || substr(md5('{how.seed}:' || {epoch} || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT"

    def level(source: str, family: str, name: str, given: str, out: str) -> str:
        over = f"PARTITION BY {family} ORDER BY CASE WHEN w > 0 THEN capacity::DOUBLE / w::DOUBLE ELSE 'infinity'::DOUBLE END, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        return f"""(SELECT *, CASE WHEN is_full THEN capacity WHEN w_all > heavy THEN (({given} - used) * w) // (w_all - heavy) ELSE 0 END AS {out} FROM (
          SELECT *, coalesce(sum(CASE WHEN is_full THEN capacity END) OVER (PARTITION BY {family}), 0)::HUGEINT AS used, coalesce(sum(CASE WHEN is_full THEN w END) OVER (PARTITION BY {family}), 0)::HUGEINT AS heavy FROM (
            SELECT *, w > 0 AND ({given} - cap_before) * w >= capacity * (w_all - w_before) AS is_full FROM (
              SELECT *, coalesce(sum(capacity) OVER ({over}), 0)::HUGEINT AS cap_before, coalesce(sum(w) OVER ({over}), 0)::HUGEINT AS w_before, (sum(w) OVER (PARTITION BY {family}))::HUGEINT AS w_all FROM ({source})))))"""

    able = lambda rows, w: f"SELECT * REPLACE (CASE WHEN w > 0 THEN capacity ELSE 0 END AS capacity) FROM (SELECT *, {w} AS w FROM ({rows}))"
    sums = lambda keys, rows: f"SELECT {keys}, sum(capacity)::HUGEINT AS capacity, sum(tokens)::HUGEINT AS tokens FROM {rows} GROUP BY ALL"
    tops = f"SELECT *, 0 AS top, (sum(tokens) OVER () * {how.budget}) // 1000 AS given FROM ({able(sums('domain', 'families'), case('domain', how.domains))})"
    langs = "SELECT l.*, given_domain FROM families l JOIN tops t ON l.domain IS NOT DISTINCT FROM t.domain"
    rows = "SELECT f.*, given_language FROM leaves f JOIN langs l ON f.domain IS NOT DISTINCT FROM l.domain AND f.language IS NOT DISTINCT FROM l.language"
    return f"""
WITH docs AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS tokens,
    coalesce(['web', 'books', 'code'][try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 3 + 1], 'other') AS domain
  FROM documents
), leaves AS (
  {able(f"SELECT domain, lang AS language, source AS leaf, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * {how.max_epochs} AS capacity FROM docs GROUP BY ALL", case("leaf", how.sources))}
), families AS (
  {able(sums("domain, language", "leaves"), case("language", how.languages))}
), tops AS (SELECT domain, given_domain FROM {level(tops, 'top', 'domain', 'given', 'given_domain')}),
langs AS (SELECT domain, language, given_language FROM {level(langs, 'domain', 'language', 'given_domain', 'given_language')}),
plan AS (SELECT domain, language, leaf, (budget // greatest(tokens, 1))::BIGINT AS epochs, (budget - (budget // greatest(tokens, 1)) * greatest(tokens, 1))::BIGINT AS rest FROM {level(rows, 'domain, language', 'leaf', 'given_language', 'budget')}),
placed AS (
  SELECT d.*, epochs, rest, {place('epochs')} AS place FROM docs d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.language AND d.source IS NOT DISTINCT FROM p.leaf
), taken AS (
  SELECT *, epochs + CASE WHEN coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) < rest THEN 1 ELSE 0 END AS times FROM placed
)
SELECT doc_id, domain, lang, source, tokens, unnest(range(times))::INT AS epoch FROM taken WHERE times > 0
"""
