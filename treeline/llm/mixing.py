"""Mixing sources to target weights (operator 4), with DataFrame functions only.

The budget of tokens flows down a tree domain - language - source. At each node it is shared among the
children by weight, but no child gets more than its subtree holds (tokens times ``max_epochs``); what a
child can't take goes to its siblings, and only what all siblings together can't take shows at their
parent, whose own siblings take it, since a parent's share is bounded by the capacity of its subtree.
A leaf then repeats its documents for whole epochs and takes a token-prefix of the next one, in an order
seeded by the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import table, written

WORD = "[^\\x20\\x09-\\x0D]+"
LEVELS = ("domain", "lang", "source")
SEED, SHARE, MAX_EPOCHS, BUCKET_DIGITS = "17", (1, 2), 4, 3
BROADCAST_LEAVES = 20_000

#: Weights by level and name; a name that isn't listed has weight 1.
WEIGHTS = {
    "domain": {"forum": 1, "news": 2, "reference": 3, "web": 4},
    "lang": {"en": 4, "de": 2},
    "source": {"src0": 2},
}


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    found = F.lit(1)
    for name, w in sorted(weights.get(level, {}).items()):
        found = F.when(F.col(level) == name, F.lit(w)).otherwise(found)
    return found.cast("long")


def filled(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (parent columns, name, cap, weight, budget of the parent) with each one's ``given``.

    Children in order of cap / weight are full as long as the rest of the budget would give them their
    cap; the others share what is left by weight, whole tokens, the odd ones to the first in order.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("budget") - F.col("cap_before")
    ranked = (
        children.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_rest", F.sum("weight").over(rest))
        .withColumn("full", left * F.col("weight") >= F.col("cap") * F.col("weight_rest"))
    )
    whole = Window.partitionBy(*parent)
    open_only = lambda c: F.when(~F.col("full"), c)
    ranked = (
        ranked.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("open_weight", F.sum(open_only(F.col("weight"))).over(whole))
        .withColumn("share", open_only(F.expr("(left * weight) div open_weight")))
        .withColumn("odd", F.col("left") - F.sum("share").over(whole))
        .withColumn("place", F.sum(F.when(F.col("full"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") + (F.col("place") <= F.col("odd")).cast("long"))
    return ranked.withColumn("given", given)


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """domain, lang, source, tokens, quota of each leaf of ``leaves`` (domain, lang, source, tokens)."""
    capped = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = capped.agg(F.sum("cap").alias("all_cap"), F.expr(f"(sum(tokens) * {share[0]}) div {share[1]}").alias("wanted")).select(F.least("all_cap", "wanted").alias("given"))
    above, keys = total, []
    for level in LEVELS:
        children = capped.groupBy(*keys, level).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(level, weights))
        budget = above.select(*keys, F.col("given").alias("budget"))
        children = children.join(budget, keys) if keys else children.crossJoin(F.broadcast(budget))  # one row
        above = filled(children, keys or [F.lit(0)], level)
        keys = [*keys, level]
    return leaves.join(above.select(*keys, F.col("given").alias("quota")), list(LEVELS))


def mixed(documents: DataFrame, domain: Column, weights: dict[str, dict[str, int]] | None = None, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epochs of each document that the mix takes.

    ``share``: the budget as a fraction (numerator, denominator) of all tokens; ``epochs`` is how often
    the document is taken. Tokens are words between ASCII white space. Null domain, lang and source are
    "" and make leaves of their own; null texts and texts without words have no tokens and are taken where
    a prefix of at least one token reaches them. A leaf without tokens gives nothing. Equal order keys (same doc_id) are taken
    in order of tokens; repeated rows count each. Only doc_id, text, lang and source (and what ``domain``
    reads) are used. An empty table gives an empty result. Weights are positive integers, and the
    tokens times the sum of a level's weights must stay below 2**63.
    """
    weights = WEIGHTS if weights is None else weights
    known = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), known(domain).alias("domain"), known(F.col("lang")).alias("lang"), known(F.col("source")).alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("tokens"))
    docs, _ = written(docs, "mix-sizes")
    keys = list(LEVELS)
    leaves = docs.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    planned = budgets(leaves, weights, share, max_epochs).select(*keys, F.expr("quota div tokens").alias("whole"), F.expr("quota % tokens").alias("rest"))
    planned, _ = written(planned, "mix-plan")
    side = F.broadcast(planned) if planned.count() <= BROADCAST_LEAVES else planned
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    ordered = docs.join(side, keys).withColumn("h", h).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    along = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = ordered.groupBy(*keys, "bucket").agg(F.sum("tokens").alias("in_bucket")).withColumn("until", F.sum("in_bucket").over(along)).select(*keys, "bucket", "until", (F.col("until") - F.col("in_bucket")).alias("since"))
    placed = ordered.join(buckets, [*keys, "bucket"])
    within = Window.partitionBy(*keys, "bucket").orderBy("h", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    border = (F.col("rest") > 0) & (F.col("since") <= F.col("rest")) & (F.col("rest") < F.col("until"))
    sure = placed.filter(~border).withColumn("more", F.when((F.col("until") <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0))
    cut = placed.filter(border).withColumn("more", F.when(F.col("since") + F.sum("tokens").over(within) <= F.col("rest"), 1).otherwise(0))
    taken = sure.unionByName(cut).withColumn("epochs", F.col("whole") + F.col("more")).filter("epochs > 0")
    return taken.select("doc_id", *keys, "tokens", "epochs")


def stand_in_domain() -> Column:
    """The tables have no domain column; sources are dealt to four domains by their name's md5."""
    digit = F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 1)
    return F.when(digit < "4", "forum").when(digit < "8", "news").when(digit < "c", "reference").otherwise("web")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), stand_in_domain())


def _level_sql(level: str, keys: list[str], above: str) -> str:
    cases = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in sorted(WEIGHTS[level].items()))
    by = ", ".join(keys) or "1"
    join = f"JOIN {above} a USING ({', '.join(keys)})" if keys else f"CROSS JOIN {above} a"
    cols = ", ".join([*keys, level])
    return f"""
{level}_c AS (SELECT {cols}, sum(tokens * {MAX_EPOCHS})::HUGEINT AS cap, CASE {cases} ELSE 1 END AS weight FROM leaves GROUP BY {cols}),
{level}_r AS (SELECT c.*, a.given AS budget, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_rest FROM {level}_c c {join}
  WINDOW o AS (PARTITION BY {by} ORDER BY cap::DOUBLE / weight, {level})),
{level}_f AS (SELECT *, (budget - cap_before) * weight >= cap * weight_rest AS full_, budget FROM {level}_r),
{level}_s AS (SELECT *, budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {by}) AS left_, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY {by}) AS open_weight FROM {level}_f),
{level}_o AS (SELECT *, CASE WHEN full_ THEN 0 ELSE left_ * weight // open_weight END AS share,
  sum(CASE WHEN full_ THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / weight, {level} ROWS UNBOUNDED PRECEDING) AS place FROM {level}_s),
{level}_g AS (SELECT {cols}, CASE WHEN full_ THEN cap ELSE share + (place <= left_ - sum(share) OVER (PARTITION BY {by}))::INTEGER END AS given FROM {level}_o)"""


OP4_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
    CASE WHEN left(md5(coalesce(source, '')), 1) < '4' THEN 'forum' WHEN left(md5(coalesce(source, '')), 1) < '8' THEN 'news' WHEN left(md5(coalesce(source, '')), 1) < 'c' THEN 'reference' ELSE 'web' END AS domain
  FROM documents
), leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0),
root AS (SELECT least(sum(tokens * {MAX_EPOCHS}), sum(tokens) * {SHARE[0]} // {SHARE[1]}) AS given FROM leaves),
{_level_sql("domain", [], "root")},
{_level_sql("lang", ["domain"], "domain_g")},
{_level_sql("source", ["domain", "lang"], "lang_g")},
plan AS (SELECT domain, lang, source, given // tokens AS whole, given % tokens AS rest FROM leaves JOIN source_g USING (domain, lang, source)),
o AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')), tokens ROWS UNBOUNDED PRECEDING) AS until FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, (whole + (rest > 0 AND until <= rest)::INTEGER)::BIGINT AS epochs FROM o WHERE whole + (rest > 0 AND until <= rest)::INTEGER > 0
"""
