"""Mixing of sources to target weights, by hierarchical budgeting. DataFrame operations only.

The tree is domain, language, source. A node's budget is divided among its children by their weights, and no
child gets more than its capacity: the tokens below it, ``max_epochs`` times. What a child cannot take goes
to its siblings first; only what a whole subtree cannot take is, one level up, left to that subtree's own
siblings. At each level the share has a closed form, a running sum over the siblings in order of capacity
for each unit of weight, so nothing iterates.

A leaf repeats its documents in whole epochs and takes, of one more epoch, the prefix of tokens that its
budget still pays for, in an order seeded by (seed, epoch, doc_id). The prefix is found in two steps: tokens
are summed for bins of the order's key, then only the bin in which the prefix ends is sorted, so that a
source that holds a third of all rows is one sort of its 4096th part. The outcome is one cut-off a leaf;
documents are compared with it where they are read and are not shuffled.

Tokens are estimated as a quarter of the bytes, rounded up; a null text has none. Null languages and sources
are leaves named "(none)". Documents with equal keys at the end of a prefix are taken together or not at all.
Rows that repeat are rows like others, and tie with each other. Very long texts count with all their tokens, which a prefix
takes whole or not at all. An empty table gives an empty result. Columns of the input other than doc_id, text, lang, source
are kept by ``mix`` as they are, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.llm.common import materialise, quoted, table

LEVELS = ("_domain", "_lang", "_source")
DOMAIN_NAMES = ("web", "news", "books", "forums")
DOMAIN_WEIGHTS = {"web": 4, "news": 2, "books": 1, "forums": 1}
LANG_WEIGHTS = {"en": 4, "de": 1, "fr": 1, "es": 1}
#: The share of the corpus that is asked for, in hundredths.
TARGET_PERCENT = 80
MAX_EPOCHS = 2
SEED = 17
BIN_DIGITS = 3
#: Leaf tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000


def domain_of(source: Column) -> Column:
    """Which domain a source belongs to: by its number; "other" where it has none."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    named = F.element_at(F.array(*map(F.lit, DOMAIN_NAMES)), (number.cast("int") % len(DOMAIN_NAMES)) + 1)
    return F.when(number != "", named).otherwise("other")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, w in weights.items():
        out = F.when(name == key, F.lit(w)).otherwise(out)
    return out.cast("long")


def with_leaf(documents: DataFrame) -> DataFrame:
    return documents.withColumns({
        "_domain": F.coalesce(domain_of(F.col("source")), F.lit("other")),
        "_lang": F.coalesce("lang", F.lit("(none)")),
        "_source": F.coalesce("source", F.lit("(none)")),
        "_tokens": F.coalesce(F.ceil(F.octet_length("text") / 4), F.lit(0)).cast("long"),
    })


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def capped_shares(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Adds ``got``: of the parent's ``budget`` by ``weight``, ``capacity`` at most, the rest to siblings."""
    family = Window.partitionBy(*parents, "budget")
    in_order = family.orderBy(F.col("capacity") / F.col("weight"), *[c for c in LEVELS if c in nodes.columns])
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(earlier), F.lit(0))) / (F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    nodes = nodes.withColumn("level", level)
    full = F.col("capacity") / F.col("weight") <= F.col("level")
    nodes = nodes.withColumns({"full": full, "water": F.max(F.when(~full, F.col("level"))).over(family)})
    return nodes.withColumn("got", F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.greatest(F.col("water"), F.lit(0.0)) * F.col("weight"))).cast("long")).drop("level", "full", "water")


def leaf_budgets(leaves: DataFrame, domain_weights: dict[str, int], lang_weights: dict[str, int], target_percent: int, max_epochs: int) -> DataFrame:
    """``leaves(_domain, _lang, _source, total)`` with budget, epochs and the rest that a further epoch's prefix holds."""
    weights = {"_domain": weight_of(F.col("_domain"), domain_weights), "_lang": weight_of(F.col("_lang"), lang_weights), "_source": F.lit(1).cast("long")}
    upper = leaves.agg((F.floor(F.sum("total") * target_percent / 100)).cast("long").alias("budget"))
    parents: list[str] = []
    for name in LEVELS:
        nodes = leaves.groupBy(*parents, name).agg(F.sum(F.col("total") * max_epochs).alias("capacity")).withColumn("weight", weights[name])
        nodes = nodes.join(upper, parents) if parents else nodes.crossJoin(F.broadcast(upper))  # one row
        parents.append(name)
        upper = capped_shares(nodes, parents[:-1]).select(*parents, F.col("got").alias("budget"))
    epochs = F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total"))).otherwise(0).cast("long")
    return leaves.join(upper, list(LEVELS)).withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("total"))


def small(df: DataFrame) -> DataFrame:
    """``df`` (already written) to be broadcast if it is found to be small, or else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mixture(documents: DataFrame, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS, target_percent: int = TARGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row for each leaf: budget, epochs, and the (key, doc_id) at which its last epoch's prefix ends."""
    narrow = materialise(with_leaf(documents).select("doc_id", *LEVELS, "_tokens"), "mix-rows")
    totals = narrow.groupBy(*LEVELS).agg(F.sum("_tokens").alias("total"))
    leaves = materialise(leaf_budgets(totals, domain_weights, lang_weights, target_percent, max_epochs), "mix-leaves")
    keyed = narrow.join(small(leaves), list(LEVELS)).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id"))).withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    bins = keyed.groupBy(*LEVELS, "bin", "rest").agg(F.sum("_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bin"))
    bins = bins.withColumn("upto", upto)
    ends = bins.groupBy(*LEVELS).agg(
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("before"),
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("bin"))).alias("end_bin"),
    )
    ends = materialise(ends, "mix-ends")
    last = keyed.join(small(ends), list(LEVELS)).where(F.col("bin") == F.col("end_bin"))
    run = F.sum("_tokens").over(Window.partitionBy(*LEVELS).orderBy("key", F.coalesce("doc_id", F.lit(-1))))
    taken = last.withColumn("run", F.col("before") + run).where(F.col("run") <= F.col("rest"))
    cut = taken.groupBy(*LEVELS).agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-1)).alias("id"))).alias("cut"))
    # Without an end bin the whole epoch is taken ("g" sorts after all digits); without a row taken in it, only what lies before it.
    return leaves.join(ends, list(LEVELS)).join(cut, list(LEVELS), "left").select(
        *LEVELS, "total", "budget", "epochs",
        F.coalesce("cut.key", "end_bin", F.lit("g")).alias("cut_key"),
        F.coalesce("cut.id", F.lit(-2)).alias("cut_id"),
    )


def counted(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """What ``with_leaf`` gives, with the leaf's columns and ``_copies``, how often the mixture holds each row."""
    key, doc_id = order_key(seed, F.col("epochs"), F.col("doc_id")), F.coalesce("doc_id", F.lit(-1))
    within = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (doc_id <= F.col("cut_id")))
    return rows.join(small(leaves), list(LEVELS)).withColumn("_copies", F.col("epochs") + within.cast("long"))


def mix(documents: DataFrame, seed: int = SEED, **budget) -> DataFrame:
    """The mixture itself: the rows of ``documents``, each as often as its leaf's budget takes it."""
    leaves = materialise(mixture(documents, seed=seed, **budget), "mixture")
    whole = with_leaf(documents.select(F.struct(*quoted(documents.columns)).alias("_whole"), "doc_id", "text", "lang", "source"))
    taken = counted(whole.select("_whole", "doc_id", *LEVELS), leaves, seed).where("_copies > 0")
    return taken.select("_whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_whole.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    leaves = materialise(mixture(documents), "mixture")
    return counted(with_leaf(documents), leaves, SEED).select(
        "doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"),
        F.col("_tokens").alias("tokens"), F.col("budget").alias("leaf_budget"), F.col("_copies").alias("copies"),
    )


def _sql_level(name: str, nodes: str, parents: list[str]) -> str:
    cols, fam = ", ".join(parents), ", ".join([*parents[:-1], "budget"])
    return f"""
{name}_lv AS (SELECT *, (budget - COALESCE(SUM(capacity) OVER o, 0)) / CAST(SUM(weight) OVER f - COALESCE(SUM(weight) OVER o, 0) AS DOUBLE) AS level
  FROM ({nodes}) WINDOW f AS (PARTITION BY {fam}), o AS (PARTITION BY {fam} ORDER BY capacity / CAST(weight AS DOUBLE), {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT {cols}, CASE WHEN capacity / CAST(weight AS DOUBLE) <= level THEN capacity ELSE CAST(FLOOR(GREATEST(MAX(CASE WHEN NOT capacity / CAST(weight AS DOUBLE) <= level THEN level END) OVER (PARTITION BY {fam}), 0) * weight) AS BIGINT) END AS budget FROM {name}_lv)"""


def _cases(column: str, weights: dict[str, int]) -> str:
    return f"CAST(CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END AS BIGINT)"


_names = "[" + ", ".join(f"'{x}'" for x in DOMAIN_NAMES) + "]"
OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, COALESCE(CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN {_names}[CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % {len(DOMAIN_NAMES)} + 1] ELSE 'other' END, 'other') AS domain,
    COALESCE(lang, '(none)') AS lang, COALESCE(source, '(none)') AS source, CAST(COALESCE(CEIL(strlen(text) / 4.0), 0) AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(SUM(tokens) AS BIGINT) AS total FROM d GROUP BY ALL),
{_sql_level("l1", f"SELECT domain, CAST(SUM(total) * {MAX_EPOCHS} AS BIGINT) AS capacity, {_cases('domain', DOMAIN_WEIGHTS)} AS weight, (SELECT CAST(FLOOR(SUM(total) * {TARGET_PERCENT} / 100.0) AS BIGINT) FROM leaves) AS budget FROM leaves GROUP BY domain", ["domain"]).lstrip()},
{_sql_level("l2", f"SELECT domain, lang, CAST(SUM(total) * {MAX_EPOCHS} AS BIGINT) AS capacity, {_cases('lang', LANG_WEIGHTS)} AS weight, any_value(l1.budget) AS budget FROM leaves JOIN l1 USING (domain) GROUP BY domain, lang", ["domain", "lang"]).lstrip()},
{_sql_level("l3", f"SELECT domain, lang, source, CAST(SUM(total) * {MAX_EPOCHS} AS BIGINT) AS capacity, CAST(1 AS BIGINT) AS weight, any_value(l2.budget) AS budget FROM leaves JOIN l2 USING (domain, lang) GROUP BY domain, lang, source", ["domain", "lang", "source"]).lstrip()},
e AS (SELECT domain, lang, source, total, budget, CASE WHEN total > 0 THEN CAST(FLOOR(budget / CAST(total AS DOUBLE)) AS BIGINT) ELSE 0 END AS epochs FROM leaves JOIN l3 USING (domain, lang, source)),
r AS (SELECT d.*, budget, epochs, budget - epochs * total AS rest, SUM(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{SEED}', CAST(epochs AS VARCHAR), CAST(doc_id AS VARCHAR))), doc_id) AS run FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, budget AS leaf_budget, epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END AS copies FROM r
"""
