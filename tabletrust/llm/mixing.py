"""Mixing sources to target weights: budgets flow down a tree of domain, language and source, with DataFrame functions only.

Every node has a whole-number weight among its siblings and a capacity: the tokens below it times the largest number of
epochs. A node's budget is dealt to its children by weight; a child that can't use its share keeps what it can, and the
shortage goes to its siblings by weight. Because capacities are those of whole subtrees, a shortage leaves a node for
its ancestors only when nothing below that node can take it. A leaf's budget buys whole epochs, then the longest prefix
of the next epoch whose tokens fit; an epoch's order is that of md5(seed, epoch, doc_id).

Prefixes are cut without sorting a leaf: token sums per leaf and 4096 ranges of the order find the one range that holds
the cut, and only that range's rows are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.llm.common import SPACE, bounded, saved, unused

LEVELS = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Mix:
    """Weights by name at each level (whole numbers; other names weigh default_weight) and the total budget.

    budget_permille: tokens to take, in thousandths of the corpus's tokens.
    """

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    default_weight: int = 1
    budget_permille: int = 500
    max_epochs: int = 2
    seed: int = 7

    def weight(self, level: str) -> Column:
        """A column of the level's weights."""
        names = getattr(self, level)
        if not names:
            return F.lit(self.default_weight).cast("long")
        chosen = F.lit(self.default_weight)
        for name, w in names.items():
            chosen = F.when(F.col(level) == name, w).otherwise(chosen)
        return chosen.cast("long")


def domain_of_source(source: Column) -> Column:
    """The domain of a source name, by the number it ends with: 0 is the web, even ones are books, odd ones forums."""
    n = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint")
    return F.when(n.isNull(), "other").when(n == 0, "web").when(n % 2 == 0, "books").otherwise("forums")


def tokens(text: Column) -> Column:
    """Number of words of a text."""
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", ""), SPACE)
    return F.when(F.element_at(words, 1) == "", 0).otherwise(F.size(words)).cast("long")


def shares(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Deals each parent's budget to its children. nodes: parent, level, weight, cap, budget (of the parent).

    Children of weight 0 get nothing. What whole numbers leave undealt goes, one token each, to the first open children by
    name, so a parent's whole budget is dealt unless its children can't take it.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = w.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.nullif("weight", F.lit(0))).otherwise(float("inf")), level).rowsBetween(Window.unboundedPreceding, -1)
    ahead = nodes.withColumns({"_c": F.coalesce(F.sum("cap").over(by), F.lit(0)), "_w": F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(by), F.lit(0))})
    # The children that fill up come first in this order.
    full = ahead.withColumn("_full", (F.col("weight") > 0) & (F.col("cap") * F.col("_w") <= F.col("weight") * (F.col("budget") - F.col("_c"))))
    left = full.withColumns({"_kept": F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(w), F.lit(0)), "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(w)})
    part = left.withColumn("_part", F.when(F.col("_full") | (F.col("weight") == 0), F.lit(0)).otherwise(F.expr("(weight * (budget - _kept)) div nullif(_open, 0)")))
    takes = ~F.col("_full") & (F.col("weight") > 0)
    rest = part.withColumns({"_rest": F.col("budget") - F.col("_kept") - F.sum("_part").over(w), "_at": F.sum(F.when(takes, 1).otherwise(0)).over(w.orderBy(level).rowsBetween(Window.unboundedPreceding, 0))})
    share = F.when(F.col("_full"), F.col("cap")).when(takes & (F.col("_at") <= F.col("_rest")), F.col("_part") + 1).otherwise(F.col("_part"))
    return rest.select(*parent, level, "cap", share.cast("long").alias("share"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """The budget of every leaf. leaves: domain, lang, source, supply (its tokens)."""
    capped = leaves.withColumn("cap", F.col("supply") * mix.max_epochs)
    top = capped.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", mix.weight("domain"))
    total = leaves.agg(F.expr(f"(sum(supply) * {mix.budget_permille}) div 1000").alias("budget"))
    dealt = shares(top.crossJoin(F.broadcast(total)), [], "domain")  # one row holds the total
    for depth in (2, 3):
        keys = LEVELS[:depth]
        children = capped.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", mix.weight(keys[-1]))
        dealt = shares(children.join(dealt.select(*keys[:-1], F.col("share").alias("budget")), keys[:-1]), keys[:-1], keys[-1])
    return dealt.select(*LEVELS, "share")


def order_key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{mix.seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def chosen(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies (1 or more) of every row that the mix takes.

    A null language or source is the empty name; null, empty and blank texts have no tokens, texts of any length count
    whole. Rows of one leaf with equal or null ids are taken or left together, and count together for the budget. An empty
    table gives no rows. Other columns of docs aren't read, whatever they are called.
    """
    named = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), tokens(F.col("text")).alias("n_tokens"))
    counted = saved(named.withColumn("domain", domain_of_source(F.col("source"))), "tokens")
    leaves = saved(counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), "leaves")
    plan = budgets(leaves, mix).join(leaves, LEVELS).where("supply > 0").withColumn("epochs", F.expr("share div supply"))
    plan = saved(plan.withColumn("rest", F.col("share") - F.col("epochs") * F.col("supply")).select(*LEVELS, "epochs", "rest"), "plan")
    keyed = counted.join(bounded(plan), LEVELS).withColumn("_key", order_key(mix, F.col("epochs"), F.col("doc_id"))).withColumn("_bin", F.substring("_key", 1, 3))
    bins = keyed.groupBy(*LEVELS, "_bin").agg(F.sum("n_tokens").alias("_n"), F.first("rest").alias("rest"))
    upto = F.sum("_n").over(Window.partitionBy(*LEVELS).orderBy("_bin"))  # over at most 4096 rows a leaf
    cut = bins.withColumn("_upto", upto).where("_upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_n")).alias("before"))).alias("_cut"))
    cut = saved(cut.select(*LEVELS, F.col("_cut._bin").alias("_at"), F.col("_cut.before").alias("_before")), "cuts")
    marked = keyed.join(bounded(cut), LEVELS, "left")
    out = ["doc_id", *LEVELS, "n_tokens", "copies"]
    whole = marked.where("_at is null or _bin <> _at").withColumn("copies", F.col("epochs") + F.when(F.col("_at").isNull() | (F.col("_bin") < F.col("_at")), 1).otherwise(0))
    edge = marked.where("_bin = _at")
    # One row a key is ranked: a key may have any number of rows.
    keys = edge.groupBy(*LEVELS, "_key").agg(F.sum("n_tokens").alias("_n"), F.first("_before").alias("_before"), F.first("rest").alias("rest"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*LEVELS).orderBy("_key"))
    fits = saved(keys.withColumn("_sum", upto).where("_sum <= rest").select(*LEVELS, "_key", F.lit(1).alias("_fits")), "edge")
    edge = edge.join(bounded(fits), [*LEVELS, "_key"], "left").withColumn("copies", F.col("epochs") + F.coalesce("_fits", F.lit(0)))
    return whole.select(*out).unionByName(edge.select(*out)).where("copies > 0").withColumn("copies", F.col("copies").cast("long"))


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it has copies; all columns of docs, whatever they are called.

    Nulls, equal ids, repeated rows and empty tables are as in `chosen`.
    """
    d, lang, source, copies = (unused(docs, c) for c in ("_d", "_l", "_s", "_copies"))
    keys = chosen(docs, mix).groupBy(F.col("doc_id").alias(d), F.col("lang").alias(lang), F.col("source").alias(source)).agg(F.max("copies").alias(copies))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.coalesce("lang", F.lit("")) == F.col(lang)) & (F.coalesce("source", F.lit("")) == F.col(source))
    return docs.join(bounded(saved(keys, "chosen")), same).withColumn(unused(docs, "_copy"), F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)


def oracle(mix: Mix) -> str:
    """The same in DuckDB."""
    case = lambda level: "CAST(CASE " + " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in getattr(mix, level).items()) + f" ELSE {mix.default_weight} END AS BIGINT)" if getattr(mix, level) else f"CAST({mix.default_weight} AS BIGINT)"

    def level(name: str, source: str, parent: str, key: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        keys = f"{parent}, {key}" if parent else key
        order = f"ORDER BY CASE WHEN weight > 0 THEN cap / nullif(weight, 0) ELSE 'inf'::DOUBLE END, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        return f"""
{name}_a AS (SELECT {keys}, cap, weight, budget, COALESCE(SUM(cap) OVER ({part} {order}), 0) AS c0, SUM(weight) OVER ({part}) - COALESCE(SUM(weight) OVER ({part} {order}), 0) AS w0 FROM ({source})),
{name}_b AS (SELECT *, weight > 0 AND cap * w0 <= weight * (budget - c0) AS full_up FROM {name}_a),
{name}_c AS (SELECT *, COALESCE(SUM(CASE WHEN full_up THEN cap END) OVER ({part}), 0) AS kept, SUM(CASE WHEN NOT full_up THEN weight END) OVER ({part}) AS open_w FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN full_up OR weight = 0 THEN 0 ELSE (weight * (budget - kept)) // nullif(open_w, 0) END AS dealt FROM {name}_c),
{name}_e AS (SELECT *, budget - kept - SUM(dealt) OVER ({part}) AS rest, SUM(CASE WHEN NOT full_up AND weight > 0 THEN 1 ELSE 0 END) OVER ({part} ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM {name}_d),
{name} AS (SELECT {keys}, CAST(CASE WHEN full_up THEN cap WHEN weight > 0 AND place <= rest THEN dealt + 1 ELSE dealt END AS BIGINT) AS share FROM {name}_e)"""

    return f"""
WITH named AS (SELECT doc_id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
    CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
    COALESCE(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), -1) AS num FROM documents),
counted AS (SELECT *, CASE WHEN num = 0 THEN 'web' WHEN num < 0 THEN 'other' WHEN num % 2 = 0 THEN 'books' ELSE 'forums' END AS domain FROM named),
leaves AS (SELECT domain, lang, source, SUM(n_tokens)::BIGINT AS supply, SUM(n_tokens)::BIGINT * {mix.max_epochs} AS cap FROM counted GROUP BY ALL),
total AS (SELECT (SUM(supply) * {mix.budget_permille}) // 1000 AS budget FROM leaves),{level("d1", f"SELECT domain, SUM(cap) AS cap, {case('domain')} AS weight, ANY_VALUE(budget) AS budget FROM leaves, total GROUP BY domain", "", "domain")},{level("d2", f"SELECT l.domain, l.lang, SUM(cap) AS cap, {case('lang')} AS weight, ANY_VALUE(d1.share) AS budget FROM leaves l JOIN d1 USING (domain) GROUP BY ALL", "domain", "lang")},{level("d3", f"SELECT l.domain, l.lang, l.source, SUM(cap) AS cap, {case('source')} AS weight, ANY_VALUE(d2.share) AS budget FROM leaves l JOIN d2 USING (domain, lang) GROUP BY ALL", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, share // supply AS epochs, share - (share // supply) * supply AS rest FROM d3 JOIN leaves USING (domain, lang, source) WHERE supply > 0),
keyed AS (SELECT c.*, epochs, rest, md5('{mix.seed}|' || CAST(epochs AS BIGINT) || '|' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS k FROM counted c JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, SUM(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM summed WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
