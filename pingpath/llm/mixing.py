"""Mixing sources to target weights: hierarchical budgets over domain, language and source.

Leaves are (domain, language, source).  A leaf can supply its tokens ``epochs``
times.  The token budget flows from the root down; every node shares what it got
among its children by weight, a child that cannot use its share is filled, and the
rest of its share goes to its siblings by their weights (water filling).  A node's
capacity is the sum of its children's, so a shortage goes to siblings first and
reaches the ancestors' other children only when all of them are full.  Sharing is
in whole tokens, rounded down.

Each leaf takes a prefix of its epochs: in epoch e its documents come in the order
of md5(seed, e, doc_id), and documents are taken until the next would exceed the
leaf's budget.  Whole epochs need no order.  For the last one, the first hex digits
of the hash cut a leaf into ranges; token sums of the ranges tell where each starts,
and rows are summed one range at a time, so a leaf with a third of all rows is not
one task.

All steps are DataFrame operations.  Texts are read to count words and not shuffled.

Defined cases: null domains, languages and sources are leaves like any other; null
and empty texts have no tokens and are taken where their order comes, but a leaf with
no token at all supplies nothing and is never taken, whatever the budget; rows that
repeat a doc_id are counted and taken each; documents with a null id come first of
their range; a weight that is missing is 1, one of 0 or less gets no share; a budget
over the supply takes every leaf with tokens whole; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingpath.llm.common import staged

LEVELS = ["domain", "lang", "source"]
#: Production weights of domains and languages (fixed values); sources weigh 1.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
           "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
_DIGITS = 3


def domain_of(source: Column) -> Column:
    """Sources are dealt to four domains by hash where a table names none."""
    digit = F.call_function("instr", F.lit("0123456789abcdef"), F.substring(F.md5(source.cast("binary")), 1, 1)) - 1
    return F.concat(F.lit("domain"), (digit % 4).cast("string"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    given = weights.get(level, {})
    c = F.lit(1).cast("long")
    for name, w in given.items():
        c = F.when(F.col(level) == name, F.lit(max(0, int(w))).cast("long")).otherwise(c)
    return c


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Water filling: ``budget`` of each parent over its children (weight, capacity) as ``got``."""
    siblings = Window.partitionBy(*parents)
    # Children fill in the order of capacity over weight; those before are full.
    order = siblings.orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))),
                             F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    n = (nodes.withColumn("_left", F.col("budget") - F.coalesce(F.sum("capacity").over(before), zero))
         .withColumn("_weights", F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), zero))
         .withColumn("_full", (F.col("weight") > 0) & (F.col("capacity") * F.col("_weights") <= F.col("weight") * F.col("_left")))
         .withColumn("_rest", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(zero)).over(siblings))
         .withColumn("_open", F.sum(F.when(F.col("_full"), zero).otherwise(F.col("weight"))).over(siblings)))
    return n.withColumn("got", F.when(F.col("_full"), F.col("capacity"))
                        .otherwise(F.expr("(weight * _rest) div greatest(_open, 1L)"))).drop("_left", "_weights", "_full", "_rest", "_open")


def _same(a: DataFrame, b: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """Join on ``cols`` where null equals null; keeps the columns of ``a`` once."""
    right = b
    for c in cols:
        right = right.withColumnRenamed(c, "_" + c)
    on = [a[c].eqNullSafe(right["_" + c]) for c in cols]
    return a.join(right, on, how).drop(*["_" + c for c in cols])


def leaf_budgets(tokens: DataFrame, budget_share: float, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """domain, lang, source, supply and budget of each leaf, in tokens."""
    supply = staged(tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), "mix-supply")
    parents: list[str] = []
    above = (supply.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("all"))
             .select(F.floor(F.col("all") * F.lit(budget_share)).cast("long").alias("budget"), (F.col("all") * epochs).alias("most"))
             .select(F.least("budget", "most").alias("budget")))
    for level in LEVELS:
        keys = [*parents, level]
        nodes = (supply.groupBy(*keys).agg((F.sum("supply") * epochs).alias("capacity"))
                 .withColumn("weight", _weight(level, weights)))
        nodes = nodes.crossJoin(F.broadcast(above)) if not parents else _same(nodes, above, parents)  # one row
        above = _share(nodes, parents, level).select(*keys, F.col("got").alias("budget"))
        parents = keys
    return _same(supply, above, LEVELS)


def mix(docs: DataFrame, budget_share: float = 0.8, epochs: int = 2, seed: int = 17,
        weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epoch of each copy taken."""
    weights = WEIGHTS if weights is None else weights
    tokens = staged(docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source",
                                F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
                                .cast("long").alias("n_tokens")), "mix-tokens")
    leaves = staged(leaf_budgets(tokens, budget_share, epochs, weights), "mix-leaves").withColumn(
        "whole", F.expr("budget div greatest(supply, 1L)")).withColumn("part", F.expr("budget - whole * supply"))
    rows = _same(tokens, leaves, LEVELS, "inner").withColumn(
        "hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole"), F.col("doc_id")).cast("binary"))).withColumn(
        "range", F.substring("hash", 1, _DIGITS))
    every = (rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
             .select("doc_id", *LEVELS, "n_tokens", "epoch"))
    last = rows.where(F.col("part") > 0)
    ranges = last.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*LEVELS, "range", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy(*LEVELS, "range").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    prefix = (_same(last, ranges, [*LEVELS, "range"], "inner")
              .where(F.col("before") <= F.col("part"))
              .withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
              .where(F.col("upto") <= F.col("part")).select("doc_id", *LEVELS, "n_tokens", F.col("whole").alias("epoch")))
    return every.unionByName(prefix)


def keep_mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes (once each), all columns kept."""
    taken = mix(docs, **{"epochs": 1, **how}).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["_id"]), "left_semi")


def _oracle(budget_share: str = "0.8", epochs: int = 2, seed: int = 17) -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in WEIGHTS.get(level, {}).items())
        return f"CAST(CASE {cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"

    parts, parents, above = [], [], "root"
    for level in LEVELS:
        keys = ", ".join([*parents, level])
        on = " AND ".join(f"n.{p} IS NOT DISTINCT FROM u.{p}" for p in parents) or "true"
        by = f"PARTITION BY {', '.join('n.' + p for p in parents)}" if parents else ""
        by2 = by.replace("n.", "")
        parts.append(f"""
n_{level} AS (SELECT n.*, u.budget, sum(n.weight) OVER ({by}) AS ws,
  coalesce(sum(n.capacity) OVER ({by} ORDER BY n.capacity / n.weight, n.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
  coalesce(sum(n.weight) OVER ({by} ORDER BY n.capacity / n.weight, n.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb
  FROM (SELECT {keys}, CAST(sum(supply) * {epochs} AS BIGINT) AS capacity, {weight(level)} AS weight FROM supply GROUP BY {keys}) n
  JOIN {above} u ON {on}),
f_{level} AS (SELECT *, capacity * (ws - wb) <= weight * (budget - cb) AS filled FROM n_{level}),
r_{level} AS (SELECT *, budget - coalesce(sum(capacity) FILTER (filled) OVER ({by2}), 0) AS rest,
  coalesce(sum(weight) FILTER (NOT filled) OVER ({by2}), 1) AS open FROM f_{level}),
b_{level} AS (SELECT {keys}, CAST(CASE WHEN filled THEN capacity ELSE (weight * rest) // open END AS BIGINT) AS budget FROM r_{level})""")
        parents, above = [*parents, level], f"b_{level}"
    return f"""
WITH t AS (SELECT doc_id, 'domain' || ((instr('0123456789abcdef', substr(md5(source), 1, 1)) - 1) % 4) AS domain, lang, source,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents),
supply AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM t GROUP BY ALL),
root AS (SELECT CAST(least(floor(sum(supply) * {budget_share}), sum(supply) * {epochs}) AS BIGINT) AS budget FROM supply),{','.join(parts)},
l AS (SELECT s.*, b.budget // greatest(s.supply, 1) AS whole, b.budget - (b.budget // greatest(s.supply, 1)) * s.supply AS part
  FROM supply s JOIN b_source b ON s.domain IS NOT DISTINCT FROM b.domain AND s.lang IS NOT DISTINCT FROM b.lang AND s.source IS NOT DISTINCT FROM b.source),
x AS (SELECT t.*, whole, part, md5(concat_ws('|', '{seed}', CAST(whole AS VARCHAR), CAST(doc_id AS VARCHAR))) AS h
  FROM t JOIN l ON t.domain IS NOT DISTINCT FROM l.domain AND t.lang IS NOT DISTINCT FROM l.lang AND t.source IS NOT DISTINCT FROM l.source),
y AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM x)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS BIGINT) AS epoch FROM
  (SELECT *, unnest(range(0, whole)) AS epoch FROM x WHERE whole > 0)
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(whole AS BIGINT) AS epoch FROM y WHERE part > 0 AND upto <= part
"""


ORACLE = _oracle()
