"""Mixing sources to target weights by Pareto order sampling.

Every document of a source first gets the whole copies that the source's rate (target words / source words) makes
certain. The rest of the target is drawn by Pareto order sampling: a document with uniform number u and inclusion
probability l ranks by the odds u/(1-u) divided by the odds l/(1-l), and the lowest ranks are taken until the source's
remaining words are used up. Inclusion grows with the bit length of a document's size, so the draw is one of unequal
probabilities. A few fill-in rounds take later documents that still fit into what is left.

No row is ranked against the rows of its source in one task: the cut of a source is found by refining sums over 1,024
bins of the rank, so a source with a third of all rows costs as many small partial sums as any other.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in order;
a null id is drawn by its text; rows with equal ids are drawn alike (they tie, and a tie is taken whole or not at all);
an empty table gives an empty result. Only the named columns are used, so extra columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from roadloom.staging import staged, within_bound

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
ROUNDS = 3
LEVELS = 3
BITS = 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, salt: str = "mix") -> Column:
    """A uniform number in (0, 1) from 52 bits of a hash of the id; of the text where the id is null."""
    key = F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit(""))))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sums: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """From (source, s words): target words by weight, none above ``most`` times its source; the excess is reshared.

    The caps are met in order of cap / weight. One row per source goes through the windows here, never one per document.
    """
    n = len(weights)
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    x = sums.withColumn("w", F.element_at(F.array(*[F.lit(v).cast("long") for v in weights]), (F.row_number().over(order) - 1) % n + 1))
    fill = W.orderBy(most * F.col("s").cast("double") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, rest = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    x = x.withColumns({
        "total": F.sum("s").over(W.partitionBy()),
        "capped": F.coalesce(F.sum(most * F.col("s")).over(before), F.lit(0)),
        "left_w": F.sum("w").over(rest),
    })
    x = x.withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("left_w"))
    fits = F.when(F.col("level") * F.col("w") <= (most * F.col("s")).cast("double"), F.struct("capped", "left_w"))
    x = x.withColumn("at", F.first(fits, ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    level_target = (F.col("total") - F.col("at.capped")).cast("double") * F.col("w") / F.col("at.left_w")
    return x.withColumn("target", F.least((most * F.col("s")).cast("double"), level_target)).select("source", "s", "m", "target")


def _cut(rows: DataFrame, budgets: DataFrame, hint) -> DataFrame:
    """For each source of ``budgets``: the first rank p at which the words taken in order of p would exceed the budget, and the words before it.

    Sources whose rows all fit are left out.
    """
    at = budgets.withColumns({"before": F.lit(0).cast("long"), "bin": F.lit(0).cast("long")})
    for level in range(1, LEVELS + 2):
        prefix = F.floor(F.col("p") * float(2 ** (BITS * (level - 1))))
        fine = F.floor(F.col("p") * float(2 ** (BITS * level))) if level <= LEVELS else F.col("p")
        x = rows.join(hint(at), rows["source"].eqNullSafe(at["at_source"]) & (prefix == F.col("bin")))
        x = x.groupBy("at_source", "budget", "before", fine.alias("fine")).agg(F.sum("size").alias("words"))
        x = x.withColumn("upto", F.col("before") + F.sum("words").over(W.partitionBy("at_source").orderBy("fine")))
        over = F.struct("fine", (F.col("upto") - F.col("words")).alias("before"))
        at = x.where(F.col("upto").cast("double") > F.col("budget")).groupBy("at_source", "budget").agg(F.min(over).alias("o"))
        at = at.select("at_source", "budget", F.col("o.before").alias("before"), F.col("o.fine").alias("bin"))
    return at.select(F.col("at_source").alias("cut_source"), F.col("bin").alias("bound"), F.col("before").alias("used"))


def _rank() -> Column:
    """Pareto's rank q = odds of u / odds of the inclusion probability, as q / (1 + q) in (0, 1)."""
    lam = F.least(F.lit(1 - 1e-9), F.col("budget") * size_class() / F.col("m"))
    q = F.col("u") / (1 - F.col("u")) * ((1 - lam) / lam)
    return F.when((F.col("size") > 0) & (F.col("budget") > 0), q / (1 + q))


def _open(rounds: int) -> Column:
    """Whether the cuts of the rounds so far left the row out, and it fits into what each of them left."""
    ok = F.lit(True)
    for k in range(rounds):
        ok = ok & (F.col("p") >= F.col(f"bound{k}")) & (F.col("size") <= F.col(f"gap{k}"))
    return ok


def size_class() -> Column:
    return F.floor(F.log2(F.col("size") + 1)).cast("long") + 1


def plan_mix(sized: DataFrame, rounds: int = ROUNDS, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source of ``sized`` (source, size, u; staged): target, certain copies, and the cuts of the draw."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("s"), F.sum(F.col("size") * size_class()).alias("m"))
    x = source_targets(sums, weights, most)
    base = F.when(F.col("s") > 0, F.floor(F.col("target") / F.col("s"))).otherwise(0).cast("long")
    plan = staged(x.select(F.col("source").alias("at_source"), "s", "m", "target", base.alias("base"), (F.col("target") - base * F.col("s")).alias("budget")), "mix")
    hint = F.broadcast if within_bound(plan) else (lambda df: df)
    for r in range(rounds):
        prior = F.col(f"gap{r - 1}" if r else "budget")
        rows = sized.join(hint(plan), sized["source"].eqNullSafe(plan["at_source"])).withColumn("p", _rank())
        rows = rows.where(F.col("p").isNotNull() & _open(r)).select("source", "size", "p")
        cut = _cut(rows, plan.select("at_source", prior.alias("budget")).where("budget > 0"), hint)
        fits_all = F.col("bound").isNull()  # then there is no bound, and later rounds have nothing to add
        plan = plan.join(hint(cut), plan["at_source"].eqNullSafe(cut["cut_source"]), "left")
        plan = plan.withColumns({f"bound{r}": F.coalesce("bound", F.lit(2.0)), f"gap{r}": F.when(fits_all, F.lit(0.0)).otherwise(prior - F.col("used"))})
        plan = staged(plan.drop("bound", "used", "cut_source"), "mix")
    return plan


def apply_mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, u and others) with the columns of the plan, ``copies`` and ``taken``."""
    hint = F.broadcast if within_bound(plan) else (lambda df: df)
    rounds = sum(c.startswith("bound") for c in plan.columns)
    out = rows.join(hint(plan), rows["source"].eqNullSafe(plan["at_source"])).withColumn("p", _rank())
    drawn = F.lit(False)
    for k in range(rounds):
        drawn = drawn | (_open(k) & (F.col("p") < F.col(f"bound{k}")))
    copies = F.when(F.col("size") > 0, F.col("base") + F.coalesce(drawn, F.lit(False)).cast("long")).otherwise(0).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", "source", word_count(docs["text"]).alias("size"), draw(docs["doc_id"], docs["text"]).alias("u"), *more)


def mix_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    sized = staged(_sized(docs), "sized")
    return apply_mix(sized, plan_mix(sized)).select("doc_id", "size", F.col("s").alias("source_size"), "target", "copies", "taken")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the mix takes it, perhaps never, with the columns of ``docs``.

    The cuts per source decide in the row, so whole texts are not shuffled.
    """
    plan = plan_mix(staged(_sized(docs).drop("doc_id"), "sized"))
    rows = apply_mix(_sized(docs, F.struct(*[docs[c] for c in docs.columns]).alias("row")), plan).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS s, sum(size * (floor(log2(size + 1))::BIGINT + 1))::BIGINT AS m FROM sized GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS w, sum(s) OVER ()::BIGINT AS total FROM sums),
f AS (SELECT *, coalesce(sum(3 * s) OVER (ORDER BY 3 * s::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
  sum(w) OVER (ORDER BY 3 * s::DOUBLE / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS left_w FROM w),
lv AS (SELECT capped AS c, left_w AS lw FROM f WHERE (total - capped)::DOUBLE / left_w * w <= (3 * s)::DOUBLE
  ORDER BY 3 * s::DOUBLE / w, source IS NULL, source LIMIT 1),
t AS (SELECT source, s, m, least((3 * s)::DOUBLE, (total - c)::DOUBLE * w / lw) AS target FROM f, lv),
b AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS base FROM t),
p AS (SELECT d.*, b.s, b.target, b.base, b.target - b.base * b.s AS budget, least(1 - 1e-9, (b.target - b.base * b.s) * (floor(log2(d.size + 1))::BIGINT + 1) / b.m) AS lam
  FROM sized d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
q AS (SELECT *, CASE WHEN size > 0 AND budget > 0 THEN u / (1 - u) * ((1 - lam) / lam) END AS q FROM p),
r AS (SELECT *, q / (1 + q) AS p FROM q),
c0 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY p) AS upto FROM r WHERE p IS NOT NULL),
k0 AS (SELECT source, min(p) AS bound0, arg_min(budget, p) AS bud FROM c0 WHERE upto > budget GROUP BY source),
g0 AS (SELECT k.source, k.bound0, k.bud - coalesce((SELECT sum(size) FROM c0 WHERE c0.source IS NOT DISTINCT FROM k.source AND c0.p < k.bound0), 0) AS gap0 FROM k0 k),
r1 AS (SELECT r.*, g.bound0, g.gap0 FROM r JOIN g0 g ON r.source IS NOT DISTINCT FROM g.source WHERE r.p >= g.bound0 AND r.size <= g.gap0),
c1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY p) AS upto FROM r1),
k1 AS (SELECT source, min(p) AS bound1, min(gap0) AS gap0 FROM c1 WHERE upto > gap0 GROUP BY source),
g1 AS (SELECT k.source, k.bound1, k.gap0 - coalesce((SELECT sum(size) FROM c1 WHERE c1.source IS NOT DISTINCT FROM k.source AND c1.p < k.bound1), 0) AS gap1 FROM k1 k),
r2 AS (SELECT r.*, g.gap1 FROM r1 r JOIN g1 g ON r.source IS NOT DISTINCT FROM g.source WHERE r.p >= g.bound1 AND r.size <= g.gap1),
c2 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY p) AS upto FROM r2),
k2 AS (SELECT source, min(p) AS bound2 FROM c2 WHERE upto > gap1 GROUP BY source)
SELECT r.doc_id, r.size, r.s AS source_size, r.target,
  CASE WHEN r.size > 0 THEN r.base + coalesce(r.p < coalesce(g0.bound0, 2), false)::BIGINT
    + coalesce(g0.gap0 > 0 AND r.p >= g0.bound0 AND r.size <= g0.gap0 AND r.p < coalesce(g1.bound1, 2), false)::BIGINT
    + coalesce(g1.gap1 > 0 AND r.p >= g0.bound0 AND r.size <= g0.gap0 AND r.p >= g1.bound1 AND r.size <= g1.gap1 AND r.p < coalesce(k2.bound2, 2), false)::BIGINT ELSE 0 END::BIGINT AS copies,
  r.size * copies AS taken
FROM r LEFT JOIN g0 ON r.source IS NOT DISTINCT FROM g0.source LEFT JOIN g1 ON r.source IS NOT DISTINCT FROM g1.source LEFT JOIN k2 ON r.source IS NOT DISTINCT FROM k2.source
"""
