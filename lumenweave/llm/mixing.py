"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted once into cells of (source, language, topic) with their tokens. The cells' weights
are raked: scaled to the first margin's targets, then the second's, the third's, round after round, until
each margin fits, or `rounds` are over and the error falls no more. Documents can be drawn once at most, so the weights are raked again
with the cells' tokens as bounds: a cell is drawn with probability min(1, product of one factor for each
margin), by a hash of doc_id, and the factors are found so that the expected tokens are the wanted share of
all and every margin fits. A value whose target asks for more tokens than it has is drawn whole, and the
others of its margin share the rest by their targets; what is missed so is returned. Only the scan of
documents grows with the corpus; raking works on cells, as DataFrames, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, uniform

NONE = "\u0000none"
CELL = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def form(text: Column, tokens: Column) -> Column:
    """The stand-in for a topic where documents carry none: the form of the text, by words and words per line."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(tokens == 0, "empty").when(tokens < 100, "short").when(tokens / lines < 15, "list").when(tokens >= 1500, "long").otherwise("prose")


def targets(cells: DataFrame, margin: str, flatten: float) -> DataFrame:
    """(margin, target): shares of tokens to the power `flatten`, scaled to one. 1 keeps the shares, 0 levels them."""
    t = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("t", F.pow("t", F.lit(flatten)))
    total = t.agg(F.sum("t")).first()[0] or 1.0
    return t.select(margin, (F.col("t") / F.lit(total)).alias("target"))


#: cells up to this number are raked in one task, where no step of a round needs a shuffle; more are dealt by margin
ONE_TASK = 50_000


def _gathered(cells: DataFrame, few: bool) -> DataFrame:
    """cells as written, in one partition if they are few."""
    return cells.coalesce(1) if few else cells


def _round(cells: DataFrame, off: Column, few: bool) -> tuple[DataFrame, float]:
    """(cells written, without `off`; the largest error, seen while they are written): one job a round, not a second one that reads them."""
    seen = Observation()
    out = cut(cells.observe(seen, F.max(off).alias("off")).drop("off"))
    return _gathered(out, few), seen.get["off"] or 0.0


def _held(cells: DataFrame, m: str, few: bool) -> DataFrame:
    """cells with `held`, the weight of all cells of the same value of m: by a window where they are in one partition already, else by partial sums
    and a join, cut as the plan would double with each."""
    if few:
        return cells.withColumn("held", F.sum("weight").over(Window.partitionBy(m)))
    return cut(cells.join(cells.groupBy(m).agg(F.sum("weight").alias("held")), m))


def rake(cells: DataFrame, goals: dict[str, DataFrame], *, rounds: int = 30, fit: float = 1e-3) -> tuple[DataFrame, float]:
    """(cells with `weight`, a share of one; the largest error left in a margin, relative to its target).

    goals: for each margin column a table (margin, target). A value without target, or with target 0, gets weight 0; a
    target whose value has no cell cannot be met, and the others share its weight. Cells without tokens have weight 0.
    After `rounds` it goes on while a round takes a hundredth or more off the error; goals that contradict each other end so.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("weight", F.lit(0.0)), 0.0
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for m, g in goals.items():  # each cell takes along its margins' targets, scaled to the values that have cells
        g = g.join(cells.where("tokens > 0").select(m).distinct(), m, "left_semi")
        s = g.agg(F.sum("target")).first()[0] or 1.0
        now = now.join(g.select(m, (F.col("target") / F.lit(s)).alias(f"goal_{m}")), m, "left")
    few = cells.count() <= ONE_TASK
    now, error, done = _gathered(cut(now), few), float("inf"), 0
    while True:
        off = F.lit(0.0)
        for m in goals:
            ratio = F.when(F.col("held") > 0, F.coalesce(f"goal_{m}", F.lit(0.0)) / F.col("held")).otherwise(0.0)
            now = _held(now, m, few).select(*[c for c in now.columns if c not in ("weight", "off")], (F.col("weight") * ratio).alias("weight"), F.greatest(off, F.abs(ratio - 1)).alias("off"))
            off = F.col("off")
        now, largest = _round(now, F.when(F.col("weight") > 0, F.col("off")), few)
        before, error, done = error, largest, done + 1
        if error <= fit or (done >= rounds and error > 0.99 * before):
            break
    return now.drop(*[f"goal_{m}" for m in goals]), float(error)


def _scaled(p: str, order: Window, goal: Column) -> tuple[Column, Column]:
    """(all tokens' share held at p, candidate of the factor of p that holds `goal`) over an order by p in which shares over 1 are whole.

    The candidate is right if just the rows after this one are whole; the largest of them is the factor.
    """
    up, one = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.sum(F.col("tokens") * F.least(F.lit(1.0), p)).over(one)
    return held, (goal - F.sum("tokens").over(one) + F.sum("tokens").over(up)) / F.sum(F.col("tokens") * F.col(p)).over(up)


def bound(raked: DataFrame, goals: dict[str, DataFrame], share: float, *, rounds: int = 60, fit: float = 1e-4) -> DataFrame:
    """raked cells with `probability`: expected tokens are share * all, or all of positive weight if they are fewer, and margins fit as far as tokens reach.

    In a step all cells of a margin's value get the one factor that gives the value its tokens, cells being whole at
    probability 1. It is the largest of the factors that are right where the cells from some place on, by probability, are whole.
    """
    got = raked.agg(F.sum("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("tokens")))).first()
    total, full = got[0] or 0, got[1] or 0
    if not total or not full or share <= 0:
        return raked.withColumn("probability", F.lit(0.0))
    want = min(share * total, full)
    live = raked.where("tokens > 0 and weight > 0")
    now = live.withColumn("p", F.col("weight") / F.col("tokens") * F.lit(float(want)))
    for m, g in goals.items():  # what each value is to have: its target of `want`, or all its tokens
        values = live.groupBy(m).agg(F.sum("tokens").alias("tokens")).join(g.select(m, F.col("target").alias("weight")), m).where("weight > 0")
        order = Window.partitionBy(F.lit(0)).orderBy("p", m)  # one row a value of the margin: sorted in one task, which may spill
        value = values.withColumn("p", F.col("weight") / F.col("tokens"))
        value = value.withColumn("factor", _scaled("p", order, F.lit(float(want)))[1])
        value = value.withColumn("factor", F.max("factor").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        now = now.join(value.select(m, (F.col("tokens") * F.least(F.lit(1.0), F.col("p") * F.col("factor"))).alias(f"goal_{m}")), m)
    few = raked.count() <= ONE_TASK
    now = _gathered(cut(now), few)
    for _ in range(rounds):
        off = F.lit(0.0)
        for m in goals:
            order = Window.partitionBy(m).orderBy("p", *CELL)  # one order for all windows of a margin: one sort, and two passes over it
            kept = [c for c in now.columns if c not in ("p", "off")]
            held, factor = _scaled("p", order, F.col(f"goal_{m}"))
            now = now.select(*kept, "p", F.greatest(off, F.abs(held / F.col(f"goal_{m}") - 1)).alias("off"), factor.alias("factor"))
            now = now.select(*kept, "off", (F.col("p") * F.max("factor").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("p"))
            off = F.col("off")
        now, error = _round(now, F.col("off"), few)
        if error <= fit:
            break
    drawn = now.select(*CELL, F.least(F.lit(1.0), "p").alias("probability"))
    return raked.join(drawn, list(CELL), "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))


def margins(cells: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """margin, value, target, expected, largest_share for each value of the margins, of cells with tokens and probability.

    target and expected are shares of the sample's tokens, a null value is NONE; largest_share is the share of all tokens
    beyond which the value has too few for its target, null where nothing is asked.
    """
    r = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    total, drawn = float(r[0] or 1), float(r[1] or 1)
    tables = []
    for m, g in goals.items():
        held = cells.groupBy(m).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("held"))
        t = held.join(g, m, "full").select(F.lit(m).alias("margin"), F.col(m).alias("value"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("held", F.lit(0.0)).alias("held"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
        tables.append(t.select("margin", "value", "target", (F.col("held") / F.lit(drawn)).alias("expected"), F.when(F.col("target") > 0, F.col("tokens") / F.lit(total) / F.col("target")).alias("largest_share")))
    return cut(reduce(DataFrame.union, tables))


def mix_with_margins(docs: DataFrame, *, share: float = 0.7, flatten: dict[str, float] | None = None, topic: Column | None = None, goals: dict[str, DataFrame] | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The documents as `mix` gives them, and the table of `margins` that tells which targets the sample holds, with rake's error as raking_error."""
    flatten = {"source": 0.5, "lang": 0.6, "topic": 0.8} | (flatten or {})
    added = ("n_tokens", "weight", "probability", "missed", "selected")
    kept = [c for c in docs.columns if c not in added and c != "topic"]
    tokens = n_tokens(F.col("text"))
    topic = topic if topic is not None else form(F.col("text"), F.col("n_tokens"))
    rows = docs.select(*kept).withColumn("n_tokens", tokens).withColumn("topic", topic)
    own = {m: F.coalesce(F.col(m).cast("string"), F.lit(NONE)) for m in CELL}
    cells = cut(rows.select("n_tokens", *[c.alias(m) for m, c in own.items()]).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    goals = goals or {m: targets(cells, m, f) for m, f in flatten.items()}
    raked, error = rake(cells, goals)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    chosen = cut(bound(raked, goals, share))
    held = margins(chosen, goals).withColumn("raking_error", F.lit(error))
    drawn, off = chosen, F.lit(0.0)
    for m in goals:
        miss = F.when(F.col("target") > 0, F.abs(F.col("expected") / F.col("target") - 1)).otherwise(0.0)
        drawn = drawn.join(held.where(F.col("margin") == m).select(F.col("value").alias(m), miss.alias(f"miss_{m}")), m, "left")
        off = F.greatest(off, F.coalesce(f"miss_{m}", F.lit(0.0)))
    drawn = cut(drawn.select(
        *[F.col(m).alias(f"__{m}") for m in own], F.when(F.col("tokens") > 0, F.col("weight") / (F.col("tokens") / F.lit(float(total)))).otherwise(0.0).alias("weight"), "probability", off.alias("missed")
    ))
    rows = rows.withColumns({f"__{m}": c for m, c in own.items()})
    out = rows.join(drawn, [f"__{m}" for m in own], "left").drop(*[f"__{m}" for m in own])
    return out.withColumn("selected", F.coalesce(uniform(F.col("doc_id"), seed=seed) < F.col("probability"), F.lit(False))), held


def mix(docs: DataFrame, *, share: float = 0.7, flatten: dict[str, float] | None = None, topic: Column | None = None, goals: dict[str, DataFrame] | None = None, seed: int = 11) -> DataFrame:
    """All columns of docs and n_tokens, topic, weight (of the document's cell, as a multiple of its share), probability, missed, selected.

    Margins are source, lang and topic; `flatten` gives each margin's power of its share as target, unless `goals` gives tables. A null
    source, language or topic is a value of its own. Texts without tokens, null ones too, have probability 0. Rows that repeat
    a doc_id are drawn together; a null doc_id draws by its null. Texts of any length are counted whole. An empty table gives no rows.
    Columns named like the added ones are replaced. missed is the largest
    miss, |expected share / target - 1|, of the document's source, language and topic: over 0 where `share` asks for more than there is.
    """
    return mix_with_margins(docs, share=share, flatten=flatten, topic=topic, goals=goals, seed=seed)[0]


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "missed", "selected")
