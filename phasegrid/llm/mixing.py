"""Mix sources to target weights: water-filling under a cap, then seeded whole and partial repetitions.

``source_targets`` gives every source its share of all words by weight; a source stops at
``max_epochs`` times its size and the others take up the rest by weight, until none is above.
``mix`` repeats each document as often as the whole part of its source's epochs says, and once more
the documents whose seeded draw is lowest, as many as bring the source's words nearest to its target.

Cases: a null source is a source of its own, the last; a null text has size 0; sources without words
get target 0; rows equal in id and text share one draw, so they are repeated alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.scratch import numbered, written
from phasegrid.llm.texts import quoted, without

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 17
#: A draw has 52 bits; the search for a source's last draw looks at ten of them at a time.
DRAW_HEX, STEP_BITS, STEPS = 13, 10, 3
RESULT = ["size", "source_size", "target", "copies", "taken"]


def draw(seed: int, key: Column, text: Column) -> Column:
    """A number of 52 bits that depends on seed, id and text alone."""
    content = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(content), 1, DRAW_HEX), 16, 10).cast("long")


def source_targets(sizes: DataFrame, source: str, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows; weights repeat along the sorted sources."""
    totals = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals, [F.col(source).asc_nulls_last()], "rank", "sources")
    cycle = F.array(*map(F.lit, weights))
    plan = ranked.select(
        source,
        "source_size",
        F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("decimal(38,0)").alias("weight"),
        (F.col("source_size") * max_epochs).cast("decimal(38,0)").alias("cap"),
    )
    plan = written(plan, "weights")
    total, free_weight = plan.agg(F.sum("source_size"), F.sum("weight")).first()
    left, free_weight, full = int(total or 0), int(free_weight or 0), F.lit(False)
    while free_weight:
        # Exact in integers: above its cap is weight * left / free_weight > cap.
        full = F.expr(f"weight * {left}BD > cap * {free_weight}BD")
        capped, weight = plan.agg(
            F.sum(F.when(full, F.col("cap"))), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        after = int(total) - int(capped or 0)
        if (after, int(weight)) == (left, free_weight):
            break
        left, free_weight = after, int(weight)
    share = F.expr(f"CAST(weight AS DOUBLE) * {float(left)!r}D / {float(max(free_weight, 1))!r}D")
    target = F.when(full, F.col("cap").cast("double")).otherwise(share)
    return plan.select(source, "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    drop_text: bool = False,
) -> DataFrame:
    """Each row with ``size, source_size, target, copies, taken``; ``copies`` may be 0."""
    kept = without(docs, RESULT)
    if drop_text:
        kept = [c for c in kept if c != text]
    drawn = docs.select(
        *[F.col(quoted(c)) for c in kept],
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source).alias("__source"),
        F.shiftright(draw(seed, F.col(key), F.col(text)), DRAW_HEX * 4 - STEP_BITS * STEPS).alias("__draw"),
    )
    if drop_text:
        drawn = written(drawn, "draws")
        draws = drawn.select("__source", "size", "__draw")
    else:
        draws = written(drawn.select("__source", "size", "__draw"), "draws")
    plan = written(_limits(draws, source_targets(draws, "__source", weights, max_epochs)), "limits")
    plan = plan.withColumnRenamed("__source", "__of")
    copies = F.col("__whole") + (F.col("__draw") < F.col("__limit")).cast("int")
    return (
        drawn.join(plan, F.col("__source").eqNullSafe(F.col("__of")))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*map(quoted, kept), *RESULT)
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """Every row ``copies`` times."""
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("__copy")


def _limits(draws: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source the whole repetitions, and the draw below which a document is taken once more.

    Sums per source and run of draws show in which run the missing words end; each step looks at
    that run more closely. A source never has more than 2^10 runs in hand.
    """
    state = targets.selectExpr(
        "__source",
        "source_size",
        "target",
        "IF(source_size > 0, CAST(floor(target / source_size) AS INT), 0) AS __whole",
        "0L AS __limit",
    ).withColumn("__need", F.expr("CAST(round(target) AS BIGINT) - __whole * source_size"))
    state = written(state, "epochs")
    for step in range(1, STEPS + 1):
        shift = STEP_BITS * (STEPS - step)
        rows = draws.withColumn("__run", F.shiftright("__draw", shift))
        left = state.select(F.col("__source").alias("__of"), "__limit")
        runs = (
            rows.join(left, F.col("__source").eqNullSafe(F.col("__of")) & (F.shiftright("__run", STEP_BITS) == F.col("__limit")))
            .groupBy("__source", "__run")
            .agg(F.sum("size").alias("__words"))
            .withColumn("__sum", F.expr("sum(__words) OVER (PARTITION BY __source ORDER BY __run)"))
            .withColumnRenamed("__source", "__of")
        )
        met = (
            state.join(runs, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__sum") >= F.col("__need")))
            .groupBy("__source")
            .agg(F.min(F.struct("__run", "__words", "__sum")).alias("__met"))
            .withColumnRenamed("__source", "__of")
        )
        state = state.join(met, F.col("__source").eqNullSafe(F.col("__of")), "left").selectExpr(
            "__source",
            "source_size",
            "target",
            "__whole",
            f"coalesce(__met.__run, (__limit << {STEP_BITS}) + {(1 << STEP_BITS) - 1}) AS __limit",
            "coalesce(__need - (__met.__sum - __met.__words), 0) AS __need",
            "__met.__words AS __last",
        )
        state = written(state.drop("__last") if step < STEPS else state, f"draws-{step}")
    # The run in which the words end is taken too where that comes nearer.
    return state.selectExpr(
        "__source", "source_size", "target", "__whole", "__limit + IF(__last < 2 * __need, 1, 0) AS __limit"
    )
