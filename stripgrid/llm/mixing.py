"""Mixing sources to target weights: water-filled targets, then pivotal rounding of copy numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stripgrid.functions.lineage import cut_lineage
from stripgrid.llm.common import fresh, unit

GROUP = 4096
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, budget: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Add ``weight`` and ``target`` to a table (source, source_size) with one row per source.

    Sources in code-point order (null last) weigh ``weights``, repeating. They share ``budget`` x all sizes by weight;
    a target stops at ``most`` x its source's size and the excess goes to the others by weight. The result is
    min(most x size, level x weight) for one level, found by going through the sources in the order in which they
    reach their bounds. ``sizes`` has one row per source, so these windows see sources, never documents.
    """
    named = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    rows = sizes.withColumn("weight", cycle[F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))])
    rows = rows.withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    filled = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    rows = rows.withColumns(
        {
            "below": F.sum("bound").over(filled.rowsBetween(Window.unboundedPreceding, -1)),
            "left": F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)),
            "share": F.lit(float(budget)) * F.sum("source_size").over(whole),
        }
    ).withColumn("level", (F.col("share") - F.coalesce("below", F.lit(0.0))) / F.col("left"))
    level = F.max(F.when(F.col("level") <= F.col("bound") / F.col("weight"), F.col("level"))).over(whole)
    rows = rows.withColumn("target", F.least("bound", F.coalesce(level * F.col("weight"), F.col("bound"))))
    return rows.select("source", "source_size", "weight", "target")


def draw(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) from three integers."""
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & (2**64 - 1)
    for shift in (30, 27, 31):
        x = ((x ^ (x >> shift)) * 0xD6E8FEB86659FD93) & (2**64 - 1)
    return (x >> 11) / 2.0**53


def settle(units: list[tuple], seed: int) -> tuple[list[tuple], tuple | None]:
    """Pivotal rounding of (id, size, part): the fractional parts of two units are pitted against each other.

    Mass moves between the two so that the words they stand for stay the same, in one of two directions, drawn so that
    each unit keeps its expectation, until one part is 0 or 1. Returns the decided units and the one that is left.
    """
    done, held = [], None
    for new in units:
        if held is None:
            held = new
            continue
        (i, s, p), (j, t, q) = held, new
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)  # words that can move to the held unit, or away
        moved = up if draw(seed, i, j) * (up + down) < down else -down
        pair = sorted([(i, s, p + moved / s), (j, t, q - moved / t)], key=lambda x: min(x[2], 1 - x[2]) * x[1])
        done.append((pair[0][0], round(pair[0][2])))
        held = pair[1]
        if min(held[2], 1 - held[2]) * held[1] < 1e-7:  # both became integral
            done.append((held[0], round(held[2])))
            held = None
    return done, held


def round_parts(units: DataFrame, seed: int = 0, group: int = GROUP) -> DataFrame:
    """Decide 0 or 1 for each (source, unit, size > 0, part in [0, 1)); returns (source, unit, copies)."""
    schema = "source string, unit long, copies long, size long, part double"

    def level(last: bool):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("unit")
            done, held = settle(list(zip(frame["unit"].tolist(), frame["size"].tolist(), frame["part"].tolist())), seed)
            if held is not None and last:
                done.append((held[0], int(draw(seed, held[0], held[1]) < held[2])))
                held = None
            rows = [(unit, copies, None, None) for unit, copies in done]
            if held is not None:
                rows.append((held[0], None, held[1], held[2]))
            out = pd.DataFrame(rows, columns=["unit", "copies", "size", "part"]).astype({"copies": "Int64", "size": "Int64"})
            out.insert(0, "source", frame["source"].iloc[0])
            return out

        return run

    decided, open_parts, last = None, units.select("source", "unit", "size", "part"), False
    while not last:
        counts = open_parts.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"))
        last = counts.where(F.col("n") > group).isEmpty()
        dealt = open_parts.join(counts, F.col("source").eqNullSafe(F.col("of")))
        dealt = dealt.withColumn("dealt_to", F.expr(f"pmod(xxhash64(unit), cast(ceil(n / {group}) as bigint))"))
        settled = cut_lineage(
            dealt.select("source", "unit", "size", "part", "dealt_to")
            .groupBy("source", "dealt_to")
            .applyInPandas(level(last), schema)
        )
        done = settled.where("copies is not null").select("source", "unit", "copies")
        decided = done if decided is None else decided.unionByName(done)
        open_parts = settled.where("copies is null").select("source", "unit", "size", "part")
    return decided


def mix(
    frame: DataFrame,
    size: Column,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    seed: int = 0,
    budget: float = 1.5,
    most: float = 2.0,
    weights: tuple = WEIGHTS,
) -> DataFrame:
    """Decide how often each row is taken: the frame with ``size``, ``source_size``, ``target`` and ``copies``.

    A row's expected copies are its source's target / size. The whole part is taken for certain. The fractional parts
    of a source's rows are settled in groups of about ``GROUP`` rows, dealt by a hash, so a source that holds most rows
    has as many groups as it needs; each leaves at most one open part. The open parts are settled again in groups, and
    so on: a reduction tree, until a coin decides the last part of a source. A source's taken words miss its target by
    less than one document. Draws depend on key, text and seed, so reruns agree in any layout.

    Rows of size 0 or null count as size 0 and are decided by a coin each. Null sources are one source, the last; null
    keys and texts are allowed. Rows that agree in source, key and text are settled together and get the same copies.
    An empty table gives an empty result. Columns named like the added ones are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    unit_id, of = fresh(frame, "unit_id"), fresh(frame, "unit_of")
    rows = frame.withColumns(
        {"size": F.coalesce(size.cast("long"), F.lit(0).cast("long")), unit_id: F.xxhash64(source, F.lit("|"), key, F.lit("|"), text)}
    )
    units = cut_lineage(
        rows.groupBy(F.col(source).cast("string").alias("source"), F.col(unit_id).alias("unit")).agg(F.sum("size").alias("size"))
    )
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = cut_lineage(targets(sizes, budget, most, weights))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    goals = goals.select(F.col("source").alias("of"), "source_size", "target", expected.alias("expected"))
    parts = (
        units.join(goals, F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("whole", F.floor(F.col("expected") + 1e-12))
        .withColumn("part", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    )
    open_parts = (F.col("size") > 0) & (F.col("part") > 1e-9)
    rounded = round_parts(parts.where(open_parts), seed)
    coin = F.when(F.col("size") == 0, (unit(F.lit(seed), F.col("unit")) < F.col("part")).cast("long")).otherwise(F.lit(0))
    fixed = parts.where(~open_parts).withColumn("copies", coin)
    chosen = (
        parts.where(open_parts)
        .join(rounded.select("unit", "copies"), "unit")
        .unionByName(fixed)
        .select(F.col("unit").alias(of), "source_size", "target", (F.col("whole") + F.col("copies")).cast("long").alias("copies"))
    )
    keep = [x for x in frame.columns if x.lower() not in added]
    return rows.drop(*[x for x in frame.columns if x.lower() in added and x != "size"]).join(
        chosen, F.col(unit_id) == F.col(of)
    ).select(*[f"`{x}`" for x in keep], *added)


def take(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of a mix as often as it is taken."""
    each = fresh(mixed, "copy")
    repeated = mixed.where("copies > 0").withColumn(each, F.explode(F.expr("sequence(1L, copies)")))
    return repeated.select(*[f"`{x}`" for x in columns])
