"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigraph.llm.text import free_name, n_words
from lumigraph.operators.similarity import number
from lumigraph.sources.tables import stash, table

WEIGHTS, MOST, CHUNK, FAN = (5, 2, 1), 3, 4096, 64
#: So many sources are broadcast at most (a row is under 100 bytes and a name).
SOURCES_BROADCAST = 10_000


def _before(df: DataFrame, order: list, sums: Sequence[str]) -> DataFrame:
    """`df` with, for each column x of `sums`, the sum of x over all rows before in `order`, as x_before.

    Rows are range-partitioned and summed within; the partitions' sums, one row
    each, give what lies before.
    """
    placed = stash(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("part").agg(*[F.sum(x).alias(x) for x in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    parts = parts.select("part", *[F.coalesce(F.sum(x).over(earlier), F.lit(0.0)).alias(f"{x}_part") for x in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(parts), "part")
    return out.select(*df.columns, *[(F.col(f"{x}_part") + F.coalesce(F.sum(x).over(own), F.lit(0.0))).alias(f"{x}_before") for x in sums])


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, units, target) from (source, mass): shares of the total mass by weight.

    Sources by code point, null last, take the weights in turn.  No target is
    above `most` times its source's size; the excess is shared again by weight
    among the others.  With sources ordered by size over weight the capped ones
    are a prefix, and the level of the rest follows from running sums: the same
    as resharing until none is above.  Sources may be many: no task sorts them
    all.  All sums are of whole numbers, so reruns agree.
    """
    by = sizes.groupBy("source").agg(F.sum("mass").cast("double").alias("source_size"), F.count("*").alias("units"))
    by = number(by, [F.asc_nulls_last("source")], 0)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("number", F.lit(len(weights))).cast("int") + 1)
    by = by.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by = stash(_before(by, [F.col("cap") / F.col("weight"), F.col("number")], ["cap", "weight"]))
    mass, shares = by.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(mass) - F.col("cap_before")) / (F.lit(shares) - F.col("weight_before"))
    # The first source that stays under its cap sets the level of all after it.
    free = by.where(F.col("cap") >= level * F.col("weight")).agg(F.min(F.struct((F.col("cap") / F.col("weight")).alias("at"), level.alias("level")))["level"]).first()[0]
    return by.select("source", F.col("source_size").cast("long").alias("source_size"), "units", F.least("cap", F.lit(free).cast("double") * F.col("weight")).alias("target"))


def pivot(mass: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round probabilities `p` pair by pair so that sum(mass * p) keeps its value; one at most stays fractional.

    A pair moves mass from one to the other, in either direction with the
    probability that keeps each expectation, until one of them is 0 or 1.
    """
    p, carry = p.copy(), -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if carry < 0:
            carry = i
            continue
        a, b, r = p[carry], p[i], mass[i] / mass[carry]
        up, down = min(1 - a, b * r), min(a, (1 - b) * r)
        if u[i] * (up + down) < down:
            a, b = (1.0 if up == 1 - a else a + up), (0.0 if up == b * r else b - up / r)
        else:
            a, b = (0.0 if down == a else a - down), (1.0 if down == (1 - b) * r else b + down / r)
        a, b = (round(x) if min(x, 1 - x) < 1e-12 else x for x in (a, b))
        p[carry], p[i] = a, b
        carry = carry if 0 < a < 1 else i if 0 < b < 1 else -1
    return p


def _round(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mass", "h"], ascending=[False, True], kind="stable").reset_index(drop=True)
        p = pivot(pdf["mass"].to_numpy("float64"), pdf["p"].to_numpy("float64"), pdf["u"].to_numpy("float64"))
        if last:  # what no partner is left for is decided by its own draw
            p = np.where((p > 0) & (p < 1), pdf["v"].to_numpy("float64") < p, p).astype("float64")
        return pdf.assign(p=p)

    return run


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """(doc_id, source, print, rows, size, source_size, target, copies): how often the mix takes each document.

    A document's size is its number of words.  Its source's target over the
    source's size is its number of copies: the whole part for sure, the
    fraction by pivotal rounding.  Documents of a source are dealt by hash into
    chunks of about CHUNK rows; each chunk leaves one fractional document at
    most, and those meet in groups of FAN chunks, level by level, until one
    is left for each source, decided by a draw of its own.  Larger documents go
    first, so that the last one is small and taken words end near the target.

    All draws are hashes of the row and `seed`, so reruns agree.  Rows equal in
    doc_id, source and text are one unit with `rows` rows, each taken `copies`
    times.  A null text is empty (size 0); documents of size 0 take part with
    their own draw.  A very long text is counted whole; units that tie in size
    follow their hash.  A null source is a source, the last one.  An empty table
    gives no rows.  Columns beside doc_id, source and text are not looked at.
    """
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("print"), n_words(F.col("text")).alias("size"))
    rows = rows.groupBy("doc_id", "source", "print", "size").agg(F.count("*").alias("rows"))
    rows = stash(rows.withColumn("mass", F.col("rows") * F.col("size")))
    goal = stash(targets(rows, weights, most).withColumnRenamed("source", "of"))
    n, widest = goal.agg(F.count("*"), F.coalesce(F.max("units"), F.lit(1))).first()
    draw = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "doc_id", "print", "size"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    units = rows.join(F.broadcast(goal) if n <= SOURCES_BROADCAST else goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    units = units.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio")).withColumn("frac", F.col("ratio") - F.col("whole"))
    units = units.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "print", "size")).withColumn("u", draw(1)).withColumn("v", draw(2))
    own_draw = (F.col("v") < F.col("frac")).cast("double")
    units = units.withColumn("chunk", F.pmod("h", F.ceil(F.col("units") / CHUNK))).withColumn("p", F.when(F.col("mass") > 0, F.col("frac")).otherwise(own_draw))
    units = units.drop("ratio", "frac", "units")
    done, left, chunks = [], units, -(-widest // CHUNK)
    while True:
        last = chunks <= 1
        out = stash(left.groupBy("source", "chunk").applyInPandas(_round(last), left.schema))
        done.append(out if last else out.where("p = 0 OR p = 1"))
        if last:
            break
        left = out.where("p > 0 AND p < 1").withColumn("chunk", F.floor(F.col("chunk") / FAN))
        left = left.withColumn("u", draw(3 + len(done)))
        chunks = -(-chunks // FAN)
    all_of = done[0]
    for x in done[1:]:
        all_of = all_of.unionByName(x)
    return all_of.select("doc_id", "source", "print", "rows", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """`docs` as the mix takes them: each row as many times as its copies, with the number of the copy in `copy_no`."""
    taken = mix(docs, **how).where("copies > 0")
    names = {x: free_name(docs.columns, f"lg_{x}") for x in ("doc_id", "source", "print", "copies")}
    taken = taken.select(*[F.col(x).alias(y) for x, y in names.items()])
    same = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & F.col("source").eqNullSafe(F.col(names["source"])) & (F.xxhash64("text") == F.col(names["print"]))
    out = docs.join(taken, same)
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int"))).alias(free_name(docs.columns, "copy_no")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    each = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), each.alias("row")).drop("row")


SQL = None
