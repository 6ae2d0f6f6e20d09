"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all rates r_i in [0, cap] whose tokens meet each source's target, the ones closest to
rate 1 in relative entropy are r_i = min(cap, exp(lambda_s * size_i / scale_s)). The convex
dual has one multiplier for each source; safeguarded Newton steps on it are one
aggregation each over the distinct (source, size) pairs with their counts. Rates are then
rounded into whole copies by a hash of the id, and what a source still lacks or has too
much is settled on a few documents of falling size.

Defined results: sources are ordered by code point with null last, null being a source
of its own; empty or null texts have size 0 and take 0; an empty table gives no rows;
rows that share id, source and size share their rounding and are never used to settle a
remainder, nor are rows without an id. Weights repeat along the ordered sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, Work
from .quality_rules import GAPS

#: Newton stops when every source is within this share of its target, or after ROUNDS.
TOLERANCE, ROUNDS = 1e-9, 40
#: So many documents for each octave of sizes and direction can settle a remainder.
SETTLERS = 3
#: Settling rows (some 40 bytes each) that may be sent to every task.
SENT_PICKS = 200_000


def size_of(text):
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, GAPS))).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], cap: int) -> DataFrame:
    """(source, weight, source_size, target) from rows of (source, size, n).

    Targets share the total by weight; one that passes ``cap`` times its source's size
    stops there and the rest is shared anew. The end of that process is a water level:
    with sources in order of size / weight those at the cap are a prefix.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # One row a source: these windows see as many rows as there are sources.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0).cast("long")
    per = per.withColumns({
        "total": F.sum("source_size").over(whole),
        "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero),
        "capped": cap * F.coalesce(F.sum("source_size").over(before), zero),
    })
    # The first source in that order which its share does not lift above its cap sets the level.
    share = (F.col("total") - F.col("capped")).cast("double") / F.col("left_weight")
    per = per.withColumn("level", F.when((F.col("total") - F.col("capped")) * F.col("weight") <= cap * F.col("source_size") * F.col("left_weight"), F.struct(F.row_number().over(order).alias("k"), share.alias("share"))))
    per = per.withColumn("level", F.min("level").over(whole)["share"])
    free = (F.col("level") * F.col("weight")).cast("double")
    return per.select("source", "weight", "source_size", F.least(free, (cap * F.col("source_size")).cast("double")).alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[int] = (1, 2, 3), cap: int = 3, size=None, carry: list[str] = ()) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, rate, copies, taken,
    and in the struct ``carried`` the input's columns named in ``carry``, if any."""
    spark = docs.sparkSession
    work = Work(spark, "mixing")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), (size_of(F.col(text_col)) if size is None else size).alias("size"), *([F.struct(*carry).alias("carried")] if carry else []))
    sized = work.keep(named, "sizes")
    also = ["carried"] if carry else []
    classes = work.keep(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    state = source_targets(classes, list(weights), cap)
    scale = classes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale")).withColumnRenamed("source", "s2")
    state = state.join(scale, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    # At the cap, and in a source without words, there is nothing to solve.
    state = state.withColumns({"lam": F.lit(0.0), "low": F.lit(-1e3), "high": F.lit(1e3), "free": (F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))})
    state = work.keep(state, "state")
    some = classes.where("size > 0")
    for _ in range(ROUNDS):
        named = state.where("free").select(F.col("source").alias("s2"), "lam", "scale")
        x = F.col("size") / F.col("scale")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        tokens = F.col("size") * F.col("n")
        sums = some.join(named, F.col("source").eqNullSafe(F.col("s2"))).groupBy("s2").agg(F.sum(tokens * F.least(tilt, F.lit(float(cap)))).alias("got"), F.sum(F.when(tilt < cap, tokens * tilt * x).otherwise(0.0)).alias("slope"))
        step = state.join(sums, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
        over = F.col("got") - F.col("target")
        step = step.withColumns({"low": F.when(over < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(over > 0, F.col("lam")).otherwise(F.col("high")), "err": F.abs(over) / F.greatest("target", F.lit(1.0))})
        # Newton on the logarithm of the tokens; the bracket's middle where that leaves it.
        newton = F.col("lam") - F.try_divide(F.log(F.col("got") / F.col("target")) * F.col("got"), F.col("slope"))
        middle = F.when(F.col("low") <= -1e3, F.least(F.col("lam") * 2, F.col("lam") - 1)).when(F.col("high") >= 1e3, F.greatest(F.col("lam") * 2, F.col("lam") + 1)).otherwise((F.col("low") + F.col("high")) / 2)
        new = F.when(newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton) < 1e3), newton).otherwise(middle)
        done = ~F.col("free") | (F.col("err") <= TOLERANCE) | (F.col("high") - F.col("low") < 1e-13)
        step = work.keep(step.withColumn("done", done).withColumn("lam", F.when(done, F.col("lam")).otherwise(new)).drop("got", "slope", "err"), "state")
        work.drop(state)
        state = step.drop("done")
        state.kept_at = step.kept_at
        if not step.where("not done").head(1):
            break
    work.drop(classes)
    rate = F.when(F.col("free"), F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))))).otherwise(F.when(F.col("source_size") > 0, F.lit(float(cap))).otherwise(F.lit(1.0)))
    rated = sized.join(state.withColumnRenamed("source", "s2").drop("weight"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumn("rate", rate)
    unit = F.pmod(F.xxhash64(F.lit("round"), "doc_id", "source", "size"), F.lit(1 << 53)) / float(1 << 53)
    rated = rated.withColumn("copies", (F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("long")).cast("long")).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "free", *also)
    # What rounding left over goes to a few documents, largest first, while it is at least half their size.
    octave = F.floor(F.log2("size")).cast("int")
    per_source = rated.where("free").groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
    can = rated.where("free and size > 0 and doc_id is not null").select("source", "doc_id", "size", octave.alias("octave"), F.pmod(F.xxhash64(F.lit("settle"), "doc_id"), F.lit(SETTLERS)).alias("lot"), F.explode(F.filter(F.array(F.when(F.col("copies") < cap, F.lit(1)), F.when(F.col("copies") > 0, F.lit(-1))), lambda x: x.isNotNull())).alias("sign"))
    lots = can.groupBy("source", "octave", "lot", "sign").agg(F.min_by(F.struct("doc_id", "size"), F.struct("doc_id", "size")).alias("pick")).select("source", "sign", "pick.*")
    lots = work.keep(lots, "picks")
    # A few rows for each source and octave, so the table can be sent if there are few sources.
    small = F.broadcast if lots.limit(SENT_PICKS + 1).count() <= SENT_PICKS else lambda df: df
    # A move is made on every row that it names, so only ids that have one row may move.
    picked = lots.select(F.col("doc_id").alias("picked")).distinct()
    once = sized.where("doc_id is not null").join(small(picked), F.col("doc_id") == F.col("picked")).groupBy("picked").agg(F.count(F.lit(1)).alias("rows")).where("rows = 1").select(F.col("picked").alias("doc_id"))
    lots = lots.join(small(once), "doc_id", "left_semi")
    queue = lots.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "sign")), asc=False).alias("queue")).withColumnRenamed("source", "s2")
    start = F.struct(F.col("rest").cast("double").alias("rest"), F.array().cast("array<struct<doc_id:bigint,sign:int>>").alias("moves"))

    def settle(acc, c):
        useful = (acc["rest"] * c["sign"] >= c["size"] / 2) & ~F.exists(acc["moves"], lambda m: m["doc_id"] == c["doc_id"])
        return F.struct(F.when(useful, acc["rest"] - c["sign"] * c["size"]).otherwise(acc["rest"]).alias("rest"), F.when(useful, F.concat(acc["moves"], F.array(F.struct(c["doc_id"].cast("bigint").alias("doc_id"), c["sign"].cast("int").alias("sign"))))).otherwise(acc["moves"]).alias("moves"))

    moves = per_source.join(queue, F.col("source").eqNullSafe(F.col("s2"))).select(F.inline(F.aggregate("queue", start, settle)["moves"])).select(F.col("doc_id").alias("moved"), "sign")
    out = rated.join(small(moves), F.col("doc_id") == F.col("moved"), "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *also)
