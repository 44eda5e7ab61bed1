"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document's size is its number of words (runs without blank or the characters 9 to 13). Sources, in code-point order with null last, weigh
5, 2, 1, repeating, and share BUDGET times all sizes; a source's target stops at CAP times its size, and the excess is shared again by weight until
none is above (which has a closed form: order the sources by cap / weight, and find the level at which the first is not capped).

A document of a source with the ratio f = target / size is taken floor(f) times, and once more with a fractional part to be rounded. Rounding is
dependent (Deville and Tillé 1998): two fractional documents are paired, and words move at random from one to the other, so that the
expectations stay, until one of them is wholly in or out; the rest goes on. Since moves keep the number of words, a source's sum hits its target but
for the one document left at the end. Pairs meet in a tree: documents are dealt by hash into small cells of about FAN of one source, each cell leaves
one fractional document, these are dealt into cells again, and so on. In a cell the longest go first, so that short ones even them out and the one
left is short. A hot source just has more cells. Each level is written to the shared folder.

Rows equal in id, source and size are one unit: of c such rows floor(c * fraction) are taken once more for certain, and what is left is one fractional row. They
are counted before anything is shuffled, so that a third of all rows may be equal.

Randomness is a hash of id, size, level and SEED, so reruns agree. Defined results: null or wordless texts have size 0 and are taken 0 times; which of the rows
of a unit are taken once more is a matter of the hash of all their columns; null ids and sources are values like others; extra columns
are ignored by ``allocate`` and carried by ``mix``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, stored, table

WEIGHTS, BUDGET, CAP, FAN, SEED = (5, 2, 1), 1.5, 2, 48, 17
#: Equal rows that one task writes out.
REPEATS = 100_000


def size_of(text: str = "text") -> Column:
    """Number of words, counted as places where a word ends; linear and without building the words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on; these windows hold sources, not documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("double")
    everything = Window.partitionBy()
    per = per.withColumn("weight", weight).withColumn("cap", (CAP * F.col("source_size")).cast("double")).withColumn("total", F.sum("source_size").over(everything) * F.lit(BUDGET))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source whose share at its own level is within its cap sets the level of all that aren't capped.
    per = per.withColumn("common", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything)["level"])
    target = F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.greatest(F.lit(0.0), F.col("common") * F.col("weight"))))
    return per.select("source", "source_size", target.alias("target"))


def _uniform(*columns) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(SEED)), 11) * F.lit(2.0**-53)


def _fold(units: Column) -> Column:
    """Pairs the units (key, a: words, p: fraction, u: random) of an array one after the other.

    Gives struct(done: array of the settled (key, up), rest: array of the one that is left or none)."""
    settled = "array<struct<key:struct<doc_id:bigint,source:string,size:bigint>,up:boolean>>"
    left = "array<struct<key:struct<doc_id:bigint,source:string,size:bigint>,a:double,p:double>>"
    zero = F.struct(F.array().cast(settled).alias("done"), F.array().cast(left).alias("rest"))

    def step(state: Column, j: Column) -> Column:
        i = F.element_at(state["rest"], 1)
        mi, mj, gi, gj = i["a"] * i["p"], j["a"] * j["p"], i["a"] * (1 - i["p"]), j["a"] * (1 - j["p"])
        to_i, to_j = F.least(gi, mj), F.least(mi, gj)
        i_gains = j["u"] * (to_i + to_j) < to_j  # words move to i with the probability that keeps both expectations
        unit = lambda x, p: F.array(F.struct(x["key"].alias("key"), x["a"].alias("a"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))).cast(left)
        end = lambda x, up: F.array(F.struct(x["key"].alias("key"), F.lit(up).alias("up"))).cast(settled)
        result = lambda done, rest: F.struct(F.concat(state["done"], done).alias("done"), rest.alias("rest"))
        moved = (
            F.when(i_gains & (gi <= mj), result(end(i, True), unit(j, (mj - gi) / j["a"])))
            .when(i_gains, result(end(j, False), unit(i, (mi + mj) / i["a"])))
            .when(mi <= gj, result(end(i, False), unit(j, (mj + mi) / j["a"])))
            .otherwise(result(end(j, True), unit(i, (mi - gj) / i["a"])))
        )
        return F.when(F.size(state["rest"]) == 0, F.struct(state["done"].alias("done"), unit(j, j["p"]).alias("rest"))).otherwise(moved)

    return F.aggregate(units, zero, step)


def rounded(units: DataFrame, largest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, up) of units (key: struct<doc_id, source, size>, a, p, n_source): whether each is taken once more; and the stored levels that it is read from.

    largest: the number of units of the largest source, which sets the number of levels; n_source: of the unit's own source.
    """
    spark = units.sparkSession
    now, done, level, levels = units.withColumn("cells", F.ceil(F.col("n_source") / FAN)), None, 0, []
    while True:
        key = F.col("key")
        u = _uniform(key["doc_id"], key["size"], key["source"], F.lit(level))
        deal = F.pmod(F.xxhash64(key["doc_id"], key["size"], F.lit(level), F.lit(SEED + 1)), F.col("cells"))
        cells = now.select(F.col("key.source").alias("source"), deal.alias("cell"), "cells", F.struct((-F.col("a")).alias("order"), F.xxhash64(key["doc_id"], key["size"], F.lit(level), F.lit(SEED + 2)).alias("tie"), "key", "a", "p", u.alias("u")).alias("unit"))
        cells = cells.groupBy("source", "cell", "cells").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        folded = stored(cells.select("cells", _fold(F.col("units")).alias("f")), spark, f"mix{level}")
        levels.append(folded)
        settled = folded.select(F.explode("f.done").alias("x")).select("x.key", "x.up")
        done = settled if done is None else done.union(settled)
        rest = folded.select("cells", F.explode("f.rest").alias("x")).select("x.key", "x.a", "x.p", "cells")
        if largest <= FAN:  # one cell per source: the last document of each is rounded by itself
            last = rest.select("key", (_uniform(rest["key"]["doc_id"], rest["key"]["size"], rest["key"]["source"], F.lit(-1)) < F.col("p")).alias("up"))
            return done.union(last), levels
        now, level, largest = rest.withColumn("cells", F.ceil(F.col("cells") / FAN)), level + 1, -(-largest // FAN)


def _equal(doc_id: str, source: str, size: str):
    """Whether a unit with these columns is that of the row."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)) & (F.col("size") == F.col(size))


def units_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, rows, source_size, target, whole, more of each unit: its rows are taken ``whole`` times, ``more`` of them once more."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"))
    counted = stored(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), spark, "sizes")
    n_units = counted.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n_source"))
    per = targets(counted.select("source", (F.col("size") * F.col("rows")).alias("size"))).join(n_units, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per = stored(per, spark, "targets")
    largest = per.agg(F.max("n_source")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = per.select(F.col("source").alias("s"), "source_size", "target", "n_source", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"))
    # Sources are few, but nothing bounds them: a plain join, whose hot keys adaptive execution splits.
    units = counted.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = units.withColumn("certain", F.floor(F.col("rows") * F.col("p") + 1e-9)).withColumn("rest", F.greatest(F.lit(0.0), F.col("rows") * F.col("p") - F.col("certain")))
    open_units = units.where("size > 0 and rest > 0").select(F.struct("doc_id", "source", "size").alias("key"), F.col("size").cast("double").alias("a"), F.col("rest").alias("p"), "n_source")
    up, levels = rounded(open_units, largest)
    up = up.select("key.*", "up").withColumnsRenamed({"doc_id": "i", "source": "s", "size": "z"})
    units = units.join(up, _equal("i", "s", "z"), "left")
    taken = lambda x: F.when(F.col("size") > 0, x).otherwise(F.lit(0).cast("long"))
    more = F.col("certain") + F.coalesce(F.col("up"), F.lit(False)).cast("long")
    out = stored(units.select("doc_id", "source", "size", "rows", "source_size", "target", taken(F.col("whole")).alias("whole"), taken(more).alias("more")), spark, "units")
    for d in (counted, per, *levels):
        discard(d)
    return out


def _repeated(df: DataFrame, times, *columns) -> DataFrame:
    """(columns, row): each row as often as ``times`` says, numbered from 1; REPEATS of one at most in one place."""
    df = df.withColumn("_times", times).where("_times > 0")
    blocks = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / REPEATS))).alias("_block"))
    if (df.agg(F.max("_times")).first()[0] or 0) > REPEATS:
        blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    row = F.sequence(F.col("_block") * REPEATS + 1, F.least(F.col("_times"), (F.col("_block") + 1) * REPEATS))
    return blocks.select(*columns, F.explode(row).alias("row"))


def allocate(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row."""
    out = _repeated(units_of(docs), F.col("rows"), "doc_id", "source", "size", "source_size", "target", "whole", "more")
    out = out.withColumn("copies", F.col("whole") + (F.col("row") <= F.col("more")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents, each repeated as often as the mix takes it; all columns with them."""
    spark = docs.sparkSession
    units = units_of(docs)
    wanted = units.where("whole > 0 or more > 0").select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "rows", "whole", "more")
    wanted = stored(wanted, spark, "mix")
    discard(units)
    held = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"))
    # Both sides grow with the data, so these joins are dealt and sorted at every size.
    single = held.join(wanted.where("rows = 1").hint("merge"), _equal("i", "s", "z")).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole") + F.col("more"))))
    taken = single.select("doc.*")
    if not wanted.where("rows > 1").isEmpty():
        # Equal rows are counted first; of a unit's different rows the ``more`` first in hash order are taken once more.
        several = held.join(wanted.where("rows > 1").hint("merge"), _equal("i", "s", "z")).withColumn("h", F.xxhash64(F.to_json("doc")))
        several = several.groupBy("i", "s", "z", "whole", "more", "h").agg(F.first("doc").alias("doc"), F.count("*").alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("i", "s", "z").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        times = F.col("c") * F.col("whole") + F.greatest(F.lit(0), F.least(F.col("c"), F.col("more") - F.col("before")))
        several = stored(several.withColumn("before", before).select("doc", times.alias("times")), spark, "several")
        taken = taken.union(_repeated(several, F.col("times"), "doc").select("doc.*"))
    return taken


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return allocate(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
