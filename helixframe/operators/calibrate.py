"""Statistics of libraries and coverage: orders and cumulative windows, all exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.params import ORIENTATION_PAIRS, ORIENTATION_SHARE


def mate_distances(placements: DataFrame) -> DataFrame:
    """lib_id, node_id, orientation, distance of each forward read (even read_id) and a mate placed on the same node.

    A mate on the same strand is orientation 1, from both of them, with the
    wider of the two spans. A mate on the other strand is 2 where the read
    begins and ends before it, 3 where it begins and ends before the read;
    one inside the other is neither.
    """
    a = placements.where("read_id % 2 = 0").select("lib_id", "node_id", F.explode(F.array(*(F.struct(F.col("read_id").bitwiseXOR(F.lit(x)).alias("read_id"), F.lit(x == 2).alias("same")) for x in (2, 3)))).alias("m"), F.col("start").alias("a0"), F.col("end").alias("a1"))
    b = placements.select("node_id", "read_id", F.col("start").alias("b0"), F.col("end").alias("b1"))
    joined = a.select("lib_id", "node_id", "m.*", "a0", "a1").join(b, ["node_id", "read_id"])
    kind = F.when(F.col("same"), 1).when(F.expr("a0 < b0 and a1 < b1"), 2).when(F.expr("b0 < a0 and b1 < a1"), 3)
    distance = F.when(F.col("same"), F.expr("greatest(abs(a0 - b1), abs(a1 - b0))")).when(F.col("a0") < F.col("b0"), F.expr("abs(a0 - b1)")).otherwise(F.expr("abs(b0 - a1)"))
    return joined.select("lib_id", "node_id", kind.alias("orientation"), distance.cast("long").alias("distance")).where("orientation is not null")


def orientation_counts(distances: DataFrame) -> DataFrame:
    """Pairs and summed distances per library and orientation, and the orientation that the library has.

    An orientation is called when more than ORIENTATION_SHARE of at least
    ORIENTATION_PAIRS pairs have it, else it is 0.
    """
    per = distances.groupBy("lib_id").agg(
        *(F.count_if(F.col("orientation") == o).alias(f"n_{name}") for o, name in ((1, "ff"), (2, "fr"), (3, "rf"))),
        *(F.sum(F.when(F.col("orientation") == o, F.col("distance")).otherwise(0)).alias(f"sum_{name}") for o, name in ((1, "ff"), (2, "fr"), (3, "rf"))),
    )
    total = F.col("n_ff") + F.col("n_fr") + F.col("n_rf")
    called = F.when(total < ORIENTATION_PAIRS, 0)
    for o, name in ((1, "ff"), (2, "fr"), (3, "rf")):
        called = called.when(F.col(f"n_{name}") > ORIENTATION_SHARE * total, o)
    return per.withColumn("orientation", called.otherwise(0))


def _ranked(values: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values per key with the number of rows up to and under each; ties are one row, so a key with few values stays small."""
    counts = values.groupBy(key, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(key)))


def at_rank(values: DataFrame, key: str, value: str, rank: Column) -> DataFrame:
    """key, the value at a 0-based rank (an expression of n) among the sorted rows."""
    return _ranked(values, key, value).where(F.col("upto") > rank).groupBy(key).agg(F.min(value).alias(value))


def upper_median(values: DataFrame, key: str, value: str) -> DataFrame:
    return at_rank(values, key, value, F.floor(F.col("n") / 2))


def tails(values: DataFrame, key: str, value: str, permille: int = 25) -> DataFrame:
    """Values at the lower and upper tail of permille / 1000 of the rows."""
    ranked = _ranked(values, key, value)
    cut = F.floor(F.col("n") * permille / 1000)
    low = F.min(F.when(F.col("upto") > cut, F.col(value)))
    high = F.min(F.when(F.col("upto") > F.col("n") - 1 - cut, F.col(value)))
    return ranked.groupBy(key).agg(low.alias("low"), high.alias("high"))


def library_sizes(distances: DataFrame, loci: DataFrame, read_length: int) -> DataFrame:
    """(lib_id, orientation, size, min_distance, max_distance) from distances (lib_id, node_id, orientation, distance) and loci (node_id, len).

    The orientation is the one with the largest sum of what its distances
    have beyond a read; without a single largest the library is left out. The
    size is the mean of the loci's upper medians, weighted by their pairs,
    over loci of at least 1.5 of the largest median or the longest of all.
    The limits come from the n / 40 (one at least) smallest and largest
    distances of every locus, taken together.
    """
    beyond = F.sum(F.col("distance") - F.least("distance", F.lit(read_length)))
    sums = distances.groupBy("lib_id", "orientation").agg(beyond.alias("s"), F.count("*").alias("total"))
    best = sums.withColumn("top", F.max("s").over(Window.partitionBy("lib_id"))).withColumn("others", F.sum(F.col("s")).over(Window.partitionBy("lib_id")) - F.col("s"))
    best = best.withColumn("n_top", F.count_if(F.col("s") == F.col("top")).over(Window.partitionBy("lib_id"))).where("s = top and n_top = 1 and s > 0")
    best = best.select("lib_id", "orientation", F.expr("greatest(1, total div 40)").alias("cut"))
    own = distances.join(best, ["lib_id", "orientation"])
    place = Window.partitionBy("lib_id", "node_id")
    own = own.withColumn("i", F.row_number().over(place.orderBy("distance")) - 1).withColumn("n", F.count("*").over(place))
    per = own.where("i = n div 2").join(loci.select("node_id", "len"), "node_id").select("lib_id", "n", "len", F.col("distance").alias("median"))
    limit = loci.select("node_id", "len").join(distances.select("lib_id", "node_id").distinct(), "node_id").groupBy("lib_id").agg(F.max("len").alias("longest"))
    limit = per.groupBy("lib_id").agg(F.max("median").alias("m")).join(limit, "lib_id").select("lib_id", F.least("longest", F.floor(F.col("m") * 1.5)).alias("least"))
    size = per.join(limit, "lib_id").where("len >= least").groupBy("lib_id").agg(F.floor(F.sum(F.col("n") * F.col("median")) / F.sum("n")).alias("size"))
    every = Window.partitionBy("lib_id")
    low = own.where("i < cut").select("lib_id", "distance", "cut").withColumn("j", F.row_number().over(every.orderBy("distance")) - 1).withColumn("c", F.count("*").over(every)).where("j = least(c - 1, cut * 2)").select("lib_id", F.col("distance").alias("low"))
    high = own.where("i >= n - cut").select("lib_id", "distance", "cut").withColumn("j", F.row_number().over(every.orderBy("distance")) - 1).withColumn("c", F.count("*").over(every)).where("j = greatest(0, c - cut)").select("lib_id", F.col("distance").alias("high"))
    joined = best.join(size, "lib_id").join(low, "lib_id").join(high, "lib_id")
    return joined.select("lib_id", "orientation", "size", F.floor(F.least("size", "low") * 0.8).alias("min_distance"), F.floor(F.greatest("size", "high") * 1.2).alias("max_distance"))


def weighted_point(rows: DataFrame, value: str, weight: str, share: float) -> DataFrame:
    """The first value, ascending, at which the cumulative weight passes share of the total, cut to a whole number. Equal values are one row."""
    per = rows.groupBy(value).agg(F.sum(weight).alias("w"))
    upto = F.sum("w").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("upto", upto).withColumn("total", F.sum("w").over(Window.partitionBy())).where(F.col("upto") > F.floor(F.col("total") * share)).agg(F.min(value).alias(value))


def weighted_mean_top(rows: DataFrame, value: str, weight: str, share: float = 0.75) -> DataFrame:
    """Weighted mean of the rows in descending order of value, then weight, down to and with the one at which the cumulative weight passes share of the total, cut to a whole number.

    Equal rows are counted together, and of the last of them only as many
    count as are needed.
    """
    per = rows.where(F.col(weight) > 0).groupBy(F.col(value).alias("__v"), F.col(weight).alias("__w")).agg(F.count("*").alias("__c"))
    own = F.col("__w") * F.col("__c")
    order = Window.orderBy(F.desc("__v"), F.desc("__w")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum(own).over(order), F.lit(0))).withColumn("cut", F.floor(F.sum(own).over(Window.partitionBy()) * share))
    taken = F.least("__c", F.floor((F.col("cut") - F.col("before")) / F.col("__w")) + 1) * F.col("__w")
    kept = per.where(F.col("before") <= F.col("cut")).withColumn("taken", taken)
    return kept.agg((F.sum(F.col("__v") * F.col("taken")) / F.sum("taken")).alias("mean"))


def n50(lengths: DataFrame, value: str, ascending: bool) -> DataFrame:
    """The length at which the cumulative sum reaches half of the total: from the longest down, or as the assembler reports it from the shortest up, against the whole part of the half."""
    per = lengths.groupBy(value).agg(F.sum(value).alias("w"))
    order = F.col(value) if ascending else F.desc(value)
    upto = F.sum("w").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("w").over(Window.partitionBy())
    hit = per.withColumn("upto", upto).withColumn("half", F.floor(total / 2) if ascending else total / 2).where(F.col("upto") >= F.col("half"))
    return hit.agg((F.min if ascending else F.max)(value).alias("n50"))
