"""Keyed relational operators: first-of-key, differences, pages, unions, systematic samples, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions.estimation import number_or_null
from terravane.session import cut_lineage


#: Rows of a dictionary that is sent to all tasks, at most; its values are a few numbers a row.
BROADCAST_ROWS = 200_000


def looked_up(df: DataFrame, known: DataFrame, key: tuple[str, ...], rows: int, values: dict[str, Column], own: tuple[str, ...] | None = None) -> DataFrame:
    """df with the values of its key in ``known`` (its columns ``own`` if they are named otherwise), null where there is none. A dictionary of up to BROADCAST_ROWS rows is
    sent to the tasks; a larger one is joined by an exchange of both sides."""
    k = [f"_k{i}" for i in range(len(key))]
    small = known.select(*[F.col(f"`{x}`").alias(a) for x, a in zip(key, k)], *[c.alias(n) for n, c in values.items()])
    small = F.broadcast(small) if rows <= BROADCAST_ROWS else small
    on = [F.col(f"`{x}`") == F.col(a) for x, a in zip(own or key, k)] or [F.lit(True)]
    return df.join(small, on, "left").drop(*k)


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order; aggregated before the exchange, so a hot key costs nothing."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def missing(universe: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys of the universe that are not done; a null key is never done."""
    return universe.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on a key, with NaN as null on both sides; of columns that both have the left's stay."""
    right = right.drop(*[c for c in right.columns if c in left.columns and c != key])
    return number_columns(left).join(number_columns(right), key)


def number_columns(df: DataFrame) -> DataFrame:
    """df with NaN and infinities of its floating-point columns as null."""
    real = [c for c, k in df.dtypes if k in ("double", "float")]
    return df.withColumns({c: number_or_null(F.col(c)) for c in real}) if real else df


def union_first(parts: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """Union by name, missing columns null, then the first row of each key."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return keep_first(whole, key, order)


def numbered(df: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """df with a dense number from 0 in a total order, without one task seeing all rows.

    Rows are range-partitioned and sorted; the partitions' sizes (one row each) give each partition's offset."""
    part = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_i").alias("_f"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", "_f", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))
    return part.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_o") + F.col("_i") - F.col("_f")).drop("_part", "_i", "_o", "_f")


def top_rows(df: DataFrame, value: str, k: int, ties: list[Column | str], accuracy: int = 100_000) -> DataFrame:
    """The k rows with the largest ``value`` (a number), ties in the order ``ties``, which must be total; null counts last.

    A quantile sketch brackets the boundary: what lies above the bracket is taken whole, and only the rows inside it are
    put in order, by range partitions, so no task ever holds the k rows. df is read three times; cut its lineage before."""
    n = df.count()
    if k >= n:
        return df
    v = F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")))
    near = 2.0 / accuracy + 1 / n
    lo, hi = df.agg(F.percentile_approx(v, [max(0.0, 1 - k / n - near), min(1.0, 1 - k / n + near)], accuracy)).first()[0]
    sure = df.where(v > hi)
    left = k - sure.count()
    if left <= 0:  # the sketch missed; rank all rows
        sure, left, lo = df.where("false"), k, float("-inf")
    edge = df.where((v <= hi) & (v >= lo)) if lo != float("-inf") else df.where(v <= (hi if left < k else F.lit(float("inf"))))
    return sure.unionByName(numbered(edge, [v.desc(), *ties], "_k").where(F.col("_k") < left).drop("_k"))


def exact_percentiles(df: DataFrame, columns: dict[str, Column], p: float, few: int = 10_000, accuracy: int = 1_000) -> dict[str, float | None]:
    """The exact, linear percentile (p in 0 to 1) of each column over the rows where it is not null; None without any.

    Sketches narrow a bracket around the two order statistics until at most ``few`` rows or one value lie inside; these
    rows go to the driver. A pass reads all rows for all columns at once, and narrows by some hundred times; where a
    bracket narrows no more (many rows of few values), its values are counted instead."""
    names = [f"_p{i}" for i in range(len(columns))]
    rows = cut_lineage(df.select(*[c.cast("double").alias(a) for a, c in zip(names, columns.values())]))
    total = rows.agg(*[F.count(c).alias(c) for c in names], *[F.min(c).alias(f"l{c}") for c in names], *[F.max(c).alias(f"h{c}") for c in names]).first()
    at = {c: p * (total[c] - 1) for c in names}
    want = {c: (int(at[c]), min(int(at[c]) + 1, total[c] - 1)) for c in names}
    box = {c: (total[f"l{c}"], total[f"h{c}"], 0, total[c]) for c in names if total[c]}  # lowest, highest, rows below, rows inside
    inside = lambda c: (F.col(c) >= box[c][0]) & (F.col(c) <= box[c][1])
    wide = [c for c in box if box[c][3] > few]
    while wide:
        share = lambda c, k: min(1.0, max(0.0, (k - box[c][2]) / box[c][3]))
        cuts = rows.agg(*[F.percentile_approx(F.when(inside(c), F.col(c)), [max(0.0, share(c, want[c][0]) - 2 / accuracy), min(1.0, share(c, want[c][1] + 1) + 2 / accuracy)], accuracy).alias(c) for c in wide]).first()
        counts = rows.agg(*[F.count_if(F.col(c) < cuts[c][0]).alias(f"b{c}") for c in wide], *[F.count_if(F.col(c).between(*cuts[c])).alias(f"n{c}") for c in wide]).first()
        again = []
        for c in wide:
            below, n = counts[f"b{c}"], counts[f"n{c}"]
            if below <= want[c][0] and want[c][1] < below + n and n < box[c][3]:
                box[c] = (*cuts[c], below, n)
                if n > few and cuts[c][0] < cuts[c][1]:
                    again.append(c)
        wide = again
    one = [F.when(inside(c), F.struct(F.lit(c).alias("c"), F.col(c).alias("v"))) for c in box]
    values: dict[str, list] = {c: [] for c in box}
    if box:
        for r in rows.select(F.explode(F.array_compact(F.array(*one))).alias("e")).groupBy("e.c", "e.v").agg(F.count("*").alias("n")).collect():
            values[r["c"]].append((r["v"], r["n"]))
    out: dict[str, float | None] = {}
    for name, c in zip(columns, names):
        if c not in box:
            out[name] = None
            continue
        found, seen = [], box[c][2]
        for v, n in sorted(values[c]):
            found += [v for k in want[c] if seen <= k < seen + n]
            seen += n
        out[name] = found[0] + (at[c] - want[c][0]) * (found[-1] - found[0])
    return out


def percentiles_by_group(df: DataFrame, group: str, value: Column, wanted: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """``group`` and the exact, linear percentiles ``wanted`` (name: 0 to 1) of a value over the rows where it is not null.

    Per group and percentile a sketch brackets the two order statistics; what lies below is counted and only the values
    inside the bracket, some 4 / accuracy of the group, are put in order. A null group is a group; one without values has
    no row."""
    v = df.select(F.col(group).alias("_g"), value.cast("double").alias("_v")).where("_v is not null")
    near = 2 / accuracy
    ends = {n: F.percentile_approx("_v", [max(0.0, p - near), min(1.0, p + near)], accuracy) for n, p in wanted.items()}
    cuts = cut_lineage(v.groupBy("_g").agg(F.count("*").alias("_n"), *[e.alias(f"_e{i}") for i, e in enumerate(ends.values())]))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.col(f"_e{i}").alias("e")) for i, p in enumerate(wanted.values())])).alias("x")
    boxes = cuts.select("_g", "_n", each).select("_g", "x.i", (F.col("x.p") * (F.col("_n") - 1)).alias("at"), F.get("x.e", F.lit(0)).alias("lo"), F.greatest(F.get("x.e", F.lit(0)), F.get("x.e", F.lit(1))).alias("hi"))
    j = v.withColumnRenamed("_g", "_h").join(boxes, F.col("_h").eqNullSafe(F.col("_g")))
    # values below a bracket are one row a task and group with the largest, those above one with the smallest; those inside
    # are one row a value. The sketch's error is half the bracket's margin, so only the next value outside can be wanted.
    place = F.when(F.col("_v") < F.col("lo"), F.lit(None).cast("double")).when(F.col("_v") <= F.col("hi"), F.col("_v")).otherwise(F.lit(float("inf")))
    seen = j.groupBy("_g", "i", "at", place.alias("_k")).agg(F.count("*").alias("_c"), F.when(place.isNull(), F.max("_v")).otherwise(F.min("_v")).alias("_v"))
    w = Window.partitionBy("_g", "i").orderBy(F.col("_k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("_l", F.sum("_c").over(w))
    low = F.min(F.when(F.col("_l") > F.floor("at"), F.col("_v")))
    high = F.min(F.when(F.col("_l") > F.floor("at") + 1, F.col("_v")))
    found = seen.groupBy("_g", "i", "at").agg(low.alias("a"), F.coalesce(high, low).alias("b"))
    found = found.select(F.col("_g").alias(group), "i", (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("x"))
    return found.groupBy(group).agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(n) for i, n in enumerate(wanted)])


def pages(df: DataFrame, order: list[Column | str], size: int = 25_000) -> DataFrame:
    return numbered(df, order, "_k").withColumn("page", F.floor(F.col("_k") / size)).drop("_k")


def systematic(df: DataFrame, order: list[Column | str], target: int, start: int) -> DataFrame:
    """Every N/target-th row along an order, from row ``start`` on: the rows at which ceil(j * target / N) steps up.

    With more wanted than there are, all rows from ``start`` on stay."""
    n = df.count()
    if n == 0:
        return df
    f = target / n
    j = F.col("_k") - start + 1
    step = (F.ceil(j * f) != F.ceil((j - 1) * f)) if target < n else F.lit(True)
    return numbered(df, order, "_k").where((F.col("_k") >= start) & step).drop("_k")


def systematic_by_group(df: DataFrame, group: str, order: list[Column | str], target: int) -> DataFrame:
    """``target`` rows of each group, evenly along an order, all of a smaller group. Rows are numbered once over groups and
    order, and each group's first number and size (one row a group) turn that into its own: no task sorts a group."""
    d = numbered(df, [group, *order], "_k")
    d = cut_lineage(d)
    g = d.groupBy(F.col(group).alias("_k0")).agg(F.min("_k").alias("_f"), F.count("*").alias("_n"))
    d = looked_up(d, g, ("_k0",), g.count(), {"_f": F.col("_f"), "_n": F.col("_n")}, own=(group,))
    j, f = F.col("_k") - F.col("_f"), F.lit(float(target)) / F.col("_n")
    step = (F.col("_n") <= target) | (F.ceil((j + 1) * f) != F.ceil(j * f))
    return d.where(step).drop("_k", "_f", "_n")


def arithmetic_hash(c: Column, seed: int = 0) -> Column:
    """A pseudo-random order key that any SQL engine can repeat: below 2^32."""
    return F.pmod((F.pmod(c.cast("long"), F.lit(2**30)) + seed) * F.lit(2654435761), F.lit(4294967296))


def sample_per_group(df: DataFrame, group: str, id_: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group by hash of their id, all of a smaller group.

    Groups are split into salts first, each salt keeps its n best, so that no task sorts a hot group."""
    h = arithmetic_hash(F.col(id_), seed)
    d = df.withColumns({"_h": h, "_salt": F.pmod(F.xxhash64(id_), F.lit(64))})
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy("_h", id_))).where(F.col("_r") <= n)
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h", id_))).where(F.col("_r") <= n).drop("_h", "_salt", "_r")


def stratum_allocation(df: DataFrame, stratum: str, value: str, total: int) -> DataFrame:
    """Per stratum, numbered by rising mean: size, mean, deviation, Neyman and proportional shares of a total (cut off)."""
    g = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("Nh"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("SD"))
    g = g.withColumn("div", F.col("Nh") * F.col("SD"))
    w = Window.orderBy("mean", "_s")  # one row per stratum
    all_ = Window.partitionBy(F.lit(1))
    return g.select(
        F.row_number().over(w).alias("stratum"), "Nh", "mean", "SD",
        F.floor(F.try_divide(total * F.col("div"), F.sum("div").over(all_))).alias("neyman"),
        F.floor(total * F.col("Nh") / F.sum("Nh").over(all_)).alias("proportional"),
    )


def stratum_bounds(df: DataFrame, stratum: str, value: str) -> DataFrame:
    """Upper bound of each stratum but the last, by rising bound."""
    g = df.groupBy(stratum).agg(F.max(value).alias("bound"))
    w = Window.orderBy("bound", stratum)
    return g.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(F.lit(1)))}).where("k < n").select("k", "bound")
