"""Filling missing values from similar records.

Functional dependencies are mined from the complete records: a candidate (a set of columns) determines a field if,
over all records whose determinant occurs more than once, the share that agrees reaches ``confidence``. The
dictionaries of the dependencies that hold, one row per determinant whose records agree, are joined to the records; what
is still missing takes the median of its group, from the narrowest group to the whole table. Each value carries where it came from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.relational import looked_up
from terravane.session import cut_lineage

CONFIDENCE = 0.98
SUPPORT = 20
GROUP_ROWS = 5


@dataclass(frozen=True)
class Dependency:
    determinant: tuple[str, ...]
    field: str
    support: int
    agreement: float
    keys: int


def _key(columns: tuple[str, ...]) -> str:
    return "+".join(columns)


def grouped(df: DataFrame, sets: list[tuple[str, ...]], *aggregates: Column) -> DataFrame:
    """The aggregates over several sets of key columns at once, from one scan and one exchange: the union of the sets'
    columns (null where a set has not the column), ``_set`` (number of the set) and the aggregates. Rows with a null in a
    set's own columns are left out of that set."""
    names = sorted({c for s in sets for c in s})
    out = df.groupingSets([[F.col(f"`{c}`") for c in s] for s in sets], *[F.col(f"`{c}`") for c in names]).agg(F.grouping_id().alias("_gid"), *aggregates)
    number = F.lit(None).cast("int")
    for i, s in enumerate(sets):
        bits = sum(1 << (len(names) - 1 - k) for k, c in enumerate(names) if c not in s)
        whole = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in s], F.lit(True))
        number = F.when((F.col("_gid") == bits) & whole, i).otherwise(number)
    return out.withColumn("_set", number).where("_set is not null").drop("_gid")


def dictionaries(df: DataFrame, fields: list[str], candidates: list[tuple[str, ...]]) -> DataFrame:
    """For each determinant of each candidate and each field: how many records have the field, its least and its largest
    value. Records with a null in the determinant or the field don't count."""
    return cut_lineage(grouped(df, candidates, *[f(c).alias(f"{n}_{c}") for c in fields for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]))


def mine_dependencies(known: DataFrame, fields: list[str], candidates: list[tuple[str, ...]], confidence: float = CONFIDENCE, support: int = SUPPORT, tolerance: float = 0.0) -> list[Dependency]:
    """Candidates that determine a field by their ``dictionaries``, best first: one row per candidate reaches the driver."""
    agree = lambda f: (F.col(f"n_{f}") > 1) & (F.col(f"hi_{f}") - F.col(f"lo_{f}") <= tolerance)
    rows = known.groupBy("_set").agg(
        F.count("*").alias("keys"),
        *[F.sum(F.when(F.col(f"n_{f}") > 1, F.col(f"n_{f}"))).alias(f"all_{f}") for f in fields],
        *[F.sum(F.when(agree(f), F.col(f"n_{f}"))).alias(f"ok_{f}") for f in fields],
    )
    found = []
    for row in rows.collect():
        for f in fields:
            n, ok = row[f"all_{f}"] or 0, row[f"ok_{f}"] or 0
            if n >= support and ok >= confidence * n:
                found.append(Dependency(candidates[row["_set"]], f, n, ok / n, row["keys"]))
    return sorted(found, key=lambda d: (-d.agreement, -d.support, len(d.determinant), d.determinant))


def fill_from_similar(
    df: DataFrame,
    fields: list[str],
    candidates: list[tuple[str, ...]],
    groups: list[tuple[str, ...]],
    confidence: float = CONFIDENCE,
    support: int = SUPPORT,
    group_rows: int = GROUP_ROWS,
    grain: float = 1e-3,
    tolerance: float = 0.0,
) -> DataFrame:
    """df with ``fields`` filled, and for each field f ``f_filled`` (boolean) and ``f_from`` (text).

    f_from is 'measured', 'same:<determinant>', 'group:<columns>', 'all', or null where no record has the field at all
    (the value stays null and f_filled false). Every row of df comes back once. Null determinants and null group
    columns match nothing, nor does a determinant whose own records break the dependency. A group counts from
    ``group_rows`` values on. Medians are exact over values rounded to ``grain``, which bounds what one group's aggregate
    holds by the field's range and not by the group's rows. df is written once; all candidates are mined from one scan of
    it and all groups from another, and only the records with a gap are joined to anything.
    """
    df = cut_lineage(df)
    known = dictionaries(df, fields, candidates) if candidates else None
    deps = mine_dependencies(known, fields, candidates, confidence, support, tolerance) if candidates else []
    median = lambda f: F.round(F.percentile(F.round(F.col(f) / grain) * grain, 0.5), 6)
    sets = [*groups, ()]
    # the rounded medians of sparse groups are dropped here; the whole table counts from one value on
    medians = grouped(df, sets, *[F.count(f).alias(f"n_{f}") for f in fields], *[median(f).alias(f"m_{f}") for f in fields])
    medians = cut_lineage(medians)
    size = {r["_set"]: r["count"] for r in medians.groupBy("_set").count().collect()}
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
    gaps = df.where(~whole)
    for c in dict.fromkeys(d.determinant for d in deps):
        own = [d for d in deps if d.determinant == c]
        fits = lambda f: F.when((F.col(f"n_{f}") > 0) & (F.col(f"hi_{f}") - F.col(f"lo_{f}") <= tolerance), F.col(f"lo_{f}"))
        gaps = looked_up(gaps, known.where(F.col("_set") == candidates.index(c)), c, own[0].keys, {f"_d_{_key(c)}_{d.field}": fits(d.field) for d in own})
    for i, g in enumerate(sets):
        least = group_rows if g else 1
        gaps = looked_up(gaps, medians.where(F.col("_set") == i), g, size.get(i, 0), {f"_g_{_key(g)}_{f}": F.when(F.col(f"n_{f}") >= least, F.col(f"m_{f}")) for f in fields})
    made = {*fields, *(f"{f}_filled" for f in fields), *(f"{f}_from" for f in fields)}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    filled = []
    for f in fields:
        sources = [("measured", F.col(f))]
        sources += [(f"same:{_key(d.determinant)}", F.col(f"`_d_{_key(d.determinant)}_{f}`")) for d in deps if d.field == f]
        sources += [(f"group:{_key(g)}" if g else "all", F.col(f"`_g_{_key(g)}_{f}`")) for g in sets]
        origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in sources])
        filled += [F.coalesce(*[c for _, c in sources]).alias(f), F.coalesce(origin != "measured", F.lit(False)).alias(f"{f}_filled"), origin.alias(f"{f}_from")]
    measured = [x for f in fields for x in (F.col(f), F.lit(False).alias(f"{f}_filled"), F.lit("measured").alias(f"{f}_from"))]
    return df.where(whole).select(*kept, *measured).unionByName(gaps.select(*kept, *filled))
