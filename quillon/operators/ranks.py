"""Order statistics by selection: values at given places of an order, found by counting, without a sort of all rows or of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.scratch import written

c = F.col
#: Parts that a range is counted in, and rows that are few enough to be listed.
STEP = 4096


def exact_ranks(rows: DataFrame, by: str, places: list[int], step: int = STEP) -> list[float]:
    """The values of `by` at the given 0-based places of its order, exact at any size and without an order over all rows.

    Each round counts the rows in `step` equal parts of every range that still holds a wanted place, and goes on with
    the part it lies in, until a part's values are equal, or so few that they can be listed.
    """
    found: dict[int, float] = {}
    first = rows.agg(F.min(by).alias("low"), F.max(by).alias("high")).first()
    ranges = {place: (first["low"], first["high"], place) for place in places}  # least, greatest, place within
    while ranges:
        wanted = sorted({(a, b) for a, b, _ in ranges.values()})
        cells = []
        for i, (low, high) in enumerate(wanted):
            width = (high - low) / step
            part = F.least(F.floor((c(by) - low) / width), F.lit(step - 1)).cast("int") if width > 0 else F.lit(0)
            cells.append(F.when(c(by).between(low, high), F.struct(F.lit(i).alias("i"), part.alias("part"))))
        counted = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("cell"), by).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("low"), F.max(by).alias("high"))
        parts: dict[int, list] = {}
        for r in counted.collect():  # `step` rows a range
            parts.setdefault(r["cell"]["i"], []).append((r["cell"]["part"], r["n"], r["low"], r["high"]))
        later = {}
        for place, (low, high, within) in ranges.items():
            for _, n, a, b in sorted(parts[wanted.index((low, high))]):
                if within < n:
                    break
                within -= n
            if a == b:
                found[place] = a
            elif n <= step:
                found[place] = sorted(r[0] for r in rows.where(c(by).between(a, b)).select(by).collect())[within]
            else:
                later[place] = (a, b, within)
        ranges = later
    return [found[place] for place in places]


def key_ranks(rows: DataFrame, keys: tuple[str, ...], by: str, places: dict[str, Column], step: int = STEP) -> DataFrame:
    """One row per key: the values of `by` at 0-based places, which are expressions of `n`, the key's rows.

    A key starts with the range of all its values. Each round counts the rows of every range that holds more than `step`
    rows in `step` equal parts, summed where they are read before they travel, and goes on with the part that the place
    lies in; ranges of equal values are done, and what is left of the others is listed, at most `step` values each. So
    no key is sorted in one task, however large. Null values count for nothing; null keys are keys; values must be
    finite.
    """
    known = rows.where(c(by).isNotNull()).select(*keys, c(by).cast("double").alias("_v"))
    bounds = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), x.cast("long").alias("within")) for k, x in places.items()])).alias("e")
    state = written(bounds.select(*keys, "n", "low", "high", each).select(*keys, "e.rank", "n", "low", "high", "e.within"), "ranks")
    ready, names = [], list(keys)
    same = lambda: [c(k).eqNullSafe(c(f"_{k}")) for k in keys]

    def met(ranges: DataFrame) -> DataFrame:
        """Rows inside the ranges of their key; each key has as many ranges as places."""
        renamed = ranges.withColumnsRenamed({k: f"_{k}" for k in keys})
        on = [*same(), c("_v").between(c("low"), c("high"))]
        many = renamed.count()
        return known.join(F.broadcast(renamed) if many <= 100_000 else renamed.hint("merge"), on)

    while True:
        ready.append(state.where("low = high").select(*names, "rank", c("low").alias("value")))
        few = (c("n") <= step) & (c("low") < c("high"))
        small = state.where(few)
        if not small.isEmpty():
            listed = met(small).groupBy(*names, "rank").agg(F.sort_array(F.collect_list("_v")).alias("vs"), F.max("within").alias("within"))
            ready.append(listed.select(*names, "rank", F.get("vs", c("within").cast("int")).alias("value")))
        state = state.where((c("n") > step) & (c("low") < c("high")))
        if state.isEmpty():
            break
        width = (c("high") - c("low")) / step
        part = F.when(width > 0, F.least(F.floor((c("_v") - c("low")) / width), F.lit(step - 1).cast("long"))).otherwise(F.lit(0).cast("long"))
        cells = met(state).groupBy(*names, "rank", "within", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        w = Window.partitionBy(*names, "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # `step` rows at most
        cells = cells.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        inside = (c("before") <= c("within")) & (c("within") < c("before") + c("n"))
        state = written(cells.where(inside).select(*names, "rank", "n", "low", "high", (c("within") - c("before")).alias("within")), "ranks")
    found = ready[0]
    for x in ready[1:]:
        found = found.unionByName(x)
    return found.groupBy(*names).agg(*[F.max(F.when(c("rank") == k, c("value"))).alias(k) for k in places])


def numbered(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str = "t") -> DataFrame:
    """rows with row_number() over the keys by `order`, in `name`, without bringing a key's rows into one task.

    A block holds the rows of one key and one value of the first column of the order (dates, say); rows are numbered
    inside their block, and a row of its own carries into each block the count of the rows before it. Rows travel once.
    Nulls are values, and first.
    """
    block, c = (*keys, order[0]), F.col
    counts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    heads = counts.select(*block, F.coalesce(before, F.lit(0)).alias("_before"))
    every = rows.withColumn("_before", F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)
    inside = Window.partitionBy(*block).orderBy(c("_before").isNull(), *order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    # the head is the first row of its block
    placed = every.withColumns({name: F.first("_before").over(inside) + F.row_number().over(inside) - 1})
    return placed.where("_before is null").drop("_before")
