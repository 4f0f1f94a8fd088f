"""Work along a total order without putting the rows in one partition.

The rows are cut into chunks along the order, the work is done inside each
chunk, and a small table with one row per chunk carries the result from one
chunk to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.session import fresh_dir

# monotonically_increasing_id keeps the partition in the upper bits and the
# row's place in the lower 33 ones.
PLACE_BITS = 33


def sorted_chunks(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """The rows with ``_chunk`` and ``_place`` columns following ``order_by``.

    The rows are range-partitioned, sorted and written once to the shared
    folder, so the chunk borders stay the same however often they are read and
    whichever executor is lost. ``order_by`` should be unique: equal values
    cannot be separated by a range border. :func:`forget` removes the sort
    when nothing reads it any more.
    """
    path = fresh_dir(df.sparkSession, "sorted")
    row = F.monotonically_increasing_id()
    df.sort(*order_by).withColumn("_row", row).write.parquet(path)
    written = df.sparkSession.read.parquet(path)
    rows = written.select(
        *df.columns,
        F.shiftright("_row", PLACE_BITS).alias("_chunk"),
        F.col("_row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place"),
    )
    rows.stored_at = path
    return rows


def forget(rows: DataFrame) -> None:
    """Remove the sort behind a result of :func:`sorted_chunks`, :func:`numbered` or :func:`assign_ids`."""
    path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(rows.stored_at)
    path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, order_by: list[str | Column], start: int = 1) -> tuple[DataFrame, int]:
    """The rows with dense ids ``start, start+1, …`` in ``order_by`` order, and how many there are."""
    rows = sorted_chunks(df, order_by)
    # One number per sort partition comes to the driver: bounded by the
    # partition count, not by the data.
    sizes = rows.groupBy("_chunk").agg(F.count(F.lit(1))).orderBy("_chunk").collect()
    firsts, used = [], 0
    for chunk, size in sizes:
        firsts.append(f"({chunk}L, {start + used}L)")
        used += size
    if firsts:
        offsets = df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(firsts)} AS offsets(_chunk, _first)")
        ids = (F.col("_first") + F.col("_place")).alias(name)
        out = rows.join(F.broadcast(offsets), "_chunk").select(*df.columns, ids)
    else:
        out = rows.select(*df.columns, F.lit(None).cast("bigint").alias(name))
    out.stored_at = rows.stored_at
    return out, used


def assign_ids(df: DataFrame, name: str, order_by: list[str | Column], start: int = 1) -> DataFrame:
    """Dense ids ``start, start+1, …`` in ``order_by`` order, as column ``name``."""
    return numbered(df, name, order_by, start)[0]


def next_id(df: DataFrame, id_col: str) -> int:
    """The id after the greatest one in use; 1 for an empty table."""
    return (df.agg(F.max(id_col)).first()[0] or 0) + 1


def assign_cyclic(df: DataFrame, n: str, pool: DataFrame, pool_id: str, name: str) -> DataFrame:
    """Give each row the pool id at position ``(n - 1) mod pool size``.

    An empty pool gives no rows. The pool is numbered along its ids and joined
    on the position, so it may be of any size; a small one is broadcast by
    Spark's own size check.
    """
    places, size = numbered(pool.select(F.col(pool_id).alias(name)), "_position", [name], start=0)
    placed = df.withColumn("_position", F.pmod(F.col(n) - 1, F.lit(max(size, 1))))
    return placed.join(places, "_position").select(*df.columns, name)


def assign_by_bounds(df: DataFrame, n: str, pool: DataFrame, pool_id: str, name: str) -> DataFrame:
    """Give each row the id ``least id + (n - 1) mod pool size``, for a pool with gapless ids.

    An empty pool gives no rows.
    """
    bounds = pool.agg(F.min(pool_id).alias("_least"), F.count(F.lit(1)).alias("_size")).where("_size > 0")
    place = F.pmod(F.col(n) - 1, F.col("_size"))
    return df.crossJoin(F.broadcast(bounds)).select(*df.columns, (F.col("_least") + place).alias(name))


def previous_value(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    chunk: Column,
    name: str,
    start: DataFrame | None = None,
) -> DataFrame:
    """``value`` of the preceding row of the same key, along ``order``.

    ``chunk`` is a number that never falls along ``order`` and holds a limited
    number of rows per key, for example ``order div 1000000``. Only one key's
    rows of one chunk meet in a task, and one row per chunk carries the last
    value onward. ``start`` (keys and ``value``) gives the value before a key's
    first row; keys missing there are left out.
    """
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    rows = df.withColumn("_chunk", chunk)
    marked = rows.withColumn("_before", F.lag(value).over(inside)).withColumn(
        "_head", F.row_number().over(inside) == 1
    )
    ends = rows.groupBy(*keys, "_chunk").agg(F.max_by(value, order).alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))
    if start is not None:
        ends = ends.join(start.select(*keys, F.col(value).alias("_start")), keys)
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("_chunk")) == 1
        carried = F.when(first, F.col("_start")).otherwise(carried)
    ends = ends.select(*keys, "_chunk", carried.alias("_carried"))
    joined = marked.join(ends, [*keys, "_chunk"])
    before = F.when(F.col("_head"), F.col("_carried")).otherwise(F.col("_before"))
    return joined.select(*df.columns, before.alias(name))


# How exact the sketch is that proposes where to cut the values of a group around a wanted place, and how far
# from the place, as a share of all rows. Both decide how many values are sorted, never the result.
ACCURACY = 10_000
MARGIN = 0.0005


def in_steps(
    rows: DataFrame, counts: DataFrame, by: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """``counts`` with the ``_step`` of each value: steps end a little before and after every wanted place.

    A place lies in a step of few values, however the values are spread, unless the sketch is wrong.
    """
    near = sorted({min(max(p + side, 0.0), 1.0) for p in probabilities.values() for side in (-MARGIN, MARGIN)})
    edges = rows.groupBy(*by).agg(F.percentile_approx(value, near, ACCURACY).alias("_edges"))
    known = counts.join(edges, by) if by else counts.crossJoin(F.broadcast(edges))  # without groups a single row
    step = F.size(F.filter("_edges", lambda edge: edge <= F.col("_value")))
    return known.select(*counts.columns, step.alias("_step"))


def wanted_steps(counts: DataFrame, by: list[str], probabilities: dict[str, float]) -> DataFrame:
    """The steps that hold a wanted place, with the number of rows before them and of all rows of the group."""
    steps = counts.groupBy(*by, "_step").agg(F.sum("_n").alias("_in_step"))
    steps = steps.withColumns(
        {
            "_end": F.sum("_in_step").over(Window.partitionBy(*by).orderBy("_step")),
            "_total": F.sum("_in_step").over(Window.partitionBy(*by)),
        }
    )
    begin = F.col("_end") - F.col("_in_step")
    places = places_of(F.col("_total"), probabilities).values()
    ends = F.array(*[f(p).cast("bigint") for p in places for f in (F.floor, F.ceil)])
    held = F.exists(ends, lambda k: (k >= begin) & (k < F.col("_end")))
    return steps.where(held).select(*by, "_step", "_total", begin.alias("_before"))


def places_of(total: Column, probabilities: dict[str, float]) -> dict[str, Column]:
    return {name: (total - 1) * F.lit(p) for name, p in probabilities.items()}


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles per group, linearly interpolated between neighbours.

    ``probabilities`` maps output names to fractions. Values are first reduced
    to distinct ones with their counts. Counting them by :func:`in_steps`
    finds the steps that hold the wanted places, and only those are sorted.
    No group is gathered whole.
    """
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    counts = in_steps(rows, counts, by, value, probabilities)
    inner = Window.partitionBy(*by, "_step").orderBy("_value")
    ranked = (
        counts.join(wanted_steps(counts, by, probabilities), [*by, "_step"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inner))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    )
    position = places_of(F.col("_total"), probabilities)

    def at(k: Column) -> Column:
        return F.max(F.when((k >= F.col("_begin")) & (k < F.col("_end")), F.col("_value")))

    picked = ranked.groupBy(*by, "_total").agg(
        *[at(F.floor(p)).alias(f"_{n}_low") for n, p in position.items()],
        *[at(F.ceil(p)).alias(f"_{n}_high") for n, p in position.items()],
    )
    outputs = [
        (
            F.col(f"_{n}_low")
            + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * (p - F.floor(p)).cast("double")
        ).alias(n)
        for n, p in position.items()
    ]
    return picked.select(*by, *outputs)
