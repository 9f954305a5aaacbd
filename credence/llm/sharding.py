"""Sharding along a Hilbert curve, in DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, the cell's index on
the Hilbert curve is computed, rows are sorted by it and the sorted rows are cut
into runs whose counts differ by one at most. Rows near each other in all
dimensions share a shard, so the minima and maxima per file prune well for
filters on any of them.

Defined cases: a null text has size 8 and the checksum of no bytes; null metadata
lies in cell 0; ties (equal cells, repeated rows) are ordered by row and split
over shards like any other rows; an empty table gives no rows; further columns
are kept by ``curve_shards`` and ignored by ``assign``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.llm.common import drop_materialised, materialise, parts

BITS = 5


def number_of(col: Column, kind: str) -> Column:
    """A number, or a string as it is, in the order of the values."""
    if kind == "string":
        return col
    if kind in ("timestamp", "date"):
        return F.unix_timestamp(col).cast("double")
    return col.cast("double")


def string_edges(df: DataFrame, name: str, cells: int) -> list[str]:
    """The values at which equal counts of rows are cut, over the whole strings; at most ``cells - 1``.

    Rows are counted per value before the values are sorted; the running count is one
    per partition plus the counts of the partitions before it.
    """
    counts = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    dealt = counts.repartitionByRange(parts(df.sparkSession), name).withColumn("part", F.spark_partition_id())
    kept = materialise(dealt, "values")
    sums = kept.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("start"), F.sum("part_n").over(Window.partitionBy(F.lit(0))).alias("total"))
    within = Window.partitionBy("part").orderBy(name)
    placed = kept.join(F.broadcast(starts), "part").withColumn("upto", F.col("start") + F.sum("n").over(within))  # one row per partition
    share = lambda x: F.floor((x) * cells / F.col("total"))
    cuts = placed.filter(share(F.col("upto")) > share(F.col("upto") - F.col("n"))).select(name).orderBy(name).limit(cells).collect()
    drop_materialised(kept)
    return [r[0] for r in cuts][: cells - 1]


def quantised(numbers: list[Column], edges: list[list], bits: int) -> list[Column]:
    """The cell of each number between the edges of its dimension, nulls in cell 0."""

    def cell(x: Column, cuts: list) -> Column:
        if not cuts:
            return F.lit(0)
        inner = F.array(*[F.lit(c) for c in cuts])
        return F.coalesce(F.least(F.size(F.filter(inner, lambda c: c < x)), F.lit((1 << bits) - 1)), F.lit(0))

    return [cell(x, cuts) for x, cuts in zip(numbers, edges, strict=True)]


def hilbert_index(cells: Column, dims: int, bits: int) -> Column:
    """Index on the Hilbert curve of an array of cell numbers.

    The cell's coordinates are turned into the transposed index: from the highest bit
    down, each coordinate with the bit set flips the lower bits of the first one, else
    exchanges them with it; a Gray code over the coordinates follows.
    """

    def put(a: Column, i: Column, v: Column) -> Column:
        return F.transform(a, lambda x, j: F.when(j == i, v).otherwise(x))

    def step(a: Column, s: Column) -> Column:
        q = F.pow(F.lit(2), F.lit(bits - 1) - F.floor(s / dims)).cast("int")
        i = (s % dims).cast("int")
        low, head, own = q - 1, F.get(a, F.lit(0)), F.get(a, i)
        t = head.bitwiseXOR(own).bitwiseAND(low)
        return (
            F.when(own.bitwiseAND(q) != 0, put(a, F.lit(0), head.bitwiseXOR(low)))
            .when(i == 0, a)
            .otherwise(put(put(a, F.lit(0), head.bitwiseXOR(t)), i, own.bitwiseXOR(t)))
        )

    def gray_code(turned: Column) -> Column:
        return F.aggregate(turned, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(x.bitwiseXOR(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))))))

    def flip_of(gray: Column) -> Column:
        last = F.element_at(gray, -1)
        power = lambda b: F.pow(F.lit(2), b).cast("int")
        return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), F.lit(0), lambda t, b: F.when(last.bitwiseAND(power(b)) != 0, t.bitwiseXOR(power(b) - 1)).otherwise(t))

    def interleaved(coords: Column) -> Column:
        order = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
        return F.aggregate(order, F.lit(0).cast("long"), lambda acc, b: F.aggregate(coords, acc, lambda h, x: h * 2 + F.floor(x / F.pow(F.lit(2), b)).cast("long") % 2))

    steps = F.sequence(F.lit(0), F.lit((bits - 1) * dims - 1))
    turned = F.aggregate(steps, cells.cast("array<int>"), step)
    gray = let(turned, gray_code)
    coords = let(gray, lambda g: let(flip_of(g), lambda t: F.transform(g, lambda x: x.bitwiseXOR(t))))
    return let(coords, interleaved)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def with_curve(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Add ``__curve``: the Hilbert index over equal-count cells of the named columns."""
    kinds = dict(df.dtypes)
    numbers = [number_of(F.col(f"`{d}`"), kinds[d]) for d in dims]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    measured = [i for i, d in enumerate(dims) if kinds[d] != "string"]
    cuts = df.agg(F.count("*"), *[F.percentile_approx(numbers[i], shares, 10_000).alias(f"c{i}") for i in measured]).first()
    edges: list[list] = [[] for _ in dims]  # at most 2**bits - 1 values per dimension
    for i, d in enumerate(dims):
        edges[i] = sorted(set(map(float, cuts[f"c{i}"] or []))) if i in measured else string_edges(df.select(F.col(f"`{d}`").alias("value")), "value", 1 << bits)
    cells = F.array(*quantised(numbers, edges, bits))
    return df.withColumn("__cells", cells).withColumn("__curve", hilbert_index(F.col("__cells"), len(dims), bits)).drop("__cells")


def cut_runs(df: DataFrame, order: list[str], n_shards: int) -> DataFrame:
    """Sort by ``order`` and cut into ``n_shards`` runs of equal count: adds shard (int) and slot (long, from 0).

    The sorted rows are written once; row numbers are then counts per partition plus
    the position inside, so no single task sees all rows.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    kept = materialise(dealt, "curve")
    counts = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__total"))
    ranked = kept.join(F.broadcast(starts), "__part").withColumn("__rank", F.col("__start") + F.col("__pos"))  # one row per partition
    # run s holds the ranks from ceil(s * total / n) on
    shard = F.expr(f"(__rank * {n_shards}) div __total")
    first = F.expr(f"((__shard * __total) + {n_shards - 1}) div {n_shards}")
    out = ranked.withColumn("__shard", shard).withColumn("slot", (F.col("__rank") - first).cast("long")).withColumn("shard", F.col("__shard").cast("int"))
    return out.drop("__part", "__pos", "__start", "__total", "__rank", "__shard")


def assign(docs: DataFrame, n_shards: int, dims: list[str], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Shard of every document: the id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve.

    The text is read once; only these columns and the dimensions are written and travel.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    size = (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 8).cast("long")
    kinds = dict(docs.dtypes)
    keys = [number_of(size if d == "__size" else F.col(f"`{d}`"), "long" if d == "__size" else kinds[d]).alias(f"__d{i}") for i, d in enumerate(dims)]
    narrow = materialise(docs.select(F.col(id_col), size.alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("__row"), *keys), "narrow")
    curved = with_curve(narrow, [f"__d{i}" for i in range(len(dims))], bits).drop(*[f"__d{i}" for i in range(len(dims))])
    cut = cut_runs(curved, ["__curve", "text_crc32", "__row"], n_shards)
    return cut.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("__curve").alias("curve"))


def curve_shards(df: DataFrame, n_shards: int, dims: list[str], bits: int = BITS) -> DataFrame:
    """Whole rows with ``shard`` and ``slot``, ready for ``write.partitionBy('shard')``."""
    row = materialise(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    return cut_runs(with_curve(row, dims, bits), ["__curve", "__row"], n_shards).drop("__curve", "__row")


def pruning_stats(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Minimum and maximum of each dimension per shard: what a reader prunes by."""
    return sharded.groupBy("shard").agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n_rows"))
