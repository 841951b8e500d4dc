"""Ordered scans, joins, ranks and quantiles that stay parallel when a key is hot.

A plain ``Window.partitionBy(user)`` puts a user's whole history in one task. Here
keys above a share of all rows are cut into time chunks of about equal size, the
window runs per (key, chunk), and the little state that crosses a chunk border
(the last row, the running total) is carried over from one row per chunk.

Bounds on what is broadcast: a key counts as hot only when it holds more than
``HOT_SHARE`` of all rows, so there are at most ``1 / HOT_SHARE`` hot keys whatever
the data size, and at most a few times as many chunks in total. The number of chunks
of a key follows its rows, so a chunk stays near the limit however hot the key is;
only rows of one and the same time are never parted. Data without hot keys pays one
count per key and nothing else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowvigil.session import shared_dir

HOT_SHARE = 1 / 131072
HOT_MIN_ROWS = 500_000
CUTS = 4096  # cuts that one sketch makes; a chunk that is still too large is cut again
HALVINGS = 20  # chunks are found by halving, which does for 2**20 - 1 cuts of a key


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _position(df: DataFrame, column: str) -> Column:
    """A number that orders like ``column`` (timestamps in microseconds)."""
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join where a null key matches a null key; the right copy of the keys is dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for k in keys:
        match = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = match if condition is None else condition & match
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def key_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest key, all rows)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    row = counts.agg(F.max("_n"), F.sum("_n")).first()
    return row[0] or 0, row[1] or 0


def find_hot(df: DataFrame, keys: Sequence[str], at: str | None = None, min_rows: int | None = None,
             share: float | None = None, sizes: tuple[int, int] | None = None) -> DataFrame | None:
    """(keys, _bounds) of the hot keys, or None when there are none.

    A key is hot when it holds more than ``share`` of all rows and ``min_rows``;
    ``_bounds`` are positions of ``at`` that cut its rows into chunks of equal size
    (left out when ``at`` is). ``sizes`` takes ``key_sizes`` when already known.
    One count per key always runs; sketches of ``at`` only for keys found hot. The
    result (1 / share keys at most) is held by the driver, so that the callers can
    share it and leave all extra work out when it is None.
    """
    min_rows = HOT_MIN_ROWS if min_rows is None else min_rows
    share = HOT_SHARE if share is None else share
    largest, total = key_sizes(df, keys) if sizes is None else sizes
    limit = max(float(min_rows), total * share)
    if largest <= limit:
        return None
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = counts.withColumn("_limit", F.lit(limit)).where(F.col("_n") > F.col("_limit"))
    rows = hot.collect()
    spark = df.sparkSession
    hot = spark.createDataFrame(rows, hot.schema)
    if at is None:
        return hot.select(*keys)
    hot_rows = null_safe_join(df.select(*keys, _position(df, at).alias("_pos")),
                              F.broadcast(hot.select(*keys)), keys, "inner")
    spread = spark.createDataFrame(_cut(hot_rows, keys, limit).collect(), _cut_schema(hot_rows, keys))
    while largest > limit * CUTS:  # else the first cut has made enough pieces
        placed = null_safe_join(hot_rows, F.broadcast(spread), keys, "inner").withColumn("_chunk", _chunk_of(F.col("_pos")))
        # the rows of one time cannot be parted, so only chunks with room between their ends count
        large = placed.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"), F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi")).where(
            (F.col("_n") > 2 * limit) & (F.col("_lo") < F.col("_hi"))).select(*keys, "_chunk")
        large = spark.createDataFrame(large.collect(), large.schema)
        if large.isEmpty():
            return spread
        inside = null_safe_join(placed.select(*keys, "_chunk", "_pos"), F.broadcast(large), [*keys, "_chunk"], "inner")
        finer = _cut(inside, [*keys, "_chunk"], limit).select(*keys, "_bounds")
        before = spread.agg(F.sum(F.size("_bounds"))).first()[0]
        spread = spark.createDataFrame(spread.unionByName(finer).groupBy(*keys).agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_bounds")))).alias("_bounds")).collect(), spread.schema)
        if spread.agg(F.sum(F.size("_bounds"))).first()[0] == before:
            break
    return spread


def _cut_schema(rows: DataFrame, keys: Sequence[str]):
    return rows.select(*keys, F.array("_pos").alias("_bounds")).schema


def _cut(rows: DataFrame, groups: Sequence[str], limit: float) -> DataFrame:
    """(groups, _bounds): values of ``_pos`` that cut each group into pieces of about ``limit`` rows, ``CUTS`` at most."""
    cuts = ", ".join(f"{i / CUTS}D" for i in range(1, CUTS))
    bounds = rows.groupBy(*groups).agg(
        F.expr(f"percentile_approx(_pos, array({cuts}), {CUTS * 10})").alias("_bounds"),
        F.least(F.lit(CUTS), F.ceil(F.count("*") / F.lit(float(limit)))).alias("_pieces"))
    # keep _pieces - 1 of the cuts, evenly spread
    return bounds.select(*groups, F.array_distinct(F.filter(
        "_bounds", lambda b, i: ((i + 1) * F.col("_pieces")) % CUTS < F.col("_pieces"))).alias("_bounds"))


AUTO = "auto"


def _resolve(hot, df: DataFrame, keys: Sequence[str], at: str | None) -> DataFrame | None:
    return find_hot(df, keys, at) if isinstance(hot, str) else hot


def _chunk_of(position: Column) -> Column:
    """How many of the sorted ``_bounds`` lie below ``position``."""
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(HALVINGS))])
    below = F.aggregate(steps, F.lit(0), lambda found, step: F.when(
        F.get("_bounds", found + step - 1) < position, found + step).otherwise(found))
    return F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(below)


def with_chunks(df: DataFrame, keys: Sequence[str], at: str, hot: DataFrame | None) -> DataFrame:
    """Add ``_chunk``; 0 for every row of a key that is not hot."""
    if hot is None:
        return df.withColumn("_chunk", F.lit(0))
    marked = null_safe_join(df, F.broadcast(hot), keys, "left")
    return marked.withColumn("_chunk", _chunk_of(_position(df, at))).drop("_bounds")


def scan_in_order(df: DataFrame, keys: str | Sequence[str], order: Sequence[str], *,
                  lags: Mapping[str, str | Column] | None = None,
                  sums: Mapping[str, Column] | None = None, peers: bool = False,
                  hot: DataFrame | str | None = AUTO) -> DataFrame:
    """Previous-row values and running totals per key, in ``order``.

    ``lags`` maps a new column to the expression whose previous value it takes;
    ``sums`` maps a new column to the expression it totals up to and including the
    row (with ``peers`` also over rows that tie with it). ``order[0]`` is a number
    or a timestamp; hot keys are cut along it. ``hot`` takes the result of
    ``find_hot`` when the caller already has it.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    lags, sums = dict(lags or {}), dict(sums or {})
    hot = _resolve(hot, df, keys, order[0])
    in_chunk = Window.partitionBy(*keys, *(["_chunk"] if hot is not None else [])).orderBy(*order)
    so_far = (in_chunk.rangeBetween if peers else in_chunk.rowsBetween)(
        Window.unboundedPreceding, Window.currentRow)
    if hot is None:
        return df.withColumns({
            **{name: F.lag(as_column(c)).over(in_chunk) for name, c in lags.items()},
            **{name: F.sum(expr).over(so_far) for name, expr in sums.items()}})

    chunked = with_chunks(df, keys, order[0], hot)
    columns, totals = {}, []
    if lags:
        last = F.struct(*[as_column(c).alias(name) for name, c in lags.items()])
        columns["_prev"] = F.lag(last).over(in_chunk)
        totals.append(F.max_by(last, F.struct(*order)).alias("_last"))
    for name, expr in sums.items():
        columns[f"_sum_{name}"] = F.sum(expr).over(so_far)
        totals.append(F.sum(expr).alias(f"_total_{name}"))
    scanned = chunked.withColumns(columns)

    # one row per chunk of a hot key: what the earlier chunks hand over
    hot_rows = null_safe_join(df, F.broadcast(hot), keys, "inner").withColumn(
        "_chunk", _chunk_of(_position(df, order[0])))
    per_chunk = hot_rows.groupBy(*keys, "_chunk").agg(*totals)
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *keys, "_chunk",
        *([F.lag("_last").over(by_chunk).alias("_carry")] if lags else []),
        *[F.sum(f"_total_{name}").over(earlier).alias(f"_carry_{name}") for name in sums])
    joined = null_safe_join(scanned, F.broadcast(carry), [*keys, "_chunk"], "left")

    out = {}
    for name in lags:
        out[name] = F.when(F.col("_prev").isNotNull(), F.col(f"_prev.{name}")).otherwise(
            F.col(f"_carry.{name}"))
    for name in sums:
        carried, local = F.col(f"_carry_{name}"), F.col(f"_sum_{name}")
        # as without chunks: nothing but nulls so far is null
        total = F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
        out[name] = total.cast(scanned.schema[f"_sum_{name}"].dataType)
    helpers = ["_chunk", *(["_prev", "_carry"] if lags else []),
               *[f"{p}_{n}" for n in sums for p in ("_sum", "_carry")]]
    return joined.withColumns(out).drop(*helpers)


# A range frame looks at all its rows again for every row, so its cost grows with the
# square of a key's rows; above this many rows per key running counts are used.
FRAME_ROWS = 5_000


def trailing_counts(df: DataFrame, key: str, at: str, row_id: str, windows: Mapping[str, int], *,
                    hot: DataFrame | str | None = AUTO, largest: int | None = None,
                    frame_rows: int | None = None) -> DataFrame:
    """Rows of the same key in ``(at - seconds, at]`` for each named window.

    When every key is small, a range frame per window. Else the count is the
    difference of two running counts, C(at) - C(at - seconds), all found in one
    ordered scan, whose cost is linear and which cuts hot keys into chunks.
    ``largest`` is the row count of the largest key, when known.
    """
    if isinstance(hot, str):
        sizes = key_sizes(df, [key])
        largest, hot = sizes[0], find_hot(df, [key], at, sizes=sizes)
    frame_rows = FRAME_ROWS if frame_rows is None else frame_rows
    moment = F.unix_micros(at)
    if hot is None:
        largest = key_sizes(df, [key])[0] if largest is None else largest
        if largest <= frame_rows:
            by_time = Window.partitionBy(key).orderBy(moment)
            return df.withColumns({
                name: F.count("*").over(by_time.rangeBetween(-seconds * 1_000_000 + 1, 0))
                for name, seconds in windows.items()})

    # The row travels with its own points. Rows of equal content have equal counts, so they are
    # brought back together by content; a row number given by a task would change if the task ran again.
    row = F.struct(*[F.col(c) for c in df.columns])
    points = [F.struct(moment.alias("_t"), F.lit(1).alias("_add"), F.lit(0).alias("_what"), row.alias("_row"))]
    points += [F.struct((moment - seconds * 1_000_000).alias("_t"), F.lit(0).alias("_add"), F.lit(i).alias("_what"),
                        F.when(F.lit(False), row).alias("_row")) for i, seconds in enumerate(windows.values(), start=1)]
    content = [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f.name) for f in df.schema]
    content += [F.col(c).isNull() for c in df.columns]
    asked = df.withColumns({"_h0": F.xxhash64(*content), "_h1": F.xxhash64(F.lit(1), *content)}).select(
        key, "_h0", "_h1", F.inline(F.array(*points)))
    counted = scan_in_order(asked, key, ["_t"], sums={"_upto": F.col("_add")}, peers=True, hot=hot)
    upto = [F.max(F.when(F.col("_what") == i, F.col("_upto"))) for i in range(len(windows) + 1)]
    no_time = F.max("_t").isNull()  # rows without a time count each other, as in a range frame
    counts = counted.groupBy(key, "_h0", "_h1").agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.sum("_add").alias("_copies"), *[
            F.when(no_time, upto[0]).otherwise(upto[0] - upto[i]).cast("bigint").alias(name)
            for i, name in enumerate(windows, start=1)])
    return counts.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*", *windows)


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "row_no") -> DataFrame:
    """0-based position of every row in the total ``order``, without one big task.

    The rows are range-partitioned and sorted, numbered per partition, and the
    counts of the earlier partitions are added. The sorted rows are checkpointed in
    the shared folder, so a lost executor cannot change partition borders between
    the two uses.
    """
    shared_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("_part", F.shiftright("_mid", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row per partition of the sort, so this window and broadcast are small
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = F.col("_mid") - F.shiftleft("_part", 33)
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        name, (F.col("_before") + local).cast("bigint")).drop("_mid", "_part", "_before")


def attach_by_key(rows: DataFrame, per_key: DataFrame, key: str, spread: str, *,
                  hot: DataFrame | str | None = AUTO) -> DataFrame:
    """Left join ``rows`` to ``per_key``, which has one row per ``key``; null finds nothing.

    Rows of hot keys (1 / HOT_SHARE keys at most) find theirs by broadcast and are
    spread over the shuffle of the remaining join by a hash of ``spread``, so that
    one hot key cannot fill one task.
    """
    values = [c for c in per_key.columns if c != key]
    hot = _resolve(hot, rows, [key], None)
    if hot is None:
        return rows.join(per_key, key, "left").select(*rows.columns, *values)
    hot_list = F.broadcast(hot.select(key))
    few = per_key.join(hot_list, key, "left_semi").select(
        key, F.struct(*values).alias("_hot_row"))
    many = per_key.join(hot_list, key, "left_anti").select(
        key, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold_row"))
    marks = F.broadcast(hot.select(key, F.lit(True).alias("_is_hot")))
    flagged = null_safe_join(rows, marks, [key], "left").join(F.broadcast(few), key, "left")
    salted = flagged.withColumn("_salt", F.when(F.col("_is_hot").isNull(), F.lit(0)).otherwise(
        1 + F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int")))
    joined = salted.join(many, [key, "_salt"], "left").withColumn(
        "_found", F.coalesce("_hot_row", "_cold_row"))
    return joined.select(*rows.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


SORTED_VALUES = 2_000_000


def exact_quantiles(df: DataFrame, wanted: Mapping[str, float], accuracy: int = 100_000,
                    sorted_values: int = SORTED_VALUES) -> dict[str, float | None]:
    """Exact linear-interpolated quantile of each column, nulls and NaN left out.

    A mergeable sketch brackets the rank and one pass counts the rows below and inside
    the bracket; while more than ``sorted_values`` rows are inside, the bracket is cut
    down the same way (to about ``10 / accuracy`` of itself). Only the distinct values
    left inside are put in order. Returns plain numbers: model parameters.
    """
    number = {c: F.col(c).cast("double") for c in wanted}
    numbers = df.select(*[F.when(~F.isnan(x), x).alias(c) for c, x in number.items()])
    sizes = numbers.agg(*[F.count(c).alias(c) for c in wanted]).first().asDict() if wanted else {}
    live = [c for c in wanted if sizes[c]]
    if not live:
        return {c: None for c in wanted}
    ranks = {c: wanted[c] * (sizes[c] - 1) for c in live}
    lo, hi = dict.fromkeys(live, float("-inf")), dict.fromkeys(live, float("inf"))
    below, inside = dict.fromkeys(live, 0), {c: sizes[c] for c in live}

    def within(c: str) -> Column:
        return F.when(F.col(c).between(F.lit(lo[c]), F.lit(hi[c])), F.col(c))

    open_ = list(live)
    while open_:
        shares = {}
        for c in open_:
            margin = max(5 / accuracy, 4 / inside[c])
            at = (ranks[c] - below[c]) / max(inside[c] - 1, 1)
            shares[c] = [min(max(at - margin, 0.0), 1.0), min(max(at + margin, 0.0), 1.0)]
        sketch = numbers.agg(*[F.percentile_approx(within(c), shares[c], accuracy).alias(c) for c in open_]).first()
        lo.update({c: sketch[c][0] for c in open_})
        hi.update({c: sketch[c][1] for c in open_})
        counts = numbers.agg(*[F.count_if(F.col(c) < F.lit(lo[c])).alias(f"b_{c}") for c in open_],
                             *[F.count(within(c)).alias(f"i_{c}") for c in open_]).first()
        before = {c: inside[c] for c in open_}
        below.update({c: counts[f"b_{c}"] for c in open_})
        inside.update({c: counts[f"i_{c}"] for c in open_})
        # a bracket that no longer shrinks holds few distinct values
        open_ = [c for c in open_ if inside[c] > sorted_values and inside[c] < before[c] / 2]

    values = numbers.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), within(c).alias("v")) for c in live]))).where(
        F.col("v").isNotNull()).groupBy("name", "v").agg(F.count("*").alias("n"))
    start = F.create_map(*[x for c in live for x in (F.lit(c), F.lit(below[c]))])
    rank = F.create_map(*[x for c in live for x in (F.lit(c), F.lit(float(ranks[c])))])
    in_order = Window.partitionBy("name").orderBy("v")
    placed = values.withColumn("upto", start[F.col("name")] + F.sum("n").over(in_order)).withColumn(
        "rank", rank[F.col("name")])
    pair = placed.groupBy("name").agg(
        F.min(F.when(F.col("upto") >= F.floor("rank") + 1, F.col("v"))).alias("lo"),
        F.min(F.when(F.col("upto") >= F.ceil("rank") + 1, F.col("v"))).alias("hi"))
    found = {r["name"]: (r["lo"], r["hi"]) for r in pair.collect()}
    return {c: found[c][0] + (found[c][1] - found[c][0]) * (ranks[c] - int(ranks[c])) if c in found else None
            for c in wanted}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, the smallest on ties."""
    if not columns:
        return {}
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])))
    counts = pairs.where(F.col("v").isNotNull()).groupBy("name", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("name").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    return {**{c: None for c in columns}, **{r["name"]: r["v"] for r in best.collect()}}


def top_share_by_hash(df: DataFrame, strata: str, row_id: str, share: float,
                      prefix: int = 4) -> DataFrame:
    """Add ``held_out``: exactly ``floor(n * share)`` rows of each stratum, picked by md5 order.

    Only rows in the hash bucket where the cut falls are ranked, so a stratum that
    holds most of the data costs no big sort; the cut is one value per stratum.
    """
    hashed = df.withColumn("_h", F.md5(F.col(row_id).cast("string")))
    bucket = F.substring("_h", 1, prefix)
    # at most 16**prefix rows per stratum
    sizes = hashed.groupBy(strata, bucket.alias("_b")).agg(F.count("*").alias("_n"))
    per_stratum = Window.partitionBy(strata)
    ordered = per_stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_bucket = sizes.select(
        strata, "_b", "_n", F.sum("_n").over(ordered).alias("_upto"),
        F.floor(F.sum("_n").over(per_stratum) * F.lit(share)).alias("_want"),
    ).where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
    at_cut = null_safe_join(hashed.select(strata, "_h", row_id, bucket.alias("_b")), cut_bucket,
                            [strata, "_b"], "inner")
    place = Window.partitionBy(strata, "_b").orderBy("_h", row_id)
    cut = at_cut.withColumn("_rn", F.row_number().over(place) + F.col("_upto") - F.col("_n")).where(
        F.col("_rn") == F.col("_want")).select(strata, F.struct("_h", row_id).alias("_cut"))
    # one row per stratum; the planner broadcasts it on its measured size
    marked = null_safe_join(hashed, cut, [strata], "left")
    return marked.withColumn(
        "held_out", F.coalesce(F.struct("_h", row_id) <= F.col("_cut"), F.lit(False))
    ).drop("_h", "_cut")
