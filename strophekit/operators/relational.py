"""Relational operators.

Each is a function DataFrame(s) -> DataFrame built on the DataFrame API so
Catalyst prunes columns, pushes filters into the scan and picks the join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



# --- P: projection and predicates ---------------------------------------------
def select_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the listed columns under their new names."""
    return df.select(*[F.col(k).alias(v) for k, v in mapping.items()])


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """A constant column."""
    return df.withColumn(name, F.lit(value))


def apply_corrections(df: DataFrame, fixes: DataFrame, key: str, col: str) -> DataFrame:
    """Replace ``col`` where a corrections table ``(key, col)`` has an
    entry.  One correction per key (first by value) keeps rows whole."""
    fx = fixes.groupBy(key).agg(F.min(col).alias("_fix"))
    out = df.join(fx, on=key, how="left")
    return out.withColumn(col, F.coalesce(F.col("_fix"), F.col(col))).drop("_fix")


def filter_members(df: DataFrame, col: str, values) -> DataFrame:
    """Membership filter.  A short Python list becomes ``isin``; a
    DataFrame (one column) becomes a left-semi join.  An empty list keeps
    everything (the reference accessors' convention)."""
    if isinstance(values, DataFrame):
        other = values.select(F.col(values.columns[0]).alias(col))
        return df.join(other, on=col, how="left_semi")
    values = list(values)
    return df if not values else df.filter(F.col(col).isin(values))


def drop_substrings(df: DataFrame, col: str, needles: Sequence[str], dropna: bool = True) -> DataFrame:
    """Drop rows whose ``col`` holds any needle, then rows with NULLs."""
    cond = F.lit(True)
    for n in needles:
        cond = cond & ~F.col(col).contains(n)
    out = df.filter(cond)
    return out.dropna("any") if dropna else out


def replace_values(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Whole-value replacement by a map."""
    return df.replace(dict(mapping), subset=[col])


def list_bucket(value: Column, base: int, width: int, names: Sequence[str]) -> Column:
    """P10: ``names[(value - base) // width]`` with Python index rules
    (negative indexes count from the end); out of range -> NULL."""
    idx = F.floor((value - F.lit(base)) / F.lit(width)).cast("int")
    n = len(names)
    arr = F.array(*[F.lit(x) for x in names])
    pos = F.when((idx >= 0) & (idx < n), idx + 1).when((idx < 0) & (idx >= -n), idx + n + 1)
    return F.when(pos.isNotNull(), F.element_at(arr, pos))


def classify_model_file(path: Column) -> tuple[Column, Column]:
    """Model family and checkpoint from an output file name, rules in
    the reference's order; an unmatched checkpoint is NULL."""
    family = (F.when(path.contains("temp-1"), "tuned-chat-temp-1")
              .when(path.contains("chat"), "tuned-chat").otherwise("tuned"))
    ckpt = (F.when(path.contains("llama"), 0).when(path.contains("-50-"), 50)
            .when(path.contains("-100-"), 100).when(path.contains("-150-"), 150))
    return family, ckpt


# --- J: joins ------------------------------------------------------------------
def join_narrowed(left: DataFrame, right: DataFrame, key: str, right_cols: Sequence[str],
                  suffix: str = "_y") -> DataFrame:
    """Inner equi-join with the right side narrowed first; clashing
    names from the right get ``suffix``."""
    r = right.select(key, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right_cols])
    return left.join(r, on=key, how="inner")


def left_join_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on differently named keys."""
    return left.join(right, left[left_key] == right[right_key], "left")


def position_index(df: DataFrame, group: Sequence[str], order: str,
                   name: str = "position") -> DataFrame:
    """1-based position of each row inside its group by one order
    column, computed with value buckets (see ``global_row_index``) so a
    group holding a third of all rows is not sorted in one task."""
    return global_row_index(df, order, name, group=group)


def common_keys(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys seen under every distinct ``member`` value.  Pre-aggregated
    to distinct (key, member) pairs before the count."""
    # The number of distinct members is a scalar subquery: no job while the plan is built.
    n_members = df.select(member).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    per_key = df.select(key, member).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_members"))
    return per_key.filter(F.col("n_members") == n_members)


def prune_to_common(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keep rows whose key occurs under every member (left-semi)."""
    return df.join(common_keys(df, key, member).select(key), on=key, how="left_semi")


def leak_guard(train: DataFrame, test: DataFrame, train_key: Column, test_key: Column) -> DataFrame:
    """Drop training rows whose normalised key occurs in the test set."""
    t = test.select(test_key.alias("_k")).distinct()
    return train.withColumn("_k", train_key).join(t, on="_k", how="left_anti").drop("_k")


# --- D / W / O -----------------------------------------------------------------
def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order`` (ascending; ties broken
    by the remaining columns, so the choice is deterministic).

    Written as ``min(struct(order..., rest...))`` per key: a declarative
    aggregate with a map-side partial step, so a key holding a third of all
    rows is reduced inside every map task before the shuffle (a window
    would sort all of that key's rows in one task)."""
    keys = list(keys)
    order = [o for o in order]
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                      *[F.col(c).alias(c) for c in rest])
    g = df.groupBy(*keys).agg(F.min(packed).alias("_r"))
    return g.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def _row_hash(df: DataFrame) -> Column:
    """One number per row content; columns that cannot be hashed (maps) are left out."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def _n_below(bounds: Column, x: Column, steps: int) -> Column:
    """How many elements of a sorted array lie below ``x`` (binary search)."""
    powers = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    return F.aggregate(powers, F.lit(0), lambda lo, st: F.when(
        F.get(bounds, lo + st - 1) < x, lo + st).otherwise(lo))


ROWS_PER_BOUND = 32


def _bucketed(df: DataFrame, columns: Sequence[str], n: int, tie: Sequence[str] | None) -> DataFrame:
    """``df`` with ``_key`` (columns, then tie) and ``_bkt``, one of about ``n``
    ranges of it that hold even shares of the rows."""
    ties = [F.col(c) for c in tie] if tie else [_row_hash(df)]
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)],
                   *[c.alias(f"t{i}") for i, c in enumerate(ties)])
    keyed = df.withColumn("_key", key)
    # about n * ROWS_PER_BOUND keys: one of every ``step``, drawn by hash
    step = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / (n * ROWS_PER_BOUND))).alias("s")).scalar()
    sample = keyed.select("_key").filter(F.pmod(F.xxhash64("_key"), step) == 0).distinct()
    bounds = sample.agg(F.sort_array(F.collect_list("_key")).alias("b"))
    bounds = bounds.select(F.expr(f"array_distinct(transform(filter(sequence(1, {n}), i -> i < {n} and size(b) > 0), "
                                  f"i -> b[cast(i * size(b) div {n} as int)]))").alias("b")).scalar()
    return keyed.withColumn("_bounds", bounds).withColumn(
        "_bkt", F.get(F.transform(F.array("_key"), lambda k: _n_below(F.col("_bounds"), k, n.bit_length())), 0)).drop("_bounds")


def global_row_index(df: DataFrame, order: str | Sequence[str], name: str = "row_no",
                     n_buckets: int | None = None, group: Sequence[str] = (),
                     tie: Sequence[str] | None = None) -> DataFrame:
    """1-based row number by columns of any orderable type (inside each
    ``group``, or over the whole table), NULLs first, without a window that
    holds a whole group and without a job while the plan is built.

    The key of a row is (group, order, tie); ``tie`` names columns that make
    rows distinct, by default a hash of the whole row, so a value held by half
    of the table is still cut.  A sample of keys drawn by hash (its expected
    size is ``ROWS_PER_BOUND`` per bucket, whatever the table's) gives the
    bucket bounds as one scalar subquery.  Rows are counted per bucket, the
    running sum of these counts is the bucket's offset, and a window numbers
    the rows inside a bucket.  Everything depends on values only, so the
    numbers hold under column pruning, AQE coalescing and task retries.  Rows
    equal in all columns are numbered in any order, inside one bucket.
    """
    group, order = list(group), [order] if isinstance(order, str) else list(order)
    n = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = _bucketed(df, group + order, n, tie)
    cells = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)] + [F.col("_bkt").alias("_ob")]
    seen = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_ob")
    offs = b.groupBy(*cells).agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_off", F.sum("_c").over(seen.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).drop("_c")
    local = b.withColumn("_ln", F.row_number().over(Window.partitionBy("_bkt", *group).orderBy("_key"))).drop("_key")
    same = F.col("_bkt") == F.col("_ob")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = local.join(offs, same)
    return out.select(*df.columns, (F.col("_off") + F.col("_ln")).cast("long").alias(name))


def row_slice(df: DataFrame, order: str, start: int, count: int | None) -> DataFrame:
    """Rows ``start`` .. ``start+count-1`` (0-based start) by ``order``."""
    idx = global_row_index(df, order, "_row")
    cond = F.col("_row") > start
    if count is not None:
        cond = cond & (F.col("_row") <= start + count)
    return idx.filter(cond).withColumn("row_no", F.col("_row") - 1).drop("_row")


def round_robin_shard(df: DataFrame, order: str, n: int) -> DataFrame:
    """Row k (1-based) gets shard ``k mod n``."""
    idx = global_row_index(df, order, "_row")
    return idx.withColumn("shard", (F.col("_row") % n).cast("int")).drop("_row")


def list_position_desc(col: Column, ordering: Sequence[str]) -> Column:
    """O2: sort key = position in a list; sort it descending for the
    reference's reversed order."""
    return F.array_position(F.array(*[F.lit(x) for x in ordering]), col)


# --- R: reshape ------------------------------------------------------------------
def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str) -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(ids), list(values), var, val)


def pivot_agg(df: DataFrame, group: Sequence[str], pivot_col: str, values: Sequence, agg: Column) -> DataFrame:
    """R2: long -> wide with an explicit value list (stable schema)."""
    return df.groupBy(*group).pivot(pivot_col, list(values)).agg(agg)


# --- A: aggregates -----------------------------------------------------------------
OCTAVE_PARTS = 1 << 14  # buckets of the first histogram per power of two
PARTS = (1 << 20) - 1   # buckets of each later one, at most
SALTS = 32


def _first_bucket(v: Column) -> Column:
    """Number that never falls as ``v`` grows: sign, and the logarithm in steps of 1 / OCTAVE_PARTS."""
    size = F.floor((F.log2(F.abs(v)) + 1100) * OCTAVE_PARTS)
    far = F.lit(1 << 40)
    return (F.when(F.isnan(v), far + 1).when(v == float("inf"), far).when(v == float("-inf"), -far)
            .when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long"))


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (``percentile`` /
    ``quantile_cont``) per group by narrowing histograms, without ranking rows.

    Rows are counted per bucket of the logarithm; running counts show which
    buckets hold the needed ranks.  Only the rows of those are counted again,
    in equal parts between the least and the greatest value of their bucket.
    Such a bucket holds at most 2^39 doubles and each of two more
    histograms cuts that by 2^20, so the last bucket of a rank is one value,
    whatever the distribution.  Each histogram is an aggregation with a
    map-side part; rows meet the few buckets of their group by a salted join.

    NULL values are left out; NaN is the greatest value; a NULL group is a group.  Output:
    group columns, ``n`` and one column per probability."""
    group, probs = list(group), [float(p) for p in probs]
    names = list(names) if names else [f"q_{p}" for p in probs]
    own = [f"_g{i}" for i in range(len(group))]
    v = F.col("_v")
    d = df.select(*[F.col(c).alias(o) for c, o in zip(group, own)], (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
    d = d.filter(v.isNotNull())
    salted = d.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))

    def place(p: float) -> Column:
        return F.lit(p) * (F.col("_n") - 1)

    def holding(counts: DataFrame, within: list[str], wanted: Column, n: Column, start: Column) -> DataFrame:
        """Buckets that hold a wanted rank: ``_n, _start, _lo, _hi, _ranks``."""
        run = Window.partitionBy(*within).orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = counts.withColumn("_end", F.sum("_c").over(run)).withColumn("_n", n)
        cut = cut.withColumn("_end", F.col("_end") + start).withColumn("_at", F.col("_end") - F.col("_c"))
        cut = cut.withColumn("_ranks", F.filter(wanted, lambda r: (r >= F.col("_at")) & (r < F.col("_end"))))
        return cut.filter(F.size("_ranks") > 0).select(*own, "_n", F.col("_at").alias("_start"), "_lo", "_hi", "_ranks")

    tallies = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    state = holding(d.groupBy(*own, _first_bucket(v).alias("_k")).agg(*tallies), own, ranks,
                    F.sum("_c").over(Window.partitionBy(*own)), F.lit(0))
    for _ in range(2):
        asked = state.select(*[F.col(o).alias(o + "w") for o in own], "_n", "_start", F.col("_lo").alias("_from"),
                             F.col("_hi").alias("_to"), "_ranks",
                             F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_saltw"))
        met = (F.col("_salt") == F.col("_saltw")) & (v >= F.col("_from")) & (v <= F.col("_to"))
        for o in own:
            met = met & F.col(o).eqNullSafe(F.col(o + "w"))
        part = F.when(F.col("_from") < F.col("_to"), F.floor((v - F.col("_from")) / F.nullif(F.col("_to") - F.col("_from"), F.lit(0.0)) * PARTS))
        rows = salted.join(asked, met).withColumn("_k", F.coalesce(part, F.lit(0)).cast("long"))
        bucket = own + ["_start", "_n", "_ranks"]
        state = holding(rows.groupBy(*bucket, "_k").agg(*tallies), bucket, F.col("_ranks"), F.col("_n"), F.col("_start"))
    at = state.groupBy(*own, "_n").agg(F.map_from_entries(F.flatten(F.collect_list(F.transform(
        "_ranks", lambda r: F.struct(r.alias("r"), F.col("_lo").alias("x")))))).alias("_at"))

    def quantile(p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        x, y = F.col("_at")[low.cast("long")], F.col("_at")[high.cast("long")]
        return F.when(low == high, x).otherwise((high - place(p)) * x + (place(p) - low) * y)

    return at.select(*[F.col(o).alias(c) for c, o in zip(group, own)], F.col("_n").alias("n"),
                     *[quantile(p).alias(nm) for p, nm in zip(probs, names)])


def mean_median_table(scores: DataFrame, measure: str, model: str, value: str,
                      models: Sequence[str], target: str) -> DataFrame:
    """A1: one row per measure, columns '<model> median score' and
    '<model> mean score' (rounded half-even to 2), sorted by the target's
    median then mean, descending.  ``scores`` is read several times: a caller whose
    scores are costly cuts their lineage first."""
    slim = scores.select(measure, model, value)
    med = exact_quantiles(slim, [measure, model], value, [0.5], ["median"])
    avg = slim.groupBy(measure, model).agg(F.avg(value).alias("mean"))
    cells = avg.join(med.drop("n"), on=[measure, model], how="left")
    g = cells.groupBy(measure).pivot(model, list(models)).agg(
        F.first("median").alias("median"), F.first("mean").alias("mean"))
    cols = [F.col(measure).alias("Measure")]
    for m in models:
        cols.append(F.bround(F.col(f"{m}_median"), 2).alias(f"{m} median score"))
        cols.append(F.bround(F.col(f"{m}_mean"), 2).alias(f"{m} mean score"))
    out = g.select(*cols)
    return out.orderBy(F.col(f"{target} median score").desc(), F.col(f"{target} mean score").desc())


def count_pivot(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """A3: counts by two keys spread to columns, missing = 0."""
    return df.groupBy(row).pivot(col, list(values)).count().na.fill(0, subset=list(values))


def win_rates(counts: DataFrame, a: str, b: str, min_votes: int) -> DataFrame:
    """A4: votes, minimum-vote cut, share of ``a``."""
    out = counts.withColumn("num_votes", (F.col(a) + F.col(b)).cast("long"))
    out = out.filter(F.col("num_votes") >= min_votes)
    return out.withColumn("win_rate", F.try_divide(F.col(a).cast("double"), F.col("num_votes").cast("double")))


def overall_rate(df: DataFrame, col: str, winner: str, loser: str) -> DataFrame:
    """A5: wins / (wins + losses) over all votes."""
    return df.agg(F.try_divide(F.sum(F.when(F.col(col) == winner, 1).otherwise(0)).cast("double"),
                               F.sum(F.when(F.col(col).isin(winner, loser), 1).otherwise(0)).cast("double"))
                  .alias("win_rate"))


def mean_by_group(df: DataFrame, group: Sequence[str], value: str, valid: Column | None = None) -> DataFrame:
    """Mean of ``value`` per group, invalid rows left out."""
    d = df.filter(valid) if valid is not None else df
    return d.groupBy(*group).agg(F.avg(value).alias("score"))


def box_summary(df: DataFrame, group: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles (linear interpolation), IQR fences, whiskers = extreme
    values inside the fences, outlier count, per group.  The quartile table
    (one row per group) is joined back.  ``df`` is read several times: a caller
    whose rows are costly cuts their lineage first."""
    df = df.select(*group, value)
    q = exact_quantiles(df, group, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumn("lo_fence", F.col("q1") - whisker * F.col("iqr")) \
         .withColumn("hi_fence", F.col("q3") + whisker * F.col("iqr"))
    j = df.select(*group, value).join(q.select(*group, "lo_fence", "hi_fence"), on=list(group))
    inside = (F.col(value) >= F.col("lo_fence")) & (F.col(value) <= F.col("hi_fence"))
    w = j.groupBy(*group).agg(
        F.min(F.when(inside, F.col(value))).alias("lo_whisker"),
        F.max(F.when(inside, F.col(value))).alias("hi_whisker"),
        F.sum(F.when(~inside, 1).otherwise(0)).cast("long").alias("n_outliers"))
    return q.join(w, on=list(group)).drop("lo_fence", "hi_fence")


def outliers(df: DataFrame, group: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """The outlier rows themselves (joined back by group)."""
    q = exact_quantiles(df, group, value, [0.25, 0.75], ["q1", "q3"]).drop("n")
    j = df.join(q, on=list(group))
    iqr = F.col("q3") - F.col("q1")
    return j.filter((F.col(value) < F.col("q1") - whisker * iqr) |
                    (F.col(value) > F.col("q3") + whisker * iqr)).drop("q1", "q3")
