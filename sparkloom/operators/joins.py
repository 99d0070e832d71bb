"""Joins with the engine's naming, and as-of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}
_HINT = {"broadcast": "broadcast", "sort_merge": "merge", "hash": "shuffle_hash"}


def _names(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def join(left: DataFrame, right: DataFrame, on=None, left_on=None, right_on=None, how: str = "inner", strategy: str | None = None, prefix: str | None = None, suffix: str | None = None, null_equals_null: bool = False) -> DataFrame:
    """Equi-join (or cross join).  Keys of one name become one column; other
    right columns whose name the left has too get a prefix (``right.``) or suffix."""
    lk, rk = _names(left_on or on), _names(right_on or on)
    if how == "cross":
        if lk or rk:
            raise ValueError("a cross join has no keys")
    elif not lk or len(lk) != len(rk):
        raise ValueError("as many keys left as right, one at least")
    clash = set(left.columns)
    new = {}
    for c in right.columns:
        name = c
        if c in clash and how not in ("semi", "anti"):
            name = f"{prefix if prefix is not None else '' if suffix else 'right.'}{c}{suffix or ''}"
        new[c] = name
    r = right.select(*(F.col(f"`{c}`").alias(f"__r{k}") for k, c in enumerate(right.columns)))
    at = {c: f"__r{k}" for k, c in enumerate(right.columns)}
    if strategy:
        r = r.hint(_HINT[strategy])
    if how == "cross":
        out = left.crossJoin(r)
    else:
        pairs = [(left[f"`{a}`"].eqNullSafe(r[at[b]]) if null_equals_null else left[f"`{a}`"] == r[at[b]]) for a, b in zip(lk, rk, strict=True)]
        out = left.join(r, reduce(lambda x, y: x & y, pairs), _HOW[how])
    if how in ("semi", "anti"):
        return out
    same = {a for a, b in zip(lk, rk, strict=True) if a == b}
    cols = []
    for c in left.columns:
        keep = F.col(f"`{c}`")
        if c in same:
            other = F.col(at[c])
            keep = {"right": other, "outer": F.coalesce(keep, other)}.get(how, keep)
        cols.append(keep.alias(c))
    cols += [F.col(at[c]).alias(new[c]) for c in right.columns if c not in same]
    return out.select(*cols)


def join_asof(left: DataFrame, right: DataFrame, on=None, left_on=None, right_on=None, by=None, left_by=None, right_by=None, strategy: str = "backward", prefix: str | None = None, suffix: str | None = None, buckets: int | None = None) -> DataFrame:
    """Each left row with the nearest right row of its keys: ``backward`` (latest at or before),
    ``forward`` (earliest at or after) or ``nearest`` (a tie goes forward).

    Both sides meet in one union that is shuffled by the keys once; a window
    carries the last (next) right row along.  Null keys never match.

    With ``buckets`` a key's rows are cut by that many ranges of ``on`` too, of
    about equal numbers of rows, and the last right row of each range is carried
    over its edge: a hot key is spread over as many tasks.  Without keys, where
    all rows would meet in one task, 64 ranges are the rule.
    """
    lo, ro = left_on or on, right_on or on
    lb, rb = _names(left_by or by), _names(right_by or by)
    taken, drop = set(left.columns), {b for a, b in zip(lb, rb, strict=True) if a == b} | ({ro} if lo == ro else set())
    bring = [c for c in right.columns if c not in drop]
    new = {c: (f"{prefix if prefix is not None else '' if suffix else 'right.'}{c}{suffix or ''}" if c in taken else c) for c in bring}
    keys = [f"__k{k}" for k in range(len(lb))]
    l_rows = left.select(*(F.col(f"`{a}`").alias(k) for a, k in zip(lb, keys, strict=True)), F.col(f"`{lo}`").alias("__t"), F.lit(1).alias("__side"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("__l"))
    good = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in [ro, *rb]])
    r_rows = right.where(good).select(*(F.col(f"`{a}`").alias(k) for a, k in zip(rb, keys, strict=True)), F.col(f"`{ro}`").alias("__t"), F.struct(F.col(f"`{ro}`").alias("__t"), *(F.col(f"`{c}`").alias(f"__v{k}") for k, c in enumerate(bring))).alias("__r"))
    rows = l_rows.unionByName(r_rows.withColumn("__side", F.lit(0)), allowMissingColumns=True)

    buckets = 64 if buckets is None and not lb else buckets or 1
    if buckets > 1:
        cuts = rows.agg(F.percentile_approx("__t", [k / buckets for k in range(1, buckets)]).alias("__cuts"))  # one row
        rows = rows.crossJoin(F.broadcast(cuts)).withColumn("__c", F.size(F.filter("__cuts", lambda c: c <= F.col("__t")))).drop("__cuts")
    parts = [*keys, "__c"] if buckets > 1 else keys

    def found(rows: DataFrame, forward: bool, name: str) -> DataFrame:
        side = F.col("__side")
        w = W.partitionBy(*parts).orderBy(F.col("__t").desc() if forward else F.col("__t").asc(), side.asc())
        out = F.last_value("__r", True).over(w.rowsBetween(W.unboundedPreceding, 0))
        if buckets > 1:
            own = lambda c: F.when(side == 0, F.col(c))
            edge = rows.groupBy(*parts).agg((F.min_by if forward else F.max_by)(own("__r"), own("__t")).alias("__e"))
            over = W.partitionBy(*keys).orderBy(F.col("__c").desc() if forward else F.col("__c").asc()).rowsBetween(W.unboundedPreceding, -1)
            edge = edge.select(*(F.col(c).alias(f"__at{k}") for k, c in enumerate(parts)), F.last_value("__e", True).over(over).alias("__in"))
            rows = rows.join(edge, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__at{k}") for k, c in enumerate(parts)]), "left").drop(*(f"__at{k}" for k in range(len(parts))))
            out = F.coalesce(out, F.col("__in"))
        good = F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ["__t", *keys]]), out)
        return rows.withColumn(name, good).drop("__in")

    kind = dict(left.dtypes)[lo]
    if strategy == "nearest":
        rows = found(found(rows, False, "__b"), True, "__f")
        if kind in ("timestamp_ntz", "timestamp", "date"):
            gap = lambda a, b: F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
        else:
            exact = "double" if kind in ("float", "double") else kind if kind.startswith("decimal") else "decimal(20,0)"
            gap = lambda a, b: a.cast(exact) - b.cast(exact)
        back, ahead = gap(F.col("__t"), F.col("__b.__t")), gap(F.col("__f.__t"), F.col("__t"))
        rows = rows.withColumn("__m", F.when(F.col("__b").isNull() | (ahead <= back), F.col("__f")).otherwise(F.col("__b")))
    else:
        rows = found(rows, strategy == "forward", "__m")
    return rows.where("__side = 1").select(*(F.col(f"__l.`{c}`").alias(c) for c in left.columns), *(F.col(f"__m.__v{k}").alias(new[c]) for k, c in enumerate(bring)))


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Left rows with the right rows whose [low, high) holds the point, over buckets of ``width``."""
    spans = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    points = left.withColumn("__b", F.floor(F.col(point) / width))
    return points.join(spans, "__b").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__b")
