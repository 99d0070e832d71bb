"""The dataframe API: a thin, lazy cover over a Spark DataFrame.

Names and semantics follow the engine (nulls sort as greatest, explode keeps
empty lists, right columns that clash are renamed); every method only declares
a plan, except those that say that they run it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import aggregates as agg_functions
from sparkloom.functions._base import col
from sparkloom.functions.windows import ordering
from sparkloom.operators import hosted, joins, runs, sinks


def _flat(cols) -> list:
    return [c for x in cols for c in (x if isinstance(x, (list, tuple)) else [x])]


class Grouped:
    """Rows by group; null is a group."""

    def __init__(self, frame: Frame, keys: list):
        self.frame, self.keys = frame, keys

    def agg(self, *exprs, **named: Column) -> Frame:
        return Frame(self.frame.df.groupBy(*map(col, self.keys)).agg(*_flat(exprs), *(c.alias(n) for n, c in named.items())))

    def _each(self, f: Callable, cols: tuple, *args) -> Frame:
        names = {k for k in self.keys if isinstance(k, str)}
        return self.agg(*(f(c, *args).alias(c) for c in _flat(cols) or [c for c in self.frame.column_names if c not in names]))

    def map_groups(self, f: Callable, schema: str) -> Frame:
        """f(pandas DataFrame of one group) -> pandas DataFrame."""
        return Frame(self.frame.df.groupBy(*map(col, self.keys)).applyInPandas(f, schema))


_AGGREGATES = {n: getattr(agg_functions, n) for n in ("sum", "mean", "stddev", "var", "min", "max", "any_value", "count", "skew", "product", "count_distinct", "list_agg", "list_agg_distinct", "string_agg", "median", "bool_and", "bool_or")}


def rebatched(batches: Iterator, size: int) -> Iterator:
    """Arrow batches of ``size`` rows, and one of the rest."""
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, rows - size + 1, size):
                yield from table.slice(at, size).to_batches()
            table = table.slice(rows - rows % size)
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Frame:
    batch_rows: int | None = None
    collected = False

    def __init__(self, df: DataFrame):
        self.df = df

    # Shape.

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def column_names(self) -> list[str]:
        return self.df.columns

    @property
    def columns(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.df.columns]

    def __getitem__(self, name) -> Column:
        return self.df[name]

    def schema(self):
        return self.df.schema

    def num_partitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def explain(self, show_all: bool = False) -> None:
        self.df.explain("extended" if show_all else "formatted")

    def describe(self) -> Frame:
        """One row for each column: its name and type."""
        return Frame(self.spark.createDataFrame(list(self.df.dtypes), "column_name string, type string"))

    def summarize(self) -> Frame:
        """One row for each column: type, min, max, count, nulls and approximate distinct values, from one aggregation."""
        parts = [F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.min(f"`{n}`").cast("string").alias("min"), F.max(f"`{n}`").cast("string").alias("max"), F.count(f"`{n}`").alias("count"), F.count_if(F.col(f"`{n}`").isNull()).alias("count_nulls"), F.approx_count_distinct(f"`{n}`").alias("approx_count_distinct")) for n, t in self.df.dtypes if not t.startswith(("map", "struct", "array"))]
        return Frame(self.df.agg(F.array(*parts).alias("a")).select(F.inline("a")))

    def pipe(self, f: Callable, *args, **kwargs):
        return f(self, *args, **kwargs)

    def transform(self, f: Callable, *args, **kwargs) -> Frame:
        out = f(self, *args, **kwargs)
        if not isinstance(out, Frame):
            raise TypeError(f"{f} must return a Frame")
        return out

    # Rows and columns.

    def select(self, *cols, **named) -> Frame:
        return Frame(self.df.select(*map(col, _flat(cols)), *(col(c).alias(n) for n, c in named.items())))

    def exclude(self, *names: str) -> Frame:
        return Frame(self.df.drop(*names))

    def where(self, predicate) -> Frame:
        return Frame(self.df.where(predicate))

    filter = where

    def with_column(self, name: str, expr) -> Frame:
        return Frame(self.df.withColumn(name, col(expr)))

    def with_columns(self, columns: dict) -> Frame:
        return Frame(self.df.withColumns({n: col(c) for n, c in columns.items()}))

    def with_column_renamed(self, existing: str, new: str) -> Frame:
        return Frame(self.df.withColumnRenamed(existing, new))

    def with_columns_renamed(self, names: dict[str, str]) -> Frame:
        return Frame(self.df.withColumnsRenamed(names))

    def distinct(self, *on) -> Frame:
        return Frame(self.df.dropDuplicates(_flat(on)) if on else self.df.distinct())

    unique = drop_duplicates = distinct

    def sort(self, by, desc=False, nulls_first=None) -> Frame:
        return Frame(self.df.orderBy(*ordering(by, desc, nulls_first)))

    def limit(self, num: int) -> Frame:
        return Frame(self.df.limit(num))

    def offset(self, num: int) -> Frame:
        return Frame(self.df.offset(num))

    def sample(self, fraction: float | None = None, size: int | None = None, with_replacement: bool = False, seed: int | None = None) -> Frame:
        """A fraction of the rows, or exactly ``size`` of them; a seed draws the same rows however they are partitioned."""
        if size is None:
            return Frame(self.df.sample(with_replacement, fraction, seed))
        order = self._order(seed)
        if not with_replacement:
            return Frame(self.df.orderBy(*order).limit(size))
        # every row is drawn Poisson(size / rows) times, a little more often than needed, and the draws are cut to size
        rows = self.df.count()
        if not rows:
            return Frame(self.df.limit(0))
        rate, draws = 1.0, 0
        while draws < size:
            rate *= 1.2
            drawn = self.df.sample(True, rate * (size + 10) / rows, seed)
            draws = drawn.limit(size).count()
        return Frame(drawn.orderBy(*Frame(drawn)._order(seed)).limit(size))

    def _order(self, seed: int | None) -> list[Column]:
        """A random order; with a seed it rests on the rows' values alone."""
        if seed is None:
            return [F.rand()]
        values = F.to_json(F.struct(*(F.col(f"`{c}`") for c in self.df.columns)))
        return [F.xxhash64(F.lit(seed), values), values]

    def shuffle(self, seed: int | None = None) -> Frame:
        return Frame(self.df.orderBy(*self._order(seed)))

    def drop_nan(self, *cols) -> Frame:
        names = _flat(cols) or [n for n, t in self.df.dtypes if t in ("float", "double")]
        return Frame(reduce(lambda d, c: d.where(~F.isnan(col(c)) | col(c).isNull()), names, self.df))

    def drop_null(self, *cols) -> Frame:
        return Frame(self.df.dropna(subset=_flat(cols) or None))

    def explode(self, *cols, index_column: str | None = None, ignore_empty_and_null: bool = False) -> Frame:
        """List columns in step, a row for each place; shorter lists give null."""
        names = _flat(cols)
        zipped = F.arrays_zip(*(F.coalesce(F.col(f"`{c}`"), F.slice(F.col(f"`{c}`"), 1, 0), F.array()) for c in names)) if len(names) > 1 else F.transform(F.col(f"`{names[0]}`"), lambda x: F.struct(x.alias("0")))
        out = self.df.select("*", (F.posexplode if ignore_empty_and_null else F.posexplode_outer)(zipped).alias("__at", "__v"))
        fields = [f.name for f in out.schema["__v"].dataType.fields]
        new = [F.col(f"__v.`{fields[names.index(c)]}`").alias(c) if c in names else F.col(f"`{c}`") for c in self.df.columns]
        return Frame(out.select(*new, *([F.col("__at").cast("long").alias(index_column)] if index_column else [])))

    def unpivot(self, ids, values=None, variable_name: str = "variable", value_name: str = "value") -> Frame:
        ids = _flat([ids])
        return Frame(self.df.unpivot(ids, _flat([values]) if values else [c for c in self.df.columns if c not in ids], variable_name, value_name))

    melt = unpivot

    def pivot(self, group_by, pivot_col: str, value_col: str, agg_fn: str, names: list | None = None) -> Frame:
        return Frame(self.df.groupBy(*map(col, _flat([group_by]))).pivot(pivot_col, names).agg(_AGGREGATES[{"list": "list_agg"}.get(agg_fn, agg_fn)](value_col)))

    def monotonically_increasing_id(self, name: str = "id") -> Frame:
        return Frame(self.df.select(F.monotonically_increasing_id().alias(name), "*"))

    add_monotonically_increasing_id = monotonically_increasing_id

    # Aggregation.

    def groupby(self, *keys) -> Grouped:
        return Grouped(self, _flat(keys))

    def agg(self, *exprs, **named: Column) -> Frame:
        return Frame(self.df.agg(*_flat(exprs), *(c.alias(n) for n, c in named.items())))

    def rollup(self, *keys) -> Frame:
        return _Sets(self, _flat(keys), "rollup")

    def cube(self, *keys) -> Frame:
        return _Sets(self, _flat(keys), "cube")

    def agg_list(self, *cols) -> Frame:
        return self.agg(*(agg_functions.list_agg(c).alias(c) for c in _flat(cols)))

    def agg_set(self, *cols) -> Frame:
        return self.agg(*(agg_functions.list_agg_distinct(c).alias(c) for c in _flat(cols)))

    def agg_concat(self, *cols, delimiter: str = "") -> Frame:
        kinds = dict(self.df.dtypes)
        return self.agg(*((agg_functions.list_concat_agg(c) if kinds[c].startswith("array") else agg_functions.string_agg(c, delimiter)).alias(c) for c in _flat(cols)))

    def count_rows(self) -> int:
        """Runs the plan."""
        return self.df.count()

    # Two frames.

    def join(self, other: Frame, on=None, **kw) -> Frame:
        return Frame(joins.join(self.df, other.df, on, **kw))

    def join_asof(self, other: Frame, on=None, **kw) -> Frame:
        return Frame(joins.join_asof(self.df, other.df, on, **kw))

    def concat(self, other: Frame) -> Frame:
        if self.df.dtypes != other.df.dtypes:
            raise ValueError(f"unlike schemas: {self.df.dtypes} and {other.df.dtypes}")
        return Frame(self.df.union(other.df))

    def union(self, other: Frame) -> Frame:
        return Frame(self.df.union(other.df).distinct())

    def union_all(self, other: Frame) -> Frame:
        return Frame(self.df.union(other.df))

    def union_by_name(self, other: Frame) -> Frame:
        return Frame(self.df.unionByName(other.df, allowMissingColumns=True).distinct())

    def union_all_by_name(self, other: Frame) -> Frame:
        return Frame(self.df.unionByName(other.df, allowMissingColumns=True))

    def intersect(self, other: Frame) -> Frame:
        return Frame(self.df.intersect(other.df))

    def intersect_all(self, other: Frame) -> Frame:
        return Frame(self.df.intersectAll(other.df))

    def except_distinct(self, other: Frame) -> Frame:
        return Frame(self.df.subtract(other.df))

    def except_all(self, other: Frame) -> Frame:
        return Frame(self.df.exceptAll(other.df))

    def checkpointed(self, store: sinks.CheckpointStore, key: str) -> Frame:
        """Rows whose key no finished run of ``store`` has; see there how a run is finished."""
        return Frame(store.unseen(self.df, key))

    def to_ray_dataset(self):
        """Needs the ray package."""
        import ray

        return ray.data.from_arrow(self.to_arrow())

    def to_dask_dataframe(self, npartitions: int = 8):
        """Needs the dask package."""
        import dask.dataframe as dd

        return dd.from_pandas(self.to_pandas(), npartitions=npartitions)

    def skip_existing(self, existing: Frame | str, key_column, file_format: str = "parquet") -> Frame:
        """Rows whose key an earlier result hasn't; null keys stay."""
        keys = _flat([key_column])
        seen = self.spark.read.format(file_format).load(existing) if isinstance(existing, str) else existing.df
        return Frame(self.df.join(seen.select(*keys).distinct(), keys, "left_anti"))

    # Layout.

    def repartition(self, num: int | None, *by) -> Frame:
        args = [*([num] if num else []), *map(col, by)]
        return Frame(self.df.repartition(*args))

    def into_partitions(self, num: int) -> Frame:
        return Frame(self.df.coalesce(num) if num <= self.df.rdd.getNumPartitions() else self.df.repartition(num))

    def into_batches(self, size: int) -> Frame:
        """This frame, whose ``map_batches`` sees ``size`` rows at once, the last of a partition aside."""
        out = Frame(self.df)
        out.batch_rows = size
        return out

    def map_batches(self, f: Callable, schema: str | None = None) -> Frame:
        """f(Arrow batch) -> Arrow batch, for batches of the size that ``into_batches`` gave, or Spark's."""
        size = self.batch_rows

        def run(batches):
            for batch in rebatched(batches, size) if size else batches:
                yield f(batch)

        return Frame(self.df.mapInArrow(run, schema or self.df.schema))

    def shard(self, world_size: int, rank: int) -> Frame:
        """The rows of every world_size-th file."""
        path = F.col("_metadata.file_path")
        return Frame(self.df.where(F.pmod(F.xxhash64(path), F.lit(world_size)) == rank))

    # Results; these run the plan.

    def collect(self) -> Frame:
        self.df.cache().count()
        self.collected = True
        return self

    @property
    def metrics(self) -> Frame:
        """What Spark counted for each operator of the plan while ``collect`` ran it: rows, bytes, files, times."""
        if not self.collected:
            raise ValueError("no metrics before collect()")
        return Frame(self.spark.createDataFrame(runs.metrics(self.df), "id int, operator string, metric string, value long"))

    @property
    def skipped_corrupt_files(self) -> list[tuple[str, str, bool]]:
        """(path, reason, whether rows came before the fault) of this frame's files that can't be read to
        their end, which a reader with ``ignore_corrupt_files`` skips; Spark only logs them, so this reads the files again."""
        if not self.collected:
            raise ValueError("skipped files are unknown before collect()")
        return runs.unreadable(self.df)

    def show(self, n: int = 8) -> None:
        self.df.show(n)

    def to_pandas(self):
        return self.df.toPandas()

    def to_arrow(self):
        return self.df.toArrow()

    def to_pydict(self) -> dict:
        return self.df.toArrow().to_pydict()

    def to_pylist(self) -> list[dict]:
        return self.df.toArrow().to_pylist()

    def iter_rows(self) -> Iterator[dict]:
        return (r.asDict(recursive=True) for r in self.df.toLocalIterator(prefetchPartitions=True))

    def to_arrow_iter(self, results_buffer_rows: int = 10_000):
        """Arrow batches, one partition after the other; the driver holds one at a time."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.df.schema), []
        for r in self.df.toLocalIterator(prefetchPartitions=True):
            rows.append(r.asDict(recursive=True))
            if len(rows) == results_buffer_rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def iter_partitions(self) -> Iterator[list]:
        """The rows of one partition after the other."""
        at, rows = None, []
        for r in self.df.withColumn("__p", F.spark_partition_id()).toLocalIterator():
            if at is not None and r["__p"] != at:
                yield rows
                rows = []
            at = r["__p"]
            rows.append({k: v for k, v in r.asDict(recursive=True).items() if k != "__p"})
        if rows:
            yield rows

    def to_torch_map_dataset(self):
        from torch.utils.data import Dataset

        rows = self.to_pylist()

        class Rows(Dataset):
            def __len__(self) -> int:
                return len(rows)

            def __getitem__(self, k: int) -> dict:
                return rows[k]

        return Rows()

    def to_torch_iter_dataset(self):
        from torch.utils.data import IterableDataset

        frame = self

        class Rows(IterableDataset):
            def __iter__(self):
                return frame.iter_rows()

        return Rows()

    def to_torch_dataloader(self, batch_size: int = 1, **kw):
        from torch.utils.data import DataLoader

        return DataLoader(self.to_torch_iter_dataset(), batch_size=batch_size, **kw)

    def write_parquet(self, path: str, **kw) -> Frame:
        return Frame(sinks.write_files(self.df, path, "parquet", **kw))

    def write_csv(self, path: str, **kw) -> Frame:
        return Frame(sinks.write_files(self.df, path, "csv", **{"header": True} | kw))

    def write_json(self, path: str, **kw) -> Frame:
        return Frame(sinks.write_files(self.df, path, "json", **kw))

    def write_sql(self, table_name: str, url: str, write_mode: str = "append", **options) -> None:
        self.df.write.mode(write_mode).options(**options).jdbc(url, table_name)

    def write_clickhouse(self, table: str, url: str, **options) -> None:
        self.write_sql(table, url, **options)

    def write_sink(self, sink: sinks.Sink) -> Frame:
        return Frame(sinks.write_sink(self.df, sink))

    def write_turbopuffer(self, namespace: str, **options) -> Frame:
        """Options of the store's sink in ``operators/hosted.py``, as for the next two."""
        return self.write_sink(hosted.TurbopufferSink(namespace, **options))

    def write_bigtable(self, project_id: str, instance_id: str, table_id: str, row_key_column: str, column_family_mappings: dict[str, str], **options) -> Frame:
        return self.write_sink(hosted.BigtableSink(project_id, instance_id, table_id, row_key_column, column_family_mappings, **options))

    def write_huggingface(self, repo: str, **options) -> Frame:
        return self.write_sink(hosted.HuggingFaceSink(repo, **options))

    def write_table(self, table: str, mode: str = "append") -> None:
        to = self.df.writeTo(table)
        to.append() if mode == "append" else to.createOrReplace()

    write_iceberg = write_table

    def write_deltalake(self, path: str, mode: str = "append", partition_cols=(), **options) -> None:
        """Needs the connector's jar, as do the next ones."""
        self.df.write.format("delta").mode(mode).partitionBy(*partition_cols).options(**options).save(path)

    def write_paimon(self, path: str, mode: str = "append", **options) -> None:
        self.df.write.format("paimon").mode(mode).options(**options).save(path)

    def write_lance(self, path: str, mode: str = "append", **options) -> None:
        self.df.write.format("lance").mode(mode).options(**options).save(path)


class _Sets(Grouped):
    def __init__(self, frame: Frame, keys: list, kind: str):
        super().__init__(frame, keys)
        self.kind = kind

    def agg(self, *exprs, **named: Column) -> Frame:
        grouped = getattr(self.frame.df, self.kind)(*map(col, self.keys))
        return Frame(grouped.agg(*_flat(exprs), *(c.alias(n) for n, c in named.items())))


def _aggregate_method(name: str, f: Callable):
    def on_frame(self, *cols, **kw) -> Frame:
        if name == "count" and not cols:
            return Frame(self.df.agg(F.count(F.lit(1)).alias("count")))
        return self.agg(*(f(c, **kw).alias(c) for c in _flat(cols) or self.column_names))

    def on_group(self, *cols, **kw) -> Frame:
        return self._each(lambda c: f(c, **kw), cols)

    return on_frame, on_group


for _name, _f in _AGGREGATES.items():
    _on_frame, _on_group = _aggregate_method(_name, _f)
    setattr(Frame, _name, _on_frame)
    setattr(Grouped, _name, _on_group)
