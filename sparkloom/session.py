"""Session: SQL over frames, catalogs, tables and functions."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.frame import Frame


def dialect(sql: str) -> str:
    """The engine's SQL as Spark's, outside of quotes: ``//`` is integer division,
    and ORDER BY puts nulls last going up and first going down."""
    quoted: list[str] = []

    def hold(m: re.Match) -> str:
        quoted.append(f"`{m[0][1:-1]}`" if m[0][0] == '"' else m[0])
        return f"\0{len(quoted) - 1}\0"

    text = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", hold, sql).replace("//", " div ")
    text = re.sub(r"\*\s+exclude\s*\(", "* EXCEPT (", text, flags=re.I)
    text = re.sub(r"\*\s+exclude\s+([\w.`\0]+)", r"* EXCEPT (\1)", text, flags=re.I)
    return re.sub("\0(\\d+)\0", lambda m: quoted[int(m[1])], _order_nulls(text))


_READ = r"\bread_(parquet|csv|json|text|iceberg|deltalake)\s*\(\s*'([^']*)'\s*\)|\b(from|join)\s+'([^']*\.(parquet|csv|json|jsonl|ndjson))'"

#: Functions of the library whose name or meaning Spark's SQL hasn't: name, parameters, type and body.  Places start at 0.
SQL_FUNCTIONS = (
    ("find", "s STRING, sub STRING", "INT", "instr(s, sub) - 1"),
    ("strip", "s STRING", "STRING", r"regexp_replace(s, '^\\s+|\\s+$', '')"),
    ("lstrip", "s STRING", "STRING", r"regexp_replace(s, '^\\s+', '')"),
    ("rstrip", "s STRING", "STRING", r"regexp_replace(s, '\\s+$', '')"),
    ("capitalize", "s STRING", "STRING", "concat(upper(left(s, 1)), lower(substring(s, 2)))"),
    ("length_bytes", "s STRING", "INT", "octet_length(s)"),
    ("count_matches", "s STRING, sub STRING", "INT", "(char_length(s) - char_length(replace(s, sub, ''))) div char_length(sub)"),
    ("levenshtein_distance", "a STRING, b STRING", "INT", "levenshtein(a, b)"),
    ("regexp_split", "s STRING, pattern STRING", "ARRAY<STRING>", "split(s, pattern)"),
    ("list_count", "l ARRAY<STRING>", "INT", "size(filter(l, x -> x IS NOT NULL))"),
    ("list_join", "l ARRAY<STRING>, delimiter STRING", "STRING", "array_join(l, delimiter)"),
    ("list_contains", "l ARRAY<STRING>, item STRING", "BOOLEAN", "array_contains(l, item)"),
    ("list_distinct", "l ARRAY<STRING>", "ARRAY<STRING>", "array_distinct(array_compact(l))"),
    ("list_sum", "l ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(filter(l, x -> x IS NOT NULL)) > 0 THEN aggregate(l, 0D, (a, x) -> a + coalesce(x, 0D)) END"),
    ("list_mean", "l ARRAY<DOUBLE>", "DOUBLE", "aggregate(l, 0D, (a, x) -> a + coalesce(x, 0D)) / nullif(size(filter(l, x -> x IS NOT NULL)), 0)"),
    ("list_min", "l ARRAY<DOUBLE>", "DOUBLE", "array_min(l)"),
    ("list_max", "l ARRAY<DOUBLE>", "DOUBLE", "array_max(l)"),
    ("clip", "x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN x IS NOT NULL THEN least(greatest(x, low), high) END"),
    ("arcsin", "x DOUBLE", "DOUBLE", "asin(x)"),
    ("arccos", "x DOUBLE", "DOUBLE", "acos(x)"),
    ("arctan", "x DOUBLE", "DOUBLE", "atan(x)"),
    ("shift_left", "x BIGINT, n INT", "BIGINT", "shiftleft(x, n)"),
    ("shift_right", "x BIGINT, n INT", "BIGINT", "shiftright(x, n)"),
    ("bitwise_and", "a BIGINT, b BIGINT", "BIGINT", "a & b"),
    ("bitwise_or", "a BIGINT, b BIGINT", "BIGINT", "a | b"),
    ("bitwise_xor", "a BIGINT, b BIGINT", "BIGINT", "a ^ b"),
    ("fill_nan", "x DOUBLE, y DOUBLE", "DOUBLE", "nanvl(x, y)"),
    ("is_nan", "x DOUBLE", "BOOLEAN", "CASE WHEN x IS NOT NULL THEN isnan(x) END"),
    ("is_inf", "x DOUBLE", "BOOLEAN", "abs(x) = double('infinity')"),
    ("day_of_week", "t TIMESTAMP_NTZ", "INT", "weekday(t)"),
    ("day_of_month", "t TIMESTAMP_NTZ", "INT", "dayofmonth(t)"),
    ("day_of_year", "t TIMESTAMP_NTZ", "INT", "dayofyear(t)"),
    ("week_of_year", "t TIMESTAMP_NTZ", "INT", "weekofyear(t)"),
    ("partition_days", "t TIMESTAMP_NTZ", "DATE", "to_date(t)"),
    ("partition_months", "t TIMESTAMP_NTZ", "INT", "(year(t) - 1970) * 12 + month(t) - 1"),
    ("partition_years", "t TIMESTAMP_NTZ", "INT", "year(t) - 1970"),
    ("great_circle_distance", "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", "DOUBLE", "2 * 6371008.8 * asin(sqrt(least(1D, pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))"),
)


_STOP = re.compile(r"\b(limit|offset|rows|range|union|intersect|except|having|fetch)\b", re.I)


def _order_nulls(sql: str) -> str:
    """Spell the place of nulls for every key of every ORDER BY that doesn't; quoted parts are held out."""
    out, at = [], 0
    for m in re.finditer(r"\border\s+by\b", sql, re.I):
        if m.start() < at:
            continue
        out.append(sql[at : m.end()])
        k, depth, keys, start = m.end(), 0, [], m.end()
        while k < len(sql):
            c = sql[k]
            if c == "(":
                depth += 1
            elif c == ")":
                if not depth:
                    break
                depth -= 1
            elif c == "," and not depth:
                keys.append(sql[start:k])
                start = k + 1
            elif not depth and c.isalpha() and (k == 0 or not (sql[k - 1].isalnum() or sql[k - 1] in "_.`")) and _STOP.match(sql, k):
                break
            elif c == ";":
                break
            k += 1
        keys.append(sql[start:k])
        out.append(",".join(x if re.search(r"\bnulls\s+(first|last)\b", x, re.I) else f"{x.rstrip()} NULLS {'FIRST' if re.search(r'\bdesc\s*$', x.strip(), re.I) else 'LAST'} " for x in keys))
        at = k
    return "".join([*out, sql[at:]])


class Table:
    """A table of a session by name; reads are lazy, writes run."""

    def __init__(self, session: Session, name: str):
        self.session, self.name = session, name

    def schema(self):
        return self.session.spark.table(self.name).schema

    def read(self, **options) -> Frame:
        return Frame(self.session.spark.read.options(**options).table(self.name))

    def select(self, *columns) -> Frame:
        return self.read().select(*columns)

    def show(self, n: int = 8) -> None:
        self.read().show(n)

    def write(self, f: Frame | DataFrame, mode: str = "append", **options) -> None:
        """Columns meet by name, as the table has them; a view can't be written to."""
        if mode not in ("append", "overwrite"):
            raise ValueError(f"mode {mode}: append or overwrite")
        df = f.df if isinstance(f, Frame) else f
        df = df.select(*(F.col(f"`{c}`") for c in self.schema().names))
        df.write.options(**options).insertInto(self.name, overwrite=mode == "overwrite")

    def append(self, f: Frame | DataFrame, **options) -> None:
        self.write(f, "append", **options)

    def overwrite(self, f: Frame | DataFrame, **options) -> None:
        self.write(f, "overwrite", **options)


class Session:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def sql(self, query: str, **frames: Frame | DataFrame) -> Frame:
        """Run the engine's SQL; frames given by name are tables of the query."""
        for name, f in frames.items():
            self.create_temp_table(name, f)
        return Frame(self.spark.sql(dialect(self._with_sources(query))))

    def _with_sources(self, query: str) -> str:
        """``read_csv('path')`` and ``FROM 'path.parquet'`` as views over the readers."""
        from sparkloom.sources import readers

        if not re.search(_READ, query, re.I):
            return query

        def view(m: re.Match) -> str:
            kind, path = (m[1], m[2]) if m[1] else (m[5], m[4])
            kind = {"jsonl": "json", "ndjson": "json"}.get(kind.lower(), kind.lower())
            name = f"loom_{kind}_{uuid.uuid4().hex}"
            self.create_temp_table(name, getattr(readers, f"read_{kind}")(self.spark, path))
            return name if m[1] else f"{m[3]} {name}"

        return re.sub(_READ, view, query, flags=re.I)

    def attach_library(self) -> list[str]:
        """Make the library's functions callable by name in SQL (temporary SQL functions, inlined by the optimiser)."""
        for name, params, kind, body in SQL_FUNCTIONS:
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
        return [f[0] for f in SQL_FUNCTIONS]

    def detach_function(self, name: str) -> None:
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    def sql_expr(self, text: str):
        return F.expr(dialect(text))

    # Tables.

    def create_temp_table(self, name: str, f: Frame | DataFrame) -> None:
        (f.df if isinstance(f, Frame) else f).createOrReplaceTempView(name)

    create_temp_view = attach_table = attach_view = create_temp_table

    def create_table(self, name: str, f: Frame, **options) -> None:
        f.df.write.options(**options).saveAsTable(name)

    def drop_table(self, name: str) -> None:
        if not self.spark.catalog.dropTempView(name):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    detach_table = drop_table

    def read_table(self, name: str) -> Frame:
        return Frame(self.spark.table(name))

    table = read_table

    def get_table(self, name: str) -> Table:
        if not self.has_table(name):
            raise ValueError(f"no table {name}")
        return Table(self, name)

    def create_table_if_not_exists(self, name: str, f: Frame, **options) -> Table:
        if not self.has_table(name):
            self.create_table(name, f, **options)
        return Table(self, name)

    def write_table(self, name: str, f: Frame, mode: str = "append") -> None:
        f.df.write.mode(mode).saveAsTable(name)

    def list_tables(self, pattern: str | None = None) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(pattern=pattern))

    def has_table(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    # Namespaces and catalogs.

    def create_namespace(self, name: str) -> None:
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name}")

    def drop_namespace(self, name: str) -> None:
        self.spark.sql(f"DROP NAMESPACE IF EXISTS {name}")

    def list_namespaces(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def has_namespace(self, name: str) -> bool:
        return self.spark.catalog.databaseExists(name)

    def attach_catalog(self, name: str, implementation: str, **options: str) -> None:
        self.spark.conf.set(f"spark.sql.catalog.{name}", implementation)
        for k, v in options.items():
            self.spark.conf.set(f"spark.sql.catalog.{name}.{k}", v)

    def detach_catalog(self, name: str) -> None:
        self.spark.conf.unset(f"spark.sql.catalog.{name}")

    def set_catalog(self, name: str) -> None:
        self.spark.catalog.setCurrentCatalog(name)

    def current_catalog(self) -> str:
        return self.spark.catalog.currentCatalog()

    def list_catalogs(self) -> list[str]:
        return sorted(c.name for c in self.spark.catalog.listCatalogs())

    def set_namespace(self, name: str) -> None:
        self.spark.catalog.setCurrentDatabase(name)

    use = set_namespace

    def current_namespace(self) -> str:
        return self.spark.catalog.currentDatabase()

    # Functions and settings.

    def attach_function(self, name: str, f, return_type: str | None = None) -> None:
        self.spark.udf.register(name, f, return_type) if return_type else self.spark.udf.register(name, f)

    def set_config(self, **settings) -> None:
        for k, v in settings.items():
            self.spark.conf.set(k.replace("__", "."), v)


def sql(spark: SparkSession, query: str, **frames) -> Frame:
    return Session(spark).sql(query, **frames)
