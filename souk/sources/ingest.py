"""Raw-file ingestion and data-quality checks.

Loading follows the reference's two steps: read every column as text, then
convert to the target types. Conversion uses ``try_cast`` so a bad value
becomes NULL and is *counted* (``cast_failures``) instead of failing the job.
Constraints the reference declares in the database (primary and foreign keys)
become distributed checks that report violations.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.operators.ranks import global_row_number
from souk.session import dealt, tasks_for
from souk.sources.csv_records import load_csv

# ---- fixed values: the reference schema (table -> column -> target type) -------
TYPE_SPEC: dict[str, dict[str, str]] = {
    "customers": {
        "customer_id": "string", "customer_unique_id": "string", "customer_zip_code_prefix": "int",
        "customer_city": "string", "customer_state": "string",
    },
    "geolocation": {
        "geolocation_zip_code_prefix": "int", "geolocation_lat": "decimal(9,6)", "geolocation_lng": "decimal(9,6)",
        "geolocation_city": "string", "geolocation_state": "string",
    },
    "order_items": {
        "order_id": "string", "order_item_id": "int", "product_id": "string", "seller_id": "string",
        "shipping_limit_date": "timestamp", "price": "decimal(20,3)", "freight_value": "decimal(20,3)",
    },
    "payments": {
        "order_id": "string", "payment_sequential": "int", "payment_type": "string",
        "payment_installments": "int", "payment_value": "decimal(20,3)",
    },
    "order_reviews": {
        "review_id": "string", "order_id": "string", "review_score": "int", "review_comment_title": "string",
        "review_comment_message": "string", "review_creation_date": "timestamp",
        "review_answer_timestamp": "timestamp",
    },
    "orders": {
        "order_id": "string", "customer_id": "string", "order_status": "string",
        "order_purchase_timestamp": "timestamp", "order_approved_at": "timestamp",
        "order_delivered_carrier_date": "timestamp", "order_delivered_customer_date": "timestamp",
        "order_estimated_delivery_date": "timestamp",
    },
    "products": {
        "product_id": "string", "product_category_name": "string", "product_name_lenght": "int",
        "product_description_lenght": "int", "product_photos_qty": "int", "product_weight_g": "int",
        "product_length_cm": "int", "product_height_cm": "int", "product_width_cm": "int",
    },
    "sellers": {
        "seller_id": "string", "seller_zip_code_prefix": "int", "seller_city": "string", "seller_state": "string",
    },
    "product_category_name_translation": {
        "product_category_name": "string", "product_category_name_english": "string",
    },
}
# declared relationships (child table, child column, parent table, parent column)
RELATIONSHIPS: tuple[tuple[str, str, str, str], ...] = (
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
    ("orders", "purchase_datekey", "calendar", "datekey"),
    ("orders", "approved_datekey", "calendar", "datekey"),
    ("orders", "delivered_datekey", "calendar", "datekey"),
    ("orders", "estimated_datekey", "calendar", "datekey"),
)
ORDER_DATEKEYS: dict[str, str] = {
    "order_purchase_timestamp": "purchase_datekey",
    "order_approved_at": "approved_datekey",
    "order_delivered_customer_date": "delivered_datekey",
    "order_estimated_delivery_date": "estimated_datekey",
}
MULTI_LINE_TABLES = ("order_reviews",)   # the only free text
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "payments": ("order_id", "payment_sequential"),
    "order_reviews": ("review_id",),
    "products": ("product_id",),
    "sellers": ("seller_id",),
}
# ---- end of fixed values -------------------------------------------------------


def compact_name(stem: str) -> str:
    """``<prefix>_order_items_dataset`` -> ``order_items``; ``order_payments`` -> ``payments``."""
    name = stem[: -len("_dataset")] if stem.endswith("_dataset") else stem
    known = set(TYPE_SPEC) | {"order_payments"}
    if name not in known and "_" in name and name.split("_", 1)[1] in known:
        name = name.split("_", 1)[1]
    return "payments" if name == "order_payments" else name


def load_raw(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             multi_line: bool = False) -> DataFrame:
    """Read a CSV file or folder with every column as text.

    ``multi_line`` allows quoted fields that span lines (free-text review comments): the
    records are put together from the lines of all file splits (``csv_records``), so
    such a file is read by as many tasks as any other.
    With ``columns`` the header is not inferred; the schema is all-string.
    """
    if multi_line:
        return load_csv(spark, path, columns)
    reader = spark.read.option("header", True).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        reader = reader.option("inferSchema", False)
    return reader.csv(path)


def normalise(raw: DataFrame, spec: Mapping[str, str], blank_to_null: bool = True,
              min_valid_ts: str | None = None) -> DataFrame:
    """T3 (+T8): one ``select`` of ``try_cast`` per column.

    ``blank_to_null`` turns whitespace-only text into NULL before casting (the
    reference keeps blanks, e.g. empty category names); ``min_valid_ts`` nulls
    timestamps before that instant (sentinel dates such as 1900-01-01).
    """
    out = []
    for name in raw.columns:
        c = F.col(name)
        if blank_to_null:
            c = F.when(F.trim(c) != "", c)
        target = spec.get(name, "string")
        typed = c.try_cast(target) if target != "string" else c
        if min_valid_ts is not None and target == "timestamp":
            typed = null_before(typed, min_valid_ts)
        out.append(typed.alias(name))
    return raw.select(*out)


def null_before(c: Column, instant: str) -> Column:
    """``UPDATE ... SET c = NULL WHERE c < instant`` as an expression."""
    return F.when(c >= F.lit(instant).cast("timestamp"), c)


def cast_failures(raw: DataFrame, spec: Mapping[str, str], table: str) -> DataFrame:
    """Per column: non-empty raw values, values after the cast, and the difference.

    One scan counts both; the result has one row per column.
    """
    cols = [c for c in raw.columns if c in spec]
    cast = {c: F.when(F.trim(c) != "", F.col(c)) for c in cols}
    counts = raw.agg(*[F.count(cast[c]).alias(f"r{i}") for i, c in enumerate(cols)],
                     *[F.count(cast[c].try_cast(spec[c])).alias(f"t{i}") for i, c in enumerate(cols)])
    rows = ", ".join(f"'{c}', '{spec[c]}', r{i}, t{i}" for i, c in enumerate(cols))
    return counts.selectExpr(f"stack({len(cols)}, {rows}) as (column_name, target_type, raw_values, typed_values)") \
        .select(F.lit(table).alias("table_name"), "column_name", "target_type", "raw_values", "typed_values",
                (F.col("raw_values") - F.col("typed_values")).alias("failed_casts"))


def load_typed(raw: DataFrame, spec: Mapping[str, str], table: str, path: str,
               min_valid_ts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """T3, T7, T8 in the pass that loads: convert ``raw``, store it at ``path``, and count while
    the rows go by (``DataFrame.observe``), so no check reads the table again.

    -> the stored table, and a profile with a row per column: table_name, column_name,
       target_type, raw_values, typed_values, failed_casts, min_value, max_value (timestamps
       after cleanup, as text; NULL for other types). The metrics are those of the completed
       write: what a failed attempt of a task counted is not among them.
    """
    cols = [c for c in raw.columns if c in spec]
    typed = normalise(raw, spec, min_valid_ts=min_valid_ts)
    fmt = "yyyy-MM-dd HH:mm:ss"
    seen = Observation(f"load of {table}")
    metrics = []
    both = raw.select(*[F.when(F.trim(c) != "", F.col(c)).alias(f"__raw_{i}") for i, c in enumerate(cols)], "*")
    for i, c in enumerate(cols):
        text = F.col(f"__raw_{i}")
        metrics += [F.count(text).alias(f"r{i}"),
                    F.count(text.try_cast(spec[c]) if spec[c] != "string" else text).alias(f"t{i}")]
        if spec[c] == "timestamp":
            when = text.try_cast("timestamp")
            when = null_before(when, min_valid_ts) if min_valid_ts is not None else when
            metrics += [F.date_format(F.min(when), fmt).alias(f"a{i}"), F.date_format(F.max(when), fmt).alias(f"z{i}")]
    normalise(both.observe(seen, *metrics).drop(*[f"__raw_{i}" for i in range(len(cols))]), spec,
              min_valid_ts=min_valid_ts).write.parquet(path)
    got = seen.get
    rows = [(table, c, spec[c], got[f"r{i}"], got[f"t{i}"], got[f"r{i}"] - got[f"t{i}"], got.get(f"a{i}"), got.get(f"z{i}"))
            for i, c in enumerate(cols)]
    spark = raw.sparkSession
    profile = spark.createDataFrame(
        rows, "table_name string, column_name string, target_type string, raw_values long, typed_values long, "
              "failed_casts long, min_value string, max_value string")
    return spark.read.schema(typed.schema).parquet(path), profile


def schema_report(df: DataFrame, table: str) -> list[tuple[str, str, str, bool]]:
    """T4: (table, column, type, nullable) from the DataFrame schema (metadata only)."""
    return [(table, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]


def column_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """T4 with counts: every column of every table, its type, rows and NULLs; one scan a table.

    -> table_name, position, column_name, data_type, row_count, null_count
    """
    out = None
    for table, df in tables.items():
        fields = list(df.schema.fields)
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}")
                                                        for i, f in enumerate(fields)])
        rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"),
                                  F.lit(f.dataType.simpleString()).alias("data_type"), F.col("n").alias("row_count"),
                                  (F.col("n") - F.col(f"c{i}")).alias("null_count")) for i, f in enumerate(fields)])
        part = counts.select(F.lit(table).alias("table_name"), F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out


def preview(df: DataFrame, n: int = 10, order: Sequence[str] = ()) -> DataFrame:
    """T5, O3: ``SELECT TOP n *``: any n rows, or the first n in the order of some columns (each
    task keeps n rows; nothing is sorted as a whole)."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def date_range_profile(columns: Iterable[tuple[str, DataFrame, str]]) -> DataFrame:
    """Min and max of each (table, frame, timestamp column), one row per column.

    Columns of the same frame share one global aggregate (one scan, partial
    min/max per task); the per-table rows are unpivoted with ``stack``.
    """
    groups: dict[int, tuple[str, DataFrame, list[str]]] = {}
    for table, df, col in columns:
        groups.setdefault(id(df), (table, df, []))[2].append(col)
    fmt = "yyyy-MM-dd HH:mm:ss"
    parts = []
    for table, df, cols in groups.values():
        agg = df.agg(*[F.date_format(F.min(c), fmt).alias(f"__min{i}") for i, c in enumerate(cols)],
                     *[F.date_format(F.max(c), fmt).alias(f"__max{i}") for i, c in enumerate(cols)])
        pairs = ", ".join(f"'{c}', __min{i}, __max{i}" for i, c in enumerate(cols))
        parts.append(agg.selectExpr(f"'{table}' as table_name",
                                    f"stack({len(cols)}, {pairs}) as (column_name, min_value, max_value)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _key_text(cols: Sequence[str]) -> Column:
    """A key as one text (NULL if a part is), the same for equal values and for no others."""
    if len(cols) == 1:
        return F.col(cols[0]).cast("string")
    parts = [F.col(c).cast("string") for c in cols]
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def key_counts(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] = PRIMARY_KEYS,
               relationships: Sequence[tuple[str, str, str, str]] = RELATIONSHIPS,
               sizes: Mapping[str, int] | None = None, in_parts: Collection[str] = ()) -> DataFrame:
    """T12, T13, T15 in one pass over the tables: every declared key and relationship.

    A table is read once, and its key columns are dealt into parts of a bounded number of rows (but
    for the tables ``in_parts``, which come so). A row gives, for each key domain it takes part in, a
    row ``(domain, key, role)``: role 0 is the key's own table, the others are its children. They are
    counted per (domain, key, task that held them), then per (domain, key), so a key that a third of
    all children name costs a row per task. Both times the rows are dealt into as many parts as
    ``sizes`` (rows of each table, or a bound; counted if not given) call for: what a task holds
    does not grow with the tables. One row of sums per task then counts the domains. A domain is a
    table with its key columns, so orders' primary key and its children are one.
    -> domain ("table(columns)"), duplicate_keys, rows_in_duplicate_keys, null_keys,
       orphans (array: orphan rows of each child, in the order of ``relationships``)
    """
    domains: dict[tuple[str, tuple[str, ...]], list[tuple[str, str]]] = {
        (t, tuple(cols)): [] for t, cols in keys.items() if t in tables}
    for child_t, child_c, parent_t, parent_c in relationships:
        if child_t in tables and parent_t in tables:
            domains.setdefault((parent_t, (parent_c,)), []).append((child_t, child_c))
    roles: dict[str, list[tuple[int, int, Sequence[str]]]] = {}
    for d, ((table, cols), children) in enumerate(domains.items()):
        roles.setdefault(table, []).append((d, 0, cols))
        for r, (child, col) in enumerate(children, 1):
            roles.setdefault(child, []).append((d, r, (col,)))
    sizes = {t: (sizes or {})[t] if t in (sizes or {}) else tables[t].count() for t in roles}
    rows = None
    for table, some in roles.items():
        short = {c: f"c{i}" for i, c in enumerate(dict.fromkeys(c for _, _, cols in some for c in cols))}
        keyed = tables[table].select(*[F.col(c).alias(name) for c, name in short.items()])
        keyed = keyed if table in in_parts else dealt(keyed, sizes[table])
        every = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(r).alias("role"),
                                   _key_text([short[c] for c in cols]).alias("key")) for d, r, cols in some])
        part = keyed.select(F.explode(every).alias("k")).select("k.d", "k.role", "k.key") \
            .where((F.col("role") == 0) | F.col("key").isNotNull())     # a NULL reference is no orphan
        rows = part if rows is None else rows.unionByName(part)
    most = max(map(len, domains.values()), default=0)
    parts = tasks_for(rows, sum(len(some) * sizes[t] for t, some in roles.items()))
    per_reader = rows.withColumn("reader", F.spark_partition_id()).repartition(parts, "d", "key", "reader") \
        .groupBy("d", "key", "reader").agg(*[F.count(F.when(F.col("role") == r, 1)).alias(f"n{r}")
                                             for r in range(most + 1)])
    per_key = per_reader.repartition(parts, "d", "key").groupBy("d", "key").agg(
        *[F.sum(f"n{r}").alias(f"n{r}") for r in range(most + 1)])
    own, null = F.col("n0"), F.col("key").isNull()
    twice = ~null & (own > 1)
    sums, lines = [], []
    for d, children in enumerate(domains.values()):
        here = F.col("d") == d
        sums += [F.count(F.when(here & twice, 1)).alias(f"k{d}"), F.sum(F.when(here & twice, own)).alias(f"t{d}"),
                 F.sum(F.when(here & null, own)).alias(f"z{d}"),
                 *[F.sum(F.when(here & (own == 0), F.col(f"n{r}"))).alias(f"o{d}_{r}") for r, _ in enumerate(children, 1)]]
        lines.append(F.struct(
            F.lit(d).alias("d"), F.col(f"k{d}").alias("duplicate_keys"), F.col(f"t{d}").alias("rows_in_duplicate_keys"),
            F.col(f"z{d}").alias("null_keys"),
            *[(F.col(f"o{d}_{r}") if r <= len(children) else F.lit(None).cast("long")).alias(f"o{r}")
              for r in range(1, most + 1)]))
    counts = F.broadcast(per_key.agg(*sums).select(F.inline(F.array(*lines))))      # a row per domain
    # a domain of an empty table without children has no rows, yet a line in the report
    names = tables[next(iter(tables))].sparkSession.createDataFrame(
        [(d, f"{t}({','.join(cols)})") for d, (t, cols) in enumerate(domains)], "d int, domain string")
    zero = F.lit(0).cast("long")
    return names.join(counts, "d", "left").select(
        "domain", *[F.coalesce(c, zero).alias(c) for c in ("duplicate_keys", "rows_in_duplicate_keys", "null_keys")],
        F.array(*[F.coalesce(f"o{r}", zero) for r in range(1, most + 1)]).cast("array<bigint>").alias("orphans"))


def key_violations(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] = PRIMARY_KEYS,
                   counts: DataFrame | None = None, sizes: Mapping[str, int] | None = None,
                   in_parts: Collection[str] = ()) -> DataFrame:
    """Per table, keys that occur more than once and keys with a NULL part; ``counts`` is a
    stored :func:`key_counts`, if there is one, ``sizes`` and ``in_parts`` as there.

    -> table_name, key_columns, duplicate_keys, rows_in_duplicate_keys, null_keys
    """
    known = {t: cols for t, cols in keys.items() if t in tables}
    found = key_counts(tables, known, (), sizes, in_parts) if counts is None else counts
    wanted = [f"{t}({','.join(cols)})" for t, cols in known.items()]
    return found.where(F.col("domain").isin(wanted)).select(
        F.substring_index("domain", "(", 1).alias("table_name"),
        F.regexp_extract("domain", r"\((.*)\)", 1).alias("key_columns"),
        "duplicate_keys", "rows_in_duplicate_keys", "null_keys")


def orphans(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent (a ``left_anti`` join)."""
    keys = parent.select(F.col(parent_col).alias("__k"))
    return child.where(F.col(child_col).isNotNull()).join(keys, F.col(child_col) == F.col("__k"), "left_anti")


def foreign_key_report(tables: Mapping[str, DataFrame],
                       relationships: Sequence[tuple[str, str, str, str]] = RELATIONSHIPS,
                       counts: DataFrame | None = None, sizes: Mapping[str, int] | None = None,
                       in_parts: Collection[str] = ()) -> DataFrame:
    """T13 + T15: declared parent/child relationships with their orphan counts; ``counts`` is a
    stored :func:`key_counts`, if there is one, ``sizes`` and ``in_parts`` as there.

    -> child_table, child_column, parent_table, parent_column, orphan_rows
    """
    known = [r for r in relationships if r[0] in tables and r[2] in tables]
    found = key_counts(tables, {}, known, sizes, in_parts) if counts is None else counts
    place: dict[str, int] = {}
    rows = []
    for child_t, child_c, parent_t, parent_c in known:
        domain = f"{parent_t}({parent_c})"
        place[domain] = place.get(domain, 0) + 1
        rows.append((domain, place[domain], child_t, child_c, parent_t, parent_c))
    names = found.sparkSession.createDataFrame(
        rows, "domain string, r int, child_table string, child_column string, parent_table string, parent_column string")
    return names.join(found, "domain").select(
        "child_table", "child_column", "parent_table", "parent_column",
        F.element_at("orphans", F.col("r")).alias("orphan_rows"))


def add_surrogate_key(df: DataFrame, order: Sequence[str], name: str = "surrogate_key",
                      buckets: int | None = None) -> DataFrame:
    """Identity-style key 1..n in a stable order, computed bucket-wise (no single task)."""
    return global_row_number(df, [(c, True) for c in order], rn=name, total="__n", buckets=buckets).drop("__n")


def render_timestamps(df: DataFrame, fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Timestamps as text, the way result grids print them."""
    return df.select(*[
        F.date_format(F.col(f.name), fmt).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name)
        for f in df.schema.fields
    ])


__all__ = [
    "PRIMARY_KEYS", "RELATIONSHIPS", "TYPE_SPEC", "add_surrogate_key", "cast_failures", "column_profile", "compact_name",
    "date_range_profile", "foreign_key_report", "key_counts", "key_violations", "load_typed", "load_raw", "normalise", "null_before",
    "orphans", "preview", "render_timestamps", "schema_report",
]


# attribute names the operators use for each loaded table (see fixtures.Marketplace)
_STAR_ATTRS = {"orders": "orders", "customers": "customers", "order_items": "order_items",
               "payments": "payments", "products": "products",
               "product_category_name_translation": "translation", "sellers": "sellers",
               "order_reviews": "reviews", "geolocation": "geolocation"}


class StarSchema:
    """Typed tables loaded from raw files, with the attribute names operators expect."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = dict(tables)
        for name, df in tables.items():
            setattr(self, _STAR_ATTRS.get(name, name), df)


def _csv_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """File stem -> path of the CSV files (or CSV folders) in ``folder``, by Spark's file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    found = {s.getPath().getName(): s.getPath().toString() for s in status}
    return {name[:-len(".csv")]: p for name, p in sorted(found.items()) if name.lower().endswith(".csv")}


def load_star_schema(spark: SparkSession, csv_dir: str | Mapping[str, str], blank_to_null: bool = True,
                     min_valid_ts: str | None = "2000-01-01") -> StarSchema:
    """T1-T3, T8, T11 in one call: every ``*.csv`` under ``csv_dir`` -> typed star schema.

    ``csv_dir`` is a folder on any file system Spark reads, or a mapping of table names
    to paths. Files are matched to tables by ``compact_name`` of their stem; columns are
    read as text and converted with ``normalise`` (cast failures become NULL and
    can be counted with ``cast_failures``). Orders, items and reviews get their
    ``yyyyMMdd`` date keys. Lazy but for the lines of multi-line files, which are stored.
    """
    from souk.sources.calendar import add_datekeys

    tables: dict[str, DataFrame] = {}
    for stem, path in (csv_dir if isinstance(csv_dir, Mapping) else _csv_files(spark, csv_dir)).items():
        name = compact_name(stem)
        if name not in TYPE_SPEC:
            continue
        raw = load_raw(spark, path, multi_line=name in MULTI_LINE_TABLES)
        tables[name] = normalise(raw, TYPE_SPEC[name], blank_to_null=blank_to_null, min_valid_ts=min_valid_ts)
    keys = {"orders": {**ORDER_DATEKEYS, "order_delivered_carrier_date": "carrier_datekey"},
            "order_items": {"shipping_limit_date": "shipping_limit_datekey"},
            "order_reviews": {"review_creation_date": "review_creation_datekey",
                              "review_answer_timestamp": "review_answer_datekey"}}
    for name, mapping in keys.items():
        if name in tables:
            tables[name] = add_datekeys(tables[name], mapping)
    return StarSchema(tables)
