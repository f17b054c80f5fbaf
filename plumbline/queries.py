"""Registered queries over the test tables, and their DuckDB counterparts.

The target of a compare is a table's perturbed copy: rows whose key is a multiple of 10 are gone, a
string is changed where it is one of 7, and copies under key + 10^9 are added where it is one of 50.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.digest import canonical, row_hash, row_text
from .functions.predicate import to_spark
from .model import Column, ForeignKey, Schema, Table, TypeSpec
from .operators import closure, columns, compare, drift, keys, rescan, screen
from .plans import instances, ordering, rebuild, schema_diff, script, selection, sizes
from .session import CompareSession
from .sources import catalog
from .sources.catalog import ParquetDatabase
from .sources.manifest import Conflict, VersionedDatabase
from .sources.snapshot import SnapshotTable, stage, staged
from .sources.store import materialize, shared_dir

FAR = 1_000_000_000


@dataclass(frozen=True)
class Fixture:
    """A table: its key, the string column that the copy changes, its columns by type."""

    key: tuple[str, ...]
    changed: str
    columns: str  # name:type, i for whole numbers, s for text, d for doubles, t for timestamps

    @property
    def names(self) -> list[str]:
        return [c.partition(":")[0] for c in self.columns.split()]


TABLES = {
    "region": Fixture(("r_regionkey",), "r_name", "r_regionkey:i r_name:s"),
    "nation": Fixture(("n_nationkey",), "n_name", "n_nationkey:i n_name:s n_regionkey:i"),
    "customer": Fixture(("c_custkey",), "c_name", "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s"),
    "supplier": Fixture(("s_suppkey",), "s_name", "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d"),
    "part": Fixture(("p_partkey",), "p_name", "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d"),
    "orders": Fixture(("o_orderkey",), "o_orderstatus", "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s"),
    "lineitem": Fixture((), "l_returnflag", "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t"),
    "events": Fixture(("event_id",), "event_type", "event_id:i ts:t user_id:i event_type:s value:d props:s"),
    "documents": Fixture(("doc_id",), "source", "doc_id:i text:s lang:s source:s n_chars:i"),
    "pages": Fixture(("page_id",), "url", "page_id:i url:s html:s"),
    "benchmark": Fixture(("item_id",), "text", "item_id:i text:s"),
    "labels": Fixture(("doc_id",), "", "doc_id:i quality:i toxic:i"),
    "conversations": Fixture(("conv_id", "turn"), "text", "conv_id:i turn:i role:s text:s"),
}
FOREIGN_KEYS = {
    "nation": [("nation_region", "n_regionkey", "region", "r_regionkey")],
    "customer": [("customer_nation", "c_nationkey", "nation", "n_nationkey")],
    "supplier": [("supplier_nation", "s_nationkey", "nation", "n_nationkey")],
    "orders": [("orders_customer", "o_custkey", "customer", "c_custkey")],
    "lineitem": [("lineitem_orders", "l_orderkey", "orders", "o_orderkey"), ("lineitem_part", "l_partkey", "part", "p_partkey"), ("lineitem_supplier", "l_suppkey", "supplier", "s_suppkey")],
    "labels": [("labels_documents", "doc_id", "documents", "doc_id")],
}
CONSTRAINTS = {
    name: {"primary_key": list(t.key), "foreign_keys": [{"name": n, "columns": [c], "parent": p, "parent_columns": [pc]} for n, c, p, pc in FOREIGN_KEYS.get(name, [])]} for name, t in TABLES.items()
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function, under its own name unless another is given, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def perturbed(df: DataFrame, name: str) -> DataFrame:
    """The target copy of a table."""
    t = TABLES[name]
    key = t.key[0]
    changed = df.where(F.col(key) % 10 != 0)
    if t.changed:
        changed = changed.withColumn(t.changed, F.when(F.col(key) % 7 == 0, F.lit("Z")).otherwise(F.col(t.changed)))
    copies = df.where(F.col(key) % 50 == 0).withColumn(key, (F.col(key) + FAR).cast(df.schema[key].dataType))
    return changed.select(df.columns).unionByName(copies)


def perturbed_sql(name: str) -> str:
    t = TABLES[name]
    k = t.key[0]
    changed = ", ".join(f"case when {k} % 7 = 0 then 'Z' else {c} end as {c}" if c == t.changed else c for c in t.names)
    copied = ", ".join(f"{k} + {FAR} as {k}" if c == k else c for c in t.names)
    return f"(select {changed} from {name} where {k} % 10 <> 0 union all select {copied} from {name} where {k} % 50 = 0)"


def classified_sql(name: str, kind: str = "full", source: str | None = None, target: str | None = None, compared: list[str] | None = None) -> str:
    """Keys and classification, by IS DISTINCT FROM over all columns."""
    t = TABLES[name]
    on = " and ".join(f"s.{k} = t.{k}" for k in t.key)
    differs = " or ".join(f"s.{c} is distinct from t.{c}" for c in compared or t.names if c not in t.key) or "false"
    shown = ", ".join(f"coalesce(s.{k}, t.{k}) as {k}" for k in t.key)
    return f"""select {shown}, case when t.{t.key[0]} is null then 'Insert' when s.{t.key[0]} is null then 'Delete' when {differs} then 'Update' else 'Same' end as classification
from {source or name} s {kind} join {target or perturbed_sql(name)} t on {on}"""


def sides(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    source = read(spark, sf_dir, name)
    return source, perturbed(source, name)


def request(name: str, **more) -> compare.CompareRequest:
    return compare.CompareRequest(TABLES[name].key, **more)


# Compares.


@query(f"select classification, count(*) as n from ({classified_sql('orders')}) group by 1")
def cmp_orders_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.counts(compare.classify(*sides(spark, sf_dir, "orders"), request("orders")))


def _compare_rows(name: str) -> None:
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compare.classify(*sides(spark, sf_dir, name), request(name)).drop("target_hash")

    query(classified_sql(name), "cmp_conversations_composite" if name == "conversations" else f"cmp_{name}_rows")(rows)


for _name, _table in TABLES.items():
    if _table.key:
        _compare_rows(_name)


@query("select 'Same' as classification, count(*) as n from events")
def cmp_self_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return compare.counts(compare.classify(events, events, request("events")))


@query(classified_sql("orders", "left", "(select * from orders order by o_orderkey nulls first limit 100)"))
def cmp_topn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.classify(*sides(spark, sf_dir, "orders"), request("orders", mode="TopN", top=100)).drop("target_hash")


_URGENT = "o_orderpriority = '1-URGENT'"
@query(classified_sql("orders", "left", f"(select * from orders where {_URGENT})", f"(select * from {perturbed_sql('orders')} where {_URGENT})"))
def cmp_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = sides(spark, sf_dir, "orders")
    predicate = to_spark(_URGENT, source.columns)
    return compare.classify(source, target, request("orders", mode="Filter", predicate=predicate)).drop("target_hash")


#: By group of functions: a table, a filter, and what it means in SQL.
FILTERS = {
    "functions": (
        "orders",
        "LEN(o_orderpriority) >= 5 AND CHARINDEX('LOW', o_orderpriority) > 0 AND YEAR(o_orderdate) >= 1995 AND ISNULL(o_custkey, 0) % 2 = 0",
        "length(rtrim(o_orderpriority)) >= 5 and strpos(o_orderpriority, 'LOW') > 0 and year(o_orderdate) >= 1995 and coalesce(o_custkey, 0) % 2 = 0",
    ),
    "text": (
        "orders",
        "SUBSTRING(o_orderpriority, 0, 3) = N'2-' OR STUFF(o_orderpriority, 1, 2, 'x') = 'xLOW' OR REVERSE(RIGHT(o_orderpriority, 3)) = 'TNE' AND LEFT(UPPER(o_orderpriority), 1) = '1'",
        "substr(o_orderpriority, 1, 2) = '2-' or 'x' || substr(o_orderpriority, 3) = 'xLOW' or reverse(right(o_orderpriority, 3)) = 'TNE' and left(upper(o_orderpriority), 1) = '1'",
    ),
    "joined_text": (
        "customer",
        "CONCAT(LOWER(c_mktsegment), NULL, '!') LIKE 'b%!' OR CONCAT_WS('-', c_mktsegment, 'x') = REPLACE('MACHINERY+x', '+', '-') AND PATINDEX('%[5-9]', c_name) > 0 AND REPLICATE('ab', 2) = 'abab' AND LEN(SPACE(2)) = 0",
        "lower(c_mktsegment) || '!' like 'b%!' or c_mktsegment || '-x' = replace('MACHINERY+x', '+', '-') and regexp_matches(c_name, '[5-9]$')",
    ),
    "codes": (
        "nation",
        "ASCII(n_name) >= UNICODE(N'I') AND NCHAR(300) > CHAR(65) AND CHAR(ASCII(n_name)) = LEFT(n_name, 1) AND DATALENGTH(TRIM(n_name)) > 4",
        "ascii(n_name) >= 73 and octet_length(encode(trim(n_name))) > 4",
    ),
    "numbers": (
        "orders",
        "o_orderkey / 7 % 2 = 1 AND ABS(o_totalprice) > SQUARE(20) AND FLOOR(o_totalprice) <> CEILING(o_totalprice) AND SIGN(o_custkey) >= 0 AND ROUND(o_totalprice, 0) > SQRT(100) AND POWER(2, 3) = 8",
        "(o_orderkey // 7) % 2 = 1 and abs(o_totalprice) > 400 and floor(o_totalprice) <> ceil(o_totalprice) and o_custkey >= 0 and round(o_totalprice, 0) > 10",
    ),
    "logarithms": (
        "part",
        "LOG10(p_retailprice) > 2.97 AND LOG(p_retailprice) > LOG(1024, 2) - 3.15 AND EXP(0) = 1 AND p_partkey % 3 <> 1",
        "log10(p_retailprice) > 2.97 and ln(p_retailprice) > 6.85 and p_partkey % 3 <> 1",
    ),
    "like_classes": (
        "customer",
        "c_name LIKE '%[02468]' AND c_name NOT LIKE '%[^0-4]_' AND c_mktsegment LIKE '[A-F]%' OR c_name LIKE 'Z!%' ESCAPE '!'",
        "regexp_matches(c_name, '[02468]$') and not regexp_matches(c_name, '[^0-4].$') and regexp_matches(c_mktsegment, '^[A-F]') or c_name = 'Z%'",
    ),
    "joined_by_plus": (
        "orders",
        "o_orderstatus + '/' + o_orderpriority IN ('O/1-URGENT', 'F/5-LOW') OR LEFT(o_orderpriority, 1) + NULL = '1' OR o_orderkey + 1 + 1 = 9",
        "o_orderstatus || '/' || o_orderpriority in ('O/1-URGENT', 'F/5-LOW') or o_orderkey + 2 = 9",
    ),
    "rounding": (
        "orders",
        "ROUND(o_totalprice, -3, 1) = ROUND(o_totalprice, -3) AND ROUND(-o_totalprice / 1000, 0, 1) > -150",
        "trunc(o_totalprice / 1000) * 1000 = round(o_totalprice / 1000) * 1000 and trunc(-o_totalprice / 1000) > -150",
    ),
    "dates_and_nulls": (
        "orders",
        "MONTH(o_orderdate) BETWEEN 3 AND 6 AND DAY(o_orderdate) / 10 = 1 AND COALESCE(NULLIF(o_orderstatus, 'F'), 'none') IN ('none', 'O') AND IIF(o_custkey > 10, 1, 0) = 1",
        "month(o_orderdate) between 3 and 6 and day(o_orderdate) // 10 = 1 and coalesce(nullif(o_orderstatus, 'F'), 'none') in ('none', 'O') and o_custkey > 10",
    ),
}


def _filtered(name: str, table: str, predicate: str, sql: str) -> None:
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, target = sides(spark, sf_dir, table)
        return compare.classify(source, target, request(table, mode="Filter", predicate=to_spark(predicate, source.dtypes))).drop("target_hash")

    query(classified_sql(table, "left", f"(select * from {table} where {sql})", f"(select * from {perturbed_sql(table)} where {sql})"), f"cmp_filter_{name}")(rows)


for _name, (_of, _predicate, _meaning) in FILTERS.items():
    _filtered(_name, _of, _predicate, _meaning)


_OPEN = "o_orderstatus <> 'Z'"


@query(
    f"""with c as ({classified_sql("orders", "left", f"(select * from orders where {_OPEN})", f"(select * from {perturbed_sql('orders')} where {_OPEN})")})
select c.*, exists (select 1 from {perturbed_sql("orders")} w where w.o_orderkey = c.o_orderkey) as key_exists_on_target from c"""
)
def cmp_filter_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.classify(*sides(spark, sf_dir, "orders"), request("orders", mode="Filter", predicate=_OPEN), extra=True).drop("target_hash")


@query("select * from (values ('c_note', 'only on target'), ('c_name', 'excluded by rule'), ('c_extra', 'only on source'), ('c_version', 'not comparable'), ('c_total', 'computed')) as t(column_name, reason)")
def cmp_excluded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = Table.of("customer", read(spark, sf_dir, "customer").schema, primary_key=("c_custkey",))
    n = len(base.columns)
    text = TypeSpec("string")
    source = Table("customer", (*base.columns, Column("c_extra", text, ordinal=n), Column("c_version", text, ordinal=n + 1, generated=True), Column("c_total", text, ordinal=n + 2, computed="1")), base.primary_key)
    target = Table("customer", (*base.columns, Column("C_VERSION", text, ordinal=n), Column("c_total", text, ordinal=n + 1), Column("c_note", text, ordinal=n + 2)), base.primary_key)
    found = columns.resolve(source, target, columns.default_key(source), ["C_NAME"])
    return spark.createDataFrame(list(found.excluded), "column_name string, reason string")


_UPDATED = f"select * from ({classified_sql('orders')}) where classification = 'Update'"


@query(f"with u as (select o_orderkey from ({_UPDATED}) order by o_orderkey limit 200) select u.o_orderkey, 'o_orderstatus' as column_name, s.o_orderstatus as source_value, 'Z' as target_value from u join orders s using (o_orderkey)")
def detail_first_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.cell_diffs(*sides(spark, sf_dir, "orders"), request("orders"), 200)


@query(f"select u.o_orderkey, 'o_orderstatus' as column_name, s.o_orderstatus as source_value, 'Z' as target_value from ({_UPDATED}) u join orders s using (o_orderkey)")
def cell_diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.cell_diffs(*sides(spark, sf_dir, "orders"), request("orders"), None)


_CHANGES = f"select c.o_orderkey, c.classification as op, s.o_custkey, s.o_orderstatus, s.o_orderpriority from ({classified_sql('orders')}) c left join orders s using (o_orderkey) where c.classification <> 'Same'"


@query(_CHANGES)
def changes_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.changes(*sides(spark, sf_dir, "orders"), request("orders"))
    return found.select("o_orderkey", "op", "o_custkey", "o_orderstatus", "o_orderpriority")


def _picks(spark: SparkSession) -> DataFrame:
    return spark.range(0, 400).select((F.col("id") * 5).alias("o_orderkey"))


@query(f"select o_orderkey, op from ({_CHANGES}) where o_orderkey in (select range * 5 from range(400))")
def picks_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.changes(*sides(spark, sf_dir, "orders"), request("orders"), _picks(spark)).select("o_orderkey", "op")


@query(f"select range * 5 as o_orderkey from range(400) where range * 5 not in (select o_orderkey from ({_CHANGES}))")
def picks_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.changes(*sides(spark, sf_dir, "orders"), request("orders"))
    return compare.unmatched_picks(_picks(spark), found, ["o_orderkey"])


# Digests and fingerprints.


def text_sql(column: str) -> str:
    name, _, kind = column.partition(":")
    shown = f"cast(cast({name} as decimal(38,6)) as varchar)" if kind == "d" else f"cast({name} as varchar)"
    return f"'|' || coalesce(length({shown})::varchar || ':' || {shown}, '-:')"


def digest_sql(name: str) -> str:
    return " || ".join(map(text_sql, TABLES[name].columns.split()))


def fingerprint_sql(name: str, source: str | None = None) -> str:
    return f"""select '{name}' as table_name, count(*) as row_count, coalesce(bit_xor(h), 0) as xor_hash, cast(coalesce(sum(h), 0) as varchar) as sum_hash
from (select cast('0x' || substr(md5({digest_sql(name)}), 1, 8) as bigint) as h from {source or name})"""


def _fingerprint(name: str) -> None:
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return screen.fingerprint(read(spark, sf_dir, name), TABLES[name].names, name, "portable", "md5")

    query(fingerprint_sql(name), f"fp_{name}")(rows)


for _name in TABLES:
    _fingerprint(_name)


@query(f"select count(*) as row_count, coalesce(bit_xor(h), 0) as xor_hash from (select 1 as h where false)")
def fp_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.fingerprint(read(spark, sf_dir, "nation").limit(0), ["n_name"]).select("row_count", "xor_hash")


_SCANNED = ("nation", "customer", "orders", "events", "labels", "conversations")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = {n: read(spark, sf_dir, n) for n in (*_SCANNED, "part", "lineitem", "region")}
    target = {n: source[n] if n in ("customer", "events") else perturbed(source[n], n) for n in _SCANNED} | {"lineitem": source["lineitem"], "region": source["region"]}
    return screen.screen(source, target, {n: TABLES[n].key for n in source}, {"region": 10}, 5)


_SCAN_SQL = "select * from (values ('conversations', 'differs', ''), ('customer', 'same', ''), ('events', 'same', ''), ('labels', 'differs', ''), ('lineitem', 'not comparable', 'no primary key'), ('nation', 'differs', ''), ('orders', 'differs', ''), ('part', 'not comparable', 'only on source'), ('region', 'skipped', 'larger than 5 bytes')) as t(table_name, state, reason)"


@query(_SCAN_SQL)
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir)


_KEPT_SQL = " union all ".join(
    f"select {i} as scan, {read_} as files_read, * from ({fingerprint_sql('orders', source)})"
    for i, read_, source in ((1, 8, "(select * from orders)"), (2, 1, f"(select * from orders union all select * replace (o_orderkey + {FAR} as o_orderkey) from orders where o_orderkey % 50 = 0)"), (3, 0, f"(select * from orders union all select * replace (o_orderkey + {FAR} as o_orderkey) from orders where o_orderkey % 50 = 0)"))
)


@query(_KEPT_SQL)
def scan_by_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of orders in eight files, after one more was written, and once again; and how many files each scan read."""
    root, rows = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}", read(spark, sf_dir, "orders")
    store, columns_, out = rescan.FingerprintStore(spark, f"{root}/kept"), TABLES["orders"].names, None
    rows.repartition(8).write.parquet(f"{root}/orders")
    for scan in (1, 2, 3):
        if scan == 2:
            rows.where("o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + FAR).coalesce(1).write.mode("append").parquet(f"{root}/orders")
        found = store.scan([rescan.watch_folder(spark, "orders", f"{root}/orders", columns_, "portable", "md5")])
        one = found.select(F.lit(scan).alias("scan"), F.lit(store.files_read["orders"]).alias("files_read"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("select 6::bigint as comparable, 4::bigint as differing, 2::bigint as not_comparable, 1::bigint as skipped")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.scan_summary(_scan(spark, sf_dir))


@query(f"select n_nationkey, {digest_sql('nation')} as row_text, sha256({digest_sql('nation')}) as row_hash, md5({digest_sql('nation')}) as row_md5 from nation")
def hash_rows_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "nation")
    text = row_text(df.schema, TABLES["nation"].names, "portable")
    return df.select("n_nationkey", text.alias("row_text")).withColumn("row_hash", row_hash(F.col("row_text"))).withColumn("row_md5", row_hash(F.col("row_text"), "md5"))


_NULLED = "select c_custkey as id, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '' else c_mktsegment end as a, case when c_custkey % 4 = 0 then null else left(c_name, (c_custkey % 4)::int) end as b from customer"


@query(f"select id, '|' || coalesce(length(a)::varchar || ':' || a, '-:') || '|' || coalesce(length(b)::varchar || ':' || b, '-:') as row_text from ({_NULLED})")
def digest_null_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with some texts taken away or emptied: null, the empty text and a text's place all show."""
    key = F.col("c_custkey")
    a = F.when(key % 3 == 0, None).when(key % 3 == 1, "").otherwise(F.col("c_mktsegment"))
    b = F.when(key % 4 != 0, F.substring("c_name", F.lit(1), (key % 4).cast("int")))
    df = read(spark, sf_dir, "customer").select(key.alias("id"), a.alias("a"), b.alias("b"))
    return df.select("id", canonical([(F.col("a"), df.schema["a"].dataType), (F.col("b"), df.schema["b"].dataType)]).alias("row_text"))


# Keys.


def _profile(name: str) -> None:
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return keys.profile(read(spark, sf_dir, name))

    one = "select '{c}' as column_name, count(*) as row_count, count(distinct {c}) as distinct_count, count(*) - count({c}) as null_count, count(*) > 0 and count({c}) = count(*) and count(distinct {c}) = count(*) as could_be_key from {t}"
    query(" union all ".join(one.format(c=c, t=name) for c in TABLES[name].names), f"key_profile_{name}")(rows)


for _name in ("nation", "customer", "orders", "lineitem", "conversations"):
    _profile(_name)


def _check(name: str, table: str, columns_: list[str]) -> None:
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return keys.check_key(read(spark, sf_dir, table), columns_)

    listed, null = ", ".join(columns_), " or ".join(f"{c} is null" for c in columns_)
    query(f"select sum(n)::bigint as row_count, count(*) as distinct_count, sum(case when {null} then n else 0 end)::bigint as null_key_count, sum(n) = count(*) and sum(case when {null} then n else 0 end) = 0 as is_unique from (select {listed}, count(*) as n from {table} group by all)", name)(rows)


_check("key_check_lineitem_2", "lineitem", ["l_orderkey", "l_linenumber"])
_check("key_check_lineitem_4", "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
_check("key_check_conversations", "conversations", ["conv_id", "turn"])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def dup_keys_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# Closures.


def _keys_of(*names: str) -> dict[str, list[ForeignKey]]:
    return {n: [ForeignKey(k, (c,), p, (pc,)) for k, c, p, pc in FOREIGN_KEYS[n]] for n in names}


@query("select c.* from customer c where c_custkey in (select o_custkey from orders) and not (c_custkey % 3 = 0)")
def closure_orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders are written; the target lacks two thirds of the customers."""
    orders, customer, nation = (read(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    found = closure.close({"orders": orders}, {"customer": customer, "nation": nation}, {"customer": customer.where("c_custkey % 3 = 0"), "nation": nation}, _keys_of("orders", "customer"), max_rows=1 << 60)
    return found.added["customer"]


_CHAIN = """with o as (select * from orders where o_orderkey in (select l_orderkey from lineitem) and o_orderkey % 2 = 1),
c as (select * from customer where c_custkey in (select o_custkey from o)), n as (select * from nation where n_nationkey in (select c_nationkey from c))
select 'orders' as table_name, count(*) as n from o union all select 'customer', count(*) from c union all select 'nation', count(*) from n union all select 'region', count(*) from region where r_regionkey in (select n_regionkey from n)"""


@query(_CHAIN)
def closure_lineitem_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lineitems are written; the target has every second order and nothing above it."""
    source = {n: read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    target = {"orders": source["orders"].where("o_orderkey % 2 = 0")} | {n: source[n].limit(0) for n in ("customer", "nation", "region")}
    links = _keys_of("orders", "customer", "nation") | {"lineitem": _keys_of("lineitem")["lineitem"][:1]}
    found = closure.close({"lineitem": source["lineitem"]}, source, target, links, max_rows=1 << 60)
    out = None
    for name, rows in found.added.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _schema(spark: SparkSession, sf_dir: str):
    return ParquetDatabase(spark, sf_dir, CONSTRAINTS).schema()


_ORDER = "benchmark conversations documents embeddings events labels part region nation customer orders supplier lineitem".split()


@query("select * from (values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_ORDER)) + ") as t(rank, table_name)")
def closure_table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _schema(spark, sf_dir)
    tables = [t for t in schema.tables if t.name != "pages"]
    order = ordering.Graph(tables).data_order()
    return spark.createDataFrame([(i, n) for i, n in enumerate(order.all)], "rank int, table_name string")


@query("select * from (values ('orders', 0), ('customer', -1), ('nation', -2), ('lineitem', 1)) as t(table_name, band)")
def fk_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands, _ = ordering.Graph(_schema(spark, sf_dir).tables).neighbourhood("orders", 2)
    return spark.createDataFrame(bands, "table_name string, band int")


_ORPHANS = " union all ".join(f"select '{k}' as foreign_key, count(*) as n from {t} where {c} is not null and {c} not in (select {pc} from {p} where {pc} % 3 = 0)" for t, ks in FOREIGN_KEYS.items() for k, c, p, pc in ks)


@query(_ORPHANS)
def orphans_all_fks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in FOREIGN_KEYS:
        for fk in _keys_of(name)[name]:
            parent = read(spark, sf_dir, fk.parent).where(F.col(fk.parent_columns[0]) % 3 == 0)
            one = closure.orphans(read(spark, sf_dir, name), fk, parent).agg(F.count(F.lit(1)).alias("n")).select(F.lit(fk.name).alias("foreign_key"), "n")
            out = one if out is None else out.unionByName(one)
    return out


# Estimates, drift, applying.


@query(f"select count(*) filter (classification = 'Delete') as deletes, (select count(*) from {perturbed_sql('orders')}) as target_rows, count(*) filter (classification = 'Delete') > 0.05 * (select count(*) from {perturbed_sql('orders')}) as warned from ({classified_sql('orders')})")
def delete_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = sides(spark, sf_dir, "orders")
    found = compare.classify(source, target, request("orders"))
    n, rows = found.where("classification = 'Delete'").count(), target.count()
    return spark.createDataFrame([(n, rows, sizes.delete_share(n, rows))], "deletes bigint, target_rows bigint, warned boolean")


@query(f"select count(*) * 5 * 24 as bytes from ({classified_sql('orders')}) where classification in ('Insert', 'Update')")
def transfer_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = {r["classification"]: r["n"] for r in compare.counts(compare.classify(*sides(spark, sf_dir, "orders"), request("orders"))).collect()}
    return spark.createDataFrame([(sizes.transfer(by.get("Insert", 0), by.get("Update", 0), 5),)], "bytes bigint")


@query(
    f"""select cast(coalesce(sum(8 + case op when 'Delete' then length(o_orderkey::varchar) + 4 + 14 when 'Update' then length(o_orderkey::varchar) + 4 + v + 36 + 14 else length(o_orderkey::varchar) + 4 + v end), 0) + 36 + 64 as bigint) as bytes
from (select *, coalesce(length(o_orderstatus), 0) + 4 + coalesce(length(o_orderpriority), 0) + 4 as v from ({_CHANGES}))"""
)
def script_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.changes(*sides(spark, sf_dir, "orders"), request("orders"))
    return sizes.script_size(found, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(
    f"""with n as (select (select count(*) from orders) as s, (select count(*) from {perturbed_sql("orders")}) as t)
select greatest(1, abs(s - t)) as min_rows, greatest(s, t) as max_rows, greatest(1, abs(s - t)) * 25 as min_bytes, least(greatest(s, t) * 100, 8388608) as max_bytes, 'Within' as verdict from n"""
)
def plan_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = sides(spark, sf_dir, "orders")
    found = sizes.plan_size([sizes.TableSize(source.count(), target.count(), 50, scanned=True, differs=True)], 1000, 8 << 20, 100 << 20)
    return spark.createDataFrame([(found.min_rows, found.max_rows, found.min_bytes, found.max_bytes, found.verdict)], "min_rows bigint, max_rows bigint, min_bytes bigint, max_bytes bigint, verdict string")


_NOW = "(select case when o_orderkey % 11 = 0 then o_orderkey + 5000000000 else o_orderkey end as o_orderkey, o_custkey, case when o_orderkey % 13 = 0 then 'Y' else o_orderstatus end as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from " + perturbed_sql("orders") + ")"


@query(
    f"""with a as (select c.o_orderkey as k, t.o_orderstatus as h from ({classified_sql("orders")}) c left join {perturbed_sql("orders")} t using (o_orderkey) where classification <> 'Same'),
b as (select c.o_orderkey as k, t.o_orderstatus as h from ({classified_sql("orders", target=_NOW)}) c left join {_NOW} t using (o_orderkey) where classification <> 'Same'),
d as (select case when a.k is null then 'appeared' when b.k is null then 'settled' when a.h is distinct from b.h then 'moved' end as kind from a full join b on a.k = b.k)
select 'orders' as table_name, count(*) filter (kind = 'moved') as moved, count(*) filter (kind = 'settled') as settled, count(*) filter (kind = 'appeared') as appeared from d"""
)
def drift_moved_settled_appeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = sides(spark, sf_dir, "orders")
    later = target.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "Y").otherwise(F.col("o_orderstatus"))).withColumn("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") + 5_000_000_000).otherwise(F.col("o_orderkey")))
    reviewed, now = (drift.snapshot(compare.classify(source, t, request("orders")), "orders", ["o_orderkey"]) for t in (target, later))
    return drift.drift_counts(drift.drift(reviewed, now))


@query(
    f"""with a as (select c.* from ({classified_sql("conversations")}) c where classification <> 'Same'),
b as (select * from a where turn % 3 <> 0) select 'conversations' as table_name, 0::bigint as moved, (select count(*) from a) - (select count(*) from b) as settled, 0::bigint as appeared"""
)
def drift_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.classify(*sides(spark, sf_dir, "conversations"), request("conversations"))
    reviewed, now = (drift.snapshot(rows, "conversations", list(TABLES["conversations"].key)) for rows in (found, found.where("turn % 3 <> 0")))
    return drift.drift_counts(drift.drift(reviewed, now))


_TOGETHER = ("customer", "orders", "events")
_TOGETHER_SQL = " union all ".join(
    f"select '{n}' as table_name, step, count(*) as rows_there, count(*) filter (classification not in ('Same', 'Insert')) as differing from ({classified_sql(n)}), (select unnest(['failed', 'refused']) as step) where classification <> 'Insert' group by step "
    f"union all select '{n}', 'applied', count(*), 0 from {n}"
    for n in _TOGETHER
)


@query(_TOGETHER_SQL)
def apply_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables after a change whose last table fails, after one that another writer forestalled, and after one that succeeds."""
    base = VersionedDatabase(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}")
    source = {n: read(spark, sf_dir, n) for n in _TOGETHER}
    with base.transaction() as t:
        for name, rows in source.items():
            t.write(name, perturbed(rows, name))

    found = {}  # change sets by table and version; one holds for as long as the version it was found for is current

    def change(t, expected: int | None = None) -> None:
        for name, rows in source.items():
            at = name, t.base.versions[name]
            if at not in found:
                found[at] = materialize(compare.changes(rows, t.read(name), request(name)), "changes")
            t.apply(name, found[at], TABLES[name].key, written=True)
        if expected is not None:
            t.write("events", t.read("events"), expected)

    shown: dict[tuple[str, str], tuple[VersionedDatabase, list[str]]] = {}  # steps by table and version; a version doesn't change, so it is compared once

    def see(step: str) -> None:
        now = base.at(base.current())
        for at in now.state().versions.items():
            shown.setdefault(at, (now, []))[1].append(step)

    try:
        with base.transaction() as t:
            change(t, -1)
    except RuntimeError:
        pass
    see("failed")
    try:
        with base.transaction() as late:
            change(late)
            with base.transaction() as other:
                other.write("orders", other.read("orders"))
    except Conflict:
        pass
    see("refused")
    with base.transaction() as t:
        change(t)
    see("applied")
    out = None
    for (name, _), (then, steps) in shown.items():
        there = compare.classify(source[name], then.table(name), request(name)).where("classification <> 'Insert'")
        counted = there.agg(F.count(F.lit(1)).alias("rows_there"), F.count_if(F.col("classification") != "Same").alias("differing"))
        one = counted.select(F.lit(name).alias("table_name"), F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"), "rows_there", "differing")
        out = one if out is None else out.unionByName(one)
    return out


_BATCHED = f"select *, row_number() over (order by c_custkey) - 1 as i from (select c.c_custkey, s.c_nationkey, s.c_mktsegment from ({classified_sql('customer')}) c join customer s using (c_custkey) where c.classification = 'Insert' union all select c_custkey + {2 * FAR}, c_nationkey, c_mktsegment from customer)"


@query(
    f"select i // 1000 as batch, count(*) as rows, 'INSERT INTO `customer` (`c_custkey`, `c_nationkey`, `c_mktsegment`) VALUES' || chr(10) || string_agg('(' || c_custkey || ', ' || c_nationkey || ', ''' || c_mktsegment || ''')', ',' || chr(10) order by i) as sql from ({_BATCHED}) group by all"
)
def insert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inserts of customers that the target lacks, the whole table once more among them, a thousand rows a statement."""
    source, target = (df.drop("c_name", "c_acctbal") for df in sides(spark, sf_dir, "customer"))
    wider = source.unionByName(source.withColumn("c_custkey", F.col("c_custkey") + 2 * FAR))
    found = script.insert_batches(compare.changes(wider, target, request("customer")), "customer", ["c_custkey"])
    return found.select("batch", F.col("rows").cast("long").alias("rows"), "sql")


@query("select c_custkey, c_nationkey, c_mktsegment from customer where c_custkey % 3 = 0 or c_custkey in (select o_custkey from orders)")
def apply_parents_converges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of the target once all orders can be written: its own, and those that orders need."""
    orders, customer, nation = (read(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    target = customer.where("c_custkey % 3 = 0")
    found = closure.close({"orders": orders}, {"customer": customer, "nation": nation}, {"customer": target, "nation": nation}, _keys_of("orders", "customer"), max_rows=1 << 60)
    there = target.join(found.added["customer"].select("c_custkey"), "c_custkey", "left_semi")
    needed = compare.changes(found.added["customer"], there, request("customer"))
    return compare.apply_changes(target, needed, ["c_custkey"]).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("select 'INSERT INTO `customer` (`c_custkey`, `c_mktsegment`) VALUES (' || c_custkey || ', ''' || c_mktsegment || ''')' as sql from customer where c_custkey % 3 <> 0 and c_custkey in (select o_custkey from orders)")
def script_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements by which the customers that all orders need, and the target lacks, are written."""
    orders, customer = (read(spark, sf_dir, n).drop("c_name", "c_nationkey", "c_acctbal") for n in ("orders", "customer"))
    found = closure.close({"orders": orders}, {"customer": customer}, {"customer": customer.where("c_custkey % 3 = 0")}, _keys_of("orders"), max_rows=1 << 60)
    missing = compare.changes(found.added["customer"], customer.limit(0), request("customer"))
    return script.statements(missing, "customer", ["c_custkey"]).select("sql")


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def apply_orders_converges(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = sides(spark, sf_dir, "orders")
    return compare.apply_changes(target, compare.changes(source, target, request("orders")), ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("select * from part")
def apply_staged_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target after a change set that went through files by operation, in one version of the table."""
    source, target = sides(spark, sf_dir, "part")
    root = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    table = SnapshotTable(spark, f"{root}/part")
    table.write(target)
    stage(compare.changes(source, target, request("part")), f"{root}/changes")
    table.apply(staged(spark, f"{root}/changes"), ["p_partkey"], written=True)
    return table.read()


_VOLUMES = ("nation", "customer", "lineitem", "labels")


@query(
    " union all ".join(
        f"select '{n}' as table_name, (select count(*) from {n}) as source_rows, {f'(select count(*) from {perturbed_sql(n)})' if n != 'lineitem' else '0'} as target_rows, '{'declared' if TABLES[n].key else 'none'}' as key_state, {'true' if n != 'lineitem' else 'false'} as on_target"
        for n in _VOLUMES
    )
)
def volumes_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large tables are on either side, and whether they have a key."""
    sources, targets = (VersionedDatabase(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", {n: {"primary_key": list(TABLES[n].key)} for n in _VOLUMES}) for _ in range(2))
    with sources.transaction() as t, targets.transaction() as u:
        for name in _VOLUMES:
            t.write(name, read(spark, sf_dir, name))
            if name != "lineitem":
                u.write(name, perturbed(read(spark, sf_dir, name), name))
    rows = [(r["table"], r["source_rows"], r["target_rows"], r["key_state"], r["on_target"]) for r in CompareSession(sources, targets).volumes()]
    return spark.createDataFrame(rows, "table_name string, source_rows bigint, target_rows bigint, key_state string, on_target boolean")


_KEYS_BETWEEN = [(k, t, p) for t, ks in FOREIGN_KEYS.items() for k, _, p, _ in ks]


@query(
    "select *, 1 as dropped, case when child = 'lineitem' then 1 else 0 end as added, child <> 'lineitem' as with_its_table from (values "
    + ", ".join(f"('{k}', '{t}', '{p}')" for k, t, p in _KEYS_BETWEEN)
    + ") as t(foreign_key, child, parent)"
)
def keys_once_over_a_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each foreign key is dropped and added by statements when the types of all key columns change, and whether it comes back with its rebuilt table."""
    base = ParquetDatabase(spark, sf_dir, CONSTRAINTS).schema()
    wide = {"INT": TypeSpec("decimal", precision=20, scale=0), "BIGINT": TypeSpec("decimal", precision=20, scale=0)}
    keyed = {(t.name, c) for t in base.tables for c in t.primary_key} | {(t.name, c) for t in base.tables for k in t.foreign_keys for c in k.columns}
    changed = base.with_tables(*[replace(t, columns=tuple(replace(c, type=wide.get(str(c.type), c.type)) if (t.name, c.name) in keyed else c for c in t.columns)) for t in base.tables])
    diffs = schema_diff.schema_diff(changed, base)
    made = script.schema_script(selection.compile_plan(selection.schema_units(diffs), [selection.Selection(selection.DATABASE)], []), changed, base, diffs)
    rows = []
    for key, child, parent in _KEYS_BETWEEN:
        steps = [s for s in made.ordered() if f"CONSTRAINT `{key}`" in s.sql]
        added = sum("ADD CONSTRAINT" in s.sql for s in steps)
        rows.append((key, child, parent, sum("DROP CONSTRAINT" in s.sql for s in steps), 0 if child in made.rebuilds else added, child in made.rebuilds and added == 1))
    return spark.createDataFrame(rows, "foreign_key string, child string, parent string, dropped int, added int, with_its_table boolean")


@query(
    f"""select case op when 'Delete' then 0 when 'Insert' then 1 else 2 end as ordinal, n_nationkey,
case op when 'Delete' then 'DELETE FROM `nation` WHERE `n_nationkey` = ' || n_nationkey
when 'Insert' then 'INSERT INTO `nation` (`n_nationkey`, `n_name`, `n_regionkey`) VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ')'
else 'UPDATE `nation` SET `n_name` = ''' || n_name || ''', `n_regionkey` = ' || n_regionkey || ' WHERE `n_nationkey` = ' || n_nationkey end as sql
from (select c.n_nationkey, c.classification as op, s.n_name, s.n_regionkey from ({classified_sql("nation")}) c left join nation s using (n_nationkey) where classification <> 'Same')"""
)
def statements_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.statements(compare.changes(*sides(spark, sf_dir, "nation"), request("nation")), "nation", ["n_nationkey"])


# Schemas and instances.


def _typed(spark: SparkSession, sf_dir: str, change: bool) -> tuple[dict[str, DataFrame], list[Table]]:
    """All tables as they are, or with columns dropped, added and of other types, by a rule that SQL can state."""
    frames, tables = {}, []
    for name in sorted(TABLES):
        df = read(spark, sf_dir, name)
        if change:
            kinds = {"int": "bigint", "bigint": "int", "double": "float"}
            shown = [F.col(f.name).cast(kinds.get(f.dataType.simpleString(), f.dataType.simpleString())).alias(f.name.upper()) for i, f in enumerate(df.schema.fields) if i != 2]
            df = df.select(*shown, F.lit("").alias("added"))
        frames[name] = df
        tables.append(Table.of(name, df.schema, primary_key=TABLES[name].key))
    return frames, tables


_SPARK_KINDS = "case data_type when 'INTEGER' then 'INT' when 'VARCHAR' then 'STRING' when 'TIMESTAMP' then 'TIMESTAMP_NTZ' else data_type end"
_COLUMNS = f"(select table_name, column_name, row_number() over (partition by table_name order by column_index) - 1 as place, {_SPARK_KINDS} as type, case data_type when 'BIGINT' then 'INT' when 'INTEGER' then 'BIGINT' when 'DOUBLE' then 'FLOAT' else '' end as other from duckdb_columns() where table_name in ({', '.join(repr(n) for n in TABLES)}))"


@query(
    f"""select table_name, column_name, 'Column' as type, case when place = 2 then 'SourceOnly' else 'Different' end as kind, case when place = 2 then null else 'DataType' end as property, case when place = 2 then null else type end as source_value, case when place = 2 then null else other end as target_value
from {_COLUMNS} where place = 2 or other <> ''
union all select distinct table_name, 'added', 'Column', 'TargetOnly', null, null, null from {_COLUMNS}"""
)
def schema_diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column that differs between the tables and their copies of other types."""
    out = None
    for source, target in zip(_typed(spark, sf_dir, False)[1], _typed(spark, sf_dir, True)[1]):
        found = schema_diff.table_diff(Table(source.name, tuple(_open(c) for c in source.columns), source.primary_key), Table(target.name, tuple(_open(c) for c in target.columns), source.primary_key))
        rows = schema_diff.diff_frame(spark, found.children).select(F.lit(source.name).alias("table_name"), F.col("name").alias("column_name"), "type", "kind", "property", "source_value", "target_value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _open(c: Column) -> Column:
    """A column without what isn't compared here."""
    return Column(c.name, c.type, True, c.ordinal)


@query(f"select table_name, column_name, type as old_type, other as new_type, case when type = 'INT' then 'None' else 'Narrows' end as kind from {_COLUMNS} where place <> 2 and other <> ''")
def narrowing_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each column of the tables would lose in the type that its copy has."""
    rows = []
    for source, target in zip(_typed(spark, sf_dir, False)[1], _typed(spark, sf_dir, True)[1]):
        for c in source.columns:
            to = target.column(c.name)
            if to is not None and to.type != c.type:
                rows.append((source.name, c.name, str(c.type), str(to.type), schema_diff.narrowing(_open(c), _open(to)).kind))
    return spark.createDataFrame(rows, "table_name string, column_name string, old_type string, new_type string, kind string")


@query(f"select c_custkey, c_name, c_nationkey, c_custkey * 2 as twice, null::varchar as note, true as applied from customer where c_custkey % 10 <> 0 or c_custkey % 20 = 0 union all select -1, 'state', 2, 0, null, true")
def apply_schema_and_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer table of other types, with a dropped, a new and a computed column, and missing rows, brought to the source's form in one step."""
    rows = read(spark, sf_dir, "customer")
    base = VersionedDatabase(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", {"customer": {"primary_key": ["c_custkey"]}})
    with base.transaction() as t:
        t.write("customer", rows.where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal"))
    wanted = rows.select("c_custkey", "c_name", "c_nationkey", (F.col("c_custkey") * 2).alias("twice"), F.lit(None).cast("string").alias("note"))
    source = Table.of("customer", wanted.schema, primary_key=("c_custkey",))
    source = replace(source, columns=tuple(replace(c, nullable=c.name != "c_custkey", computed="[c_custkey] * 2" if c.name == "twice" else None) for c in source.columns))
    old = base.schema()
    with base.transaction() as t:
        t.rebuild("customer", rebuild.rebuild(source, old.table("customer"), old, []).columns)
        t.describe("customer", catalog.constraints_of(source))
        t.apply("customer", compare.changes(wanted.where("c_custkey % 20 = 0 or c_custkey % 10 <> 0"), t.read("customer"), request("customer")), ["c_custkey"])
    same = not [d for d in schema_diff.schema_diff(Schema("s", (source,)), base.schema()) if d.changed]
    state = spark.createDataFrame([(-1, "state", base.current().number, 0, None)], wanted.schema)
    return base.table("customer").unionByName(state).withColumn("applied", F.lit(same))


@query(
    """with s as (select n_name as name from nation where n_nationkey % 2 = 0), t as (select upper(n_name) as name from nation where n_nationkey % 3 = 0),
d as (select (select n_name from nation where n_nationkey = 2) as a, (select upper(n_name) from nation where n_nationkey = 3) as b),
j as (select s.name as source_name, t.name as target_name from (select * from s where name not in (select a from d)) s full join (select * from t where name not in (select b from d)) t on lower(s.name) = lower(t.name))
select a as source_name, b as target_name, 'Declared' as kind from d
union all select source_name, target_name, case when target_name is null then 'SourceOnly' when source_name is null then 'TargetOnly' else 'ByName' end from j"""
)
def instance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    source = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))
    target = nation.where("n_nationkey % 3 = 0").select(F.upper("n_name").alias("name"))
    pair = nation.agg(F.max(F.when(F.col("n_nationkey") == 2, F.col("n_name"))).alias("source_name"), F.max(F.when(F.col("n_nationkey") == 3, F.upper("n_name"))).alias("target_name"))
    return instances.match_frames(source, target, pair)


@query(" union all ".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in sorted([*TABLES, "embeddings"])))
def volume_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ParquetDatabase(spark, sf_dir).volume().select("table_name", "row_count")


_KEYS = [(n, "primary key", "", t.key) for n, t in TABLES.items() if t.key] + [(n, "foreign key", k, (c,)) for n, ks in FOREIGN_KEYS.items() for k, c, _, _ in ks]


@query("select * from (values " + ", ".join(f"('{n}', '{kind}', '{name}', '{','.join(cols)}')" for n, kind, name, cols in _KEYS) + ") as t(table_name, kind, constraint_name, columns)")
def catalog_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.constraints_frame(spark, _schema(spark, sf_dir)).withColumn("columns", F.array_join("columns", ","))


@query(
    "select t.table_name, t.column_name, coalesce(string_agg(distinct k.kind, ',' order by k.kind), '') as keys from (values "
    + ", ".join(f"('{n}', '{c}')" for n, t in TABLES.items() for c in t.names)
    + ") as t(table_name, column_name) left join (values "
    + ", ".join(f"('{n}', '{kind}', '{c}')" for n, kind, _, cols in _KEYS for c in cols)
    + ") as k(table_name, kind, column_name) using (table_name, column_name) group by all"
)
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.catalog_frame(spark, _schema(spark, sf_dir)).where("table_name <> 'embeddings'")
    return found.select("table_name", "column_name", F.array_join("keys", ",").alias("keys"))


@query(f"select o_orderkey, 'o_orderstatus' as changed, 4 as unchanged from ({_UPDATED})")
def row_details_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.row_details(*sides(spark, sf_dir, "orders"), request("orders"), None)
    return found.select("o_orderkey", F.array_join("changed", ",").alias("changed"), "unchanged")


@query("select case when n_nationkey % 10 = 0 then n_nationkey + 100 else n_nationkey end::bigint as n_nationkey, n_name as title, null::varchar as note from nation")
def rebuild_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose columns change in type and name, as a new version with all its rows."""
    table = SnapshotTable(spark, f"{shared_dir(spark)}/rebuild-{uuid.uuid4().hex}")
    nation = read(spark, sf_dir, "nation")
    table.write(nation.withColumn("n_nationkey", F.when(F.col("n_nationkey") % 10 == 0, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey"))))
    table.rebuild({"n_nationkey": "bigint", "title": "string", "note": "string"}, {"title": "n_name"})
    return table.read()
