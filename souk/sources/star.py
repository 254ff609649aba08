"""Order fact view over a TPC-H-like star (lineitem, orders, customer, nation,
region, part).

One fact row per line item.  The mapping onto the order-fact columns is fixed:

    order_id              o_orderkey as string
    customer_id           o_custkey as string
    order_date            o_orderdate (timestamp_ntz)
    state / zone          nation name / region name of the customer
    category              p_type
    brand_type            'Premium' if the brand number (Brand#N) <= 10 else 'Mass'
    customer_gender       'Male' for an even customer key else 'Female'
    customer_age          18 + o_custkey % 42
    units_sold            l_quantity as int
    base_price            l_extendedprice / l_quantity
    discount_percent      l_discount * 100
    final_price           base_price * (1 - l_discount)
    revenue               l_extendedprice * (1 - l_discount)
    sales_event           'Festival' in October and November else 'Normal'
    competition_intensity priority 1, 2 -> High; 3 -> Medium; 4, 5 -> Low
    inventory_pressure    'High' if l_linestatus = 'O' else 'Low'

Join plan: the fact is lineitem-sized; every join is an inner equi-join on a
foreign key.  nation (25 rows) and region (5 rows) are fixed-size dimensions of
the schema and are broadcast.  customer and part grow with the data, so no
hint is given: AQE measures them at runtime and broadcasts only if they fall
under the broadcast threshold, otherwise they are shuffle-joined.  Every join is
made whatever columns are asked for, so the rows never depend on the projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACT_COLUMNS = [
    "order_id", "customer_id", "order_date", "state", "zone", "category",
    "brand_type", "customer_gender", "customer_age", "base_price",
    "discount_percent", "sales_event", "competition_intensity",
    "inventory_pressure", "units_sold", "final_price", "revenue",
]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_fact(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Order fact with the columns of ``souk.schema.RAW_ORDER_SCHEMA`` plus
    ``customer_id``; ``order_date`` is already a timestamp."""
    want = list(columns) if columns else list(FACT_COLUMNS)
    unknown = set(want) - set(FACT_COLUMNS)
    if unknown:
        raise ValueError(f"unknown fact columns: {sorted(unknown)}")
    # every join is made whatever the columns: the rows never depend on the projection
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_linestatus")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    geo = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
            .select("c_custkey", "n_name", "r_name"))
    o = o.join(geo, o.o_custkey == geo.c_custkey)
    # parts first: the line items are moved by part while they are narrow, and
    # what the orders add is not moved again
    df = li.join(p, li.l_partkey == p.p_partkey).drop("l_partkey", "p_partkey")
    df = df.join(o, df.l_orderkey == o.o_orderkey)

    qty = F.col("l_quantity")
    base = F.try_divide(F.col("l_extendedprice"), qty)
    prio = F.substring(F.col("o_orderpriority"), 1, 1)
    brand_no = F.substring_index(F.col("p_brand"), "#", -1).cast("int")
    exprs = {
        "order_id": lambda: F.col("l_orderkey").cast("string"),
        "customer_id": lambda: F.col("o_custkey").cast("string"),
        "order_date": lambda: F.col("o_orderdate"),
        "state": lambda: F.col("n_name"),
        "zone": lambda: F.col("r_name"),
        "category": lambda: F.col("p_type"),
        "brand_type": lambda: F.when(brand_no <= 10, "Premium").otherwise("Mass"),
        "customer_gender": lambda: F.when(F.col("o_custkey") % 2 == 0, "Male").otherwise("Female"),
        "customer_age": lambda: (F.lit(18) + F.col("o_custkey") % 42).cast("int"),
        "base_price": lambda: base,
        "discount_percent": lambda: F.col("l_discount") * 100 + 0.0,
        "sales_event": lambda: F.when(F.month("o_orderdate").isin(10, 11), "Festival")
                                .otherwise("Normal"),
        "competition_intensity": lambda: F.when(prio.isin("1", "2"), "High")
                                          .when(prio == "3", "Medium").otherwise("Low"),
        "inventory_pressure": lambda: F.when(F.col("l_linestatus") == "O", "High").otherwise("Low"),
        "units_sold": lambda: qty.cast("int"),
        "final_price": lambda: base * (1 - F.col("l_discount")),
        "revenue": lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")),
    }
    return df.select(*[exprs[c]().alias(c) for c in want])


# The same mapping as DuckDB SQL, used by the oracle queries.  Kept next to the
# Spark version so that the two are read and changed together.
FACT_SQL = """
fact AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         o.o_orderdate AS order_date,
         n.n_name AS state,
         r.r_name AS zone,
         p.p_type AS category,
         CASE WHEN CAST(split_part(p.p_brand, '#', 2) AS INTEGER) <= 10
              THEN 'Premium' ELSE 'Mass' END AS brand_type,
         CASE WHEN o.o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS customer_gender,
         CAST(18 + o.o_custkey % 42 AS INTEGER) AS customer_age,
         l.l_extendedprice / l.l_quantity AS base_price,
         l.l_discount * 100 + 0.0 AS discount_percent,
         CASE WHEN month(o.o_orderdate) IN (10, 11) THEN 'Festival' ELSE 'Normal' END AS sales_event,
         CASE WHEN substr(o.o_orderpriority, 1, 1) IN ('1', '2') THEN 'High'
              WHEN substr(o.o_orderpriority, 1, 1) = '3' THEN 'Medium'
              ELSE 'Low' END AS competition_intensity,
         CASE WHEN l.l_linestatus = 'O' THEN 'High' ELSE 'Low' END AS inventory_pressure,
         CAST(l.l_quantity AS INTEGER) AS units_sold,
         l.l_extendedprice / l.l_quantity * (1 - l.l_discount) AS final_price,
         l.l_extendedprice * (1 - l.l_discount) AS revenue
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


# ---------------------------------------------------------------- shared fact
import contextlib  # noqa: E402
import threading  # noqa: E402
import uuid  # noqa: E402

JOIN_ROWS = 500_000        # line items of a partition of the fact's joins, on average
_BUILD_LOCK = threading.Lock()


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Hash of the input tables' paths, sizes and modification times (file
    metadata only -- no data is read)."""
    import hashlib
    import inspect

    # the mapping is part of the key: a fact written by another one is not reused
    h = hashlib.sha1(inspect.getsource(orders_fact).encode())
    for name in ("lineitem", "orders", "customer", "nation", "region", "part"):
        path = f"{sf_dir.rstrip('/')}/{name}.parquet"
        p, fs = _hadoop_fs(spark, path)
        h.update(path.encode())
        if fs.exists(p):
            it = fs.listFiles(p, True)
            while it.hasNext():
                st = it.next()
                h.update(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}".encode())
    return h.hexdigest()[:16]


@contextlib.contextmanager
def _join_partitions(spark: SparkSession, rows: int):
    """Exchanges of more than ``JOIN_ROWS`` rows have a partition per ``JOIN_ROWS`` rows (at least one per
    core, if the session asks for as many), and AQE doesn't merge them: it would by compressed bytes,
    up to some two million line items, whose sort doesn't fit a small executor's memory."""
    number = "spark.sql.shuffle.partitions"
    wanted = -(-rows // JOIN_ROWS)
    own = {number: str(max(wanted, min(int(spark.conf.get(number)), spark.sparkContext.defaultParallelism))),
           "spark.sql.adaptive.coalescePartitions.enabled": "false"} if wanted > 1 else {}
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shared_fact_path(spark: SparkSession, sf_dir: str) -> str:
    from souk.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).rstrip("/")
    # the checkpoint dir is per application; keep the fact next to it, in the
    # shared folder the cluster names
    base = root.rsplit("/", 1)[0] if "/" in root else root
    return f"{base}/souk-fact/{_fingerprint(spark, sf_dir)}"


def shared_fact(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The order fact, joined once per dataset and stored as Parquet in the
    shared checkpoint folder, then scanned by every analytic.

    Rationale at scale: every analytic otherwise repeats the lineitem x orders
    x customer x part join (a full shuffle of the largest tables).  The joins'
    own partitions are written, without another exchange: their number
    follows the counted line items, so that a partition's joins and sort fit in
    memory and the file count follows the data size, not a setting.  Each file is sorted by order date so row-group statistics prune
    date-window filters.  A completed write is marked by
    Spark's ``_SUCCESS`` file; the key includes the input files' sizes and
    modification times, so changed inputs produce a new fact.
    """
    path = shared_fact_path(spark, sf_dir)
    p, fs = _hadoop_fs(spark, path + "/_SUCCESS")
    with _BUILD_LOCK:    # threads of one driver build a given fact once
        if not fs.exists(p):
            # written under a name of its own and published by a rename, so that
            # another driver never reads or overwrites a half-written fact
            draft = f"{path}-{uuid.uuid4().hex}"
            with _join_partitions(spark, table(spark, sf_dir, "lineitem").count()):
                orders_fact(spark, sf_dir).sortWithinPartitions("order_date").write.parquet(draft)
            target, source = p.getParent(), _hadoop_fs(spark, draft)[0]
            if fs.exists(p) or not fs.rename(source, target):
                fs.delete(source, True)
    df = spark.read.parquet(path)
    return df.select(*(columns or FACT_COLUMNS))
