"""What several operators share: written intermediate tables, and connected components.

Intermediate results that are used more than once are written as Parquet to the shared
folder that the cluster names in ``spark.checkpoint.dir``. That cuts the lineage, survives
the loss of an executor, and lets adaptive execution split skewed joins, because both
sides of a join then come straight from an exchange.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_LOCAL_FOLDER: list[str] = []
FEW_EDGES = 10_000  # that components() finishes without further rounds
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local run without that setting gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must be set for local-cluster")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"file://{_LOCAL_FOLDER[0]}"


def small_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """From now on the session sends rows to Python in Arrow batches of so many MB, if its setting is not smaller.

    An executor holds a batch in vectors of up to twice its size, outside the heap, once on the way
    to Python and once on the way back, for each task at once; Spark's own 64 MB fill its memory.
    The setting is read when a table is computed, so it stays.
    """
    text = spark.conf.get(BATCH_BYTES, "64m")
    number, unit = re.fullmatch(r"(-?\d+)([bkmgtp]?)b?", text.strip().lower()).groups()
    now = int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]
    if now <= 0 or now > megabytes << 20:
        spark.conf.set(BATCH_BYTES, f"{megabytes << 20}b")


def cut(df: DataFrame, name: str, free: bool = True, **options: int) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage.

    free: Spark gives back the shuffle files of the write as soon as it is done, instead of when
    the driver notices that nothing refers to them any more. options: of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/touchline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, str(free).lower())
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._touchline_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that no later step reads."""
    for table in tables:
        path = getattr(table, "_touchline_path", None)
        if path:
            jvm, jsc = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def _few_components(links: DataFrame) -> DataFrame:
    """node, root of at most FEW_EDGES edges a, b."""
    rows = links.collect()
    top = {}

    def find(x):
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    for a, b in rows:
        one, two = find(a), find(b)
        if one != two:
            top[max(one, two)] = min(one, two)
    found = [(x, find(x)) for x in dict.fromkeys(x for row in rows for x in row)]
    kind = links.schema["a"].dataType
    schema = StructType([StructField("node", kind), StructField("root", kind)])
    return cut(links.sparkSession.createDataFrame(found, schema), "tree", free=False)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by contraction: node, root (the smallest node of a component).

    Union-find over tables: in each round every node hooks itself to its smallest
    neighbour, pointer jumping flattens the trees, and the edges are contracted to the
    roots. Rounds end when no edge joins two roots. Each join reads written tables on
    both sides, so a hub of any degree is split by adaptive execution, and the minimum
    over neighbours is combined before the shuffle. Nodes without an edge are not listed.

    A round costs some twenty stages however few its edges are, and the driver keeps what it
    knows of each. So the last FEW_EDGES edges at most, a number that does not grow with
    the input, are joined at once. The result is the same.
    """
    ends = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    links = cut(edges.where(F.col(a) != F.col(b)).select(*ends).distinct(), "links", free=False)
    levels: list[DataFrame] = []
    while n := links.count():
        if n <= FEW_EDGES:
            levels.append(_few_components(links))
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = cut(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("root")),
            "tree",
            free=False,
        )
        while True:  # two jumps are one written table
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            top = tree.select(F.col("node").alias("above"), F.col("root").alias("top"))
            moved = (F.col("top") != F.col("root")).alias("moved")
            jumped = tree.join(up, "root").join(top, "above").select("node", F.col("top").alias("root"), moved)
            jumped = cut(jumped, "tree", free=False)
            still = jumped.where("moved").isEmpty()
            discard(tree)
            tree = jumped
            if still:
                break
        low = tree.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        high = tree.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = links.join(low, "a").select("ra", "b").distinct().join(high, "b")
        rest = joined.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        shrunk = cut(rest.distinct(), "links", free=False)
        discard(links)
        links = shrunk
        levels.append(tree)
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels[0].select("node", "root")
    for level in levels[1:]:
        up = level.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = found.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    named = cut(found, "components")
    discard(*levels, links)
    return named
