"""Session construction and the shared scratch folder.

On a cluster the shared folder is whatever the cluster names in
``spark.checkpoint.dir``; it is read from the running session. Only when it is
unset in a local run (tests) is a private folder created and registered.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


# Settings for large inputs (100 TB class). Shuffle partitions is an upper
# bound that AQE coalesces to ~advisory size; skew join splits hot partitions;
# file splits of 256 MB keep scan tasks at a few million rows.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def apply_cluster_defaults(spark: SparkSession) -> SparkSession:
    """Set the defaults above only where the cluster's own configuration is silent."""
    given = spark.sparkContext.getConf()
    for key, value in CLUSTER_DEFAULTS.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    shared_root(spark)
    return spark


def local_session(cores: int | str = "*", app: str = "starling", **conf) -> SparkSession:
    """A local session with settings sized for one machine (tests, bench)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_root(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where it is unset, a local session gets a private
    one, and a cluster's session is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="starling-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared root for one write."""
    root = spark.sparkContext.getCheckpointDir() or shared_root(spark)
    # getCheckpointDir returns a per-application sub folder; stay next to it.
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """`df` as Parquet in the shared scratch folder, read back: the lineage ends there, later reads take only
    the columns they use, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def register_java(spark: SparkSession, path: str, return_type: str) -> str:
    """The Java UDF class of the source file ``path`` as a function of this session; returns its name.

    Spark's own compiler (Janino) makes the class, which reaches the executors as a jar of this session."""
    name = os.path.splitext(os.path.basename(path))[0]
    if spark.catalog.functionExists(name):
        return name
    jvm = spark._jvm
    with open(path) as f:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(f.read())
    jar = os.path.join(tempfile.mkdtemp(prefix="starling-jar-"), f"{name}-{uuid.uuid4().hex[:12]}.jar")  # a context takes a file name once
    with zipfile.ZipFile(jar, "w") as z:
        for class_name, code in compiler.getBytecodes().items():
            z.writestr(f"{class_name.replace('.', '/')}.class", bytes(code))
    spark.sql(f"ADD JAR '{jar}'")
    found = jvm.java.lang.Class.forName(name, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    spark._jsparkSession.udf().register(name, found.newInstance(), spark._jsparkSession.parseDataType(T.DataType.fromDDL(return_type).json()))
    return name
