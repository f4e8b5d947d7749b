"""Session helpers: building a session for tests/bench and materialising
intermediate results into the shared checkpoint folder.

Lineage is cut by writing Parquet under the folder the cluster names in
``spark.checkpoint.dir`` (read from the session).  Only when that setting is
unset (tests, ad-hoc local runs) do we choose a folder ourselves, and then only
in local mode, where the driver's disk *is* the shared disk.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN_TAG = uuid.uuid4().hex[:12]
_counter = [0]
_tables: list[str] = []      # bucketed state tables registered by this process


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "matchbook", extra: dict | None = None) -> SparkSession:
    """Session used by tests and the benchmark (the library never requires it)."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # Local runs: keep about one shuffle partition per core even for
         # small data, and let small files split across cores.
         .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
         .config("spark.sql.files.openCostInBytes", "262144")
         .config("spark.sql.files.maxPartitionBytes", str(16 * 1024 * 1024))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates.

    Order: ``spark.checkpoint.dir`` from the session conf, then the
    SparkContext's checkpoint dir; if neither is set and the master is local,
    a fresh temp folder (set on the context so later calls agree).  On a
    cluster with no checkpoint dir we refuse rather than write machine-local
    files that other executors cannot read.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    sc = spark.sparkContext
    ctx_dir = sc.getCheckpointDir()
    if ctx_dir:
        return ctx_dir.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", sc.master):     # not local-cluster[...]
        d = tempfile.mkdtemp(prefix="matchbook-ckpt-")
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir().rstrip("/")
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


def materialize(df: DataFrame, tag: str, bucket_by: str | None = None,
                compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    One job computes the data once (unlike ``RDD.checkpoint``, which recomputes
    it for the write), the files survive executor loss, and the returned plan
    starts from a plain Parquet scan so later stages get pushdown and pruning.

    With ``bucket_by`` the files are written as a table bucketed on that
    column (one bucket per shuffle partition, sorted on it), so a later
    sort-merge join on the column reads this side already partitioned and
    sorted, and shuffles only the other side.
    The bucket spec lives in the session catalog, so the files are registered
    as an external table named ``mb_<process tag>_...`` in the current
    database; ``drop_scratch`` removes both.  ``compression`` is the codec of the
    files, for tables as large as the input.
    """
    spark = df.sparkSession
    _counter[0] += 1
    path = f"{checkpoint_root(spark)}/matchbook/{_RUN_TAG}/{_counter[0]:05d}-{tag}"
    out = df.write.mode("overwrite")
    if compression is not None:
        out = out.option("compression", compression)
    if bucket_by is None:
        out.parquet(path)
        return spark.read.schema(df.schema).parquet(path)     # no job to infer the schema
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "mb_" + re.sub(r"[^0-9A-Za-z_]", "_", f"{_RUN_TAG}_{_counter[0]:05d}_{tag}")
    (out.format("parquet").bucketBy(n, bucket_by).sortBy(bucket_by)
     .option("path", path).saveAsTable(name))
    _tables.append(name)
    return spark.table(name)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the shared checkpoint root (not created)."""
    _counter[0] += 1
    return f"{checkpoint_root(spark)}/matchbook/{_RUN_TAG}/{_counter[0]:05d}-{tag}-{os.getpid()}"


def drop_scratch(spark: SparkSession) -> bool:
    """Delete this process's intermediates under the checkpoint folder and
    the bucketed state tables it registered.

    Call it once the result has been written and no frame returned by the
    library is used any more (they read those files).  Goes through the
    Hadoop FileSystem API, so it works for any shared file system."""
    for name in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _tables.clear()
    root = f"{checkpoint_root(spark)}/matchbook/{_RUN_TAG}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True)) if fs.exists(path) else False
