"""Session construction and cluster-safe helpers shared by every operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC wall clock, ANSI arithmetic, adaptive
# execution with skew-join splitting and partition coalescing.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "crisismap", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster ``master`` stays ``None`` so spark-submit decides; tests pass
    ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(key, conf[key])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster the library never invents a machine-local folder: if nothing
    is configured it raises. Only a ``local[...]`` session (one machine, where
    local is shared) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        # a single-machine session (tests, local runs): its own scratch folder is the shared folder
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="crisismap-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder for checkpoints")


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the configured checkpoint folder; only set ``fallback`` when none is set (tests)."""
    try:
        return checkpoint_dir(spark)
    except RuntimeError:
        os.makedirs(fallback, exist_ok=True)
        spark.sparkContext.setCheckpointDir(fallback)
        return spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder, for tables that are written and read again."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    For loops: unlike ``checkpoint()`` the plan that goes on knows the table's true
    size (estimates of joins would multiply round after round), and columns are pruned.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` provably holds at most ``max_rows`` rows.

    Counts at most ``max_rows + 1`` rows, so the check itself is cheap even
    when the answer is no.
    """
    return df.limit(max_rows + 1).count() <= max_rows


# What a dimension side may hold before it stops being broadcast: rows, and bytes of their JSON form.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 128 << 20
# Estimated bytes for each core below which spread() deals an input anew.
SPREAD_BYTES = 16 << 20


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                    max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """Return ``(broadcast(df), True)`` when its size is proven small, else ``(df, False)``.

    Rows alone prove nothing (a polygon may have any number of vertices), so the
    bytes of at most ``max_rows + 1`` rows are added up too.
    """
    from pyspark.sql import functions as F

    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    size = df.limit(max_rows + 1).select(F.length(F.to_json(whole)).alias("b")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    if size["n"] <= max_rows and size["b"] <= max_bytes:
        return F.broadcast(df), True
    return df, False


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin an under-partitioned input (e.g. one Parquet row group) over the cluster's cores.

    Per-row text work (regex scans, tokenising whole documents) is CPU-bound;
    a scan that yields fewer partitions than there are cores would run it on
    one core. An input that fills all cores anyway (any large table) passes
    untouched, so no shuffle is added at scale.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    # the optimizer's size estimate: reads the plan only and runs no job
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < target * SPREAD_BYTES:
        return df.repartition(target)
    return df


def keep(df: DataFrame) -> DataFrame:
    """Reuse an intermediate table several times without recomputing it.

    Stored on executor disk only: a job that reads a few reused tables should
    not hold them in the heap that sorts, aggregates and broadcasts need, and
    cached blocks of many sequential jobs must not pile up in memory.
    """
    from pyspark import StorageLevel

    return df.persist(StorageLevel.DISK_ONLY)


def left_join_spread(left: DataFrame, right: DataFrame, key: str, *salt: str) -> DataFrame:
    """Left equi join on a ``key`` that many rows lack.

    A shuffle sends all rows of a NULL key to one task. They match nothing, so here they are
    dealt by a hash of their ``salt`` columns instead.
    """
    from pyspark.sql import functions as F

    dealt = left.withColumn("_deal", F.coalesce(F.col(key).cast("long"), F.xxhash64(*salt)))
    other = right.withColumnRenamed(key, "_key").withColumn("_there", F.col("_key").cast("long"))
    match = (F.col("_deal") == F.col("_there")) & F.col(key).isNotNull()
    return dealt.join(other, match, "left").drop("_deal", "_there", "_key")
