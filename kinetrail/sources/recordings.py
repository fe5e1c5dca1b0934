"""Recording metadata, long tracking rows and annotations: scans by metadata, row predicates, pivot to one row a frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def root_of(split: str, train: str, test: str) -> str:
    """Where a split's files lie; `valid` reads the training files."""
    if split not in ("train", "valid", "test"):
        raise ValueError(f"split must be train, valid or test, not {split!r}")
    return test if split == "test" else train


def scan(spark: SparkSession, root: str, metadata: DataFrame, schema: str) -> DataFrame:
    """Rows of `root/<lab_id>/<video_id>.parquet` of the recordings that metadata lists, with lab_id and video_id (as
    strings) from the path: one scan of the folder and a semi-join, not one read a file. A file that is not listed is
    dropped, a listed recording without a file gives no rows."""
    path = F.col("_metadata.file_path")
    place = lambda k: F.url_decode(F.regexp_extract(path, r"([^/]+)/([^/]+)\.parquet$", k))
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root).select("*", place(1).alias("lab_id"), place(2).alias("video_id"))
    listed = metadata.select(F.col("lab_id").cast("string").alias("lab_id"), F.col("video_id").cast("string").alias("video_id")).distinct()
    return rows.join(listed, ["lab_id", "video_id"], "left_semi")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def sleeping(special: str, lab: str = "lab_id", condition: str = "mouse1_condition") -> Column:
    """Whether a recording is of a lab whose name holds `special` and was made with lights on; null counts as no."""
    return F.coalesce(F.col(lab).contains(special) & (F.lower(condition) == "lights on"), F.lit(False))


def present(columns: list[str]) -> Column:
    """How many of the columns are not null."""
    return reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))


def select_recordings(metadata: DataFrame, special: str, strains: list[str], section: str | None = None, deny: list[int] | None = None, drop_sleeping: bool = True) -> DataFrame:
    """Metadata with n_mice and sleeping, without denied recordings, those of other sections (body_parts_tracked, the exact
    string), those without behaviors_labeled and, if asked, sleeping ones. A null video_id is not denied."""
    rows = metadata.withColumns({"n_mice": present(strains), "sleeping": sleeping(special)}).filter(F.col("behaviors_labeled").isNotNull())
    if deny:
        rows = rows.filter(F.col("video_id").isNull() | ~F.col("video_id").isin(deny))
    if section is not None:
        rows = rows.filter(F.col("body_parts_tracked") == section)
    return rows.filter(~F.col("sleeping")) if drop_sleeping else rows


def drop_parts(tracking: DataFrame, unstable: list[str], more_than: int = 5) -> DataFrame:
    """tracking (video_id, bodypart, ...) without the unstable parts where a video has more than so many distinct parts."""
    counts = tracking.groupBy("video_id").agg(F.count_distinct("bodypart").alias("_parts")).filter(F.col("_parts") > more_than).select(F.col("video_id").alias("_video"))
    marked = tracking.join(counts, F.col("video_id").eqNullSafe(F.col("_video")), "left")
    return marked.filter(F.col("_video").isNull() | ~F.col("bodypart").isin(unstable) | F.col("bodypart").isNull()).drop("_video")


def wide(tracking: DataFrame, parts: list[str], keys: tuple[str, ...] = ("video_id", "mouse_id", "video_frame"), per_cm: str | None = None) -> DataFrame:
    """One row a frame with `<part>_x`, `<part>_y` (NaN is null; divided by the column per_cm if given). A key that has two
    rows of a part is an error. Other parts are left out."""
    scale = F.col(per_cm) if per_cm else F.lit(1.0)
    value = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) / scale
    of = lambda p: F.col("bodypart") == p
    cells = []
    for p in parts:
        n = F.count(F.when(of(p), 1))
        for c in "xy":
            once = F.when(n <= 1, F.max(F.when(of(p), value(c)))).otherwise(F.raise_error(F.lit(f"two rows of {p} in one frame")).cast("double"))
            cells.append(once.alias(f"{p}_{c}"))
    return tracking.filter(F.col("bodypart").isin(parts)).groupBy(*keys).agg(*cells)


def labelled_frames(frames: DataFrame, labels: DataFrame, raster: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, action, y): each frame with each action that is labelled in its sequence (labels: keys, action), y
    true where the raster (keys, frame, action) holds it. What is not labelled has no row."""
    rows = frames.select(*keys, "frame").join(labels.select(*keys, "action").distinct(), keys)
    return rows.join(raster.select(*keys, "frame", "action", F.lit(True).alias("_y")).distinct(), [*keys, "frame", "action"], "left").withColumn("y", F.coalesce("_y", F.lit(False))).drop("_y")


def trainable(rows: DataFrame, actions: list[str]) -> DataFrame:
    """rows (action, y, ...) of the listed actions that have both classes."""
    both = rows.filter(F.col("action").isin(actions)).groupBy("action").agg(F.count_distinct("y").alias("_n")).filter("_n > 1").select("action")
    return rows.join(F.broadcast(both), "action", "left_semi")


def aligned(df: DataFrame, names: list[str], keep: list[str], fill: float | None = 0.0) -> DataFrame:
    """keep and the named columns, in order, as floats; a column that df lacks is `fill`, a null value stays null."""
    return df.select(*keep, *((F.col(f"`{n}`") if n in df.columns else F.lit(fill)).cast("float").alias(n) for n in names))


def write_features(df: DataFrame, path: str, version: str) -> DataFrame:
    """df written under path/version (once: an existing one is read), so a changed transform can't read stale rows."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}/_SUCCESS")):
        df.write.mode("overwrite").parquet(f"{path}/{version}")
    return spark.read.schema(df.schema).parquet(f"{path}/{version}")


def write_split(groups: DataFrame, path: str) -> None:
    """The manifest of a split: (group, held_out)."""
    groups.write.mode("overwrite").parquet(path)
