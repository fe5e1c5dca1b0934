"""Sequences of one entity and of directed pairs, with their labels or the actions to predict, from metadata, long tracking
rows and annotations, in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.operators import intervals, labels
from kinetrail.operators.pairing import directed
from kinetrail.sources import recordings

#: A recording's name in every table.
RECORDING = ("lab_id", "video_id")
#: What of a recording goes along with its frames.
SETTING = ("fps", "arena_width", "arena_height", "arena_shape")


@dataclass(frozen=True)
class Parameters:
    """How sequences are made. split: train and valid sequences have labels, test ones the actions to predict. parts: those
    that get columns. unstable: parts dropped where a recording has more than more_than. deny: recordings (lab_id, video_id)
    whose identities are wrong, left out where labels are wanted."""

    split: str = "train"
    parts: tuple[str, ...] = ()
    unstable: tuple[str, ...] = ()
    more_than: int = 5
    deny: tuple[tuple[str, int], ...] = ()
    entity: str = "mouse"
    metadata: dict[str, str] = field(default_factory=lambda: {"fps": "frames_per_second", "arena_width": "arena_width_cm", "arena_height": "arena_height_cm", "arena_shape": "arena_shape", "per_cm": "pix_per_cm_approx"})

    @property
    def labelled(self) -> bool:
        return self.split != "test"


def siblings(spark: SparkSession, root: str, suffix: str = "parquet") -> DataFrame:
    """(lab_id, video_id) of the files `root/<lab_id>/<video_id>.<suffix>` that exist: names only, no file is opened, and
    Spark lists the folders. An absent root: no rows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "lab_id string, video_id string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root).select("path")
    part = lambda k: F.url_decode(F.regexp_extract("path", rf"([^/]+)/([^/]+)\.{suffix}$", k))
    return files.select(part(1).alias("lab_id"), part(2).alias("video_id"))


def number(c: str | Column) -> Column:
    """The digits that end a name, as a number; null if there are none."""
    return F.nullif(F.regexp_extract(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), r"(\d+)$", 1), F.lit("")).cast("long")


def _recording() -> Column:
    return F.struct(*(F.col(c).cast("string").alias(c) for c in RECORDING))


@dataclass
class Sequences:
    """single: (video, agent, target, seq, frame, settings, `<part>_x`, `<part>_y`, actions, and y where labels are wanted);
    pair: the same with `A_` and `B_` parts. video is the recording, target `self` in single sequences, actions the sorted
    actions listed for it, y whether each of them is annotated at the frame."""

    single: DataFrame
    pair: DataFrame


def frames(metadata: DataFrame, tracking: DataFrame, p: Parameters) -> DataFrame:
    """(video, entity, frame, settings, parts in cm): tracking (lab_id, video_id, mouse_id, video_frame, bodypart, x, y) of
    the recordings of metadata that list behaviours, one row a frame."""
    listed = metadata.filter(F.col("behaviors_labeled").isNotNull())
    told = listed.select(_recording().alias("video"), *(F.col(p.metadata[c]).alias(c) for c in (*SETTING, "per_cm")))
    rows = tracking.withColumn("video", _recording()).drop(*RECORDING)
    if p.unstable:
        rows = recordings.drop_parts(rows.withColumnRenamed("video", "video_id"), list(p.unstable), p.more_than).withColumnRenamed("video_id", "video")
    rows = rows.join(told, "video")
    return recordings.wide(rows.withColumnsRenamed({"mouse_id": "entity", "video_frame": "frame"}), list(p.parts), ("video", "entity", "frame", *SETTING), per_cm="per_cm")


def _labelled(sequences: DataFrame, annotation: DataFrame) -> DataFrame:
    """sequences (video, a, t, frame, actions, ...) with y: map of each listed action to whether an interval of annotation
    (video, a, t, action, start, stop; both ends included) holds the frame."""
    on = ["video", "a", "t"]
    held = intervals.raster(sequences.select(*on, "frame"), annotation, on).groupBy(*on, "frame").agg(F.collect_set("action").alias("_held"))
    rows = sequences.join(held, [*on, "frame"], "left")
    return rows.withColumn("y", F.map_from_arrays("actions", F.transform("actions", lambda x: F.coalesce(F.array_contains("_held", x), F.lit(False))))).drop("_held")


def assemble(metadata: DataFrame, tracking: DataFrame, p: Parameters, annotation: DataFrame | None = None, annotated: DataFrame | None = None) -> Sequences:
    """Sequences of every recording that lists behaviours and is tracked. metadata: (lab_id, video_id, behaviors_labeled,
    and the columns that p.metadata names); annotation: (lab_id, video_id, agent_id, target_id, action, start_frame,
    stop_frame); annotated: the recordings that have an annotation (see siblings()), those with a row if not given. Where
    labels are wanted, recordings without annotation and those of p.deny have no sequence.

    A label `agent,self,action` makes a single sequence of the entity that agent names (see labels.resolve), `agent,target,
    action` a pair sequence of the two entities with those numbers; labels that name no tracked entity make none. Intervals
    of actions that are not listed for a sequence are left out. Null or malformed lists, empty tables: no rows.
    """
    meta = metadata
    if p.labelled:
        if annotation is None:
            raise ValueError(f"{p.split} sequences need annotations")
        known = (annotated if annotated is not None else annotation).select(*(F.col(c).cast("string").alias(f"_{c}") for c in RECORDING)).distinct()
        meta = meta.join(known, (F.col("lab_id").cast("string") == F.col("_lab_id")) & (F.col("video_id").cast("string") == F.col("_video_id")), "left_semi")
        for lab, video in p.deny:
            meta = meta.filter(~F.coalesce((F.col("lab_id") == lab) & (F.col("video_id").cast("string") == str(video)), F.lit(False)))
    rows = frames(meta, tracking, p)
    wanted = labels.listed(meta.withColumn("video", _recording()), "behaviors_labeled", "video").filter("agent is not null and target is not null and action is not null")
    entities = rows.select("video", "entity").distinct()
    actions = F.array_sort(F.collect_set("action")).alias("actions")

    alone = wanted.filter("target = 'self'").groupBy("video", "agent", "target").agg(actions)
    ids = labels.resolve(alone.select("video", F.col("agent").alias("raw")), entities.select("video", F.col("entity").cast("string").alias("id")), "video").filter("id is not null")
    alone = alone.join(ids.select("video", F.col("raw").alias("agent"), "id"), ["video", "agent"])
    single = rows.withColumn("id", F.col("entity").cast("string")).join(alone, ["video", "id"]).drop("id")
    single = single.withColumns({"seq": F.struct("video", "agent", "target"), "a": number("entity"), "t": number("entity")}).drop("entity")

    both = wanted.filter("target <> 'self'").groupBy("video", "agent", "target").agg(actions)
    numbered = entities.withColumn("n", number("entity")).withColumn("name", F.concat(F.lit(p.entity), F.col("n").cast("string")))
    side = lambda name: numbered.select("video", F.col("name").alias(name), F.col("entity").alias(f"{name}_entity"), F.col("n").alias(name[0]))
    both = both.join(side("agent"), ["video", "agent"]).join(side("target"), ["video", "target"]).filter("agent <> target")
    allowed = both.select("video", F.col("agent_entity").alias("agent"), F.col("target_entity").alias("target"))
    pair = directed(rows, allowed).withColumnsRenamed({"agent": "agent_entity", "target": "target_entity"}).drop("seq", "fps")
    settings = meta.select(_recording().alias("video"), *(F.col(p.metadata[c]).alias(c) for c in SETTING))
    pair = pair.join(both, ["video", "agent_entity", "target_entity"]).join(settings, "video").drop("agent_entity", "target_entity")
    pair = pair.withColumn("seq", F.struct("video", "agent", "target"))

    if p.labelled:
        marks = annotation.select(_recording().alias("video"), number("agent_id").alias("a"), number("target_id").alias("t"), F.lower("action").alias("action"), F.col("start_frame").cast("long").alias("start"), F.col("stop_frame").cast("long").alias("stop"))
        single, pair = _labelled(single, marks.filter("a = t")), _labelled(pair, marks.filter("a <> t"))
    return Sequences(single.drop("a", "t"), pair.drop("a", "t"))
