"""Ordered rows of sequences as arrays, and how Spark deals them to tasks: one exchange of the frames by sequence, rate and
block of frames, with the rows of neighbouring blocks that windows reach for."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.functions.kernel import Array, Chunks, Decay, Ranks, after, decaying, lagged
from kinetrail.functions.windows import bounds, scale

Point = tuple[Array, Array]
#: Frames of a block.
BLOCK = 1 << 16
#: Rows (at 30 a second) before and after a block that its windows may reach for.
REACH = 600
#: Columns that name a row, where they are there.
KEYS = ("agent", "target", "seq", "frame")


def zero(x: Array) -> Array:
    return np.where(np.isnan(x), 0.0, x)


def flag(x: Array) -> Array:
    """1.0 where x holds, else 0.0 (a comparison with a missing value doesn't)."""
    return np.asarray(x, np.float64)


@dataclass
class Frames:
    """Rows of one sequence in order: columns (missing values are NaN), rate, rows of the whole sequence."""

    columns: dict[str, Array]
    fps: float
    total: int
    texts: dict[str, str] = field(default_factory=dict)  # columns that hold one text for the sequence
    own: slice = slice(None)  # rows that are not a neighbour's
    carried: list[Decay] | None = None
    _memo: dict = field(default_factory=dict)

    def __len__(self) -> int:
        return len(next(iter(self.columns.values()), ()))

    def tracked(self, side: str = "") -> list[str]:
        return [c[len(side) : -2] for c in self.columns if c.startswith(side) and c.endswith("_x") and f"{c[:-2]}_y" in self.columns]

    def point(self, part: str, side: str = "") -> Point:
        return self.columns[f"{side}{part}_x"], self.columns[f"{side}{part}_y"]

    def n(self, width: float) -> int:
        """Rows of a window given for 30 a second."""
        return scale(width, self.fps)

    def _kept(self, what: tuple, make: Callable, *of: Array):
        """make(), once for each arrays and window."""
        key = (what, *map(id, of))
        if key not in self._memo:
            self._memo[key] = (make(), of)
        return self._memo[key][0]

    def window(self, x: Array, width: int, least: int, kind: str, side: str = "trailing") -> Array:
        """mean, sum, var, std, min, max or median over width rows; NaN where fewer than least values are there."""
        back, ahead = bounds(width, side)
        back = -back
        if kind == "median":
            count, out = self._kept(("ranks",), lambda: Ranks(x), x).median(back, ahead)
            return np.where(count >= max(1, least), out, np.nan)
        chunks = self._kept(("chunks", len(x), back, ahead), lambda: Chunks(len(x), back, ahead))
        count, mean, squares, _, _ = self._kept(("moments", back, ahead), lambda: chunks.moments(x), x)
        few = max(1, least)
        if kind in ("min", "max"):
            out = chunks.extreme(x, np.fmin if kind == "min" else np.fmax)
        elif kind in ("mean", "sum"):
            out = mean if kind == "mean" else mean * count
        else:
            out, few = squares / np.maximum(count - 1, 1), max(2, least)
            out = np.sqrt(out) if kind == "std" else out
        return np.where(count >= few, out, np.nan)

    def past(self, x: Array, width: int, least: int, kind: str) -> Array:
        return self.window(x, width, least, kind)

    def mid(self, x: Array, width: int, least: int, kind: str) -> Array:
        return self.window(x, width, least, kind, "centred")

    def ahead(self, x: Array, width: int, least: int, kind: str) -> Array:
        return self.window(x, width, least, kind, "future")

    def correlation(self, x: Array, y: Array, width: int, least: int) -> Array:
        """Pearson correlation of x and y where both are there, over the trailing window; NaN for a constant side."""
        both = ~np.isnan(x) & ~np.isnan(y)
        x, y = np.where(both, x, np.nan), np.where(both, y, np.nan)
        chunks = Chunks(len(x), width - 1, 0)
        count, _, sx, _, products = chunks.moments(x, y)
        sy = chunks.moments(y)[2]
        moves = np.ones(len(x), bool)
        for v in (x, y):  # rounding leaves a constant side a spread
            moves &= chunks.extreme(v, np.fmax) > chunks.extreme(v, np.fmin)
        return np.where(moves & (count >= max(2, least)), products / np.sqrt(np.where(moves, sx * sy, 1.0)), np.nan)

    def rank_share(self, x: Array, width: int, least: int) -> Array:
        """Average rank of each value among those of its trailing window, as a share of them."""
        count, share = self._kept(("ranks",), lambda: Ranks(x), x).share(width - 1)
        return np.where(~np.isnan(x) & (count >= max(1, least)), share, np.nan)

    def lag(self, x: Array, k: int = 1) -> Array:
        """x k rows before, or -k rows after."""
        return lagged(x, k)

    def diff(self, x: Array, k: int = 1) -> Array:
        return x - lagged(x, k)

    def step(self, p: Point, k: int = 1) -> Array:
        return np.hypot(self.diff(p[0], k), self.diff(p[1], k))

    def long_enough(self, x: Array, width: int) -> Array:
        """x where the sequence has width rows."""
        return x if self.total >= width else np.full(len(x), np.nan)

    def decays(self, wanted: list[tuple[str, Array, float]]) -> dict[str, Array]:
        """Exponentially weighted means (name, values, span) of the sequence's own rows."""
        out = {}
        for k, (name, x, span) in enumerate(wanted):
            out[name] = np.full(len(x), np.nan)
            out[name][self.own] = decaying(x[self.own], span, self.carried[k] if self.carried else Decay())[0]
        return out


Family = Callable[[Frames], dict[str, Array]]


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a local session gets one where that is unset."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        place = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{uuid.uuid4().hex}"


class _Noted(dict):
    """Columns that remember which of them were read."""

    def __init__(self, *args):
        super().__init__(*args)
        self.read: set[str] = set()

    def __getitem__(self, name: str) -> Array:
        self.read.add(name)
        return super().__getitem__(name)


def _numbers(c: pa.ChunkedArray) -> Array:
    return c.cast(pa.float64()).to_numpy()


class Plan:
    """What some families need of df and what they give."""

    def __init__(self, df: DataFrame, families: list[Family], fps: str):
        self.families = families
        kinds = dict(df.dtypes)
        self.texts = [c for c, k in kinds.items() if k == "string" and c not in KEYS]
        numbers = [c for c, k in kinds.items() if c not in (*KEYS, fps) and k.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
        seen = _Noted({c: np.full(2, np.nan) for c in numbers})
        told = _Noted({c: "" for c in self.texts})
        with np.errstate(all="ignore"):
            self.names = list(self.compute(Frames(seen, 30.0, 2, told)))
        self.numbers, self.texts = [c for c in numbers if c in seen.read], [c for c in self.texts if c in told.read]
        self.keys = [k for k in KEYS if k in df.columns]
        self.decays = next((f.decays for f in families if hasattr(f, "decays")), None)

    def compute(self, s: Frames) -> dict[str, Array]:
        out: dict[str, Array] = {}
        for f in self.families:
            out |= f(s)
        return out

    def schema(self, df: DataFrame) -> T.StructType:
        return T.StructType([*df.select(*self.keys).schema.fields, *[T.StructField(n, T.DoubleType()) for n in self.names]])

    def frames(self, table: pa.Table, own: Array | None = None, total: int | None = None, carried: list[Decay] | None = None) -> Frames:
        columns = {c: _numbers(table.column(c)) for c in self.numbers}
        texts = {c: next((x for x in table.column(c).to_pylist() if x is not None), "") for c in self.texts}
        part = slice(None)
        if own is not None:
            at = np.flatnonzero(own)
            part = slice(int(at[0]), int(at[-1]) + 1) if len(at) else slice(0, 0)
        return Frames(columns, table.column("_fps")[0].as_py(), total or table.num_rows, texts, part, carried)

    def table(self, table: pa.Table, s: Frames) -> pa.Table:
        with np.errstate(all="ignore"):
            found = self.compute(s)
        rows = range(table.num_rows)[s.own]
        kept = table.select(self.keys).slice(rows.start, len(rows))
        for name in self.names:
            kept = kept.append_column(name, pa.array(np.broadcast_to(found[name], table.num_rows)[s.own], pa.float64(), from_pandas=True))
        return kept


def _ordered(table: pa.Table) -> pa.Table:
    return table.take(pa.compute.sort_indices(table, sort_keys=[("frame", "ascending")], null_placement="at_start"))


def _sides(keys: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Of each block of a sequence, the blocks that reach into it, and the rows of the sequence."""

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        rows, need = table.column("_rows").to_numpy(), table.column("_need")[0].as_py()
        upto, place = np.cumsum(rows), table.column("_block").to_numpy()
        # blocks between which and this one there are fewer rows than windows reach for
        last = np.minimum(np.searchsorted(upto, upto + need), len(rows) - 1)
        first = np.searchsorted(upto, upto - rows - need, side="right")
        table = table.append_column("_targets", pa.array([place[a : b + 1] for a, b in zip(first, last)], pa.list_(pa.int64())))
        return table.append_column("_total", pa.array(np.full(len(rows), upto[-1]), pa.int64())).select([*keys, "_block", "_head", "_tail", "_targets", "_total"])

    return make


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (seq, _fps, _need, frame, ...) for each block (_target) that holds or reaches for them; _own: it holds them.
    Blocks are counted in a first pass over three columns, and the few numbers of each are written to the shared folder."""
    spark, keys = rows.sparkSession, ["seq", "_fps", "_need"]
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.col("frame") / size).cast("long"), F.lit(-(2**62))))
    at = F.coalesce(F.col("frame") - F.col("_block") * size, F.lit(0))
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"), F.count_if(at < F.col("_need")).alias("_head"), F.count_if(at >= size - F.col("_need")).alias("_tail"))
    schema = T.StructType([*rows.select(*keys).schema.fields, *[T.StructField(n, T.LongType()) for n in ("_block", "_head", "_tail")], T.StructField("_targets", T.ArrayType(T.LongType())), T.StructField("_total", T.LongType())])
    path = scratch(spark)
    counts.groupBy(*keys).applyInArrow(_sides(keys), schema).write.parquet(path)
    sides = spark.read.schema(schema).parquet(path).withColumnsRenamed({k: f"{k}_of" for k in [*keys, "_block"]})
    same = F.lit(True)
    for k in [*keys, "_block"]:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    met = rows.join(sides, same).withColumn("_target", F.explode("_targets"))
    own, after_it = F.col("_target") == F.col("_block"), F.col("_target") > F.col("_block")
    met = met.filter(own | (after_it & ((F.col("_tail") < F.col("_need")) | (at >= size - F.col("_need")))) | (~own & ~after_it & ((F.col("_head") < F.col("_need")) | (at < F.col("_need")))))
    return met.select(*rows.columns, "_target", "_total", own.alias("_own"))


def _carried(blocks: DataFrame, plan: Plan) -> DataFrame:
    """(seq, _fps, _target, _carried): of each block and exponentially weighted mean, what the blocks before it carry on."""

    def parts(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        s = plan.frames(table, table.column("_own").to_numpy(zero_copy_only=False))
        n = len(range(len(s))[s.own])
        ends = [(decaying(x[s.own], span)[1], span) for _, x, span in plan.decays(s)]
        told = [[e.mean, e.weight, float(e.age), float(n), float(span)] for e, span in ends]
        return table.select(["seq", "_fps", "_target"]).slice(0, 1).append_column("_parts", pa.array([told], pa.list_(pa.list_(pa.float64()))))

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("_target")
        held, out = None, []
        for told in table.column("_parts").to_pylist():
            held = held or [Decay() for _ in told]
            out.append([[h.mean, h.weight, float(h.age)] for h in held])
            held = [after(h, int(n), Decay(mean, weight, int(age)), span) for h, (mean, weight, age, n, span) in zip(held, told)]
        return table.drop(["_parts"]).append_column("_carried", pa.array(out, pa.list_(pa.list_(pa.float64()))))

    keys = blocks.select("seq", "_fps", "_target").schema.fields
    nested = T.ArrayType(T.ArrayType(T.DoubleType()))
    found = blocks.groupBy("seq", "_fps", "_target").applyInArrow(parts, T.StructType([*keys, T.StructField("_parts", nested)]))
    return found.groupBy("seq", "_fps").applyInArrow(chain, T.StructType([*keys, T.StructField("_carried", nested)]))


def features(df: DataFrame, *families: Family, fps: str = "fps", default: float = 30.0, block: int | None = BLOCK, reach: int = REACH) -> DataFrame:
    """The keys of df (agent, target, seq, frame, where they are there) with the columns of all families, in one exchange of
    the frames. Window widths follow each sequence's rate (column fps; null counts as `default`; rows of one sequence with
    different rates are different sequences). Missing coordinates are null or NaN; rows whose seq is null are one sequence,
    null frames come first, rows that share a frame in any order. Only columns that the families read are taken.

    A sequence is a task's work up to `block` frames. A longer one is cut into blocks, and each gets the rows of its
    neighbours that windows of up to `reach` rows (at 30 a second, on either side, summed over windows of windows) look
    at; exponentially weighted means carry two numbers from block to block. None: sequences stay whole.
    """
    plan = Plan(df, list(families), fps)
    rate = F.nanvl(F.coalesce(F.col(fps).cast("double"), F.lit(float(default))), F.lit(float(default)))
    rows = df.select(*plan.keys, *plan.numbers, *plan.texts, rate.alias("_fps"))
    schema = plan.schema(df)
    split = False
    if block:
        ends = rows.groupBy("seq", "_fps").agg(F.floor(F.min("frame") / block).alias("a"), F.floor(F.max("frame") / block).alias("b"))
        split = bool(ends.filter("a <> b").head(1))
    if not split:

        def whole(table: pa.Table) -> pa.Table:
            table = _ordered(table)
            return plan.table(table, plan.frames(table))

        return rows.groupBy("seq", "_fps").applyInArrow(whole, schema)

    blocks = _in_blocks(rows.withColumn("_need", F.ceil(F.col("_fps") * reach / 30).cast("long")), block)

    def part(table: pa.Table, carried: list[Decay] | None) -> pa.Table:
        table = _ordered(table)
        return plan.table(table, plan.frames(table, table.column("_own").to_numpy(zero_copy_only=False), table.column("_total")[0].as_py(), carried))

    by = ("seq", "_fps", "_target")
    if not plan.decays:

        def alone(table: pa.Table) -> pa.Table:
            return part(table, None)

        return blocks.groupBy(*by).applyInArrow(alone, schema)

    def with_carry(table: pa.Table, carry: pa.Table) -> pa.Table:
        return part(table, [Decay(mean, weight, int(age)) for mean, weight, age in carry.column("_carried")[0].as_py()])

    return blocks.groupBy(*by).cogroup(_carried(blocks, plan).groupBy(*by)).applyInArrow(with_carry, schema)
