"""Product quantisation with Yinyang Lloyd rounds over whole numbers.

Each part of a vector keeps, from round to round, an upper bound of the distance to its entry and a lower bound for each
group of the codebook's other entries. Entries that move by d shift the bounds by d; a group is scanned only where its
bound no longer lies above the entry's. Distances are sums of squared whole numbers: doubles hold them exactly while
components stay below 2**20, and the few numbers beyond are compared as Python integers, so that ties are settled exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import discard, fresh, frugal, stored

#: Components below this, in parts of at most LONGEST of them, have exact distances in double precision.
PLAIN, LONGEST = 1 << 20, 1 << 11
#: Bits of the limbs that sums of whole numbers travel in.
LIMB = 32
#: Slack by which a bound must win, far above the rounding of 32-bit bounds.
SLACK = 1e-5


def whole(column: pa.Array, scale: int) -> tuple[list[int], list[bytes]]:
    """Which rows of a column of lists of doubles hold finite numbers only (one at least), and floor(scale * x) of theirs,
    for a power of two, as bytes: 2 or 4 a number below PLAIN, else decimals."""
    flat = column.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    stop = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = np.flatnonzero((stop > start) & (odd[stop] == odd[start]))
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(flat * scale)
        two, four = np.abs(y) < 1 << 15, np.abs(y) < PLAIN
        short, long = np.where(two, y, 0).astype("<i2"), np.where(four, y, 0).astype("<i4")
    past_two, past_four = (np.concatenate([[0], np.cumsum(~m)]) for m in (two, four))
    out = []
    for a, b in zip(start[ok].tolist(), stop[ok].tolist()):
        if past_two[a] == past_two[b]:
            out.append(b"h" + short[a:b].tobytes())
        elif past_four[a] == past_four[b]:
            out.append(b"i" + long[a:b].tobytes())
        else:
            out.append(b"d" + ",".join(str(int(j) if np.isfinite(j) else int(i) * scale) for i, j in zip(flat[a:b].tolist(), y[a:b].tolist())).encode())
    return ok.tolist(), out


def numbers(rows: list[bytes], dims: int) -> np.ndarray:
    """The matrix of rows of one kind: int64, or Python integers."""
    kind = rows[0][:1]
    if kind == b"d":
        out = np.empty((len(rows), dims), object)
        out[:] = [[int(p) for p in r[1:].split(b",")] for r in rows]
        return out
    return np.frombuffer(b"".join(r[1:] for r in rows), "<i2" if kind == b"h" else "<i4").astype(np.int64).reshape(len(rows), dims)


def length(row: bytes) -> int:
    return row.count(b",") + 1 if row[:1] == b"d" else (len(row) - 1) // (2 if row[:1] == b"h" else 4)


def limbs(x: int) -> list[int]:
    """x = sum of limbs[k] << (LIMB * k), all with the sign of x."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x:
        out.append(sign * (x & ((1 << LIMB) - 1)))
        x >>= LIMB
    return out


@dataclass
class Codebook:
    """entries[part][entry]: lists of whole numbers; group[part][entry]; drift[part][entry]: how far an entry moved in the
    last round, None where bounds can't follow."""

    entries: list[list[list[int]]]
    group: np.ndarray
    drift: list[np.ndarray | None]

    def array(self, part: int) -> np.ndarray:
        wide = any(abs(x) >= PLAIN for e in self.entries[part] for x in e) or len(self.entries[part][0]) > LONGEST
        return np.array(self.entries[part], object if wide else np.int64)

    def moved(self, sums: dict[tuple[int, int], list[int]], counts: dict[tuple[int, int], int]) -> Codebook:
        """Each entry replaced by the floors of its parts' means; unused entries stay."""
        new = [[[x // counts[p, e] for x in sums[p, e]] if counts.get((p, e)) else old for e, old in enumerate(part)] for p, part in enumerate(self.entries)]
        out = Codebook(new, self.group, [None] * len(new))
        for p in range(len(new)):
            a, b = self.array(p), out.array(p)
            if a.dtype != object and b.dtype != object:
                out.drift[p] = np.sqrt(((a - b).astype(np.float64) ** 2).sum(axis=1))
        return out

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def grouped(entries: list[list[list[int]]], groups: int) -> np.ndarray:
    """A group for each entry of each part: a few Lloyd rounds over the entries themselves, from evenly dealt seeds."""
    out = []
    for part in entries:
        x = np.array([[min(max(c, -(2**60)), 2**60) for c in e] for e in part], np.float64)
        x = x / max(1.0, float(np.abs(x).max(initial=1.0)))
        seeds = x[np.linspace(0, len(x) - 1, min(groups, len(x))).astype(int)]
        for _ in range(5):
            near = ((x[:, None] - seeds) ** 2).sum(axis=2).argmin(axis=1)
            seeds = np.stack([x[near == g].mean(axis=0) if (near == g).any() else s for g, s in enumerate(seeds)])
        out.append(near)
    return np.array(out)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of v to rows of c: whole numbers in doubles, or Python integers."""
    if v.dtype == object or c.dtype == object:
        d = v.astype(object)[:, None] - c.astype(object)
        return (d * d).sum(axis=2)
    v, c = v.astype(np.float64), c.astype(np.float64)
    return (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)


class Bounds:
    """Entry, upper bound and lower bounds (one a group) of one part of some vectors."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.entry, self.upper, self.lower = entry, upper, lower

    @classmethod
    def none(cls, n: int, groups: int) -> Bounds:
        return cls(np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, groups)))

    def assign(self, v: np.ndarray, c: np.ndarray, group: np.ndarray, drift: np.ndarray | None) -> int:
        """The nearest row of c of each row of v, ties to the lower one; bounds follow. Returns distances computed."""
        if v.dtype == object or c.dtype == object:
            self.entry = squared(v, c).argmin(axis=1).astype(np.int64)
            self.upper[:], self.lower[:] = np.inf, 0.0
            return len(v) * len(c)
        n_groups, work = self.lower.shape[1], 0
        if drift is None:
            self.upper[:], self.lower[:] = np.inf, 0.0
        else:
            far = np.array([drift[group == g].max(initial=0.0) for g in range(n_groups)])
            self.upper += drift[self.entry]
            self.lower = np.maximum(self.lower - far, 0.0)
        loose = np.flatnonzero(self.upper * (1 + SLACK) >= self.lower.min(axis=1))
        if not len(loose):
            return work
        best = ((v[loose] - c[self.entry[loose]]) ** 2).sum(axis=1).astype(np.float64)
        d = np.sqrt(best)
        work += len(loose)
        # `best` is exact: a squared distance; groups whose bound lies above it can't hold a nearer or equal entry
        of = self.entry[loose].copy()
        failing = self.lower[loose] <= (d * (1 + SLACK))[:, None]
        seen = np.full((len(loose), len(c)), np.inf)
        for g in range(n_groups):
            rows, members = np.flatnonzero(failing[:, g]), np.flatnonzero(group == g)
            if not len(rows) or not len(members):
                continue
            near = squared(v[loose[rows]], c[members])
            work += near.size
            seen[rows[:, None], members] = near
            k = near.argmin(axis=1)  # the lowest of equals, as members ascend
            least, entry = near[np.arange(len(rows)), k], members[k]
            won = (least < best[rows]) | ((least == best[rows]) & (entry < of[rows]))
            best[rows], of[rows] = np.where(won, least, best[rows]), np.where(won, entry, of[rows])
        left = self.entry[loose]
        moved = of != left
        self.entry[loose], self.upper[loose] = of, np.sqrt(best)
        seen[np.arange(len(loose)), of] = np.inf
        for g in range(n_groups):
            members = np.flatnonzero(group == g)
            if len(members):
                scanned = failing[:, g]
                self.lower[loose[scanned], g] = np.sqrt(seen[scanned][:, members].min(axis=1))
                # the entry that was left now stands among the others of its group
                back = np.flatnonzero(moved & ~scanned & (group[left] == g))
                self.lower[loose[back], g] = np.minimum(self.lower[loose[back], g], d[back])
        return work


class State:
    """Bounds of every part of some vectors, as bytes a vector: entries, upper bounds, lower bounds."""

    def __init__(self, parts: int, groups: int):
        self.parts, self.groups = parts, groups

    def read(self, rows: list[bytes | None]) -> list[Bounds]:
        if rows[0] is None:
            return [Bounds.none(len(rows), self.groups) for _ in range(self.parts)]
        kind = np.dtype([("e", "u1", self.parts), ("u", "<f4", self.parts), ("l", "<f4", (self.parts, self.groups))])
        x = np.frombuffer(b"".join(rows), kind)
        return [Bounds(x["e"][:, p].astype(np.int64), x["u"][:, p].astype(np.float64), x["l"][:, p].astype(np.float64)) for p in range(self.parts)]

    def write(self, found: list[Bounds]) -> list[bytes]:
        n = len(found[0].entry)
        e = np.stack([b.entry for b in found], axis=1).astype("u1").reshape(n, -1).view(np.uint8)
        u = np.stack([b.upper for b in found], axis=1).astype("<f4").view(np.uint8).reshape(n, -1)
        low = np.stack([b.lower for b in found], axis=1).astype("<f4").reshape(n, -1).view(np.uint8).reshape(n, -1)
        return [r.tobytes() for r in np.concatenate([e, u, low], axis=1)]


def _kinds(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows of one kind of numbers, 4096 at a time at most: their places in the batch and their numbers."""
    held = batch.column("v").to_pylist()
    for kind in (b"h", b"i", b"d"):
        at = [i for i, r in enumerate(held) if r[:1] == kind]
        for a in range(0, len(at), 4096):
            yield at[a : a + 4096], [held[i] for i in at[a : a + 4096]]


def _cut(rows: list[bytes], dims: int, parts: int) -> np.ndarray:
    if other := next((r for r in rows if length(r) != dims), None):
        raise ValueError(f"vectors of {dims} and of {length(other)} components")
    v = numbers(rows, dims).reshape(len(rows), parts, dims // parts)
    return v.astype(object) if dims // parts > LONGEST else v


@dataclass
class Coded:
    """rows: the kept columns, code, error (null beyond a long) of each vector; book: the last codebook (None without
    vectors); count: vectors; work: distances computed in each round."""

    rows: DataFrame
    book: Codebook | None
    count: int
    work: list[int]


def encode(vectors: DataFrame, *keep: str, value: str = "embedding", by: str = "vec_id", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, groups: int = 4) -> Coded:
    """Product codes of `value` (an array of numbers): components x become floor(scale * x) (scale: a power of two),
    vectors are cut into equal parts, each part position's codebook starts with that part of the vectors of the `entries`
    smallest `by` and is improved by `rounds` rounds of Lloyd; code is each part's entry in two hex digits, error the
    squared distances summed over parts. keep: columns to come along.

    Vectors that are null, empty or hold a null or non-finite component take no part and have no row. Ties go to the lower
    entry; of vectors that share the smallest `by` the smaller one comes first, nulls of `by` come last; repeated rows
    count as often as they come. Fewer vectors than entries: a smaller codebook. Empty table: no rows. Vectors of different
    lengths, or of a length that parts does not divide, are an error. Each round is one pass over the
    vectors, written with their bounds to the shared folder; sums are added up by Spark, one row for each number of the codebook and task, and only
    the codebook comes to the driver.
    """
    if entries > 256:
        raise ValueError("an entry takes two hex digits")
    if clash := {k.lower() for k in keep} & {"code", "error", *SUMS}:
        raise ValueError(f"columns of these names can't be kept: {sorted(clash)}")
    spark, kept = vectors.sparkSession, list(keep)
    v, b = fresh(vectors.select(*keep), "v", "b")

    @frugal
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, held = whole(batch.column(batch.num_columns - 1), scale)
            cols = [c.take(pa.array(ok, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(held, pa.binary())], names=[*batch.schema.names[:-1], v])

    slim = vectors.select(*keep, F.col(value).cast("array<double>").alias(v))
    ready = slim.mapInArrow(prepare, slim.drop(v).schema.add(v, "binary"))
    (order,) = fresh(vectors.select(*keep), "order")
    seeds_of = vectors.select(F.col(by).alias(order), F.col(value).cast("array<double>").alias(v))
    seeds_of = seeds_of.filter((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    seeds = whole(pa.array([r[1] for r in seeds_of.orderBy(F.asc_nulls_last(order), v).limit(entries).collect()], pa.list_(pa.float64())), scale)[1]
    if not seeds:
        return Coded(ready.select(*keep, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None, 0, [])
    dims = length(seeds[0])
    if dims % parts:
        raise ValueError(f"{parts} equal parts of {dims} components")
    size = dims // parts
    first = [_cut([s], dims, parts)[0].tolist() for s in seeds]
    start = [[f[p] for f in first] for p in range(parts)]
    book = Codebook(start, grouped(start, groups), [None] * parts)
    state = State(parts, int(book.group.max()) + 1)

    def round_(rows: DataFrame, book: Codebook) -> DataFrame:
        """Vectors with their bounds after an assignment, and at each task's end its sums by part, entry and place
        (place -1: counts, part -1: distances computed)."""
        arrays = [book.array(p) for p in range(parts)]

        @frugal
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, len(arrays[0]), size), np.int64)
            wide, counts, work, schema = {}, np.zeros((parts, len(arrays[0])), np.int64), 0, None
            for batch in batches:
                schema, bounds = batch.schema, batch.column(b).to_pylist() if b in batch.schema.names else [None] * batch.num_rows
                for at, held in _kinds(batch.rename_columns([*batch.schema.names[: len(kept)], "v", *batch.schema.names[len(kept) + 1 :]])):
                    x, found = _cut(held, dims, parts), state.read([bounds[i] for i in at])
                    for p, f in enumerate(found):
                        work += f.assign(x[:, p], arrays[p], book.group[p], book.drift[p])
                        counts[p] += np.bincount(f.entry, minlength=len(arrays[p]))
                        if x.dtype == object:
                            for e, part in zip(f.entry.tolist(), x[:, p].tolist()):
                                wide[p, e] = [i + j for i, j in zip(wide.get((p, e), [0] * size), part)]
                        else:
                            np.add.at(sums[p], f.entry, x[:, p])
                    cols = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(held, pa.binary()), pa.array(state.write(found), pa.binary()), *[pa.nulls(len(at), t) for t in SUMS.values()]], names=[*kept, v, b, *SUMS])
            if schema is None:
                return
            out = [(-1, 0, 0, 0, work)]
            for p in range(parts):
                for e in range(len(arrays[p])):
                    if counts[p, e]:
                        total = [int(i) + j for i, j in zip(sums[p, e], wide.get((p, e), [0] * size))]
                        out.append((p, e, -1, 0, int(counts[p, e])))
                        out += [(p, e, k, i, limb) for k, t in enumerate(total) for i, limb in enumerate(limbs(t))]
            nulls = [pa.nulls(len(out), schema.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*nulls, *[pa.nulls(len(out), pa.binary())] * 2, *[pa.array([r[k] for r in out], t) for k, t in enumerate(SUMS.values())]], names=[*kept, v, b, *SUMS])

        fields = slim.drop(v).schema.add(v, "binary").add(b, "binary")
        for name, kind in SUMS.items():
            fields = fields.add(name, "long" if kind == pa.int64() else "integer")
        return stored(rows.mapInArrow(assign, fields), "codes")

    now, work, count = ready, [], 0
    for _ in range(rounds):
        new = round_(now.select(*kept, v, *([b] if b in now.columns else [])), book)
        sums: dict[tuple[int, int], list[int]] = {}
        counts: dict[tuple[int, int], int] = {}
        for p, e, place, limb, total in new.filter(F.col("_part").isNotNull()).groupBy(*list(SUMS)[:-1]).agg(F.sum(F.col("_value").cast("decimal(38,0)"))).collect():
            if p < 0:
                work.append(int(total))
            elif place < 0:
                counts[p, e] = int(total)
            else:
                sums.setdefault((p, e), [0] * size)[place] += int(total) << (LIMB * limb)
        for key in counts:
            sums.setdefault(key, [0] * size)
        count = sum(n for (p, _), n in counts.items() if p == 0)
        book = book.moved(sums, counts)
        discard(now)
        now = new.filter(F.col("_part").isNull())
        now.__dict__["stored_at"] = new.__dict__["stored_at"]
    last, arrays = book, [book.array(p) for p in range(parts)]

    @frugal
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = batch.column(batch.num_columns - 1).to_pylist()
            for at, held in _kinds(batch.rename_columns([*batch.schema.names[: len(kept)], "v", b])):
                x, found = _cut(held, dims, parts), state.read([bounds[i] for i in at])
                errors = [0] * len(at)
                for p, f in enumerate(found):
                    f.assign(x[:, p], arrays[p], last.group[p], last.drift[p])
                    off = x[:, p] - arrays[p][f.entry]
                    errors = [i + j for i, j in zip(errors, (off * off).sum(axis=1).tolist())]
                hexed = np.stack([f.entry for f in found], axis=1).astype(np.uint8)
                cols = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([r.tobytes().hex() for r in hexed]), pa.array([e if e < 2**63 else None for e in errors], pa.int64())], names=[*kept, "code", "error"])

    coded = stored(now.select(*kept, v, b).mapInArrow(finish, slim.drop(v).schema.add("code", "string").add("error", "long")), "coded")
    discard(now)
    return Coded(coded, last, count, work)


#: Columns of a task's sums.
SUMS = {"_part": pa.int32(), "_entry": pa.int32(), "_place": pa.int32(), "_limb": pa.int32(), "_value": pa.int64()}


def code_table(vectors: DataFrame, **options: int) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of vectors (vec_id, embedding, label): encode() with the errors
    summed over equal labels, nulls together (null beyond a long), and a digest of the last codebooks. Labels that more
    than a thousandth of the vectors bear are fewer than a thousand and come by broadcast, the others by a join."""
    found = encode(vectors, "vec_id", "label", **options)
    rows = found.rows
    totals = rows.groupBy("label").agg(F.count("*").alias("k"), F.try_sum("error").alias("label_error"))
    totals = stored(totals, "totals")
    hot = totals.filter(F.col("k") > found.count / 1000).select(F.col("label").alias("_hot"), F.col("label_error").alias("_hot_error"), F.lit(True).alias("_is_hot"))
    rare = totals.filter(F.col("k") <= found.count / 1000).select(F.col("label").alias("_rare"), "label_error")
    marked = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_hot")), "left")
    one = marked.filter("_is_hot").withColumn("label_error", F.col("_hot_error"))
    two = marked.filter("_is_hot IS NULL").join(rare, F.col("label").eqNullSafe(F.col("_rare")), "left")
    names = ("vec_id", "code", "error", "label_error")
    return one.select(*names).union(two.select(*names)).withColumn("codebooks_sha256", F.lit(found.book.sha256() if found.book else None).cast("string"))
