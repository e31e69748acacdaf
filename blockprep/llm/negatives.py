"""Hard negatives by angular triangle filtering, with exact integer scores.

Every vector keeps its angles to a few reference directions.  The angle between an anchor and a
row is at least the difference and at most the sum of their angles to a reference (or what is
left of a full turn), so that the stored angles give an interval of the cosine and, times both
norms, of the score.  Intervals are widened by more than any rounding.  First the rows of the
anchor's label are searched for its highest scores, the positives; each positive's score makes a
window of scores, and only rows of other labels whose interval meets a window are scored.

Rows are dealt once, by label, nearest reference and angle to it, into tiles of bounded size and
written to the shared folder; equal vectors are spread over tiles.  In a tile, blocks of ``BLOCK``
rows keep the range of each angle and of the norms.  A row stays in its tile: anchors go to the
tiles that may matter to them, chosen by the tiles' own ranges, and are streamed past the rows
that a task holds.  So vectors are shuffled once per search whatever the number of anchors, and a
task holds one tile and one batch of anchors.  Negatives are searched in two rounds: the first
goes to about the square root of an anchor's tiles, those of the highest bounds, and where it
fills a window, its last score is the least that the second round has to look for.

Rows without an id or label, with a NULL or empty vector, or with a NULL or non-finite component
take no part; nor do those with a component beyond 32 bits (after scaling) or whose squared norm
reaches 2^62, as a score could leave the range of a long.  Only vectors of one length meet.  Ties go to the smaller id.  Rows that
repeat are rows each for itself, but no row of an anchor's id is its positive or negative; anchors
that share an id have their rows each.  An empty table gives no rows.  Labels are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockprep.llm.common import Shared
from blockprep.sources.storage import new_path

#: Rows of a tile and of a block, and reference directions.
TILE, BLOCK, REFERENCES = 16_384, 64, 16
#: Tiles are smaller, down to this, while there are fewer of them than shuffle partitions.
LEAST_TILE = 1024
#: Vector lengths whose references are rows of the table; others have seeded directions.
LENGTHS = 16
#: Tiles whose ranges are broadcast (some 200 bytes each); beyond, anchors go to every tile.
MAX_RANGES = 200_000
#: Widening of angles: far above the rounding of stored 32-bit angles and of arc cosines.
SLACK = 2e-6
_LARGEST = 2.0**62
_EXACT = 2.0**53

_ROW = "id long, label long, d int, v binary, angles binary, norm double, lead int, lead_angle double, anchor boolean"


def quantised(df: DataFrame, vec_id: str, vector: str, label: str, scale: int, anchors: Column) -> DataFrame:
    """Usable rows (id, label, anchor, d, v): components times ``scale``, rounded down."""
    own = F.col(f"`{vector}`")
    there = own.isNotNull() & (F.size(own) > 0) & F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull()
    number = F.transform(own, lambda x: F.floor(x.cast("double") * scale))
    whole = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < 2.0**31))
    return df.where(there & whole).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.size(own).alias("d"),
        F.transform(number, lambda x: x.cast("long")).alias("v"),
    )


def references(rows: DataFrame) -> dict[int, np.ndarray]:
    """For the most frequent vector lengths, up to ``REFERENCES`` rows chosen by a hash, as units."""
    frequent = [r["d"] for r in rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()]
    hashed = rows.where(F.col("d").isin(frequent)).select("d", "v", F.xxhash64("v").alias("h")).where(
        F.exists("v", lambda x: x != 0)
    )
    picked = hashed.groupBy("d", F.pmod("h", F.lit(REFERENCES)).alias("part")).agg(F.min_by("v", "h").alias("v"))
    found: dict[int, list] = {}
    for row in picked.orderBy("d", "part").collect():
        found.setdefault(row["d"], []).append(row["v"])
    return {d: _units(np.array(v, float)) for d, v in found.items()}


def _units(directions: np.ndarray) -> np.ndarray:
    return directions / np.linalg.norm(directions, axis=1, keepdims=True)


def directions_for(d: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors to measure angles to."""
    return known[d] if d in known else _units(np.random.default_rng(d).normal(size=(REFERENCES, d)))


def angles_to(units: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of rows to the directions, and norms; a zero row is at angle 0 to all."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    cosines = (rows @ units.T) / np.where(norms > 0, norms, 1)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(cosines, -1, 1)), 0).astype(np.float32), norms


def _bounds(least: np.ndarray, most: np.ndarray, small: np.ndarray, large: np.ndarray, angles: np.ndarray, norm: float):
    """Lower and upper bounds of scores, given ranges of angles (n x m) and norms (n)."""
    near = np.maximum(np.maximum(least - angles, angles - most).max(axis=1), 0)
    far = np.minimum((most + angles).min(axis=1), (2 * np.pi - least - angles).min(axis=1))
    high, low = np.cos(np.clip(near - SLACK, 0, np.pi)), np.cos(np.clip(far + SLACK, 0, np.pi))
    upper = norm * np.where(high >= 0, large, small) * high
    lower = norm * np.where(low >= 0, small, large) * low
    room = 1 + norm * large * 1e-12
    return lower - room, upper + room


class Rows:
    """The rows of one tile and one vector length, with the ranges of their blocks."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, angles: np.ndarray, norms: np.ndarray):
        self.row, self.ids, self.labels, self.v, self.norms = row, ids, labels, v, norms
        self.angles = angles.astype(np.float64)
        self.floats = v.astype(np.float64)
        self.edges = np.arange(0, len(row), BLOCK)
        self.least = np.minimum.reduceat(self.angles, self.edges)
        self.most = np.maximum.reduceat(self.angles, self.edges)
        self.small, self.large = np.minimum.reduceat(norms, self.edges), np.maximum.reduceat(norms, self.edges)

    def _members(self, blocks: np.ndarray) -> np.ndarray:
        places = (self.edges[blocks][:, None] + np.arange(BLOCK)).ravel()
        return places[places < len(self.row)]

    def _scores(self, places: np.ndarray, v: np.ndarray, norm: float) -> np.ndarray:
        if not len(places):
            return np.empty(0, np.int64)
        if norm * self.norms[places].max() < _EXACT:
            return (self.floats[places] @ v.astype(np.float64)).astype(np.int64)
        return self.v[places].astype(np.int64) @ v.astype(np.int64)

    def _interval(self, places: np.ndarray, angles: np.ndarray, norm: float):
        own, norms = self.angles[places], self.norms[places]
        return _bounds(own, own, norms, norms, angles, norm)

    def _first(self, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.row[places], self.ids[places], -scores))[:k]

    def positives(self, number: int, label: int, v: np.ndarray, angles: np.ndarray, norm: float, k: int, floor: int | None):
        """Places and scores of the k best rows of the label; none below ``floor`` matters."""
        _, upper = _bounds(self.least, self.most, self.small, self.large, angles, norm)
        blocks = np.ones(len(upper), bool) if floor is None else upper >= floor
        places = self._members(np.flatnonzero(blocks))
        places = places[(self.labels[places] == label) & (self.ids[places] != number)]
        if not len(places):
            return places, np.empty(0, np.int64)
        lower, upper = self._interval(places, angles, norm)
        least = -np.inf if floor is None else floor
        if len(places) > k:
            least = max(least, np.partition(lower, len(lower) - k)[len(lower) - k])
        places = places[upper >= least]
        scores = self._scores(places, v, norm)
        first = self._first(places, scores, k)
        return places[first], scores[first]

    def negatives(self, number: int, label: int, v: np.ndarray, angles: np.ndarray, norm: float, k: int, windows: list[tuple[int, int]]):
        """For each window (least, most score): places and scores of the k best rows of other labels."""
        lower, upper = _bounds(self.least, self.most, self.small, self.large, angles, norm)
        blocks = np.zeros(len(upper), bool)
        for low, high in windows:
            blocks |= (upper >= low) & (lower <= high)
        places = self._members(np.flatnonzero(blocks))
        places = places[(self.labels[places] != label) & (self.ids[places] != number)]
        lower, upper = self._interval(places, angles, norm)
        needed = np.zeros(len(places), bool)
        for low, high in windows:
            sure = lower[(lower >= low) & (upper <= high)]
            least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else low
            needed |= (upper >= max(low, least)) & (lower <= high)
        places = places[needed]
        scores = self._scores(places, v, norm)
        out = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            first = inside[self._first(places[inside], scores[inside], k)]
            out.append((places[first], scores[first]))
        return out


def window_of(score: int, least: int, most: int) -> tuple[int, int]:
    """The whole scores s with least * score <= 100 * s <= most * score."""
    return -((-least * score) // 100), (most * score) // 100


def _packed(rows: np.ndarray, kind: type) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows, kind)]


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _measured(rows: DataFrame, known: Shared) -> DataFrame:
    """Add angles and norms, and pack vectors; rows that reach the largest norm go."""
    names = [field.split()[0] for field in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                values = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                angles, norms = angles_to(directions_for(d, known.value), values.astype(float))
                usable = norms * norms < _LARGEST
                part, values, angles, norms = part.filter(pa.array(usable)), values[usable], angles[usable], norms[usable]
                lead = angles.argmin(axis=1) if len(angles) else np.empty(0, int)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("label"),
                        part.column("d"),
                        pa.array(_packed(values, np.int32), pa.binary()),
                        pa.array(_packed(angles, np.float32), pa.binary()),
                        pa.array(norms),
                        pa.array(lead.astype(np.int32)),
                        pa.array(angles[np.arange(len(lead)), lead].astype(float)),
                        part.column("anchor"),
                    ],
                    names,
                )

    return rows.mapInArrow(run, _ROW)


def _rows(table: pa.Table) -> dict[int, Rows]:
    """The rows of a tile by vector length."""
    table = table.combine_chunks()
    sizes, out = table.column("d").to_numpy(), {}
    for d in np.unique(sizes).tolist():
        part = table.filter(pa.array(sizes == d)).combine_chunks()
        row, ids, labels, norms = (part.column(c).to_numpy() for c in ("row", "id", "label", "norm"))
        out[d] = Rows(row, ids, labels, _matrix(part.column("v"), np.int32), _matrix(part.column("angles"), np.float32), norms)
    return out


def make_tiles(rows: DataFrame, count: int) -> DataFrame:
    """Rows with (tile, row), written once: neighbours by label, nearest reference and angle."""
    order = ["d", "label", "lead", "lead_angle", "tie"]
    tied = rows.withColumn("tie", F.xxhash64("id", "v", F.monotonically_increasing_id()))
    wanted = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // LEAST_TILE))
    dealt = tied.repartitionByRange(max(1, -(-count // TILE), wanted), *order).sortWithinPartitions(*order).drop("tie")
    path = new_path(rows.sparkSession, "tiles")
    dealt.withColumns({"tile": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


_RANGE = "tile int, d int, least binary, most binary, small double, large double, first long, last long"


def tile_ranges(tiles: DataFrame) -> DataFrame:
    """For each tile and vector length the ranges of angles, norms and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column("tile").to_numpy(), batch.column("d").to_numpy()], axis=1)
            out = []
            for tile, d in np.unique(keys, axis=0).tolist():
                part = batch.filter(pa.array((keys == (tile, d)).all(axis=1)))
                angles, norms, labels = _matrix(part.column("angles"), np.float32), part.column("norm").to_numpy(), part.column("label").to_numpy()
                out.append((tile, d, angles.min(axis=0).tobytes(), angles.max(axis=0).tobytes(), norms.min(), norms.max(), labels.min(), labels.max()))
            names = [f.split()[0] for f in _RANGE.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    return tiles.select("tile", "d", "angles", "norm", "label").mapInArrow(run, _RANGE)


def _merged_ranges(rows: list) -> dict[int, tuple]:
    """By vector length: tiles, and their ranges as arrays."""
    by: dict[tuple[int, int], list] = {}
    for r in rows:
        least, most = np.frombuffer(r["least"], np.float32), np.frombuffer(r["most"], np.float32)
        have = by.get((r["d"], r["tile"]))
        new = [least, most, r["small"], r["large"], r["first"], r["last"]]
        by[r["d"], r["tile"]] = new if have is None else [f(a, b) for f, a, b in zip((np.minimum, np.maximum, min, max, min, max), have, new)]
    out = {}
    for d in {d for d, _ in by}:
        tiles = sorted(t for e, t in by if e == d)
        columns = [np.array(c) for c in zip(*[by[d, t] for t in tiles])]
        out[d] = (np.array(tiles), columns[0].astype(float), columns[1].astype(float), *columns[2:])
    return out


def _sent(anchors: DataFrame, ranges: Shared | None, tiles: DataFrame, wanted: Callable) -> DataFrame:
    """Anchors once for each tile that may matter; ``wanted(anchor, ranges)`` is a mask of tiles."""
    if ranges is None:
        return anchors.withColumnRenamed("tile", "home").join(tiles.select("tile", "d").distinct(), "d").drop("home")
    schema = anchors.schema
    at = anchors.columns.index("tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _merged_ranges(ranges.value)
        for batch in batches:
            for i, anchor in enumerate(batch.to_pylist()):
                tiles = known[anchor["d"]][0][wanted(anchor, known[anchor["d"]])]
                columns = [batch.column(c).take(pa.array(np.full(len(tiles), i))) for c in range(batch.num_columns)]
                columns[at] = pa.array(tiles.astype(np.int32))
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return anchors.mapInArrow(run, schema)


def _range_bounds(anchor: dict, ranges: tuple) -> tuple[np.ndarray, np.ndarray]:
    _, least, most, small, large, _, _ = ranges
    return _bounds(least, most, small, large, np.frombuffer(anchor["angles"], np.float32).astype(float), anchor["norm"])


def _may_hold_positives(anchor: dict, ranges: tuple) -> np.ndarray:
    fits = (ranges[5] <= anchor["label"]) & (ranges[6] >= anchor["label"])
    return fits if anchor["floor"] is None else fits & (_range_bounds(anchor, ranges)[1] >= anchor["floor"])


def _meeting(anchor: dict, ranges: tuple, windows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which tiles may hold rows of other labels with a score in a window, and their upper bounds."""
    lower, upper = _range_bounds(anchor, ranges)
    meets = np.zeros(len(lower), bool)
    for low, high in windows:
        meets |= (upper >= low) & (lower <= high)
    return meets & ~((ranges[5] == anchor["label"]) & (ranges[6] == anchor["label"])), upper


def _first_tiles(anchor: dict, ranges: tuple, windows: list[tuple[int, int]]) -> np.ndarray:
    """The tiles of the first round: of those that may matter, a square root's number, highest first."""
    meets, upper = _meeting(anchor, ranges, windows)
    order = np.argsort(np.where(meets, -upper, np.inf), kind="stable")
    chosen = np.zeros(len(meets), bool)
    chosen[order[: int(np.ceil(np.sqrt(meets.sum())))]] = True
    return chosen & meets


_TILE_ROW = ["tile", "row", "id", "label", "d", "v", "angles", "norm"]


def _search(tiles: DataFrame, asked: DataFrame, more: list[str], find: Callable, schema: str, parts: int) -> DataFrame:
    """Stream the anchors sent to each tile past its rows; ``more`` is what they bring along."""
    none = [F.lit(None).cast(asked.schema[name].dataType).alias(name) for name in more]
    rows = tiles.select(F.lit(0).alias("asks"), *_TILE_ROW, *none)
    both = rows.unionByName(asked.select(F.lit(1).alias("asks"), *_TILE_ROW, *more))
    # Rows of a tile come before its anchors.
    placed = both.repartition(parts, "tile").sortWithinPartitions("tile", "asks", "row")
    out_names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, ready = None, [], None
        for batch in batches:
            numbers, asks = batch.column("tile").to_numpy(), batch.column("asks").to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks) != 0)) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                if last == first:
                    continue
                part = batch.slice(first, last - first)
                if numbers[first] != tile:
                    tile, held, ready = numbers[first], [], None
                if not asks[first]:
                    held.append(part)
                    continue
                if ready is None:
                    ready, held = _rows(pa.Table.from_batches(held)) if held else {}, []
                out = []
                for anchor in part.to_pylist():
                    own = ready.get(anchor["d"])
                    if own is not None:
                        out.extend(find(own, anchor))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], out_names)

    return placed.mapInArrow(run, schema)


def _vector(anchor: dict) -> tuple:
    return np.frombuffer(anchor["v"], np.int32), np.frombuffer(anchor["angles"], np.float32).astype(float), anchor["norm"]


def _floors(tiles: DataFrame, positives: int, parts: int) -> DataFrame:
    """(row, floor): for anchors, the k-th best score of their label in their own tile."""
    anchors = tiles.where("anchor").withColumn("floor", F.lit(None).cast("long"))

    def find(rows: Rows, a: dict) -> list:
        _, scores = rows.positives(a["id"], a["label"], *_vector(a), positives, None)
        return [(a["row"], int(scores[-1]))] if len(scores) == positives else []

    return _search(tiles, anchors, ["floor"], find, "row long, floor long", parts)


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Per anchor and positive the best rows of other labels between two shares of its score.

    ``anchors`` says which rows are anchors.  A row's score is its inner product with the anchor;
    positives are the ``positives`` best rows of the anchor's label, negatives the ``negatives``
    best others with least * positive_score <= 100 * score <= most * positive_score.  Returns
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = df.sparkSession

    def windows(scores: list[int]) -> list[tuple[int, int]]:
        return [window_of(score, least, most) for score in scores]

    usable = quantised(df, vec_id, vector, label, scale, anchors)
    known = Shared(spark, references(usable))
    tiles = make_tiles(_measured(usable, known), usable.count())
    own = tile_ranges(tiles)
    n_tiles = tiles.agg(F.max("tile").alias("n")).first()["n"]
    parts = max(1, (n_tiles or 0) + 1)
    ranges = Shared(spark, own.collect()) if parts <= MAX_RANGES else None

    floors = _floors(tiles, positives, parts)
    asking = tiles.where("anchor").join(floors, "row", "left")
    asked = _sent(asking.select(*_TILE_ROW, "floor"), ranges, tiles, _may_hold_positives)

    def find_positives(rows: Rows, a: dict) -> list:
        places, scores = rows.positives(a["id"], a["label"], *_vector(a), positives, a["floor"])
        return [(a["row"], int(rows.row[p]), int(rows.ids[p]), int(s)) for p, s in zip(places, scores)]

    found = _search(tiles, asked, ["floor"], find_positives, "row long, p_row long, p_id long, p_score long", parts)
    best = Window.partitionBy("row").orderBy(F.desc("p_score"), "p_id", "p_row")
    chosen = found.withColumn("p", F.row_number().over(best) - 1).where(F.col("p") < positives)
    path = new_path(spark, "positives")
    chosen.write.parquet(path)
    chosen = spark.read.parquet(path)

    scored = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("p", "p_score"))).alias("s"))
    scored = scored.select("row", F.transform("s", lambda s: s["p_score"]).alias("scores"))
    asking = tiles.where("anchor").join(scored, "row").select(*_TILE_ROW, "scores")

    def find_negatives(rows: Rows, a: dict) -> list:
        asked = [(max(low, least), high) for (low, high), least in zip(windows(a["scores"]), a["least"])]
        hits = rows.negatives(a["id"], a["label"], *_vector(a), negatives, asked)
        return [
            (a["row"], p, int(rows.row[i]), int(rows.ids[i]), int(s))
            for p, (places, scores) in enumerate(hits)
            for i, s in zip(places, scores)
        ]

    first = Window.partitionBy("row", "p").orderBy(F.desc("n_score"), "n_id", "n_row")

    def search_negatives(asked: DataFrame) -> DataFrame:
        hits = _search(tiles, asked, ["scores", "least"], find_negatives, "row long, p long, n_row long, n_id long, n_score long", parts)
        return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)

    def unvisited(a: dict, r: tuple) -> np.ndarray:
        raised = [(max(low, least), high) for (low, high), least in zip(windows(a["scores"]), a["least"])]
        return _meeting(a, r, raised)[0] & ~_first_tiles(a, r, windows(a["scores"]))

    nothing = F.transform("scores", lambda _: F.lit(-(2**63)))
    begun = asking.withColumn("least", nothing)
    if ranges is None:
        ranked = search_negatives(_sent(begun, None, tiles, None))
    else:
        path = new_path(spark, "negatives")
        search_negatives(_sent(begun, ranges, tiles, lambda a, r: _first_tiles(a, r, windows(a["scores"])))).write.parquet(path)
        early = spark.read.parquet(path).drop("rank")
        full = early.groupBy("row", "p").agg(F.count(F.lit(1)).alias("n"), F.min("n_score").alias("last"))
        full = full.where(F.col("n") == negatives).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("p", "last"))).alias("lasts"))
        place = F.transform("scores", lambda _, i: F.coalesce(F.try_element_at("lasts", i.cast("long")), F.lit(-(2**63))))
        raised = asking.join(full, "row", "left").withColumn("least", F.coalesce(place, nothing)).drop("lasts")
        late = search_negatives(_sent(raised, ranges, tiles, unvisited)).drop("rank")
        ranked = early.unionByName(late).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    names = tiles.where("anchor").select("row", F.col("id").alias("anchor_id"))
    return (
        ranked.join(chosen.withColumn("p", F.col("p").cast("long")), ["row", "p"])
        .join(names, "row")
        .select(
            "anchor_id",
            F.col("p_id").alias("positive_id"),
            "rank",
            F.col("n_id").alias("negative_id"),
            F.col("p_score").alias("positive_score"),
            F.col("n_score").alias("negative_score"),
        )
    )
