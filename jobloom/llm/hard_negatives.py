"""Hard-negative mining with a pivot table.

Vectors are scaled to integers. With M the longest length, a row x becomes (x, sqrt(M^2 - |x|^2))
and an anchor q becomes (q, 0): then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so a higher inner product is
a smaller distance. Distances of every row to a few pivots are stored; by the triangle inequality
they bracket a row's distance to an anchor, and so its score, without reading its vector. Only rows
whose bracket meets what is still asked for are scored exactly.

Anchors meet rows in blocks: each pair of a group of anchors and a stripe of rows is one group of
a cogrouped join, of bounded size on both sides. Rows of one label, however many, lie in many
stripes; each stripe returns its best few, and these are ranked by anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, importable, materialise, table

#: Stored pivots, and the bound of the sample (rows of the smallest id hashes) from which they are chosen.
PIVOTS, PIVOT_SAMPLE = 12, 1024
#: Rows of a stripe, at least and at most, and anchors of a group at most.
STRIPE, WIDEST, ANCHORS = 1024, 65_536, 16_384
#: Rows of a tile, whose pivot distances have common bounds, and anchors of a step.
TILE, STEP = 512, 256
#: Squared lengths stay below this, so that scores fit a key with their place.
LONGEST = 1 << 50

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Percent of the positive's score that a negative's may be.
LOWEST, HIGHEST = 50, 95
ANCHOR_EVERY, MOVED_EVERY, LABELS = 50, 7, 10


def scaled(vector: Column) -> Column:
    """floor(256 x) of every component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    """Whether there is a vector and every component is a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return vector.isNotNull() & finite


def _packed(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v, norm): vectors as little-endian int32 or int64, none of them longer than the exact scores allow."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    checked = rows.withColumn("norm", norm)
    bound = F.when(F.col("norm") >= LONGEST, F.raise_error(F.concat(F.lit("vector too long for exact scores: "), F.col("vec_id").cast("string"))).cast("double")).otherwise(F.col("norm"))

    def run(batches):
        for b in batches:
            lists = b.column("v")
            at, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy().astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()), b.column("norm")], names=["vec_id", "label", "v", "norm"])

    return checked.withColumn("norm", bound).mapInArrow(run, "vec_id long, label int, v binary, norm double")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(column), width), np.float64)
    for i, x in enumerate(column.to_pylist()):
        v = np.frombuffer(x, "<i4")
        out[i, : len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, longest: float, count: int = PIVOTS) -> np.ndarray:
    """Rows of the augmented sample, each the farthest from those before; the first is the shortest vector's."""
    if not len(sample):
        return np.zeros((0, sample.shape[1] + 1))
    norm = (sample**2).sum(axis=1)
    rows = np.column_stack((sample, np.sqrt(np.maximum(longest - norm, 0))))
    chosen = [int(np.argmin(norm))]
    far = np.full(len(rows), np.inf)
    while len(chosen) < min(count, len(rows)):
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(np.argmax(far)))
    return rows[chosen]


def _distances(vectors: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (row, pivot) of the vectors augmented by ``last``."""
    square = (vectors**2).sum(axis=1) + last**2
    return np.sqrt(np.maximum(square[:, None] + (pivots**2).sum(axis=1) - 2 * (vectors @ pivots[:, :-1].T + last[:, None] * pivots[:, -1]), 0))


def pivot_table(rows: DataFrame, pivots: np.ndarray, longest: float) -> DataFrame:
    """``rows`` (vec_id, label, v, norm) with ``d``, each row's distances to the pivots, and ``dq``, those of the row as an anchor."""
    width = pivots.shape[1] - 1

    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"), width)
            own = _distances(x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0)), pivots).astype("<f4")
            asked = _distances(x, np.zeros(len(x)), pivots).astype("<f4")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "v", "norm")), pa.array([r.tobytes() for r in own], pa.binary()), pa.array([r.tobytes() for r in asked], pa.binary())], names=["vec_id", "label", "v", "norm", "d", "dq"])

    return rows.mapInArrow(run, "vec_id long, label int, v binary, norm double, d binary, dq binary")


class Best:
    """The best ``k`` (score, id) of each (anchor, window) among the candidates so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.kept = (np.empty(0, np.int64),) * 3

    def add(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Ranks candidates with what is kept; a full window asks for no less than its last score from now on."""
        windows = self.low.shape[1]
        parts = [self.kept]
        for w in range(windows):
            hit = (score >= self.low[anchor, w]) & (score <= self.high[anchor, w])
            parts.append((anchor[hit] * windows + w, ids[hit], score[hit]))
        key, ids, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.empty(0, np.int64)
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep = place < self.k
        self.kept = (key[keep], ids[keep], score[keep])
        full = place == self.k - 1
        self.low.ravel()[key[full]] = np.maximum(self.low.ravel()[key[full]], score[full])


def search_stripe(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], longest: float, k: int, same_label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """(anchor, window, id, score) of the best ``k`` rows of a stripe in each of the anchors' windows, and counts of the work.

    ``anchors``: x, label, id, norm, dq, low and high (anchor x window, in whole numbers); ``rows``: x, label, id, d.
    """
    count = {"pairs": 0, "exact": 0}
    none = np.empty(0, np.int64)
    if not len(rows["id"]) or not len(anchors["id"]):
        return none, none, none, none, count
    order = np.lexsort((rows["id"], np.argmin(rows["d"], axis=1) if rows["d"].shape[1] else rows["id"]))
    rows = {c: v[order] for c, v in rows.items()}
    # Products of integers are exact in a float as long as no sum of their sizes reaches its precision.
    kind = np.float32 if longest < 1 << 24 else np.float64
    x, slack = rows["x"].astype(kind), 2 + 1e-4 * longest
    tiles = [slice(i, i + TILE) for i in range(0, len(x), TILE)]
    bounds = [(rows["d"][t].min(axis=0), rows["d"][t].max(axis=0)) for t in tiles]
    out = []
    for begin in range(0, len(anchors["id"]), STEP):
        a = {c: v[begin : begin + STEP] for c, v in anchors.items()}
        q, best = a["x"].astype(kind), Best(a["low"], a["high"], k)
        square, highest = a["norm"] + longest, a["high"].max(axis=1)
        least = np.sqrt(np.maximum(square - 2.0 * (slack + highest), 0)).astype(np.float32)
        # Nearest tiles first: they raise what the others must reach.
        low_tile = np.stack([np.max(np.maximum(np.maximum(lo - a["dq"], a["dq"] - hi), 0), axis=1, initial=0) for lo, hi in bounds], axis=1)
        for i in np.argsort(low_tile.mean(axis=0), kind="stable"):
            t = tiles[i]
            # A score of at least ``lowest`` needs a distance of at most ``limit``.
            lowest = best.low.min(axis=1)
            room = square + 2 * (slack - lowest)
            limit = np.sqrt(np.maximum(room, 0))
            alive = np.flatnonzero((low_tile[:, i] <= limit) & (room >= 0))
            n = len(x[t])
            count["pairs"] += len(q) * n
            if not len(alive):
                continue
            dq, d = a["dq"][alive], rows["d"][t]
            near, far = np.zeros((len(alive), n), np.float32), np.full((len(alive), n), np.inf, np.float32)
            for j in range(d.shape[1]):
                np.maximum(near, np.abs(dq[:, j, None] - d[None, :, j]), out=near)
                np.minimum(far, dq[:, j, None] + d[None, :, j], out=far)
            fits = (near <= limit[alive, None].astype(np.float32)) & (far >= least[alive, None])
            fits &= (a["label"][alive, None] == rows["label"][None, t]) == same_label
            fits &= a["id"][alive, None] != rows["id"][None, t]
            alive, fits = alive[fits.any(axis=1)], fits[fits.any(axis=1)]
            cols = np.flatnonzero(fits.any(axis=0))
            count["exact"] += int(fits.sum())
            score = q[alive] @ x[t][cols].T
            fits = fits[:, cols] & (score >= lowest[alive, None]) & (score <= highest[alive, None])
            who, what = np.nonzero(fits)
            if len(who):
                best.add(alive[who], rows["id"][t][cols][what], score[who, what].astype(np.int64))
        key, ids, score = best.kept
        out.append((anchors["id"][begin + key // best.low.shape[1]], key % best.low.shape[1], ids, score))
    return *(np.concatenate(c) for c in zip(*out, strict=True)), count


FOUND = "anchor_id long, place int, found_id long, score long"


def _searcher(width: int, pivots: int, longest: float, k: int, same_label: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def arrays(part: pa.Table, d: str) -> dict[str, np.ndarray]:
        flat = b"".join(part.column(d).to_pylist())
        return {"x": _matrix(part.column("v"), width), "label": part.column("label").to_numpy(), "id": part.column("vec_id").to_numpy(), d: np.frombuffer(flat, "<f4").reshape(len(part), pivots)}

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        windows = asked.column("windows").to_pylist()
        most = max(map(len, windows), default=0)
        low, high = np.full((len(asked), most), 1 << 62, np.int64), np.full((len(asked), most), -1 << 62, np.int64)
        for i, w in enumerate(windows):
            low[i, : len(w)], high[i, : len(w)] = [x["low"] for x in w], [x["high"] for x in w]
        anchors = arrays(asked, "dq") | {"norm": asked.column("norm").to_numpy(), "low": low, "high": high}
        anchor, place, ids, score, _ = search_stripe(anchors, arrays(rows, "d"), longest, k, same_label)
        return pa.table({"anchor_id": pa.array(anchor, pa.int64()), "place": pa.array(place, pa.int32()), "found_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def _meet(anchors: DataFrame, rows: DataFrame, sizes: DataFrame, on: list[str], stripe: int, run: Callable) -> DataFrame:
    """Anchors (with windows) against rows, by ``on`` if there is any, in groups of bounded size.

    ``sizes``: (on, n_rows, n_anchors). Every anchor of a group meets every stripe, every row every group of anchors.
    """
    groups, stripes = F.ceil(F.col("n_anchors") / ANCHORS).cast("int"), F.ceil(F.col("n_rows") / stripe).cast("int")
    sizes = sizes.select(*on, F.greatest(groups, F.lit(1)).alias("_gs"), F.greatest(stripes, F.lit(1)).alias("_ss"))
    hashed = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if on:
        # Three numbers for each label; very many labels are joined by shuffle, where Spark splits a skewed one.
        sizes = materialise(sizes, "label-sizes")
        sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS else sizes
        a, r = anchors.join(sizes, on), rows.join(sizes, on)
    else:
        one = sizes.first()
        known = {"_gs": F.lit(one["_gs"]), "_ss": F.lit(one["_ss"])}
        a, r = anchors.withColumns(known), rows.withColumns(known)
    a = a.withColumn("_g", hashed("_gs")).withColumn("_s", every("_ss")).select(*(c for c in ("vec_id", "label", "v", "norm", "dq", "windows")), "_g", "_s")
    # Both sides come from one table: the rows' columns are named anew.
    r = r.withColumn("_s", hashed("_ss")).withColumn("_g", every("_gs")).select(*(F.col(c).alias(c) for c in ("vec_id", "label", "v", "d", "_g", "_s")))
    keys = ["_g", "_s", *on]
    return a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each (anchor_id, place) with ``rank`` from 1."""
    w = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``rows`` (vec_id, label, v: array of longs).

    An anchor's positives are its best other rows of the same label; each positive's negatives
    the best rows of other labels that score ``lowest`` to ``highest`` percent of it. Ties go to the
    smaller id. Rows without an id or a label take no part; of several rows with one id
    the smallest (label, vector) counts. A shorter vector ends in zeros. Squared lengths of
    2^50 or more have no exact score and raise an error. An empty table gives no rows.
    """
    spark = rows.sparkSession
    importable(spark)
    clean = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    once = clean.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x.label").cast("int").alias("label"), F.col("x.v").alias("v"))
    packed = materialise(_packed(once), "vectors")
    longest, width, n = packed.agg(F.max("norm"), F.max(F.octet_length("v")) / 4, F.count(F.lit(1))).first()
    longest, width = float(longest or 0), int(width or 0)
    # At most ``sample`` vectors.
    picked = packed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    chosen = choose_pivots(_matrix(picked.column("v"), width), longest, pivots)
    stored = materialise(pivot_table(packed, chosen, longest), "pivot-table")
    stripe = min(WIDEST, max(STRIPE, math.ceil(n / (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    asked = stored.where(anchor)
    sizes = stored.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(anchor).alias("n_anchors")).where("n_anchors > 0")
    all_windows = F.array(F.struct(F.lit(-(1 << 61)).alias("low"), F.lit(1 << 61).alias("high")))
    runs = lambda k, same: _searcher(width, len(chosen), longest, k, same)
    found = _meet(asked.withColumn("windows", all_windows), stored, sizes, ["label"], stripe, runs(positives, True))
    pairs = materialise(_ranked(found, positives).select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    # 100 * s must lie between lowest * p and highest * p.
    windows = pairs.withColumns({"low": F.expr(f"{lowest} * positive_score div 100 + IF({lowest} * positive_score % 100 > 0, 1, 0)"), "high": F.expr(f"{highest} * positive_score div 100")}).where("positive_score >= 0 AND low <= high")
    lists = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("windows"))
    total = stored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(anchor).alias("n_anchors"))
    found = _meet(asked.join(lists, "vec_id"), stored, total, [], stripe, runs(negatives, False))
    named = lists.select(F.col("vec_id").alias("anchor_id"), F.posexplode("windows").alias("place", "w")).select("anchor_id", "place", F.col("w.rank").alias("_rank"))
    with_ids = named.join(pairs.select("anchor_id", F.col("rank").alias("_rank"), "positive_id", "positive_score"), ["anchor_id", "_rank"])
    best = _ranked(found, negatives).join(with_ids, ["anchor_id", "place"])
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector. Rows without a label or with a component that is missing or no finite number take no part."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), scaled(F.col("embedding")).alias("v")), F.col("vec_id") % ANCHOR_EVERY == 0)
