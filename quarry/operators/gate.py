"""Gates on held-out blocks: paired bootstrap of average-precision gains, harm and benefit rules, single-use blocks, and choices
between models."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quarry.operators.metrics import ap_and_auc, average_precision
from quarry.plans.schema import cut_lineage, together


def _poisson_table() -> np.ndarray:
    """The Poisson(1) weight of each 16-bit ticket."""
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])
    return np.searchsorted(shares, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def replicate_weights(marks: np.ndarray, repeats: int, table: np.ndarray) -> np.ndarray:
    """Poisson(1) resampling weights, a row a mark (unsigned 64-bit) and a column a replicate; column 0 is the rows as they are.

    A weight is a function of mark and replicate, so old and new scores meet the same resamples and a lost task draws the
    same numbers again. Poisson weights are the large-sample form of drawing with replacement.
    """
    lanes = -(-repeats // 4)
    x = marks[:, None] + (np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    drawn = table[(x ^ (x >> np.uint64(31))).view(np.uint16)[:, :repeats]]
    return np.concatenate([np.ones((len(marks), 1), np.uint8), drawn], axis=1)


def _steps_frames(repeats: int, before: dict[tuple, tuple], chunk: int = 1024):
    """For mapInArrow over (region, which, range, score, y, mark), sorted by the first three and descending scores: of each run, the
    replicates' sums (region, which, range, n, pos, gain), gain being the average precision's numerator given before, what each
    replicate had above the run (region, which, range -> n, pos, scale of negatives). Without before it is empty.
    """
    import pyarrow as pa

    schema = pa.schema([("region", pa.int64()), ("which", pa.int32()), ("range", pa.int32()), ("n", pa.binary()), ("pos", pa.binary()), ("gain", pa.binary())])

    class Run:
        def __init__(self, key: tuple):
            self.key, self.n, self.pos, self.gain = key, np.zeros(repeats + 1), np.zeros(repeats + 1), np.zeros(repeats + 1)
            self.above = before.value[key] if before else None
            self.tie, self.tie_n, self.tie_pos = None, np.zeros(repeats + 1), np.zeros(repeats + 1)

        def close_tie(self) -> None:
            self.n += self.tie_n
            self.pos += self.tie_pos
            if self.above is not None and self.tie_pos.any():
                n, pos, negative = self.above
                positives = pos + self.pos
                every = positives + (n + self.n - positives) * negative
                self.gain += np.divide(self.tie_pos * positives, every, out=np.zeros_like(every), where=every > 0)

        def add(self, scores: np.ndarray, y: np.ndarray, weights: np.ndarray) -> None:
            starts = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
            positive = np.add.reduceat(y, starts) > 0
            alone = np.r_[True, positive[:-1] | positive[1:]]  # groups without a positive go together: only their number counts
            alone[1:2] |= scores[0] == self.tie
            cuts = starts[alone]
            n = np.add.reduceat(weights, cuts, axis=0, dtype=np.int64)
            pos = np.add.reduceat(weights * y[:, None].astype(np.uint8), cuts, axis=0, dtype=np.int64)
            for k, at in enumerate(cuts.tolist()):
                if scores[at] != self.tie:
                    self.close_tie()
                    self.tie_n, self.tie_pos = np.zeros(repeats + 1), np.zeros(repeats + 1)
                self.tie_n += n[k]
                self.tie_pos += pos[k]
                self.tie = scores[(cuts[k + 1] if k + 1 < len(cuts) else len(scores)) - 1]

        def batch(self) -> pa.RecordBatch:
            self.close_tie()
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip([*self.key, self.n.tobytes(), self.pos.tobytes(), self.gain.tobytes()], schema, strict=True)], schema=schema)

    def run(batches):
        table, now = _poisson_table(), None
        for b in batches:
            region, which, span, scores, y, marks = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(region):
                continue
            cuts = np.flatnonzero(np.r_[True, (np.diff(region) != 0) | (np.diff(which) != 0) | (np.diff(span) != 0)]).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(region)], strict=True):
                key = int(region[s]), int(which[s]), int(span[s])
                if now is None or now.key != key:
                    if now is not None:
                        yield now.batch()
                    now = Run(key)
                for at in range(s, e, chunk):
                    end = min(e, at + chunk)
                    now.add(scores[at:end], y[at:end], replicate_weights(marks[at:end].view(np.uint64), repeats, table))
        if now is not None:
            yield now.batch()

    return run


def bootstrap_gain(df: DataFrame, y: str, old: str, new: str, rid: str, by: list[str] | None = None, repeats: int = 1000, seed: int = 0, classwise: bool = False, most_regions: int = 1000) -> DataFrame:
    """(by..., gain, se, lower, upper, repeats): the gain in average precision of new over old, its bootstrap standard
    error (ddof 1) and 95 % interval. Replicates without both classes are left out; a region with one class
    gives a null gain. classwise: replicates have as many positives and negatives as the rows, each class's weights
    being scaled to its size. Rows without a label or with a missing score are left out.

    Rows are sorted in ranges of the scores, each by a task that sums all replicates' weights at once; a first pass
    gives each range what lies above it, a second the precisions. The driver holds ranges x replicates numbers a region, of
    most_regions regions (an error beyond).
    """
    by = by or []
    spark = df.sparkSession
    regions = df.select(*by).distinct().limit(most_regions + 1).collect() if by else [()]
    if len(regions) > most_regions:
        raise ValueError(f"more than {most_regions} regions")
    scores = F.array(F.struct(F.lit(0).alias("which"), F.col(old).cast("double").alias("score")), F.struct(F.lit(1).alias("which"), F.col(new).cast("double").alias("score")))
    kept = df.where(F.col(y).isNotNull() & F.col(old).isNotNull() & F.col(new).isNotNull())
    region = F.xxhash64(*[F.col(k) for k in by]) if by else F.lit(0).cast("long")
    rows = kept.select(region.alias("region"), F.explode(scores).alias("s"), F.col(y).cast("int").alias("y"), F.xxhash64(F.col(rid), F.lit(seed)).alias("mark"))
    rows = rows.select("region", "s.which", "s.score", "y", "mark")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(rows.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)] or [0.5], 1000)).first()[0] or []))
    below = F.lit(0)
    for v in bounds:
        below = below + (F.col("score") > v).cast("int")
    ranged = rows.withColumn("range", (F.lit(len(bounds)) - below).cast("int"))  # 0 has the highest scores
    ordered = cut_lineage(ranged.repartition(parts, "region", "which", "range").sortWithinPartitions("region", "which", "range", F.desc("score"), "mark").select("region", "which", "range", "score", "y", "mark"))
    kinds = "region long, which int, range int, n binary, pos binary, gain binary"

    def sums(before) -> dict[tuple, list[np.ndarray]]:
        got = ordered.mapInArrow(_steps_frames(repeats, before), kinds).collect()
        return {(r["region"], r["which"], r["range"]): [np.frombuffer(r[c]) for c in ("n", "pos", "gain")] for r in got}

    first = sums(None)
    above, total = {}, {}
    for key in sorted(first):
        n, pos = total.get(key[:2], (0.0, 0.0))
        above[key] = n + np.zeros(repeats + 1), pos + np.zeros(repeats + 1)
        total[key[:2]] = n + first[key][0], pos + first[key][1]
    scale = {k: (n[0] - pos[0]) / np.maximum(n - pos, 1) / (pos[0] / np.maximum(pos, 1)) if classwise and pos[0] else np.ones(repeats + 1) for k, (n, pos) in total.items()}
    held = spark.sparkContext.broadcast({k: (*v, scale[k[:2]]) for k, v in above.items()})
    gained: dict[tuple, np.ndarray] = {}
    for key, (_, _, gain) in sorted(sums(held).items(), key=lambda x: x[0]):
        gained[key[:2]] = gained.get(key[:2], 0.0) + gain
    names = {r["_r"]: tuple(r[k] for k in by) for r in df.select(*by, region.alias("_r")).distinct().collect()} if by else {0: ()}
    out = []
    for r, own in names.items():
        none = np.zeros(repeats + 1)
        n, pos = total.get((r, 0), (none, none))
        gain = (gained.get((r, 1), none) - gained.get((r, 0), none)) / np.maximum(pos, 1)
        both = (pos[1:] > 0) & (pos[1:] < n[1:])
        draws = gain[1:][both]
        spread = [float(np.std(draws, ddof=1)) if len(draws) > 1 else None, *(float(np.quantile(draws, q)) if len(draws) else None for q in (0.025, 0.975))]
        out.append((*own, float(gain[0]) if 0 < pos[0] < n[0] else None, *spread, len(draws)))
    fields = df.select(*by).schema.fields if by else []
    schema = StructType([*fields, *[StructField(c, DoubleType()) for c in ("gain", "se", "lower", "upper")], StructField("repeats", LongType())])
    return spark.createDataFrame(out, schema)


def stratified_gate(df: DataFrame, y: str, old: str, new: str, rid: str, seeds: tuple[int, ...] = (41, 42, 43), repeats: int = 200, most: int = 50_000) -> DataFrame:
    """(seed, gain, se, lower, upper, repeats, passed): the class-wise bootstrap of each seed on at most ``most`` audit rows
    of kept class shares; passed says whether every seed's lower bound is above zero."""
    from quarry.operators.split import audit_sample

    audit = audit_sample(df.select(rid, y, old, new), y, rid, most, seeds[0])
    each = [bootstrap_gain(audit, y, old, new, rid, repeats=repeats, seed=k, classwise=True).withColumn("seed", F.lit(k)) for k in seeds]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    worst = out.agg(F.min("lower").alias("_worst"))
    return out.crossJoin(F.broadcast(worst)).select("seed", "gain", "se", "lower", "upper", "repeats", F.coalesce(F.col("_worst") > 0, F.lit(False)).alias("passed"))  # one row


def harmless(gains: DataFrame, k: float = 2.0) -> bool:
    """Whether no region's gain falls below -k standard errors; a region with one class fails."""
    return all(r["gain"] is not None and r["gain"] >= -k * (r["se"] or 0.0) for r in gains.collect())


def beneficial(gains: DataFrame, k: float = 1.0) -> bool:
    return all(r["gain"] is not None and r["gain"] >= k * (r["se"] or 0.0) for r in gains.collect())


def decide(gains: DataFrame, harm_k: float = 2.0, benefit_k: float | None = None) -> DataFrame:
    """gains with passed: harm rule, and the benefit rule if asked."""
    fine = F.col("gain").isNotNull() & (F.col("gain") >= -harm_k * F.coalesce("se", F.lit(0.0)))
    if benefit_k is not None:
        fine = fine & (F.col("gain") >= benefit_k * F.coalesce("se", F.lit(0.0)))
    return gains.withColumn("passed", fine)


@dataclass
class BlockBudget:
    """Validation blocks, each to be used once; use() gives the next and raises when none is left. The first is halved."""

    blocks: list[list[str]] = field(default_factory=lambda: [["1a", "1b"], ["2"], ["3"]])
    used: int = 0

    @property
    def left(self) -> int:
        return len(self.blocks) - self.used

    def use(self) -> list[str]:
        if not self.left:
            raise RuntimeError("validation blocks are exhausted")
        self.used += 1
        return self.blocks[self.used - 1]


class TestVault:
    """Holds the test labels; evaluate() once, with a prediction for every row."""

    __test__ = False

    def __init__(self, labels: DataFrame, rid: str, y: str):
        self._labels, self._rid, self._y, self.used = labels.select(rid, F.col(y).alias("_y")), rid, y, False

    def evaluate(self, predictions: dict[str, DataFrame], p: str = "p") -> dict[str, dict[str, float]]:
        """{name: {"ap", "auc"}}; the labels do not leave the vault otherwise. A frame that stands under several names is measured once."""
        if self.used:
            raise RuntimeError("the test part was evaluated before")
        frames = {id(df): df for df in predictions.values()}

        def met(df: DataFrame) -> DataFrame | None:
            """The labels with their predictions, if these are one finite value for every row."""
            good = F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(F.col(p)) < float("inf"))
            said = df.where(good).groupBy(self._rid).agg(F.count(F.lit(1)).alias("_n"), F.first(p).alias(p))
            both = cut_lineage(self._labels.withColumn("_met", F.lit(True)).join(said, self._rid, "full"))
            return both.where("_met").select("_y", p) if both.where("(_met AND _n IS NULL) OR _n > 1").isEmpty() else None

        rows = dict(zip(frames, together(self._labels.sparkSession, [lambda df=df: met(df) for df in frames.values()]), strict=True))
        for name, df in predictions.items():
            if rows[id(df)] is None:
                raise ValueError(f"predictions of {name} are not one finite value for every test row")
        self.used = True
        got = dict(zip(rows, together(self._labels.sparkSession, [lambda df=df: ap_and_auc(df, "_y", p).first() for df in rows.values()]), strict=True))
        return {name: {"ap": got[id(df)]["ap"], "auc": got[id(df)]["auc"]} for name, df in predictions.items()}


def choose_core(df: DataFrame, y: str, candidates: list[str]) -> DataFrame:
    """(candidate, ap, chosen): the state of highest average precision, the earlier on ties."""
    from quarry.operators.metrics import stack_scores

    order = {c: i for i, c in enumerate(candidates)}
    aps = average_precision(stack_scores(df, y, {c: F.col(c) for c in candidates}), "y", "p", ["candidate"])
    ranked = aps.withColumn("_o", F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])[F.col("candidate")])
    best = ranked.orderBy(F.desc("ap"), "_o").limit(1).select(F.col("candidate").alias("_best"))
    return ranked.crossJoin(F.broadcast(best)).select("candidate", "ap", (F.col("candidate") == F.col("_best")).alias("chosen"))  # one row


def stack_decision(gains: DataFrame, rule: str = "one_se") -> bool:
    """Whether the stacked model replaces the simple one: any gain ("legacy"), or a gain of more than one standard error."""
    row = gains.first()
    return row["gain"] is not None and row["gain"] > (row["se"] or 0.0 if rule == "one_se" else 0.0)
