"""Partitions, folds, blocks and samples. Every choice is a function of row ids (md5 order) or of positions in time, so the
same rows are chosen however the data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.schema import with_position


def lottery(seed: int | str, rid: str | Column) -> Column:
    """A row's ticket: rows in ticket order are in random, repeatable order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(rid) if isinstance(rid, str) else rid).cast("string")))


def ticket_rank(df: DataFrame, within: list[str], seed: int | str, rid: str, name: str = "_ticket", size: str | None = None) -> DataFrame:
    """1-based rank of each row's ticket within its groups (null is one), and on demand the groups' sizes.

    Tickets are evenly spread, so each group is cut into ranges of tickets: every range is numbered by a task of its own and
    shifted by the sizes of those before it. A label that nearly all rows have is no single task's work.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    span = F.floor(F.conv(F.substring("_lot", 1, 4), 16, 10).cast("long") * parts / 65536).cast("int")
    marked = df.withColumn("_lot", lottery(seed, rid)).withColumn("_range", span)
    sizes = marked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(within)], F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))  # a row a group and range
    keys = [f"_k{i}" for i in range(len(within))]
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select(*keys, "_r", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_size"))
    ranked = marked.withColumn("_place", F.row_number().over(Window.partitionBy(*within, "_range").orderBy("_lot", rid)))
    same = F.col("_range") == F.col("_r")
    for k, i in zip(within, keys, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(i))
    out = ranked.join(shifts, same).withColumn(name, F.col("_place") + F.col("_before"))
    return (out.withColumn(size, F.col("_size")) if size else out).drop("_lot", "_range", "_r", "_place", "_before", "_size", *keys)


def chronological(df: DataFrame, time: str, rid: str, test: float = 0.2, valid: float = 0.2, name: str = "_part") -> DataFrame:
    """I, V, T by time: the last ``test`` share is T, the last ``valid`` share of the rest V."""
    n = df.count()
    cut = int((1 - test) * n)
    first = int((1 - valid) * cut)
    placed = with_position(df, [time, rid])
    return placed.withColumn(name, F.when(F.col("_pos") < first, "I").when(F.col("_pos") < cut, "V").otherwise("T"))


def stratified(df: DataFrame, label: str, rid: str, seed: int = 42, test: float = 0.2, valid: float = 0.2, name: str = "_part") -> DataFrame:
    """I, V, T at random within each label: first T, then V from the rest, each a rounded share."""
    ranked = ticket_rank(df, [label], seed, rid, size="_n")
    n_test = F.round(F.col("_n") * test)
    n_valid = F.round((F.col("_n") - n_test) * valid)
    return ranked.withColumn(name, F.when(F.col("_ticket") <= n_test, "T").when(F.col("_ticket") <= n_test + n_valid, "V").otherwise("I")).drop("_ticket", "_n")


def stratified_folds(df: DataFrame, label: str, rid: str, k: int, seed: int = 0, name: str = "_fold") -> DataFrame:
    """Folds 0 .. k-1 of equal label shares, dealt in ticket order."""
    return ticket_rank(df, [label], seed, rid).withColumn(name, F.pmod(F.col("_ticket") - 1, F.lit(k)).cast("int")).drop("_ticket")


def block_of(pos: Column, n: int, k: int) -> Column:
    """The block of a 0-based position when n rows are cut into k runs, the first n mod k of them one row longer."""
    size, longer = divmod(n, k)
    head = longer * (size + 1)
    return F.when(pos < head, F.floor(pos / (size + 1))).otherwise(longer + F.floor((pos - head) / max(size, 1))).cast("int")


def weighted_blocks(pos: Column, n: int, weights: tuple[int, ...] = (3, 1, 1)) -> Column:
    """The block (1-based) of a position when n rows are cut by weights at half-even rounded places."""
    total, at, cuts = sum(weights), 0, []
    for w in weights[:-1]:
        at += w
        cuts.append(round(n * at / total))
    out = F.lit(1)
    for c in cuts:
        out = out + (pos >= c).cast("int")
    return out


def recent(pos: Column, n: int, level: int) -> Column:
    """Whether a position lies in the most recent n // 2**level rows."""
    return pos >= n - n // 2**level


def keep_positives(df: DataFrame, label: str, rid: str, ratio: float, seed: int = 0) -> DataFrame:
    """All positives and at most ratio negatives for each of them."""
    n_pos = df.where(F.col(label) == 1).count()
    ranked = ticket_rank(df, [label], seed, rid)
    return ranked.where((F.col(label) == 1) | (F.col("_ticket") <= int(ratio * n_pos))).drop("_ticket")


def sample_rows(df: DataFrame, rid: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, those of the smallest tickets.

    Counts by the tickets' first digits say in which range of tickets the last row lies; only that range, a 4096th of the rows, is sorted.
    """
    marked = df.withColumn("_lot", F.coalesce(lottery(seed, rid), F.lit("")))
    span = F.substring("_lot", 1, 3)
    left, last = most, None
    for r in sorted(marked.groupBy(span.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["s"]):  # at most 4097 rows
        if r["n"] > left:
            last = r["s"]
            break
        left -= r["n"]
    if last is None:
        return df
    within = marked.where(span == last).select("_lot", rid)
    end = within.orderBy("_lot", rid).limit(left).agg(F.max(F.struct("_lot", rid)).alias("e")).first()["e"] if left else None
    if end is None:
        return marked.where(span < last).drop("_lot")
    upto = (F.col("_lot") < end["_lot"]) | ((F.col("_lot") == end["_lot"]) & F.col(rid).eqNullSafe(F.lit(end[rid])))
    if within.where(upto).count() == left:
        return marked.where(upto).drop("_lot")
    return marked.where(span < last).unionByName(marked.where(span == last).orderBy("_lot", rid).limit(left)).drop("_lot")  # ids repeat at the cut


def audit_sample(df: DataFrame, label: str, rid: str, most: int, seed: int = 0) -> DataFrame:
    """About ``most`` rows with each label's share kept."""
    sized = ticket_rank(df, [label], seed, rid, size="_n")
    n = df.count()
    return sized.where(F.col("_ticket") <= F.round(F.col("_n") * (min(most, n) / max(n, 1)))).drop("_ticket", "_n")


def few_shot(df: DataFrame, label: str, rid: str, shots: int, seed: int = 0) -> DataFrame:
    """The same number of rows of each label."""
    return ticket_rank(df, [label], seed, rid).where(F.col("_ticket") <= shots).drop("_ticket")


def even_places(n: int, cap: int) -> list[int]:
    """cap evenly spaced places among n, ends included."""
    return list(range(n)) if n <= cap else sorted({(i * (n - 1)) // (cap - 1) for i in range(cap)})


def tail_holdout(df: DataFrame, time: str, rid: str, share: float = 1 / 9, name: str = "_holdout") -> DataFrame:
    """Marks the last share of the rows by time."""
    n = df.count()
    return with_position(df, [time, rid]).withColumn(name, F.col("_pos") >= n - int(n * share))
