"""Reading and writing datasets."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.schema import with_position

# ------------------------------------------------------------------ readers


def normalise_name(name: str) -> str:
    """Lower case; each other character than a letter or digit is an underscore; none at the ends."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def normalise_names(df: DataFrame) -> DataFrame:
    names = [normalise_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names clash once normalised: {names}")
    return df.toDF(*names)


def format_of(path: str) -> tuple[str, dict[str, str]]:
    """Spark's reader and options for a path's ending; gzip needs no mention."""
    base = re.sub(r"\.(gz|bz2|zst)$", "", path.rstrip("/").lower())
    for ending, found in ((".csv", ("csv", {"header": "true"})), (".tsv", ("csv", {"header": "true", "sep": "\t"})), (".json", ("json", {})), (".jsonl", ("json", {})), (".orc", ("orc", {}))):
        if base.endswith(ending):
            return found
    return "parquet", {}


def read_any(spark: SparkSession, paths: str | list[str], schema: str | None = None, infer: bool = True) -> DataFrame:
    """One table of all paths (globs allowed), united by column names. Spark itself resolves the paths, in any store; a
    missing one is its error. schema spares the pass that infers types of text formats."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        kind, options = format_of(path)
        reader = spark.read.format(kind).options(**options)
        if schema:
            reader = reader.schema(schema)
        elif kind == "csv" and infer:
            reader = reader.option("inferSchema", "true")
        part = reader.load(path)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no path given")
    return out


def read_jdbc(spark: SparkSession, url: str, dbtable: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table, read in ranges of a numeric column if its bounds are given. The driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def read_excel(spark: SparkSession, path: str, header_row: int = 0) -> DataFrame:
    """A sheet small enough for the driver; needs pandas' Excel support. ZIP archives hold one sheet."""
    import io
    import zipfile

    import pandas as pd

    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            name = next(n for n in z.namelist() if re.search(r"\.xlsx?$|\.csv$", n, re.I))
            raw, path = z.read(name), name
    table = pd.read_csv(io.BytesIO(raw), header=header_row) if path.lower().endswith(".csv") else pd.read_excel(io.BytesIO(raw), header=header_row)
    return spark.createDataFrame(table)


def count_rows(df: DataFrame) -> DataFrame:
    """One row: n. Over a Parquet scan this reads no column."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def time_range(df: DataFrame, time: str, rid: str, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 in time order: a filter on positions, so nothing is sorted into one task."""
    return with_position(df, [time, rid]).where((F.col("_pos") >= offset) & (F.col("_pos") < offset + limit)).drop("_pos")


# ------------------------------------------------------------------ cleaners


def to_epoch(c: str) -> Column:
    return F.unix_timestamp(c)


def day_first_date(c: str, pattern: str = "dd-MM-yyyy") -> Column:
    return F.try_to_timestamp(c, F.lit(pattern))


def strip_quotes(df: DataFrame, columns: list[str] | None = None, quote: str = "'") -> DataFrame:
    """df with quotes around strings removed, in all string columns by default."""
    columns = columns or [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.btrim(F.col(c), F.lit(quote)) for c in columns})


def label_of(c: str, positive: str) -> Column:
    """1 where the column is the positive value, else 0."""
    return F.coalesce((F.col(c) == positive).cast("int"), F.lit(0))


def year_of(c: str) -> Column:
    return F.year(F.col(c).try_cast("date"))


def demo(spark: SparkSession, n: int = 8000, seed: int = 7) -> DataFrame:
    """A synthetic table with event time, customers, four numbers, a region and a rare label; the same rows for a seed."""

    def u(k: int) -> Column:
        return F.pmod(F.xxhash64("event_time", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40)

    def z(k: int) -> Column:
        return F.sqrt(-2 * F.ln(F.greatest(u(k), F.lit(1e-12)))) * F.cos(2 * F.pi() * u(k + 1))

    rows = spark.range(n).select(F.col("id").cast("int").alias("event_time"))
    rows = rows.withColumns({"customer": F.floor(u(1) * 200).cast("int"), "income": F.exp(z(2) * 0.5 + 10), "debt": F.exp(z(4) * 0.7 + 9), "x1": z(6), "x2": z(8), "region": F.element_at(F.array(F.lit("north"), F.lit("south"), F.lit("east")), F.floor(u(10) * 3).cast("int") + 1)})
    risk = -3.2 + 0.8 * F.col("x1") + 1.1 * F.ln(F.col("debt") / F.col("income")) + 0.6 * (F.col("region") == "south").cast("int")
    return rows.withColumn("target", (u(11) < 1 / (1 + F.exp(-risk))).cast("int"))


LOADERS: dict[str, Callable[..., DataFrame]] = {"demo": demo, "files": read_any, "jdbc": read_jdbc, "excel": read_excel}


def register_loader(name: str, loader: Callable[..., DataFrame]) -> None:
    LOADERS[name] = loader


def load(spark: SparkSession, loader: str, *args, **kw) -> DataFrame:
    if loader not in LOADERS:
        raise ValueError(f"loader not known: {loader}; known: {sorted(LOADERS)}")
    return LOADERS[loader](spark, *args, **kw)


def dataset_registry(path: str) -> dict[str, dict]:
    """Datasets of a YAML file: each entry laid over its "defaults"."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    defaults = raw.pop("defaults", {})
    return {name: {**defaults, **(entry or {})} for name, entry in raw.items()}


# ------------------------------------------------------------------ sinks


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if kind == "csv":
        writer = writer.option("header", "true")
    writer.format(kind).save(path)


def json_safe(value):
    """The value with numbers of other libraries, sets, paths and non-finite floats as JSON knows them."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_safe(v) for v in value]
    if isinstance(value, set | frozenset):
        return sorted((json_safe(v) for v in value), key=str)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value if isinstance(value, str | int | float | bool | type(None)) else str(value)


def canonical_hash(value) -> str:
    return hashlib.sha256(json.dumps(json_safe(value), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_report(value, path: str) -> None:
    Path(path).write_text(json.dumps(json_safe(value), indent=2, sort_keys=True) + "\n", encoding="utf-8")


def append_log(value, path: str) -> None:
    """One JSON line more."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(json_safe(value), sort_keys=True) + "\n")


class ResponseCache:
    """Answers by the hash of their request, each checked against its own hash when read back."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _file(self, request) -> Path:
        return self.folder / f"{canonical_hash(request)}.json"

    def get(self, request):
        file = self._file(request)
        if not file.exists():
            return None
        held = json.loads(file.read_text(encoding="utf-8"))
        if canonical_hash(held["response"]) != held["sha256"]:
            raise ValueError(f"{file} was changed")
        return held["response"]

    def put(self, request, response) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self._file(request).write_text(json.dumps({"request": json_safe(request), "response": json_safe(response), "sha256": canonical_hash(response)}), encoding="utf-8")
