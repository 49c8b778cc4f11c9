"""Sources and sinks of localisation tables: delimited text with a column map, the common text formats, Parquet.

Text is read as lines and split by expressions, so a file of any size is read by many tasks; bad lines are counted, not
fatal.  Only the first lines are looked at on the driver, to tell the format.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records

COLUMNS = ("frame", "x", "y", "intensity", "background", "noise", "precision")


def sniff(spark: SparkSession, path: str) -> str:
    """The format's name by a file's first lines: text and binary records by their version tag, the old results table,
    nstorm, rapidstorm, malk, tagged spots, delimited or unknown."""
    lines = [r[0] for r in spark.read.text(path).limit(50).collect()]
    head = [x for x in lines if x.startswith("#")]
    text = "\n".join(lines)
    tag = next((x.removeprefix(records.VERSION) for x in head if x.startswith(records.VERSION)), "")
    if tag.startswith(("Text", "Binary")):
        return "text_records" if tag.startswith("Text") else "binary_records"
    if records.OLD_TABLE in text:
        return "results_table"
    if lines and "Channel Name" in lines[0]:
        return "nstorm"
    body = [x for x in lines if x and not x.startswith("#")]
    is_malk = bool(body) and all(len(x.split()) == 4 and all(_number(v) for v in x.split()) for x in body)
    if "<localizations " in text:
        return "malk" if is_malk else "rapidstorm"
    if is_malk:
        return "malk"
    if lines and lines[0].startswith("\x00\x00\x00\x00"):
        return "tagged_spots"
    return "delimited" if body else "unknown"


def _number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True


def _after_header(batches, header: int, comment: str | None):
    """Of (line, file, start of the block): the lines after each file's first ``header`` ones; a file begins in its block at 0."""
    file, left = None, 0
    for batch in batches:
        keep = []
        for line, name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != file:
                file, left = name, header if start == 0 else 0
            stays = bool(line.strip()) and not (comment and line.startswith(comment))
            if stays and left:
                stays, left = False, left - 1
            keep.append(stays)
        yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"]).filter(pa.array(keep, pa.bool_()))


def _fields(spark: SparkSession, path: str, delimiter: str, comment: str | None, header: int) -> DataFrame:
    """Lines without comments and the first ``header`` lines of each file, split.  A header is told by its place, not its text."""
    lines = spark.read.text(path)
    if header:
        lines = lines.select("value", "_metadata.file_path", "_metadata.file_block_start").mapInArrow(lambda b: _after_header(b, header, comment), "value string")
    else:
        lines = lines.where(F.trim("value") != "")
        lines = lines.where(~F.col("value").startswith(comment)) if comment else lines
    return lines.select(F.split(F.trim("value"), delimiter).alias("f"))


def delimited(spark: SparkSession, path: str, columns: dict[str, int], delimiter: str = "\t", comment: str | None = "#", header: int = 0, z_limits: tuple[float, float] | None = None, keep_bad: bool = False) -> DataFrame:
    """A table by a map of names to field numbers.  Lines that lack a field or hold no number there are bad: dropped, or
    kept and flagged with ``keep_bad``.  A width on one axis also sets the other."""
    rows = _fields(spark, path, delimiter, comment, header)
    get = lambda n, k: F.get("f", F.lit(k)).try_cast("int" if n in WHOLE else "double").alias(n)
    out = rows.select(*[get(n, k) for n, k in columns.items()])
    if "sx" in columns and "sy" not in columns:
        out = out.withColumn("sy", F.col("sx"))
    bad = ~_all_set(*columns)
    if z_limits and "z" in columns:
        out = out.where(F.col("z").between(*z_limits) | F.col("z").isNull())
    return out.withColumn("bad", bad) if keep_bad else out.where(~bad)


def _all_set(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def malk(spark: SparkSession, path: str) -> DataFrame:
    """x y frame intensity, parted by blanks."""
    return delimited(spark, path, {"x": 0, "y": 1, "frame": 2, "intensity": 3}, r"\s+")


def rapidstorm(spark: SparkSession, path: str, most_bad: int = 9) -> DataFrame:
    """x nm, y nm, frame, signal, squared widths, kernel improvement and residue; widths come out as the roots times 1000.

    More bad lines than allowed and the folder is refused, not read in part.
    """
    columns = {"x": 0, "y": 1, "frame": 2, "intensity": 3, "sx": 4, "sy": 5, "improvement": 6, "error": 7}
    out = delimited(spark, path, columns, r"\s+", keep_bad=True)
    if out.where("bad").limit(most_bad + 1).count() > most_bad:
        raise ValueError(f"more than {most_bad} bad lines")
    return out.where("NOT bad").withColumns({c: F.sqrt(c) * 1000 for c in ("sx", "sy")}).drop("bad", "improvement")


def nstorm(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with names in the first line; drift-corrected positions, length to end frame, width to deviation."""
    raw = spark.read.csv(path, sep="\t", header=True)
    num = lambda c: F.col(f"`{c}`").try_cast("double")
    ratio = F.when(num("Axial ratio") < 1, 1 / num("Axial ratio")).otherwise(num("Axial ratio"))
    sd = num("Width") / 2
    frame = num("Frame").cast("int")
    return raw.select(frame.alias("frame"), (frame + num("Length").cast("int") - 1).alias("end_frame"), num("Xc").alias("x"), num("Yc").alias("y"), num("Area").alias("intensity"), num("BG").alias("background"), (sd * F.sqrt(ratio)).alias("sx"), (sd / F.sqrt(ratio)).alias("sy")).where(_all_set("frame", "x", "y"))


def write_text(df: DataFrame, path: str, columns: list[str], units: dict[str, float] | None = None) -> None:
    """Tab-separated text with the names in each file's first line; columns are scaled by ``units``."""
    df.select(*[(F.col(c) * (units or {})[c]).alias(c) if c in (units or {}) else F.col(c) for c in columns]).write.csv(path, sep="\t", header=True)


def read_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


#: The names of result files, without units, and the columns they stand for.
RESULT_NAMES = {
    "Id": "id", "Category": "category", "Frame": "frame", "Peak": "frame", "End Frame": "end_frame", "End Peak": "end_frame", "origX": "orig_x", "origY": "orig_y",
    "origValue": "orig_value", "Error": "error", "Noise": "noise", "Mean": "mean_intensity", "Background": "background", "Intensity": "intensity", "Signal": "intensity",
    "X": "x", "Y": "y", "Z": "z", "S": "sx", "Sx": "sx", "Sy": "sy", "Precision": "precision",
}
WHOLE = {"frame", "id", "end_frame", "category", "orig_x", "orig_y"}


def result_columns(header: str) -> tuple[list[str], dict[str, str]]:
    """The columns of a header line and their units; a deviation is named after the column before it, unknown names are kept."""
    names: list[str] = []
    units: dict[str, str] = {}
    for field in header.lstrip("#").rstrip("\n").split("\t"):
        name, _, unit = field.strip().partition(" (")
        names.append(f"{names[-1]}_sd" if name == "+/-" and names else RESULT_NAMES.get(name, name))
        if unit:
            units[names[-1]] = unit.rstrip(")")
    return names, units


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated result file of any version: columns come from the last # line that has tabs, with end frames, ids, categories, deviations and precisions where it names them.  Lines with too
    few or bad fields are left out."""
    lines = spark.read.text(path)
    heads = [r[0] for r in lines.where(F.col("value").startswith("#") & F.col("value").contains("\t")).distinct().collect()]  # a few a file
    if len({h.count("\t") for h in heads}) > 1:
        heads = sorted(heads, key=lambda h: h.count("\t"))
    if not heads:
        raise ValueError("no line names the columns")
    names, _ = result_columns(heads[-1])
    kind = lambda n: "int" if n in WHOLE else "double"
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split("value", "\t", -1).alias("f"))
    return rows.select(*[F.get("f", F.lit(k)).try_cast(kind(n)).alias(n) for k, n in enumerate(names)]).where(_all_set(*names))


def write_results(df: DataFrame, path: str, units: dict[str, str] | None = None) -> None:
    """Tab-separated result files; each part starts with a # line of names and units.  Only known columns are written, and
    rows that lack one of them cannot be: they raise no error but read back as bad lines."""
    named = {c: n for n, c in reversed(RESULT_NAMES.items())}
    have = [c for c in named if c in df.columns]
    order = sorted(have, key=lambda c: list(RESULT_NAMES.values()).index(c))
    label = lambda c: named[c] + (f" ({units[c]})" if units and c in units else "")
    df.select(*[F.col(c).alias(("#" if k == 0 else "") + label(c)) for k, c in enumerate(order)]).write.option("comment", "~").csv(path, sep="\t", header=True)  # or # is quoted


def write_malk(df: DataFrame, path: str) -> None:
    """x y frame intensity, parted by blanks, as ``malk`` reads them."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x", "y", "frame", "intensity")]).alias("value")).write.text(path)


def write_columns(df: DataFrame, path: str, columns: list[tuple[str, Column]], suffix: str = "") -> None:
    """Text of chosen expressions under chosen names, each value with ``suffix``."""
    df.select(*[F.concat(c.cast("string"), F.lit(suffix)).alias(n) for n, c in columns]).write.csv(path, sep="\t", header=True)


def fan_out(df: DataFrame, *sinks) -> DataFrame:
    """Gives one stored copy of the rows to every sink, so they are computed once; returns the copy."""
    from ..operators.graph import shared_table

    stored = shared_table(df)
    for sink in sinks:
        sink(stored)
    return stored


#: Fixed-width big-endian records.
RECORD = np.dtype([("frame", ">i4"), ("x", ">f4"), ("y", ">f4"), ("intensity", ">f4"), ("noise", ">f4")])


def write_binary(df: DataFrame, path: str) -> None:
    """Fixed-width big-endian records (frame, x, y, intensity, noise), a batch of them in each row of one binary column of
    Parquet, so a reader can take them in parallel."""
    kinds = {"frame": "int"} | dict.fromkeys(("x", "y", "intensity", "noise"), "float")
    df.select(*[F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c) for c, t in kinds.items()]).mapInArrow(_pack, "records binary").write.parquet(path)


def _pack(batches):
    for batch in batches:
        rows = np.empty(batch.num_rows, RECORD)
        for k, c in enumerate(RECORD.names):
            rows[c] = batch.column(k).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["records"])


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).mapInArrow(_unpack, "frame int, x float, y float, intensity float, noise float")


def _unpack(batches):
    for batch in batches:
        for blob in batch.column(0):
            rows = np.frombuffer(blob.as_py(), RECORD)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c].astype(RECORD[c].newbyteorder("="))) for c in RECORD.names], list(RECORD.names))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """frame, id, category lines: exactly three whole numbers.  Ids and categories of 0 or less are skipped; a key that
    comes twice is an error."""
    rows = delimited(spark, path, {"frame": 0, "id": 1, "category": 2}, ",").where("id > 0 AND category > 0")
    if rows.groupBy("frame", "id").count().where("count > 1").limit(1).count():
        raise ValueError("a key comes twice")
    return rows


def export_tracks(df: DataFrame, path: str, style: str = "spoton", min_length: int = 2, exposure_s: float = 0.01, um_per_unit: float = 0.1, max_gap: int | None = None, max_jump: float | None = None) -> None:
    """Tracks of at least ``min_length`` rows as text in the layout of a tracking tool.

    With ``max_gap`` (frames) or ``max_jump``, a track ends before a longer gap or jump; its parts are numbered anew.
    """
    if max_gap is not None or max_jump is not None:
        from ..operators.graph import numbered
        from ..operators.tracks import islands

        parts = islands(df, 2**30 if max_gap is None else max_gap, max_jump, "_part")
        df = parts.join(numbered(parts.select("id", "_part").distinct(), "id", "_part", name="_id"), ["id", "_part"]).drop("id", "_part").withColumnRenamed("_id", "id")
    long = df.join(df.groupBy("id").count().where(F.col("count") >= min_length).select("id"), "id", "left_semi")
    x, y, t = F.col("x") * um_per_unit, F.col("y") * um_per_unit, F.col("frame") * exposure_s
    layouts = {
        "spoton": [F.col("frame"), t.alias("t"), F.col("id").alias("trajectory"), x.alias("x"), y.alias("y")],
        "vbspt": [F.col("id"), x.alias("x"), y.alias("y")],
        "anadda": [x.alias("x"), y.alias("y"), F.col("frame"), F.col("id").alias("track")],
        "nobias": [F.col("id").alias("track"), F.col("frame"), x.alias("x"), y.alias("y")],
    }
    long.repartitionByRange("id").sortWithinPartitions("id", "frame").select(*layouts[style]).write.csv(path, header=True)


def registered(spark: SparkSession) -> list[str]:
    """The names of the datasets in the session's registry."""
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def unregister(spark: SparkSession, name: str | None = None) -> None:
    """Takes a dataset, or all of them, out of the registry."""
    for n in registered(spark) if name is None else [name]:
        spark.catalog.dropTempView(n)


def register(df: DataFrame, name: str) -> None:
    """Puts a dataset in the session's registry of views."""
    df.createOrReplaceTempView(name)


def resolve(spark: SparkSession, name: str, scale: float = 1.0) -> DataFrame:
    """A dataset by registered name, or else by path; positions times ``scale``."""
    df = spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(name)
    return df.withColumns({c: F.col(c) * scale for c in ("x", "y") if c in df.columns}) if scale != 1 else df
