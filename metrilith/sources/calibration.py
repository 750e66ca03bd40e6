"""Stereo calibrations from files of several forms, as one table, and their JSON form."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of a calibration's parts, the preferred one first.
ALIASES = {
    "name": ("name",),
    "unit": ("unit",),
    "image_size": ("image_size", "imageSize"),
    "K_left": ("K_left", "left_camera_matrix"),
    "D_left": ("D_left", "left_distortion"),
    "K_right": ("K_right", "right_camera_matrix"),
    "D_right": ("D_right", "right_distortion"),
    "R": ("R", "rotation"),
    "T": ("T", "translation"),
    "P1": ("P1",),
    "P2": ("P2",),
    "Q": ("Q",),
}
#: Rows and columns of the matrices; the other numeric parts are read as one row.
SHAPES = {"K_left": (3, 3), "K_right": (3, 3), "R": (3, 3), "P1": (3, 4), "P2": (3, 4), "Q": (4, 4)}
ROWS = ("image_size", "D_left", "D_right", "T")
MATRIX = "array<array<double>>"
#: Paths of JSON lines: a file, or a part of a folder.
_LINES = r"(?i)\.jsonl(?:/part-[^/]+)?\z"


def _as_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """YAML and NPZ files as JSON text, where they are read; null for what isn't a mapping or can't be decoded."""

    def decode(path: str, content: bytes) -> str | None:
        if path.lower().endswith(".npz"):
            try:
                with np.load(io.BytesIO(content), allow_pickle=False) as parts:
                    return json.dumps({k: parts[k].tolist() for k in parts.files})
            except (ValueError, OSError):
                return None
        import yaml

        try:
            found = yaml.safe_load(content)
        except yaml.YAMLError:
            return None
        return json.dumps(found) if isinstance(found, dict) else None

    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "text": [decode(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]})


def _from_text(df: DataFrame) -> DataFrame:
    """Parts of (path, text) with JSON objects; a name that is present wins over later aliases even where its value is no good."""
    doc = df.withColumn("doc", F.try_parse_json("text"))
    whole = F.schema_of_variant("doc").startswith("OBJECT")
    part = lambda c: F.coalesce(*(F.try_variant_get("doc", f"$.{n}", "variant") for n in ALIASES[c]))
    matrix = lambda c: F.try_variant_get(part(c), "$", MATRIX)
    row = lambda c: F.coalesce(F.flatten(matrix(c)), F.try_variant_get(part(c), "$", "array<double>"))
    text = lambda c: F.try_variant_get(part(c), "$", "string")
    return doc.select(
        "path", F.coalesce(whole, F.lit(False)).alias("readable"), text("name").alias("name"), text("unit").alias("unit"), *(row(c).alias(c) for c in ROWS), *(matrix(c).alias(c) for c in SHAPES),
        *(part(c).isNotNull().alias(f"has_{c}") for c in ("D_left", "D_right", "R", "P1", "P2", "unit", "name")),
    )


def _from_xml(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of XML storage files: matrices hold rows, cols and data; only preferred names are known there."""
    cell = "struct<rows:int,cols:int,data:string>"
    schema = ", ".join(f"`{c}` {'string' if c in ('name', 'unit') else cell}" for c in ALIASES)
    raw = spark.read.format("xml").schema(schema).option("rowTag", "opencv_storage").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(folder)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), *ALIASES)
    flat = lambda c: F.transform(F.split(F.trim(f"{c}.data"), r"\s+"), lambda x: x.try_cast("double"))
    sound = lambda c: F.size(flat(c)) == F.col(f"{c}.rows") * F.col(f"{c}.cols")

    def matrix(c: str) -> Column:
        width = F.col(f"{c}.cols")
        lines = F.transform(F.sequence(F.lit(0), F.col(f"{c}.rows") - 1), lambda k: F.slice(flat(c), k * width + 1, width))
        return F.when(sound(c) & (F.col(f"{c}.rows") > 0) & (width > 0), lines)

    return raw.select(
        "path", F.lit(True).alias("readable"), "name", "unit", *(F.when(sound(c), flat(c)).alias(c) for c in ROWS), *(matrix(c).alias(c) for c in SHAPES),
        *(F.col(c).isNotNull().alias(f"has_{c}") for c in ("D_left", "D_right", "R", "P1", "P2", "unit", "name")),
    )


def _literal(rows: list[list[float]]) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in rows))


def _product(a: Column, b: Column, columns: int) -> Column:
    """a (3 x 3) times b (3 x columns)."""
    cell = lambda r, j: sum((F.get(r, k) * F.get(F.get(b, k), j) for k in (1, 2)), F.get(r, 0) * F.get(F.get(b, 0), j))
    return F.transform(a, lambda r: F.array(*(cell(r, j) for j in range(columns))))


def _finite(c: Column) -> Column:
    """False where a number is missing, not a number or infinite."""
    return F.forall(c, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def calibrations(spark: SparkSession, folder: str, units: tuple[str, ...] = ("mm",)) -> DataFrame:
    """One row for each calibration in the JSON, XML, YAML and NPZ files below a folder, with what is wrong with it.

    path, name, unit, image_size, K_left, D_left, K_right, D_right, R, T, P1, P2, Q, baseline
    and `issues`, the parts that are missing or no good (empty: a sound calibration; `file`
    alone: no mapping). Missing distortions are five zeros, a missing R is the unit matrix, a missing name
    stereo_camera, a missing unit mm; P1 and P2 follow from the cameras where they aren't given. Q stays
    null where it isn't given. Further parts of a file play no part; an empty folder gives no rows.
    JSON, YAML and NPZ files hold one calibration each, XML storages one or more. JSON lines, in .jsonl files or in the
    parts of a folder so named, hold one in each line. Calibrations are small, their number isn't bounded; Spark lists
    files at the driver, so a great many belong in JSON lines or storages. YAML needs its library where it is read.
    """
    files = lambda end: spark.read.option("pathGlobFilter", end).option("recursiveFileLookup", True)
    path = F.col("_metadata.file_path")
    # these go by the file's path alone, so that Spark leaves other files unread
    listed, json_end = path.rlike(_LINES), path.rlike(r"(?i)\.json\z")
    lines = files("{*.[jJ][sS][oO][nN][lL],part-*}").text(folder).filter(listed).select(path.alias("path"), F.col("value").alias("text")).filter(r"text rlike '\\S'")
    whole = files("*.{json,yaml,yml,npz,JSON,YAML,YML,NPZ}").format("binaryFile").load(folder).filter(~listed)
    texts = whole.filter(json_end).select(path.alias("path"), F.col("content").cast("string").alias("text"))
    coded = whole.filter(~json_end).select("path", "content").mapInPandas(_as_json, "path string, text string")
    df = _from_text(texts.unionByName(coded).unionByName(lines)).unionByName(_from_xml(spark, folder))

    default = lambda c, value: F.when(F.col(f"has_{c}"), F.col(c)).otherwise(value)
    zeros = F.array(*[F.lit(0.0)] * 5)
    df = df.withColumns({
        "D_left": default("D_left", zeros), "D_right": default("D_right", zeros), "R": default("R", _literal([[1, 0, 0], [0, 1, 0], [0, 0, 1]])),
        "name": default("name", F.lit("stereo_camera")), "unit": default("unit", F.lit("mm")), "image_size": F.slice("image_size", 1, 2).cast("array<int>"),
    })
    shaped = lambda c: (F.size(c) == SHAPES[c][0]) & F.forall(c, lambda r: (F.size(r) == SHAPES[c][1]) & _finite(r))
    beside = F.zip_with("R", F.transform("T", lambda x: F.array(x)), lambda r, t: F.concat(r, t))
    first = F.transform("K_left", lambda r: F.concat(r, F.array(F.lit(0.0))))
    ready = lambda *names: F.coalesce(F.lit(True) if not names else shaped(names[0]), F.lit(False))
    vector = F.coalesce((F.size("T") == 3) & _finite(F.col("T")), F.lit(False))
    df = df.withColumns({
        "P1": default("P1", F.when(ready("K_left"), first)),
        "P2": default("P2", F.when(ready("K_right") & ready("R") & vector, _product(F.col("K_right"), beside, 4))),
    })
    size = F.coalesce((F.size("image_size") == 2) & F.forall("image_size", lambda x: F.coalesce(x > 0, F.lit(False))), F.lit(False))
    sound = {"unit": F.coalesce(F.col("unit").isin(*units), F.lit(False)), "image_size": size, **{c: F.coalesce(shaped(c), F.lit(c == "Q")) for c in SHAPES}, "T": vector}
    issues = F.filter(F.array(*(F.when(~ok, F.lit(c)) for c, ok in sound.items())), lambda x: x.isNotNull())
    baseline = F.when(vector, F.sqrt(F.aggregate("T", F.lit(0.0), lambda a, x: a + x * x)))
    return df.select("path", *ALIASES, baseline.alias("baseline"), F.when(F.col("readable"), issues).otherwise(F.array(F.lit("file"))).alias("issues"))


def as_json(df: DataFrame) -> DataFrame:
    """(name, text) of calibrations: JSON that `calibrations` reads back; parts that are null are left out."""
    return df.select("name", F.to_json(F.struct("name", "image_size", *(F.col(c).alias(ALIASES[c][1]) for c in ("K_left", "K_right", "D_left", "D_right", "R", "T")), "P1", "P2", "Q", "unit")).alias("text"))
