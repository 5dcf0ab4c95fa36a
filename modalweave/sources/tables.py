"""Readers for the metadata table, wide modality tables, image manifests and images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalweave.operators.keys import keep_first
from modalweave.operators.skew import salted_join

META_SCHEMA = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("donor", T.IntegerType()),
        T.StructField("technology", T.StringType()),
        T.StructField("cell_type", T.StringType()),
    ]
)


#: Name of the column that tells where a row stood in its files.
POSITION = "_position"


def position(indexed: bool = False) -> Column:
    """Where a row of a file source stands: file, first byte of its split, number within the split.

    Add it where the files are read, before any exchange. A split is read by one task in its order, so the running
    number of the task orders its rows; splits are ordered by their first byte, files by their path. ``indexed``: the
    format numbers its rows itself (Parquet), so the number is that of the file and doesn't depend on the splits.
    """
    if indexed:
        start, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
    else:
        start, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    return F.struct(F.col("_metadata.file_path").alias("file"), start.alias("start"), row.alias("row"))


def read_metadata(spark: SparkSession, path: str, positions: bool = False) -> DataFrame:
    """Metadata CSV with header, columns matched by name. With ``positions``, each row tells its place in the files,
    so that ``keep_first(meta, keys, [POSITION])`` keeps the row that comes first in the file."""
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    own = [position().alias(POSITION)] if positions else []
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in META_SCHEMA], *own)


def first_in_file(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row that comes first in its files; ``df`` was read with positions, which are dropped."""
    return keep_first(df, keys, [POSITION]).drop(POSITION)


def header_index(spark: SparkSession, path: str, at_once: int = 256) -> dict[str, list[str]]:
    """The files of each header line. Of a file only the lines up to its first one that isn't blank are read.

    A limit of one line ends a scan after its first buffer, so the cost is one buffer a file, whatever follows. Names of
    files come from the listing that Spark holds for the table anyway; one job looks at ``at_once`` of them.
    """
    files = sorted(spark.read.text(path).inputFiles())
    found: dict[str, list[str]] = {}
    for lo in range(0, len(files), at_once):
        lines = [
            spark.read.text(f).where(F.trim("value") != "").limit(1).select(F.lit(f).alias("file"), "value")
            for f in files[lo : lo + at_once]
        ]
        for file, header in reduce(DataFrame.unionAll, lines).collect():
            found.setdefault(header, []).append(file)
    return found


def read_modality(spark: SparkSession, path: str, key: str = "cell_id"):
    """Wide CSV (key + one numeric column per feature) as ``(key, features)`` and its column names.

    Files may order their columns differently: a column is matched by its name, in the order of the
    first file; files of other columns are an error. Headers cost one buffer of each file; values are parsed by the
    executors. Convert once to parquet, the wide text form is for exchange only.
    """
    headers = sorted(((min(files), header, files) for header, files in header_index(spark, path).items()))
    if not headers:
        raise ValueError(f"no file with a header in {path}")
    parts, names = [], []
    for first, header, files in headers:
        source = path if len(headers) == 1 else files
        raw = spark.read.csv(source, header=True, maxColumns=header.count(",") + 2)
        found = [c for c in raw.columns if c != key]
        names = names or found
        if sorted(found) != sorted(names) or key not in raw.columns:
            raise ValueError(f"{first} has other columns than the files before it")
        parts.append(raw.select(key, to_vector(names).alias("features")))
    return reduce(DataFrame.unionByName, parts), names


def to_vector(columns: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def read_manifest(spark: SparkSession, path: str, key: str = "cell_id") -> DataFrame:
    """Image manifest CSV: the key and one column that holds a file name."""
    raw = spark.read.csv(path, header=True)
    files = [c for c in raw.columns if c != key]
    if len(files) != 1:
        raise ValueError(f"an image manifest has one file column, got {files}")
    return raw.select(key, F.col(files[0]).alias("file"))


def read_images(spark: SparkSession, directory: str) -> DataFrame:
    """Images of a directory: ``file, height, width, channels, data`` (bytes in BGR order).

    A file that can't be decoded stays, with NULL in all but its name.
    """
    img = spark.read.format("image").option("dropInvalid", False).load(directory)
    decoded = F.col("image.height") > 0
    fields = {"height": "height", "width": "width", "channels": "nChannels", "data": "data"}
    return img.select(
        base_name(F.col("image.origin")).alias("file"),
        *[F.when(decoded, F.col(f"image.{f}")).alias(n) for n, f in fields.items()],
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def attach_images(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest rows with their image, matched by file name; one image may serve very many rows.

    A row whose file is missing or can't be decoded stays, with NULL image columns.
    """
    return salted_join(manifest.withColumn("file", base_name(F.col("file"))), images, ["file"], "left")


def rejected_images(attached: DataFrame) -> DataFrame:
    """The rows of ``attach_images`` that have no image."""
    return attached.where(F.col("data").isNull()).drop("height", "width", "channels", "data")


def require_images(attached: DataFrame) -> None:
    """An error that counts the rows without an image and names one of their files."""
    n, file = rejected_images(attached).agg(F.count(F.lit(1)), F.min("file")).first()
    if n:
        raise ValueError(f"{n} manifest rows have no readable image, among them {file}")
