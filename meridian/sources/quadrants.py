"""Files of array light curves, one a quadrant and band, whose names say what they hold; searches open only the files they need."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import kept
from ..operators.spatial import in_ranges, nearest

#: The form of a file's name, and flags of bad epochs.
NAME, FORM = r"ztf_(\d{6})_z([gri])_c(\d{2})_q(\d)_dr(\d+)\.parquet$", "ztf_%06d_z%s_c%02d_q%d_dr%d.parquet"
BAD_EPOCH = 6141
KEYS = ["fieldid", "band", "ccdid", "qid", "release"]
OBJECTS = "objectid long, objra double, objdec double, hmjd array<double>, mag array<double>, magerr array<double>, catflags array<int>"
ARRAYS = ["hmjd", "mag", "magerr", "catflags"]


def name_of(*keys: Column | str) -> Column:
    return F.format_string(FORM, *keys)


def parts(path: Column) -> list[Column]:
    """KEYS out of a file's path; NULL where the name is of another form."""
    part = lambda i: F.nullif(F.regexp_extract(path, NAME, i), F.lit(""))
    return [(part(i + 1) if k == "band" else part(i + 1).cast("long")).alias(k) for i, k in enumerate(KEYS)]


def write(df: DataFrame, folder: str) -> int:
    """Writes df (KEYS and OBJECTS) as a named file for each of its keys; returns how many.

    A file is written under a name of its own and then moved to its right one, so a task that is repeated replaces what
    it wrote before.
    """
    names = [f.split()[0] for f in OBJECTS.split(", ")]

    def run(batches):
        from pyarrow import fs, parquet

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = out = draft = None
        for batch in batches:
            of = batch.column("_name").to_pylist()
            lo = 0
            while lo < len(of):
                hi = lo + 1
                while hi < len(of) and of[hi] == of[lo]:
                    hi += 1
                rows = batch.slice(lo, hi - lo).select(names)
                if of[lo] != name:
                    if out is not None:
                        out.close()
                        system.move(draft, f"{base}/{name}")
                        yield pa.RecordBatch.from_pydict({"name": [name]})
                    name, draft = of[lo], f"{base}/_{uuid.uuid4().hex}"
                    out = parquet.ParquetWriter(draft, rows.schema, filesystem=system)
                out.write_batch(rows)
                lo = hi
        if out is not None:
            out.close()
            system.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    dealt = df.select(name_of(*KEYS).alias("_name"), *names).repartition("_name").sortWithinPartitions("_name", "objectid")
    return dealt.mapInArrow(run, "name string").count()


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and KEYS of the files in a folder and below whose names are of the form; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select("path", "length", *parts(F.col("path"))).filter("fieldid is not null")


def _paths(files: DataFrame) -> list[str]:
    """The names of the files that are to be opened, on the driver."""
    return sorted(r["path"] for r in files.select("path").distinct().collect())


def _read(spark: SparkSession, paths: list[str], columns: list[str] | None) -> DataFrame:
    schema = OBJECTS if columns is None else ", ".join(f for f in OBJECTS.split(", ") if f.split()[0] in columns)
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema).withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    return rows.select(F.col("_metadata.file_path").alias("path"), "*")


def opened(spark: SparkSession, files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """OBJECTS (or some of their columns) of these files (path), with path and KEYS. The plan lists these files only."""
    return _read(spark, _paths(files), columns).select("*", *parts(F.col("path")))


def _numbered(spark: SparkSession, files: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows as opened() gives them, with a number, `file`, in place of path; and a row a file: file, path and KEYS, to broadcast.

    Numbers are what is shuffled: a path is longer than all else in a row.
    """
    paths = _paths(files)
    names = F.broadcast(spark.createDataFrame(list(enumerate(paths)), "file int, path string").select("*", *parts(F.col("path"))))
    return _read(spark, paths, columns).join(names, "path").drop("path"), names


def at_positions(spark: SparkSession, files: DataFrame, targets: DataFrame, boxes: DataFrame, radius: float, id_col: str) -> DataFrame:
    """id, path, objectid, sep: for each target and file of a field whose box holds it, the nearest object closer than radius.

    boxes: fieldid, ra_lo, ra_hi, dec_lo, dec_hi. The footprints give the files, only those are opened, and of them the
    columns of ids and places alone. A place is looked up once for a field, whatever its targets and the field's files;
    of an id with several places the nearest object counts.
    """
    placed = kept(in_ranges(targets.select("ra", "dec").distinct(), boxes).select(F.struct("ra", "dec").alias("at"), "ra", "dec", "fieldid"))
    rows, names = _numbered(spark, files.join(placed.select("fieldid").distinct(), "fieldid"), ["objectid", "objra", "objdec"])
    rows = rows.select("file", "fieldid", "objectid", F.col("objra").alias("ra2"), F.col("objdec").alias("dec2"))
    near = nearest(placed, rows, radius, "at", "objectid", on=("fieldid",), per=("file",))
    near = kept(near.filter(F.col("sep") < radius).select("at.ra", "at.dec", "file", "objectid", "sep"))
    rows = targets.select(id_col, "ra", "dec").filter("ra is not null and dec is not null")
    ids = rows.groupBy(id_col).agg(*[f(x).alias(y) for x in ("ra", "dec") for f, y in ((F.min, x), (F.max, f"_{x}"))])
    one = (F.col("ra") == F.col("_ra")) & (F.col("dec") == F.col("_dec"))
    several = rows.join(ids.filter(~one).select(id_col), id_col).join(near, ["ra", "dec"]).groupBy(id_col, "file").agg(F.min(F.struct("sep", "objectid")).alias("_b"))
    found = ids.filter(one).join(near, ["ra", "dec"]).select(id_col, "file", "objectid", "sep").union(several.select(id_col, "file", "_b.objectid", "_b.sep"))
    return found.join(names, "file").select(id_col, "path", "objectid", "sep")


def of_objects(spark: SparkSession, files: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """id, path, objectid of the objects under these ids (id, objectid) in any of the files."""
    return opened(spark, files, ["objectid"]).select("path", "objectid").join(ids, "objectid").select(id_col, "path", "objectid")


def light_curves(spark: SparkSession, found: DataFrame, id_col: str) -> DataFrame:
    """A row an epoch of what was found (id, path, objectid): the files are opened a second time for their arrays.

    Epochs with a bad flag or without a finite magnitude and error are left out.
    """
    rows, names = _numbered(spark, found)
    rows = rows.filter(" and ".join(f"{x} is not null" for x in ARRAYS))  # without an array there is no epoch
    rows = rows.join(found.join(names, "path").select(id_col, "file", "objectid"), ["file", "objectid"])
    e = rows.select(id_col, "objectid", "objra", "objdec", "band", F.explode(F.arrays_zip(*ARRAYS)).alias("e")).select(id_col, "objectid", "objra", "objdec", "band", "e.*")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return e.filter((F.col("catflags").bitwiseAND(BAD_EPOCH) == 0) & finite("mag") & finite("magerr"))
