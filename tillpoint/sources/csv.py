"""CSV sources (A1-A6): discovery, per-file encoding choice, typed scans,
row counts and column-name rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tillpoint.functions.text import renamed

CSV_OPTIONS = {"header": "true", "escape": '"'}


def plain_path(c):
    """A path column without URL encoding and without ``file:``, so that the metadata's
    paths, listed paths and given paths compare as equal."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def _plain(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _decodes(encoding: str):
    """Whether a line's bytes are text of this encoding; None when it is not known."""
    name = encoding.lower().replace("_", "-")
    if name in ("utf-8", "utf8"):
        return F.is_valid_utf8("value")
    if name in ("latin-1", "latin1", "iso-8859-1", "iso8859-1"):
        return F.lit(True)
    pairs = F.hex(F.col("value").cast("binary"))
    if name in ("ascii", "us-ascii"):
        return ~pairs.rlike("^(..)*[89A-F]")
    if name in ("cp1252", "windows-1252"):       # five bytes stand for nothing
        return ~pairs.rlike("^(..)*(81|8D|8F|90|9D)")
    return None


def discover(spark: SparkSession, directory: str, pattern: str = "*.csv", recursive: bool = False) -> list[str]:
    """A5: file paths under ``directory`` matching the glob (optionally
    recursive), sorted.  Only the listing (one row per file) reaches the driver."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return sorted(x.path for x in r.load(directory).select("path").collect())


def file_encodings(spark: SparkSession, paths, encoding: str = "utf-8") -> dict:
    """A1: the encoding per file: the requested one, then utf-8, then latin-1, the first
    that decodes every line.  Lines are
    checked by the executors, in parallel splits; one row per file comes back.  An encoding
    whose bytes can't be checked here (utf-16, cp1250, GBK) is refused: reading it as
    another one would give wrong letters without an error."""
    if _decodes(encoding) is None:
        raise ValueError(f"encoding {encoding!r} is not supported")
    lines = spark.read.text(list(paths)).select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        _decodes(encoding).alias("asked"), F.is_valid_utf8("value").alias("utf"))
    found = {r["path"]: r for r in lines.groupBy("path").agg(F.min("asked").alias("asked"), F.min("utf").alias("utf")).collect()}
    java = {"latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "cp1252": "windows-1252", "ascii": "US-ASCII"}

    def choose(path):
        r = found.get(_plain(path))
        if r is None or r["asked"]:          # an empty file has no line
            return java.get(encoding.lower().replace("_", "-"), encoding)
        return "utf-8" if r["utf"] else "ISO-8859-1"

    return {p: choose(p) for p in paths}


# ------------------------------------------------------------------ types of all files in one job

#: What a cell can be, from narrow to wide.
_INTEGER, _REAL = "^[+-]?[0-9]+$", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^(NaN|[+-]?Inf(inity)?)$"
_DAY = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
_CELL = ',("[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'


def _cells(line) -> F.Column:
    """The fields of a record, quotes removed.  Each match takes the comma before its field."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), 1)
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"[^"]*$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def _kind(c) -> F.Column:
    """The narrowest kind of a cell: null, int, bigint, decimal, double, date, timestamp, boolean or string."""
    return (F.when(c == "", "null")
             .when(c.rlike(_INTEGER), F.when(c.try_cast("int").isNotNull(), "int").when(c.try_cast("bigint").isNotNull(), "bigint").otherwise("decimal"))
             .when(F.trim(c).rlike(_REAL), "double")
             .when(c.rlike(_DAY + "$") & c.try_cast("date").isNotNull(), "date")
             .when(c.rlike(_DAY + "[ T]") & c.try_cast("timestamp").isNotNull(), "timestamp")
             .when(F.lower(c).isin("true", "false"), "boolean").otherwise("string"))


_KINDS = ("int", "bigint", "decimal", "double", "date", "timestamp", "boolean", "string")


def _column_type() -> F.Column:
    """The type that all cells of a column fit, from the counts of their kinds."""
    n = {k: F.col(f"n_{k}") for k in _KINDS}
    total = reduce(lambda a, b: a + b, n.values())
    whole = n["int"] + n["bigint"] + n["decimal"]
    number, time = whole + n["double"], n["date"] + n["timestamp"]
    return (F.when(total == 0, "string")
             .when(n["int"] == total, "int").when(n["int"] + n["bigint"] == total, "bigint")
             .when((whole == total) & (F.col("digits") <= 38), F.concat(F.lit("decimal("), F.col("digits").cast("string"), F.lit(",0)")))
             .when(number == total, "double").when(n["date"] == total, "date").when(time == total, "timestamp")
             .when(n["boolean"] == total, "boolean").otherwise("string"))


def column_types(spark: SparkSession, paths) -> DataFrame:
    """A2 + A5: ``(path, pos, header_line, column_type)`` for every column of every file, by one
    grouped aggregate over one scan of all files, however many they are.

    Cells are classed where they are read, and only counts per file, place and task are
    shuffled.  A file's header is the first line that isn't blank; its cells are counted with all
    others and taken off again.  Records are lines, as for ``read_csv`` without
    ``multi_line``.  An exponent makes a double, and so does a blank beside a number, as in Spark's own inference."""
    # a line's place in its file: the split, then the place within the split
    order = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = (spark.read.text(list(paths)).select("value", plain_path(F.col("_metadata.file_path")).alias("path"), order.alias("at"))
             .where(F.trim("value") != ""))
    cells = lines.select("path", "at", "value", F.posexplode(_cells(F.col("value"))).alias("pos", "cell")).withColumn("kind", _kind(F.col("cell")))
    digits = F.length(F.regexp_replace("cell", "^[+-]?0*", ""))
    counted = cells.groupBy("path", "pos").agg(
        F.min_by(F.struct(F.col("value").cast("binary").alias("line"), "kind"), "at").alias("first"), F.min("at").alias("at"),
        # the header may be the longest "number" of its column; it is no integer then, as a rule
        F.max(F.when(F.col("kind").isin("int", "bigint", "decimal"), digits)).alias("digits"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in _KINDS))
    # the header's cells are there for the places that it has; where its line starts the column, it is taken off
    start = counted.groupBy("path").agg(F.min("at").alias("top"))
    own = counted.join(start, "path").withColumn("has_header", F.col("at") == F.col("top"))
    rest = own.select("path", "pos", "has_header", "digits", F.col("first.line").alias("header_line"),
                      *((F.col(f"n_{k}") - (F.col("has_header") & (F.col("first.kind") == k)).cast("int")).alias(f"n_{k}") for k in _KINDS))
    return rest.where("has_header").select("path", "pos", "header_line", _column_type().alias("column_type"))


def _header(line: bytes, encoding: str) -> list[str]:
    """Column names as the reader makes them: an empty one is ``_c<place>``, names that repeat
    get their place behind them."""
    import csv

    names = next(csv.reader([line.decode(encoding, "replace")]), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def infer_schemas(spark: SparkSession, paths, encodings: dict | None = None) -> dict[str, StructType]:
    """A2 + A5: the schema of every file, by one job.  One row per file and column reaches the driver."""
    paths, encodings = list(paths), encodings or {}
    if not paths:
        return {}
    found: dict[str, list] = {}
    for r in column_types(spark, paths).collect():
        found.setdefault(r["path"], []).append(r)
    out = {}
    for p in paths:
        rows = sorted(found.get(_plain(p), []), key=lambda r: r["pos"])
        names = _header(bytes(rows[0]["header_line"]), encodings.get(p, "utf-8")) if rows else []
        types = {r["pos"]: r["column_type"] for r in rows}
        out[p] = StructType([StructField(n, StructType.fromDDL(f"c {types.get(i, 'string')}")["c"].dataType) for i, n in enumerate(names)])
    return out


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", schema=None, multi_line: bool = False) -> DataFrame:
    """A2: typed scan, by an explicit schema or by one inference pass.  A file is read in
    splits; ``multi_line`` allows line breaks in quoted fields and then makes it one task."""
    r = spark.read.options(**CSV_OPTIONS).option("encoding", encoding).option("multiLine", multi_line)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv_files(spark: SparkSession, paths, encoding: str = "utf-8", schemas=None, multi_line: bool = False) -> dict:
    """A1 + A5: ``{path: DataFrame}``, each file read with its own encoding and schema
    (``schemas`` gives known ones, which need no inference); a file that fails to
    read is reported as the exception.

    Two jobs, whatever the number of files: the encodings, and the types of all files without a
    known schema.  With ``multi_line`` records are no lines, and each such file has a pass of its own."""
    paths, schemas = list(paths), dict(schemas or {})
    out = {p: None if _there(spark, p) else FileNotFoundError(f"no such file: {p}") for p in paths}
    present = [p for p in paths if out[p] is None]
    encs = file_encodings(spark, present, encoding) if present else {}
    if not multi_line:
        schemas |= infer_schemas(spark, [p for p in present if p not in schemas], encs)
    for p in present:
        try:
            out[p] = read_csv(spark, p, encs[p], schemas.get(p), multi_line)
        except Exception as e:  # noqa: BLE001 - reported per file, the others go on
            out[p] = e
    return out


def count_by_file(df: DataFrame) -> DataFrame:
    """A4: rows per source file of a multi-file scan."""
    return df.groupBy(F.url_decode(F.col("_metadata.file_name")).alias("file_name")).agg(
        F.count(F.lit(1)).alias("row_count"))


def head_rows(df: DataFrame, n: int, order_by=None) -> DataFrame:
    """A3: the first ``n`` rows; with ``order_by`` the choice is reproducible."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def sanitize_columns(df: DataFrame) -> tuple[DataFrame, dict]:
    """Rename every column by rule 2, unique; returns the frame and the
    original -> new mapping."""
    new = renamed(df.columns)
    return df.toDF(*new), dict(zip(df.columns, new))


def with_provenance(df: DataFrame, loaded_at=None) -> DataFrame:
    """``source_file`` and ``loaded_at`` columns."""
    ts = F.current_timestamp() if loaded_at is None else F.lit(loaded_at).cast("timestamp")
    return df.withColumn("source_file", F.url_decode(F.col("_metadata.file_name"))).withColumn("loaded_at", ts)
