"""Sheet readers: threat catalogue (S01) and incident sheet.

The reference reads xlsx workbooks; xlsx decoding is not on Spark's
classpath, so the same sheets are read as CSV exports (one file or a folder
of part files) with an all-string schema and cast once at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as K
from riskloom.functions import casts as C
from riskloom.functions.wallclock import fmt_day_first

CATALOGUE_COLUMNS = list(K.CATALOGUE_HEADERS.values())
# The CSV writer trims cell text by default; sheet cells keep their spaces.
_KEEP_SPACES = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def normalise_header(name: str) -> str:                                          # S06
    return name.strip().replace(" ", "_")


def sheet_order() -> list[Column]:
    """Order of rows in a sheet: file name, start of the split, row inside the split."""
    return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


_WIDTHS = (64, 1024, 16384)     # cells of a record that are looked at, one after the other; a sheet has 16,384 at most
_PART_RECORDS = 200_000         # records of a written part: a part is read by one task
_TAIL = 16                      # a header whose last cells at a width are all empty ends before it


def _records(spark: SparkSession, path: str, multi_line: bool, width: int, raw: bool = False) -> DataFrame:
    """(_file, _row, cells) of every record of every file; cells that a record does not have are null.

    ``raw`` adds the text of a record that has not just ``width`` cells as ``_raw``, null for the others.
    """
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    cells = F.array(*schema.fieldNames()).alias("cells")
    read = spark.read.option("header", "false").option("multiLine", str(multi_line).lower())
    if raw:
        schema, read = schema.add("_raw", T.StringType()), read.option("columnNameOfCorruptRecord", "_raw")
    return read.schema(schema).csv(path).select(
        F.col("_metadata.file_path").alias("_file"), F.struct(*sheet_order()).alias("_row"), cells, *(["_raw"] if raw else []))


def _headers(spark: SparkSession, path: str, multi_line: bool, key: str, width: int) -> DataFrame:
    """(_file, x) of every file: ``x`` is the place and the cells of its first record that holds ``key``, null if none does.

    Parsing ``width`` cells of every record costs more than all else where few are filled, so records are read as
    text and only those whose text holds the key are parsed; and a minimum of structs sorts its rows, so it only gets
    those, too.
    """
    def underlined(c: Column) -> Column:
        return F.replace(c, F.lit(" "), F.lit("_"))

    records = _records(spark, path, multi_line, 1, raw=True)
    likely = records.where(underlined(F.coalesce("_raw", F.col("cells")[0])).contains(key))
    names = [f"_c{i}" for i in range(width)]
    # The lambda keeps a record from being parsed once for each of its cells.
    parsed = F.expr(f"transform(array(from_csv(_raw, '{' string, '.join(names)} string')), p -> array(p.{', p.'.join(names)}))[0]")
    named = likely.select("_file", "_row", F.transform(F.when(F.col("_raw").isNull(), F.col("cells")).otherwise(parsed),
                                                       lambda c: underlined(F.trim(c))).alias("h"))
    found = named.where(F.array_contains("h", key)).groupBy("_file").agg(F.min(F.struct("_row", "h")).alias("x"))
    return records.select("_file").distinct().join(F.broadcast(found), "_file", "left")     # one row a file


def _laid_out(spark: SparkSession, path: str, multi_line: bool, headers: dict[str, str], optional: set[str]) -> DataFrame:
    """(_row, _above, _has_<optional column>, *columns) of every record: the cells under each file's own headers, wherever they stand.

    The header of a file is its first record that holds the first of ``headers``; a file without one goes on
    with the columns of the file before it, as the parts of one exported sheet do.  One row for each file
    passes the driver, as in Spark's own listing of the folder.
    """
    wanted = {normalise_header(h): name for h, name in headers.items()}
    key = next(iter(wanted))
    for width in _WIDTHS:
        found = _headers(spark, path, multi_line, key, width)
        layouts, missing, goes_on, place = [], [], False, None
        for file, x in sorted((r["_file"], r["x"]) for r in found.collect()):
            if x is not None:
                place = {wanted[h]: i for i, h in reversed(list(enumerate(x["h"]))) if h in wanted}
                lacking = [h for h, n in headers.items() if n not in place and n not in optional]
                missing += [f"headers missing in {file}: {lacking}"] if lacking else []
                goes_on |= len(place) < len(wanted) and any(h for h in x["h"][-_TAIL:])
            elif place is None:
                missing.append(f"no header row with {next(iter(headers))!r} in {file}")
                goes_on |= width < _WIDTHS[-1]
                continue
            layouts.append((file, None if x is None else tuple(x["_row"]), [place.get(n) for n in wanted.values()]))
        if not goes_on:
            break
    if missing:
        raise ValueError("; ".join(missing))
    # No cell after the last wanted one is read again.
    records = _records(spark, path, multi_line, 1 + max((i for _, _, at in layouts for i in at if i is not None), default=0))
    row_type = records.schema["_row"].dataType
    at = spark.createDataFrame(layouts, T.StructType([
        T.StructField("_sheet", T.StringType()), T.StructField("_header", row_type), T.StructField("_at", T.ArrayType(T.IntegerType()))]))
    rows = records.join(F.broadcast(at), F.col("_file") == F.col("_sheet"))
    return rows.select("_row", F.coalesce(F.col("_row") < F.col("_header"), F.lit(False)).alias("_above"),
                       *[F.col("_at")[list(wanted.values()).index(n)].isNotNull().alias(f"_has_{n}") for n in sorted(optional)],
                       *[F.get("cells", F.col("_at")[i]).alias(n) for i, n in enumerate(wanted.values())])


def _filled(columns) -> Column:
    return F.size(F.filter(F.array(*[F.trim(F.col(c)) for c in columns]), lambda c: c.isNotNull() & (c != "")))


def _threat_rows(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The records with ``_row``, ``_id`` (S09) and ``_title`` (banner, header or empty row)."""
    raw = _laid_out(spark, path, multi_line, K.CATALOGUE_HEADERS, set())
    number, filled = C.sheet_id("threat_id"), _filled(CATALOGUE_COLUMNS)
    title = (F.trim(F.col("threat_id")) == next(iter(K.CATALOGUE_HEADERS))) | (
        number.isNull() & ((filled == 0) | (F.col("_above") & (filled == 1))))
    return raw.withColumns({"_id": number, "_title": title})


def read_threat_sheet(spark: SparkSession, path: str, multi_line: bool = True, sequence: str | None = None) -> DataFrame:              # S01 + S13 + P19
    """Catalogue sheet whose real header is on the second row.

    ``path`` is a file, the folder of one exported sheet's parts, or a folder of sheets, each with banner and
    header of its own.  Columns are found by the text of each file's headers, wherever they stand; a missing header
    is an error.
    Ids follow S09 (``12.0`` is 12).  Banners (one filled cell, no id, above the header in sheet order),
    header rows and rows without any filled cell are left out; any other row without an id is an error,
    never dropped.  Breach cells are numbers where empty means True (D8); dates are ISO or day-first.  Cells
    may hold line breaks, so a file is read by one task (a folder by one for each part file); only a sheet
    known to have none may be split with ``multi_line=False``.  ``sequence`` names a column for the
    order of rows in the sheet.
    """
    rows = _threat_rows(spark, path, multi_line).where(~F.coalesce("_title", F.lit(False)))
    bad = F.raise_error(F.concat(F.lit("threat row without an id: "), F.coalesce("threat_id", F.lit("")), F.lit(" "),
                                 F.coalesce("name", F.lit("")))).cast("int")
    return rows.select(
        F.coalesce("_id", bad).alias("threat_id"),
        F.col("name"),
        F.col("description"),
        F.col("threat_source"),
        F.col("target_object"),
        C.truthy("confidentiality_breach").alias("confidentiality_breach"),
        C.truthy("integrity_breach").alias("integrity_breach"),
        C.truthy("availability_breach").alias("availability_breach"),
        C.parse_date("date_added").alias("date_added"),
        C.parse_date("last_modified").alias("last_modified"),
        F.col("status"),
        F.when(F.trim(F.col("notes")) == "", None).otherwise(F.col("notes")).alias("notes"),
        *([F.col("_row").alias(sequence)] if sequence else []),
    )


def count_rejected(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of the catalogue sheet that are not data rows (banner, header, rows without an id)."""
    rows = _threat_rows(spark, path, multi_line)
    return rows.agg(F.coalesce(F.sum(F.col("_id").isNull().cast("int")), F.lit(0).cast("bigint")).alias("rejected"))


def read_incident_sheet(spark: SparkSession, path: str, default_time: str | None = None, multi_line: bool = True,
                        sequence: str | None = None) -> DataFrame:  # S02
    """Incident sheet: header row of display names, day-first dates.

    Headers are normalised (S06) and mapped to engine names, file by file; in a file without
    a time column the time is the constant ``default_time`` (S11).  Rows without any filled cell,
    and rows of one cell above a header, are left out.  Host count and
    success default to 0 where the cell is empty, and numbers may be written as
    ``5.0`` (P20); other text in a number cell is an error; bad dates become null (S10).
    ``multi_line`` and ``sequence`` as for the threat sheet.
    """
    names = list(K.INCIDENT_SHEET_HEADERS.values())
    headers = {"Код предприятия": "enterprise_code"} | K.INCIDENT_SHEET_HEADERS
    raw = _laid_out(spark, path, multi_line, headers, {"incident_time"})
    own = F.replace(F.trim("enterprise_code"), F.lit(" "), F.lit("_")) == normalise_header(next(iter(headers)))
    filled = _filled(names)
    df = raw.where(~(F.coalesce(own, F.lit(False)) | (filled == 0) | (F.col("_above") & (filled == 1))))
    constant = F.lit(default_time or "2024-08-12 11:00:00").cast("timestamp_ntz")
    t = F.when(F.col("_has_incident_time"), C.parse_dayfirst("incident_time")).otherwise(constant)
    return df.select(
        F.col("enterprise_type"),
        F.col("enterprise_code"),
        C.default_zero("host_count").alias("host_count"),
        C.sheet_int("threat_code").alias("threat_code"),
        C.default_zero("success").alias("success"),
        F.col("region"),
        C.parse_dayfirst("incident_date").cast("date").alias("incident_date"),
        t.alias("incident_time"),
        *([F.col("_row").alias(sequence)] if sequence else []),
    )


def write_threat_sheet(catalog: DataFrame, path: str, banner: str = "Перечень угроз", first: list[str] = ()) -> None:
    """Export a catalogue in the sheet layout: banner row, header row, data rows; the columns headed ``first`` come first.

    Breach flags are written as 1/0 and missing (empty) when the part size is a
    multiple of 5, which exercises the empty → True rule on the way back.
    """
    spark = catalog.sparkSession
    headers = [*first, *(h for h in K.CATALOGUE_HEADERS if h not in first)]
    lead = spark.createDataFrame([[banner] + [""] * (len(headers) - 1), headers], [K.CATALOGUE_HEADERS[h] for h in headers])
    def flag(c):
        return F.when(F.col("threat_id") % 5 == 0, F.lit("")).otherwise(F.col(c).cast("int").cast("string"))
    body = catalog.select(
        F.col("threat_id").cast("string"), "name", "description", "threat_source", "target_object",
        flag("confidentiality_breach").alias("confidentiality_breach"),
        flag("integrity_breach").alias("integrity_breach"),
        flag("availability_breach").alias("availability_breach"),
        F.col("date_added").cast("string").alias("date_added"),
        fmt_day_first("last_modified", with_time=False).alias("last_modified"),
        "status", F.coalesce("notes", F.lit("")).alias("notes"))
    # The header is in the first part only: the readers carry it on to the parts after it.
    lead.coalesce(1).unionByName(body).write.mode("overwrite").options(**_KEEP_SPACES) \
        .option("maxRecordsPerFile", _PART_RECORDS).option("header", "false").csv(path)


def write_incident_sheet(incidents: DataFrame, path: str, first: list[str] = ()) -> None:
    """Export incidents in the sheet layout with display headers and day-first times; the columns headed ``first`` come first."""
    cols = {
        "enterprise_type": F.col("enterprise_type"),
        "enterprise_code": F.col("enterprise_code"),
        "host_count": F.col("host_count").cast("string"),
        "threat_code": F.col("threat_code").cast("string"),
        "success": F.col("success").cast("string"),
        "region": F.col("region"),
        "incident_date": fmt_day_first("incident_date", with_time=False),
        "incident_time": fmt_day_first("incident_time", seconds=True),
    }
    inv = {v: k for k, v in K.INCIDENT_SHEET_HEADERS.items()}
    cells = {inv[n]: c.alias(inv[n]) for n, c in cols.items()}
    incidents.select(*[cells[h] for h in [*first, *(h for h in cells if h not in first)]]) \
        .write.mode("overwrite").options(**_KEEP_SPACES).option("maxRecordsPerFile", _PART_RECORDS).option("header", "true").csv(path)
