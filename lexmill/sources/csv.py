"""CSV in and out.

``read_records`` is Spark's own reader with the settings that records need.  ``parse`` is a strict scanner for a whole
text, for files that Spark reads differently (blank lines as rows, quotes that open within a field).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def parse(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of cells.  A quote opens quoting anywhere in a cell, two quotes in it are one; LF, CR and CRLF end rows; a
    blank line is a row of one empty cell."""
    rows, row, cell, quoted, k = [], [], [], False, 0
    text = text.removeprefix(BOM)
    while k < len(text):
        c = text[k]
        if quoted:
            if c == '"' and text[k + 1 : k + 2] == '"':
                cell.append('"')
                k += 1
            elif c == '"':
                quoted = False
            else:
                cell.append(c)
        elif c == '"':
            quoted = True
        elif c == delimiter:
            row.append("".join(cell))
            cell = []
        elif c in "\r\n":
            k += text[k : k + 2] == "\r\n"
            rows.append([*row, "".join(cell)])
            row, cell = [], []
        else:
            cell.append(c)
        k += 1
    if row or cell or quoted or (text and text[-1] not in "\r\n"):
        rows.append([*row, "".join(cell)])
    return rows


def format_row(cells: list[str], delimiter: str = ",") -> str:
    return delimiter.join('"' + c.replace('"', '""') + '"' if any(x in c for x in ('"', delimiter, "\n", "\r")) else c for c in cells)


def records(text: str, delimiter: str = ",") -> tuple[list[str], list[dict[str, str]]]:
    """Header and records: short rows are filled with "", extra cells dropped, of equal names the last one wins."""
    rows = parse(text, delimiter)
    if not rows:
        return [], []
    header = rows[0]
    return header, [dict(zip(header, r + [""] * (len(header) - len(r)))) for r in rows[1:]]


def read_records(spark: SparkSession, path: str, delimiter: str = ",", row_id: str = "row_id") -> DataFrame:
    """All columns as strings, empty for missing cells, with a row number that rises in file order."""
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', sep=delimiter, mode="PERMISSIVE", inferSchema=False, encoding="UTF-8").csv(path)
    return df.na.fill("").withColumn(row_id, F.monotonically_increasing_id())


def read_records_strict(spark: SparkSession, path: str, header: list[str], delimiter: str = ",") -> DataFrame:
    """The strict scanner over whole files, one file a task: (path, row, one column for each header name)."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for text, name in zip(b["value"].to_pylist(), b["path"].to_pylist()):
                rows = [(name, k, *[r.get(h, "") for h in header]) for k, r in enumerate(records(text, delimiter)[1])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "row", *header])

    return files.mapInArrow(run, ", ".join(["path string", "row long", *[f"`{h}` string" for h in header]]))


def write_records(df: DataFrame, path: str, header: list[str] | None = None, delimiter: str = ",", single: bool = False) -> None:
    """Columns in the order of ``header``; null and missing cells are empty.  ``single`` makes one file."""
    header = header or df.columns
    cols = [F.coalesce(df[h].cast("string"), F.lit("")).alias(h) if h in df.columns else F.lit("").alias(h) for h in header]
    out = df.select(*cols)
    (out.coalesce(1) if single else out).write.mode("overwrite").options(header=True, quote='"', escape='"', sep=delimiter, emptyValue="", nullValue="").csv(path)
