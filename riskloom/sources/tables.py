"""Readers and writers: columnar and text tables, artefacts, HTML and XLSX reports."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Mapping
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None, **options) -> DataFrame:
    """Parquet, ORC, JSON, CSV (with header) or text by ending or ``fmt``."""
    fmt = fmt or next((e for e in ("parquet", "orc", "json", "csv", "text") if path.rstrip("/").endswith(e) or path.endswith(f".{e}.gz")), "parquet")
    reader = spark.read.options(**({"header": "true"} if fmt == "csv" else {}) | options)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv" and "inferSchema" not in options:
        reader = reader.option("inferSchema", "true")
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(fmt).mode(mode).options(**({"header": "true"} if fmt == "csv" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def save_artefact(spark: SparkSession, text: str, path: str) -> None:
    """A JSON artefact (bin model, rule set, scorecard) as a one-line text table in any store that Spark reaches."""
    spark.createDataFrame([(text.replace("\n", " "),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_artefact(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first()[0]


def _rows(df: DataFrame, limit: int) -> tuple[list[str], list[list]]:
    """Header and rows of a summary table; a report holds ``limit`` rows of it at most, and says so in a last row if there are more."""
    rows = [list(r) for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        rows[limit:] = [[f"only the first {limit} rows are shown", *[None] * (len(df.columns) - 1)]]
    return df.columns, rows


def html_report(tables: Mapping[str, DataFrame], title: str = "Report", limit: int = 1000) -> str:
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>td,th{{border:1px solid #ccc;padding:2px 6px}}table{{border-collapse:collapse}}</style><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head, rows = _rows(df, limit)
        cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in row) + "</tr>"
        out.append(f"<h2>{html.escape(name)}</h2><table>{cells('th', head)}{''.join(cells('td', r) for r in rows)}</table>")
    return "".join(out)


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        i, r = divmod(i, 26)
        out, i = chr(65 + r) + out, i - 1
    return out


def xlsx_report(tables: Mapping[str, DataFrame], limit: int = 100_000) -> bytes:
    """A workbook with one sheet per table (plain cells, no styling)."""
    def sheet(df: DataFrame) -> str:
        head, rows = _rows(df, limit)
        lines = []
        for y, row in enumerate([head, *rows], 1):
            cells = []
            for x, v in enumerate(row):
                ref = f"{_column(x)}{y}"
                if isinstance(v, bool) or v is None or not isinstance(v, (int, float)) or v != v:
                    cells.append("" if v is None else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                else:
                    cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            lines.append(f'<row r="{y}">{"".join(cells)}</row>')
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>'

    names = list(tables)
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet(tables[n]))
    return buffer.getvalue()
