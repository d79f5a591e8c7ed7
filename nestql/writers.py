"""Result sets as JSON, CSV or plain text, row by row from the driver's iterator."""

from __future__ import annotations

import csv
import datetime
import decimal
import json
from collections.abc import Iterable
from typing import Any, TextIO

from pyspark.sql import DataFrame, Row


def plain(value: Any) -> Any:
    """A value as JSON has it."""
    if isinstance(value, Row):
        if value.__fields__ == ["ts", "zone"]:
            return offset_text(value)
        return {k: plain(v) for k, v in zip(value.__fields__, value, strict=True)}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, datetime.datetime):
        return value.isoformat(timespec="milliseconds" if value.microsecond else "seconds")
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value.toPython() if hasattr(value, "toPython") else value


def offset_text(value: Row) -> str:
    from zoneinfo import ZoneInfo

    zone = datetime.UTC if value.zone == "Z" else ZoneInfo(value.zone) if "/" in value.zone or value.zone.isalpha() else datetime.datetime.fromisoformat(f"2000-01-01T00:00:00{value.zone}").tzinfo
    local = value.ts.replace(tzinfo=datetime.UTC).astimezone(zone)
    return local.isoformat(timespec="milliseconds" if local.microsecond else "seconds").replace("+00:00", "Z")


def write_json(results: Iterable[DataFrame], out: TextIO, pretty: bool = False, row_per_line: bool = False) -> None:
    """An array of result sets, each an array of objects. Names that repeat stay apart."""
    indent = 2 if pretty else None
    out.write("[")
    for i, df in enumerate(results):
        out.write(("," if i else "") + "[")
        for j, row in enumerate(df.toLocalIterator()):
            pairs = ", ".join(f"{json.dumps(k)}: {json.dumps(plain(v), indent=indent, default=str)}" for k, v in zip(df.columns, row, strict=True))
            out.write(("," if j else "") + ("\n" if pretty or row_per_line else "") + "{" + pairs + "}")
        out.write("]")
    out.write("]")


def write_csv(results: Iterable[DataFrame], out: TextIO, separator: str = ",", headers: bool = True, escape: bool = True) -> None:
    writer = csv.writer(out, delimiter=separator, lineterminator="\n", quoting=csv.QUOTE_MINIMAL if escape else csv.QUOTE_NONE, escapechar=None if escape else "\\")
    for i, df in enumerate(results):
        if i:
            out.write("\n")
        if headers:
            writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow("" if v is None else json.dumps(v, default=str) if isinstance(v, (dict, list)) else v for v in map(plain, row))


def write_text(results: Iterable[DataFrame], out: TextIO) -> None:
    for i, df in enumerate(results):
        if i:
            out.write("\n")
        for row in df.toLocalIterator():
            out.write("\t".join("" if v is None else str(plain(v)) for v in row) + "\n")
