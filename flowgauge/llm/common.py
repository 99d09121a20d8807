"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowgauge.tables import shared_path as new_path
from flowgauge.tables import stored as written

__all__ = ["LOWER", "new_names", "new_path", "words", "written"]

#: ASCII upper-case letters to lower case; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space (0x20, 0x09-0x0D), A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def new_names(table: DataFrame, *names: str) -> None:
    """Raises where ``table`` already has a column of one of these names, in any case of letters."""
    taken = {c.lower() for c in table.columns}
    clash = [n for n in names if n.lower() in taken]
    if clash:
        raise ValueError(f"the table already has a column {', '.join(clash)}; choose another name")
