"""Fields of XML labels, by local name and whatever the namespace."""

from __future__ import annotations

from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_value(xml: Column, name: str, any_case: bool = False) -> Column:
    """First non-empty text of an element of that local name, trimmed; null if there is none."""
    if any_case:
        test = f"translate(local-name(), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')='{name.lower()}'"
    else:
        test = f"local-name()='{name}'"
    values = F.xpath(xml, F.lit(f"//*[{test}]/text()"))
    return F.get(F.filter(F.transform(values, lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda v: v != ""), F.lit(0))


_BLANK = " \t\n\v\f\r"


def values(xml: Column, names: Sequence[str], any_case: bool = False) -> Column:
    """A struct of the same for several names, from one pass over the label; nulls for a label that is not XML."""
    wanted = [n.lower() if any_case else n for n in names]

    def read(text: str | None) -> dict[str, str]:
        found: dict[str, str] = {}
        try:
            root = ElementTree.fromstring(text) if text else None
        except ElementTree.ParseError:
            root = None
        for e in root.iter() if root is not None else ():
            if isinstance(e.tag, str):
                name = e.tag.rpartition("}")[2]
                name = name.lower() if any_case else name
                if name in wanted and name not in found:
                    parts = (t.strip(_BLANK) for t in (e.text, *(c.tail for c in e)) if t)
                    if value := next((t for t in parts if t), None):
                        found[name] = value
        return found

    @F.pandas_udf(", ".join(f"{n} string" for n in names))
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [read(t) for t in texts]
        return pd.DataFrame({n: [r.get(w) for r in rows] for n, w in zip(names, wanted, strict=True)}, dtype=object)

    return parse(xml)


#: The fields that labels are read for.
FIELDS = ("start_date_time", "instrument_id", "instrument_name", "solar_azimuth", "solar_elevation", "sun_azimuth_angle", "sun_elevation_angle")


def label_fields(xml: Column) -> Column:
    return values(xml, FIELDS, any_case=True)


def number_of(*values: Column) -> Column:
    """The first value that is there, as a number; null if it is malformed, whatever comes after it."""
    return F.expr("cast(null as double)") if not values else F.coalesce(*values).try_cast("double")


def instant(text: Column) -> Column:
    """An ISO-8601 time; Z is UTC. Null where it is malformed."""
    return F.try_to_timestamp(text)
