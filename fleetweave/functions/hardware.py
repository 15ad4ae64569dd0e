"""Hardware facts from labelled free text, such as `CPU: i7-1185G7; RAM: 16 GB`."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels of each field (fixed values).
LABELS = {
    "cpu": ("processor", "cpu"), "ram": ("memory", "ram"), "storage": ("hard drive", "storage", "disk", "ssd", "hdd"), "gpu": ("graphics", "gpu"), "display": ("display", "screen"),
    "os": ("operating system", "os"), "model": ("model",), "serial_number": ("serial number", "serial", "s/n"),
}
_FIELD = {label: name for name, labels in LABELS.items() for label in labels}
_LABEL = re.compile(r"(?<![A-Za-z0-9])(" + "|".join(sorted(map(re.escape, _FIELD), key=len, reverse=True)) + r")\s*[:=]\s*", re.IGNORECASE)


def labelled(text: str | None) -> dict[str, str]:
    """Value of each field: the text after its label up to the next label of another field; the first of a field counts."""
    out: dict[str, str] = {}
    marks = list(_LABEL.finditer(text or ""))
    for i, m in enumerate(marks):
        name = _FIELD[m[1].lower()]
        if name in out:
            continue
        end = next((n.start() for n in marks[i + 1 :] if _FIELD[n[1].lower()] != name), len(text))
        value = " ".join(text[m.end() : end].split()).rstrip("&;, ")
        if value:
            out[name] = value
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def hardware_fields(s: pd.Series) -> pd.Series:
    """Map of the labelled fields, empty without any (null and empty texts too)."""
    return s.map(labelled)
