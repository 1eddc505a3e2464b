"""Text held in JSON documents."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# the helpers travel with the function, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _leaves(node) -> list[str]:
    """Non-empty string values in document order; keys and other scalars are left out."""
    found, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if item:
                found.append(item)
        elif isinstance(item, (dict, list)):
            stack.extend(reversed(list(item.values()) if isinstance(item, dict) else item))
    return found


def _to_text(raw: str) -> str | None:
    try:
        return "\n".join(_leaves(json.loads(raw)))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _json_text(s: pd.Series) -> pd.Series:
    return s.map(_to_text, na_action="ignore")


def json_text(c: Column) -> Column:
    """String leaves joined by newline, in document order; null when ``c`` is not JSON.

    The engine's VARIANT type sorts object keys, hence the Arrow UDF over the
    standard parser.
    """
    return _json_text(c)
