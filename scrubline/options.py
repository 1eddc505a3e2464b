"""Options of the two cleaning plans and of null filling."""

from __future__ import annotations

from dataclasses import dataclass, field

from scrubline.functions import fixed_values as V
from scrubline.functions.text import CASE_MODES

DATE_ORDERS = ("auto", "global", "us")
OUTLIER_METHODS = ("z_score", "iqr")
FILL_METHODS = (
    "mean", "median", "mode", "forward", "backward", "interpolate", "zero", "custom", "drop",
)


@dataclass(frozen=True)
class TextOptions:
    strip_html: bool = True
    remove_urls: bool = False
    remove_emails: bool = False
    remove_phone: bool = False
    remove_emojis: bool = False
    remove_special_chars: bool = True
    keep_basic_punctuation: bool = True
    remove_non_utf8: bool = True
    replace_whitespace: bool = True
    replace_escape: bool = True
    normalize_case: bool = True
    case_mode: str = "title"
    remove_spaces: bool = True
    keep_paragraphs: bool = False
    remove_linebreaks: bool = True

    def __post_init__(self):
        if self.case_mode not in CASE_MODES:
            raise ValueError(f"case_mode must be one of {CASE_MODES}, not {self.case_mode!r}")


@dataclass(frozen=True)
class TableOptions:
    strip_headers: bool = True
    strip_strings: bool = True
    convert_dates: bool = True
    date_order: str = "auto"
    lowercase_text: bool = False
    remove_duplicates: bool = True
    remove_outliers: bool = False
    outlier_method: str = "z_score"
    outlier_threshold: float = V.Z_LIMIT

    def __post_init__(self):
        if self.date_order not in DATE_ORDERS:
            raise ValueError(f"date_order must be one of {DATE_ORDERS}, not {self.date_order!r}")
        if self.outlier_method not in OUTLIER_METHODS:
            raise ValueError(
                f"outlier_method must be one of {OUTLIER_METHODS}, not {self.outlier_method!r}"
            )


@dataclass(frozen=True)
class FillOptions:
    """``method`` for every column with nulls, or ``per_column`` (mean for numbers,
    mode for the rest where a column is not named). ``order_by`` is the row key that
    stands for file order; the ordered methods need it."""

    method: str | None = None
    per_column: dict[str, str] = field(default_factory=dict)
    custom: dict[str, str] = field(default_factory=dict)
    custom_value: str | None = None
    widen: bool = False
    order_by: str | None = None
    partition_by: tuple[str, ...] = ()

    def __post_init__(self):
        for m in [self.method, *self.per_column.values()]:
            if m is not None and m not in FILL_METHODS:
                raise ValueError(f"fill method must be one of {FILL_METHODS}, not {m!r}")
