"""Patterns, word lists and limits whose exact value decides results."""

# --- Whitespace -----------------------------------------------------------
# The characters of Python's ``str.isspace``: as a class body under the Java flag
# (?U), and as a string. (Few, short class members: long unions of ranges run slow.)
WS = r"\s\x1c-\x1f"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Code points replaced by a plain space.
SPECIAL_SPACES = r"[\t\u00a0\u2000-\u200a\u202f\u205f\u3000]"

# Line terminators of ``str.splitlines``.
LINE_END_CHARS = r"\n\r\x0b\f\x1c\x1d\x1e\x85\u2028-\u2029"
LINE_END = rf"\r\n|[{LINE_END_CHARS}]"

# --- Text patterns ----------------------------------------------------------
TAG = r"<[^>]+>"
# What html.unescape takes for an entity.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# "$-_" and "a-z" are ranges; together with "!" they are every character a URL run takes.
URL = r"https?://[!$-_a-z]+"
EMAIL = rf"(?U)(?<![^{WS}])[^{WS}][^{WS}@]*+@[^{WS}]+\.[^{WS}]+"
PHONE = rf"(?U)((\+?\p{{Nd}}{{1,3}}[-.{WS}]?)?(\(?\p{{Nd}}{{3}}\)?[-.{WS}]?)?\p{{Nd}}{{3}}[-.{WS}]?\p{{Nd}}{{4}})"
PHONE_GATE = r"\p{Nd}{4}"
EMOJI = r"[\x{10000}-\x{10FFFF}]+"
NOT_BASIC = rf"(?U)[^a-zA-Z0-9{WS}.,!?;:\-'\"]+"
NOT_ALNUM = rf"(?U)[^a-zA-Z0-9{WS}]+"
CASED_RUN = r"([\p{IsLowercase}\p{IsUppercase}\p{Lt}]+|[^\p{IsLowercase}\p{IsUppercase}\p{Lt}]+)"

# --- Labels of the cleaning report, in the order the steps run ---------------
TEXT_STEP_LABELS = {
    "strip_html": "✓ Stripped HTML tags",
    "remove_urls": "✓ Removed URLs",
    "remove_emails": "✓ Removed Email addresses",
    "remove_phone": "✓ Removed Phone numbers",
    "remove_emojis": "✓ Removed Emojis",
    "remove_special_chars": "✓ Removed special characters",
    "remove_non_utf8": "✓ Removed non-UTF-8 characters",
    "replace_whitespace": "✓ Replaced non-breaking spaces",
    "replace_escape": "✓ Replaced escape characters",
    "normalize_case": "✓ Normalized case to {mode}",
    "remove_spaces": "✓ Removed extra spaces",
    "remove_linebreaks": "✓ Removed excessive line breaks",
}

TABLE_STEP_LABELS = {
    "headers": "✓ Stripped whitespace from column headers",
    "cells": "✓ Stripped whitespace from {n} string column(s)",
    "dates": "✓ Converted {n} column(s) to datetime: {columns} (DayFirst={day_first})",
    "lowercase": "✓ Converted text to lowercase in {n} column(s)",
    "duplicates": "✓ Removed {n} duplicate row(s)",
    "no_duplicates": "✓ No duplicate rows found",
    "duplicates_uncounted": "✓ Removed duplicate rows",
    "outliers": "✓ Removed {n} outlier(s) using {method}",
    "no_outliers": "✓ No outliers found using {method}",
    "outliers_uncounted": "✓ Removed outliers using {method}",
}

# --- Tables -----------------------------------------------------------------
# Cells read as null (the default list of pandas.read_csv).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BOOL_TOKENS = ("True", "TRUE", "true", "False", "FALSE", "false")
DATE_SHARE = 0.5
Z_LIMIT = 3.0
IQR_REACH = 1.5
TOP_CATEGORIES = 10
HISTOGRAM_BINS = 30
PREVIEW_ROWS = 10
PREVIEW_CHARS = 1000

# Date layouts. Those of numbers are made from an order, a separator and a time; these are
# the others. The preferred day order comes before month names, the other order after, because
# a first value such as 13/02/2024 can only be read one way. Day first holds for year-first
# dates as well (2024-01-05 is then the first of May), unless values are read one by one.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
PLAIN_LAYOUTS = ("yyyyMMdd", "yyyyMMdd'T'HHmmss", "yyyyMMdd HHmmss", "yyyy-MM", "yyyy")
MONTH_NAME_LAYOUTS = (
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy",
    "d-MMM-yyyy", "ddMMMyyyy",
)
WEEKDAY_LAYOUTS = (
    "EEEE, MMMM d, yyyy", "EEE MMM d yyyy", "EEE, d MMM yyyy", "EEE, d MMM yyyy H:m:s", "EEE, d MMM yyyy H:m:s 'GMT'",
)
# A column takes its layout from a clock time with hours and minutes; seconds are read one by one.
CLOCK_TIMES = (" h:m a", " h:ma", " h a")
CLOCK_SECONDS = (" h:m:s a", " h:m:sa")
MONTH_YEAR_LAYOUTS = (
    "MMM yyyy", "MMMM yyyy", "yyyy MMM", "yyyy MMMM", "MMM-yyyy", "yyyy-MMM", "M/yyyy", "M-yyyy", "yyyy/M",
)

# --- Pixels -----------------------------------------------------------------
GRAY_WEIGHTS = (0.299, 0.587, 0.114)
BLUR_LIMIT = 100.0
CHANNEL_NAMES = ("Red", "Green", "Blue")
SSIM_WINDOW = 7
SSIM_K1, SSIM_K2, PIXEL_RANGE = 0.01, 0.03, 255.0
SMALL_WIDTH, UPSCALE = 500, 1.5
MAX_WIDTH, MAX_HEIGHT = 1024, 1024

# --- Frames -----------------------------------------------------------------
VIDEO_PRESETS = {"720p HD": (1280, 720), "1080p Full HD": (1920, 1080), "480p SD": (854, 480)}
DEFAULT_FPS, GIF_FPS, GIF_WIDTH, PREVIEW_SECONDS = 30.0, 15, 480, 5.0

# --- Signals ----------------------------------------------------------------
TARGET_DBFS = -20.0
FIXED_SILENCE_DB, SILENCE_CEILING_DB, SILENCE_FLOOR_DB = -40.0, -15.0, -50.0
SILENCE_MARGIN_DB, STRICT_MARGIN_DB = 10.0, 6.0
TRIM_STEP_MS, GAP_STEP_MS, MIN_GAP_MS, KEEP_MS = 5, 10, 500, 250
WAVEFORM_POINTS = 10_000
SIGNAL_STEPS = {
    "gain": "Normalized to -20dB", "mono": "Converted to Mono", "threshold": "Auto-Threshold: %.1fdB",
    "trim": "Trimmed Silence", "gaps": "Removed internal gaps", "format": "Format: %dHz, %d-bit",
}

# --- Files ------------------------------------------------------------------
# Files that the line scan would unpack.
PACKED_SUFFIXES = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff")
AUDIO_SUFFIXES = (".wav", ".mp3", ".m4a", ".flac", ".ogg")
VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv")
# suffix -> (byte offset, leading bytes as hex), public file signatures
MAGIC = {
    ".jpg": ((0, "FFD8FF"),), ".jpeg": ((0, "FFD8FF"),), ".png": ((0, "89504E470D0A1A0A"),),
    ".bmp": ((0, "424D"),), ".webp": ((8, "57454250"),),
    ".tiff": ((0, "49492A00"), (0, "4D4D002A")),
    ".wav": ((8, "57415645"),), ".flac": ((0, "664C6143"),), ".ogg": ((0, "4F676753"),),
    ".mp3": ((0, "494433"), (0, "FFFB"), (0, "FFF3"), (0, "FFF2")), ".m4a": ((4, "66747970"),),
    ".mp4": ((4, "66747970"),), ".mov": ((4, "66747970"), (4, "6D6F6F76")),
    ".avi": ((8, "41564920"),), ".mkv": ((0, "1A45DFA3"),),
}
