"""Scalar text functions as Column expressions; \\s, \\d and \\w are Unicode where noted with (?U)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Typographic ligatures and what they stand for, and checkbox glyphs.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
CHECKED, UNCHECKED = "☑☒✓✔✗✘", "☐□"
RTL = r"\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"
#: Seconds to wait before each further attempt.
RETRY_LADDER = (5, 300, 1800, 7200, 18000, 36000, 36000)


def without_ligatures(x: Column) -> Column:
    for sign, letters in LIGATURES.items():
        x = F.replace(x, F.lit(sign), F.lit(letters))
    return x


def flat(x: Column) -> Column:
    """White space collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def alphanumerics(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\D", "")


def lines_trimmed(x: Column) -> Column:
    """Horizontal white space of each line collapsed and trimmed; three line ends or more become two."""
    lines = F.transform(F.split(x, "\n"), lambda y: F.trim(F.regexp_replace(y, r"[ \t\x{A0}]+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")


def replacement_share(x: Column) -> Column:
    """The share of U+FFFD; 1 for an empty text."""
    return F.when(F.length(x) == 0, 1.0).otherwise((F.length(x) - F.length(F.translate(x, "�", ""))) / F.length(x))


def substance(x: Column) -> Column:
    """How many letters and digits there are."""
    return F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def right_to_left_share(x: Column) -> Column:
    """Right-to-left letters among letters; 0 without letters."""
    n = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    return F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}]", ""), f"[^{RTL}]", "")) / n)


def low_quality_script(x: Column) -> Column:
    return (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 20) & (right_to_left_share(x) >= 0.3)


def currency_cents(x: Column) -> Column:
    """Cents of a currency token, else null: $, grouped or plain digits, two decimals; in a pair of parentheses negative."""
    amount = r"\$?((0|[1-9][0-9]*)|[1-9][0-9]{0,2}(,[0-9]{3})+)\.[0-9]{2}"
    value = F.regexp_replace(x, "[^0-9]", "").cast("bigint")
    return F.when(x.rlike(f"^{amount}$"), value).when(x.rlike(rf"^\({amount}\)$"), -value)


def checkbox_text(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, f"[{CHECKED}]", "[x]"), f"[{UNCHECKED}]", "[ ]")


def redacted_url(x: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(x, "[?#].*$", "")


def redacted_message(message: Column, url: Column) -> Column:
    return F.replace(message, url, redacted_url(url))


def kind_from_name(x: Column) -> Column:
    """Document kind by the extension of a name or URL path."""
    path = F.lower(F.regexp_replace(x, "[?#].*$", ""))
    return (
        F.when(path.rlike(r"\.pdf$"), "pdf").when(path.rlike(r"\.(pptx|ppsx)$"), "pptx").when(path.rlike(r"\.(docx|doc)$"), "docx")
        .when(path.rlike(r"\.(png|jpg|jpeg|jpe|webp|tif|tiff|heic|heif|bmp)$"), "image")
    )


def html_escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def pipe_cells(line: Column) -> Column:
    """Cells of a pipe row, split at unescaped pipes, outer empty ones dropped, trimmed and unescaped."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def is_delimiter_row(line: Column) -> Column:
    return F.forall(pipe_cells(line), lambda c: c.rlike("^:?-+:?$"))


def longest_id(x: Column) -> Column:
    """The longest run of letters and digits that has a digit; of equal ones the first."""
    runs = F.filter(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), 0), lambda t: t.rlike("[0-9]"))
    return F.aggregate(runs, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best), lambda best: F.when(best != "", best))


def date_digit_forms(x: Column) -> Column:
    """Digits of yyyy-mm-dd[ hh:mm], with a short year, and month first."""
    y, m, d = (F.substring(x, a, n) for a, n in ((1, 4), (6, 2), (9, 2)))
    return F.array(F.concat(y, m, d), F.concat(F.substring(x, 3, 2), m, d), F.concat(m, d, y), F.concat(m, d, F.substring(x, 3, 2)))


def date_key(x: Column) -> Column:
    """The integers of a date, sorted."""
    return F.array_sort(F.transform(F.regexp_extract_all(x, F.lit("[0-9]+"), 0), lambda t: t.cast("int")))


def is_subsequence(needle: Column, hay: Column) -> Column:
    at = F.aggregate(F.split(hay, ""), F.lit(1), lambda i, c: F.when((i <= F.length(needle)) & (c == F.substring(needle, i, F.lit(1))), i + 1).otherwise(i))
    return at > F.length(needle)


def canonical_number(x: Column) -> Column:
    """A number's shortest text: no trailing zeros, no bare point."""
    return F.regexp_replace(F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def char_width(c: Column) -> Column:
    """Relative width of a character: narrow, wide, capital or digit, other."""
    return F.when(c.rlike(r"^[ .,:;'|!ilIjt]$"), 0.5).when(c.rlike("^[mwMW@%]$"), 1.1).when(c.rlike("^[A-Z0-9]$"), 1.0).otherwise(0.6)


#: The same by code point, up to 128, which stands for all others.
_WIDTHS = np.array([0.5 if chr(c) in " .,:;'|!ilIjt" else 1.1 if chr(c) in "mwMW@%" else 1.0 if re.match("[A-Z0-9]", chr(c)) else 0.6 for c in range(129)])


@F.arrow_udf(DoubleType())
def _text_width(texts: pa.Array) -> pa.Array:
    # a running sum adds from the left, as a database does; other orders give other last digits of long texts
    widths = lambda t: np.cumsum(_WIDTHS[np.minimum(np.frombuffer(t.encode("utf-32-le"), np.uint32), 128)])[-1] if t else 0.0
    return pa.array([None if t is None else float(widths(t)) for t in texts.to_pylist()], pa.float64())


def text_width(x: Column) -> Column:
    """The sum of the relative widths of a text's characters, added from left to right."""
    return _text_width(x)


def cursor(at: Column, key: Column) -> Column:
    """A URL-safe keyset cursor without padding."""
    return F.regexp_replace(F.translate(F.base64(F.concat_ws("|", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), key.cast("string")).cast("binary")), "+/", "-_"), "=+$", "")


def cursor_parts(x: Column) -> Column:
    padded = F.rpad(F.translate(x, "-_", "+/"), (F.ceil(F.length(x) / 4) * 4).cast("int"), F.lit("="))
    return F.split(F.unbase64(padded).cast("string"), r"\|")


def retry_delay(attempts: Column) -> Column:
    """Seconds before the next attempt, null when there is none left."""
    return F.when(attempts.between(1, len(RETRY_LADDER)), F.get(F.array(*(F.lit(x) for x in RETRY_LADDER)), attempts - 1))


def webhook_url_error(x: Column) -> Column:
    """Why a URL can't be a target, null if it can."""
    host = F.lower(F.regexp_extract(x, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return (
        F.when(~F.coalesce(x.rlike("^https://"), F.lit(False)), "url must use https").when(x.rlike(r"^https://[^/?#]*@"), "url must not contain credentials").when(host == "", "url must have a hostname")
        .when(host.rlike(r"^[0-9.]+$|^\["), "url must not be an ip address").when((host == "localhost") | host.endswith(".localhost"), "url must not be localhost")
    )
