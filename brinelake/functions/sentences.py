"""Column functions on sentence text.  All are JVM-side built-ins, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space at the ends of lines and fields.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"

# Spellings of whole numbers and of decimal numbers.
INT_PATTERN = r"^[+-]?\d+(?:_\d+)*$"
NUM_PATTERN = (r"^(?:[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)"
               r"(?:[eE][+-]?\d+(?:_\d+)*)?|[+-]?(?i:inf|infinity)|(?i:nan))$")

# Calendar dates and clock times as six digits.  Every fourth year is a leap
# year over the whole range two digits can mean.
_MONTH_DAY = (r"(?:(?:0[13578]|1[02])(?:0[1-9]|[12]\d|3[01])"
              r"|(?:0[469]|11)(?:0[1-9]|[12]\d|30)|02(?:0[1-9]|1\d|2[0-8]))")
_LEAP = r"(?:[02468][048]|[13579][26])"
DATE_M_PATTERN = rf"^(?:{_MONTH_DAY}\d\d|0229{_LEAP})$"
DATE_Y_PATTERN = rf"^(?:\d\d{_MONTH_DAY}|{_LEAP}0229)$"
TIME_PATTERN = r"^(?:[01]\d|2[0-3])[0-5]\d[0-5]\d$"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col_of(c), F.lit(BLANKS))


def one_char_per_byte(c: Column | str) -> Column:
    """Text whose characters are the bytes of the line (bytes survive the text reader)."""
    return F.decode(col_of(c).cast("binary"), "ISO-8859-1")


def is_binary(text: Column | str, scan: int = 1024) -> Column:
    """Over a tenth of the first ``scan`` bytes lies outside printable ASCII, CR and LF.

    ``text`` has one character per byte.  The cheap search comes first: a clean line never
    pays for the count.
    """
    head = F.substring(col_of(text), 1, scan)
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[^\x20-\x7E\r\n]+", ""))
    return F.when(~head.rlike(r"[^\x20-\x7E\r\n]"), F.lit(False)).otherwise(
        odd > F.floor(F.length(head) / 10))


def has_non_ascii(text: Column | str) -> Column:
    """P2."""
    return col_of(text).rlike(r"[^\x00-\x7F]")


def readable(text: Column | str) -> Column:
    """Line as stored in the logs: each undecodable byte becomes the replacement character."""
    return F.regexp_replace(col_of(text), r"[^\x00-\x7F]", "�")


def is_sentence(sentence: Column | str) -> Column:
    s = col_of(sentence)
    return s.startswith("$") & s.contains(",")


def prefix(sentence: Column | str) -> Column:
    """Upper-cased text between ``$`` and the first comma; NULL where either is missing."""
    s = strip(sentence)
    head = F.substring_index(s, ",", 1)
    return F.when(is_sentence(s), F.upper(head.substr(F.lit(2), F.length(head))))


def given_checksum(sentence: Column | str) -> Column:
    """Upper-cased text after the last ``*``; NULL where there is none."""
    s = col_of(sentence)
    return F.when(s.contains("*"), F.upper(strip(F.substring_index(s, "*", -1))))


def body(sentence: Column | str) -> Column:
    """Text before the last ``*``."""
    s = col_of(sentence)
    tail = F.substring_index(s, "*", -1)
    return F.when(s.contains("*"), s.substr(F.lit(1), F.length(s) - F.length(tail) - 1)).otherwise(s)


def split_fields(sentence: Column | str) -> Column:
    """P5: trimmed fields, the first still with its ``$``."""
    return F.transform(F.split(body(strip(sentence)), ","), strip)


def checksum(sentence: Column | str) -> Column:
    """Exclusive or of the characters after ``$`` up to the first ``*``, in hex."""
    s = F.substring_index(col_of(sentence), "*", 1)
    s = F.when(s.startswith("$"), s.substr(F.lit(2), F.length(s))).otherwise(s)
    # Splitting on nothing gives single characters, and an empty tail that counts as 0.
    value = F.hex(F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: acc.bitwiseXOR(F.ascii(c))))
    return F.lpad(value, F.greatest(F.length(value), F.lit(2)), F.lit("0"))


def checksum_valid(sentence: Column | str) -> Column:
    """NULL where the sentence carries no checksum."""
    return F.when(col_of(sentence).contains("*"), checksum(sentence) == given_checksum(sentence))


def message_type(line: Column | str) -> Column:
    """P25: text between the first character and the first comma."""
    s = col_of(line)
    return F.substring(s, F.lit(2), F.instr(s, ",") - 2)


def number(text: Column | str) -> Column:
    """Decimal number or NULL, with the spellings of ``NUM_PATTERN`` only."""
    v = col_of(text)
    return F.when(v.rlike(NUM_PATTERN), F.replace(v, F.lit("_"), F.lit("")).try_cast("double"))


def whole_number(text: Column | str) -> Column:
    v = col_of(text)
    return F.when(v.rlike(INT_PATTERN), F.replace(v, F.lit("_"), F.lit("")).try_cast("double"))


def optional_number(text: Column | str, markers: tuple[str, ...], le_minus_9: bool = False) -> Column:
    """NULL for empty fields, markers of missing data and unreadable text."""
    v = col_of(text)
    n = F.when(~v.isin("", *markers), number(v))
    return F.when(n > -9, n) if le_minus_9 else n


def measurement_id(date: Column | str, time: Column | str) -> Column:
    """Date and time digits as one integer."""
    d, t = col_of(date), col_of(time)
    return F.when((F.length(d) == 6) & (F.length(t) == 6), F.concat(d, t).try_cast("bigint"))


def measured_at(date: Column | str, time: Column | str, year_first: bool = False) -> Column:
    """One timestamp for both date conventions, NULL where the digits are no date."""
    d, t = col_of(date), col_of(time)
    year, month, day = (1, 3, 5) if year_first else (5, 1, 3)
    text = F.concat(F.lit("20"), F.substring(d, year, 2), F.lit("-"), F.substring(d, month, 2),
                    F.lit("-"), F.substring(d, day, 2), F.lit(" "), F.substring(t, 1, 2), F.lit(":"),
                    F.substring(t, 3, 2), F.lit(":"), F.substring(t, 5, 2))
    return F.when((F.length(d) == 6) & (F.length(t) == 6), text.try_cast("timestamp_ntz"))


def config_sentence(kind: str, with_checksum: bool = True) -> Column:
    """Configuration columns written back as a PNORI, PNORI1 or PNORI2 sentence."""
    two = lambda name: F.format_string("%.2f", F.col(name).cast("double"))
    text = lambda name: F.col(name).cast("string")
    values = [text("instrument_type_code"), text("head_id"), text("beam_count"),
              text("cell_count"), two("blanking_distance"), two("cell_size"),
              text("coord_system_code" if kind == "PNORI" else "coord_system_name")]
    if kind == "PNORI2":
        tags = ("IT", "SN", "NB", "NC", "BD", "CS", "CY")
        values = [F.concat(F.lit(f"{t}="), v) for t, v in zip(tags, values, strict=True)]
    line = F.concat_ws(",", F.lit(f"${kind}"), *values)
    return F.concat(line, F.lit("*"), checksum(line)) if with_checksum else line
