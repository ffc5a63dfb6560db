"""Fields mined from free-text experiment logs. Built-in regex functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from axonframe.functions.scalar import ColumnLike, col

# The log grammar.
STIM_DESCRIPTOR = r"\b[A-Z]_\d+ A (\d+\.?\d*%?|\d*\.?\d+%?) \d+\.?\d* ms\b"
STIM_PERCENT = r"(R|B)_(\d+\.?\d*) A (\d+)% (\d+\.?\d*) ms"
STIM_PLAIN = r"(R|B)_\d+ A (\d+\.?\d*) (\d+\.?\d*) ms"
INTERVAL = r"IT_(\d+) ms"
RESTING_POTENTIAL = r"RMP\s(-?\d+)\smV"
PTX = r"(?i)PTX"
FOUR_AP = r"(?i)4\s*-?\s*AP"
RECORDING_FILE = r"([\w\-]+\.abf)"
CELL_HEADING = r"^(## Cell\d+|## PVneuron-\d+)"
SLICE_HEADING = r"^(# Slice\d+)"


def extract(c: ColumnLike, pattern: str, group: int = 0) -> Column:
    """First match or capture group; NULL (not '') when there is none."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def left(c: ColumnLike, n: int) -> Column:
    return F.substring(col(c), 1, n)


def right(c: ColumnLike, n: int) -> Column:
    return F.right(col(c), F.lit(n))


def stim_descriptors(log: ColumnLike) -> Column:
    """All stimulus descriptors of a log entry, in order."""
    return F.regexp_extract_all(col(log), F.lit(STIM_DESCRIPTOR), F.lit(0))


def nth(array: Column, k: int) -> Column:
    """k-th element, counted from 1; NULL out of range."""
    return F.get(array, F.lit(k - 1))


def concentration(log: ColumnLike, drug_pattern: str) -> Column:
    """Number and unit written after a drug name, as struct(value, unit); the two units are kept apart."""
    pattern = drug_pattern + r"\s+([0-9]+(?:\.[0-9]+)?)\s*(uM|mM)"
    return F.struct(
        extract(log, pattern, 1).try_cast("double").alias("value"),
        extract(log, pattern, 2).alias("unit"),
    )


def _last_of_colour(log: Column, pattern: str, colour: str) -> Column:
    found = F.regexp_extract_all(log, F.lit(pattern), F.lit(0))
    return F.try_element_at(F.filter(found, lambda m: m.startswith(colour + "_")), F.lit(-1))


def _stimulus(log: ColumnLike, pattern: str, power: int, duration: int) -> Column:
    fields = []
    for colour, prefix in (("R", "r"), ("B", "b")):
        last = _last_of_colour(col(log), pattern, colour)
        fields += [
            F.regexp_extract(last, pattern, power).alias(f"{prefix}_power"),
            F.regexp_extract(last, pattern, duration).alias(f"{prefix}_duration"),
        ]
    return F.struct(*fields)


def stimulus_percent(log: ColumnLike) -> Column:
    """Power (in percent) and duration of the last R and the last B stimulus."""
    return _stimulus(log, STIM_PERCENT, 3, 4)


def stimulus_plain(log: ColumnLike) -> Column:
    """As :func:`stimulus_percent`, for power written without a percent sign."""
    return _stimulus(log, STIM_PLAIN, 2, 3)


def colour_order(log: ColumnLike) -> Column:
    """Which of ``B_`` and ``R_`` comes first: 'B', 'R' or 'None'."""
    b, r = F.instr(col(log), "B_"), F.instr(col(log), "R_")
    return (
        F.when((b == 0) & (r == 0), "None")
        .when(b == 0, "R")
        .when(r == 0, "B")
        .when(b < r, "B")
        .otherwise("R")
    )


def interval_ms(log: ColumnLike) -> Column:
    return extract(log, INTERVAL, 1).try_cast("int")


def substances(log: ColumnLike) -> Column:
    """Substance names present, joined by ', '; 'None' if there are none."""
    tags = [F.when(col(log).contains(t), F.lit(t)) for t in ("PTX", "NBQX", "AP-V")]
    joined = F.concat_ws(", ", *tags)
    return F.when(col(log).isNull(), F.lit(None)).when(joined == "", "None").otherwise(joined)


def resting_potential(log: ColumnLike, *ids: str) -> Column:
    """struct(ids..., rmp_mv); every field is NULL when the log has no resting potential."""
    value = extract(log, RESTING_POTENTIAL, 1)
    return F.struct(
        *[F.when(value.isNotNull(), F.col(i)).alias(i) for i in ids],
        value.try_cast("int").alias("rmp_mv"),
    )


def contains_or_false(c: ColumnLike, pattern: str) -> Column:
    """Regex test in which a missing value counts as no match."""
    return F.coalesce(col(c).rlike(pattern), F.lit(False))
