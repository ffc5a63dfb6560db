"""Cell-level E/I balance: clean, pair, derive, pick one row per cell, summarise, model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.scalar import paste, ratio, safe_log
from axonframe.operators import models, pick, summarise

# Amplitude bands (pA) and their targets.
SMALL_BAND, SMALL_TARGET = (-50.0, -10.0), -40.0
LARGE_BAND = (-120.0, -70.0)


def paired_recordings(raw: DataFrame, ordinal: list[str], color: str | None = "blue") -> DataFrame:
    """One row per recording pair, of one stimulus colour."""
    kept = raw.filter(F.col("color") == color) if color else raw
    return pick.pair_dedup(kept, "filename_plus10", "filename_minus55", ordinal)


def ei_balance(pairs: DataFrame) -> DataFrame:
    """Rows with both amplitudes: balance, its log and the cell key."""
    balance = ratio("amp_plus10", -F.col("amp_minus55"))
    return pairs.dropna(subset=["amp_minus55", "amp_plus10"]).withColumns(
        {"ei_balance": balance, "log_ei_balance": safe_log(balance), "cell_key": paste("brain_id", "slice_id", "cell_id")}
    )


def in_band(df: DataFrame, band: tuple[float, float]) -> DataFrame:
    """Open amplitude band, with a known position."""
    low, high = band
    return df.filter((F.col("amp_minus55") > low) & (F.col("amp_minus55") < high) & F.col("rough_ap").isNotNull())


def small_response_cells(balance: DataFrame, ordinal: list[str]) -> DataFrame:
    """Per cell the first row nearest to -40 pA."""
    return pick.nearest(in_band(balance, SMALL_BAND), ["cell_key"], "amp_minus55", SMALL_TARGET, ordinal)


def large_response_cells(balance: DataFrame) -> DataFrame:
    """Per cell the row(s) with the largest inward current."""
    return pick.slice_min(in_band(balance, LARGE_BAND), ["cell_key"], "amp_minus55")


def region_summary(raw: DataFrame, ordinal: list[str]) -> DataFrame:
    """Mean, SEM and count of the balance per region over the large-response cells."""
    cells = large_response_cells(ei_balance(paired_recordings(raw, ordinal)))
    return summarise.mean_table(cells, ["region"], "ei_balance")


def region_model(cells: DataFrame, with_position: bool = True, levels: tuple[str, ...] = ("ACC", "RSC")) -> models.GammaFit:
    return models.gamma_glm(cells, "ei_balance", {"region": list(levels)}, ["rough_ap"] if with_position else [])
