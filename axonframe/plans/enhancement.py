"""Enhancement index of paired stimuli: one operator for the six analysis variants, and its summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions import textparse as tp
from axonframe.functions.scalar import paste, ratio
from axonframe.operators import hypothesis, models, pair, reshape, summarise


@dataclass(frozen=True)
class Variant:
    hold: str | None = None  # text the log must contain
    exclude: tuple[str, ...] = ()  # drugs whose rows are dropped
    stim1_prefix: str | None = None  # regex the first descriptor must match
    keys: tuple[str, ...] = ("cell_id", "ptx", "interval")
    means: tuple[str, ...] = ("actual_peak", "estimated_peak")


_FULL = ("cell_id", "ptx", "interval", "stim1", "stim2")
_ALL_PEAKS = ("actual_peak", "estimated_peak", "first_peak", "third_peak")

# Filters and cell-level keys of each analysis.
VARIANTS = {
    "normal": Variant("-75 mV", ("ptx", "ap4"), None, ("ptx", "interval", "cell_id")),
    "ptx": Variant("-75 mV", (), None, (*_FULL, "ptx_conc")),
    "4ap": Variant("-75 mV", (), None, (*_FULL, "ptx_conc", "ap4", "ap4_conc")),
    "cs_vs_k": Variant(None, (), "^R_1", (*_FULL, "intra"), _ALL_PEAKS),
    "vhold": Variant(None, (), "^R_1", (*_FULL, "vhold"), _ALL_PEAKS),
    "vhold_and_cs_vs_k": Variant(None, ("ptx", "ap4"), "^R_1", (*_FULL, "vhold"), _ALL_PEAKS),
}
DRUGS = {"ptx": tp.PTX, "ap4": tp.FOUR_AP}


def parse_log(sweeps: DataFrame) -> DataFrame:
    """Drug flags and concentrations, stimulus descriptors and (if the ids are there) the cell key."""
    found = tp.stim_descriptors("log")
    cols = {name: F.col("log").rlike(pattern) for name, pattern in DRUGS.items()}
    cols |= {f"{name}_conc": tp.concentration("log", pattern).getField("value") for name, pattern in DRUGS.items()}
    cols |= {"stim1": tp.nth(found, 1), "stim2": tp.nth(found, 2)}
    if {"filename", "slice_id"} <= set(sweeps.columns):
        cols["cell_id"] = paste(tp.left("filename", 5), tp.right("slice_id", 1), tp.right("cell_id", 1))
    return sweeps.withColumns(cols)


def enhancement_index(sweeps: DataFrame, variant: Variant | str) -> DataFrame:
    """Cell-level means of the peaks and actual / estimated.

    ``sweeps`` has log, interval, the peak columns, cell_id (or filename, slice_id, cell_id) and any
    condition columns the variant groups by.
    """
    v = VARIANTS[variant] if isinstance(variant, str) else variant
    d = parse_log(sweeps).filter((F.col("interval") > 0) & F.col("stim1").isNotNull() & F.col("stim2").isNotNull())
    if v.hold:
        d = d.filter(F.col("log").contains(v.hold))
    for drug in v.exclude:
        d = d.filter(~F.col(drug))
    if v.stim1_prefix:
        d = d.filter(F.col("stim1").rlike(v.stim1_prefix))
    missing = [c for c in (*v.keys, *v.means) if c not in d.columns]
    if missing:
        raise ValueError(f"the variant needs the columns {missing}")
    cells = summarise.group_means(d, list(v.keys), list(v.means))
    return cells.withColumn("enhancement_index", ratio("actual_peak", "estimated_peak"))


def condition_tables(cells: DataFrame, condition: str, values: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """One table for all measures: mean, SEM, counts and 95 % half-width by interval and condition.

    ``labels`` renames conditions. The measures are stacked first, so the cells are read and grouped once.
    """
    from axonframe.functions.scalar import recode

    shown = recode(condition, labels) if labels else F.col(condition)
    long = reshape.pivot_longer(cells.select("interval", shown.alias("condition"), *values), ["interval", "condition"], values, "measure", "value")
    return summarise.mean_table(long, ["measure", "interval", "condition"], "value", ci=True)


def joined_conditions(cells: DataFrame, first: str, second: str) -> DataFrame:
    """Cells with ``condition``, both labels joined by a blank."""
    return cells.withColumn("condition", F.concat_ws(" ", first, second))


def drug_pairs(cells: DataFrame, drug: str, low: float, high: float) -> DataFrame:
    """Same cell, interval and stimuli without and with the drug at a concentration in [low, high]."""
    keys = ["cell_id", "interval", "stim1", "stim2"]
    treated = F.col(drug) & F.col(f"{drug}_conc").between(low, high)
    return pair.pair_join(cells, ~F.col(drug), treated, keys, ["enhancement_index"], ("_acsf", "_drug")).dropna(
        subset=["enhancement_index_acsf", "enhancement_index_drug"]
    )


def paired_t(pairs: DataFrame) -> DataFrame:
    return hypothesis.t_test_paired(pairs, ["interval"], "enhancement_index_acsf", "enhancement_index_drug")


def paired_long(pairs: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One row per cell and condition, with display labels."""
    from axonframe.functions.scalar import recode

    values = ["enhancement_index_acsf", "enhancement_index_drug"]
    long = reshape.pivot_longer(pairs, ["cell_id", "interval", "stim1", "stim2"], values, "cond", "enh")
    return long.withColumn("cond", recode("cond", labels))


def interval_summary(cells: DataFrame, nonparametric: bool = False, mu: float = 1.0) -> DataFrame:
    """Per interval: mean, test against ``mu`` and effect size with intervals."""
    v = "enhancement_index"
    if nonparametric:
        test = hypothesis.signed_rank(cells, ["interval"], v, mu)
        ci = hypothesis.signed_rank_interval(cells, ["interval"], v)
        mean = cells.groupBy("interval").agg(F.avg(v).alias("mean"), F.count(v).alias("n_valid"))
        out = mean.join(test.select("interval", "p", "effect", "effect_low", "effect_high"), "interval", "left").join(ci, "interval", "left")
        return out.select("interval", "n_valid", "mean", "ci_low", "ci_high", "p", "effect", "effect_low", "effect_high")
    test = hypothesis.t_test_1samp(cells, ["interval"], v, mu)
    g = hypothesis.hedges_g(cells, ["interval"], v, mu)
    return test.join(g.select("interval", "g", "g_low", "g_high"), "interval").select(
        "interval", F.col("n").alias("n_valid"), "mean", "ci_low", "ci_high", "p",
        F.col("g").alias("effect"), F.col("g_low").alias("effect_low"), F.col("g_high").alias("effect_high"),
    )


def across_intervals(cells: DataFrame, levels: list) -> tuple[DataFrame, DataFrame]:
    """Interval effect by a mixed model with a random intercept per cell: (main effect, contrasts).

    Contrasts carry BH-adjusted p-values and paired d with its interval.
    """
    fit = models.mixed_model(cells, "enhancement_index", {"interval": levels}, [], "cell_id")
    pairs = hypothesis.benjamini_hochberg(fit.contrasts("interval", levels), [], "p", "p_adj")
    return fit.anova(), hypothesis.t_to_d(pairs, "t", "df")


def across_intervals_nonparametric(cells: DataFrame, levels: list) -> tuple[DataFrame, DataFrame]:
    """Friedman test with Kendall's W, and pairwise signed-rank tests, over the complete cells."""
    full = reshape.complete_cases(cells, ["cell_id"], "interval", "enhancement_index", levels).withColumn("family", F.lit("all"))
    main = hypothesis.friedman(full, ["family"], ["cell_id"], "interval", "enhancement_index", levels)
    return main, hypothesis.pairwise_signed_rank(full, ["family"], ["cell_id"], "interval", "enhancement_index", levels)
