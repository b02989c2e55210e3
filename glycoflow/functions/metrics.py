"""Glucose metrics as column expressions: the same definition serves windows, days, pumps and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def bg_column() -> Column:
    return F.col("bg_mgdl").cast("double")


def valid_bg(bg: Column | None = None) -> Column:
    bg = bg_column() if bg is None else bg
    return F.nanvl(bg, F.lit(None))


def percent(condition: Column, bg: Column | None = None, empty: float | None = 0.0) -> Column:
    """Percentage of valid readings that fulfil a condition; `empty` where there are none."""
    bg = bg_column() if bg is None else bg
    share = F.try_divide(100.0 * F.count_if(condition), F.count(bg))
    return share if empty is None else F.coalesce(share, F.lit(empty))


def time_in_bands(bg: Column | None = None) -> dict[str, Column]:
    bg = bg_column() if bg is None else bg
    return {
        "tbr_level2": percent(bg < 54, bg),
        "tbr_level1": percent((bg >= 54) & (bg < 70), bg),
        "tir": percent((bg >= 70) & (bg <= 180), bg),
        "tar_level1": percent((bg > 180) & (bg <= 250), bg),
        "tar_level2": percent(bg > 250, bg),
        "tbr_total": percent(bg < 70, bg),
        "tar_total": percent(bg > 180, bg),
        "titr": percent((bg >= 70) & (bg <= 140), bg),
    }


def time_in_range(bg: Column, low: float, high: float, empty: float | None = 0.0) -> Column:
    return percent((bg >= low) & (bg <= high), bg, empty)


def cv_percent(mean: Column, sd: Column) -> Column:
    return 100 * F.try_divide(sd, F.nullif(mean, F.lit(0.0)))


def gmi(mean: Column) -> Column:
    return 3.31 + 0.02392 * mean


def ea1c(mean: Column) -> Column:
    return (mean + 46.7) / 28.7


def risk(bg: Column | None = None) -> Column:
    bg = bg_column() if bg is None else bg
    g = F.least(F.greatest(bg, F.lit(20.0)), F.lit(600.0))
    return 1.509 * (F.pow(F.ln(g), F.lit(1.084)) - 5.381)


def lbgi(bg: Column | None = None) -> Column:
    bg = bg_column() if bg is None else bg
    f = risk(bg)
    return F.coalesce(F.avg(F.when(f < 0, 10 * f * f).otherwise(F.when(bg.isNotNull(), 0.0))), F.lit(0.0))


def hbgi(bg: Column | None = None) -> Column:
    bg = bg_column() if bg is None else bg
    f = risk(bg)
    return F.coalesce(F.avg(F.when(f > 0, 10 * f * f).otherwise(F.when(bg.isNotNull(), 0.0))), F.lit(0.0))


def gri_hypo(tbr2: Column, tbr1: Column) -> Column:
    return tbr2 + 0.8 * tbr1


def gri_hyper(tar1: Column, tar2: Column) -> Column:
    return tar2 + 0.5 * tar1


def gri(tbr2: Column, tbr1: Column, tar1: Column, tar2: Column) -> Column:
    """Both components weighted and cut to 0 to 100; the components themselves aren't cut."""
    raw = 3.0 * gri_hypo(tbr2, tbr1) + 1.6 * gri_hyper(tar1, tar2)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))


def j_index(mean: Column, sd: Column) -> Column:
    return 0.001 * (mean + sd) * (mean + sd)


def bg_class(bg: Column | None = None) -> Column:
    bg = bg_column() if bg is None else bg
    return F.when(bg < 70, "low").when(bg <= 180, "in_range").when(bg <= 250, "high").when(bg > 250, "very_high")


def freshness(age_minutes: Column, fresh: float, stale: float) -> Column:
    return F.when(age_minutes.isNull(), "unknown").when(age_minutes <= fresh, "fresh").when(age_minutes <= stale, "stale").otherwise("down")


def age_label(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "never").when(minutes < 90, F.concat(F.bround(minutes).cast("int").cast("string"), F.lit(" min ago"))).when(minutes < 48 * 60, F.concat(F.bround(minutes / 60).cast("int").cast("string"), F.lit(" h ago"))).otherwise(F.concat(F.bround(minutes / 1440).cast("int").cast("string"), F.lit(" d ago")))
