"""The flagship regime pipeline (entry 1 of the reference, on the hourly
sensor frame): hourly medians -> time interpolation -> drop leading gaps
-> standardise -> k-means(4) -> per-regime profile."""

from __future__ import annotations

from sinter.operators import cluster as CL, filters as FL, profile as PR, sequence as SQ
from sinter.plans import fixtures as FX
from sinter.plans.catalog import register


def regime_pipeline(spark, sf_dir, k: int = 4):
    h = FX.hourly_sensors(spark, sf_dir)
    h = SQ.interpolate_time(h, "ts", ["ts"], FX.SENSORS)
    h = FL.drop_any_null(h)
    _, labelled = CL.kmeans(h, FX.SENSORS, k=k)
    return PR.profile(labelled, by="cluster", cols=FX.SENSORS)


@register("flagship_regimes", covers=("W4", "F1", "M1", "K1", "A1"))
def flagship_regimes(spark, sf_dir):
    return regime_pipeline(spark, sf_dir)
