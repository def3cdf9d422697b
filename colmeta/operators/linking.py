"""Join of observations to the sites they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linked(observations: DataFrame, sites: DataFrame, on: str, site_key: str, suffixes: tuple[str, str] = ("_obs", "_site")) -> DataFrame:
    """Every observation with its site's columns; null keys match null keys.

    Names that both have get the suffixes, but for a key of one name, which stays single. Keys of two names both stay.
    The optimizer picks the join; a site key that repeats repeats observations.
    """
    same = on == site_key
    clash = (set(observations.columns) & set(sites.columns)) - ({on} if same else set())
    left = observations.select(*(F.col(f"`{c}`").alias(c + suffixes[0] if c in clash else c) for c in observations.columns))
    right = sites.select(*(F.col(f"`{c}`").alias("__key" if same and c == on else c + suffixes[1] if c in clash else c) for c in sites.columns))
    a, b = on + suffixes[0] if on in clash else on, "__key" if same else site_key + suffixes[1] if site_key in clash else site_key
    out = left.join(right, left[a].eqNullSafe(right[b]), "left")
    return out.drop("__key")
