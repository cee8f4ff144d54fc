"""Designed experiments: pure error and lack of fit of a model in coded factors, and Lenth's test for designs without replicates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from .stats import _gram, design, factorial_effects


def model_terms(df: DataFrame, factors: list[str], interactions: bool) -> tuple[DataFrame, list[str]]:
    """Rows with a column a term: the factors, and their products in pairs."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]] if interactions else []
    out = df.withColumns({f"{a}:{b}": F.col(a) * F.col(b) for a, b in pairs}) if pairs else df
    return out, [*factors, *[f"{a}:{b}" for a, b in pairs]]


def lack_of_fit(df: DataFrame, factors: list[str], y: str, interactions: bool = True) -> DataFrame:
    """(rss, dof, ss_pure, dof_pure, ss_lack, dof_lack, f, p): the rest of the model split into the spread of replicates (rows of equal factors) and what the
    model misses.  f is null without replicates or without a cell more than terms.

    The cells of equal factors are one aggregation; the model's rest follows from their counts and means, which it fits as well as it fits the rows."""
    rows = design(df, y, factors)
    cells = rows.groupBy(*factors).agg(F.count("*").alias("_n"), F.avg(y).alias("_mean"), (F.var_pop(y) * F.count("*")).alias("_ss"))
    cells, terms = model_terms(cells, factors, interactions)
    named = cells.select(F.col("_mean"), F.col("_n"), F.col("_ss"), *[F.col(f"`{t}`").cast("double").alias(f"_x{i}") for i, t in enumerate(terms)])
    named = named.cache()
    xs = [f"_x{i}" for i in range(len(terms))]
    gram, b, yy, _ = _gram(named, "_mean", xs, F.col("_n"))
    r = named.agg(F.sum("_n").alias("n"), F.count("*").alias("cells"), F.sum("_ss").alias("ss")).first()
    named.unpersist()
    rank = int(np.linalg.matrix_rank(gram))
    ss_lack = max(yy - float(np.linalg.lstsq(gram, b, rcond=None)[0] @ b), 0.0)
    dof_pure, dof_lack = r.n - r.cells, r.cells - rank
    f = (ss_lack / dof_lack) / (r.ss / dof_pure) if dof_pure > 0 and dof_lack > 0 and r.ss > 0 else None
    row = (ss_lack + r.ss, r.n - rank, r.ss, dof_pure, ss_lack, dof_lack, f, tails.f_tail(f, dof_lack, dof_pure) if f is not None else None)
    return df.sparkSession.createDataFrame([row], "rss double, dof long, ss_pure double, dof_pure long, ss_lack double, dof_lack long, f double, p double")


def lenth(df: DataFrame, factors: list[str], y: str, level: float = 0.95) -> DataFrame:
    """(term, effect, pse, margin, simultaneous, active): effects against their pseudo standard error (Lenth, 1989), for designs without replicates.

    The error is 1.5 times the median absolute effect, taken again without those beyond 2.5 times it; the margins are t quantiles of a third as
    many degrees of freedom as there are effects."""
    effects = factorial_effects(df, factors, y).cache()
    first = effects.agg((1.5 * F.median(F.abs("effect"))).alias("s"), F.count("*").alias("m"))
    small = effects.join(F.broadcast(first)).where((F.abs("effect") < 2.5 * F.col("s")) | (F.col("s") == 0))
    one = small.agg((1.5 * F.median(F.abs("effect"))).alias("pse"), F.max("m").alias("m")).first()
    both = [tails.t_quantile(x, one.m / 3) * one.pse for x in (level, level ** (1 / one.m))]
    return effects.select("term", "effect", F.lit(one.pse).alias("pse"), F.lit(both[0]).alias("margin"), F.lit(both[1]).alias("simultaneous"), (F.abs("effect") > both[0]).alias("active"))
