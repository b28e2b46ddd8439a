"""Statistical column expressions: tail probabilities, evidence scores, link functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f_tail(f: Column, df: Column) -> Column:
    """P(F(1, df) >= f) for a whole df of at least 1, by its finite trigonometric series."""
    c2 = df / (df + f)
    s = F.sqrt(F.greatest(1 - c2, F.lit(0.0)))
    odd = F.pmod(df.cast("int"), F.lit(2)) == 1
    terms = F.floor(F.when(odd, (df - 3) / 2).otherwise(df / 2 - 1)).cast("int")
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    first = F.when(odd, F.sqrt(c2)).otherwise(F.lit(1.0))

    def add(state: Column, k: Column) -> Column:
        grow = F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        term = state["t"] * c2 * grow
        return F.struct(term.alias("t"), (state["s"] + term).alias("s"))

    series = F.aggregate(steps, F.struct(first.alias("t"), first.alias("s")), add)["s"]
    series = F.when(odd & (df < 3), F.lit(0.0)).otherwise(series)
    p = F.when(odd, 1 - F.lit(0.6366197723675814) * (F.asin(s) + s * series)).otherwise(1 - s * series)
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))


def pearson_tail(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n rows."""
    rest = 1 - r * r
    return F.when(rest <= 1e-15, F.lit(0.0)).otherwise(f_tail(r * r * (n - 2) / F.when(rest > 1e-15, rest), n - 2))


def composite_score(p_adj: Column, effect: Column, n: Column, reference: float, alpha: float, least_effect: float) -> Column:
    """Weighted evidence: 0.4 of the p part and 0.6 of the effect part, corrected for degrees of freedom."""
    c = F.pow((F.lit(reference) - 3) / F.greatest(n - 3, F.lit(1)), 2)
    p_part = F.greatest(F.least(1 - p_adj / (F.lit(alpha) / c), F.lit(1.0)), F.lit(0.0))
    e_part = F.greatest(F.least(effect / F.greatest(F.lit(least_effect) * c, F.lit(1e-10)), F.lit(2.0)), F.lit(0.0)) / 2
    return 0.4 * p_part + 0.6 * e_part


def softsign(z: Column) -> Column:
    return F.when(F.abs(z) == float("inf"), F.signum(z)).otherwise(z / (1 + F.abs(z)))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column, edge: float = 1e-4) -> Column:
    q = clip(p, edge, 1 - edge)
    return F.ln(q / (1 - q))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def gumbel_tail(top: Column, mean: Column, sd: Column) -> Column:
    """P of a maximum of scores with the given mean and deviation, by a Gumbel law."""
    beta = sd * (6**0.5 / 3.141592653589793)
    mu = mean - F.lit(0.5772156649015329) * beta
    return clip(1 - F.exp(-F.exp(-(top - mu) / F.when(beta > 0, beta))), 0.0, 1.0)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_p(x: Column) -> Column:
    return F.coalesce(nan_to_null(x), F.lit(1.0))
