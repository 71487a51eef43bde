"""Error metrics as aggregate expressions over (observed, predicted).

Every expression is made of mergeable moments (counts, sums, central moments), so Spark combines
them on the map side and a group of any size costs one small row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Errors:
    """Metric expressions for the rows where both values are present and ``where`` holds."""

    def __init__(self, obs: str | Column, pred: str | Column, where: Column | None = None):
        o = F.col(obs) if isinstance(obs, str) else obs
        p = F.col(pred) if isinstance(pred, str) else pred
        usable = o.isNotNull() & p.isNotNull()
        if where is not None:
            usable = usable & where
        self.o = F.when(usable, o.cast("double"))
        self.p = F.when(usable, p.cast("double"))

    def n(self) -> Column:
        return F.count(self.o)

    def _squared_error(self) -> Column:
        return F.sum((self.o - self.p) * (self.o - self.p))

    def nse(self) -> Column:
        """1 - squared error / spread of the observations; 0 where they do not vary."""
        spread = F.var_pop(self.o) * self.n()
        return (
            F.when(self.n() == 0, F.lit(None))
            .when(spread == 0, F.lit(0.0))
            .otherwise(F.lit(1.0) - F.try_divide(self._squared_error(), spread))
        )

    def r2(self) -> Column:
        """The same quantity as :meth:`nse`, reported under a second name."""
        return self.nse()

    def kge(self) -> Column:
        """Correlation, variability and bias as one distance. Flat observations give r = alpha = 0,
        a zero mean gives beta = 0, and a flat prediction of varying observations is undefined."""
        so, sp = F.stddev_pop(self.o), F.stddev_pop(self.p)
        varies = F.var_pop(self.o) > 0
        r = F.when(varies, F.try_divide(F.covar_pop(self.o, self.p), so * sp)).otherwise(F.lit(0.0))
        alpha = F.when(varies, F.try_divide(sp, so)).otherwise(F.lit(0.0))
        beta = F.when(F.avg(self.o) != 0, F.try_divide(F.avg(self.p), F.avg(self.o))).otherwise(F.lit(0.0))
        distance = F.sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1))
        return F.when(self.n() == 0, F.lit(None)).otherwise(F.lit(1.0) - distance)

    def rmse(self) -> Column:
        return F.sqrt(F.avg((self.o - self.p) * (self.o - self.p)))

    def pbias(self) -> Column:
        """Percent of the observed total that the prediction misses; positive means too low."""
        total = F.sum(self.o)
        return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(100.0) * F.sum(self.o - self.p), total))

    def suite(self, digits: int | None = 4) -> list[Column]:
        """The five standard metrics, rounded for reports (``digits=None`` keeps them raw)."""
        raw = {"nse": self.nse(), "kge": self.kge(), "rmse": self.rmse(), "pbias": self.pbias(), "r2": self.r2()}
        return [(F.round(c, digits) if digits is not None else c).alias(name) for name, c in raw.items()]
