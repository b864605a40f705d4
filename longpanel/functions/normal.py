"""Inverse of the standard normal distribution as a Spark column expression.

Algorithm AS 241 (Wichura 1988), accurate to about 1e-16, evaluated inside codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published coefficients of AS 241 (PPND16), highest power last.
A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3)
B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3)
C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4)
D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9)
E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7)
G = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15)


def _poly(c: Sequence[float], x: Column) -> Column:
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = out * x + F.lit(k)
    return out


def inverse_normal(p: Column) -> Column:
    """``inv_cdf(p)`` for ``0 < p < 1``; NULL elsewhere."""
    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    centre = q * _poly(A, r0) / _poly(B, r0)
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    near, far = tail - 1.6, tail - 5.0
    size = F.when(tail <= 5, _poly(C, near) / _poly(D, near)).otherwise(
        _poly(E, far) / _poly(G, far))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre)
                  .otherwise(F.when(q < 0, -size).otherwise(size)))
