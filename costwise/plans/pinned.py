"""Pinned models for the SQL twins.

A SQL twin cannot call Spark's optimiser, so the operators that *use* a
classifier are checked with a fixed one: the fit on the sf0.01 transactions
view, rounded to six decimals. The fit itself is checked separately
(``fit_logistic`` against a gradient-descent twin).
"""

from __future__ import annotations

from ..operators.classifier import LinearModel

# sf0.01 transactions view, scaler statistics and scaled fit, 6 decimals.
PINNED_CLASSIFIER = LinearModel(
    mean=(49.630657, 11.4951, 0.7312, 0.4915, 0.498223),
    scale=(49.099895, 6.868186, 0.443336, 0.499928, 0.290202),
    coef=(1.91931, -0.715105, 0.701252, 0.412969, 1.023256),
    intercept=-0.691936,
)
