"""Validate raw requests and split them into accepted and rejected.

Rows arrive with every field as text (JSON bodies, CSV, a string table).
Each field is checked and cast; the first failing check becomes the row's
``reject_reason``. Nothing is imputed. A field that is absent from the body
is told apart from an explicit null when the ``_present`` key array from
``parse_json_requests`` is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ID, INTEGRAL_FEATURES, REQUEST
from .readers import once

# The ranges the input form enforces (checked only with strict_domain).
DOMAIN = {
    "transaction_time": (0, 23),
    "location_change": (0, 1),
    "device_change": (0, 1),
    "merchant_risk": (0.0, 1.0),
}
INTEGRAL = (ID,) + INTEGRAL_FEATURES
#: What counts as a number: a decimal literal (Spark's casts also take "1d" or hexadecimal forms), or NaN and infinities, which get a reason of their own.
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"


def _as_text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def _parsed(name: str, text: Column) -> Column:
    """Cast text to the request type, or null when it is not a valid value (also one out of the type's range)."""
    literal = F.when(text.rlike(NUMBER), text)
    if name in INTEGRAL:
        dbl = literal.try_cast("double")
        whole = literal.try_cast("bigint")
        # "12" and 12.0 are accepted, "12.5" is not; beyond 2^53 only literal integers are exact
        from_dbl = F.when((dbl == F.floor(dbl)) & (F.abs(dbl) <= 2.0**53), dbl.try_cast("bigint"))
        return F.coalesce(whole, from_dbl).try_cast("long" if name == ID else "int")
    return F.when(text.rlike(NUMBER) | text.rlike(NOT_FINITE), text).try_cast("double")


def _reason(name: str, raw: Column, text: Column, val: Column, present: Column | None, strict: bool) -> Column:
    kind = "an integer" if name in INTEGRAL else "a number"
    absent = ~F.array_contains(present, name) if present is not None else F.lit(False)
    r = F.when(raw.isNull() & absent, F.lit(f"missing field {name}"))
    r = r.when(raw.isNull(), F.lit(f"null {name}"))
    r = r.when(val.isNull(), F.concat(F.lit(f"{name} is not {kind}: "), text))
    if name not in INTEGRAL:
        r = r.when(F.isnan(val) | (F.abs(val) == float("inf")), F.lit(f"{name} is not finite"))
    if strict and name in DOMAIN:
        lo, hi = DOMAIN[name]
        r = r.when((val < lo) | (val > hi), F.lit(f"{name} out of range [{lo}, {hi}]"))
    return r


def validate(df: DataFrame, strict_domain: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed request columns plus ``reject_reason`` (null for accepted rows).

    ``df`` may hold the request fields as text or already typed; fields it
    lacks entirely are rejected as missing. Extra columns are ignored unless
    listed in ``keep``. Row-local: no shuffle, duplicate ids stay separate.
    """
    present = F.col("_present") if "_present" in df.columns else None
    fields = [f.name for f in REQUEST.fields if f.name in df.columns]
    if fields:  # a field's text and value are computed once, however many checks and outputs read them
        df = once(df, {f"_text_{n}": _as_text(F.col(n)) for n in fields})
        df = once(df, {f"_value_{n}": _parsed(n, F.col(f"_text_{n}")) for n in fields})
    outs, reasons = [], []
    if "_malformed" in df.columns:  # a body that is no JSON object
        reasons.append(F.when(F.col("_malformed"), F.concat(F.lit("malformed body: "), F.coalesce(F.col("_raw"), F.lit("")))))
    for f in REQUEST.fields:
        if f.name not in df.columns:
            outs.append(F.lit(None).cast(f.dataType).alias(f.name))
            reasons.append(F.lit(f"missing field {f.name}"))
            continue
        raw = F.col(f.name)
        text, val = F.col(f"_text_{f.name}"), F.col(f"_value_{f.name}")
        outs.append(val.alias(f.name))
        reasons.append(_reason(f.name, raw, text, val, present, strict_domain))
    return df.select(*[F.col(k) for k in keep], *outs, F.coalesce(*reasons).alias("reject_reason"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K7: (accepted rows without the reason column, rejected rows with it)."""
    ok = validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = validated.filter(F.col("reject_reason").isNotNull())
    return ok, bad
