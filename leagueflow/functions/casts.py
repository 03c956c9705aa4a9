"""Safe typing of raw JSON leaves (numbers and dates often arrive as strings).

All helpers return native Spark column expressions: no Python UDF, so they stay
inside whole-stage codegen. Spark runs with ANSI mode on, so every parse is a
``try_*`` and invalid input becomes NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number grammar accepted by the reference's parser
# (sign, digits with optional fraction, or a bare fraction, optional exponent).
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# The special float spellings that parse to NaN / +inf / -inf.
NAN_WORDS = ("nan", "+nan", "-nan")
POS_INF_WORDS = ("inf", "+inf", "infinity", "+infinity")
NEG_INF_WORDS = ("-inf", "-infinity")
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
# Zone designator after the time of an ISO-8601 string: Z or +hh:mm / +hhmm / +hh.
ZONE_PATTERN = r"[T ][0-9:.,]+\s*(Z|z|[+-][0-9]{2}(:?[0-9]{2})?)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_float(c: Column | str) -> Column:
    """Text or number → DOUBLE; blank/garbage → NULL; nan/inf spellings kept."""
    s = F.trim(_col(c).cast("string"))
    low = F.lower(s)
    return (
        F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))
        .when(low.isin(*NAN_WORDS), F.lit(float("nan")))
        .when(low.isin(*POS_INF_WORDS), F.lit(float("inf")))
        .when(low.isin(*NEG_INF_WORDS), F.lit(float("-inf")))
    )


def safe_int(c: Column | str, dtype: str = "bigint") -> Column:
    """Text or number → integer, truncating toward zero ('12.9' → 12, '-1.5' → -1).

    NaN, infinities, blanks and garbage become NULL. Plain integers are read
    as such, so ids above 2^53 keep their value; only a fraction or an exponent
    goes through DOUBLE.
    """
    s = F.trim(_col(c).cast("string"))
    # an infinity, as of 1e999, does not fit the integer, and try_cast gives NULL
    return F.when(s.rlike(INTEGER_PATTERN), s.try_cast(dtype)).when(s.rlike(NUMBER_PATTERN), s.try_cast("double").try_cast(dtype))


def safe_bool(c: Column | str) -> Column:
    """JSON booleans read as text → BOOLEAN ('true'/'false', also 1/0)."""
    s = F.lower(F.trim(_col(c).cast("string")))
    return F.when(s.isin("true", "1"), F.lit(True)).when(s.isin("false", "0"), F.lit(False))


def safe_ts_utc(c: Column | str) -> Column:
    """ISO-8601 text → TIMESTAMP_NTZ holding UTC wall time.

    An explicit zone (``Z`` or ``±hh:mm``) is converted to UTC; a naive string or
    a date alone is taken as UTC. The result does not depend on the session time
    zone: a zone is only looked for after a time, so the day of a date is none.
    """
    s = F.trim(_col(c).cast("string"))
    # the parser wants seconds before a zone, the minutes of an offset, and a colon before them
    timed = F.regexp_replace(s, r"([T ][0-9]{1,2}:[0-9]{2})\s*(Z|z|[+-])", "$1:00$2")
    whole = F.regexp_replace(timed, r"([T ][0-9:.,]+)\s*([+-][0-9]{2})$", "$1$2:00")
    instant = F.try_to_timestamp(F.regexp_replace(whole, r"([T ][0-9:.,]+)\s*([+-][0-9]{2})([0-9]{2})$", "$1$2:$3"))
    as_utc_ntz = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.unix_micros(instant).cast("decimal(38,6)") / F.lit(1_000_000)).cast("decimal(18,6)")
    )
    naive = s.try_cast("timestamp_ntz")
    return F.when(s == "", None).when(s.rlike(ZONE_PATTERN), as_utc_ntz).otherwise(naive)


def round2(c: Column | str) -> Column:
    """Round half up to 2 decimals on the double value: floor(x*100 + 0.5) / 100."""
    x = _col(c)
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    """max(lo, min(hi, x)); NULL stays NULL (Spark's least/greatest skip NULLs)."""
    x = _col(c)
    return F.when(x.isNull(), None).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))
