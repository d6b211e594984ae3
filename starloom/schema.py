"""Row types of the tables the operators exchange."""

from pyspark.sql import types as T

_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


SOURCES = _struct(
    ("run_id", _S), ("sample_id", _L), ("src", _L), ("x", _D), ("y", _D), ("flux", T.ArrayType(_D))
)
SCALARS = _struct(
    ("run_id", _S), ("sample_id", _L), ("param", _S), ("idx", T.ArrayType(_L)), ("value", _D)
)
MAPS = _struct(
    ("run_id", _S), ("sample_id", _L), ("kind", _S), ("band", _L), ("row_", _L), ("col_", _L), ("value", _D)
)
TRUTH = _struct(("field_id", _L), ("truth_id", _L), ("x", _D), ("y", _D), ("f0", _D), ("f1", _D), ("f2", _D))
SAMPLES = _struct(
    ("run_id", _L), ("ts", T.TimestampType()), ("move", _S), ("accepted", _D), ("out_of_bounds", _D),
    ("chi2", _D), ("nsrc", _L), ("ms", _D),
)
EVENTS = _struct(("event_id", _L), ("obsid", _L), ("ts", T.TimestampType()), ("x", _D), ("y", _D), ("energy", _D))
