"""Column functions for comparing embeddings; all of them stay in the JVM, but for the distance of long ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import EMBEDDING_SIZES, FALLBACK_THRESHOLD, VerifyConfig


def rounded(x: Column, digits: int) -> Column:
    """x rounded half up by one formula that any SQL engine can repeat; never -0.0."""
    p = float(10**digits)
    return F.floor(x * p + 0.5).cast("double") / p


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def length_error(a: Column, b: Column) -> Column:
    """A message where two embeddings differ in length, else null."""
    return F.when(F.size(a) != F.size(b), F.concat(F.lit("embedding lengths differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))


def expected_size(model_name: Column) -> Column:
    """Length of a model's embeddings; null for an unknown model."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in EMBEDDING_SIZES.items() for x in pair)), model_name)


@F.arrow_udf(DoubleType())
def _dense_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """cosine_distance by one product over all numbers of a batch."""
    n, m = (pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (a, b))
    fit = np.flatnonzero((n == m) & (n >= 0))
    x, y = (c.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in (a, b))
    out, some = np.ones(len(fit)), n[fit] > 0
    starts = (np.cumsum(n[fit]) - n[fit])[some].astype(np.int64)
    if len(starts):
        dot, xx, yy = (np.add.reduceat(p, starts) for p in (x * y, x * x, y * y))
        norms = np.sqrt(xx) * np.sqrt(yy)
        out[some] = np.where(norms == 0, 1.0, 1.0 - dot / np.where(norms == 0, 1.0, norms))
    full = np.full(len(n), np.nan)
    full[fit] = out
    return pa.array(full, pa.float64(), from_pandas=True)  # a null number in a vector gives null, as in the JVM


#: Numbers of an embedding from which a batch in Arrow is faster than the JVM's fold.
DENSE = 128


def cosine_distance(a: Column, b: Column, size: int | None = None) -> Column:
    """1 - cosine: 0 same direction, 1 orthogonal or a zero vector, 2 opposite; null on unequal length.

    size is the length that embeddings are expected to have; it only chooses how they are computed.
    """
    if size is not None and size >= DENSE:
        return _dense_distance(a, b)
    norms = _norm(a) * _norm(b)
    return F.when(F.size(a) == F.size(b), F.when(norms == 0.0, F.lit(1.0)).otherwise(F.lit(1.0) - _dot(a, b) / norms))


def effective_threshold(explicit: Column | float | None, cfg: VerifyConfig) -> Column:
    """An explicit threshold counts even at 0; a configured 0 doesn't."""
    given = explicit if isinstance(explicit, Column) else F.lit(explicit).cast("double")
    return F.coalesce(given, F.lit(cfg.threshold), F.lit(FALLBACK_THRESHOLD))


def confidence(distance: Column) -> Column:
    """Percent in [0, 100], two decimals."""
    return rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.lit(1.0) - distance) * 100.0)), 2)


def verdict(distance: Column, threshold: Column) -> Column:
    """struct<verified, confidence, distance>; the test is on the unrounded distance."""
    return F.struct((distance <= threshold).alias("verified"), confidence(distance).alias("confidence"), rounded(distance, 6).alias("distance"))


def match_band(distance: Column, threshold: Column) -> Column:
    """struct<band, gap, suggested_threshold>: how clear a match or a failure is."""
    ok, conf = distance <= threshold, confidence(distance)
    band = (
        F.when(ok & (conf > 90), "excellent").when(ok & (conf > 75), "good").when(ok, "acceptable")
        .when(distance > 0.8, "very_high").when(distance > 0.6, "high").when(distance.isNotNull(), "marginal")
    )
    return F.struct(
        band.alias("band"), F.when(~ok, rounded(distance - threshold, 6)).alias("gap"),
        F.when(band == "marginal", rounded(distance + 0.01, 6)).alias("suggested_threshold"),
    )


def similarity(conf: Column) -> Column:
    """Confidence in percent as a score in [0, 1]."""
    return conf / 100.0


def first_face(faces: Column) -> Column:
    """struct<face, error>: the first detected face."""
    face = F.get(faces, F.lit(0))
    return F.struct(face.alias("face"), F.when(face.isNull(), F.lit("no face found")).alias("error"))


def classify_error(message: Column) -> Column:
    """struct<error_class, user_message>: whose image had no face, or the text as it is."""
    low = F.lower(message)
    detect = F.contains(low, F.lit("face")) & F.contains(low, F.lit("detect"))
    kind = F.when(detect & F.contains(low, F.lit("img1_path")), "probe").when(detect & F.contains(low, F.lit("img2_path")), "reference").when(detect, "either").otherwise("other")
    text = F.when(kind == "probe", "The captured photo shows no face.").when(kind == "reference", "The enrolled photo shows no face.").when(kind == "either", "An image shows no face.").otherwise(message)
    return F.struct(kind.alias("error_class"), text.alias("user_message"))
