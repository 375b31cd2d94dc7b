"""Explicit schemas and the policies that are part of the data contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

REVIEW = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType()), T.StructField("stars", T.DoubleType()), T.StructField("text", T.StringType())])
ITEM_MODEL = T.StructType([T.StructField("b1", T.StringType()), T.StructField("b2", T.StringType()), T.StructField("sim", T.DoubleType())])
USER_MODEL = T.StructType([T.StructField("u1", T.StringType()), T.StructField("u2", T.StringType()), T.StructField("sim", T.DoubleType())])
TEST_PAIR = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType())])

SIX = ["n", "sx", "sy", "sxx", "syy", "sxy"]


@dataclass(frozen=True)
class Policy:
    """min_overlap: shared dimensions a pair needs; eps: similarities must exceed it to be emitted;
    tolerance: accepted absolute difference of two results; jaccard: verification threshold."""

    min_overlap: int = 3
    eps: float = 1e-14
    tolerance: float = 1e-12
    jaccard: float = 0.01


POLICY = Policy()


class InputRefused(ValueError):
    """Input or options outside an operator's domain; nothing has been computed."""


class ValidationFailed(RuntimeError):
    """A computed result disagrees with what it was validated against."""
