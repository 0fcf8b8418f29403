"""Predicted classes, label codes, and the seam for a user's model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def predicted_class(logits: Column) -> Column:
    """The place of the largest logit, counted from 0; the first one on ties."""
    return F.array_position(logits, F.array_max(logits)) - 1


def score(df: DataFrame, features: str, make_predict_fn: Callable, n_features: int, batch_size: int = 8) -> DataFrame:
    """Adds ``logits`` from a model that each worker makes once; rows go to it in batches."""
    udf = predict_batch_udf(
        make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[n_features]])
    return df.withColumn("logits", udf(F.col(features).cast("array<double>")))


def label_codes(train: DataFrame, label: str = "label") -> DataFrame:
    """``label, label_code``: sorted label names numbered from 0, fitted on the training rows only."""
    names = train.select(label).distinct()
    return names.withColumn("label_code", (F.row_number().over(Window.orderBy(label)) - 1).cast("bigint"))


def encode_labels(df: DataFrame, codes: DataFrame, label: str = "label") -> DataFrame:
    return df.join(codes, label, "left")
