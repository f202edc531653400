"""Schemas of the logical tables; readers take them explicitly, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, I, B, D, L = T.StringType(), T.IntegerType(), T.ByteType(), T.DoubleType(), T.LongType()

ITEMS = _of(item_id=S, title=S, category=S, brand=S, gender=S, age_group=S, attributes=S)
TERMS = _of(term_id=S, query=S)
TRAINING_PAIRS = _of(id=S, term_id=S, item_id=S, label=B)
SUBMISSION_PAIRS = _of(id=S, term_id=S, item_id=S)
TRAIN_SAMPLED = _of(id=S, term_id=S, item_id=S, label=I, sample_type=S)
TRAIN_PAIRS = _of(term_id=S, item_id=S, label=B, fold=B)
SCORES = _of(id=S, model=S, score=D)
EMBEDDINGS = _of(id=S, embedding=T.ArrayType(T.FloatType()))
JUDGE_LABELS = _of(id=S, label=I, source=S, priority=I)
LABEL_FILE = _of(id=S, label=I)
LLM_LABELS = _of(term_id=S, item_id=S, label=I)
SUBMISSION = _of(id=S, prediction=I)
#: A line of a judge service's batch output.
JUDGE_REPLY = T.StructType(
    [
        T.StructField("custom_id", S),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField("status_code", I),
                    T.StructField(
                        "body",
                        T.StructType(
                            [
                                T.StructField("choices", T.ArrayType(T.StructType([T.StructField("message", T.StructType([T.StructField("content", S)]))]))),
                                T.StructField("usage", T.StructType([T.StructField("prompt_tokens", L), T.StructField("completion_tokens", L)])),
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)
