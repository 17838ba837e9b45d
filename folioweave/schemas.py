"""Schemas of the engine's tables, used on every read of raw files."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _A, _I, _L, _D = T.StringType(), T.ArrayType(T.StringType()), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BOOKS = _struct(book_id=_S, book_text=_S)
QA = _struct(book_id=_S, question_id=_I, question=_S, options=_A, answer=_S)
CHUNKS = _struct(book_id=_S, chunk_id=_S, ord=_I, text=_S)
NODES = _struct(book_id=_S, node_id=_S, level=_I, text=_S, embedding=T.ArrayType(T.FloatType()))
TREE_EDGES = _struct(book_id=_S, parent_id=_S, child_id=_S)
NODE_LEAVES = _struct(book_id=_S, node_id=_S, chunk_id=_S)
MENTIONS = _struct(book_id=_S, chunk_id=_S, entity=_S)
NODE_ENTITIES = _struct(book_id=_S, node_id=_S, entity=_S)
RELATIONS = _struct(book_id=_S, chunk_id=_S, source=_S, relation=_S, target=_S)
EDGES = _struct(book_id=_S, source=_S, relation=_S, target=_S, weight=_D, support_count=_I, chunk_ids=_A)
PREDICTIONS = _struct(pipeline=_S, book_id=_S, question_id=_I, question=_S, options=_A, ground_truth=_S, ground_truth_text=_S, prediction=_S, raw_llm_output=_S)
#: One line of the question file of a long-text benchmark; `answer` is a text or a list, so it is read as a variant.
BENCHMARK_LINE = T.StructType([T.StructField("context", _S), T.StructField("input", _S), T.StructField("options", _A), T.StructField("answer", T.VariantType()), T.StructField("_corrupt", _S)])
NOVEL_QUESTION = _struct(Question=_S, Options=_struct(A=_S, B=_S, C=_S, D=_S), Gold=_S)
USAGE = _struct(book_id=_S, call=_S, prompt_tokens=_L, completion_tokens=_L)
