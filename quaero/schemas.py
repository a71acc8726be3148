"""Explicit schemas of every stage; nothing is inferred."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

PAGES = _struct(("page_id", _L), ("url", _S), ("html", _S))
DOCUMENTS = _struct(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L))
CONVERSATIONS = _struct(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S))
EMBEDDINGS = _struct(("vec_id", _L), ("embedding", T.ArrayType(T.FloatType())), ("label", _I))
LABELS = _struct(("doc_id", _L), ("quality", _I), ("toxic", _I))
BENCHMARK = _struct(("item_id", _L), ("text", _S))

ARTICLES = _struct(("url", _S), ("title", _S), ("text", _S))
CUSTOM_PASSAGES = _struct(("url", _S), ("page_contents", _S), ("content", _S))
EVAL_SET = _struct(("request_id", _S), ("request", _S), ("expected_response", _S))
CHUNKS = _struct(("id", _L), ("url", _S), ("chunk_no", _I), ("content", _S), ("page_contents", _S))
SECTIONS = T.ArrayType(_struct(("heading", _S), ("body", _S)))
HITS = _struct(("query_id", _L), ("id", _L), ("score", _D))
RETRIEVAL_LOG = _struct(
    ("run_id", _S), ("query_id", _L), ("rank", _I), ("id", _L), ("url", _S),
    ("score", _D), ("relevance_score", _D),
)
VERDICTS = _struct(
    ("request_id", _S), ("correctness", _B), ("context_sufficiency", _B),
    ("groundedness", _B), ("overall", _B),
)

TABLES = {
    "pages": PAGES, "documents": DOCUMENTS, "conversations": CONVERSATIONS,
    "embeddings": EMBEDDINGS, "labels": LABELS, "benchmark": BENCHMARK,
}
