"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from semcode.functions.hashing import md5_u32, md5_u32_sql, uniform01
from semcode.functions.vectors import dot, norm, cosine, l2_normalize, round_score
from semcode.functions.text import topic_tokens, word_tokens

__all__ = ["md5_u32", "md5_u32_sql", "uniform01", "dot", "norm", "cosine",
           "l2_normalize", "round_score", "topic_tokens", "word_tokens"]
