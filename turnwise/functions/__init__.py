from .hashing import portable_hash, unit_uniform
from .text import (normalize_label, normalize_text, strip, tokens, truncate_tokens,
                   turn_count, whitespace_tokens)
from .vectors import cosine, dot, euclidean, l2_normalize, norm, pair_distance

__all__ = [
    "portable_hash", "unit_uniform", "normalize_label", "normalize_text", "strip",
    "tokens", "truncate_tokens", "turn_count", "whitespace_tokens", "cosine", "dot",
    "euclidean", "l2_normalize", "norm", "pair_distance",
]
