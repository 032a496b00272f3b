from foldwise.functions.features import flag_above, interaction, mean_of, rate, ratio
from foldwise.functions.hashing import hash_position, order_hash
from foldwise.functions.nulls import finite_sql
from foldwise.functions.scores import linear_margin, positive_class, sigmoid

__all__ = [
    "finite_sql",
    "flag_above",
    "hash_position",
    "interaction",
    "linear_margin",
    "mean_of",
    "order_hash",
    "positive_class",
    "rate",
    "ratio",
    "sigmoid",
]
