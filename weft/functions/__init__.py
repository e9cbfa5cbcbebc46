"""Column functions."""

from weft.functions.columns import divide, entropy_bits, infinity, mode_struct, repeat_fold
from weft.functions.hashing import hash_part, pair_part, times_prime, wrapping_abs, wrapping_product, wrapping_sum

__all__ = [
    "divide",
    "entropy_bits",
    "hash_part",
    "infinity",
    "mode_struct",
    "pair_part",
    "repeat_fold",
    "times_prime",
    "wrapping_abs",
    "wrapping_product",
    "wrapping_sum",
]
