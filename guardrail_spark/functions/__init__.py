"""Column functions."""

from .columns import (
    aba_ok,
    bump_patch,
    canonical_double,
    canonical_ts,
    iban_ok,
    jwt_ok,
    luhn_ok,
    shannon_entropy,
    text_hash,
    wilson,
)

__all__ = ["aba_ok", "bump_patch", "canonical_double", "canonical_ts", "iban_ok", "jwt_ok", "luhn_ok", "shannon_entropy", "text_hash", "wilson"]
