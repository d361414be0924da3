"""Key and hash expressions: pair identity, unordered pair keys, seeded ranks, spec names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pair_id(*cols) -> Column:
    """Stable identity of a pair; never row order."""
    return F.md5(F.concat_ws("|", *[_c(c).cast("string") for c in cols]))


def seeded_rank(seed, *cols) -> Column:
    """Order key for a seeded random choice: md5 text, equal in Spark and DuckDB."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def seeded_int(seed, *cols) -> Column:
    """Non-negative integer from the first 8 hex digits of the seeded md5 (portable across engines)."""
    return F.conv(F.substring(seeded_rank(seed, *cols), 1, 8), 16, 10).cast("long")


def unordered_pair_key(a, b) -> Column:
    """B6: 'min/max' of two terms."""
    return F.concat_ws("/", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def url_safe_md5_b64(text) -> Column:
    """URL-safe base64 of the MD5 digest of ``text``."""
    return F.translate(F.base64(F.unhex(F.md5(_c(text)))), "+/", "-_")


def dashed(c) -> Column:
    """Space -> dash form used to compare spellings."""
    return F.translate(_c(c), " ", "-")
