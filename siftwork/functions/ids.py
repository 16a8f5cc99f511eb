"""Content ids and seeded order keys that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\u001f"  # field separator of the canonical form


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_id(*parts, length: int = 16) -> Column:
    """First ``length`` hex digits of sha256 over the parts; NULL reads as ''."""
    text = F.concat_ws(UNIT, *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, length)


def sample_id(instruction="instruction", response="response", source="source") -> Column:
    return content_id(instruction, response, source)


def task_id(name, member_ids) -> Column:
    """Id of a task from its name and the set of its sketch members (bounded array)."""
    ordered = F.array_sort(_c(member_ids))
    text = F.concat_ws(UNIT, _c(name), F.concat_ws(",", F.transform(ordered, lambda x: x.cast("string"))))
    return F.substring(F.sha2(text, 256), 1, 16)


def order_key(seed: int | str, *parts) -> Column:
    """Pseudo-random but reproducible order: md5 of ``seed:part:part``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]))


def hash_index(key: Column, n) -> Column:
    """0-based index below ``n`` from the first 8 hex digits of an md5 key."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), n)
