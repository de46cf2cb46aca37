"""Pieces of check SQL for DuckDB, which has no CRC-32."""

from __future__ import annotations

# a common table expression: the 256 remainders of the reflected polynomial
CRC_TABLE = """crc as (
    select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n)) t)"""


def crc32_of(body: str) -> str:
    """The unsigned CRC-32 of a blob, where ``crc`` of ``CRC_TABLE`` is joined in (one row, column ``t``)."""
    bytes_ = f"list_transform(regexp_extract_all(hex({body}), '..'), lambda pair: ('0x' || pair)::bigint)"
    step = "lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])"
    return f"xor(list_reduce({bytes_}, {step}, 4294967295), 4294967295)"
