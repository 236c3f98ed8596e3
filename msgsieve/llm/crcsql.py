"""crc32 for SQL counterparts, from its definition: DuckDB has no function for it."""

#: A common table expression for a ``WITH`` list. Its single row goes into every ``FROM`` that uses ``crc32_sql``.
CRC_TABLE = """crc_table AS MATERIALIZED (
    SELECT list(c ORDER BY b) AS codes FROM (
        SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS b)
    )
)"""


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of a text that is not null."""
    bytes_of = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295, list_reduce([4294967295] || {bytes_of}, {step}))"
