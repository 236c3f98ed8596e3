"""The thirteen hand-written text signals as native expressions."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame

from msgsieve.functions.sqltext import regex

# The signal patterns.
URL_PATTERN = r"https?://\S+|www\.\S+|\b\w+\.(com|net|org|uk|io|co|info|biz)\b"
SHORTENER_PATTERN = r"\b(bit\.ly|bit\.do|tinyurl|goo\.gl|t\.co|smsg\.io|ow\.ly|is\.gd|buff\.ly|tiny\.cc)\b"
PHONE_PATTERN = r"\+?\d[\d\s().-]{6,}\d"
SHORTCODE_PATTERN = r"\b\d{5,6}\b"
CURRENCY_PATTERN = "[$£€]"
URL_GRAB = (
    r"(https?://[^\s]+|www\.[^\s]+|"
    r"\b[a-z0-9.-]+\.(?:com|net|org|uk|io|co|info|biz|tk|xyz|top|ml|ga)\b)"
)
IP_URL_PATTERN = r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
SUSPICIOUS_TLD_PATTERN = r"\.(tk|xyz|top|ml|ga|gq|cf|buzz|club|work)\b"
LOOKALIKE_PATTERN = r"\b[a-z]*[a-z][01][a-z]*[a-z]\b"

# Signal order of the feature matrix.
SIGNALS_8 = [
    "url_count",
    "has_url",
    "has_shortened_url",
    "has_phone",
    "has_shortcode",
    "exclamation_count",
    "currency_count",
    "capital_ratio",
]
URL_SIGNALS = [
    "has_ip_url",
    "has_suspicious_tld",
    "has_lookalike",
    "longest_url_len",
    "max_url_dots",
]
SIGNALS_13 = SIGNALS_8 + URL_SIGNALS


def signal_expressions(text: str, urls: str, url_count: str) -> dict[str, str]:
    """SQL text of each signal over a text column and its two prepared columns."""

    def flag(pattern):
        return f"CAST({text} RLIKE {regex(pattern)} AS INT)"

    letters = f'length(regexp_replace({text}, r"\\P{{L}}+", ""))'
    capitals = f'length(regexp_replace({text}, r"\\P{{Lu}}+", ""))'
    return {
        "url_count": url_count,
        "has_url": f"CAST({url_count} > 0 AS INT)",
        "has_shortened_url": flag(SHORTENER_PATTERN),
        "has_phone": flag(PHONE_PATTERN),
        "has_shortcode": flag(SHORTCODE_PATTERN),
        "exclamation_count": f"length({text}) - length(replace({text}, '!', ''))",
        "currency_count": f"length({text}) - length(translate({text}, '$£€', ''))",
        "capital_ratio": f"round(coalesce({capitals} / nullif({letters}, 0), 0.0D), 4)",
        "has_ip_url": flag(IP_URL_PATTERN),
        "has_suspicious_tld": flag(SUSPICIOUS_TLD_PATTERN),
        "has_lookalike": flag(LOOKALIKE_PATTERN),
        "longest_url_len": f"coalesce(array_max(transform({urls}, u -> length(u))), 0)",
        "max_url_dots": (
            f"coalesce(array_max(transform({urls}, "
            "u -> length(u) - length(replace(u, '.', '')))), 0)"
        ),
    }


def signal_transformer(text: str = "text", prefix: str = "", ratio: str | None = None) -> SQLTransformer:
    """A stage that adds the 13 signals.

    ``ratio`` names an SQL expression for ``capital_ratio``, usually the column saved before the
    text was lower-cased; without it the ratio comes from the text itself. The URL list feeds two
    signals and its own column, so an inner projection computes it once per row.
    """
    exprs = signal_expressions("_text", "_urls", "_url_count")
    if ratio:
        exprs["capital_ratio"] = ratio
    outer = ", ".join(f"{exprs[name]} AS {prefix}{name}" for name in SIGNALS_13)
    inner = (
        f"SELECT *, regexp_extract_all(_text, {regex(URL_GRAB)}, 1) AS _urls, "
        f"regexp_count(_text, {regex(URL_PATTERN)}) AS _url_count "
        f"FROM (SELECT *, coalesce({text}, '') AS _text FROM __THIS__)"
    )
    return SQLTransformer(
        statement=f"SELECT * EXCEPT (_text, _urls, _url_count), {outer} FROM ({inner})"
    )


def url_list(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``urls``: every link in the text, in order."""
    return df.selectExpr("*", f"regexp_extract_all({text}, {regex(URL_GRAB)}, 1) AS urls")


def with_signals(df: DataFrame, text: str = "text", ratio: str | None = None) -> DataFrame:
    """The message columns plus the 13 signals; a saved ratio column is replaced by name."""
    out = signal_transformer(text, prefix="sig_", ratio=ratio).transform(df)
    out = out.drop(*[c for c in SIGNALS_13 if c in df.columns])
    return out.withColumnsRenamed({f"sig_{c}": c for c in SIGNALS_13})
