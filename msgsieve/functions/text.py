"""Scalar text functions as native column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

# Every character that Python's ``\s`` matches: Unicode white space and four separators.
SPACE = r"[\s\x{1c}-\x{1f}]"

# Source artefacts and years that the ablations strip.
YEAR_PATTERN = r"\b(19[9][0-9]|20[0-2][0-9])\b"
SOURCE_PATTERN = r"\b(jose|monkey|monkey\.org|org|utf)\b"
TIDY_SOURCE_PATTERN = r"\b(monkey\.org|monkey|jose|org|utf)\b[.@]?"

# Mis-decoded sequences and what they stand for, in cased and lower-cased form.
MOJIBAKE = {
    "Â£": "£",
    "â£": "£",
    "ï¿½": "\ufffd",
    "â€™": "’",
    "â€˜": "‘",
    "â€œ": "“",
    "â€¦": "…",
    "â€“": "–",
    "â€”": "—",
    "â‚¬": "€",
}
# Marks that follow a word in sound text, so they prove nothing after a lower-case letter.
AFTER_WORDS = "ª«´·¸¹²³º»¡¿¨¯"


def _two_bytes(lead: str, read_as: str) -> dict[str, str]:
    """Characters of two UTF-8 bytes with this first byte, as they look when read in Windows-1252."""
    out = {}
    for second in range(0x80, 0xC0):
        try:
            mark = bytes([second]).decode("cp1252")
        except UnicodeDecodeError:
            continue
        if read_as.isupper() or mark not in AFTER_WORDS and not mark.isspace():
            out[read_as + mark] = (lead.encode("cp1252") + bytes([second])).decode("utf-8")
    return out


# By rule: accented letters and Latin-1 signs read as two characters, as they are and lower-cased.
for _lead in "ÃÂ":
    MOJIBAKE.update(_two_bytes(_lead, _lead) | MOJIBAKE)
MOJIBAKE.update(_two_bytes("Ã", "ã"))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that later filters may name without evaluating them again.

    A filter on an ordinary computed column is pushed below the projection, which repeats the
    expression in the filter. Nothing is pushed below a generator, so one that yields exactly one row
    keeps a costly expression to one evaluation.
    """
    rest = [c for c in df.columns if c not in columns]
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*rest, F.inline(F.array(row)))


def collapse_spaces(col: Column) -> Column:
    """Runs of Unicode whitespace become one space; ends are stripped."""
    return F.trim(F.regexp_replace(col, f"(?U){SPACE}+", " "))


def strip_spaces(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def capital_ratio(col: Column) -> Column:
    """Upper-case letters over letters, 0.0 where there is no letter."""
    letters = F.length(F.regexp_replace(col, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(col, r"\P{Lu}+", ""))
    return F.when(letters > 0, capitals / letters).otherwise(F.lit(0.0))


def template_key(col: Column) -> Column:
    """The text with each run of digits replaced by 0."""
    return F.regexp_replace(col, r"(?U)\d+", "0")


def text_digest(col: Column) -> Column:
    """A 32-byte key for grouping on whole texts without shuffling or sorting them."""
    return F.unhex(F.sha2(col, 256))


def strip_years(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), "(?U)" + YEAR_PATTERN, " ")


def strip_confounds(col: Column, tidy: bool = False) -> Column:
    """Years, then the source artefacts. ``tidy`` also takes the punctuation they leave."""
    pattern = TIDY_SOURCE_PATTERN if tidy else SOURCE_PATTERN
    stripped = F.regexp_replace(strip_years(col), "(?U)" + pattern, " ")
    return collapse_spaces(stripped) if tidy else stripped


def _bound(col: Column, body) -> Column:
    """``body(col)`` with ``col`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(col), body), 1)


def _replace_found(col: Column, pattern: str, group: int, replacement) -> Column:
    """Replace each distinct match of ``pattern``; work grows with the matches of a row."""

    def body(text):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
        return F.reduce(found, text, lambda acc, hit: F.replace(acc, *replacement(hit)))

    return _bound(col, body)


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


# Characters that Windows-1252 has where Latin-1 has controls, and those controls.
_CP1252 = "".join(bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_LATIN1 = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
# Marks that follow a letter in sound text, so that they prove nothing by themselves.
_SOUND = AFTER_WORDS + "\u00a0\u00ad’‘”“…–—™•"
_ANY = _CP1252 + "\u0081\u008d\u008f\u0090\u009d" + "".join(map(chr, range(0xA0, 0xC0)))
_ODD = "".join(c for c in _ANY if c not in _SOUND)


def _sequences() -> tuple[str, str]:
    """Patterns of UTF-8 as it looks in Windows-1252, a letter for a first byte and marks for the others: runs of two
    characters or more, and single characters, of whose marks at least one does not follow letters in sound text.
    Lower-cased text has the small letter in place of the mark for 9F, which begins most characters of four bytes."""
    k, n = f"[{_ANY}]", f"[{_ODD}]"
    run = f"(?:[Â-ß]{k}|[à-ï]{k}{k}|[ð-ô][{_ANY}ÿ]{k}{k}){{2,}}"
    three = f"[à-ï](?:{n}{k}|{k}{n})"
    four = f"[ð-ô](?:[{_ODD}ÿ]{k}{k}|{k}{n}{k}|{k}{k}{n})"
    return run, f"[ÂÃ]{k}|[Ä-ß]{n}|{four}|{three}"


SEQUENCES = _sequences()


def _decoded(found: Column) -> Column:
    """The characters whose bytes a sequence shows, or the sequence if they are no UTF-8."""
    latin = F.translate(found, _CP1252 + "ÿ", _LATIN1 + "\u009f")
    return F.coalesce(F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string")), found)


def fix_encoding(col: Column) -> Column:
    """Undo UTF-8 that was read as Windows-1252, by rule, then the known sequences of lower-cased text."""
    leads = "".join(sorted({bad[0] for bad in MOJIBAKE}))
    pattern = f"(?=[{leads}])(?:{'|'.join(MOJIBAKE)})"
    table = _lookup(MOJIBAKE)
    col = F.coalesce(col, F.lit(""))
    for found in SEQUENCES:
        col = _replace_found(col, f"(?=[Â-ô])(?:{found})", 0, lambda bad: (bad, _decoded(bad)))
    return _replace_found(col, pattern, 0, lambda bad: (bad, F.element_at(table, bad)))


# Numeric references to the Windows-1252 control range mean the characters of that code page.
_CONTROLS = {str(p): bytes([p]).decode("cp1252") for p in range(0x80, 0xA0) if p not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _map(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _character(digits: Column, base: int) -> Column:
    """The character of a number of any length without leading zeros."""
    point = F.when(F.length(digits) <= 7, F.conv(digits, base, 10).cast("int"))
    valid = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(point), 8, "0"))
    plain = F.when(valid, F.decode(utf32, "UTF-32")).otherwise(F.lit("\ufffd"))
    return F.coalesce(F.try_element_at(_map(_CONTROLS), F.coalesce(point.cast("string"), F.lit(""))), plain)


def decode_entities(col: Column) -> Column:
    """HTML character references to characters; the ampersand last, so nothing decodes twice.

    Names are those of HTML 5; the older ones among them also count without a semicolon, and so do numbers.
    """
    names = _map({k: v for k, v in html5.items() if k not in ("amp", "amp;", "AMP", "AMP;")})
    older = sorted((k for k in html5 if not k.endswith(";") and k.lower() != "amp"), key=lambda k: (-len(k), k))

    def named(name):
        ref = F.concat(F.lit("&"), name)
        return ref, F.coalesce(F.try_element_at(names, name), ref)

    def decimal(digits):
        return F.concat(F.lit("&#"), digits, F.lit(";")), _character(digits, 10)

    def hexadecimal(digits):
        return F.concat(F.lit("&#x"), digits, F.lit(";")), _character(digits, 16)

    out = F.regexp_replace(F.regexp_replace(col, "&#0*([0-9]+);?", "&#$1;"), "&#[xX]0*([0-9a-fA-F]+);?", "&#x$1;")
    out = F.regexp_replace(out, "&#38;|&#x26;|&(?:amp|AMP);?", "&amp;")
    out = _replace_found(out, "&([A-Za-z][A-Za-z0-9]*;)", 1, named)
    out = _replace_found(out, f"&({'|'.join(older)})", 1, named)
    out = _replace_found(out, "&#([0-9]+);", 1, decimal)
    out = _replace_found(out, "&#x([0-9a-fA-F]+);", 1, hexadecimal)
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


ENCODED_WORD = r"=\?([^?*\s]+)(?:\*[^?\s]*)?\?([bBqQ])\?([^?\s]*)\?="


def _word_bytes(kind: Column, body: Column) -> Column:
    """The bytes of an encoded word's body; null if it is no base64."""
    pieces = F.regexp_extract_all(F.translate(body, "_", " "), F.lit("=[0-9A-Fa-f]{2}|[^=]+|="), F.lit(0))
    one = lambda p: F.when(p.rlike("^=[0-9A-Fa-f]{2}$"), F.unhex(F.substring(p, 2, 2))).otherwise(F.encode(p, "UTF-8"))
    quoted = F.aggregate(pieces, F.lit(b""), lambda done, p: F.concat(done, one(p)))
    bare = F.rtrim(body, F.lit("="))
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    return F.when(F.lower(kind) == "q", quoted).otherwise(F.try_to_binary(padded, F.lit("base64")))


def _charset(name: Column, raw: Column) -> Column:
    """Bytes to text; null for a character set that is not known."""
    latin = F.decode(raw, "ISO-8859-1")
    return (
        F.when(F.lower(name).isin("utf-8", "utf8", "us-ascii", "ascii"), F.make_valid_utf8(raw.cast("string")))
        .when(F.lower(name).isin("iso-8859-1", "latin1", "latin-1"), latin)
        .when(F.lower(name).isin("windows-1252", "cp1252"), F.translate(latin, _LATIN1, _CP1252))
    )


def decode_words(col: Column) -> Column:
    """A mail header with its encoded words (RFC 2047) decoded.

    White space between neighbours goes, and the bytes of neighbours in one character set are joined before they are
    decoded, so a character may be split over two words. Words that are malformed or in an unknown character set stay.
    """
    near = F.regexp_replace(col, rf"(\?=)\s+(?={ENCODED_WORD})", "$1")

    def run_text(run):
        group = lambda text, n: F.regexp_extract(text, ENCODED_WORD, n)
        words = F.transform(
            F.regexp_extract_all(run, F.lit(ENCODED_WORD), F.lit(0)),
            lambda w: F.struct(F.lower(group(w, 1)).alias("charset"), _word_bytes(group(w, 2), group(w, 3)).alias("raw"), w.alias("text")),
        )
        kind = "array<struct<charset: string, raw: binary, text: string>>"

        def join(done, w):
            last = F.try_element_at(done, F.lit(-1))
            both = F.struct(w["charset"].alias("charset"), F.concat(last["raw"], w["raw"]).alias("raw"), F.concat(last["text"], w["text"]).alias("text"))
            on = F.coalesce((last["charset"] == w["charset"]) & last["raw"].isNotNull() & w["raw"].isNotNull(), F.lit(False))
            return F.when(on, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(w)))

        joined = F.aggregate(words, F.array().cast(kind), join)
        return F.array_join(F.transform(joined, lambda w: F.coalesce(_charset(w["charset"], w["raw"]), w["text"])), "")

    return _replace_found(near, f"(?:{ENCODED_WORD})+", 0, lambda run: (run, run_text(run)))


# Comments, script and style content, each up to the end if it is not closed, and tags. A tag starts with a
# letter or one of / ! ?, and its quoted values may hold the closing sign.
MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    r"""|<[a-z/!?](?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>"""
)


def html_to_text(col: Column) -> Column:
    """Text nodes joined by single spaces."""
    return collapse_spaces(decode_entities(F.regexp_replace(col, MARKUP, " ")))
