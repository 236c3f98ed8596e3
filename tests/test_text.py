import re

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from msgsieve.functions import signals as G, text as X, tokens as K
from msgsieve.plans.probes import PROBES

ORDER = [
    "url_count", "has_url", "has_shortened_url", "has_phone", "has_shortcode", "capital_ratio",
    "exclamation_count", "currency_count", "has_ip_url", "has_suspicious_tld", "has_lookalike",
    "longest_url_len", "max_url_dots",
]
MICRO = [
    ("minutes of the gardening club are on https://ow.ly/9f2x today", "1,1,1,0,0,0.0,0,0,0,0,0,18,1"),
    ("roadworks map: www.cityroads.info, plan b www.detours.biz", "2,1,0,0,0,0.0,0,0,0,0,0,19,2"),
    ("Bus 48213 leaves at nine, ticket 900417", "0,0,0,0,1,0.0476,0,0,0,0,0,0,0"),
    ("reach the vet on +49 30-1234 567!", "0,0,0,1,0,0.0,1,0,0,0,0,0,0"),
    ("a kilo of plums is €3, of figs $4 and of dates £5", "0,0,0,0,0,0.0,0,3,0,0,0,0,0"),
    ("printer page at http://10.20.30.40:631/ jobs", "1,1,0,1,0,0.0,0,0,1,0,0,23,3"),
    ("choir songs: notes.tk and score.ml", "0,0,0,0,0,0.0,0,0,0,1,0,8,1"),
    ("seed swap at garden.club, tools from shed.work", "0,0,0,0,0,0.0,0,0,0,1,0,0,0"),
    ("the b1rds sang at l0dge no 4", "0,0,0,0,0,0.0,0,0,0,0,1,0,0"),
    ("new opening hours on tinyurl.com/lib-hours", "1,1,1,0,0,0.0,0,0,0,0,0,11,1"),
    ("NO RAIN tomorrow", "0,0,0,0,0,0.4286,0,0,0,0,0,0,0"),
    ("mail.example.net, a.b.org and docs.example.io!!", "3,1,0,0,0,0.0,2,0,0,0,0,16,2"),
    ("login http://192.168.10.1/a.b?c=1 or www.foo.xyz now", "2,1,0,1,0,0.0,0,0,1,1,0,27,4"),
    ("paypa1 g00gle amaz0n", "0,0,0,0,0,0.0,0,0,0,0,1,0,0"),
    ("éle1ns tel +44 (0)20 7946 0958", "0,0,0,1,0,0.0,0,0,0,0,0,0,0"),
    ("", "0,0,0,0,0,0.0,0,0,0,0,0,0,0"),
    ("A", "0,0,0,0,0,1.0,0,0,0,0,0,0,0"),
    ("foo.co.uk and foo.com.", "2,1,0,0,0,0.0,0,0,0,0,0,9,2"),
    ("Straße ÉCOLE ǅ Ⅷ", "0,0,0,0,0,0.5,0,0,0,0,0,0,0"),
    (None, "0,0,0,0,0,0.0,0,0,0,0,0,0,0"),
]


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "text string").select(expr(F.col("text"))).first()[0]


def test_signals(spark):
    rows = [(i, t) for i, (t, _) in enumerate(MICRO)]
    got = G.with_signals(spark.createDataFrame(rows, "i int, text string")).orderBy("i").collect()
    for row, (text, expected) in zip(got, MICRO):
        assert ",".join(str(row[c]) for c in ORDER) == expected, text


def test_saved_ratio_replaces_the_recomputed_one(spark):
    df = spark.createDataFrame([("abc", 0.25)], "text string, capital_ratio double")
    row = G.with_signals(df, ratio="capital_ratio").first()
    assert row.capital_ratio == 0.25
    assert G.with_signals(df).first().capital_ratio == 0.0


@pytest.mark.parametrize(
    "value, expected",
    [("a b  c d\u000be", "a b c d e"), (" \n\t", ""), ("a\u001cb\u0085", "a b"), ("ab", "ab")],
)
def test_whitespace(spark, value, expected):
    assert one(spark, X.collapse_spaces, value) == expected == " ".join(value.split())


def test_strip_matches_python(spark):
    for value in ["  a  b\x1f", "x", "", "  "]:
        assert one(spark, X.strip_spaces, value) == value.strip()


def test_encoding(spark):
    assert one(spark, X.fix_encoding, "Â£5 â£5 ï¿½5") == "£5 £5 �5"
    assert one(spark, X.fix_encoding, "cafÃ© itâ€™s fÃ¼r") == "café it’s für"
    assert one(spark, X.fix_encoding, "grâce à l'âge, São") == "grâce à l'âge, São"
    assert one(spark, X.fix_encoding, None) == ""


def misread(text):
    """UTF-8 read as Windows-1252, its gaps as controls."""
    gaps = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
    return "".join(chr(b) if b in gaps else bytes([b]).decode("cp1252") for b in text.encode())


@pytest.mark.parametrize(
    "text", ["é", "ñandú", "Łódka", "’", "™", "…", "日本語", "😀 🎉", "Привет", "שלום", "한글", "£5", "a’b — c", "x😀y"]
)
def test_misread_text_of_any_length_comes_back(spark, text):
    assert one(spark, X.fix_encoding, misread(text)) == text
    assert one(spark, X.fix_encoding, f"({misread(text)})") == f"({text})"
    assert one(spark, X.fix_encoding, text) == text


def test_lower_cased_four_bytes(spark):
    assert one(spark, X.fix_encoding, misread("😀").lower()) == "😀"


@pytest.mark.parametrize(
    "text",
    ["Strauß’ Walzer", "groß« und »klein", "CAFÉ… É” À– Ñ™", "à\u00a0« mot", "né·e", "à €5", "naïve”", "prix: 5â", "få» ÿes", "Ã la", "ð and þ", "É”,"],
)
def test_sound_text_stays(spark, text):
    assert one(spark, X.fix_encoding, text) == text


def test_html(spark):
    page = (
        "<!DOCTYPE html><title>T</title><style>p{}</style><p>a <b>b</b>,c<!-- z --></p>"
        "<script>v='</p>'</script>"
    )
    assert one(spark, X.html_to_text, page) == "T a b ,c"
    refs = "&amp;lt; &eacute;&#233;&#xE9; &#38;lt; &bogus; &#55296; &#X41; &euro;"
    assert one(spark, X.html_to_text, refs) == "&lt; ééé &lt; &bogus; � A €"


def test_confounds(spark):
    text = "jose@monkey.org in 2024"
    assert one(spark, X.strip_confounds, text) == " @ .  in  "
    assert one(spark, lambda c: X.strip_confounds(c, tidy=True), text) == "in"
    assert one(spark, X.strip_years, "1989 1990 2029 2030 x2024") == "1989     2030 x2024"
    assert one(spark, X.strip_confounds, None) == ""


def test_patterns_agree_with_python_on_the_probes(spark):
    df = spark.createDataFrame([(t,) for t, *_ in PROBES], "text string")
    rows = df.select("text", X.strip_confounds(F.col("text")).alias("s"), X.template_key(F.col("text")).alias("k"))
    for r in rows.collect():
        expected = re.sub(X.SOURCE_PATTERN, " ", re.sub(X.YEAR_PATTERN, " ", r.text))
        assert r.s == expected
        assert r.k == re.sub(r"\d+", "0", r.text)


def test_stop_words_are_sparks(spark):
    assert K.STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_word_ngrams(spark):
    df = spark.createDataFrame([("The code 12, the CODE will é",), (None,), ("one",)], "text string")
    rows = [r.word_tokens for r in K.word_ngrams().transform(df).collect()]
    assert rows == [["code", "12", "code", "code 12", "12 code"], [], ["one"]]


def test_char_ngrams(spark):
    def brute(text):
        out = []
        for word in text.lower().split():
            word = f" {word} "
            for n in range(3, 6):
                out += [word[i : i + n] for i in range(max(1, len(word) - n + 1))]
                if len(word) <= n:
                    break
        return out

    texts = ["ab a", "abc défg h", "", "internationalization of x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, row in zip(texts, K.char_ngrams().transform(df).collect()):
        assert sorted(row.char_tokens) == sorted(brute(text))
    assert sorted(brute("ab a")) == sorted([" ab", "ab ", " ab ", " a "])


def test_term_counts(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["x"])], "id int, t array<string>")
    rows = K.explode_terms(df, "t", "id").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 1), (1, "b", 2), (3, "x", 1)]


def test_url_list(spark):
    df = spark.createDataFrame([("see www.a.com/x, b.org or http://c.d",)], "text string")
    assert G.url_list(df).first().urls == ["www.a.com/x,", "b.org", "http://c.d"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>5 < 6 and 7 > 3 ok</p>", "5 < 6 and 7 > 3 ok"),
        ('<a title="a>b">x</a>', "x"),
        ("a<script>var x = '<b>';", "a"),
        ("a<!-- open", "a"),
        ("<b>it&apos;s&nbsp;5&euro; &amp;lt;</b>", "it's 5€ &lt;"),
        ("a&nbspb &copy2 &#128;&#150; &#0000000065; &#x41 &#99999999999;", "a b ©2 €– A A \ufffd"),
        ('<a title="x>y', "y"),
        ("<img alt='it\"s > that'>z", "z"),
    ],
)
def test_html_to_text(spark, html, text):
    assert one(spark, X.html_to_text, html) == text


@pytest.mark.parametrize(
    "bad, good",
    [
        ("cafÃ© Ã‰cole straÃŸe 20Â° Â© 5â‚¬", "café École straße 20° © 5€"),
        ("«amanhã» irmãº", "«amanhã» irmãº"),
        ("cafã© mã¼de", "café müde"),
    ],
)
def test_fix_encoding(spark, bad, good):
    assert one(spark, X.fix_encoding, bad) == good
