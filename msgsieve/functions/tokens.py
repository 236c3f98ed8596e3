"""Word and character n-grams, and per-row term counts, without a shuffle or a Python UDF."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame

from msgsieve.functions.sqltext import strings

# Spark's English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split()

WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def word_ngrams(text: str = "text", out: str = "word_tokens", stop_words=STOP_WORDS) -> SQLTransformer:
    """Unigrams, then bigrams over what is left after the stop words are taken out."""
    # A token has no apostrophe, so only plain stop words can match one.
    plain = [w for w in stop_words if "'" not in w]
    keep = f"w -> w NOT IN ({strings(plain)})" if plain else "w -> true"
    return SQLTransformer(
        statement=f"""
        SELECT * EXCEPT (_words),
               concat(_words, zip_with(
                   slice(_words, 1, greatest(size(_words) - 1, 0)),
                   slice(_words, 2, greatest(size(_words) - 1, 0)),
                   (a, b) -> concat(a, ' ', b))) AS {out}
        FROM (SELECT *, filter(regexp_extract_all(lower(coalesce({text}, '')), r"{WORD_PATTERN}", 0),
                               {keep}) AS _words
              FROM __THIS__)"""
    )


def char_ngrams(text: str = "text", out: str = "char_tokens", low: int = 3, high: int = 5) -> SQLTransformer:
    """Character n-grams inside space-padded words; a padded word no longer than n comes once.

    A padded word has at least three characters, which is why ``low`` may not exceed 3.
    """
    if not 1 <= low <= 3 or high < low:
        raise ValueError("need 1 <= low <= 3 and high >= low")
    return SQLTransformer(
        statement=f"""
        SELECT * EXCEPT (_padded),
               flatten(transform(_padded, p ->
                   flatten(transform(sequence({low}, least({high}, length(p))), n ->
                       transform(sequence(1, length(p) + 1 - n), i -> substring(p, i, n)))))) AS {out}
        FROM (SELECT *, transform(regexp_extract_all(lower(coalesce({text}, '')), r"(?U)\\S+", 0),
                                  w -> concat(' ', w, ' ')) AS _padded
              FROM __THIS__)"""
    )


def term_counts(tokens: str, out: str = "terms") -> SQLTransformer:
    """``array<struct<term, tf>>`` of a token column, one entry per distinct term of the row.

    A row's tokens are already together, so sorting them in place and cutting the runs gives what a
    ``groupBy(row, term)`` would, but no token crosses the network.
    """
    return SQLTransformer(
        statement=f"""
        SELECT * EXCEPT (_sorted, _starts),
               zip_with(_starts,
                        concat(slice(_starts, 2, greatest(size(_starts) - 1, 0)), array(size(_sorted))),
                        (a, b) -> named_struct('term', _sorted[a], 'tf', b - a)) AS _all_terms
        FROM (SELECT *, if(size(_sorted) = 0, array(),
                           filter(sequence(0, size(_sorted) - 1),
                                  i -> i = 0 OR _sorted[i] <> _sorted[greatest(i - 1, 0)])) AS _starts
              FROM (SELECT *, sort_array({tokens}) AS _sorted FROM __THIS__))""".replace(
            "_all_terms", out
        )
    )


def explode_terms(df: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """Rows ``(keep..., term, tf)``, one per distinct term of each input row.

    The outer form matters: for a plain ``inline`` the optimizer adds a filter on the array's size and
    pushes it below the projections that build the array, which evaluates them again, the sort once
    per element.
    """
    counted = term_counts(tokens).transform(df.select(*keep, tokens))
    return counted.selectExpr(*keep, "inline_outer(terms)").where("term IS NOT NULL")
