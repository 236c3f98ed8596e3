"""Quality by distribution divergence: a text's character classes and common words against its language.

A text has two histograms: characters by class (white space, lower case, upper case, other letters, digits,
punctuation, symbols, rest) and words (each common word of its language, and all others as one). The references are the summed
histograms of all documents of that language that pass the base rules. The Jensen-Shannon distance (the square root of the
divergence, to base two, so between 0 and 1) beyond ``MOST`` rejects a text. A histogram of a short
text says little, so each has a guard: with fewer than ``LEAST`` counts it is not judged. Languages without a word
list are judged by characters alone, texts without a language against all languages together.

Everything is a DataFrame expression; only narrow rows of counts are ever shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.functions.text import computed_once
from msgsieve.llm.common import read, written

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Character classes in the order in which they are taken out of a text.
CLASSES = {
    "space": r"[\x20\x09-\x0D]+",
    "lower": "[a-z]+",
    "upper": "[A-Z]+",
    "letter": r"\p{L}+",
    "digit": "[0-9]+",
    "mark": "[.,;:!?'\"()-]+",
    "symbol": r"[\x21-\x7E]+",
}

#: Common function words of each language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he this are or from at which but have an had they you".split(),
    "fr": "le la les de des du et un une dans que qui pour par sur est pas plus au avec ce il en ne se son sont aux mais ou".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei".split(),
    "es": "el la de que y en un una los las por con para se del su al como es lo no sus este ya entre cuando muy sin sobre o".split(),
}
ALL = "*"

MOST = {"classes": 0.32, "words": 0.30}
LEAST = {"classes": 100, "words": 60}


def repeated_words(windows: Column) -> Column:
    """How many words are in a window that occurs twice or more; ``windows`` are sorted structs (hash, at)."""

    def again(x, i):
        near = [F.get(windows, i + step)["hash"] == x["hash"] for step in (-1, 1)]
        return reduce(lambda a, b: a | b, [F.coalesce(same, F.lit(False)) for same in near])

    at = F.array_sort(F.transform(F.filter(windows, again), lambda x: x["at"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        at,
        start,
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["upto"], i)).alias("n"), (i + WINDOW).alias("upto")),
    )
    return covered["n"]


def counted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The base counts, the class counts and the common-word counts of every text, whole texts.

    A null text counts as an empty one: no words, no counts.
    """
    rows = docs.select(F.col(id_col), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lists = F.create_map(*[x for name, words in COMMON.items() for x in (F.lit(name), F.array(*map(F.lit, words)))])
    rows = computed_once(
        rows.withColumn("_common", F.try_element_at(lists, F.coalesce("lang", F.lit("")))),
        _words=F.filter(F.split("_text", SPACES), lambda w: w != ""),
    )
    rows = computed_once(rows, _hash=F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    every = sorted({w for words in COMMON.values() for w in words})
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_hash", i + j) for j in range(WINDOW)])),
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = computed_once(
        rows,
        _windows=windows,
        _hits=F.filter("_words", lambda w: w.isin(every)),
        _lines=lines,
        _left=F.regexp_replace("_text", CLASSES["space"], ""),
        n_symbols=F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", "")),
    )
    # Only texts with a window that occurs again are sorted.
    rows = computed_once(
        rows,
        _sorted=F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at")))),
        ),
    )
    taken, before = {"space": F.length("_text") - F.length("_left")}, "_left"
    for name, pattern in list(CLASSES.items())[1:]:
        after = f"_without_{name}"
        rows = computed_once(rows, **{after: F.regexp_replace(before, pattern, "")})
        taken[name] = F.length(before) - F.length(after)
        before = after
    taken["rest"] = F.length(before)
    hits = F.size("_hits")
    return rows.select(
        id_col,
        "lang",
        n.cast("long").alias("n_words"),
        F.length("_left").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_sorted").isNotNull(), repeated_words(F.col("_sorted"))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*[c.cast("long") for c in taken.values()]).alias("classes"),
        F.transform(F.coalesce("_common", F.array()), lambda w: (hits - F.size(F.array_remove("_hits", w))).cast("long")).alias("words"),
    ).withColumn("words", F.concat("words", F.array(F.col("n_words") - F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x))))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same length; null if one has no count."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    of_all = F.aggregate(reference, F.lit(0).cast("long"), lambda s, x: s + x)

    def term(x, y):
        p, q = x / total, y / of_all
        m = (p + q) / 2
        return F.when(x > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(y > 0, q * F.log2(q / m)).otherwise(0.0)

    divergence = F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda s, x: s + x) / 2
    return F.when((total > 0) & (of_all > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def references(counts: DataFrame) -> DataFrame:
    """``_of, _classes, _words``: the summed histograms of each language and of all together."""
    sound = counts.where(~base_failed())
    longest = max(map(len, COMMON.values())) + 1
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(longest)]
    by_language = sound.where(F.col("lang").isNotNull()).groupBy(F.col("lang").alias("_of")).agg(*sums)
    together = sound.groupBy(F.lit(ALL).alias("_of")).agg(*sums)
    return by_language.union(together).select(
        "_of",
        F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)]).alias("_classes"),
        F.filter(F.array(*[f"w{i}" for i in range(longest)]), lambda x: x.isNotNull()).alias("_words"),
    )


def judged(counts: DataFrame) -> DataFrame:
    """``counts`` (a stored table) with distances, ``base_failed`` and ``kept``."""
    rows = counts.withColumn("_of", F.coalesce("lang", F.lit(ALL))).join(references(counts), "_of", "left")
    enough = {k: F.aggregate(F.col(k), F.lit(0).cast("long"), lambda s, x: s + x) >= LEAST[k] for k in LEAST}
    rows = rows.withColumns({f"{k}_distance": F.when(enough[k], distance(F.col(k), F.col(f"_{k}"))) for k in LEAST})
    odd = [F.coalesce(F.col(f"{k}_distance") > MOST[k], F.lit(False)) for k in MOST]
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | odd[0] | odd[1]))


def op7_quality_rules(spark, sf_dir):
    """Base counts, divergence from the language and verdict for every document."""
    counts = written(counted(read(spark, sf_dir, "documents")), "quality-counts")
    return judged(counts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("classes_distance", 6).alias("classes_distance"), F.round("words_distance", 6).alias("words_distance"),
    )


def _oracle() -> str:
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in words)}]" for k, words in COMMON.items())
    steps, before = [], "t0"
    for i, pattern in enumerate(CLASSES.values(), 1):
        steps.append(f"regexp_replace({before}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS t{i}")
        before = f"t{i}"
    n = len(CLASSES)
    taken = ", ".join([*(f"length(t{i}) - length(t{i + 1})" for i in range(n)), f"length(t{n})"])
    sums = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {f}))"
    share = "({a}[i] / list_sum({a}))"

    def distance(a: str, b: str) -> str:
        p, q = share.format(a=a), share.format(a=b)
        middle = f"(({p} + {q}) / 2)"
        term = f"(CASE WHEN {a}[i] > 0 THEN {p} * log2({p} / {middle}) ELSE 0 END + CASE WHEN {b}[i] > 0 THEN {q} * log2({q} / {middle}) ELSE 0 END)"
        return f"sqrt(greatest({sums.format(a=a, f=term)} / 2, 0))"

    def reference(column: str) -> str:
        return (
            f"SELECT lang, list(s ORDER BY i) AS r FROM (SELECT lang, i, sum({column}[i])::BIGINT AS s FROM "
            f"(SELECT lang, {column}, unnest(range(1, len({column}) + 1)) AS i FROM counted WHERE NOT base_failed) GROUP BY 1, 2) GROUP BY 1"
        )

    guard = {k: f"list_sum({k}) >= {LEAST[k]}" for k in LEAST}
    far = {k: f"CASE WHEN {guard[k]} AND list_sum({k[0]}.r) > 0 THEN {distance(k, k[0] + '.r')} END" for k in LEAST}
    return rf"""
WITH texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS t0,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CASE lang {lists} ELSE [] END AS common
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS key
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM texts))),
repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM windows WHERE n > 1) GROUP BY 1),
stripped AS (SELECT *, {", ".join(steps)} FROM texts),
based AS (
  SELECT s.doc_id, lang, len(ws) AS n_words, length(t1) AS word_chars,
    length(t0) - length(regexp_replace(t0, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    [{taken}] AS classes, list_transform(common, lambda w: len(list_filter(ws, lambda x: x = w))) AS hits
  FROM stripped s LEFT JOIN repeats USING (doc_id)),
counted AS (
  SELECT *, list_append(hits, n_words - coalesce(list_sum(hits), 0)::BIGINT) AS words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM based),
class_references AS ({reference("classes")}),
word_references AS ({reference("words")}),
judged AS (
  SELECT d.*, {far["classes"]} AS classes_distance, {far["words"]} AS words_distance
  FROM counted d LEFT JOIN class_references c ON c.lang = d.lang LEFT JOIN word_references w ON w.lang = d.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(classes_distance > {MOST["classes"]}, false) OR coalesce(words_distance > {MOST["words"]}, false)) AS kept,
  round(classes_distance, 6) AS classes_distance, round(words_distance, 6) AS words_distance
FROM judged
"""


#: For tables whose documents all have a language.
ORACLE_SQL = _oracle()
