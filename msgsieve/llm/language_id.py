"""Language identification in two levels: the family first, then one-versus-one linear support vector
machines between the languages of that family.

A text is a histogram of hashed runs of one to four bytes over its letters (lower-cased ASCII, all else but
letters a space), square-rooted and of unit length. The family comes from one logistic model each, whose
share among all is also part of the score. Within a family every pair of languages has a linear SVM; the
language with most votes wins, ties by the sum of margins, then by name. Related languages are thus told
apart by models that see nothing but them.

Learning takes at most ``PER_LANGUAGE`` rows of a language and ``MOST_ROWS`` in all, drawn by the hash of the id;
their vectors are fitted on the driver. Every text is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from msgsieve.llm import hashing as H
from msgsieve.llm import linear
from msgsieve.llm.common import crc_part, read, written

BITS = 12
RUNS = (1, 2, 3, 4)
PER_LANGUAGE = 1000
#: Rows of all languages together; each language gets its part.
MOST_ROWS = 8000
PENALTY = 1e-5
UNKNOWN = "und"

#: Families of ISO 639-1 languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "pt", "it", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "uralic": ["fi", "et", "hu"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "pa", "gu", "ne"],
    "semitic": ["ar", "he", "mt", "am"],
}

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Identifier:
    """Families and their languages, the family model, and a weight vector for each pair of languages."""

    families: tuple[tuple[str, tuple[str, ...]], ...]
    family_weights: np.ndarray
    family_bias: np.ndarray
    pairs: dict


def histogram(data: np.ndarray) -> np.ndarray:
    """The unit-length feature vector of the bytes of a text."""
    codes = _FOLD[data]
    counts = np.zeros(1 << BITS)
    held = np.zeros(len(codes), dtype=np.uint32)
    for n in RUNS:
        if len(codes) < n:
            break
        held = held[: len(codes) - n + 1] * np.uint32(257) + codes[n - 1 :] if n > 1 else codes
        at = ((held + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        counts += np.bincount(at, minlength=1 << BITS)
    counts = np.sqrt(counts)
    return counts / max(np.linalg.norm(counts), 1e-12)


def family_of(language: str, families: dict = FAMILIES) -> str:
    return next((f for f, members in families.items() if language in members), language)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Identifier:
    """Learn from the rows that have a text, a language and an id. Without any, nothing can be told."""
    known = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang).alias("_lang"))
    place = F.row_number().over(W.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    first = known.withColumn("_place", place).where(F.col("_place") <= per_language)
    # Place by place over all languages: a language with few rows leaves its part to the others.
    drawn = written(first.orderBy("_place", "_lang").limit(MOST_ROWS).select("_id").distinct(), "languages-drawn")
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).join(drawn, F.col(id_col) == F.col("_id"))

    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "text"):
                data, offsets = H.buffers(part.column(1))
                vectors = [histogram(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                at = [np.flatnonzero(v).astype(np.int32) for v in vectors]
                value = [v[i].astype(np.float32) for v, i in zip(vectors, at)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["lang", "at", "value"]
                )

    source = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    table = source.mapInArrow(run, "lang string, at array<int>, value array<float>").toArrow().slice(0, MOST_ROWS)
    x = np.zeros((table.num_rows, 1 << BITS), dtype=np.float32)
    for i, (at, value) in enumerate(zip(table["at"], table["value"])):
        x[i, at.values.to_numpy()] = value.values.to_numpy()
    name = np.array(table["lang"].to_pylist(), dtype=object)
    members: dict = {}
    for one in sorted(set(name)):
        members.setdefault(family_of(one), []).append(one)
    families = tuple((f, tuple(m)) for f, m in sorted(members.items()))
    of = np.array([family_of(n) for n in name], dtype=object)
    fits = [linear.fit(x, of == f, "logistic", PENALTY) if len(families) > 1 else (0.0, np.zeros(1 << BITS)) for f, _ in families]
    pairs = {}
    for _, names in families:
        for a, b in combinations(names, 2):
            own = (name == a) | (name == b)
            bias, weights = linear.fit(x[own], name[own] == a, "svm", PENALTY)
            pairs[a, b] = weights, bias
    return Identifier(families, np.array([w for _, w in fits]).reshape(len(fits), 1 << BITS), np.array([b for b, _ in fits]), pairs)


def identify(model: Identifier, data: np.ndarray) -> tuple[str, float]:
    """Language and score of a text with a letter."""
    x = histogram(data)
    p = 1 / (1 + np.exp(-np.clip(model.family_weights @ x + model.family_bias, -50, 50)))
    k = int(np.argmax(p))
    share, names = float(p[k] / p.sum()), model.families[k][1]
    votes, margins = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for a, b in combinations(names, 2):
        w, c = model.pairs[a, b]
        margin = float(w @ x + c)
        votes[a if margin >= 0 else b] += 1
        margins[a] += margin
        margins[b] -= margin
    best = min(names, key=lambda n: (-votes[n], -margins[n], n))
    certain = 1.0 if len(names) == 1 else 1 / (1 + float(np.exp(-min(max(margins[best] / (len(names) - 1), -30.0), 30.0))))
    return best, share * certain


def identified(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); ``und`` and 0 if a text is null or has no letter,
    or if nothing was learnt. Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"

    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, text):
                column = part.column(part.schema.get_field_index(text))
                data, offsets = H.buffers(column)
                found = []
                for value, a, b in zip(column, offsets[:-1], offsets[1:]):
                    has_letter = b > a and any(c.isalpha() for c in value.as_py())
                    found.append(identify(model, data[a:b]) if has_letter and model.families else (UNKNOWN, 0.0))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    [*columns, "lang_pred", "score"],
                )

    return docs.mapInArrow(run, schema)


def op2_language_id(spark, sf_dir):
    """The language of every document; learnt from those whose crc32(doc_id) mod 5 is not 0."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc_part("doc_id", 5) == 0)
    model = fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identified(docs.select("doc_id", "held_out", "text"), model).drop("text")
