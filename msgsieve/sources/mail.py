"""Raw mail to rows: folders of single mails, and mboxes split in parallel."""

from __future__ import annotations

import email
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgsieve.functions import text as X
from msgsieve.operators.ranks import pick_position
from msgsieve.schema import MIN_BODY

# Mail folders and their labels.
FOLDER_LABELS = {
    "easy_ham": "ham",
    "easy_ham_2": "ham",
    "hard_ham": "ham",
    "spam": "spam",
    "spam_2": "spam",
}


#: Bytes of mails whose parsed parts a worker holds at a time.
PARSED_BYTES = 1_000_000
_PARSED = pa.schema(
    [("subject", pa.string()), ("plain", pa.string()), ("html", pa.string()), ("is_multipart", pa.bool_()), ("error", pa.string())]
)


def _parts(raw: bytes) -> dict:
    """First plain and first HTML body of one mail, decoded as UTF-8 with replacement."""
    mail = email.message_from_bytes(raw)
    bodies = {"text/plain": None, "text/html": None}
    for part in mail.walk() if mail.is_multipart() else [mail]:
        kind, payload = part.get_content_type(), part.get_payload(decode=True)
        if payload and bodies.get(kind, "") is None:
            bodies[kind] = payload.decode("utf-8", errors="replace")
    # Encoded words in the subject stay as they are.
    subject = mail["Subject"]
    return {
        "subject": "" if subject is None else str(subject),
        "plain": bodies["text/plain"],
        "html": bodies["text/html"],
        "is_multipart": mail.is_multipart(),
        "error": None,
    }


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed mails, given on after each ``PARSED_BYTES``: a worker holds no more, however large its batches are."""
    for batch in batches:
        start, held, rows = 0, 0, []
        for k in range(batch.num_rows):
            raw = batch.column(1)[k].as_py()
            try:
                row = _parts(bytes(raw))
                # Lone surrogates from undecodable headers cannot leave as UTF-8.
                for c in ("subject", "plain", "html"):
                    row[c] = row[c] if row[c] is None else row[c].encode("utf-8", "replace").decode("utf-8")
            except Exception as error:  # noqa: BLE001 - a bad mail is counted, not fatal
                row = {**dict.fromkeys(_PARSED.names), "error": type(error).__name__}
            rows.append(row)
            held += len(raw or b"")
            if held >= PARSED_BYTES or k == batch.num_rows - 1:
                parsed = pa.RecordBatch.from_pylist(rows, _PARSED)
                names = [batch.schema.names[0], *_PARSED.names]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), *parsed.columns], names)
                start, held, rows = k + 1, 0, []


def parse_mail(raw: DataFrame, decode_subject: bool = False) -> DataFrame:
    """``(source_file, content)`` to ``(source_file, subject, text, is_multipart, status)``.

    Only MIME decoding runs in Python. A plain body wins over an HTML one even if it is blank; HTML
    is reduced to text by native expressions. Mails with less than ten characters of body, and mails
    that cannot be parsed, keep their row with status ``skipped``. Encoded words in a subject stay as they are
    unless ``decode_subject`` is set.
    """
    parsed = raw.select("source_file", "content").mapInArrow(
        _parse,
        "source_file string, subject string, plain string, html string, is_multipart boolean, error string",
    )
    body = F.coalesce(
        F.nullif(F.col("plain"), F.lit("")), X.html_to_text(F.col("html")), F.lit("")
    )
    text = X.strip_spaces(body)
    if decode_subject:
        parsed = parsed.withColumn("subject", X.decode_words(F.col("subject")))
    usable = F.col("error").isNull() & (F.length("text") >= MIN_BODY)
    return (
        X.computed_once(parsed, text=text)
        .withColumn("status", F.when(usable, "usable").otherwise("skipped"))
        .select("source_file", "subject", "text", "is_multipart", "status")
    )


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """One row per mail file below ``path/<folder>/``; names not starting with a digit are ignored."""
    # The pattern is applied to the listing, so other files are never opened.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    return files.select(
        F.concat_ws("/", folder, name).alias("source_file"), "content"
    )


def folder_labels(df: DataFrame) -> DataFrame:
    """Add ``label`` by folder; mails of unknown folders are dropped. The lookup has five rows."""
    lookup = df.sparkSession.createDataFrame(list(FOLDER_LABELS.items()), "folder string, label string")
    folder = F.substring_index("source_file", "/", 1)
    return df.withColumn("folder", folder).join(F.broadcast(lookup), "folder").drop("folder")


def load_folders(spark: SparkSession, path: str) -> DataFrame:
    files = read_folders(spark, path)
    folder = F.substring_index("source_file", "/", 1)
    # Mails of other folders are dropped before they are parsed.
    return folder_labels(parse_mail(files.where(folder.isin(list(FOLDER_LABELS)))))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """One row per mail of the mboxes at ``path``.

    The separator line starts a record, so the text reader splits one large mbox over many tasks. The
    marker itself is lost for all but a file's first record; it is put back, because the mail parser
    knows to skip a line that starts with it.
    """
    lines = spark.read.option("lineSep", "\nFrom ").text(path).withColumns(
        # Where a mail stands: the split it was read in, and its place in that.
        {"block": F.col("_metadata.file_block_start"), "place": F.monotonically_increasing_id()}
    )
    record = F.col("value").cast("binary")
    marked = F.when(F.col("value").startswith("From "), record).otherwise(
        F.concat(F.lit(b"From "), record)
    )
    return lines.where(F.length(record) > 0).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"),
        marked.alias("content"),
        "block",
        "place",
    )


def nth_of_mbox(spark: SparkSession, path: str, position: int) -> DataFrame:
    """``(source_file, content)`` of the mail at ``position`` (from 1) of each mbox, in the order of the file."""
    mails = read_mbox(spark, path)
    return pick_position(mails, ["source_file"], "block", "place", position).select("source_file", "content")


def load_mbox(spark: SparkSession, path: str, label: str = "phishing") -> DataFrame:
    return parse_mail(read_mbox(spark, path)).withColumn("label", F.lit(label))


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") == "usable").drop("status", "is_multipart")


def ingest_counts(parsed: DataFrame, by: str = "label") -> DataFrame:
    """Usable and skipped mails per folder, file or label."""
    return parsed.groupBy(by, "status").agg(F.count(F.lit(1)).alias("n"))


def ingest_profile(parsed: DataFrame, by: str = "source_file") -> DataFrame:
    return parsed.groupBy(by).agg(
        F.count(F.lit(1)).alias("mails"),
        F.count_if("is_multipart").alias("multipart"),
        F.count_if(~F.col("is_multipart")).alias("simple"),
    )
