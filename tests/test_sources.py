import mailbox
from email.message import EmailMessage

import pyarrow as pa
from pyspark.sql import functions as F

from msgsieve.operators import clean as C
from msgsieve.sources import corpora, mail, sinks


def test_tsv_with_an_odd_quote(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('ham\t"hello there\nspam\twin " now\nham\tbye\n', encoding="utf-8")
    rows = corpora.scan_tsv(spark, str(tmp_path / "a.tsv")).orderBy("position").collect()
    assert [(r.label, r.text) for r in rows] == [("ham", '"hello there'), ("spam", 'win " now'), ("ham", "bye")]
    assert {(r.source, r.channel) for r in rows} == {("uci_sms", "sms")}


def test_tsv_text_holds_tabs(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("ham\thello there\tand the rest\n\nspam\n", encoding="utf-8")
    rows = corpora.scan_tsv(spark, str(tmp_path / "a.tsv")).orderBy("position").collect()
    assert [(r.label, r.text) for r in rows] == [("ham", "hello there\tand the rest"), ("spam", None)]


def test_flagged_csv(spark, tmp_path):
    text = 'LABEL,TEXT,URL,EMAIL,PHONE\nSmishing,"two\nlines, ""quoted""",Yes,No,No\nham, padded ,No,No,No\n'
    (tmp_path / "b.csv").write_text(text, encoding="utf-8")
    rows = corpora.scan_flagged_csv(spark, str(tmp_path / "b.csv")).orderBy("position").collect()
    assert [(r.label, r.text) for r in rows] == [("phishing", 'two\nlines, "quoted"'), ("ham", " padded ")]


def test_combine_order_decides_the_survivor(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("ham\tthe same message here\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(
        "LABEL,TEXT,URL,EMAIL,PHONE\nsmishing,The same  message here,No,No,No\n", encoding="utf-8"
    )
    parsed = spark.createDataFrame(
        [("body of a mail", None, "f/1", "phishing")], "text string, subject string, source_file string, label string"
    )
    parsed.write.parquet(str(tmp_path / "n"))
    parsed.withColumn("label", F.lit("ham")).write.parquet(str(tmp_path / "s"))
    combined = corpora.combine(
        spark, *[str(tmp_path / p) for p in ("a.tsv", "b.csv", "n", "s")]
    )
    assert combined.count() == 4
    kept = C.dedup_exact(C.clean_text(combined), order=("source_rank", "position")).collect()
    assert sorted((r.source, r.label, r.text) for r in kept) == [
        ("nazario", "phishing", "body of a mail"),
        ("uci_sms", "ham", "the same message here"),
    ]


def mails():
    plain = EmailMessage()
    plain["Subject"] = "hello"
    plain.set_content("a plain body of some length\nFrom here on")
    html = EmailMessage()
    html["Subject"] = "=?utf-8?q?caf=C3=A9?="
    html.set_content("<p>only <b>html</b> in this mail</p>", subtype="html")
    both = EmailMessage()
    both.set_content("the plain side wins here")
    both.add_alternative("<p>html side</p>", subtype="html")
    tiny = EmailMessage()
    tiny.set_content("tiny")
    return [plain, html, both, tiny]


EXPECTED = {
    ("hello", "a plain body of some length\nFrom here on", False, "usable"),
    ("=?utf-8?q?caf=C3=A9?=", "only html in this mail", False, "usable"),
    ("", "the plain side wins here", True, "usable"),
    ("", "tiny", False, "skipped"),
}


def seen(parsed):
    return {(r.subject, r.text.replace(">From", "From"), r.is_multipart, r.status) for r in parsed.collect()}


def test_folders(spark, tmp_path):
    for folder in ("easy_ham", "spam_2", "other"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "cmds").write_bytes(b"mv 1 2")
        for i, m in enumerate(mails()):
            (tmp_path / folder / f"{i:04d}.x").write_bytes(m.as_bytes())
    parsed = mail.load_folders(spark, str(tmp_path)).persist()
    assert seen(parsed) == EXPECTED
    assert {(r.label, r.status): r.n for r in mail.ingest_counts(parsed).collect()} == {
        ("ham", "usable"): 3, ("ham", "skipped"): 1, ("spam", "usable"): 3, ("spam", "skipped"): 1,
    }
    assert {r.source_file.split("/")[0] for r in parsed.collect()} == {"easy_ham", "spam_2"}
    profile = mail.ingest_profile(parsed, "label").where("label = 'ham'").first()
    assert (profile.mails, profile.multipart, profile.simple) == (4, 1, 3)


def test_mbox_as_the_library_reads_it(spark, tmp_path):
    box = mailbox.mbox(str(tmp_path / "x.mbox"))
    for m in mails():
        box.add(m)
    box.close()
    parsed = mail.load_mbox(spark, str(tmp_path / "x.mbox"))
    assert seen(parsed) == EXPECTED
    assert mail.usable(parsed).count() == 3
    assert {r.label for r in parsed.collect()} == {"phishing"}


def test_unparsable_mail_is_counted_not_fatal(spark):
    raw = spark.createDataFrame([("f/1", bytearray(b"\xff\xfe\x00")), ("f/2", bytearray(b""))], "source_file string, content binary")
    assert [r.status for r in mail.parse_mail(raw).collect()] == ["skipped", "skipped"]


def test_metrics_survive_per_experiment(spark, tmp_path):
    path = str(tmp_path / "metrics")
    row = lambda e: spark.createDataFrame(
        [("m", "all", "macro_f1", 0.5, None, e)],
        "model string, slice string, metric string, value double, error string, experiment string",
    )
    sinks.append_metrics(row("E0"), path)
    sinks.append_metrics(row("E1"), path)
    assert sorted(r.experiment for r in sinks.read_metrics(spark, path).collect()) == ["E0", "E1"]


def test_encoded_subjects(spark):
    from msgsieve.functions import text as X

    cases = {
        "=?utf-8?q?caf=C3=A9?=": "café",
        "=?UTF-8?B?w6lww6ll?= tail": "épée tail",
        "Re: =?iso-8859-1?Q?Gr=FC=DFe_an?=\r\n =?iso-8859-1?Q?_alle?=!": "Re: Grüße an alle!",
        "=?windows-1252?Q?5=80_=93x=94?=": "5€ “x”",
        "=?utf-8?Q?split_=C3?= =?utf-8?Q?=A9t=C3=A9?=": "split été",
        "=?utf-8?B?w6k=?= =?iso-8859-1?Q?=E9?=": "éé",
        "=?utf-8?B?w6k?=": "é",
        "=?x-unknown?Q?a=20b?= =?utf-8?q?c?=": "=?x-unknown?Q?a=20b?=c",
        "=?utf-8?B?!!!?= plain": "=?utf-8?B?!!!?= plain",
        "=?utf-8*en?Q?lang?= a = b ?=": "lang a = b ?=",
        "no words here": "no words here",
        "": "",
        "=?utf-8?Q?bad_=FF?=": "bad �",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "s string")
    got = {r.s: r.d for r in df.select("s", X.decode_words(F.col("s")).alias("d")).collect()}
    assert got == {**cases, None: None}
    raw = b"Subject: =?utf-8?q?caf=C3=A9?=\n\nlong enough a body\n"
    mails = spark.createDataFrame([("a/1", bytearray(raw))], "source_file string, content binary")
    assert mail.parse_mail(mails).first().subject == "=?utf-8?q?caf=C3=A9?="
    assert mail.parse_mail(mails, decode_subject=True).first().subject == "café"


def test_position_in_an_mbox(spark, tmp_path):
    for name, n in (("a.mbox", 400), ("b.mbox", 49)):
        text = "".join(f"From x Mon Jan  1 00:00:00 2024\nSubject: {name} {k}\n\nbody number {k} of this file\n\n" for k in range(1, n + 1))
        (tmp_path / name).write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # many splits
    try:
        for position in (1, 50, 399, 400):
            rows = mail.nth_of_mbox(spark, str(tmp_path), position).collect()
            told = sorted(bytes(r.content).decode().split("Subject: ")[1].split("\n")[0] for r in rows)
            assert told == [f"{name} {position}" for name, n in (("a.mbox", 400), ("b.mbox", 49)) if position <= n]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert mail.nth_of_mbox(spark, str(tmp_path), 401).collect() == []


def test_parsed_mails_leave_in_bounded_batches():
    raw = [b"Subject: a\n\n" + b"x" * 400_000, b"Subject: b\n\nshort", None, b"", *[b"Subject: c\n\n" + b"y" * 300_000] * 7]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(raw))]), pa.array(raw, pa.binary())], ["source_file", "content"])
    out = list(mail._parse(iter([batch.slice(0, 5), batch.slice(5)])))
    assert [r for b in out for r in b.column(0).to_pylist()] == [str(i) for i in range(len(raw))]
    assert max(b.nbytes for b in out) < 1_600_000 and len(out) >= 3
    rows = [r for b in out for r in b.to_pylist()]
    assert rows[0]["plain"] == "x" * 400_000 and rows[1]["plain"] == "short" and rows[2]["error"] == "TypeError"
