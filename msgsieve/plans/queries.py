"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over the whole tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve.functions import text as X
from msgsieve.functions.signals import SIGNALS_8, SIGNALS_13, url_list as links, with_signals
from msgsieve.operators import (
    bayes as B,
    clean as C,
    evaluate as E,
    explain as L,
    models as M,
    quality as Q,
    ranks as R,
    vectorize as V,
)
from msgsieve.plans import stages as S
from msgsieve.plans.probes import with_probes
from msgsieve.schema import messages, table
from msgsieve.session import scratch_path, stage
from msgsieve.sources import corpora, mail, sinks

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(col: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def _probed(spark: SparkSession, sf: str) -> DataFrame:
    return with_probes(spark, messages(spark, sf))


def _rows(df: DataFrame) -> DataFrame:
    """Message columns in a fixed order, ratio rounded."""
    return rounded(
        df.select("row_id", "text", "source", "channel", "label", "capital_ratio"), "capital_ratio"
    )


# --- sources ---------------------------------------------------------------------------------


@query
def scan_tsv(spark, sf):
    """Write all messages as label<TAB>text lines and scan them back."""
    path = scratch_path(spark, "tsv")
    line = F.concat_ws("\t", "label", X.collapse_spaces(F.col("text")))
    messages(spark, sf).select(line).write.text(path)
    return corpora.scan_tsv(spark, path).select("text", "label", "source", "channel")


@query
def scan_csv(spark, sf):
    """Write all messages as the flagged CSV, raw texts with line breaks, and scan them back."""
    path = scratch_path(spark, "csv")
    label = F.when(F.col("label") == "phishing", "Smishing").otherwise(F.initcap("label"))
    flagged = messages(spark, sf).select(
        label.alias("LABEL"),
        F.col("text").alias("TEXT"),
        F.lit("No").alias("URL"),
        F.lit("No").alias("EMAIL"),
        F.lit("No").alias("PHONE"),
    )
    sinks.export_csv(flagged, path)
    return corpora.scan_flagged_csv(spark, path).select("text", "label", "source", "channel")


@query
def conform(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("lang", "label")
    channel = F.when(F.col("n_chars") < 1000, "sms").otherwise("email")
    return C.conform(docs, F.col("source"), channel, "doc_id")


@query
def label_normalise(spark, sf):
    raw = F.when(F.col("toxic") == 1, "Smishing").when(F.col("quality") == 0, "SPAM").otherwise("Ham")
    labels = table(spark, sf, "labels").withColumn("raw_label", raw)
    return labels.select("doc_id", "raw_label", C.normalise_label(F.col("raw_label")).alias("label"))


def _parsed_mail(spark, sf):
    """Documents in the shape of parsed mail; only some languages have a subject."""
    subject = F.when(F.col("lang").isin("en", "fr"), F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id", "text", subject.alias("subject"), F.col("lang").alias("label")
    )


@query
def conform_mail(spark, sf):
    parsed = _parsed_mail(spark, sf)
    both = [corpora.conform_mail(parsed, s, "doc_id") for s in ("nazario", "spamassassin")]
    return both[0].unionByName(both[1])


@query
def min_body(spark, sf):
    kept = C.min_body(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return kept.select("doc_id", "source", "text")


@query
def folder_label_join(spark, sf):
    names = [*mail.FOLDER_LABELS, "unknown"]
    place = F.pmod(F.col("page_id"), F.lit(len(names))).cast("int")
    folder = F.element_at(F.array(*[F.lit(n) for n in names]), place + 1)
    files = table(spark, sf, "pages").select(
        "page_id", F.concat_ws("/", folder, F.col("page_id").cast("string")).alias("source_file")
    )
    return mail.folder_labels(files)


def _raw_mail(spark, sf):
    """Every document as a raw mail: plain, HTML, plain with HTML, or HTML in a multipart, by
    language. The shape is the one a folder scan gives."""
    text = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><style>p{}</style><p>"), text, F.lit("</p></html>"))
    b64 = lambda c: F.base64(F.encode(c, "UTF-8"))
    head = F.concat(
        F.lit("From: a@example.com\nSubject: "), "source", F.lit("\nMIME-Version: 1.0\n")
    )
    part = lambda kind, c: F.concat(
        F.lit(f"Content-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), b64(c)
    )
    open_, next_, end = "--cut-here\n", "\n--cut-here\n", "\n--cut-here--\n"
    multi = F.lit('Content-Type: multipart/alternative; boundary="cut-here"\n\n')
    body = (
        F.when(F.col("lang") == "en", part("text/plain", F.col("text")))
        .when(F.col("lang") == "fr", part("text/html", html))
        .when(
            F.col("lang") == "de",
            F.concat(
                multi, F.lit(open_), part("text/plain", F.col("text")), F.lit(next_),
                part("text/html", F.lit("<p>not this one</p>")), F.lit(end),
            ),
        )
        .otherwise(F.concat(multi, F.lit(open_), part("text/html", html), F.lit(end)))
    )
    folder = F.when(F.col("lang") == "en", "easy_ham").when(F.col("lang") == "de", "hard_ham").otherwise("spam")
    return table(spark, sf, "documents").select(
        F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("source_file"),
        F.encode(F.concat(head, body), "UTF-8").alias("content"),
    )


@query
def ingest_mail(spark, sf):
    parsed = mail.folder_labels(mail.parse_mail(_raw_mail(spark, sf)))
    return parsed.select("source_file", "subject", "text", "label", "status")


@query
def decode_subject(spark, sf):
    """Every document's opening words as a mail subject in encoded words, some Q, some B, some in several words."""
    part = F.regexp_replace(F.substring("text", 1, 60), r"[^\p{L}\p{N} ]", "")
    raw = F.hex(F.encode(part, "UTF-8"))
    quoted = F.regexp_replace(raw, "(..)", "=$1")
    third = (F.floor(F.length(raw) / 6) * 2).cast("int")  # splits characters, too
    q = lambda c: F.concat(F.lit("=?utf-8?Q?"), F.regexp_replace(c, "(..)", "=$1"), F.lit("?="))
    subject = (
        F.when(F.col("lang") == "en", F.concat(F.lit("=?UTF-8?q?"), quoted, F.lit("?=")))
        .when(F.col("lang") == "fr", F.concat(F.lit("Re: =?utf-8?B?"), F.translate(F.base64(F.encode(part, "UTF-8")), "\r\n", ""), F.lit("?= (fwd)")))
        .otherwise(F.concat(q(F.substring(raw, F.lit(1), third)), F.lit("\r\n "), q(F.substring(raw, third + 1, F.length(raw)))))
    )
    return table(spark, sf, "documents").select("doc_id", X.decode_words(subject).alias("subject"))


def folder_mails(spark, sf):
    folder = F.when(F.col("lang") == "en", "easy_ham").when(F.col("lang") == "de", "hard_ham").otherwise("spam")
    return table(spark, sf, "documents").select("doc_id", folder.alias("folder"), F.col("source").alias("subject"))


@query
def nth_mail(spark, sf):
    """The 50th mail of each folder, in the order of file names."""
    name = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    mails = folder_mails(spark, sf).withColumn("name", name).withColumn("block", F.substring("name", 1, 10))
    return R.pick_position(mails, ["folder"], "block", "name", 50).select("folder", "name", "subject")


@query
def ingest_counts(spark, sf):
    return mail.ingest_counts(mail.folder_labels(mail.parse_mail(_raw_mail(spark, sf))))


@query
def ingest_profile(spark, sf):
    folder = F.substring_index("source_file", "/", 1)
    parsed = mail.parse_mail(_raw_mail(spark, sf)).withColumn("folder", folder)
    return mail.ingest_profile(parsed, "folder")


@query
def ingest_mbox(spark, sf):
    """Write all documents as mboxes, one per task, and ingest them."""
    path = scratch_path(spark, "mbox")
    escaped = F.regexp_replace("text", "(?m)^From ", ">From ")
    mails = table(spark, sf, "documents").select(
        F.concat(
            F.lit("From sender@example.com Mon Jan  1 00:00:00 2024\nMessage-ID: <"),
            F.col("doc_id").cast("string"),
            F.lit(">\nSubject: "),
            "source",
            F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"),
            escaped,
            F.lit("\n"),
        )
    )
    mails.write.text(path)
    return mail.usable(mail.load_mbox(spark, path)).select("subject", "text", "label")


# --- cleaning, sets and aggregates -----------------------------------------------------------


@query
def union_sources(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return Q.union_sources([docs, pages, turns, items])


@query
def clean_text(spark, sf):
    return _rows(C.clean_text(_probed(spark, sf)))


@query
def length_band(spark, sf):
    return C.length_band(table(spark, sf, "documents")).select("doc_id", F.length("text").alias("chars"))


@query
def capital_ratio(spark, sf):
    return _probed(spark, sf).select("row_id", r6(X.capital_ratio(F.col("text"))).alias("capital_ratio"))


@query
def dedup_exact(spark, sf):
    return _rows(C.dedup_exact(C.clean_text(_probed(spark, sf))))


@query
def dedup_conflicts(spark, sf):
    kept = C.dedup_exact(C.clean_text(_probed(spark, sf)), conflicts=True)
    return kept.where(F.col("copies") > 1).select("row_id", "label", "copies", "label_conflict")


@query
def dedup_template(spark, sf):
    return _rows(C.dedup_template(C.repair(C.clean_text(_probed(spark, sf)))))


@query
def prepared_messages(spark, sf):
    return _rows(S.prepared(spark, sf))


@query
def validate_domain(spark, sf):
    """Messages beside raw documents, whose labels and channels are outside the domain."""
    docs = table(spark, sf, "documents").select(
        "text", F.col("lang").alias("label"), "source", F.lit("web").alias("channel")
    )
    known = messages(spark, sf).select("text", "label", "source", "channel")
    return Q.validate(known.unionByName(docs))


@query
def source_overlap(spark, sf):
    docs = table(spark, sf, "documents").withColumn("text", F.lower(X.collapse_spaces(F.col("text"))))
    return Q.source_overlap(docs.select("text", "source"))


@query
def attrition_funnel(spark, sf):
    return C.attrition(_probed(spark, sf))


@query
def label_counts(spark, sf):
    return Q.value_counts(messages(spark, sf), "label")


@query
def source_counts(spark, sf):
    return Q.value_counts(messages(spark, sf), "source")


@query
def crosstab_channel_label(spark, sf):
    return Q.crosstab(C.prepare(messages(spark, sf)))


@query
def describe_capital_ratio(spark, sf):
    stats = Q.describe(C.clean_text(messages(spark, sf)), "capital_ratio")
    return stats.select("statistic", (F.round("value", 3) + F.lit(0.0)).alias("value"))


@query
def labels_per_source(spark, sf):
    return Q.labels_per_source(messages(spark, sf))


@query
def cell_filter(spark, sf):
    return Q.cell(messages(spark, sf)).select("row_id", "label", "channel", "text")


@query
def head_cell(spark, sf):
    return Q.head_of_cell(messages(spark, sf).select("row_id", "label", "channel", "text"))


@query
def first_per_label(spark, sf):
    return Q.first_per_label(messages(spark, sf).select("row_id", "label", "text"))


@query
def sink_roundtrip(spark, sf):
    path = scratch_path(spark, "table")
    sinks.write_table(R.stratified_split(messages(spark, sf)), path, "split")
    return spark.read.parquet(path).select("row_id", "label", "channel", "split", "text")


# --- splits ----------------------------------------------------------------------------------


@query
def stratified_split(spark, sf):
    return R.stratified_split(messages(spark, sf).select("row_id", "label", "channel"))


@query
def split_counts(spark, sf):
    split = R.stratified_split(messages(spark, sf).select("row_id", "label", "channel"))
    return split.groupBy("channel", "label").pivot("split", ["train", "test"]).count().na.fill(0)


@query
def kfold_assign(spark, sf):
    return R.kfold(messages(spark, sf).select("row_id", "label"))


# --- scalar text functions -------------------------------------------------------------------


def _signal_input(spark, sf):
    """Messages, raw pages and probes, cleaned and lower-cased, with the ratio saved before."""
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("row_id"),
        F.col("html").alias("text"),
        F.lit("page").alias("source"),
        F.lit(0).alias("source_rank"),
        F.lit("email").alias("channel"),
        F.lit("ham").alias("label"),
    )
    rows = _probed(spark, sf).unionByName(pages)
    clean = X.computed_once(rows.select("row_id", "source", "text"), text=X.collapse_spaces(F.col("text")))
    return clean.select(
        "row_id",
        "source",
        F.lower("text").alias("text"),
        X.capital_ratio(F.col("text")).alias("capital_ratio"),
    )


@query
def signals_13(spark, sf):
    """All signals from the text alone: the ratio is that of lower-cased text."""
    rows = with_signals(_signal_input(spark, sf).drop("capital_ratio"))
    return rows.select("row_id", "source", *SIGNALS_13)


@query
def signals_8(spark, sf):
    """The first eight signals with the saved ratio in place of the recomputed one."""
    rows = with_signals(_signal_input(spark, sf), ratio="capital_ratio")
    return rounded(rows.select("row_id", "source", *SIGNALS_8), "capital_ratio")


@query
def url_list(spark, sf):
    rows = links(_signal_input(spark, sf))
    return rows.select("row_id", "source", F.posexplode("urls").alias("pos", "url"))


@query
def strip_years(spark, sf):
    return _signal_input(spark, sf).select("row_id", "source", X.strip_years(F.col("text")).alias("text"))


@query
def strip_confounds(spark, sf):
    return _signal_input(spark, sf).select(
        "row_id", "source", X.strip_confounds(F.col("text")).alias("text")
    )


@query
def fix_encoding(spark, sf):
    return _signal_input(spark, sf).select("row_id", "source", X.fix_encoding(F.col("text")).alias("text"))


@query
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


# --- vectors ---------------------------------------------------------------------------------


@query
def word_ngrams(spark, sf):
    return V.token_rows(S.prepared(spark, sf), "word", "row_id").select(
        "row_id", "term", F.col("tf").cast("long").alias("tf")
    )


@query
def char_ngrams(spark, sf):
    return V.token_rows(S.prepared(spark, sf), "char", "row_id").select(
        "row_id", "term", F.col("tf").cast("long").alias("tf")
    )


@query
def vocab_word(spark, sf):
    return V.vocabulary(S.train_rows(spark, sf), "word").select("term", "df", "tf")


@query
def vocab_char(spark, sf):
    return V.vocabulary(S.train_rows(spark, sf), "char").select("term", "df", "tf")


def _tfidf(spark, sf, kind):
    rows = V.tfidf_rows(S.prepared(spark, sf), S.vocab(spark, sf, kind), kind)
    return rounded(rows, "tfidf")


@query
def tfidf_word(spark, sf):
    return _tfidf(spark, sf, "word")


@query
def tfidf_char(spark, sf):
    return _tfidf(spark, sf, "char")


@query
def scale_signals(spark, sf):
    rows = with_signals(S.prepared(spark, sf), ratio="capital_ratio")
    train = rows.where(F.col("split") == "train")
    return rounded(V.scale_signals(rows, train, SIGNALS_13, "row_id", "split"), *SIGNALS_13)


def _features(spark, sf, spec):
    names = V.feature_names(S.feature_model(spark, sf, spec))
    rows = sinks.feature_rows(spark, S.feature_path(spark, sf, spec), names, "row_id")
    return rounded(rows, "value").where(F.col("value") != 0)


@query
def features_word_char(spark, sf):
    return _features(spark, sf, V.FeatureSpec(char=True))


@query
def features_full(spark, sf):
    return _features(spark, sf, M.FULL_13)


@query
def feature_names(spark, sf):
    names = V.feature_names(S.feature_model(spark, sf, M.FULL_13))
    return spark.createDataFrame(list(enumerate(names)), "idx int, name string")


# --- models ----------------------------------------------------------------------------------


@query
def class_weights(spark, sf):
    return rounded(B.class_weights(S.train_rows(spark, sf)), "weight")


@query
def nb_fit(spark, sf):
    return rounded(S.bayes_weights(spark, sf, False), "ham", "phishing", "spam")


def _scores(spark, sf, complement):
    return S.bayes_scores(spark, sf, complement).drop("text")


@query
def nb_predict(spark, sf):
    return _scores(spark, sf, False)


@query
def cnb_predict(spark, sf):
    return _scores(spark, sf, True)


@query
def lr_fit(spark, sf):
    """Test predictions and probabilities of the unweighted logistic model."""
    scored = S.test_predictions(spark, sf, M.WORD, "LogisticRegression")
    return M.with_probabilities(scored).drop("features", "split", "label_index")


@query
def lr_balanced(spark, sf):
    scored = S.test_predictions(spark, sf, M.FULL_8, "LogisticRegression_balanced")
    return M.with_probabilities(scored).drop("features", "split", "label_index")


@query
def svc_predict(spark, sf):
    return S.test_predictions(spark, sf, M.WORD, "LinearSVC").drop("features", "split")


@query
def svc_balanced(spark, sf):
    return S.test_predictions(spark, sf, M.WORD, "LinearSVC_balanced").drop("features", "split")


def _cv(spark, sf):
    return stage(spark, sf, "cv", lambda: M.cross_validate(R.kfold(S.train_rows(spark, sf)), M.TUNED))


@query
def cv_grid(spark, sf):
    return _cv(spark, sf)


@query
def cv_summary(spark, sf):
    return M.cv_summary(_cv(spark, sf))


@query
def tune(spark, sf):
    """Test predictions of the model that the best setting of the grid gives, refitted on the whole training split."""
    _, c, pipeline, model = M.tune(R.kfold(S.train_rows(spark, sf)), M.TUNED, scores=_cv(spark, sf))
    scored = model.predict(pipeline.transform(S.test_rows(spark, sf)).select("row_id", "channel", "label", "features"))
    return M.with_probabilities(scored).drop("features").withColumn("c", F.lit(c))


def _stored(spark, sf):
    return lambda spec, solver: S.test_predictions(spark, sf, spec, solver)


@query
def experiment_matrix(spark, sf):
    train, test = S.train_rows(spark, sf), S.test_rows(spark, sf)
    return M.run_experiments(train, test, M.RUN_2, _stored(spark, sf), sink=scratch_path(spark, "experiments"))


@query
def ablation(spark, sf):
    return M.ablations(S.train_rows(spark, sf), S.test_rows(spark, sf), predict=_stored(spark, sf))


@query
def score_reload(spark, sf):
    """Save the feature pipeline and the classifier, load them, and score the test rows."""
    path = scratch_path(spark, "model")
    classifier = S.fitted(spark, sf, M.FULL_8, "LogisticRegression_balanced").model
    sinks.save_model(PipelineModel([S.feature_model(spark, sf, M.FULL_8), classifier, M.label_names()]), path)
    scored = sinks.load_model(path).transform(S.test_rows(spark, sf))
    return M.with_probabilities(scored).select("row_id", "label", "prediction", "p_ham", "p_phishing", "p_spam")


@query
def models_reload(spark, sf):
    """All five models with their feature pipeline, saved, loaded, and the test rows as the loaded ones predict them."""
    return stage(spark, sf, "reloaded", lambda: S.reloaded_predictions(spark, sf))


@query
def leaderboard_all(spark, sf):
    """The five models side by side, best first."""
    return E.leaderboard(E.counts(models_reload(spark, sf), "model"))


@query
def best_of_all(spark, sf):
    return E.best_model(E.counts(models_reload(spark, sf), "model"))


# --- evaluation ------------------------------------------------------------------------------


def _cells(spark, sf):
    return E.counts(S.predictions(spark, sf), "model")


@query
def confusion_matrix(spark, sf):
    return E.confusion_matrix(_cells(spark, sf), "model")


@query
def class_report(spark, sf):
    return rounded(E.class_report(_cells(spark, sf), "model"), "precision", "recall", "f1")


@query
def macro_f1(spark, sf):
    rows = E.summary(_cells(spark, sf), "model").where(F.col("slice") == E.ALL)
    return rounded(rows.select("model", "macro_f1", "weighted_f1", "accuracy"), "macro_f1", "weighted_f1", "accuracy")


@query
def macro_f1_by_channel(spark, sf):
    return rounded(E.summary(_cells(spark, sf), "model").select("model", "slice", "macro_f1", "n"), "macro_f1")


@query
def class_pr(spark, sf):
    return rounded(E.class_scores(_cells(spark, sf), "model"), "precision", "recall")


@query
def cell_recall(spark, sf):
    return rounded(E.cell_recall(_cells(spark, sf), "model"), "recall")


@query
def leaderboard(spark, sf):
    return rounded(E.leaderboard(_cells(spark, sf)), "macro_f1", "email_macro_f1", "sms_macro_f1")


@query
def best_model(spark, sf):
    return rounded(E.best_model(_cells(spark, sf)), "macro_f1", "email_macro_f1", "sms_macro_f1")


@query
def error_triage(spark, sf):
    return E.error_triage(S.predictions(spark, sf), "model")


@query
def metrics_rows(spark, sf):
    rows = sinks.read_metrics(spark, S.metrics_sink(spark, sf))
    return rounded(rows.select("experiment", "model", "slice", "metric", "value"), "value")


# --- explanation -----------------------------------------------------------------------------


@query
def top_features_nb(spark, sf):
    """Top terms per class of the closed-form model."""
    rows = rounded(S.bayes_weights(spark, sf, True), "ham", "phishing", "spam").select(
        F.concat(F.lit("word:"), "term").alias("feature"),
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("weight")) for c in ("ham", "phishing", "spam")])
        ),
    )
    return E.top_per_class(rows)


@query
def top_features(spark, sf):
    return E.top_per_class(S.weights(spark, sf, M.FULL_8))


@query
def signal_weights(spark, sf):
    return L.signal_weights(S.weights(spark, sf, M.FULL_13))


@query
def artefact_audit(spark, sf):
    stripped = dict(M.ABLATIONS["confounds"])["B_confounds_stripped"]
    return L.artefact_audit(S.weights(spark, sf, M.FULL_8), S.weights(spark, sf, stripped))


@query
def explain_messages(spark, sf):
    """Why the word model says what it says, for every message of the test split."""
    return L.explain(S.test_rows(spark, sf), S.text_model(spark, sf, M.WORD), ["row_id"])


@query
def explain_messages_full(spark, sf):
    """The same for the full model: words, characters and signals of every copy."""
    return L.explain(S.test_rows(spark, sf), S.text_model(spark, sf, M.FULL_8), ["row_id"])


def _scored_turns(spark, sf):
    """Prediction and confidences for a table of new messages: all conversation turns."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return S.scorer(spark, sf, M.FULL_8)(C.repair(C.for_scoring(turns)))


@query
def score_messages(spark, sf):
    return _scored_turns(spark, sf).select("conv_id", "turn", "prediction", "p_ham", "p_phishing", "p_spam")


@query
def score_with_reasons(spark, sf):
    """The same messages with the eight strongest words of each under the full model."""
    scored = _scored_turns(spark, sf).select("conv_id", "turn", "text", "prediction", "p_ham", "p_phishing", "p_spam")
    return L.score_with_reasons(scored, S.text_model(spark, sf, M.FULL_8), ["conv_id", "turn"])
