"""The same queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from msgsieve.functions import signals as G
from msgsieve.functions.signals import SIGNALS_8, SIGNALS_13
from msgsieve.functions.text import _CP1252, _LATIN1, MOJIBAKE, SEQUENCES, SOURCE_PATTERN, YEAR_PATTERN
from msgsieve.functions.tokens import STOP_WORDS, WORD_PATTERN
from msgsieve.plans.probes import probe_rows
from msgsieve.schema import LABELS, MAX_DF, MAX_FEATURES, MIN_DF, SEED, TEST_SHARE
from msgsieve.sources.mail import FOLDER_LABELS


# Every character that Python's ``\s`` matches, spelled out for an ASCII engine.
SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replace_all(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(by)}, 'g')"


def collapse(expr: str) -> str:
    return f"trim({replace_all(expr, SPACE + '+', ' ')}, ' ')"


def strip(expr: str) -> str:
    return replace_all(expr, f"^{SPACE}+|{SPACE}+$", "")


def ratio(expr: str) -> str:
    letters = f"length({replace_all(expr, chr(92) + 'P{L}', '')})"
    capitals = f"length({replace_all(expr, chr(92) + 'P{Lu}', '')})"
    return f"coalesce(CAST({capitals} AS DOUBLE) / nullif({letters}, 0), 0.0)"


def repaired(expr: str) -> str:
    for found in SEQUENCES:
        latin = f"string_split(translate(s, {q(_CP1252 + 'ÿ')}, {q(_LATIN1 + chr(0x9F))}), '')"
        as_bytes = f"unhex(array_to_string(list_transform({latin}, lambda c: printf('%02x', ord(c))), ''))"
        step = f"lambda acc, s: replace(acc, s, coalesce(TRY(decode({as_bytes})), s))"
        expr = f"list_reduce([{expr}] || list_distinct(regexp_extract_all({expr}, {q(found)})), {step})"
    for bad, good in MOJIBAKE.items():
        expr = f"replace({expr}, {q(bad)}, {q(good)})"
    return expr


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- common tables ---------------------------------------------------------------------------

MESSAGES = """messages AS (
  SELECT d.doc_id AS row_id, d.text, d.source,
         CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS INTEGER) AS source_rank,
         CASE WHEN d.n_chars < 1000 THEN 'sms' ELSE 'email' END AS channel,
         CASE WHEN l.toxic = 1 THEN 'phishing' WHEN l.quality = 0 THEN 'spam' ELSE 'ham' END AS label
  FROM documents d JOIN labels l USING (doc_id))"""

PROBES = (
    "probes(row_id, text, source, source_rank, channel, label) AS (VALUES "
    + ", ".join(
        f"(CAST({i} AS BIGINT), {q(t)}, {q(s)}, {r}, {q(c)}, {q(label)})"
        for i, t, s, r, c, label in probe_rows()
    )
    + ")"
)
PROBED = "probed AS (SELECT * FROM messages UNION ALL SELECT * FROM probes)"


def cleaned(source: str) -> str:
    return f"""banded AS (
  SELECT * FROM (SELECT * REPLACE ({collapse('text')} AS text) FROM {source} WHERE text IS NOT NULL)
  WHERE length(text) BETWEEN 10 AND 10000),
clean AS (
  SELECT row_id, lower(text) AS text, source, source_rank, channel, label,
         {ratio('text')} AS capital_ratio FROM banded),
exact AS (
  SELECT * FROM clean
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY source_rank, row_id) = 1),
final AS (
  SELECT * FROM (SELECT * REPLACE ({repaired('text')} AS text) FROM exact)
  QUALIFY row_number() OVER (PARTITION BY {replace_all('text', '[0-9]+', '0')}
                             ORDER BY source_rank, row_id) = 1)"""


ROWS = f"SELECT row_id, text, source, channel, label, {r6('capital_ratio')} AS capital_ratio FROM "


def split(source: str) -> str:
    return f"""strata AS (
  SELECT label, channel, count(*) AS n FROM {source} GROUP BY ALL),
shares AS (
  SELECT *, sum(n) OVER () AS total,
         sum(n) OVER () - CAST(ceil(CAST({TEST_SHARE} AS DOUBLE) * sum(n) OVER ()) AS BIGINT) AS train
  FROM strata),
floors AS (
  SELECT *, CAST(n * train AS BIGINT) // CAST(total AS BIGINT) AS low,
         CAST(n * train AS BIGINT) % CAST(total AS BIGINT) AS rest FROM shares),
quotas AS (
  SELECT label, channel,
         low + CASE WHEN row_number() OVER (ORDER BY rest DESC, label, channel)
                         <= train - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM floors),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY label, channel
                                 ORDER BY md5('{SEED}:' || row_id), row_id) AS place
  FROM {source} s),
parted AS (
  SELECT r.* EXCLUDE (place), CASE WHEN place <= quota THEN 'train' ELSE 'test' END AS split
  FROM ranked r JOIN quotas USING (label, channel))"""


PREPARED = ",\n".join([MESSAGES, cleaned("messages"), split("final")])
STOPS = ", ".join(q(w) for w in STOP_WORDS)

WORD_TOKENS = f"""word_lists AS (
  SELECT row_id, label, split,
         [w FOR w IN regexp_extract_all(lower(text), {q(WORD_PATTERN)}) IF w NOT IN ({STOPS})] AS words
  FROM parted),
word_all AS (
  SELECT row_id, label, split, unnest(words) AS term FROM word_lists
  UNION ALL
  SELECT row_id, label, split, words[i] || ' ' || words[i + 1]
  FROM (SELECT *, unnest(range(1, greatest(len(words), 1))) AS i FROM word_lists)),
word_tf AS (
  SELECT row_id, label, split, term, count(*) AS tf FROM word_all GROUP BY ALL)"""

CHAR_TOKENS = """pads AS (
  SELECT row_id, label, split, ' ' || unnest(regexp_extract_all(lower(text), '[^ ]+')) || ' ' AS pad
  FROM parted),
sizes AS (
  SELECT *, unnest(range(3, least(5, length(pad)) + 1)) AS n FROM pads),
starts AS (
  SELECT *, unnest(range(1, length(pad) + 2 - n)) AS i FROM sizes),
char_tf AS (
  SELECT row_id, label, split, substring(pad, i, n) AS term, count(*) AS tf FROM starts
  GROUP BY row_id, label, split, substring(pad, i, n))"""


def vocab(kind: str) -> str:
    share = f"AND df <= {MAX_DF} * n_docs" if kind == "word" else ""
    return f"""{kind}_size AS (SELECT count(*) AS n_docs FROM parted WHERE split = 'train'),
{kind}_vocab AS (
  SELECT term, df, tf, n_docs, ln((1.0 + n_docs) / (1.0 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf
        FROM {kind}_tf WHERE split = 'train' GROUP BY term), {kind}_size
  WHERE df >= {MIN_DF} {share}
  ORDER BY tf DESC, term LIMIT {MAX_FEATURES})"""


def tfidf(kind: str) -> str:
    return f"""{kind}_raw AS (
  SELECT t.row_id, t.label, t.split, t.term, t.tf * v.idf AS w
  FROM {kind}_tf t JOIN {kind}_vocab v USING (term)),
{kind}_tfidf AS (
  SELECT row_id, label, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS tfidf
  FROM {kind}_raw)"""


WORD = ",\n".join([WORD_TOKENS, vocab("word"), tfidf("word")])
CHAR = ",\n".join([CHAR_TOKENS, vocab("char"), tfidf("char")])

# --- signals ---------------------------------------------------------------------------------

# RE2 has ASCII word characters only; a non-ASCII letter becomes one that no pattern's letters hold.
SHIM = r"[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"


def signal_sql(given_ratio: str) -> dict[str, str]:
    flag = lambda p: f"CAST(regexp_matches(shim, {q(p)}) AS INTEGER)"
    number = lambda p: f"CAST(len(regexp_extract_all(shim, {q(p)})) AS INTEGER)"
    return {
        "url_count": number(G.URL_PATTERN),
        "has_url": f"CAST(len(regexp_extract_all(shim, {q(G.URL_PATTERN)})) > 0 AS INTEGER)",
        "has_shortened_url": flag(G.SHORTENER_PATTERN),
        "has_phone": flag(G.PHONE_PATTERN),
        "has_shortcode": flag(G.SHORTCODE_PATTERN),
        "exclamation_count": number("!"),
        "currency_count": number(G.CURRENCY_PATTERN),
        "capital_ratio": given_ratio,
        "has_ip_url": flag(G.IP_URL_PATTERN),
        "has_suspicious_tld": flag(G.SUSPICIOUS_TLD_PATTERN),
        "has_lookalike": flag(G.LOOKALIKE_PATTERN),
        "longest_url_len": "CAST(coalesce(list_max([length(u) FOR u IN urls]), 0) AS INTEGER)",
        "max_url_dots": (
            "CAST(coalesce(list_max([length(u) - length(replace(u, '.', '')) FOR u IN urls]), 0) AS INTEGER)"
        ),
    }


def shimmed(source: str, name: str = "shimmed") -> str:
    return f"""{name} AS (
  SELECT *, regexp_extract_all(shim, {q(G.URL_GRAB)}, 1) AS urls
  FROM (SELECT *, {replace_all('text', SHIM, '_')} AS shim FROM {source}))"""


SIGNAL_INPUT = ",\n".join(
    [
        MESSAGES,
        PROBES,
        PROBED,
        f"""signal_input AS (
  SELECT row_id, source, lower(text) AS text, {ratio('text')} AS capital_ratio
  FROM (SELECT row_id, source, {collapse('text')} AS text FROM probed
        UNION ALL SELECT page_id, 'page', {collapse('html')} FROM pages))""",
        shimmed("signal_input"),
    ]
)


def signal_select(names, given_ratio: str, *keep: str) -> str:
    exprs = signal_sql(given_ratio)
    return "SELECT " + ", ".join([*keep, *[f"{exprs[n]} AS {n}" for n in names]])


SCALED = ",\n".join(
    [
        PREPARED,
        shimmed("parted"),
        f"signals AS ({signal_select(SIGNALS_13, 'capital_ratio', 'row_id', 'split')} FROM shimmed)",
        "bounds AS (SELECT "
        + ", ".join(f"min({n}) AS lo_{n}, max({n}) AS hi_{n}" for n in SIGNALS_13)
        + " FROM signals WHERE split = 'train')",
        "scaled AS (SELECT row_id, split, "
        + ", ".join(
            f"coalesce((CAST({n} AS DOUBLE) - lo_{n}) / nullif(hi_{n} - lo_{n}, 0), {n} - lo_{n}) AS {n}"
            for n in SIGNALS_13
        )
        + " FROM signals, bounds)",
    ]
)

# --- closed-form models ----------------------------------------------------------------------

NB = f"""class_sums AS (
  SELECT v.term, {', '.join(f"coalesce(sum(t.tfidf) FILTER (t.label = '{c}'), 0.0) AS {c}" for c in LABELS)}
  FROM word_vocab v LEFT JOIN (SELECT * FROM word_tfidf WHERE split = 'train') t USING (term)
  GROUP BY v.term),
nb_mass AS (SELECT term, {', '.join(f"{c} + 1 AS {c}" for c in LABELS)} FROM class_sums),
cnb_mass AS (
  SELECT term, {', '.join(f"{' + '.join(LABELS)} - {c} + 1 AS {c}" for c in LABELS)} FROM class_sums),
nb_weights AS (
  SELECT term, {', '.join(f"ln({c} / sum({c}) OVER ()) AS {c}" for c in LABELS)} FROM nb_mass),
cnb_weights AS (
  SELECT term, {', '.join(f"-ln({c} / sum({c}) OVER ()) AS {c}" for c in LABELS)} FROM cnb_mass),
priors AS (
  SELECT {', '.join(f"ln(nullif(count(*) FILTER (label = '{c}'), 0) / CAST(count(*) AS DOUBLE)) AS {c}" for c in LABELS)}
  FROM parted WHERE split = 'train')"""


def scored(name: str) -> str:
    """Scores and prediction of the test rows; only the multinomial model has priors."""
    priors, prior = "", {c: "0.0" for c in LABELS}
    if name == "nb":
        priors = ", priors p"
        prior = {c: f"coalesce(p.{c}, CAST('-infinity' AS DOUBLE))" for c in LABELS}
    best = f"greatest({', '.join(f'{c}_score' for c in LABELS)})"
    return f"""{name}_added AS (
  SELECT t.row_id, {', '.join(f"sum(t.tfidf * w.{c}) AS {c}" for c in LABELS)}
  FROM word_tfidf t JOIN {name}_weights w USING (term) WHERE t.split = 'test' GROUP BY t.row_id),
{name}_scores AS (
  SELECT m.row_id, m.channel, m.label, m.text,
         {', '.join(f"{r6(f'coalesce(a.{c}, 0.0) + {prior[c]}')} AS {c}_score" for c in LABELS)}
  FROM (parted m LEFT JOIN {name}_added a ON a.row_id = m.row_id){priors} WHERE m.split = 'test'),
{name}_predicted AS (
  SELECT *, CASE {' '.join(f"WHEN {c}_score = {best} THEN '{c}'" for c in LABELS)} END AS prediction
  FROM {name}_scores)"""


MODEL = ",\n".join([PREPARED, WORD, NB])
PREDICTED = ",\n".join(
    [
        MODEL,
        scored("nb"),
        scored("cnb"),
        """predictions AS (
  SELECT 'MultinomialNB' AS model, * FROM nb_predicted
  UNION ALL SELECT 'ComplementNB', * FROM cnb_predicted)""",
    ]
)

METRICS = """sliced AS (
  SELECT *, 'all' AS slice FROM predictions UNION ALL SELECT *, channel FROM predictions),
seen AS (
  SELECT DISTINCT model, slice, label FROM sliced
  UNION SELECT DISTINCT model, slice, prediction FROM sliced),
tallies AS (
  SELECT s.model, s.slice, s.label,
         count(*) FILTER (p.label = s.label AND p.prediction = s.label) AS hit,
         count(*) FILTER (p.label = s.label) AS support,
         count(*) FILTER (p.prediction = s.label) AS predicted
  FROM seen s JOIN sliced p ON p.model = s.model AND p.slice = s.slice GROUP BY ALL),
classes AS (
  SELECT model, slice, label, hit, support,
         coalesce(CAST(hit AS DOUBLE) / nullif(predicted, 0), 0.0) AS "precision",
         coalesce(CAST(hit AS DOUBLE) / nullif(support, 0), 0.0) AS recall,
         coalesce(2.0 * hit / nullif(support + predicted, 0), 0.0) AS f1 FROM tallies),
summary AS (
  SELECT model, slice, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
         sum(hit) / CAST(sum(support) AS DOUBLE) AS accuracy, CAST(sum(support) AS BIGINT) AS n
  FROM classes GROUP BY ALL),
cell AS (
  SELECT model, count(*) FILTER (label = prediction) / CAST(count(*) AS DOUBLE) AS recall, count(*) AS n
  FROM predictions WHERE channel = 'sms' AND label = 'phishing' GROUP BY model),
board AS (
  SELECT model, max(macro_f1) FILTER (slice = 'all') AS macro_f1,
         max(macro_f1) FILTER (slice = 'email') AS email_macro_f1,
         max(macro_f1) FILTER (slice = 'sms') AS sms_macro_f1 FROM summary GROUP BY model)"""
EVALUATED = PREDICTED + ",\n" + METRICS


def board(tail: str = "") -> str:
    cols = ", ".join(f"{r6(c)} AS {c}" for c in ("macro_f1", "email_macro_f1", "sms_macro_f1"))
    return with_(EVALUATED) + f"SELECT model, {cols} FROM board {tail}"


def folder_of(lang: str) -> str:
    return f"CASE {lang} WHEN 'en' THEN 'easy_ham' WHEN 'de' THEN 'hard_ham' ELSE 'spam' END"


# HTML bodies come back with collapsed whitespace, plain ones stripped only.
MAIL = f"""mails AS (
  SELECT {folder_of('lang')} AS folder, doc_id, source AS subject, lang,
         CASE WHEN lang IN ('en', 'de') THEN {strip('text')} ELSE {collapse('text')} END AS text
  FROM documents),
parsed AS (
  SELECT *, CASE WHEN length(text) >= 10 THEN 'usable' ELSE 'skipped' END AS status,
         CASE WHEN folder LIKE '%ham%' THEN 'ham' ELSE 'spam' END AS label FROM mails)"""

FOLDERS = [*FOLDER_LABELS, "unknown"]


def oracle_sql() -> dict[str, str]:
    out = {}
    out["scan_tsv"] = (
        with_(MESSAGES)
        + f"SELECT {collapse('text')} AS text, label, 'uci_sms' AS source, 'sms' AS channel FROM messages"
    )
    out["scan_csv"] = (
        with_(MESSAGES) + "SELECT text, label, 'mishra_sms' AS source, 'sms' AS channel FROM messages"
    )
    out["conform"] = """SELECT doc_id, text, lang AS label, source,
      CASE WHEN n_chars < 1000 THEN 'sms' ELSE 'email' END AS channel FROM documents"""
    out["label_normalise"] = """SELECT doc_id,
      CASE WHEN toxic = 1 THEN 'Smishing' WHEN quality = 0 THEN 'SPAM' ELSE 'Ham' END AS raw_label,
      CASE WHEN toxic = 1 THEN 'phishing' WHEN quality = 0 THEN 'spam' ELSE 'ham' END AS label FROM labels"""
    folded = """SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN source ELSE '' END || ' ' || text AS text,
      lang AS label, '{0}' AS source, 'email' AS channel FROM documents"""
    out["conform_mail"] = folded.format("nazario") + " UNION ALL " + folded.format("spamassassin")
    out["min_body"] = f"""SELECT * FROM (SELECT doc_id, source, {strip('text')} AS text FROM documents)
      WHERE length(text) >= 10"""
    cases = " ".join(f"WHEN {i} THEN {q(f)}" for i, f in enumerate(FOLDERS))
    known = " ".join(f"WHEN {q(f)} THEN {q(label)}" for f, label in FOLDER_LABELS.items())
    out["folder_label_join"] = f"""SELECT page_id, folder || '/' || page_id AS source_file,
      CASE folder {known} END AS label
      FROM (SELECT page_id, CASE page_id % {len(FOLDERS)} {cases} END AS folder FROM pages)
      WHERE folder <> 'unknown'"""
    opening = "regexp_replace(substr(text, 1, 60), '[^\\p{L}\\p{N} ]', '', 'g')"
    out["decode_subject"] = (
        f"SELECT doc_id, CASE WHEN lang = 'fr' THEN 'Re: ' || {opening} || ' (fwd)' ELSE {opening} END AS subject FROM documents"
    )
    out["nth_mail"] = f"""SELECT {folder_of('lang')} AS folder, lpad(doc_id::VARCHAR, 12, '0') AS name, source AS subject
        FROM documents QUALIFY row_number() OVER (PARTITION BY folder ORDER BY name) = 50"""
    out["ingest_mail"] = (
        with_(MAIL)
        + "SELECT folder || '/' || doc_id AS source_file, subject, text, label, status FROM parsed"
    )
    out["ingest_counts"] = with_(MAIL) + "SELECT label, status, count(*) AS n FROM parsed GROUP BY ALL"
    out["ingest_profile"] = (
        with_(MAIL)
        + """SELECT folder, count(*) AS mails, count(*) FILTER (lang NOT IN ('en', 'fr')) AS multipart,
      count(*) FILTER (lang IN ('en', 'fr')) AS simple FROM parsed GROUP BY folder"""
    )
    escaped = replace_all("text", "(?m)^From ", ">From ")
    out["ingest_mbox"] = f"""SELECT * FROM (
      SELECT source AS subject, {strip(escaped)} AS text, 'phishing' AS label FROM documents)
      WHERE length(text) >= 10"""
    out["union_sources"] = """SELECT doc_id AS id, text, CAST(0 AS INTEGER) AS source_rank FROM documents
      UNION ALL SELECT page_id, html, 1 FROM pages
      UNION ALL SELECT conv_id, text, 2 FROM conversations
      UNION ALL SELECT item_id, text, 3 FROM benchmark"""
    probed = with_(MESSAGES, PROBES, PROBED, cleaned("probed"))
    out["clean_text"] = probed + ROWS + "clean"
    out["length_band"] = """SELECT doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents
      WHERE length(text) BETWEEN 10 AND 10000"""
    out["capital_ratio"] = (
        with_(MESSAGES, PROBES, PROBED) + f"SELECT row_id, {r6(ratio('text'))} AS capital_ratio FROM probed"
    )
    out["dedup_exact"] = probed + ROWS + "exact"
    out["dedup_conflicts"] = (
        probed
        + """SELECT arg_min(row_id, CAST(source_rank AS BIGINT) * 1000000000 + row_id) AS row_id,
      arg_min(label, CAST(source_rank AS BIGINT) * 1000000000 + row_id) AS label, count(*) AS copies,
      CAST(min(label) <> max(label) AS INTEGER) AS label_conflict
      FROM clean GROUP BY text HAVING count(*) > 1"""
    )
    out["dedup_template"] = probed + ROWS + "final"
    out["prepared_messages"] = with_(MESSAGES, cleaned("messages")) + ROWS + "final"
    out["validate_domain"] = (
        with_(
            MESSAGES,
            """rows AS (SELECT text, label, source, channel FROM messages
      UNION ALL SELECT text, lang, source, 'web' FROM documents)""",
        )
        + "".join(
            f"SELECT 'missing_{c}' AS \"check\", '' AS value, count(*) FILTER ({c} IS NULL) AS n FROM rows UNION ALL "
            for c in ("text", "label", "source", "channel")
        )
        + """SELECT 'short_text', '', count(*) FILTER (length(text) < 5) FROM rows
      UNION ALL SELECT 'unknown_label', label, count(*) FROM rows
        WHERE label NOT IN ('ham', 'phishing', 'spam') GROUP BY label
      UNION ALL SELECT 'unknown_channel', channel, count(*) FROM rows
        WHERE channel NOT IN ('email', 'sms') GROUP BY channel"""
    )
    out["source_overlap"] = f"""WITH held AS (
      SELECT DISTINCT lower({collapse('text')}) AS text, source FROM documents)
      SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared_texts
      FROM held a JOIN held b ON a.text = b.text AND a.source < b.source GROUP BY ALL"""
    steps = [
        ("raw", "SELECT count(*) FROM probed"),
        ("text_present", "SELECT count(text) FROM probed"),
        ("text_not_empty", f"SELECT count(*) FROM probed WHERE length({collapse('text')}) > 0"),
        ("length_band", "SELECT count(*) FROM clean"),
        ("exact_dedup", "SELECT count(*) FROM exact"),
        ("template_dedup", "SELECT count(*) FROM final"),
    ]
    out["attrition_funnel"] = (
        probed
        + "SELECT step, stage, rows, coalesce(lag(rows) OVER (ORDER BY step) - rows, 0) AS lost FROM ("
        + " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS step, '{name}' AS stage, ({sql}) AS rows"
            for i, (name, sql) in enumerate(steps)
        )
        + ")"
    )
    for c in ("label", "source"):
        out[f"{c}_counts"] = with_(MESSAGES) + f"SELECT {c}, count(*) AS n FROM messages GROUP BY {c}"
    counted = ", ".join(f"count(*) FILTER (label = '{c}') AS {c}" for c in LABELS)
    out["crosstab_channel_label"] = (
        with_(MESSAGES, cleaned("messages")) + f"SELECT channel, {counted} FROM final GROUP BY channel"
    )
    stats = [
        ("count", "count(capital_ratio)"),
        ("mean", "avg(capital_ratio)"),
        ("std", "stddev_samp(capital_ratio)"),
        ("min", "min(capital_ratio)"),
        ("max", "max(capital_ratio)"),
        ("25%", "quantile_cont(capital_ratio, 0.25)"),
        ("50%", "quantile_cont(capital_ratio, 0.5)"),
        ("75%", "quantile_cont(capital_ratio, 0.75)"),
    ]
    out["describe_capital_ratio"] = with_(MESSAGES, cleaned("messages")) + " UNION ALL ".join(
        f"SELECT '{n}' AS statistic, round(CAST({e} AS DOUBLE), 3) + 0.0 AS value FROM clean" for n, e in stats
    )
    out["labels_per_source"] = (
        with_(MESSAGES)
        + "SELECT source, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM messages GROUP BY source"
    )
    cell = "SELECT row_id, label, channel, text FROM messages WHERE channel = 'sms' AND label = 'phishing'"
    out["cell_filter"] = with_(MESSAGES) + cell
    out["head_cell"] = with_(MESSAGES) + cell + " ORDER BY row_id LIMIT 3"
    out["first_per_label"] = (
        with_(MESSAGES)
        + """SELECT label, row_id, text FROM messages
      QUALIFY row_number() OVER (PARTITION BY label ORDER BY row_id) = 1"""
    )
    raw_split = with_(MESSAGES, split("messages"))
    out["sink_roundtrip"] = raw_split + "SELECT row_id, label, channel, split, text FROM parted"
    out["stratified_split"] = raw_split + "SELECT row_id, label, channel, split FROM parted"
    out["split_counts"] = (
        raw_split
        + """SELECT channel, label, count(*) FILTER (split = 'train') AS train,
      count(*) FILTER (split = 'test') AS test FROM parted GROUP BY ALL"""
    )
    out["kfold_assign"] = (
        with_(MESSAGES)
        + f"""SELECT row_id, label, CAST(ntile(5) OVER (PARTITION BY label
      ORDER BY md5('{SEED}:' || row_id), row_id) - 1 AS INTEGER) AS fold FROM messages"""
    )
    text_ratio = f"round({ratio('text')}, 4) + 0.0"
    out["signals_13"] = (
        with_(SIGNAL_INPUT) + signal_select(SIGNALS_13, text_ratio, "row_id", "source") + " FROM shimmed"
    )
    out["signals_8"] = (
        with_(SIGNAL_INPUT)
        + signal_select(SIGNALS_8, r6("capital_ratio"), "row_id", "source")
        + " FROM shimmed"
    )
    out["url_list"] = (
        with_(SIGNAL_INPUT)
        + """SELECT row_id, source, CAST(pos - 1 AS INTEGER) AS pos, urls[pos] AS url
      FROM (SELECT *, unnest(range(1, len(urls) + 1)) AS pos FROM shimmed)"""
    )
    # The boundary needs the shim, the output the text: a match is ASCII, so it sits at the same place.
    years = replace_all("text", YEAR_PATTERN, " ")
    out["strip_years"] = with_(SIGNAL_INPUT) + f"SELECT row_id, source, {years} AS text FROM shimmed"
    out["strip_confounds"] = (
        with_(SIGNAL_INPUT)
        + f"SELECT row_id, source, {replace_all(years, SOURCE_PATTERN, ' ')} AS text FROM shimmed"
    )
    out["fix_encoding"] = with_(SIGNAL_INPUT) + f"SELECT row_id, source, {repaired('text')} AS text FROM shimmed"
    tag = r"""<[a-zA-Z/!?]([^>"']|"[^"]*"|'[^']*')*>"""
    markup = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|" + tag
    bare = replace_all("html", markup, " ")
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        bare = f"replace({bare}, '&{name};', {q(char)})"
    out["html_to_text"] = f"SELECT page_id, {collapse(bare)} AS text FROM pages"

    for kind, tokens in (("word", WORD_TOKENS), ("char", CHAR_TOKENS)):
        all_ = WORD if kind == "word" else CHAR
        out[f"{kind}_ngrams"] = with_(PREPARED, tokens) + f"SELECT row_id, term, tf FROM {kind}_tf"
        out[f"vocab_{kind}"] = (
            with_(PREPARED, tokens, vocab(kind)) + f"SELECT term, df, tf FROM {kind}_vocab"
        )
        out[f"tfidf_{kind}"] = (
            with_(PREPARED, all_) + f"SELECT row_id, term, {r6('tfidf')} AS tfidf FROM {kind}_tfidf"
        )
    out["scale_signals"] = (
        with_(SCALED) + "SELECT row_id, split, " + ", ".join(f"{r6(n)} AS {n}" for n in SIGNALS_13) + " FROM scaled"
    )
    blocks = " UNION ALL ".join(
        f"SELECT row_id, '{k}:' || term AS feature, {r6('tfidf')} AS value FROM {k}_tfidf" for k in ("word", "char")
    )
    custom = " UNION ALL ".join(
        f"SELECT row_id, 'custom:{n}' AS feature, {r6(n)} AS value FROM scaled" for n in SIGNALS_13
    )
    out["features_word_char"] = with_(PREPARED, WORD, CHAR) + f"SELECT * FROM ({blocks}) WHERE value <> 0"
    out["features_full"] = (
        with_(SCALED, WORD, CHAR) + f"SELECT * FROM ({blocks} UNION ALL {custom}) WHERE value <> 0"
    )
    customs = " UNION ALL ".join(
        f"SELECT 2 AS block, CAST({i} AS BIGINT) AS place, 'custom:{n}' AS name" for i, n in enumerate(SIGNALS_13)
    )
    out["feature_names"] = (
        with_(PREPARED, WORD_TOKENS, vocab("word"), CHAR_TOKENS, vocab("char"))
        + f"""SELECT CAST(row_number() OVER (ORDER BY block, place) - 1 AS INTEGER) AS idx, name FROM (
      SELECT 0 AS block, row_number() OVER (ORDER BY term) AS place, 'word:' || term AS name FROM word_vocab
      UNION ALL SELECT 1, row_number() OVER (ORDER BY term), 'char:' || term FROM char_vocab
      UNION ALL {customs})"""
    )
    out["class_weights"] = (
        with_(PREPARED)
        + f"""SELECT label, count(*) AS n,
      {r6('sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE))')} AS weight
      FROM parted WHERE split = 'train' GROUP BY label"""
    )
    weights = ", ".join(f"{r6(c)} AS {c}" for c in LABELS)
    out["nb_fit"] = with_(MODEL) + f"SELECT term, {weights} FROM nb_weights"
    for name in ("nb", "cnb"):
        out[f"{name}_predict"] = (
            with_(MODEL, scored(name)) + f"SELECT * EXCLUDE (text) FROM {name}_predicted"
        )
    predicted = ", ".join(f"count(*) FILTER (prediction = '{c}') AS {c}" for c in LABELS)
    out["confusion_matrix"] = with_(PREDICTED) + f"SELECT model, label, {predicted} FROM predictions GROUP BY ALL"
    three = lambda f: ", ".join(f"{r6(f(c))} AS \"{c}\"" for c in ("precision", "recall", "f1"))
    name3 = lambda c: f'"{c}"'
    overall = "FROM classes WHERE slice = 'all'"
    out["class_report"] = (
        with_(EVALUATED)
        + f"""SELECT model, label AS row, {three(name3)}, support {overall}
      UNION ALL SELECT model, 'macro avg', {three(lambda c: f'avg("{c}")')}, CAST(sum(support) AS BIGINT)
        {overall} GROUP BY model
      UNION ALL SELECT model, 'weighted avg', {three(lambda c: f'sum("{c}" * support) / sum(support)')},
        CAST(sum(support) AS BIGINT) {overall} GROUP BY model
      UNION ALL SELECT model, 'accuracy', {three(lambda c: 'sum(hit) / CAST(sum(support) AS DOUBLE)')},
        CAST(sum(support) AS BIGINT) {overall} GROUP BY model"""
    )
    out["macro_f1"] = (
        with_(EVALUATED)
        + f"""SELECT model, {r6('macro_f1')} AS macro_f1, {r6('weighted_f1')} AS weighted_f1,
      {r6('accuracy')} AS accuracy FROM summary WHERE slice = 'all'"""
    )
    out["macro_f1_by_channel"] = with_(EVALUATED) + f"SELECT model, slice, {r6('macro_f1')} AS macro_f1, n FROM summary"
    phishing = "FROM classes WHERE slice = 'all' AND label = 'phishing'"
    out["class_pr"] = (
        with_(EVALUATED)
        + f"""SELECT model, {r6('"precision"')} AS "precision", {r6('recall')} AS recall {phishing}"""
    )
    out["cell_recall"] = with_(EVALUATED) + f"SELECT model, {r6('recall')} AS recall, n FROM cell"
    out["leaderboard"] = board()
    out["best_model"] = board("ORDER BY board.macro_f1 DESC, model LIMIT 1")
    out["error_triage"] = (
        with_(PREDICTED)
        + """SELECT model, row_id, prediction,
      CAST(CASE prediction WHEN 'phishing' THEN 2 WHEN 'ham' THEN 0 ELSE 1 END AS INTEGER) AS severity,
      substring(text, 1, 200) AS preview FROM predictions WHERE channel = 'sms' AND label = 'phishing'"""
    )
    metric = lambda slice_, name, value, source: (
        f"SELECT 'naive_bayes' AS experiment, model, {slice_} AS slice, '{name}' AS metric, {r6(value)} AS value {source}"
    )
    out["metrics_rows"] = with_(EVALUATED) + " UNION ALL ".join(
        [
            metric("slice", "macro_f1", "macro_f1", "FROM summary"),
            metric("slice", "weighted_f1", "weighted_f1", "FROM summary WHERE slice = 'all'"),
            metric("slice", "phishing_precision", '"precision"', phishing),
            metric("slice", "phishing_recall", "recall", phishing),
            metric("'sms'", "phishing_recall", "recall", "FROM cell"),
            metric("'sms'", "phishing_n", "n", "FROM cell"),
        ]
    )
    out["top_features_nb"] = with_(MODEL) + (
        "SELECT class, CAST(rank AS INTEGER) AS rank, feature, weight FROM (SELECT *, row_number() OVER (PARTITION BY class "
        "ORDER BY weight DESC, feature) AS rank FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS class, 'word:' || term AS feature, {r6(c)} AS weight FROM cnb_weights" for c in LABELS
        )
        + ")) WHERE rank <= 15"
    )
    return out
