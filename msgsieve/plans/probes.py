"""Hand-written messages that reach the patterns the generated tables never hit.

They are appended to whole tables, with negative ids, so that both engines prove every pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (text, source_rank, channel, label)
PROBES = [
    ("minutes of the gardening club are on https://ow.ly/9f2x today", 0, "email", "ham"),
    ("roadworks map: www.cityroads.info, plan b www.detours.biz", 0, "sms", "ham"),
    ("Bus 48213 leaves at nine, ticket 900417", 0, "sms", "ham"),
    ("reach the vet on +49 30-1234 567!", 0, "sms", "spam"),
    ("a kilo of plums is €3, of figs $4 and of dates £5", 0, "email", "spam"),
    ("printer page at http://10.20.30.40:631/ jobs", 0, "email", "phishing"),
    ("choir songs: notes.tk and score.ml", 0, "sms", "phishing"),
    ("seed swap at garden.club, tools from shed.work", 0, "email", "spam"),
    ("the b1rds sang at l0dge no 4", 0, "sms", "phishing"),
    ("new opening hours on tinyurl.com/lib-hours", 0, "sms", "ham"),
    ("NO RAIN tomorrow", 0, "sms", "ham"),
    ("mail.example.net, a.b.org and docs.example.io!!", 0, "email", "ham"),
    ("login http://192.168.10.1/a.b?c=1 or www.foo.xyz now", 0, "sms", "phishing"),
    ("paypa1 g00gle amaz0n", 0, "sms", "phishing"),
    ("éle1ns tel +44 (0)20 7946 0958", 0, "sms", "spam"),
    ("", 0, "sms", "ham"),
    ("A", 0, "sms", "ham"),
    ("foo.co.uk and foo.com.", 0, "email", "ham"),
    ("Straße ÉCOLE ǅ Ⅷ", 0, "sms", "ham"),
    ("a\u00a0b  c\u2003d\u000be and some more", 0, "sms", "ham"),
    ("code 123 now", 1, "sms", "ham"),
    ("code 98765 now", 1, "sms", "ham"),
    ("same text, two labels", 0, "sms", "ham"),
    ("Same  text, two labels", 1, "sms", "phishing"),
    ("jose@monkey.org wrote utf in 2024, 1989 and 1994", 0, "email", "phishing"),
    ("pay Â£5 or â£5 or ï¿½5, cafÃ© and itâ€™s done", 0, "sms", "spam"),
    ("Ã¼ber ðŸ˜€ ðŸŽ‰ and æ—¥æœ¬ at 5â‚¬, ÐŸÑ€Ð¸Ð²ÐµÑ‚; Strauß’ CAFÉ… stay", 0, "sms", "ham"),
    ("offer at pay.example.buzz, €20 or $30!", 0, "sms", "spam"),
]
COLUMNS = "row_id long, text string, source string, source_rank int, channel string, label string"


def probe_rows() -> list[tuple]:
    return [
        (-1 - i, text, f"src{rank}", rank, channel, label)
        for i, (text, rank, channel, label) in enumerate(PROBES)
    ]


def with_probes(spark: SparkSession, messages: DataFrame) -> DataFrame:
    return messages.unionByName(spark.createDataFrame(probe_rows(), COLUMNS))
