"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from msgsieve.plans.queries import QUERIES
from msgsieve.session import build_session

# From raw tables to explanations; stage tables are written by the first query that needs them, and
# their time counts for that query.
HEADLINE = """
scan_tsv ingest_mail ingest_mbox
clean_text dedup_exact dedup_template crosstab_channel_label attrition_funnel describe_capital_ratio
source_overlap validate_domain signals_13 strip_confounds fix_encoding html_to_text
stratified_split kfold_assign
prepared_messages word_ngrams char_ngrams vocab_word vocab_char tfidf_word tfidf_char scale_signals
nb_fit nb_predict cnb_predict class_report macro_f1_by_channel error_triage
features_full lr_balanced svc_balanced score_messages explain_messages_full
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "20g"))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        # The noop sink computes every column of every row and keeps none.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
