"""Headline timings: one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Words of printed pages
are first set from the tables and written once, outside the timing: reading
documents starts from words. The reference's published times are per document
from upload to result; ``documents_per_sec`` is the figure to hold against them.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from inkgrid import fixed
from inkgrid.operators import findings, grid
from inkgrid.plans import payslip, transcribe
from inkgrid.session import build_session, ship_package
from suite import adapters as ad
from suite.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(fn) -> float:
    start = time.perf_counter()
    fn().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    cores = int(CPUS) if CPUS.isdigit() else os.cpu_count() or 8
    spark = build_session(
        "inkgrid-bench", f"local[{CPUS}]", spark__ui__enabled="false", spark__driver__memory="20g",
        spark__sql__shuffle__partitions=4 * cores,
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    work = tempfile.mkdtemp(prefix="inkgrid-bench-")
    words, pages = ad.rendered(spark, SF_DIR)
    words.repartition(4 * cores).write.parquet(f"{work}/words")
    pages.write.parquet(f"{work}/pages")
    words, pages = spark.read.parquet(f"{work}/words"), spark.read.parquet(f"{work}/pages")
    documents = ad.rendered_documents(pages)
    n_words, n_docs = words.count(), documents.count()

    times: dict[str, float] = {}
    start = time.perf_counter()
    out = transcribe.transcribe(words, pages, documents)
    for name in ("days", "entries"):
        out[name].write.parquet(f"{work}/{name}")
    times["transcribe"] = round(time.perf_counter() - start, 3)
    transcribe.release_transcription(out)

    days, entries = spark.read.parquet(f"{work}/days"), spark.read.parquet(f"{work}/entries")
    times["timecard_findings"] = timed(
        lambda: findings.timecard_findings(findings.summarise_nested_days(days))
    )
    times["payslip_findings"] = timed(
        lambda: findings.payslip_findings(
            findings.summarise_nested_entries(payslip.number_entries(entries))
        )
    )
    numbered = payslip.number_entries(entries)
    fields = payslip.flat_fields(entries).join(
        numbered.select("doc_id", "page", "entry_no", "entry_pos"), ["doc_id", "page", "entry_no"]
    )
    times["payslip_grid"] = timed(lambda: grid.payslip_grid(numbered, fields))
    for name in ("severity", "grid_timesheet", "grid_payslip", "apply_corrections", "cluster_lines",
                 "label_value_pairs", "read_clock", "read_money", "lifecycle_status"):
        times[name] = timed(lambda name=name: QUERIES[name](spark, SF_DIR))
    print(json.dumps({
        "metric": "words to findings, grids and corrections",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
        "cpus": cores,
        "words": n_words,
        "documents": n_docs,
        "documents_per_sec": round(n_docs / times["transcribe"], 1),
        "kinds": [fixed.TIMECARD, fixed.PAYSLIP],
    }))


if __name__ == "__main__":
    main()
