"""

BENCH_ROWS: entries (default 1,000,000). BENCH_CPUS: threads (default 8). Names are
drawn by hashes from words and extensions of our own, of like lengths; each case runs
once to warm up and seven times, the median counts, on the snapshot as it lies on
disk and then on its entries held in memory.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

ROWS = int(os.environ.get("BENCH_ROWS", 1_000_000))
CPUS = os.environ.get("BENCH_CPUS", "8")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "report invoice summary ledger draft minutes photo holiday screenshot sketch track mixdown lecture chapter recipe garden budget forecast contract letter survey sample module parser helper widget archive backup café señal größe żuraw écran año".split()
EXTS = "pdf docx xlsx csv txt md png jpg mp3 mp4 py zip".split()
CASES = {"one letter": ("e", {}), "two letters": ("re", {}), "word": ("report", {}), "long word": ("screenshot", {}), "no match": ("zzqqxy", {}), "not ASCII": ("café", {}), "listing": ("", {"scope": "/home/bench/draft/photo/d32", "max_depth": 1}), "subtree and extension": ("ext:pdf", {"scope": "/home/bench/draft"}), "capped letter": ("e", {"max_results": 2000})}


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from foliant.schema import RAW
    from foliant.sources import catalog

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    at = tempfile.mkdtemp(prefix="bench-")
    draw = lambda of, seed: F.element_at(F.array(*map(F.lit, of)), (1 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(of)))).cast("int"))
    folder = F.floor(F.col("id") / 40)
    name = F.concat_ws("_", draw(WORDS, 1), draw(WORDS, 2), F.col("id").cast("string"))
    place = lambda seed: F.element_at(F.array(*map(F.lit, WORDS)), (1 + F.pmod(folder + seed, F.lit(len(WORDS)))).cast("int"))
    rows = spark.range(ROWS).select(
        F.col("id").alias("entry_id"),
        F.concat(name, F.lit("."), draw(EXTS, 3)).alias("name"),
        F.concat(F.lit("/home/bench/"), place(4), F.lit("/"), place(6), F.lit("/d"), folder.cast("string")).alias("dir_path"),
        F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 26)).alias("size"),
        (1_700_000_000 + F.col("id") % 1_000_000).alias("mtime"),
        F.when(F.col("id") % 40 == 0, 1).otherwise(0).alias("kind"),
        F.pmod(F.xxhash64("id", F.lit(6)), F.lit(9)).cast("int").alias("category"),
    )
    began = time.perf_counter()
    catalog.build(rows.select(*RAW.names), f"file://{at}/catalog")
    took = {"build": round(time.perf_counter() - began, 3)}
    c = catalog.Catalog(spark, f"file://{at}/catalog")

    def timed(text: str, named: dict) -> tuple[float, int]:
        began = time.perf_counter()
        n = len(c.query(text, **named).toArrow())
        return time.perf_counter() - began, n

    for kept in ("disk", "memory"):
        if kept == "memory":
            c.entries = c.entries.cache()
            c.entries.count()
        for case, (text, named) in CASES.items():
            timed(text, named)
            runs = [timed(text, named) for _ in range(7)]
            took[f"{case}, {kept}"] = round(median(t for t, _ in runs), 4)
            took.setdefault(f"{case}, rows", runs[0][1])
    print(json.dumps({"metric": "median seconds", "rows": ROWS, "queries": took}))


if __name__ == "__main__":
    main()
