"""Compare the forms the design chose between, on the sf0.1 tables; prints one line each."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators.cells import Cells, recall, search_cells
from groundwell.operators.chunking import chunk_documents
from groundwell.operators.search import search
from groundwell.plans import tables
from groundwell.settings import shared_folder


def seconds(build, runs: int = 3) -> float:
    """Best time of ``runs`` after one to warm up."""
    best = float("inf")
    for i in range(runs + 1):
        start = time.perf_counter()
        frame: DataFrame = build()
        frame.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start) if i else best
    return best


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    documents = tables.documents(spark, folder, spread=True)
    n_chunks = chunk_documents(documents).count()

    @F.udf("array<string>")
    def chunks_in_python(text: str) -> list[str]:
        words = re.findall(r"\S+", text or "")
        count = 1 + max(0, -(-(len(words) - 512) // 448)) if words else 0
        return [" ".join(words[i * 448:i * 448 + 512]) for i in range(count)]

    native = seconds(lambda: chunk_documents(documents))
    python = seconds(
        lambda: documents.select("document_id", F.posexplode(chunks_in_python("text")))
    )
    print(f"chunk rows, native: {native:.2f} s, {n_chunks / native:,.0f} rows/s")
    print(f"chunk rows, Python row function: {python:.2f} s, {n_chunks / python:,.0f} rows/s")

    points = tables.vector_points(spark, folder)
    queries = tables.vector_queries(spark, folder)
    pairs = points.count() * queries.count()
    block = seconds(lambda: search(points, queries))
    print(f"exact top-5, block products: {block:.2f} s, {pairs / block:,.0f} pairs/s")

    cells = Cells.fit(points, 32)
    shared_folder(spark)
    placed = cells.assign(points).checkpoint()
    exact = search(points, queries)
    for n_probe in (1, 2, 4, 8, 32):
        found = search_cells(cells, placed, queries, n_probe=n_probe)
        share = recall(found, exact, "query_id", "chunk_id").first()["recall"]
        spent = seconds(
            lambda n=n_probe: search_cells(cells, placed, queries, n_probe=n), runs=1
        )
        print(f"cells, 32 with {n_probe} probes: {spent:.2f} s, recall@5 {share:.3f}")
    spent = seconds(
        lambda: search_cells(cells, placed, queries, n_probe=4, exact=True), runs=1
    )
    print(f"cells, exact: {spent:.2f} s")
    spark.stop()


if __name__ == "__main__":
    main()
