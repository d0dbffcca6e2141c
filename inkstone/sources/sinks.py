"""Writers: samples, fingerprints, records, lexicons, pairs and training rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..files import make_folder, place
from ..operators.corpus import holdout_split, training_rows
from ..operators.evaluate import gates
from ..stage import staged


def write_samples(samples: DataFrame, path: str) -> None:
    """Appends samples as JSON lines; what is there stays."""
    samples.write.mode("append").json(path)


def write_fingerprint(style: DataFrame, path: str) -> None:
    style.coalesce(1).write.mode("overwrite").json(path)


def _fixed(column: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(column).cast("double")).alias(column)


def write_records_csv(records: DataFrame, path: str, *, four: list[str], two: list[str]) -> None:
    """CSV with a header; measures with four or two digits, texts quoted."""
    rest = [c for c in records.columns if c not in {*four, *two}]
    rows = records.select(*rest, *[_fixed(c, 4) for c in four], *[_fixed(c, 2) for c in two])
    rows.select(*records.columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_records(records: DataFrame, summary: DataFrame, path: str, *, four: list[str], two: list[str]) -> None:
    """Records as JSON lines and as CSV, and their summary (one row) as JSON, in three folders."""
    records.write.mode("overwrite").json(f"{path}/eval_results")
    write_records_csv(records, f"{path}/eval_results_csv", four=four, two=two)
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/eval_summary")


def write_ablation(records: DataFrame, stats: DataFrame, path: str) -> None:
    """Records of all generations as JSON lines, the statistics of all buckets, and the gates with reasons."""
    records.write.mode("overwrite").json(f"{path}/per_generation")
    stats.write.mode("overwrite").json(f"{path}/buckets")
    gates(stats).coalesce(1).write.mode("overwrite").json(f"{path}/ablation_summary")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Preference pairs as JSON lines."""
    pairs.write.mode("overwrite").json(path)


def progress(completed: int, total: int, eta_seconds: float, combo: str, status: str) -> str:
    """The JSON of a progress file."""
    percent = round(100 * completed / total) if total else 0
    return json.dumps({"completed": completed, "total": total, "percent": percent, "eta_minutes": round(eta_seconds / 60), "current_combo": combo, "status": status}, indent=2) + "\n"


def write_corpus(samples: DataFrame, path: str, *, key: str = "source") -> None:
    """The texts of each key (a column of samples, which have a doc_id) as one file below its folder, in order, an empty
    line after each. A task streams a key's texts; none holds them together."""
    rows = samples.where("text is not null").repartition(key).sortWithinPartitions(key, "doc_id", "text")
    rows.select(key, "text").write.mode("overwrite").partitionBy(key).option("lineSep", "\n\n").option("maxRecordsPerFile", 0).text(path)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each row (name, data binary) as a file of that name, which may hold folders, and gives the names. A task that
    is run again writes the same files again."""
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (own := f"{folder}/{name}".rpartition("/")[0]) not in made:
                    made.add(make_folder(own))
                system, path = place(f"{folder}/{name}")
                with system.open_output_stream(path, compression=None) as out:
                    out.write(data or b"")
            yield batch.select(["name"])

    return staged(rows.select("name", "data").mapInArrow(run, "name string"), "files")


def write_lexicon(terms: DataFrame, path: str, *, title: str) -> None:
    """A text file: the title as a comment, then terms by rank. Terms are bounded by the lexicon's size."""
    head = terms.sparkSession.createDataFrame([(0, f"# {title}")], "rank int, value string")
    rows = head.unionByName(terms.select("rank", F.col("term").alias("value")))
    rows.coalesce(1).sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


def write_training(samples: DataFrame, path: str, *, style: str = "chat", ratio: float = 0.1) -> None:
    """train, valid and test as JSON lines; test is a copy of valid."""
    split = holdout_split(samples, ratio, at_most_half=True)
    for name, held in (("train", False), ("valid", True), ("test", True)):
        part = training_rows(split.where(F.col("held_out") == held), style).select(F.col("row").alias("value"))
        part.write.mode("overwrite").text(f"{path}/{name}")


def envelope(data: dict | None = None, error: str | None = None) -> str:
    """The JSON form of an answer."""
    body = {"version": "1", "status": "error" if error else "success"}
    return json.dumps(body | ({"error": error} if error else {"data": data or {}}), ensure_ascii=False)
