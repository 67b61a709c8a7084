"""Tables and small files as outputs."""

from __future__ import annotations

import atexit
import csv
import html
import json
import os
import tempfile
import uuid
from decimal import ROUND_HALF_EVEN, Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partitions: list[str] | None = None, codec: str = "zstd", keep_others: bool = False) -> None:
    """Parquet by Spark's committer: readers see all of it or nothing. With keep_others
    only the partitions at hand are replaced, which resumes an unfinished run."""
    out = df.write.mode("overwrite").option("compression", codec)
    if partitions:
        out = out.partitionBy(*partitions)
        if keep_others:
            out = out.option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Small reports as one file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def python_round(x: float | None, digits: int) -> float | None:
    """Half to even on the exact binary value, as reports round; SQL rounds half up."""
    return None if x is None else float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))


def report_metrics(df: DataFrame, digits: dict[str, int]) -> list[dict[str, Any]]:
    """The few metric rows of a report, rounded for print."""
    rows = [r.asDict() for r in df.collect()]
    return [{k: python_round(v, digits[k]) if k in digits else v for k, v in r.items()} for r in rows]


def write_json(value: Any, path: str) -> None:
    """Through a temporary name, so that a reader never meets half a file."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    tmp = at.with_name(at.name + ".tmp")
    tmp.write_text(json.dumps(value, indent=2, default=str))
    os.replace(tmp, at)


def write_skill(skill: DataFrame, path: str, extreme: str, lead: str, **attributes: Any) -> None:
    """One table for all skill maps, a partition for each extreme and lead, with the
    attributes of the run as columns."""
    out = skill.withColumn("extreme", F.lit(extreme)).withColumn("lead", F.lit(lead))
    for k, v in attributes.items():
        out = out.withColumn(k, F.lit(v))
    write_table(out, path, ["extreme", "lead"], keep_others=True)


def write_index(folder: str, images: list[str], tables: list[str] | None = None) -> None:
    """An HTML page of the distinct images of a folder, and links to tables, in order of name."""
    names = lambda paths: [html.escape(x) for x in sorted({os.path.relpath(i, folder) for i in paths})]
    rows = [f'<figure><img src="{x}"><figcaption>{x}</figcaption></figure>' for x in names(images)]
    rows += [f'<p><a href="{x}">{x}</a></p>' for x in names(tables or [])]
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "index.html").write_text("\n".join(["<!doctype html><meta charset=utf-8><title>Figures</title>", *rows, ""]))


def write_rows(rows: list[dict[str, Any]], path: str) -> None:
    """The few rows of a report as one CSV file with a header, through a temporary name."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    tmp = at.with_name(at.name + ".tmp")
    with tmp.open("w", newline="") as f:
        out = csv.DictWriter(f, list(dict.fromkeys(k for r in rows for k in r)))
        out.writeheader()
        out.writerows(rows)
    os.replace(tmp, at)


def write_run_configs(manifest: list[dict[str, Any]], folder: str, settings: dict[str, Any]) -> list[str]:
    """A configuration file for each chunk of a manifest: `settings` of the model with where
    the chunk writes, its steps and members. JSON, which every YAML reader takes."""
    out = []
    for row in manifest:
        own = {"experiment_dir": row["output_dir"], "n_forward_steps": int(row["expected_steps"]), "n_ensemble_per_ic": int(row["members"])}
        init = {"initial_condition": {**settings.get("initial_condition", {}), "start_indices": {"times": [row["init_time"]]}}} if row.get("init_time") else {}
        name = f"{folder}/{row['target_date']}_{int(row['lead_days']):03d}/chunk{int(row['chunk']):03d}.yaml"
        write_json(settings | own | init, name)
        out.append(name)
    return out


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a query writes and reads again: below spark.checkpoint.dir,
    which all executors share, or, only on a local master without that setting, below this
    machine's temporary folder. It goes when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='skillgrid-core-')}"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def layout(root: str) -> dict[str, str]:
    """Folders of a run."""
    return {n: f"{root.rstrip('/')}/{n}" for n in ("cache", "processed", "metrics", "figures", "plans", "logs")}
