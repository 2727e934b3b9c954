"""``python -m weftline job.json [--key value | --key__op value | --@limit N ...]``: run a job and those it depends on.

``-o -`` prints the rows, ``--@show`` prints the resolved document and the plan
and writes nothing, ``--@limit``/``-l`` cuts the output, ``-v`` prints the plan too.

``--@batch N`` goes through the input in batches of N files, ``--@streaming`` in
batches as they come; both end when nothing is left, unless the input says ``use P``,
which polls it every ``options.period`` (``10 seconds``) until SIGTERM or SIGHUP, or for
``--@timeout`` seconds.  ``--@recovery FOLDER`` keeps the place that a stream has come
to in that folder, and of a job with a cursor goes on behind its last row.
"""

from __future__ import annotations

import json
import signal
import sys
import threading
import uuid
from typing import Any

from pyspark.sql import SparkSession

from weftline import config as configs
from weftline.plans.job import Job, parse_table
from weftline.sources import Catalog
from weftline.streaming import run_stream

SHORT = {"-l": "@limit", "-s": "@show", "-o": "@output", "-i": "@input", "-b": "@batch", "-v": "@verbose"}
FLAGS = {"@show", "@streaming", "@verbose"}


def parse(args: list[str]) -> tuple[str, dict[str, Any]]:
    path, given, rest = args[0], {}, list(args[1:])
    while rest:
        a = rest.pop(0)
        name = SHORT.get(a) or a.removeprefix("--")
        name, eq, value = name.partition("=")
        given[name] = True if name in FLAGS else value if eq else rest.pop(0)
    if "@limit" in given:
        given["@limit"] = int(given["@limit"])
    return path, given


def streamed(job: Job, given: dict[str, Any]) -> dict:
    """The job over its input as a stream, until nothing is left, the time is over or the process is told to end."""
    name, _, mode = parse_table(job.config["input"])
    polled = mode == "P"
    folder = given.get("@recovery")
    if folder is None:
        top = job.spark.conf.get("spark.checkpoint.dir", None)
        if top is None:
            raise ValueError("a stream needs @recovery or spark.checkpoint.dir for its place in the input")
        folder = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    period = job.config.get("options", {}).get("period", "10 seconds") if polled else None
    found = run_stream(job, job.catalog.stream(name, int(given.get("@batch", 0)) or None), folder, period)
    if threading.current_thread() is threading.main_thread():
        for sign in (signal.SIGTERM, signal.SIGHUP):
            signal.signal(sign, lambda *_: found.stop())
    if given.get("@timeout"):
        if not found.awaitTermination(int(given["@timeout"])):
            found.stop()
    else:
        found.awaitTermination()
    return {"batches": len(found.recentProgress)} | job.status


def run(spark: SparkSession, path: str, given: dict[str, Any], catalog: Catalog | None = None) -> list[dict]:
    """The jobs that this one depends on, in order, and then itself; later ones see what earlier ones wrote."""
    catalog = catalog or Catalog(spark)
    config = configs.load(path)
    done: list[dict] = []
    for other in config.get("dependencys", []):
        file, more = (other[0], other[1]) if isinstance(other, list) else (other, {})
        done += run(spark, file, more, catalog)
    for key, mark in (("input", "<<"), ("output", ">>")):
        if f"@{key}" in given and config[key].startswith(mark):
            config[key] = "&.stdio.&1 use I" if given[f"@{key}"] == "-" else given[f"@{key}"]
    job = Job.from_config(spark, config, given, catalog)
    if given.get("@show"):
        print(json.dumps(job.config, indent=2, ensure_ascii=False, default=str))
        job.plan().explain("formatted")
        return done
    if given.get("@verbose"):
        job.plan().explain("formatted")
    polled = isinstance(job.config["input"], str) and parse_table(job.config["input"])[2] == "P"
    status = streamed(job, given) if polled or given.get("@streaming") or "@batch" in given else job.run()
    return [*done, {"job": config.get("name", path)} | status]


def main() -> None:
    if len(sys.argv) < 2:
        sys.exit(__doc__)
    path, given = parse(sys.argv[1:])
    zone = configs.load(path).get("options", {}).get("timezone")
    builder = SparkSession.builder.appName(path)
    spark = (builder.config("spark.sql.session.timeZone", zone) if zone else builder).getOrCreate()
    for status in run(spark, path, given):
        print(json.dumps(status, default=str))


if __name__ == "__main__":
    main()
