"""Versioned folders: a new version is written beside the old one and becomes
current when a pointer file, written last, names it.

The pointer records the version of the input and the number and size of the
folder's files, so a torn, thinned-out or outdated version is not taken for the
current one. The version before stays for readers that still hold it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from .raw import file_system, path_exists

POINTER = "current.json"  # Spark leaves out names that start with _ or .


def _read_pointer(spark: SparkSession, root: str) -> dict | None:
    if not path_exists(spark, f"{root}/{POINTER}"):
        return None
    text = "\n".join(r.value for r in spark.read.text(f"{root}/{POINTER}").collect())
    try:
        return json.loads(text)
    except json.JSONDecodeError:  # torn
        return None


def _contents(spark: SparkSession, path: str) -> tuple[int, int]:
    fs, hpath = file_system(spark, path)
    summary = fs.getContentSummary(hpath)
    return summary.getFileCount(), summary.getLength()


def latest_version(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """Folder and version that are current, if the folder is complete."""
    pointer = _read_pointer(spark, root)
    if not pointer:
        return None
    path = f"{root}/{pointer['folder']}"
    if not path_exists(spark, path) or list(_contents(spark, path)) != pointer["contents"]:
        return None
    return path, pointer["version"]


def current(spark: SparkSession, root: str, version: str) -> str | None:
    """The folder of the complete current version, if it is ``version``."""
    found = latest_version(spark, root)
    return found[0] if found and found[1] == version else None


def publish(spark: SparkSession, root: str, version: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder, then make it current."""
    old = _read_pointer(spark, root)
    folder = f"v-{uuid.uuid4().hex[:12]}"
    write(f"{root}/{folder}")
    body = json.dumps({"folder": folder, "version": version, "contents": list(_contents(spark, f"{root}/{folder}"))})
    jvm = spark.sparkContext._jvm
    fs, target = file_system(spark, f"{root}/{POINTER}")
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/.{POINTER}.{folder}")
    out = fs.create(draft, True)
    out.write(bytearray(body.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(draft, target, options)
    keep = {folder, (old or {}).get("folder")}
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in keep:
            fs.delete(status.getPath(), True)
    return f"{root}/{folder}"
