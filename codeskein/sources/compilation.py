"""Compilation databases: shell commands, compiler options, and the options most files share."""

from __future__ import annotations

import json
import os
import shlex
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Options:
    standard: str | None
    defines: tuple[str, ...]
    includes: tuple[str, ...]


def parse_options(arguments: list[str], directory: str) -> Options:
    """-std, -D, -U, -I, -isystem and their cl spellings; later ones win, values may be the next argument."""
    standard, defines, includes = None, {}, []
    i = 0
    while i < len(arguments):
        a = arguments[i]
        for flag in ("-D", "/D", "-U", "/U", "-I", "/I", "-isystem", "-std=", "/std:"):
            if a.startswith(flag):
                value = a[len(flag) :]
                if not value and i + 1 < len(arguments):
                    i += 1
                    value = arguments[i]
                if flag in ("-D", "/D"):
                    defines[value.split("=")[0]] = value
                elif flag in ("-U", "/U"):
                    defines.pop(value, None)
                elif flag in ("-std=", "/std:"):
                    standard = value
                else:
                    includes.append(os.path.normpath(os.path.join(directory, value)))
                break
        i += 1
    return Options(standard, tuple(defines.values()), tuple(dict.fromkeys(includes)))


def read_database(path: str) -> tuple[dict[str, Options], Options]:
    """Options by file, the first entry of a file standing, and the option set of most files."""
    files: dict[str, Options] = {}
    for entry in json.loads(Path(path).read_text()):
        directory = entry.get("directory", "")
        file = os.path.normpath(os.path.join(directory, entry["file"]))
        if file not in files:
            files[file] = parse_options(entry.get("arguments") or shlex.split(entry.get("command", "")), directory)
    common = Counter(files.values()).most_common(1)
    return files, common[0][0] if common else Options(None, (), ())


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The same as rows, for databases of many files: file, directory, command, the first entry of a file."""
    rows = spark.read.schema("directory string, file string, command string, arguments array<string>").json(path, multiLine=True)
    rows = rows.withColumn("command", F.coalesce("command", F.array_join("arguments", " "))).withColumn("n", F.monotonically_increasing_id())
    first = Window.partitionBy("file").orderBy("n")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select("file", "directory", "command")
