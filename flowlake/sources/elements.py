"""Element dictionaries (information models) from files."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession

from flowlake.functions.elements import built_in_rows

ELEMENT_SCHEMA = "enterprise bigint, element_id int, name string, type string"


def default_elements(spark: SparkSession) -> DataFrame:
    """The built-in dictionary."""
    return spark.createDataFrame(built_in_rows(), ELEMENT_SCHEMA)


def load_elements(spark: SparkSession, path: str, mode: str = "replace") -> DataFrame:
    """A dictionary file; it replaces the built-in one or is merged over it.

    Understood layouts: enterprise -> id -> ``[name, type]`` as JSON or YAML, and the CSV
    that IANA publishes (columns ElementID, Name, Abstract Data Type). Entries with fewer
    than two properties are skipped. A dictionary has some hundreds of lines, so it is read
    on the driver like any other configuration.
    """
    if mode not in ("replace", "merge"):
        raise ValueError(f"mode must be 'replace' or 'merge', not {mode!r}")
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path").collect()
    rows = [row for file in sorted(files, key=lambda f: f.file_path) for row in _parse(file.value, file.file_path)]
    if not rows:
        raise ValueError(f"no elements in {path}")
    if mode == "merge":
        merged = {row[:2]: row for row in built_in_rows()}
        merged.update({row[:2]: row for row in rows})
        rows = list(merged.values())
    return spark.createDataFrame(rows, ELEMENT_SCHEMA)


def _parse(text: str, path: str) -> list[tuple[int, int, str, str]]:
    if path.endswith(".csv"):
        return [
            (0, int(row["ElementID"]), row["Name"], row["Abstract Data Type"])
            for row in csv.DictReader(io.StringIO(text))
            if row["ElementID"].isdigit() and row["Name"] and row["Abstract Data Type"]
        ]
    try:
        tree = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading a YAML dictionary needs the yaml package; use JSON or CSV") from error
        tree = yaml.safe_load(text)
    return [
        (int(enterprise), int(element_id), properties[0], properties[1])
        for enterprise, elements in tree.items()
        for element_id, properties in elements.items()
        if properties and len(properties) > 1
    ]
