"""Unit ids (``path:symbol``), paths and modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_name(unit_id: Column) -> Column:
    """Text after the last ``:``, or the whole id without one."""
    return F.substring_index(unit_id, ":", -1)


def symbol_name_or_null(unit_id: Column) -> Column:
    return F.when(F.contains(unit_id, F.lit(":")), symbol_name(unit_id))


def file_part(unit_id: Column) -> Column:
    """Text before the last ``:``, or the whole id without one."""
    return F.regexp_replace(unit_id, ":[^:]*$", "")


def map_symbol_name(unit_id: Column) -> Column:
    """As :func:`symbol_name`, but a bare path gives its file stem."""
    stem = F.regexp_replace(basename(unit_id), r"(?<=.)\.[^.]*$", "")
    return F.when(F.contains(unit_id, F.lit(":")), symbol_name(unit_id)).otherwise(stem)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory of a path: ``.`` at the top level, ``/`` directly under the root."""
    head = F.regexp_replace(path, "/[^/]*$", "")
    return (
        F.when(~F.contains(path, F.lit("/")), F.lit("."))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def module_path(unit_id: Column) -> Column:
    return parent_dir(file_part(unit_id))


def module_name(path: Column) -> Column:
    name = basename(path)
    return F.when(name == "", path).otherwise(name)


def unit_id(path: Column, symbol: Column) -> Column:
    return F.concat(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(":"), symbol)


def is_exported(path: Column, signature: Column, name: Column) -> Column:
    """Visibility by the habits of the language the file suffix stands for."""
    return (
        F.when(F.endswith(path, F.lit(".py")), ~F.startswith(name, F.lit("_")))
        .when(path.rlike(r"\.(ts|tsx|js|jsx)$"), F.contains(signature, F.lit("export")))
        .when(F.endswith(path, F.lit(".go")), name.rlike(r"^\p{Lu}"))
        .otherwise(F.lit(True))
    )
