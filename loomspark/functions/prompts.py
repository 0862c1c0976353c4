"""Prompt texts of the pipeline's steps as column functions; the wording is this library's own, the slots are fixed.

Missing slots read as empty text, so that a prompt is never NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "`" * 3


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def _code(code: Column) -> tuple[Column | str, ...]:
    return (f"\n{FENCE}python\n", code, f"\n{FENCE}\n")


def zero_shot(requirement: Column, dll: Column) -> Column:
    return _text("Write a program with ", dll, " for this task.\n\nTask:\n", requirement, "\n\nAnswer with one block of code.")


def candidates(requirement: Column, dll: Column) -> Column:
    """First step: asks for names of APIs only."""
    return _text("Name the APIs of ", dll, " that a model for this task needs, and no others.\n\nTask:\n", requirement, "\n\nAnswer with a list of dictionaries with the key api_name.")


def with_documents(requirement: Column, dll: Column, documents: Column) -> Column:
    """Second step: the documents of the retrieved APIs follow one another without a sign between them."""
    return _text("Write a program with ", dll, " for this task. Use the documented APIs.\n\nTask:\n", requirement, "\n\nDocuments:\n", F.array_join(documents, ""), "\n\nName all arguments, and build the model once on a sample input.")


def numbered(documents: Column) -> Column:
    """Retrieved documents with their numbers, parted by a blank line; a note where there are none."""
    block = F.array_join(F.transform(documents, lambda d, i: F.concat(F.lit("[Retrieved API "), (i + 1).cast("string"), F.lit("]\n"), F.coalesce(d, F.lit("")))), "\n\n")
    return F.when(F.coalesce(F.size(documents), F.lit(0)) > 0, block).otherwise("(no API retrieved)")


def retrieval(requirement: Column, dll: Column, documents: Column) -> Column:
    return _text("Write a program with ", dll, " for this task.\n\nTask:\n", requirement, "\n\n", numbered(documents), "\n\nAnswer with one block of code.")


def self_debug(base: Column, code: Column, error: Column) -> Column:
    """A draft that failed, behind the prompt that it answers."""
    return _text(base, "\n\nThis draft stops:", *_code(code), "\nwith\n", error, "\n\nRepair it.")


def unresolved(code: Column, error: Column) -> Column:
    """A crash whose cause wasn't found: program and traceback only."""
    return _text("Repair this program with few and local changes; keep the model's structure.\n", *_code(code), "\nError:\n", error, "\n\nAnswer with the whole program in one block of code.")


def diagnosed(base: Column, code: Column, cause: Column) -> Column:
    """A program with its shape annotations and the root cause found."""
    return _text(base, "\n\nProgram:", *_code(code), "\nCause: ", cause, "\n\nRepair it.")


def shapes_only(base: Column, code: Column) -> Column:
    """A program with its shape annotations, without guidance about the cause."""
    return _text(base, "\n\nProgram:", *_code(code), "\nRepair it by the shapes that it notes.")
