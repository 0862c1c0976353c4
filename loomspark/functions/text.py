"""Column functions over code and response text; all of them stay inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "`" * 3
OPEN = FENCE + "python"


def fence_match(t: Column) -> Column:
    """Text between the first opening marker and the next fence, trimmed; further opening markers are dropped.

    NULL without an opening marker or without a closing fence.
    """
    rest = F.replace(F.substring(t, F.locate(OPEN, t), F.length(t)), F.lit(OPEN), F.lit(""))
    inside = F.regexp_replace(F.substring_index(rest, FENCE, 1), r"\A[ \n\t\r]+|[ \n\t\r]+\z", "")
    return F.when(F.contains(t, F.lit(OPEN)) & F.contains(rest, F.lit(FENCE)), inside)


def fence_regex(t: Column, lang: str = "python") -> Column:
    """First fenced block with the language's tag, trimmed; with any tag or none where lang is empty; NULL without one."""
    tag = re.escape(lang) if lang else r"(?:\w+)?"
    pattern = rf"(?s){FENCE}{tag}\s*(.*?){FENCE}"
    return F.when(F.rlike(t, F.lit(pattern)), F.regexp_replace(F.regexp_extract(t, pattern, 1), r"\A\s+|\s+\z", ""))


def lines_of(t: Column) -> Column:
    """Lines of a text as array<string>: any of the usual line ends parts them, and one at the end begins no further line."""
    parts = F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def code_lines(t: Column) -> Column:
    """Lines that aren't blank, a comment or part of a triple-quoted block that starts a line."""
    two, one = '"' * 3, "'" * 3
    has = lambda l, q: (F.length(l) - F.length(F.replace(l, F.lit(q), F.lit("")))) == 6

    def step(a: Column, l: Column) -> Column:
        starts = F.startswith(l, F.lit(two)) | F.startswith(l, F.lit(one))
        state = lambda block, n: F.struct(block.alias("block"), n.alias("n"))
        return (
            F.when(a.block, state(~(F.contains(l, F.lit(two)) | F.contains(l, F.lit(one))), a.n))
            .when(starts, state(~(has(l, two) | has(l, one)), a.n))
            .when((l == "") | F.startswith(l, F.lit("#")), a)
            .otherwise(state(F.lit(False), a.n + 1))
        )

    lines = F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.aggregate(lines, F.struct(F.lit(False).alias("block"), F.lit(0).cast("long").alias("n")), step, lambda a: a.n)


#: Fixed patterns of annotations, removed in this order.
SHAPE_COMMENTS = (r"(?dm)[^\S\n]*#[^\S\n]*the initial shape of .*$", r"(?dm)[^\S\n]*#[^\S\n]*output tensor shape.*$", r"(?dm)[^\S\n]+$", r"\A\s+|\s+\z")


def strip_shape_comments(t: Column) -> Column:
    """Code without shape annotations, right-trimmed by line and trimmed whole, with one newline at its end."""
    for pattern in SHAPE_COMMENTS:
        t = F.regexp_replace(t, pattern, "")
    return F.when(t == "", t).otherwise(F.concat(t, F.lit("\n")))


def slug(name: Column) -> Column:
    """Last part of a path-like name in lower case, runs of other signs as one underscore, none at its ends."""
    last = F.element_at(F.split(F.trim(name), "/"), -1)
    return F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_by_sign(name: Column) -> Column:
    """The spelling that shell scripts give a name: each other sign an underscore of its own, none at the ends."""
    last = F.regexp_replace(name, r"^.*/", "")
    return F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9]", "_"), "^_*|_*$", "")


def natural_key(t: Column, lower: bool = True) -> Column:
    """A string whose plain order is the natural order: runs of digits compare as numbers of up to 20 digits."""
    parts = F.regexp_extract_all(F.lower(t) if lower else t, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[0-9]+$")), F.lpad(p, 20, "0")).otherwise(p)), "")


def api_base(name: Column) -> Column:
    """The dotted name before its arguments; NULL with fewer than two parts."""
    base = F.trim(F.substring_index(F.trim(name), "(", 1))
    return F.when(F.size(F.split(base, r"\.")) >= 2, base)


def shape_of(t: Column) -> Column:
    """A tuple such as (1, 3, 32) as array<int>; NULL where it is unknown or not a tuple."""
    inner = F.regexp_extract(t, r"\(([0-9 ,]+)\)", 1)
    return F.when(inner != "", F.transform(F.filter(F.split(inner, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int")))


def frames(t: Column) -> Column:
    """array<struct<file, line>> of a traceback, in its order."""
    pattern = F.lit(r'File "([^"]+)", line (\d+)')
    files, lines = F.regexp_extract_all(t, pattern, F.lit(1)), F.regexp_extract_all(t, pattern, F.lit(2))
    return F.zip_with(files, lines, lambda f, n: F.struct(f.alias("file"), n.cast("int").alias("line")))


def user_frames(t: Column) -> Column:
    """Frames of a traceback that lie in a user's program, not in an installed package, the interpreter or generated code."""
    return F.filter(frames(t), lambda f: ~F.rlike(f["file"], F.lit(r"(?:^<|site-packages/|dist-packages/|/lib/python\d)")))


def crash(t: Column) -> Column:
    """struct<crash_stage, line_no, crash_code> of a traceback's last user frame; NULL without one.

    The stage is forward where that frame is a forward or call method, else init for a constructor, else other.
    """
    own = r'File "(?!<)(?![^"]*(?:site-packages/|dist-packages/|/lib/python\d))[^"]+", line (\d+), in ([^\n]+)\n[ \t]*([^\n]*)'
    part = lambda k: F.try_element_at(F.regexp_extract_all(t, F.lit(own), F.lit(k)), F.lit(-1))
    stage = F.when(part(2).isin("forward", "call"), "forward").when(part(2) == "__init__", "init").otherwise("other")
    return F.when(F.rlike(t, F.lit(own)), F.struct(stage.alias("crash_stage"), part(1).cast("int").alias("line_no"), part(3).alias("crash_code")))


def forward_local(t: Column) -> Column:
    """Root cause of a crash at a call made directly in the forward pass; NULL where the crash lies elsewhere or in self.<name>(...)."""
    at = crash(t)
    local = (at["crash_stage"] == "forward") & F.rlike(at["crash_code"], F.lit(r"\w\s*\(")) & ~F.rlike(at["crash_code"], F.lit(r"\bself\.\w+(?:\.\w+|\[[^\]]*\])*\s*\("))
    return F.when(
        local,
        F.struct(
            at.alias("crash_location"),
            F.struct(at["line_no"].alias("line_no"), at["crash_code"].alias("original_call")).alias("forward_definition"),
            F.create_map().cast("map<string,string>").alias("init_definition"),
            F.lit("Forward_Local_Crash").alias("root_cause_type"),
        ),
    )


def conv_size(size: Column, kernel: Column, stride: Column, padding: Column, mode: str = "valid") -> Column:
    """Output size of a convolution or pooling along one axis; NULL where it isn't positive or the stride isn't."""
    out = {
        "valid": lambda: F.floor((size + 2 * padding - kernel) / stride) + 1,
        "same": lambda: F.floor((size - 1) / stride) + 1,
        "transposed": lambda: (size - 1) * stride - 2 * padding + kernel,
    }[mode]()
    return F.when((stride > 0) & (out > 0), out.cast("long"))
