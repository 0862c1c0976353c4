"""Problem 2: programs that differ in format only.

Each program becomes the sequence of its words, with the free orders sorted, and that a 128-bit hash. Each partition
marks its hashes in two blocked Bloom filters, of hashes seen once and seen again; the filters are merged block by
block (a block's bits that two partitions both have among the once-seen are seen again). Hashes outside of the merged
filter of repeats occur once for certain and are emitted as singletons; the others are shuffled and grouped exactly.
The filter grows with the records, so that it lets through the same share at every size; it goes out in waves of blocks
of a bounded size, each of which meets the hashes of its own blocks only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.skew import with_group_values
from loomspark.session import cut, stored

#: Signs written wide stand for the plain ones.
_WIDE = str.maketrans("，（）：；＝｛｝［］", ",():;={}[]")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_WORD = re.compile(r"[^\W_]+")
_IMPORT = re.compile(r"[\W_]*(?:import|from)\b(?=[\W_])", re.I)


class _Reader:
    """Reads words and brackets; the words of a named argument or of an object's key stay with their value."""

    def __init__(self, text: str, mode: str):
        self.text, self.mode = text, mode

    def words(self) -> list[str]:
        """Iterative, as brackets may be nested deep or left open."""
        text, json_mode = self.text, self.mode == "json"
        # frame: [opening sign, is a group of free order, finished items, words of the open item, item's value offset]
        stack: list[list] = [["", False, [], [], False]]
        before = 0  # end of the last token, to see what stands between it and a bracket
        last_word, last_end = "", -1
        definition = False
        for found in _SCAN.finditer(text):
            word, sign = found.group(1), found.group(2)
            frame = stack[-1]
            if word is not None:
                frame[3].append(word.casefold())
                if word.casefold() in ("def", "class"):
                    definition = True
                elif last_end >= 0 and "\n" in text[last_end : found.start()]:
                    definition = False
                last_word, last_end = word, found.end()
                continue
            if sign in "([{":
                called = sign == "(" and not json_mode and last_end >= 0 and text[last_end : found.start()].strip(" _\t") == "" and last_end > before
                free = (called and not definition) or (json_mode and sign == "{")
                stack.append([sign, free, [], [], False])
                before = found.end()
                definition = False
                continue
            before = found.end()
            if sign in ")]}":
                while len(stack) > 1:
                    closed = stack.pop()
                    stack[-1][3] += _close(closed)
                    if _CLOSE[closed[0]] == sign:
                        break
                last_end = -1
                continue
            if sign == "," and frame[1]:
                frame[2].append((frame[4], frame[3]))
                frame[3], frame[4] = [], False
            elif sign in "=:" and frame[1] and not frame[4] and frame[3]:
                if (sign == ":") == json_mode:
                    frame[4] = len(frame[3])
        while len(stack) > 1:
            closed = stack.pop()
            stack[-1][3] += _close(closed)
        return stack[0][3]


_SCAN = re.compile(r"([^\W_]+)|([(){}\[\],:]|(?<![=!<>:+\-*/%&|^@~])=(?!=))")


def _close(frame: list) -> list[str]:
    """Words of a closed bracket: of a free group, the named items in the order of name and value, in the named places."""
    items = [*frame[2], (frame[4], frame[3])] if frame[3] or frame[2] else []
    if not frame[1]:
        return frame[3]
    named = sorted(w for n, w in items if n)
    out: list[str] = []
    k = 0
    for n, w in items:
        if n:
            out += named[k]
            k += 1
        else:
            out += w
    return out


#: Words of statements read before, joined by spaces, and how many brackets they leave open.
_KNOWN: dict[str, tuple[str, int]] = {}
_KEPT = 200_000


def _statement(text: str) -> tuple[str, int]:
    known = _KNOWN.get(text)
    if known is None:
        depth = sum(map(text.count, "([{")) - sum(map(text.count, ")]}"))
        known = (" ".join(_Reader(text, "py").words()), depth)
        if len(text) < 600:
            if len(_KNOWN) >= _KEPT:
                _KNOWN.clear()
            _KNOWN[text] = known
    return known


def _statements(lines: list[str]) -> list[str]:
    """Words of the lines; lines go together while a bracket is open, so that a call is read as one."""
    out, held, depth = [], [], 0
    for line in lines:
        line = line.strip()
        if not line:
            continue
        words, open_ = _statement(line)
        if not held and open_ <= 0:
            if words:
                out.append(words)
            continue
        held.append(line)
        depth += open_
        if depth <= 0:
            if words := _statement("\n".join(held))[0]:
                out.append(words)
            held, depth = [], 0
    if held:
        if words := _statement("\n".join(held))[0]:
            out.append(words)
    return out


def canonical(code: str | None, language: str) -> str:
    """Words of a program, joined by spaces, with its free orders sorted; '' for null and blank code."""
    if not code:
        return ""
    code = code.translate(_WIDE) if not code.isascii() else code
    if language == "json":
        return " ".join(_Reader(code, "json").words())
    if "\r" in code:
        code = code.replace("\r\n", "\n").replace("\r", "\n")
    lines = code.split("\n")
    first = next((i for i, line in enumerate(lines) if _IMPORT.match(line)), None)
    if first is None:
        return " ".join(_statements(lines))
    end, heads = first, []
    while end < len(lines):
        if _IMPORT.match(lines[end]):
            heads.append(" ".join(_WORD.findall(lines[end].casefold())))
        elif _WORD.search(lines[end]):
            break
        end += 1
    return " ".join([*_statements(lines[:first]), *sorted(heads), *_statements(lines[end:])])


BLOCK_BITS = 32768
#: Bits of the filters: 12 a record or more. WAVE blocks (32 MB) are broadcast at once; pieces of a block are merged in
#: MERGES parts before the last merge.
LEAST_BLOCKS, WAVE, BITS_A_RECORD, PROBES, MERGES = 4, 8192, 12, 4, 64


def hashes(records: DataFrame) -> DataFrame:
    """(repair_id, h1, h2: the 128-bit hash of the canonical words); code without words is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            ids, a, b = [], [], []
            for i, name, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = canonical(code, "json" if name and name.strip().lower().endswith("json") else "py")
                if text:
                    h = xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
                    ids.append(i)
                    a.append((h >> 64) - (1 << 63))
                    b.append((h & (1 << 64) - 1) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["repair_id", "h1", "h2"])

    return records.where("repair_id IS NOT NULL AND repaired_code IS NOT NULL").select("repair_id", "filename", "repaired_code").mapInArrow(run, "repair_id bigint, h1 bigint, h2 bigint")


def _blocks(rows: int) -> int:
    return max(LEAST_BLOCKS, 1 << (max(1, rows * BITS_A_RECORD // BLOCK_BITS) - 1).bit_length())


def repeat_filter(found: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the merged filter of hashes that occur more than once, without its empty blocks."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        seen: dict[int, np.ndarray] = {}

        def of(block: int) -> np.ndarray:
            if block not in seen:
                seen[block] = np.zeros((2, BLOCK_BITS // 8), np.uint8)
            return seen[block]

        for batch in batches:
            h1 = batch.column(0).to_numpy(zero_copy_only=False)
            h2 = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            where = np.mod(h1, blocks)
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            for part in np.split(order, cuts) if len(order) else ():
                bits = of(int(where[part[0]]))
                # equal hashes of one batch first, then those that the filter holds already
                values, counts = np.unique(h2[part], return_counts=True)
                spots = np.stack([(values >> np.uint64(15 * k)) & np.uint64(BLOCK_BITS - 1) for k in range(PROBES)]).astype(np.int64)
                held = ((bits[0][spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).all(axis=0)
                again = spots[:, held | (counts > 1)].ravel()
                np.bitwise_or.at(bits[1], again >> 3, (1 << (again & 7)).astype(np.uint8))
                # two new hashes of one batch may cover a third's bits; that only sends it to the exact grouping later
                flat = spots.ravel()
                np.bitwise_or.at(bits[0], flat >> 3, (1 << (flat & 7)).astype(np.uint8))
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([zlib.compress(seen[k].tobytes(), 1) for k in keys], pa.binary())], names=["block", "pair"])

    def merge(pdf):
        import zlib

        import numpy as np
        import pandas as pd

        once = again = None
        for raw in pdf["pair"]:
            o, a = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(2, -1)
            if once is None:
                once, again = o, a
            else:
                once, again = once | o, again | a | (once & o)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "pair": [zlib.compress(np.stack([once, again]).tobytes(), 1)]})

    def last(pdf):
        import zlib

        pdf = merge(pdf)
        return pdf.assign(bits=[zlib.decompress(x)[BLOCK_BITS // 8 :] for x in pdf["pair"]])[["block", "bits"]]

    pieces = found.select("h1", "h2").mapInArrow(mark, "block bigint, pair binary").withColumn("part", F.spark_partition_id() % MERGES)
    merged = pieces.groupBy("block", "part").applyInPandas(merge, "block bigint, pair binary")
    return merged.groupBy("block").applyInPandas(last, "block bigint, bits binary")


def _hit() -> Column:
    """Whether a block's bits hold a hash at all of its places."""
    hit = None
    for k in range(PROBES):
        byte = F.conv(F.hex(F.expr(f"substring(bits, cast((shiftrightunsigned(h2, {15 * k}) & {BLOCK_BITS - 1}L) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        test = byte.bitwiseAND(F.expr(f"cast(shiftleft(1, cast(shiftrightunsigned(h2, {15 * k}) & 7L as int)) as int)")) > 0
        hit = test if hit is None else hit & test
    return hit


def canonical_groups(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(possible repeats with first_id, least repair_id of the group, and copies, its size; certain singletons).

    Both have repair_id, h1, h2. Repeated deliveries of one repair_id are one record.
    """
    # in the order of waves within each partition, so that a wave reads only its own row groups
    blocks = _blocks(records.count())
    waves = max(1, blocks // WAVE)
    found = hashes(records).withColumn("block", F.expr(f"pmod(h1, {blocks}L)")).withColumn("wave", F.expr(f"cast(block div {WAVE} as int)"))
    found = stored(found.sortWithinPartitions("wave") if waves > 1 else found)
    rows = found.count()
    bits = stored(repeat_filter(found, blocks).withColumn("wave", F.expr(f"cast(block div {WAVE} as int)")))
    marked = None
    for wave in range(waves):
        part, held = (found, bits) if waves == 1 else (found.where(F.col("wave") == wave), bits.where(F.col("wave") == wave))
        one = part.join(F.broadcast(held.select("block", "bits")), "block", "left").withColumn("again", F.coalesce(_hit(), F.lit(False)))
        one = one.select("repair_id", "h1", "h2", "again")
        marked = one if marked is None else marked.unionByName(one)
    if waves > 1:
        marked = stored(marked)
    again = marked.where("again").select("repair_id", "h1", "h2").distinct()
    again = cut(again.withColumn("key", F.struct("h1", "h2")))
    grouped = with_group_values(again, "key", {"first_id": F.min("repair_id"), "copies": F.count("*")}, max(1, rows)).drop("key")
    return grouped, marked.where("NOT again").select("repair_id", "h1", "h2")


def copy_pairs(records: DataFrame) -> DataFrame:
    """(first_id, copy_id): each record beside the least repair_id with the same program, that one left out.

    Null and blank code and code without a letter or digit are left out, as are null ids; an empty table gives no
    rows; ties don't arise, as ids are distinct; other columns aren't read; texts are read whole.
    """
    grouped, _ = canonical_groups(records)
    return grouped.where("repair_id <> first_id").select("first_id", F.col("repair_id").alias("copy_id"))


def collapsed(records: DataFrame) -> DataFrame:
    """(first_id, copies): each program once, singletons with 1."""
    grouped, single = canonical_groups(records)
    whole = grouped.where("repair_id = first_id").select("first_id", "copies")
    return whole.unionByName(single.select(F.col("repair_id").alias("first_id"), F.lit(1).cast("long").alias("copies")))
