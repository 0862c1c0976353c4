"""Problem 5: prompt and response pairs with a defect.

The opening sentences of all responses are clustered by verified MinHash: the sketch of a sentence is its least word
shingles in one order of all shingles, rare ones first, and has as many as make any two alike sentences share one; what
shares one is compared. A template that recurs across unrelated prompts, mostly in responses that give no repair, reveals a
refusal, whatever its words. Whether prompts are unrelated is told by MinHash too. Copies, other languages and lost
ends are told by checks of each pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.cuts import cut_values
from loomspark.llm.prose import language, text_outside
from loomspark.session import cut

_WORD = re.compile(r"[^\W_]+")
_UNIT = re.compile(r"[㐀-鿿]|[^\W_]+")
_FENCE_LINE = re.compile(r"(?:`{3,}|~{3,})[ \t]*\w*")
_BLOCK, _TICKED, _DIGITS, _SENTENCE = re.compile(r"`{3,}|~{3,}"), re.compile(r"`[^`\n]*`"), re.compile(r"\d+"), re.compile(r"[.!?。！？\n]+")
_FENCE_OR_WORD = re.compile(r"(?:`{3,}|~{3,})[ \t]*\w*|([^\W_]+)")
#: Fixed words: what stands in a field that holds nothing.
PLACEHOLDERS = frozenset("none|null|nil|nan|na|n a|empty|no answer|no response|no output|answer|response|todo|tbd|pending|undefined|missing|blank".split("|"))
#: Words of a shingle; least share of equal shingles; sentences of an opening and words of each; sentences compared
#: without a split, by a task and among tasks.
SHINGLE, ALIKE, OPENING, WORDS, FEW, HEAVY = 5, 0.8, 3, 24, 64, 10_000
#: Hashes of a prompt's sketch, and how many must differ for two prompts to be unrelated (under half of their shingles are equal).
SKETCH, UNRELATED = 8, 5
#: Share of a template's responses that give no repair, from which it is a refusal's.
REFUSING = 0.5
#: A copy repeats this share of the prompt's shingles, or has nothing of its own; own shingles left to a heading; those
#: looked up before the prompt's shingles are made.
REPEATED, OWN, FIRST = 0.5, 4, 12

#: Fixed patterns: how a prompt asks for a language, its name behind a preposition.
_BEHIND = r"\b(?:in|into|auf|en)\s+(?:\w+\s+)?(?:{0})\b|[用以](?:{1})"
_NAMES = {
    "en": re.compile(_BEHIND.format(r"english|englisch\w*|inglés|inglesa?", "英文|英语"), re.I),
    "de": re.compile(_BEHIND.format(r"german|deutsch\w*|alemán|alemana", "德文|德语"), re.I),
    "es": re.compile(_BEHIND.format(r"spanish|spanisch\w*|español\w*|castellano", "西班牙"), re.I),
    "zh": re.compile(_BEHIND.format(r"chinese|chinesisch\w*|chino|china|mandarin", "中文|汉语"), re.I),
}
_CODE_LINE = re.compile(r"^\s*(?:import |from \S+ import|def |class |return\b|@|#|[\w.\[\]\"' ]+\s*=[^=]|[\w.]+\(.*\)?[,;]?\s*$|[)\]}]+,?;?\s*$|[{\[]\s*$|\"[^\"]*\":|for .*:$|if .*:$|try:|except\b|with .*:$|else:)")


def is_empty(response: str | None) -> bool:
    """Null, blank, a placeholder, signs without a letter or digit, or an empty block."""
    if not response:
        return True
    if len(response) > 200:
        return not any(found.group(1) for found in _FENCE_OR_WORD.finditer(response))
    words = " ".join(_WORD.findall(_FENCE_LINE.sub(" ", response).casefold()))
    return not words or words in PLACEHOLDERS


def is_code(text: str) -> bool:
    """Whether most lines of a text without fences are code."""
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) < 3:
        return False
    return sum(1 for x in lines if _CODE_LINE.match(x)) * 2 > len(lines)


def has_code(response: str) -> bool:
    return "```" in response or "~~~" in response or is_code(response)


def shingles(words: list[str], n: int = SHINGLE) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []


def is_copy(prompt: str, response: str) -> bool:
    """Whether the response repeats the whole prompt or most of it, and adds no more than a heading."""
    r = _UNIT.findall(response.casefold())
    if len(r) < 8:
        return False
    p = _UNIT.findall(prompt.casefold())
    if len(r) * 2 < len(p):
        return False
    # most responses begin with words of their own: more than a heading's shows in the first shingles
    flat, own = f" {' '.join(p)} ", 0
    for i in range(min(FIRST, len(r) - SHINGLE + 1)):
        own += f" {' '.join(r[i : i + SHINGLE])} " not in flat
        if own > OWN:
            return False
    a, b = shingles(p), shingles(r)
    have, repeated = set(a), set(b)
    if sum(1 for x in b if x not in have) > OWN:
        return False
    share = sum(1 for x in a if x in repeated) / max(1, len(a))
    if share < REPEATED:
        return False
    # the prompt's own words, not only the program that it holds
    prose = shingles(_UNIT.findall(text_outside(prompt).casefold()))
    return not prose or sum(1 for x in prose if x in repeated) * 4 >= len(prose)


def wrong_language(prompt: str, response: str) -> bool:
    """Whether the response explains in another language than the prompt's, which the prompt didn't ask for."""
    if "```" not in response and "~~~" not in response and is_code(response):
        return False
    answer = language(response)
    if not answer:
        return False
    asked = language(prompt)
    if not asked or asked == answer:
        return False
    return not _NAMES[answer].search(text_outside(prompt))


def openings(response: str) -> list[str]:
    """Words of the first sentences before any block, numbers and names in backticks left out, so that a template reads alike everywhere."""
    out = []
    for part in _SENTENCE.split(_TICKED.sub(" ", _BLOCK.split(response, maxsplit=1)[0])):
        if words := _UNIT.findall(_DIGITS.sub(" ", part.casefold())):
            out.append(" ".join(words[:WORDS]))
            if len(out) == OPENING:
                break
    return out


def sketch(prompt: str) -> list[int]:
    """Least values of SKETCH hashes over the prompt's shingles; two prompts share each with the chance of their likeness."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    values = np.array([xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in set(shingles(_UNIT.findall(prompt.casefold())))] or [0], np.uint64)
    out = []
    for k in range(SKETCH):
        with np.errstate(over="ignore"):
            x = (values ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(int((x ^ (x >> np.uint64(32))).min() >> np.uint64(1)))
    return out


def specific(prompt: str, response: str) -> bool:
    """Whether the response names something of its prompt: a number, a dotted or quoted name."""
    for found in re.finditer(r"`([^`\n]+)`|\b(\w+\.\w[\w.]*)|\b(\d+)\b", response):
        if (found.group(1) or found.group(2) or found.group(3)) in prompt:
            return True
    return False


def features(records: DataFrame) -> DataFrame:
    """(repair_id, local, wrong, gives, sentences, sketch): what each pair shows by itself.

    gives: whether it holds code or names something of its prompt; sketch is that of the prompt of one that doesn't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, prompt, response in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not prompt or prompt.isspace():
                    continue
                if is_empty(response):
                    out.append((i, "empty", False, True, [], None))
                elif is_copy(prompt, response):
                    out.append((i, "copy", False, True, [], None))
                else:
                    gives = has_code(response) or specific(prompt, response)
                    out.append((i, None, wrong_language(prompt, response), gives, openings(response), None if gives else sketch(prompt)))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["repair_id", "local", "wrong", "gives", "sentences", "sketch"])

    source = records.where("repair_id IS NOT NULL").select(F.col("repair_id").cast("long"), "prompt", "llm_response")
    return source.mapInArrow(run, "repair_id bigint, local string, wrong boolean, gives boolean, sentences array<string>, sketch array<bigint>")


def shared(size: int) -> int:
    """Shingles that a set of this size shares at least with any set alike."""
    return math.ceil(ALIKE * size - 1e-9)


def alike(p: set[str], q: set[str]) -> bool:
    return len(p & q) >= ALIKE * len(p | q)


def links(openings: list[str], orders: list[list[int]], starts: list[int], needs: list[int]) -> list[tuple[str, str]]:
    """Alike pairs that join all openings which are alike, directly or by others; all share what their group is of.

    orders are each opening's shingles, rare ones first; starts the places after the shared ones, the first that a pair
    shares, and needs how many more it shares at least. Many openings are split again by the next shared shingle; what is
    joined already isn't compared.
    """
    sets: dict[int, set[str]] = {}
    root = list(range(len(openings)))
    out = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def words(i: int) -> set[str]:
        if i not in sets:
            sets[i] = set(shingles(openings[i].split()))
        return sets[i]

    def join(i: int, j: int) -> bool:
        if not alike(words(i), words(j)):
            return False
        root[find(j)] = find(i)
        out.append((openings[i], openings[j]))
        return True

    def compare(members: list[int]) -> None:
        groups: dict[int, list[int]] = {}
        for i in members:
            groups.setdefault(find(i), []).append(i)
        done: list[list[int]] = []
        for group in groups.values():
            apart = []
            for other in done:
                if any(join(i, j) for i in group for j in other):
                    group = other + group
                else:
                    apart.append(other)
            done = [*apart, group]

    todo = [[(i, at, need) for i, (at, need) in enumerate(zip(starts, needs))]]
    while todo:
        members = todo.pop()
        first = members[0][0]
        for i, _, _ in members[1:]:
            if find(i) != find(first):
                join(first, i)
        if len({find(i) for i, _, _ in members}) < 2:
            continue
        if len(members) <= FEW or any(need < 1 for _, _, need in members):
            compare([i for i, _, _ in members])
            continue
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for i, at, need in members:
            for k in range(at, len(orders[i]) - need + 1):
                parts.setdefault(orders[i][k], []).append((i, k + 1, need - 1))
        todo += [x for x in parts.values() if len(x) > 1]
    return out


def templates(openings: DataFrame) -> DataFrame:
    """(opening, template): openings whose shingles are alike by ALIKE or more share a template, the least opening.

    Alike openings share one of the first shingles of each, rare ones first; so each opening meets those with which it
    shares one of these, and no pair is missed. The links are followed until no label changes.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {xxh3_64_intdigest(x.encode()) - (1 << 63) for x in shingles(t.split())}
                ids += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], names=["id", "shingle"])

    names = ["shingle", "opening", "keys", "start", "need"]
    kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32())

    def made_rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for opening, order in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = [x["shingle"] for x in order]
                need = shared(len(order))
                out += [(x["shingle"], opening, keys, k + 1, need - 1) for k, x in enumerate(order[: len(order) - need + 1]) if x["n"] > 1]
            yield made_rows(out)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A heavy group's openings by the next shingle that they share with any they are alike to."""
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            out = []
            for shingle, opening, keys, start, need in zip(*(batch.column(k).to_pylist() for k in range(5))):
                for k in range(start, len(keys) - need + 1):
                    both = shingle.to_bytes(8, "little", signed=True) + keys[k].to_bytes(8, "little", signed=True)
                    out.append((xxh3_64_intdigest(both) - (1 << 63), opening, keys, k + 1, need - 1))
            yield made_rows(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(5)))

        def made(found: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(2)], names=["opening", "head"])

        found: list[tuple[str, str]] = []
        for _, members in groupby(rows(), key=lambda r: r[0]):  # sorted by shingle
            members = list(members)
            if len(members) > 1:
                found += links(*(list(x) for x in list(zip(*members))[1:]))
            if len(found) > 10_000:
                yield made(found)
                found = []
        yield made(found)

    distinct = cut(openings.select("opening").distinct().select(F.monotonically_increasing_id().alias("id"), "opening"))
    spreaded = distinct.mapInArrow(spread, "id bigint, shingle bigint")
    often = spreaded.groupBy("shingle").agg(F.count("*").alias("n"))
    orders = spreaded.join(often, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("keys"))
    form = "shingle bigint, opening string, keys array<bigint>, start int, need int"
    met = cut(distinct.join(orders, "id").select("opening", "keys").mapInArrow(prefixes, form))
    while True:  # each time one more shingle is shared, so this ends
        heavy = met.where("need > 0").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("shingle")
        if not heavy.limit(1).count():
            break
        met = cut(met.where("need > 0").join(heavy, "shingle", "left_semi").select(*names).mapInArrow(split, form).unionByName(met.where("need < 1").unionByName(met.where("need > 0").join(heavy, "shingle", "left_anti").select(*names))))
    found = cut(met.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(compare, "opening string, head string").distinct())
    both = found.unionByName(found.select(F.col("head").alias("opening"), F.col("opening").alias("head")))
    labels = distinct.select("opening", F.col("opening").alias("template"))
    while True:  # labels only get less, so this ends
        near = both.join(labels.withColumnRenamed("opening", "head"), "head").groupBy("opening").agg(F.min("template").alias("other"))
        least = labels.join(near, "opening", "left").select("opening", F.col("template").alias("was"), F.least("template", F.coalesce("other", "template")).alias("least"))
        further = labels.select(F.col("opening").alias("least"), F.col("template").alias("further"))
        after = cut(least.join(further, "least").select("opening", F.least("least", "further").alias("template"), (F.col("least") < F.col("was")).alias("moved")))
        moved = after.where("moved").limit(1).count()
        labels = after.select("opening", "template")
        if not moved:
            return labels


def refusals(found: DataFrame) -> DataFrame:
    """(repair_id) of the responses that give no repair and open with a template that refuses.

    A template refuses where it recurs across unrelated prompts, and REFUSING of its responses or more give no repair. Of
    each sentence only counts and the ends of its prompts' sketches are kept, added up before the shuffle: two prompts are
    unrelated where most of the hashes have a least and a greatest value that differ.
    """
    each = found.where("local IS NULL").select("repair_id", "gives", "sketch", F.explode(F.array_distinct("sentences")).alias("opening"))
    ends = [f(F.col("sketch")[k]).alias(f"{n}{k}") for k in range(SKETCH) for n, f in (("low", F.min), ("high", F.max))]
    by = cut(each.groupBy("opening").agg(F.count("*").alias("n"), F.count_if(~F.col("gives")).alias("without"), *ends))
    labels = templates(by)
    other = by.select("opening", "n", "without", *[f"{n}{k}" for k in range(SKETCH) for n in ("low", "high")]).join(labels, "opening")
    whole = other.groupBy("template").agg(F.sum("n").alias("n"), F.sum("without").alias("without"), *[F.min(f"low{k}").alias(f"low{k}") for k in range(SKETCH)], *[F.max(f"high{k}").alias(f"high{k}") for k in range(SKETCH)])
    differ = sum((F.col(f"low{k}") < F.col(f"high{k}")).cast("int") for k in range(SKETCH))
    refusing = whole.where((differ >= UNRELATED) & (F.col("without") >= REFUSING * F.col("n"))).select("template")
    sentences = labels.join(refusing, "template", "left_semi").select("opening")
    return each.where("NOT gives").select("repair_id", "opening").join(sentences, "opening", "left_semi").select("repair_id").distinct()


def defects(records: DataFrame) -> DataFrame:
    """(repair_id, defect): the one defect of each defective pair: empty, copy, refusal, truncated or language.

    Records without a prompt (null or blank) and without an id are left out, and so is what is no defect. Rows with one
    repair_id come out once. An empty table gives no rows. Texts are read whole.
    """
    shown = features(records)
    rest = F.struct(*[c for c in shown.columns if c != "repair_id"])
    found = cut(shown.groupBy("repair_id").agg(F.min(rest).alias("x")).select("repair_id", "x.*"))
    refused = refusals(found).select("repair_id", F.lit(True).alias("refuses"))
    cuts = cut_values(records, ("llm_response",)).select("repair_id", F.lit(True).alias("lost")).distinct()
    whole = found.select("repair_id", "local", "wrong").join(refused, "repair_id", "left").join(cuts, "repair_id", "left")
    defect = F.coalesce(F.col("local"), F.when(F.col("refuses"), "refusal"), F.when(F.col("lost"), "truncated"), F.when(F.col("wrong"), "language"))
    return whole.select("repair_id", defect.alias("defect")).where("defect IS NOT NULL")
