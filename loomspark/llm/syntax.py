"""Problem 3: source files that their language's grammar rejects.

A file is cut into chunks at line ends. Each chunk gives its state map: for every lexer state that it may be entered
in, the state that it leaves in and the brackets that it closes and leaves open. Maps of adjoining chunks combine
associatively, so a file's chunks are summarised wherever they lie: where a task holds all of them, by that task, and
those of a longer file by a tree over partitions. The combined maps tell each chunk where it begins in the file, so that
its balanced statements can be cut out. They are parsed one by one by a local grammar, never the file as a whole, and
become an outline of their indentation and kinds, which folds associatively as well. A file is valid where its map
leaves nothing open, no statement is refused and the outline folds into one block. The lines of JSON give symbols, and
balanced groups of these fold into values.
"""

from __future__ import annotations

import ast
import io
import json
import re
import tokenize
import warnings
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.prose import slug
from loomspark.session import cut

#: Characters of a chunk, of which a task holds HELD of one file; chunks of a longer file are spread, GROUP to a node of the tree.
CHUNK, HELD, GROUP = 1024, 1024, 64
#: Entries of each cache of lines and statements.
KEPT = 50_000

CODE, SINGLE, DOUBLE, TRIPLE_SINGLE, TRIPLE_DOUBLE = range(5)
STATES = (CODE, SINGLE, DOUBLE, TRIPLE_SINGLE, TRIPLE_DOUBLE)
_QUOTE = {"'": SINGLE, '"': DOUBLE, "'''": TRIPLE_SINGLE, '"""': TRIPLE_DOUBLE}
_ENDS = {SINGLE: re.compile(r"\\.|'|\n", re.S), DOUBLE: re.compile(r'\\.|"|\n', re.S), TRIPLE_SINGLE: re.compile(r"\\.|'''", re.S), TRIPLE_DOUBLE: re.compile(r'\\.|"""', re.S)}
_CODE = re.compile(r"'''|\"\"\"|'|\"|#[^\n]*|[()\[\]{}]|\\\r?\n")
_OPENS = {")": "(", "]": "[", "}": "{"}

#: (state at the end, closing brackets without their opening, opening brackets without their closing, line is continued)
Summary = tuple[int, str, str, bool]
START: Summary = (CODE, "", "", False)


def summary(text: str, state: int = CODE) -> Summary:
    """What a chunk that starts and ends at a line does to the lexer when entered in the state."""
    at, closers, openers, size = 0, [], [], len(text)
    continued = False
    while at < size:
        if state != CODE:
            found = _ENDS[state].search(text, at)
            if not found:
                return state, "".join(closers), "".join(openers), False
            at = found.end()
            if found.group()[0] != "\\":
                state = CODE
            elif at >= size:
                return state, "".join(closers), "".join(openers), False
            continue
        found = _CODE.search(text, at)
        if not found:
            break
        sign, at = found.group(), found.end()
        if sign in _QUOTE:
            state = _QUOTE[sign]
        elif sign in "([{":
            openers.append(sign)
        elif sign in ")]}":
            if openers and openers[-1] == _OPENS[sign]:
                openers.pop()
            elif openers:
                closers.append("!")  # crossed brackets: no later chunk heals them
            else:
                closers.append(sign)
        elif sign[0] == "\\":
            continued = at >= size
    return state, "".join(closers), "".join(openers), continued


def combine(a: Summary, b: Summary) -> Summary:
    """Summary of two adjoining chunks, b entered in the state that a left; associative."""
    openers, closers = a[2], a[1]
    for sign in b[1]:
        if openers and sign != "!" and openers[-1] == _OPENS[sign]:
            openers = openers[:-1]
        elif openers:
            closers += "!"
        else:
            closers += sign
    return b[0], closers, openers + b[2], b[3]


StateMap = tuple[Summary, ...]


#: Maps and items that are equal are kept once; lines have few different ones.
_SHARED: dict = {}


def _shared(value):
    if len(_SHARED) >= KEPT:
        _SHARED.clear()
    return _SHARED.setdefault(value, value)


@lru_cache(KEPT)
def _line_map(line: str) -> StateMap:
    return _shared(tuple([summary(line, s) for s in STATES]))


def line_map(line: str) -> StateMap:
    return _line_map(line) if len(line) < 500 else _line_map.__wrapped__(line)


def combine_maps(a: StateMap, b: StateMap) -> StateMap:
    return tuple([combine(x, b[x[0]]) for x in a])


IDENTITY: StateMap = tuple([(s, "", "", False) for s in STATES])


def state_map(lines: Iterable[str]) -> StateMap:
    """A chunk's summary for every state that it may be entered in, combined from those of its lines."""
    out = IDENTITY
    for line in lines:
        m = line_map(line)
        if m[0] != START or out[0][0] != CODE:
            out = combine_maps(out, m)
        else:  # a line that is balanced and plain in code: only strings that were open are ended or go on
            out = tuple([(CODE, x[1], x[2], False) if x[0] == CODE else combine(x, m[x[0]]) for x in out])
    return out


def lines_of(text: str) -> list[str]:
    """Lines with their ends as the language reads them: a carriage return ends a line too."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = [x + "\n" for x in text.split("\n")]
    if lines[-1] == "\n":
        lines.pop()
    return lines


def chunks(lines: list[str], size: int | None = None) -> Iterator[list[str]]:
    """Runs of lines of CHUNK characters or a little more."""
    size = size or CHUNK
    held, n = [], 0
    for line in lines:
        held.append(line)
        n += len(line)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def pieces(lines: list[str], entry: Summary = START) -> tuple[str, list[str], str]:
    """(rest of the statement open at the entry, statements that begin and end here, beginning of the one left open).

    Blank lines and comments between statements are statements of their own. A chunk within one statement is all rest.
    """
    head, out, held = "", [], []
    inside = entry[0] != CODE or bool(entry[2]) or entry[3]
    here, trivial = entry, not inside
    for line in lines:
        if trivial:
            here = line_map(line)[0]
            if here == START:
                out.append(line)
                continue
        else:
            here = combine(here, line_map(line)[here[0]])
        held.append(line)
        trivial = here[0] == CODE and not here[2] and not here[3]
        if trivial:
            if inside:
                head, inside = "".join(held), False
            else:
                out.append("".join(held))
            held = []
    rest = "".join(held)
    return (rest, out, "") if inside else (head, out, rest)


def _tree(text: str) -> list[ast.stmt] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text).body
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None


#: What may stand before a statement of a block: nothing pending (N), a closed if or elif (I), loop (L), try (T), except
#: (E), except* (A), else of a try (Y), a decorator (D), the cases of a match (M); small letters wait for their block.
PLACES = "NILTEAYDMniteaylmc"
_FREE = "NILEAY"
_ENDING = frozenset("NILEAYM")
_CLOSED = {"n": "N", "i": "I", "l": "L", "t": "T", "e": "E", "a": "A", "y": "Y", "m": "N", "c": "M"}
#: Kinds of statements: from which places each may follow, and the place after it if its block is yet to come.
_MOVES: dict[str, dict[str, str]] = {
    "S": dict.fromkeys(_FREE, "N"), "D": dict.fromkeys(_FREE + "D", "D"), "def": dict.fromkeys(_FREE + "D", "n"), "with": dict.fromkeys(_FREE, "n"), "if": dict.fromkeys(_FREE, "i"),
    "loop": dict.fromkeys(_FREE, "l"), "try": dict.fromkeys(_FREE, "t"), "match": dict.fromkeys(_FREE, "m"), "elif": {"I": "i"}, "else": {"I": "n", "L": "n", "E": "y", "A": "y"},
    "except": {"T": "e", "E": "e"}, "except*": {"T": "a", "A": "a"}, "finally": dict.fromkeys("TEAY", "n"), "case": {"M": "c"}, "S or case": {**dict.fromkeys(_FREE, "N"), "M": "M"},
}
BAD = "x" * len(PLACES)


def _move(kind: str, whole: bool) -> str:
    """For each place before a statement of the kind, the place after it; whole: its block stands on its own line."""
    to = {p: _CLOSED.get(q, q) if whole else q for p, q in _MOVES[kind].items()}
    return "".join(to.get(p, "x") for p in PLACES)


_MOVE = {(k, w): _move(k, w) for k in _MOVES for w in (False, True)}


@lru_cache(10_000)
def follow(a: str, b: str) -> str:
    """The move of one run of statements and then another in the same block."""
    return "".join([b[PLACES.index(p)] if p != "x" else "x" for p in a])


@lru_cache(10_000)
def enclose(outer: str, inner: str) -> str:
    """The move of a run whose last statement has the inner run as its block."""
    out = []
    for p in outer:
        if p not in _CLOSED:
            out.append("x")  # no block was waited for
            continue
        end = inner[PLACES.index("M" if p == "m" else "N")]
        out.append(_CLOSED[p] if end in _ENDING else "x")
    return "".join(out)


_NODES = {ast.If: "if", ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop", ast.With: "with", ast.AsyncWith: "with", ast.FunctionDef: "def", ast.AsyncFunctionDef: "def", ast.ClassDef: "def", ast.Try: "try", ast.TryStar: "try", ast.Match: "match"}
_CLAUSE = re.compile(r"(elif|else|except|finally)\b")
_FIRST = {"elif": "if 1:\n pass\n", "else": "if 1:\n pass\n", "except": "try:\n pass\n", "finally": "try:\n pass\n"}
_SOFT = re.compile(r"case\b")
_NUMBER = re.compile(r"(?<![\w.])(?:[1-9][0-9]{0,17}|[0-9]{1,9}\.[0-9]{1,9})(?![\w.])")
_STRINGS = {'"': re.compile(r'"([^"\n]*)"'), "'": re.compile(r"'([^'\n]*)'")}
_PLAIN = re.compile(r"[A-Za-z0-9_ ./-]*\Z").match


def plainly(text: str) -> str:
    """The statement with plain numbers and strings replaced by one of their sort, so that its like is parsed once."""
    text = _NUMBER.sub(lambda m: "1.0" if "." in m.group() else "1", text)
    if "#" in text or "\\" in text:
        return text
    for quote, other in (('"', "'"), ("'", '"')):
        if quote in text and other not in text and quote * 3 not in text:
            return _STRINGS[quote].sub(lambda m: f"{quote}s{quote}" if _PLAIN(m.group(1)) else m.group(), text)
    return text


def _one(tree: list[ast.stmt] | None) -> str | None:
    """Kind of a statement that parses with its block; simple ones may stand in one line, parted by semicolons."""
    if tree is None or any(b.lineno != a.end_lineno for a, b in zip(tree, tree[1:])):
        return None  # a line's end within: the statement was cut too late
    return _NODES.get(type(tree[0]), "S") if len(tree) == 1 else "S"


@lru_cache(KEPT)
def _local(text: str) -> str | None:
    """Move of one statement by the grammar of statements alone; None if it is refused."""
    if clause := _CLAUSE.match(text):
        word = clause.group(1)
        kind = "except*" if word == "except" and re.match(r"except\s*\*", text) else word
        for rest, whole in ((text, True), (text + "\n pass", False)):
            tree = _tree(_FIRST[word] + rest)
            if tree is not None and len(tree) == 1:
                return _MOVE[kind, whole]
        return None
    if text[0] == "@":
        tree = _tree(text + "\ndef f(): pass")
        return _MOVE["D", False] if tree is not None and len(tree) == 1 and len(tree[0].decorator_list) == 1 else None
    soft = _SOFT.match(text) is not None
    if kind := _one(tree := _tree(text)):
        if soft and kind == "S" and _tree(f"match 0:\n {text}"):
            kind = "S or case"
        return _MOVE[kind, True]
    if tree is not None:
        return None
    tree = _tree(text + "\n pass")
    if tree and len(tree) == 1 and type(tree[0]) in _NODES:
        return _MOVE[_NODES[type(tree[0])], False]
    tree = _tree(text + "\nexcept: pass")
    if tree and len(tree) == 1:
        return _MOVE["try", True]
    tree = _tree(text + "\n pass\nexcept: pass")
    if tree and len(tree) == 1 and isinstance(tree[0], ast.Try):
        return _MOVE["try", False]
    if soft:
        for rest, whole in ((text, True), (text + "\n  pass", False)):
            tree = _tree(f"match 0:\n {rest}")
            if tree and len(tree) == 1 and len(tree[0].cases) == 1:
                return _MOVE["case", whole]
    tree = _tree(text + "\n case 0: pass")
    return _MOVE["match", False] if tree and len(tree) == 1 and isinstance(tree[0], ast.Match) else None


#: (column, column with tabs as one place, move) of a run of statements of one block.
Item = tuple[int, int, str]


def indentation(text: str) -> tuple[int, int, int]:
    """(characters, column, column where a tab is one place) of the white space before a statement.

    Where the line is continued before the statement, the place of the first such backslash holds, unless it is the first.
    """
    column = narrow = first = n = 0
    while n < len(text):
        sign = text[n]
        if sign == " ":
            column, narrow = column + 1, narrow + 1
        elif sign == "\t":
            column, narrow = (column // 8 + 1) * 8, narrow + 1
        elif sign == "\f":
            column = narrow = 0
        elif text.startswith("\\\n", n):
            first, n = first or column, n + 1
        else:
            break
        n += 1
    return (n, first, first) if first else (n, column, narrow)


def _item(statement: str) -> Item | None | tuple[()]:
    n, column, narrow = indentation(statement)
    text = statement[n:]
    if not text or text[0] in "#\n":
        return ()
    text = plainly(text)
    move = _local(text) if len(text) < 500 else _local.__wrapped__(text)
    return _shared((column, narrow, move)) if move else None


_item_kept = lru_cache(KEPT)(_item)


def item(statement: str) -> Item | None | tuple[()]:
    """A statement's place and move; () for blanks and comments, None if it is refused."""
    return _item_kept(statement) if len(statement) < 500 else _item(statement)


def fold(items: Iterable[Item]) -> list[Item] | None:
    """Outline of a run of statements, with every block that is closed within put into its header; associative.

    What is left goes down to the least indentation and up again, as brackets do. None if something doesn't fit.
    """
    out: list[Item] = []
    for now in items:
        while out:
            top = out[-1]
            if now[0] == top[0]:
                move = follow(top[2], now[2])
                if now[1] != top[1] or move == BAD:
                    return None
                out[-1] = (top[0], top[1], move)
                break
            if now[0] > top[0]:
                if now[1] <= top[1]:
                    return None
                out.append(now)
                break
            if len(out) < 2 or out[-2][0] > top[0]:
                out.append(now)  # the block began before this run
                break
            before = out[-2]
            if now[0] > before[0]:
                return None  # back to an indentation that no block has
            move = enclose(before[2], top[2])
            if move == BAD:
                return None
            out[-2:] = [(before[0], before[1], move)]
        else:
            out.append(now)
    return out


def closed(outline: list[Item] | None) -> bool:
    """Whether the outline of a whole file is one block, with all headers followed by theirs."""
    if outline is None or len(outline) > 100:
        return False
    while len(outline) > 1:
        before, top = outline[-2:]
        if before[0] >= top[0]:
            return False
        outline = [*outline[:-2], (before[0], before[1], enclose(before[2], top[2]))]
    return not outline or outline[0][0] == 0 and outline[0][2][0] in _ENDING


#: Strings whose fields may hold quotes of their own kind, brackets or line ends, which the state maps don't follow.
_FIELDS = re.compile(r"\b(?:[fF][rR]?|[rR][fF])(?:'|\")")


def exactly(text: str) -> list[str] | None:
    """Statements as the language's own tokenizer cuts them; None where it refuses the text."""
    lines = lines_of(text)
    out, first = [], 1
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.NEWLINE:
                statement = "".join(lines[first - 1 : token.end[0]])
                while statement.startswith("\n", n := indentation(statement)[0]):  # continued blank lines before it
                    statement = statement[n + 1 :]
                out.append(statement)
                first = token.end[0] + 1
            elif token.type in (tokenize.NL, tokenize.COMMENT) and token.start[0] == first and not lines[first - 1][: token.start[1]].strip():
                first += 1
    except (tokenize.TokenError, SyntaxError, ValueError):
        return None
    return out


def outline(statements: Iterable[str]) -> list[Item] | None:
    items = []
    for s in statements:
        got = item(s)
        if got is None:
            return None
        if got:
            items.append(got)
    return fold(items)


def at_border(here: Summary) -> bool:
    return here[0] == CODE and not here[2] and not here[3]


def python_valid(text: str) -> bool:
    """Whether the chunks' maps, statements and outlines make a whole program."""
    if "\0" in text:
        return False
    lines = lines_of(text)
    here, held, out = START, "", []
    for part in chunks(lines):
        head, whole, tail = pieces(part, here)
        inside, here = not at_border(here), combine(here, state_map(part)[here[0]])
        if here[1]:
            break  # a bracket is closed that wasn't open
        if inside:
            held += head
            if whole or tail or at_border(here):
                whole, held = [held, *whole], ""
        found = outline(whole)
        if found is None:
            break
        out += found
        held += tail
    else:
        if at_border(here) and closed(fold(out)):
            return True
    return bool(_FIELDS.search(text)) and exactly_valid("".join(lines))


def exactly_valid(text: str) -> bool:
    try:
        statements = exactly(text)
    except SystemError:  # the tokenizer itself breaks on some broken strings
        return _tree(text) is not None
    return statements is not None and closed(outline(statements))


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![\w.+-]))')
_BLANK = re.compile(r"[ \t\n\r]*\Z")
_OBJECT = re.compile(r"(?:(?:s:[sv]|m)(?:,(?:s:[sv]|m))*)?").fullmatch
_ARRAY = re.compile(r"(?:[sv](?:,[sv])*)?").fullmatch
_SHORTER = ((re.compile(r"(?<=,)s:[sv](?=,)"), "m"), (re.compile(r"(?<=,)s(?=,)"), "v"), (re.compile(r",m(?:,m)+(?=,)"), ",m"), (re.compile(r",v(?:,v)+(?=,)"), ",v"))


@lru_cache(KEPT)
def _symbols(line: str) -> str:
    out, at, size = [], 0, len(line)
    while at < size:
        found = _TOKEN.match(line, at)
        if not found:
            return "".join(out) if _BLANK.match(line, at) else "x"
        out.append(found.group(1) or ("s" if found.group(2) else "v"))
        at = found.end()
    return "".join(out)


def symbols(line: str) -> str:
    """Signs of a line of JSON, s for a string and v for another value; x where it holds anything else."""
    return _symbols(line) if len(line) < 500 else _symbols.__wrapped__(line)


def _tidy(content: str) -> str:
    """Members and values between commas, all of a kind, count as one; what stands at the ends may still belong to others."""
    if len(content) > 40:
        for pattern, short in _SHORTER:
            content = pattern.sub(short, content)
    return content


def json_fold(text: str) -> str:
    """Symbols with every balanced object and array put into one value; associative under joining, x if something doesn't fit."""
    if "x" in text:
        return "x"
    stack: list[tuple[str, list[str]]] = [("", [])]
    for sign in text:
        if sign in "{[":
            stack.append((sign, []))
        elif sign in "}]" and len(stack) > 1:
            opener, content = stack.pop()
            if opener != _OPENS[sign] or not (_OBJECT if sign == "}" else _ARRAY)("".join(content)):
                return "x"
            stack[-1][1].append("v")
        else:
            stack[-1][1].append(sign)
    return "".join([opener + _tidy("".join(content)) for opener, content in stack])


def json_valid(text: str) -> bool:
    """Whether the chunks' symbols fold into one value."""
    folded = [json_fold("".join(map(symbols, part))) for part in chunks(text.split("\n"))]
    return json_fold("".join(folded)) in ("s", "v")


def valid(code: str, language: str) -> bool:
    """Whether the language's grammar accepts the code."""
    return json_valid(code) if language == "json" else python_valid(code)


def _language(name: str = "filename"):
    return F.lower(F.regexp_extract(name, r"\.(\w+)\s*$", 1))


def invalid_ids(records: DataFrame) -> DataFrame:
    """(repair_id) of the records whose repaired_code is rejected by the grammar of its file name's extension.

    Null and blank code is no case; other extensions, null names and null ids aren't judged. Records with equal ids come
    out once. Texts are judged whole, whatever their length: those of more than HELD chunks by tasks that have a few of
    the chunks each. An empty table gives no rows; other columns aren't read.
    """
    found = cut(_chunked(records))
    short = found.where("file IS NULL").select("repair_id")
    most = found.agg(F.max("no")).first()[0]
    if most is None:
        return short.distinct()
    files = found.where("file IS NOT NULL")
    return short.unionByName(_spread(files.where("language = 'py'"), most)).unionByName(_spread_json(files.where("language = 'json'"), most)).distinct()


CHUNKED = "repair_id bigint, file bigint, language string, no int, part string, map string"


def _chunked(records: DataFrame) -> DataFrame:
    """Ids of the invalid files whose chunks a task holds, and the chunks of the others with their maps."""
    chunk, held, group = CHUNK, HELD, GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            out: list[tuple] = []
            for i, file, language, code in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not code or code.isspace():
                    continue
                if len(code) <= chunk * held:
                    if not valid(code, language):
                        out.append((i, None, None, None, None, None))
                    continue
                lines = lines_of(code) if language == "py" else [x + "\n" for x in code.split("\n")]
                for no, part in enumerate(chunks(lines, chunk * group)):
                    made = json.dumps(state_map(part)) if language == "py" else json_fold("".join(map(symbols, part)))
                    out.append((i, file, language, no, "".join(part), made))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["repair_id", "file", "language", "no", "part", "map"])

    rows = records.where("repair_id IS NOT NULL AND repaired_code IS NOT NULL").select(F.col("repair_id").cast("long"), F.monotonically_increasing_id().alias("file"), _language().alias("language"), F.col("repaired_code").alias("code"))
    return rows.where(F.col("language").isin("py", "json")).mapInArrow(run, CHUNKED)


def _levels(rows: DataFrame, most: int, join) -> list[DataFrame]:
    """Values (file, no, map) and those of runs of GROUP of them, up to one a file; join puts a run's values together."""

    def up(key, pdf):
        import pandas as pd

        return pd.DataFrame({"file": [key[0]], "no": [key[1]], "map": [join(pdf.sort_values("no")["map"])]})

    levels = [rows]
    while most > 0:
        most //= GROUP
        below = levels[-1].withColumn("g", F.expr(f"cast(no div {GROUP} as int)"))
        levels.append(cut(below.groupBy("file", "g").applyInPandas(up, "file bigint, no int, map string")))
    return levels


def _maps(raw: str) -> StateMap:
    return tuple([tuple(x) for x in json.loads(raw)])


def _spread(files: DataFrame, most: int) -> DataFrame:
    """Invalid Python files among those whose chunks are spread."""
    from pyspark.sql import Window as W

    def join_maps(maps) -> str:
        out = IDENTITY
        for m in maps:
            out = combine_maps(out, _maps(m))
        return json.dumps(out)

    def entries(pdf):
        pdf = pdf.sort_values("no")
        here, out = tuple(json.loads(pdf["entry"].iloc[0])), []
        for m in pdf["map"]:
            out.append(json.dumps(here))
            here = combine(here, _maps(m)[here[0]])
        return pdf.assign(entry=out)[["file", "no", "entry"]]

    def statements(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for file, no, part, entry in zip(pdf["file"], pdf["no"], pdf["part"], pdf["entry"]):
                head, whole, tail = pieces(lines_of(part), tuple(json.loads(entry)))
                out.append((file, no, 1, json.dumps(None if "\0" in part else outline(whole))))
                out += [(file, no, k, text) for k, text in ((0, head), (2, tail)) if text]
            yield pd.DataFrame(out, columns=["file", "no", "k", "text"])

    def one(frames):
        for pdf in frames:
            yield pdf.assign(map=[json.dumps(outline([x])) for x in pdf["text"]])[["file", "no", "map"]]

    def join_outlines(outlines) -> str:
        items = [json.loads(x) for x in outlines]
        return json.dumps(None if None in items else fold([tuple(i) for x in items for i in x]))

    def ends(frames):
        for pdf in frames:
            good = []
            for raw, lines in zip(pdf["map"], pdf["outline"]):
                end, items = _maps(raw)[CODE], json.loads(lines)
                good.append(at_border(end) and not end[1] and items is not None and closed([tuple(i) for i in items]))
            yield pdf[["file"]].assign(good=good)

    def again(key, pdf):
        import pandas as pd

        text = "".join(pdf.sort_values("no")["part"])
        bad = "\0" in text or not (_FIELDS.search(text) and exactly_valid(text))
        return pd.DataFrame({"repair_id": [pdf["repair_id"].iloc[0]] if bad else []})

    levels = _levels(files.select("file", "no", "map"), most, join_maps)
    begin = levels[-1].select("file", "no", F.lit(json.dumps(START)).alias("entry"))
    for level in reversed(levels[:-1]):
        run = F.expr(f"cast(no div {GROUP} as int)")
        begin = level.withColumn("g", run).join(begin.withColumnRenamed("no", "g"), ["file", "g"]).groupBy("file", "g").applyInPandas(entries, "file bigint, no int, entry string")
    cuts = cut(files.select("file", "no", "part").join(begin, ["file", "no"]).mapInPandas(statements, "file bigint, no int, k int, text string"))
    # a statement that goes over chunks is put together again: the ends belong to the last beginning before them
    loose = cuts.where("k <> 1")
    owner = loose.select("file", "no", "k").withColumn("g", F.last(F.when(F.col("k") == 2, F.col("no")), True).over(W.partitionBy("file").orderBy("no", "k")))
    whole = loose.join(owner, ["file", "no", "k"]).groupBy("file", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "k", "text"))), lambda x: x.text), "").alias("text"))
    over = whole.select("file", (F.col("g") * 2 + 1).alias("no"), "text").mapInPandas(one, "file bigint, no int, map string")
    outlines = cuts.where("k = 1").select("file", (F.col("no") * 2).alias("no"), F.col("text").alias("map")).unionByName(over)
    folded = _levels(outlines, most * 2 + 1, join_outlines)[-1]
    judged = levels[-1].select("file", "map").join(folded.select("file", F.col("map").alias("outline")), "file").mapInPandas(ends, "file bigint, good boolean")
    return files.select("file", "no", "repair_id", "part").join(judged.where("NOT good").select("file"), "file", "left_semi").groupBy("file").applyInPandas(again, "repair_id bigint")


def _spread_json(files: DataFrame, most: int) -> DataFrame:
    """Invalid JSON files among those whose chunks are spread."""
    folded = _levels(files.select("file", "no", "map"), most, lambda parts: json_fold("".join(parts)))[-1]
    bad = folded.where("map NOT IN ('s', 'v')").select("file")
    return files.where("no = 0").join(bad, "file", "left_semi").select("repair_id")


def invalid_rates(records: DataFrame, found: DataFrame) -> DataFrame:
    """Files, invalid files and their share by model (one spelling) and language, over the records with code."""
    has = F.coalesce(F.regexp_replace("repaired_code", r"\s", ""), F.lit("")) != ""
    files = records.select("repair_id", F.coalesce(slug(F.col("model")), F.lit("unknown")).alias("model"), _language().alias("language"), has.alias("has")).where("has AND repair_id IS NOT NULL AND language IN ('py', 'json')").groupBy("repair_id").agg(F.min("model").alias("model"), F.min("language").alias("language"))
    both = files.join(found.select("repair_id", F.lit(1).alias("bad")), "repair_id", "left")
    return both.groupBy("model", "language").agg(F.count("*").alias("files"), F.count("bad").alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
