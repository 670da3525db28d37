"""Text helpers: stripping, digests and finding the JSON object in a model's answer."""

from __future__ import annotations


from alertloom.functions import variants as V
from alertloom.functions.sql import F, Sql

# Characters Python counts as white space in str.strip (fixed values).
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"
FENCED = r"(?s)```(?:json)?\s*(.*?)\s*```"


def strip(t: Sql) -> Sql:
    return F.btrim(t, F.lit(BLANKS))


def collapse_blanks(t: Sql) -> Sql:
    return strip(F.regexp_replace(t, BLANK_RUN, " "))


def digest(t: Sql) -> Sql:
    """SHA-256 of the text as it is."""
    return F.sha2(t, 256)


def loose_digest(t: Sql) -> Sql:
    """SHA-256 after collapsing white space, so re-indented copies meet."""
    return F.sha2(collapse_blanks(t), 256)


def fenced_block(t: Sql) -> Sql:
    """Content of the first fenced block, NULL without one."""
    return F.when(t.rlike(FENCED), F.regexp_extract(t, FENCED, 1))


def brace_span(t: Sql) -> Sql:
    """From the first "{" to the brace that closes it, NULL when it stays open.

    Works on brace positions, not characters: the text is cut at every brace, so
    the fold has one step per brace however long the text between them is.
    Braces inside strings count, as in the reference.
    """
    from_first = F.when(F.instr(t, "{") > 0, F.substr(t, F.instr(t, "{")))
    # Each piece ends with one brace, except a tail without any.
    pieces = F.regexp_extract_all(from_first, F.lit(r"(?s)[^{}]*[{}]"), F.lit(0))
    start = F.struct(
        F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("length"),
        F.lit(0).cast("long").alias("end"),
    )

    def step(acc: Sql, piece: Sql) -> Sql:
        depth = acc["depth"] + F.when(piece.endswith("{"), 1).otherwise(-1)
        length = acc["length"] + F.length(piece)
        closed = F.when((acc["end"] == 0) & (depth == 0), length).otherwise(acc["end"])
        return F.struct(
            depth.cast("long").alias("depth"),
            length.cast("long").alias("length"),
            closed.cast("long").alias("end"),
        )

    end = F.aggregate(pieces, start, step, lambda acc: acc["end"])
    return F.when(end > 0, F.substr(from_first, F.lit(1), end))


def found_json(t: Sql) -> Sql:
    """``text`` and ``doc`` of the JSON in a model's answer: whole text, else fenced block, else first brace span.

    Each part is cut out and parsed once; the last one is given even where it does not parse, then without ``doc``.
    """
    read = lambda part: V.let(part, lambda p: F.struct(p.alias("text"), V.parse_strict(p).alias("doc")))
    # A struct without doc makes way for the next part.
    fits = lambda part: V.let(read(part), lambda r: F.when(r["doc"].isNotNull(), r))
    return F.coalesce(fits(t), fits(fenced_block(t)), read(brace_span(t)))


def extract_json(t: Sql) -> Sql:
    """VARIANT found in a model's answer: whole text, else fenced block, else first brace span."""
    return found_json(t)["doc"]


def source_json(t: Sql) -> Sql:
    """The part of a model's answer that ``extract_json`` parses, as text."""
    return found_json(t)["text"]


# Tokens of compact JSON text: strings, brackets and separators, other values.
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},:]|[^\s"\[\]{},:]++'
# A key with its colon.
JSON_KEY = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:'
# Finds every text that may hold an empty value (and a few others, where a string looks like one).
MAY_HOLD_EMPTIES = r'[:,\[](null|""|\[\]|\{\})[,}\]]'


def without_empties(json: Sql) -> Sql:
    """Compact JSON text without null, "", [] and {}, at any depth; what becomes empty goes too, but for the outermost value.

    One pass over the tokens; ``stack`` holds the open objects and lists with what was kept of them.
    """
    top, size = "get(s.stack, size(s.stack) - 1)", "size(s.stack)"

    def level(kind: str, body: str, key: str) -> str:
        return f"named_struct('kind', {kind}, 'body', {body}, 'key', {key})"

    def state(stack: str = "s.stack", prev: str = "t", out: str = "s.out") -> str:
        return f"named_struct('stack', {stack}, 'prev', {prev}, 'out', {out})"

    def put(into: str, below: str, value: str) -> str:
        comma = f"CASE WHEN {into}.body = '' THEN '' ELSE ',' END"
        key = f"CASE WHEN {into}.kind = '{{' THEN concat({into}.key, ':') ELSE '' END"
        return f"concat({below}, array({level(f'{into}.kind', f'concat({into}.body, {comma}, {key}, {value})', f'{into}.key')}))"

    below, second = f"slice(s.stack, 1, {size} - 1)", f"get(s.stack, {size} - 2)"
    closed = f"concat({top}.kind, {top}.body, t)"
    step = f"""CASE
        WHEN t IN ('{{', '[') THEN {state(f"concat(s.stack, array({level('t', chr(39) * 2, chr(39) * 2)}))")}
        WHEN t IN ('}}', ']') AND {size} = 1 THEN {state("cast(array() AS array<struct<kind:string,body:string,key:string>>)", out=closed)}
        WHEN t IN ('}}', ']') AND {top}.body = '' THEN {state(below)}
        WHEN t IN ('}}', ']') THEN {state(put(second, f"slice(s.stack, 1, {size} - 2)", closed))}
        WHEN t IN (',', ':') THEN {state()}
        WHEN {top}.kind = '{{' AND s.prev <> ':' THEN {state(f"concat({below}, array({level(f'{top}.kind', f'{top}.body', 't')}))", prev="'key'")}
        WHEN {size} = 0 THEN {state(out="t")}
        WHEN t IN ('null', '""') THEN {state()}
        ELSE {state(put(top, below, "t"))} END"""
    start = "named_struct('stack', cast(array() AS array<struct<kind:string,body:string,key:string>>), 'prev', '', 'out', '')"
    return Sql(f"aggregate(regexp_extract_all({json.text}, r'{JSON_TOKEN}', 0), {start}, (s, t) -> {step}, s -> s.out)")


# A character as Python writes it in a JSON string; ``{odd}`` says which of the others are written as numbers.
_ESCAPED = r"""CASE c WHEN '"' THEN r'\"' WHEN r'\' THEN r'\\' WHEN '\n' THEN r'\n' WHEN '\r' THEN r'\r' WHEN '\t' THEN r'\t' WHEN '\b' THEN r'\b' WHEN chr(12) THEN r'\f'
    ELSE CASE WHEN {odd} THEN regexp_replace(lower(hex(encode(c, 'UTF-16BE'))), '(.{{4}})', r'\\u$1') ELSE c END END"""
# Strings that hold nothing to be read or written in another way, and those without a backslash or a control character.
_AS_IT_IS = r"""r'^"[ !#-\[\]-~]*"$'"""
_PLAIN = r"""r'^"[^"\\\x00-\x1f]*"$'"""


def dumps(json: Sql, indent: int | None = None, ascii_only: bool = False, compact: bool = False) -> Sql:
    """JSON text written anew as Python's ``json.dumps`` would: over lines with ``indent``, else in one, with blanks after signs unless ``compact``.

    The order of keys and the writing of numbers stay as they are.  Other letters than ASCII are escaped with
    ``ascii_only``.  Strings are written first, each for itself; in one line every token then depends on the one before
    alone, over lines a pass over the tokens counts the open brackets.
    """
    escaped = _ESCAPED.format(odd="c < ' ' OR c > '~'" if ascii_only else "c < ' '")

    def text(t: str) -> str:
        read = f"CASE WHEN rlike({t}, {_PLAIN}) THEN substr({t}, 2, length({t}) - 2) ELSE from_json(concat('[', {t}, ']'), 'array<string>')[0] END"
        return f"""CASE WHEN rlike({t}, {_AS_IT_IS if ascii_only else _PLAIN}) THEN {t} ELSE concat('"', array_join(transform(split({read}, ''), c -> {escaped}), ''), '"') END"""

    name = r"regexp_replace(t, r'\s*:$', '')"
    written = f"""CASE WHEN startswith(t, '"') THEN CASE WHEN endswith(t, ':') THEN concat({text(name)}, ':') ELSE {text("t")} END ELSE t END"""
    tokens = f"transform(regexp_extract_all({json.text}, r'{JSON_KEY}|{JSON_TOKEN}', 0), t -> {written})"
    if indent is None:
        if compact:
            return Sql(f"array_join({tokens}, '')")
        # A comma, or the colon of a key, ahead.
        after = "i > 0 AND (get(a, i - 1) = ',' OR endswith(get(a, i - 1), ':'))"
        spaced = lambda a: Sql(f"array_join(transform({a.text}, (t, i) -> CASE WHEN t IN (',', '}}', ']') THEN t WHEN {after.replace('(a,', f'({a.text},')} THEN concat(' ', t) ELSE t END), '')")
        return V.let(Sql(tokens), spaced)

    gap = "''" if compact else "' '"
    broken = lambda depth: f"concat(chr(10), repeat(' ', {indent} * ({depth})))"
    opened = "s.prev IN ('{', '[')"
    lead = f"CASE WHEN endswith(s.prev, ':') THEN {gap} WHEN {opened} OR s.prev = ',' THEN {broken('s.depth')} ELSE '' END"

    def state(depth: str, *pieces: str) -> str:
        return f"named_struct('depth', {depth}, 'prev', t, 'out', concat(s.out, array({', '.join(pieces)})))"

    step = f"""CASE WHEN t = ',' THEN {state("s.depth", "t")}
        WHEN t IN ('{{', '[') THEN {state("s.depth + 1", lead, "t")}
        WHEN t IN ('}}', ']') THEN {state("s.depth - 1", f"CASE WHEN {opened} THEN '' ELSE {broken('s.depth - 1')} END", "t")}
        ELSE {state("s.depth", lead, "t")} END"""
    start = "named_struct('depth', 0, 'prev', '', 'out', CAST(array() AS array<string>))"
    return Sql(f"aggregate({tokens}, {start}, (s, t) -> {step}, s -> array_join(s.out, ''))")
