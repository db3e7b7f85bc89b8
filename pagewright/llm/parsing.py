"""Problem 2: source files that do not parse in the language their extension names.

Every file is tokenised and recognised by generalised LL over a graph-structured stack (``gll``),
with the grammars of its language's dialects together, over one stack; it is flagged if its standard, the only
dialect that counts as valid, rejects it, and what other dialects say is reported beside (``dialects``).
For Python a logical line is recognised once for each sequence of token kinds and remembered, and so is an
indented block over its lines' kinds; the file is then recognised over its outermost lines.  What no grammar holds follows it: escapes in strings
and TOML's rules on keys.

Null contents are no cases; an empty file is valid Python and TOML but not JSON.
"""

from __future__ import annotations

import io
import json
import keyword
import re
import tokenize
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gll import Grammar, squeezed

LANGUAGE = {"py": "python", "pyi": "python", "json": "json", "toml": "toml"}
#: The dialect of each language that is valid, and one beside it, by their start symbols: Python 2's statements, JSON with
#: comments and last commas, TOML 1.1's inline tables over several lines.
STANDARD = {"python": "python-3.13", "json": "json-rfc8259", "toml": "toml-1.0"}
_OTHER = {"python": "python-2-statements", "json": "json-comments", "toml": "toml-1.1-tables"}
#: Line shapes that a worker remembers.
REMEMBERED = 200_000

_PYTHON_LINES = """
name: NAME | 'match' | 'case' | 'type' | '_' | 'print' | 'exec' ;
simple_line_2: simple_2 (';' simple_2)* [';'] ;
simple_2: simple | 'print' ['>>' expression [',' print_items] | print_items] | 'exec' bit ['in' expression [',' expression]] | 'raise' expression ',' expression [',' expression] ;
print_items: expression (',' expression)* [','] ;
except_2_head: 'except' expression ',' name ;
simple_line: simple (';' simple)* [';'] ;
simple: assignment | star_expressions | 'return' [star_expressions] | 'import' dotted_as (',' dotted_as)* | from_import
  | 'raise' [expression ['from' expression]] | 'pass' | 'del' del_targets | yield_expr | 'assert' expression [',' expression]
  | 'break' | 'continue' | 'global' name (',' name)* | 'nonlocal' name (',' name)* | 'type' name [type_params] '=' expression ;
dotted: name ('.' name)* ;
dotted_as: dotted ['as' name] ;
from_import: 'from' ('.' | '...')* dotted 'import' import_names | 'from' ('.' | '...')+ 'import' import_names ;
import_names: '(' import_as (',' import_as)* [','] ')' | import_as (',' import_as)* | '*' ;
import_as: name ['as' name] ;

assignment: name ':' expression ['=' assigned]
  | ('(' single_target ')' | attribute_target) ':' expression ['=' assigned]
  | (star_targets '=')+ assigned
  | single_target augmented assigned ;
augmented: '+=' | '-=' | '*=' | '@=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' | '//=' ;
assigned: yield_expr | star_expressions ;
attribute_target: primary '.' name | primary '[' slices ']' ;
single_target: attribute_target | name | '(' single_target ')' ;
star_targets: star_target (',' star_target)* [','] ;
star_target: '*' target | target ;
target: attribute_target | name | '(' target ')' | '(' [star_target ',' [star_target (',' star_target)* [',']]] ')' | '[' [star_target (',' star_target)* [',']] ']' ;
del_targets: del_target (',' del_target)* [','] ;
del_target: attribute_target | name | '(' del_target ')' | '(' [del_target (',' del_target)* [',']] ')' | '[' [del_target (',' del_target)* [',']] ']' ;

yield_expr: 'yield' 'from' expression | 'yield' [star_expressions] ;
star_expressions: star_expression (',' star_expression)* [','] ;
star_expression: '*' bit | expression ;
star_named: '*' bit | named ;
named: name ':=' expression | expression ;
expressions: expression (',' expression)* [','] ;
expression: disjunction ['if' disjunction 'else' expression] | lambda ;
lambda: 'lambda' [lambda_params] ':' expression ;
disjunction: conjunction ('or' conjunction)* ;
conjunction: inversion ('and' inversion)* ;
inversion: 'not' inversion | comparison ;
comparison: bit (compare bit)* ;
compare: '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
bit: unary (binary unary)* ;
binary: '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
unary: ('+' | '-' | '~')* awaited ;
awaited: ['await'] primary ;
primary: atom | primary '.' name | primary '(' [arguments] ')' | primary '[' slices ']' | primary genexp ;
slices: slice_item (',' slice_item)* [','] ;
slice_item: [expression] ':' [expression] [':' [expression]] | named | '*' bit ;
atom: name | 'True' | 'False' | 'None' | '...' | NUMBER | IMAGINARY | strings
  | '(' [star_named ',' [star_named (',' star_named)* [',']]] ')' | '(' (yield_expr | named) ')' | genexp
  | '[' [star_named (',' star_named)* [',']] ']' | '[' named for_ifs ']'
  | '{' '}' | '{' pair (',' pair)* [','] '}' | '{' expression ':' expression for_ifs '}'
  | '{' star_named (',' star_named)* [','] '}' | '{' named for_ifs '}' ;
pair: '**' bit | expression ':' expression ;
genexp: '(' (name ':=' expression | expression) for_ifs ')' ;
for_ifs: for_if+ ;
for_if: ['async'] 'for' star_targets 'in' disjunction ('if' disjunction)* ;
strings: (STR | fstring)+ | BYTES+ ;
fstring: FS (FM | field)* FE ;
field: '{' (yield_expr | star_expressions) ['='] ['!' CONVERSION] [':' (FM | field)*] '}' ;
arguments: argument_list [','] ;
argument_list: positional (',' positional)* [',' keywords] | keywords ;
positional: '*' expression | name ':=' expression | expression ;
keywords: keyword_or_star (',' keyword_or_star)* [',' keyword_or_stars] | keyword_or_stars ;
keyword_or_star: name '=' expression | '*' expression ;
keyword_or_stars: keyword_or_double (',' keyword_or_double)* ;
keyword_or_double: name '=' expression | '**' expression ;

lambda_params: lp_plain ;
lp_plain: lp (',' lp)* [',' '/'] [',' lp_rest] | lp (',' lp)* ',' '/' (',' lp)* [',' lp_rest] | lp_rest | lp (',' lp)* [',' '/'] ',' | lp (',' lp)* ',' '/' (',' lp)* ',' ;
lp_rest: lp_default (',' lp_default)* [',' '/' (',' lp_default)*] [',' lp_star] | lp_default (',' lp_default)* [',' '/' (',' lp_default)*] ',' | lp_star ;
lp: name ;
lp_default: name '=' expression ;
lp_star: '*' name (',' (lp | lp_default))* [',' lp_kw] [','] | '*' (',' (lp | lp_default))+ [',' lp_kw] [','] | lp_kw [','] ;
lp_kw: '**' name ;
params: p (',' p)* [',' '/'] [',' p_rest] | p (',' p)* ',' '/' (',' p)* [',' p_rest] | p_rest | p (',' p)* [',' '/'] ',' | p (',' p)* ',' '/' (',' p)* ',' ;
p_rest: p_default (',' p_default)* [',' '/' (',' p_default)*] [',' p_star] | p_default (',' p_default)* [',' '/' (',' p_default)*] ',' | p_star ;
p: name [':' expression] ;
p_default: name [':' expression] '=' expression ;
p_star: '*' name [':' (expression | '*' bit)] (',' (p | p_default))* [',' p_kw] [','] | '*' (',' (p | p_default))+ [',' p_kw] [','] | p_kw [','] ;
p_kw: '**' name [':' expression] ;
type_params: '[' type_param (',' type_param)* [','] ']' ;
type_param: name [':' expression] ['=' expression] | '*' name ['=' star_expression] | '**' name ['=' expression] ;

decorator: '@' named ;
if_head: 'if' named ;
elif_head: 'elif' named ;
else_head: 'else' ;
while_head: 'while' named ;
for_head: ['async'] 'for' star_targets 'in' star_expressions ;
try_head: 'try' ;
except_head: 'except' expression ['as' name] ;
except_all_head: 'except' ;
except_star_head: 'except' '*' expression ['as' name] ;
finally_head: 'finally' ;
with_head: ['async'] 'with' with_item (',' with_item)* | ['async'] 'with' '(' with_item (',' with_item)* [','] ')' ;
with_item: expression ['as' star_target] ;
def_head: ['async'] 'def' name [type_params] '(' [params] ')' ['->' expression] ;
class_head: 'class' name [type_params] ['(' [arguments] ')'] ;
match_head: 'match' (star_named ',' [star_named (',' star_named)* [',']] | named) ;
case_head: 'case' (pattern | open_sequence) ['if' named] ;
pattern: or_pattern ['as' NAME_NOT_BLANK] ;
NAME_NOT_BLANK_: NAME ;
open_sequence: maybe_star ',' [maybe_star (',' maybe_star)* [',']] ;
maybe_star: '*' name | pattern ;
or_pattern: closed ('|' closed)* ;
closed: signed | NUMBER_SUM | strings | 'None' | 'True' | 'False' | name | name ('.' name)+
  | '(' pattern ')' | '(' [maybe_star ',' [maybe_star (',' maybe_star)* [',']]] ')' | '[' [maybe_star (',' maybe_star)* [',']] ']'
  | '{' [key_pattern (',' key_pattern)* [',' '**' name] [',']] '}' | '{' '**' name [','] '}'
  | name ('.' name)* '(' [class_args [',']] ')' ;
signed: ['-'] (NUMBER | IMAGINARY) | ['-'] NUMBER ('+' | '-') IMAGINARY ;
key_pattern: (signed | strings | 'None' | 'True' | 'False' | name ('.' name)+) ':' pattern ;
class_args: pattern (',' pattern)* [',' named_pattern (',' named_pattern)*] | named_pattern (',' named_pattern)* ;
named_pattern: name '=' pattern ;
""".replace("NAME_NOT_BLANK_: NAME ;\n", "").replace("NAME_NOT_BLANK", "plain_name").replace("signed | NUMBER_SUM |", "signed |") + "plain_name: NAME | 'match' | 'case' | 'type' | 'print' | 'exec' ;\n"

_HEADS = ("if", "elif", "else", "while", "for", "try", "except", "except_all", "except_star", "finally", "with", "def", "class", "match", "case")
for _h in _HEADS:
    _PYTHON_LINES += f"{_h}_inline: {_h}_head ':' simple_line ;\n{_h}_inline_2: {_h}_head ':' simple_line_2 ;\n"
_PYTHON_LINES += "except_2_inline_2: except_2_head ':' simple_line_2 ;\n"

_PYTHON_FILE = """
file: statement* ;
statement: SIMPLE | if | while | for | try | with | decorated | match ;
suite: INLINE | BLOCK BODY ;
body: statement+ ;
if: 'if' suite ('elif' suite)* ['else' suite] ;
while: 'while' suite ['else' suite] ;
for: 'for' suite ['else' suite] ;
try: 'try' suite excepts ['else' suite] ['finally' suite] | 'try' suite 'finally' suite | 'try' suite ('except_star' suite)+ ['else' suite] ['finally' suite] ;
excepts: (('except' | 'except_all') suite)+ ;
with: 'with' suite ;
decorated: 'decorator'* ('def' suite | 'class' suite) ;
match: 'match' BLOCK CASES ;
cases: ('case' suite)+ ;
"""

# The same for Python 2: its rules and line kinds are named apart.
_PYTHON_FILE += re.sub(r"'(\w+)'|\b(SIMPLE|BODY|CASES|[a-z_]+)\b", lambda m: f"'{m[1]}_2'" if m[1] else f"{m[2]}_2", _PYTHON_FILE).replace("('except_2' |", "('except_2' | 'except_2_2' |")

_JSON = """
whole_2: value_2 ;
value_2: VALUE | '{' [pair_2 (',' pair_2)* [',']] '}' | '[' [value_2 (',' value_2)* [',']] ']' | STR | NUMBER | 'true' | 'false' | 'null' ;
pair_2: STR ':' value_2 ;
whole: value ;
value: VALUE | '{' [pair (',' pair)*] '}' | '[' [value (',' value)*] ']' | STR | NUMBER | 'true' | 'false' | 'null' ;
pair: STR ':' value ;
"""

_TOML = """
file: line (NL line)* ;
line: [key '=' value | '[' key ']' | '[[' key ']]'] ;
file_2: line_2 (NL line_2)* ;
line_2: [key '=' value_2 | '[' key ']' | '[[' key ']]'] ;
value_2: SCALAR | '[' NL* [value_2 NL* (',' NL* value_2 NL*)* [',' NL*]] ']' | '{' NL* [key '=' value_2 NL* (',' NL* key '=' value_2 NL*)* [',' NL*]] '}' ;
key: KEY ('.' KEY)* ;
value: SCALAR | '[' NL* [value NL* (',' NL* value NL*)* [',' NL*]] ']' | '{' [key '=' value (',' key '=' value)*] '}' ;
"""


@cache
def _grammar(name: str) -> Grammar:
    return Grammar({"lines": _PYTHON_LINES, "file": _PYTHON_FILE, "json": _JSON, "toml": _TOML}[name])


# ---- Python

_SOFT = {"match", "case", "type", "_"}
_STATEMENTS_2 = {"print", "exec"}
_BAD_ESCAPE = re.compile(r"\\(?:\\|x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|N(?!\{[^}]+\})|N\{([^}]+)\})|\\.", re.S)


def _bad_escape(body: str, is_bytes: bool) -> bool:
    for m in _BAD_ESCAPE.finditer(body):
        what = m[0][1]
        if what == "x" and len(m[0]) == 2 and not re.match(r"[0-9a-fA-F]{2}", body[m.end() :]):
            return True
        if not is_bytes and what in "uUN":
            if m[1] is None:
                rest = body[m.start() + 2 :]
                if what == "u" and not re.match("[0-9a-fA-F]{4}", rest) or what == "U" and not re.match("(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}", rest) or what == "N":
                    return True
            else:
                try:
                    unicodedata.lookup(m[1])
                except KeyError:
                    return True
    return False


def _string_kind(text: str) -> str | None:
    """STR or BYTES, or None if the literal's contents are invalid."""
    prefix = re.match(r"[A-Za-z]*", text)[0].lower()
    body = text[len(prefix) :]
    if "b" in prefix and not text.isascii():
        return None
    if "r" not in prefix and "\\" in body and _bad_escape(body.strip("\"'"), "b" in prefix):
        return None
    return "BYTES" if "b" in prefix else "STR"


def python_lines(source: str) -> Iterator[list[str] | str]:
    """Logical lines as token kinds, and INDENT and DEDENT; raises on what the tokeniser rejects."""
    line: list[str] = []
    raw_parts: list[bool] = []  # of the f-strings that are open, whether they are raw
    previous, end = "", (0, 0)
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        kind = t.type
        if kind in (tokenize.COMMENT, tokenize.NL):
            continue
        if kind == tokenize.NEWLINE:
            if line:
                yield line
            line = []
        elif kind == tokenize.INDENT:
            yield "INDENT"
        elif kind == tokenize.DEDENT:
            yield "DEDENT"
        elif kind == tokenize.NAME:
            if previous == "!" and raw_parts:
                line.append("CONVERSION" if t.string in ("s", "r", "a") and t.start == end else "ERROR")
            elif keyword.iskeyword(t.string) or t.string in _SOFT or t.string in _STATEMENTS_2:
                line.append(t.string)
            else:
                if not t.string.isidentifier():
                    raise SyntaxError("invalid character")
                line.append("NAME")
        elif kind == tokenize.NUMBER:
            if re.fullmatch(r"0[0_]*[1-9][0-9_]*", t.string):
                line.append("ERROR")  # leading zeros
            else:
                line.append("IMAGINARY" if t.string[-1] in "jJ" else "NUMBER")
        elif kind == tokenize.STRING:
            line.append(_string_kind(t.string) or "ERROR")
        elif kind == tokenize.FSTRING_START:
            raw_parts.append("r" in t.string.lower())
            line.append("FS")
        elif kind == tokenize.FSTRING_MIDDLE:
            line.append("ERROR" if not raw_parts[-1] and "\\" in t.string and _bad_escape(t.string, False) else "FM")
        elif kind == tokenize.FSTRING_END:
            raw_parts.pop()
            line.append("FE")
        elif kind == tokenize.ENDMARKER:
            if line:
                yield line
        else:
            line.append(t.string if kind == tokenize.OP else "ERROR")
        previous, end = t.string, t.end


_STARTS: dict[str, tuple[str, ...]] = {
    "if": ("if",), "elif": ("elif",), "else": ("else",), "while": ("while",), "for": ("for",), "try": ("try",), "except": ("except", "except_all", "except_star"),
    "finally": ("finally",), "with": ("with",), "def": ("def",), "class": ("class",), "match": ("match",), "case": ("case",), "async": ("for", "with", "def"),
}
_HEADS_2 = {"except": ("except_2",)}
_shapes: dict[tuple[str, ...], tuple[frozenset[str], frozenset[str]]] = {}


def line_kinds(line: tuple[str, ...]) -> tuple[frozenset[str], frozenset[str]]:
    """(what the line can be in either dialect, whether a block or an inline suite follows it)."""
    if (known := _shapes.get(line)) is not None:
        return known
    grammar = _grammar("lines")
    heads = _STARTS.get(line[0], ())
    kinds: set[str] = set()
    suites: set[str] = set()
    if line[0] == "@":
        kinds |= {"decorator", "decorator_2"} if grammar.accepts(line, ["decorator"]) else set()
    else:
        if not heads or line[0] in _SOFT:
            got = grammar.accepts(line, ["simple_line", "simple_line_2"])
            kinds |= {{"simple_line": "SIMPLE", "simple_line_2": "SIMPLE_2"}[x] for x in got}
        if heads and line[-1] == ":":
            got = {x.removesuffix("_head") for x in grammar.accepts(line[:-1], [f"{h}_head" for h in (*heads, *_HEADS_2.get(line[0], ()))])}
            kinds |= {k for x in got for k in ((f"{x}_2",) if x == "except_2" else (x, f"{x}_2"))}
            suites |= {"BLOCK"} if got else set()
        if heads and ":" in line[:-1]:
            got = grammar.accepts(line, [f"{h}_inline{d}" for h in heads for d in ("", "_2")] + [f"{h}_inline_2" for h in _HEADS_2.get(line[0], ())])
            kinds |= {x.replace("_inline", "") for x in got}
            suites |= {"INLINE"} if got else set()
    if len(_shapes) < REMEMBERED:
        _shapes[line] = frozenset(kinds), frozenset(suites)
    return frozenset(kinds), frozenset(suites)


def python_dialects(source: str) -> set[str]:
    """The dialects that accept the source, as start symbols: ``file``, ``file_2``."""
    if "\0" in source:
        return set()
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    open_blocks: list[list[frozenset[str]]] = [[]]
    try:
        for line in python_lines(source):
            if line == "INDENT":
                open_blocks.append([])
                continue
            if line == "DEDENT":
                if not (body := _body_kinds(tuple(open_blocks.pop()))):
                    return set()
                open_blocks[-1].append(body)
                continue
            kinds, suites = line_kinds(tuple(squeezed(line)))
            if not kinds:
                return set()
            if suites and "SIMPLE" in kinds:  # begins with a soft keyword and ends without a colon
                kinds, suites = kinds & {"SIMPLE", "SIMPLE_2"}, frozenset()
            open_blocks[-1].append(kinds)
            if suites:
                open_blocks[-1].append(suites)
    except (tokenize.TokenError, SyntaxError, ValueError):
        return set()
    return set(_file_kinds(tuple(_without_repeats(open_blocks[0])))) if len(open_blocks) == 1 else set()


_WHOLE = [frozenset({x, f"{x}_2"}) for x in ("SIMPLE", "def", "class")]
_files: dict[tuple[frozenset[str], ...], frozenset[str]] = {}


def _without_repeats(lines: list[frozenset[str]]) -> list[frozenset[str]]:
    """Lines without a simple statement, function or class right behind one of the same kinds.

    Each is a statement whatever stands around it, so a sequence of statements is one with or without the second.
    """
    out: list[frozenset[str]] = []
    i = 0
    while i < len(lines):
        size = 1 if lines[i] == _WHOLE[0] else 3 if lines[i] in _WHOLE else 0
        item = lines[i : i + size]
        if size and len(item) == size and out[-size:] == item and (size == 1 or item[1:] == [frozenset({"BLOCK"}), frozenset({"BODY", "BODY_2"})]):
            i += size
        else:
            out.append(lines[i])
            i += 1
    return out


def _file_kinds(lines: tuple[frozenset[str], ...]) -> frozenset[str]:
    if (known := _files.get(lines)) is None:
        known = frozenset(_grammar("file").accepts(lines, ["file", "file_2"]))
        if len(_files) < REMEMBERED:
            _files[lines] = known
    return known


_bodies: dict[tuple[frozenset[str], ...], frozenset[str]] = {}


def _body_kinds(lines: tuple[frozenset[str], ...]) -> frozenset[str]:
    """What an indented block can be, whose inner blocks are single kinds; recognised once for each sequence."""
    if (known := _bodies.get(lines)) is None:
        known = frozenset(x.replace("body", "BODY").replace("cases", "CASES") for x in _grammar("file").accepts(lines, ["body", "body_2", "cases", "cases_2"]))
        if len(_bodies) < REMEMBERED:
            _bodies[lines] = known
    return known


def python_valid(source: str) -> bool:
    return "file" in python_dialects(source)


# ---- JSON

_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9A-Za-z_.+-])|(true|false|null)(?![0-9A-Za-z_])|([{}\[\],:])|(//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/))')


def json_dialects(text: str) -> set[str]:
    """The dialects that accept the text, as start symbols: ``whole``, ``whole_2``."""
    tokens, at, comments = [], 0, False
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _JSON_TOKEN.match(text, at)
        if not m:
            return set()
        if m[5] is None:
            tokens.append("STR" if m[1] is not None else "NUMBER" if m[2] is not None else m[3] or m[4])
        comments |= m[5] is not None
        at = m.end()
    return _json_recognised(tokens) - ({"whole"} if comments else set())


def json_valid(text: str) -> bool:
    return "whole" in json_dialects(text)


_containers: dict[tuple[str, ...], frozenset[str]] = {}


def _json_recognised(tokens: list[str]) -> set[str]:
    """Containers are recognised as they close, with what they hold as single values; equal shapes once."""
    stack: list[list[str]] = [[]]
    dialects = {"whole", "whole_2"}
    for t in tokens:
        if t in "{[" and len(t) == 1:
            stack.append([t])
        elif t in "}]" and len(t) == 1:
            stack[-1].append(t)
            if len(stack) == 1 or not (dialects := dialects & _json_accepts(stack.pop())):
                return set()
            stack[-1].append("VALUE")
        else:
            stack[-1].append(t)
    return dialects & _json_accepts(stack[0]) if len(stack) == 1 else set()


def _json_accepts(tokens: list[str]) -> frozenset[str]:
    shape = tuple(squeezed(tokens))
    if (known := _containers.get(shape)) is None:
        known = frozenset(_grammar("json").accepts(shape, ["whole", "whole_2"]))
        if len(_containers) < REMEMBERED:
            _containers[shape] = known
    return known


# ---- TOML

_CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f"
_BASIC = rf'"(?:[^"\\\n\r{_CONTROL}]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}))*"'
_LITERAL = rf"'[^'\n\r{_CONTROL}]*'"
_LONG_BASIC = rf'"""(?:\r?\n)?(?:[^"\\\r{_CONTROL}]|\r\n|\\(?:[btnfr"\\]|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[ \t]*\r?\n\s*)|"{{1,2}}(?!"))*"{{3,5}}'
_LONG_LITERAL = rf"'''(?:\r?\n)?(?:[^'\r{_CONTROL}]|\r\n|'{{1,2}}(?!'))*'{{3,5}}"
_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?"
_DATE = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_SCALAR = re.compile(
    rf"(?:{_LONG_BASIC}|{_LONG_LITERAL}|{_BASIC}|{_LITERAL}|(?:{_DATE}(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?)?|{_TIME}|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?[0-9])*)(?:(?:\.[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?)|true|false)(?=[\s,\]}#]|$))"
)
_KEY = re.compile(rf"[A-Za-z0-9_-]+|{_BASIC}|{_LITERAL}")
_COMMENT = re.compile(rf"#[^\n\r{_CONTROL}]*")
_SURROGATE = re.compile(r"\\(?:u[dD][89a-fA-F]|U0000[dD][89a-fA-F]|U(?!000[0-9a-fA-F]|0010)[0-9a-fA-F]{8})")


def toml_tokens(text: str) -> list[tuple[str, str]] | None:
    """(kind, text) in key and value contexts; None if a character fits neither."""
    out: list[tuple[str, str]] = []
    at, n, opened = 0, len(text), []
    key = True
    while at < n:
        c = text[at]
        if c in " \t":
            at += 1
        elif c == "#":
            m = _COMMENT.match(text, at)
            at = m.end()
        elif c == "\n" or text.startswith("\r\n", at):
            out.append(("NL", ""))
            at += 1 if c == "\n" else 2
            key = not opened or opened[-1] == "{"
        elif key:
            if text.startswith(("[[", "]]"), at) and not opened:
                out.append((text[at : at + 2],) * 2)
                at += 2
            elif c in "[].":
                out.append((c, c))
                at += 1
            elif c == "=":
                out.append(("=", "="))
                at += 1
                key = False
            elif c == "," and opened:
                out.append((",", ","))
                at += 1
            elif c == "}" and opened and opened[-1] == "{":
                opened.pop()
                out.append(("}", "}"))
                at += 1
                key = False
            elif m := _KEY.match(text, at):
                if _SURROGATE.search(m[0]) and m[0][0] == '"':
                    return None
                out.append(("KEY", m[0]))
                at = m.end()
            else:
                return None
        elif c in "[{":
            opened.append(c)
            out.append((c, c))
            at += 1
            key = c == "{"
        elif c in "]}":
            if not opened or opened.pop() != {"]": "[", "}": "{"}[c]:
                return None
            out.append((c, c))
            at += 1
        elif c == ",":
            out.append((",", ","))
            at += 1
            key = bool(opened) and opened[-1] == "{"
        elif m := _SCALAR.match(text, at):
            if m[0][0] == '"' and _SURROGATE.search(m[0]) or re.match(r"\d{4}-\d", m[0]) and not _real_date(m[0]):
                return None
            out.append(("SCALAR", m[0]))
            at = m.end()
        else:
            return None
    return out


def _real_date(text: str) -> bool:
    y, m, d = map(int, text[:10].split("-"))
    return y > 0 and d <= (31, 29 if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def _key_name(text: str) -> str:
    return json.loads(re.sub(r"\\U000([0-9a-fA-F]{5})", lambda m: json.dumps(chr(int(m[1], 16)))[1:-1], text)) if text[0] == '"' else text[1:-1] if text[0] == "'" else text


def toml_keys_agree(tokens: list[tuple[str, str]]) -> bool:
    """TOML's rules on keys and tables, over tokens that the grammar has accepted."""
    root: dict = {}
    state: dict[int, str] = {}  # id of a table -> how it came to be: header, dotted, implicit, closed
    table, i = root, 0

    def path() -> list[str]:
        nonlocal i
        names = []
        while tokens[i][0] in ("KEY", "."):
            if tokens[i][0] == "KEY":
                names.append(_key_name(tokens[i][1]))
            i += 1
        return names

    def value():
        nonlocal i
        kind = tokens[i][0]
        i += 1
        if kind == "SCALAR":
            return True, True
        if kind == "[":
            ok = True
            while tokens[i][0] != "]":
                if tokens[i][0] in ("NL", ","):
                    i += 1
                else:
                    ok &= value()[0]
            i += 1
            return ok, []
        own: dict = {}
        ok = True
        while tokens[i][0] != "}":
            if tokens[i][0] in (",", "NL"):
                i += 1
                continue
            names = path()
            i += 1
            good, v = value()
            ok &= good and put(own, names, v)
        i += 1
        close(own)
        return ok, own

    def close(t: dict) -> None:
        state[id(t)] = "closed"
        for v in t.values():
            if isinstance(v, dict):
                close(v)

    def put(base: dict, names: list[str], v) -> bool:
        for name in names[:-1]:
            nxt = base.setdefault(name, {})
            if not isinstance(nxt, dict) or state.get(id(nxt)) in ("closed", "header", "implicit"):
                return False
            state.setdefault(id(nxt), "dotted")
            base = nxt
        if names[-1] in base:
            return False
        base[names[-1]] = v
        return True

    while i < len(tokens):
        kind = tokens[i][0]
        if kind == "NL":
            i += 1
        elif kind in ("[", "[["):
            i += 1
            names = path()
            i += 1
            base = root
            for name in names[:-1]:
                nxt = base.setdefault(name, {})
                if isinstance(nxt, Tables):
                    nxt = nxt[-1]
                if not isinstance(nxt, dict) or state.get(id(nxt)) == "closed":
                    return False
                state.setdefault(id(nxt), "implicit")
                base = nxt
            last = names[-1]
            if kind == "[[":
                if last not in base:
                    base[last] = Tables()
                if not isinstance(base[last], Tables):
                    return False
                base[last].append({})
                table = base[last][-1]
            else:
                table = base.setdefault(last, {})
                if not isinstance(table, dict) or state.get(id(table)) in ("header", "dotted", "closed"):
                    return False
            state[id(table)] = "header"
        else:
            names = path()
            i += 1
            ok, v = value()
            if not ok or not put(table, names, v):
                return False
    return True


class Tables(list):
    """An array of tables, made by double brackets."""


def toml_dialects(text: str) -> set[str]:
    """The dialects that accept the text, as start symbols: ``file``, ``file_2``."""
    if re.search(r"\r(?!\n)", text):
        return set()
    tokens = toml_tokens(text)
    got = _grammar("toml").accepts(squeezed([k for k, _ in tokens]), ["file", "file_2"]) if tokens is not None else set()
    try:
        return got if got and toml_keys_agree(tokens) else set()
    except RecursionError:  # values nested hundreds deep hold no more keys than others
        return got


def toml_valid(text: str) -> bool:
    return "file" in toml_dialects(text)


# ---- the operator

_DIALECTS = {"python": python_dialects, "json": json_dialects, "toml": toml_dialects}


def dialects(language: str, text: str) -> list[str]:
    """The dialects of the language that accept the text, the standard first."""
    return [(_OTHER if x.endswith("_2") else STANDARD)[language] for x in sorted(_DIALECTS[language](text))]


def parsed(sources: DataFrame) -> DataFrame:
    """(file_id, repo, language, dialects, valid) of every file in a supported language, its latest submission.

    Submissions are parsed where they lie; verdicts, not contents, are exchanged to find each file's latest.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    language = F.when(extension.isin("py", "pyi"), "python").when(extension.isin("json", "toml"), extension)
    rows = sources.select("file_id", "received_at", "submitted_at", F.md5("content").alias("digest"), "repo", language.alias("language"), "content")
    kept = [c for c in rows.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if x is None or t is None else dialects(x, t) for x, t in zip(b.column("language").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(got, pa.list_(pa.string()))], names=[*kept, "dialects"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", dialects array<string>"
    each = rows.mapInArrow(run, schema)
    latest = each.groupBy("file_id").agg(F.max_by(F.struct("repo", "language", "dialects"), F.struct("received_at", "submitted_at", "digest")).alias("f")).select("file_id", "f.*")
    valid = F.lit(False)
    for x, standard in STANDARD.items():
        valid = valid | (F.col("language") == x) & F.array_contains("dialects", standard)
    return latest.where("language IS NOT NULL AND dialects IS NOT NULL").withColumn("valid", valid)


def by_dialect(sources: DataFrame) -> DataFrame:
    """(file_id, language, dialects): the dialects that accept each file, joined by commas; empty if every one rejects it."""
    return parsed(sources).select("file_id", "language", F.array_join("dialects", ",").alias("dialects"))


def found(sources: DataFrame) -> DataFrame:
    return parsed(sources).where("NOT valid").select("file_id")


def rates(sources: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, invalid_rate)."""
    bad = (~F.col("valid")).cast("int")
    return parsed(sources).groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.sum(bad).alias("n_invalid"), F.avg(bad).alias("invalid_rate"))


def against_diagnostics(sources: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(file_id, valid, reported): present verdicts beside the older run's syntax reports."""
    path = F.regexp_replace("path", r"\\", "/")
    where = sources.groupBy("file_id").agg(F.max_by(F.struct("task_id", path.alias("source_file")), F.struct("received_at", "submitted_at", "path")).alias("w")).select("file_id", "w.task_id", "w.source_file")
    reports = diagnostics.where(F.col("code").startswith("PARSE")).select("task_id", "source_file").distinct().withColumn("reported", F.lit(True))
    return parsed(sources).join(where, "file_id").join(reports, ["task_id", "source_file"], "left").select("file_id", "valid", F.coalesce("reported", F.lit(False)).alias("reported"))
