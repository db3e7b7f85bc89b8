"""Problem 4: literal credentials in source and configuration files, found and redacted.

A file is scanned for literals that stand where a credential stands: assigned to a telling name,
as argument, default, header, user part of a URL, comment, or in place of a variable's name.
Every literal of an encoded look, wrapped over lines or not, is then decoded, layer after layer (base64, hex,
percent, escapes) until nothing is left to decode; decoded text is scanned again, decoded bytes are parsed by the
grammar of key containers (DER: PKCS#1, PKCS#8, SEC 1, SPKI, X.509; OpenSSH).  What a hidden layer holds redacts
the whole enclosing literal with all its lines; quotes and line ends stay, and so does the code around it.

Null and empty contents have no findings.  Placeholders, references, digests, public keys and
certificates are none.  Rows of one file_id count once.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shortest encoded literal that can hold a credential: seven characters, as ``pw=abcd``, in base64.
LEAST_ENCODED = 10
MARK = "REDACTED"

# Last words of a name that holds a credential; two-word endings for keys.
SECRET_WORDS = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "secret", "token", "auth", "credential", "credentials", "apikey", "passw", "pw", "bearer"}
KEY_WORDS = {"api", "secret", "private", "access", "encryption", "signing", "deploy", "ssh", "master", "auth", "account", "client", "license", "service", "app", "admin", "webhook", "shared", "storage", "session"}

# What stands in for a value.
PLACEHOLDER = re.compile(
    r"""(?ix)^(?: | your[-_ ]?.* | .*[-_ ]here | change[-_ ]?me.* | replace[-_ ]?(?:me|this|with).* | to[-_ ]?do | tbd | fix[-_ ]?me | null | nil | none | undefined | true | false
    | dummy.* | example.* | sample | placeholder.* | password | passwd | secret | token | redacted.* | hidden | masked | empty | unset | default | not[-_ ]?set | insert.* | enter.*
    | n/?a | test(?:ing)? | foo | bar | foobar | str | string | bytes | int | bool | any | object | \W+ | x+ | \*+ | \.+ | -+ | _+ | \#+ | \?+ | (?:x{2,}|\*{2,}).* | .*\*{4,}
    | <.*> | \[.*\] | \$.* | \{\{?.*\}\}? | %\(?\w+\)?s? | %\w+% | @\w+@ | env\W.* | os\..* | vault:.* | secretsmanager:.* | ssm:.* | \w*\(.*\) | (?:sha\d+|md5)[-:].* )$"""
)
_TELLING = re.compile("pass|pwd|pw|secret|token|auth|credential|key|bearer")  # a part of every telling name, in lower case
_NAME = re.compile(r"""(?P<q>["'`]?)(?P<name>[A-Za-z][A-Za-z0-9_.\-]{1,60})(?P=q)\s*\]?\s*(?P<sep>=>|:=|=(?!=)|:(?![:/]))\s*""")
_ANNOTATION = re.compile(r"""[A-Za-z_][\w.]*(?:\[[\w., |"']*\])?(?:\s*\|\s*[A-Za-z_][\w.]*(?:\[[\w., |"']*\])?)*\s*=(?!=)\s*(?=[rbuRBU]?["'(])""")
_LITERAL = re.compile(r"""[rRbBuUfF]{0,2}(?P<q>\"{3}|'{3}|["'`])""")
_GETENV = re.compile(r"""(?:environ(?:\.get|\.setdefault|\.pop)?|getenv|env|config)\s*[\[(]\s*(["'])(?P<name>[^"'\n]+)\1\s*(?:,\s*(?:default\s*=\s*)?[rbuRBU]?(?P<q>["'])(?P<default>[^"'\n]*)(?P=q))?""")
_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@"'`<>]*:(?P<v>[^\s/@"'`<>]+)@""")
_USER_OPTION = re.compile(r"""(?:\s-u|--user)[\s=]+["']?[^\s:"']+:(?P<v>[^\s"']+)""")
_SCHEME = re.compile(r"""(?i)\b(?P<kind>bearer|basic|token)\s+(?P<v>[A-Za-z0-9._~+/=:!$&*#%^\-]{8,})""")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_JWT = re.compile(r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}")
# Published shapes of providers' keys.
_SHAPES = re.compile(
    r"\b(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|xox[baprs]-[A-Za-z0-9-]{10,}|xapp-\d-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}|glpat-[\w\-]{20,}|npm_[A-Za-z0-9]{36}|pypi-[\w\-]{40,}|hf_[A-Za-z0-9]{30,}"
    r"|SG\.[\w\-]{16,}\.[\w\-]{16,}|ya29\.[\w\-]{20,}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|dop_v1_[0-9a-f]{64}|key-[0-9a-f]{32}|sq0csp-[\w\-]{43}|NRAK-[A-Z0-9]{27}|[a-z]{2,6}_live_[A-Za-z0-9]{16,})"
)
_COMMENT = re.compile(r"""(?i)(?:^\s*|[^:\w"'])(?:\#|//|;|--|<!--|\*)\s*(?P<name>(?:[A-Za-z][\w\-]*\s+){0,5}?[A-Za-z][\w\-]*)\s*[:=]\s*["'`]?(?P<v>[^"'`\n]+?)["'`]?\s*(?:-->)?\s*$""")
_PROSE = re.compile(r"(?i)^(?:see|ask|in|is|from|the|a|an|kept|stored|set|read|use|now|moved|rotate|via|at|by|on|for|of|to|and|or|not)\b")
_WORD_ENDS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[\s_.\-]+")
_CODE_LINE = re.compile(r"(?m)^\s*(?:import \w|from \S+ import|def \w+\(|class \w+|async def |@\w+|if .*:\s*$|for .* in |return\b|with )")
_EXPRESSION = re.compile(r"^(?:[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*\s*(?:[(\[].*)?|[\[{(].*|(?:await|not|lambda|f|r|b)\b.*|\d+(?:\.\d+)?)[,;)]*$")


def secret_name(name: str) -> bool:
    """Whether a name's last words say that its value is a credential."""
    words = [w for w in (x.rstrip("0123456789").lower() for x in _WORD_ENDS.split(name)) if w]
    if not words or "public" in words:
        return False
    if words[-1] in SECRET_WORDS:
        return True
    if words[-1] in ("authorization",):
        return True
    return words[-1] == "key" and len(words) > 1 and words[-2] in KEY_WORDS


def literal(value: str) -> bool:
    """Whether a value is a literal credential, not something that stands for one."""
    value = value.strip()
    return len(value) >= 4 and not PLACEHOLDER.match(value) and any(c.isalnum() for c in value) and not re.search(r"\$\{|\{\w*\}|\{\{|%s|<[\w -]+>", value)


def secret_look(value: str) -> bool:
    """Whether a string that stands for a variable's name can be none."""
    if re.fullmatch(r"[A-Z][A-Z0-9_]*|[a-z][a-z0-9_]*|[A-Za-z]+(?:[A-Z][a-z]+)*", value) and not (len(value) >= 32 and re.fullmatch(r"[0-9a-f]+", value)):
        return False
    if len(value) < 12 or PLACEHOLDER.match(value):
        return False
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    if any(len(p) >= 12 and sum(c.isdigit() for c in p) >= 2 and p != p.lower() and p != p.upper() for p in value.split("_")):
        return True  # a part that no name has
    return digits >= 2 and letters >= 2 and not re.fullmatch(r"[\w]*(?:_[\w]+)+", value) or bool(_JWT.search(value))


# ---- the binary grammar of key containers


def _der(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the value at ``at``."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def key_container(b: bytes) -> str | None:
    """``private``, ``public`` or ``certificate`` if the bytes are such a container."""
    if b.startswith(b"openssh-key-v1\0"):
        return "private"
    top = _der(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] - top[1] < 16:
        return None
    children, at = [], top[1]
    while at < top[2] and len(children) < 12:
        child = _der(b, at, top[2])
        if child is None:
            return None
        children.append(child)
        at = child[2]
    tags = [c[0] for c in children]
    first = b[children[0][1] : children[0][2]]
    if tags[:3] == [0x02, 0x30, 0x04] and first in (b"\0", b"\1"):
        return "private"  # PKCS#8
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and first in (b"\0", b"\1"):
        return "private"  # PKCS#1
    if tags[:2] == [0x02, 0x04] and first == b"\1":
        return "private"  # SEC 1
    if tags == [0x30, 0x04]:
        return "private"  # encrypted PKCS#8
    if tags == [0x30, 0x03]:
        return "public"
    if tags == [0x30, 0x30, 0x03]:
        return "certificate"
    return None


_PERCENTS = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")  # a percent sign that was escaped over and over
_ENCODED = r"[A-Za-z0-9+/_\-=%\\]"
_RUN = re.compile(rf"{_ENCODED}{{{LEAST_ENCODED},}}")


def layers(value: str) -> Iterator[bytes]:
    """What the value is when one layer is taken off, in each way that fits."""
    if "%" in value and re.search(r"%[0-9A-Fa-f]{2}", value) and (u := unquote(_PERCENTS.sub("%", value))) != value:
        yield u.encode("utf-8", "replace")
    if "\\" in value and re.search(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-7]{3}|n)", value):
        try:
            yield value.encode("latin-1", "backslashreplace").decode("unicode_escape").encode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            pass
    packed = re.sub(r"\s+", "", value)
    if len(packed) >= LEAST_ENCODED and len(packed) % 2 == 0 and re.fullmatch(r"(?:0x)?[0-9A-Fa-f]+", packed):
        yield bytes.fromhex(packed.removeprefix("0x"))
    if len(packed) >= LEAST_ENCODED and re.fullmatch(r"[A-Za-z0-9+/_\-]+={0,2}", packed):
        try:
            yield base64.b64decode(packed.replace("-", "+").replace("_", "/") + "=" * (-len(packed.rstrip("=")) % 4) if not packed.endswith("=") else packed.replace("-", "+").replace("_", "/"))
        except (binascii.Error, ValueError):
            pass


def hidden(value: str) -> bool:
    """Whether a credential lies under the value's layers, however many; every layer is shorter than the one around it."""
    work, seen = [value], {value}
    while work:
        for inner in layers(work.pop()):
            if key_container(inner) == "private":
                return True
            try:
                text = inner.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if not all(c.isprintable() or c in "\r\n\t" for c in text):
                continue
            if scan(text, False):
                return True
            further = [text, *(text[a:b] if p is None else p for a, b, p in encoded(text))]
            work += [x for x in further if len(x) >= LEAST_ENCODED and x not in seen]
            seen.update(further)
    return False


_WRAP_HEAD = re.compile(rf"({_ENCODED}{{8,}})[\"']?[ \t]*[\\+]?[ \t]*\r?$")
_WRAP_LINE = re.compile(rf"[ \t]*(?:\+[ \t]*)?(?:[rbuRBU]{{0,2}}[\"'])?({_ENCODED}+)")


def encoded(text: str) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, joined) of the literals that look encoded; ``joined`` without line breaks where they are wrapped."""
    for m in _RUN.finditer(text):
        yield m.start(), m.end(), None
    at = 0
    block: list[tuple[int, int]] = []  # runs that end one line and begin the next
    for line in text.split("\n"):
        whole = _WRAP_LINE.match(line)
        head = _WRAP_HEAD.search(line)
        if block and whole:
            block.append((at + whole.start(1), at + whole.end(1)))
        if block and not (whole and head and head.start(1) <= whole.start(1)):  # the line does not go on to its end
            yield from _wrapped(text, block)
            block = []
        if not block and head:
            block = [(at + head.start(1), at + head.end(1))]
        at += len(line) + 1
    yield from _wrapped(text, block)


def _wrapped(text: str, block: list[tuple[int, int]]) -> Iterator[tuple[int, int, str | None]]:
    for runs in (block, block[1:]):  # the first may be a word before the literal
        if len(runs) > 1:
            yield runs[0][0], runs[-1][1], "".join(re.sub(r"\\n$", "", text[a:b]) for a, b in runs)


# ---- the scan

Span = tuple[int, int]


def _value(text: str, at: int, end: int, config: bool, dashed: bool) -> tuple[int, int, str] | None:
    """(start, end, value) of the literal that begins at ``at``; ``end`` is the line's end."""
    if m := _ANNOTATION.match(text, at, end):
        at = m.end()
    if m := _LITERAL.match(text, at, end):
        quote, start = m["q"], m.end()
        if len(quote) == 3:
            stop = text.find(quote, start)
            stop = len(text) if stop < 0 else stop
            body = text[start:stop]
            if body.lstrip().startswith("-----BEGIN"):
                return None
            if not text[start:end].strip() and re.fullmatch(rf"\s*{_ENCODED}{{16,}}(?:\s+{_ENCODED}+)*\s*", body):  # the value begins on the next line
                start += len(body) - len(body.lstrip())
                return start, start + len(body.strip()), body.split()[0]
            return start, start + len(body.rstrip()), text[start : min(stop, end)]
        stop = start
        while stop < end and text[stop] != quote:
            stop += 2 if text[stop] == "\\" else 1
        return start, _continued(text, min(stop, end), quote), text[start : min(stop, end)]
    if at < end and text[at] == "(" and not text[at + 1 : end].strip():
        m = re.compile(r"\s*(?:\#[^\n]*\n\s*)*[rbuRBU]?([\"'])((?:[^\"'\n\\]|\\.)*)").match(text, at + 1)
        return (m.start(2), _continued(text, m.end(2), m[1]), m[2]) if m else None
    raw = re.split(r"\s+[#;]\s|[&\s]?[\"'`]|&", text[at:end], maxsplit=1)[0].rstrip().rstrip(",;")
    if not raw or not config or _EXPRESSION.match(raw) and not dashed and not any(c.isdigit() for c in raw) and "." in raw or raw[0] in "[{(|>&*!":
        return None
    return at, at + len(raw), raw


_NEXT_PIECE = re.compile(r"""[ \t]*(?:\\?\r?\n[ \t]*)?(?:\+[ \t]*(?:\\?\r?\n[ \t]*)?)?[rbuRBU]?(["'])((?:[^"'\n\\]|\\.)+)""")


def _continued(text: str, end: int, quote: str) -> int:
    """The end of the last literal that is put together with the one that ends at ``end``."""
    while text.startswith(quote, end) and (m := _NEXT_PIECE.match(text, end + 1)) and m[1] == quote and text.startswith(quote, m.end()):
        after = text[m.end() + 1 : m.end() + 40].lstrip(" \t")
        if after[:1] in (":", "]") or not text[end + 1 : m.start(1)].strip(" \t") and after[:1] == "=":
            break  # a key of its own
        end = m.end()
    return end


def scan(text: str, deep: bool = True) -> list[Span]:
    """Places of the literal credentials in a text, in order and without overlaps; with ``deep``, of encoded ones too."""
    found: list[Span] = []
    code = bool(_CODE_LINE.search(text))
    for m in _PRIVATE.finditer(text):
        stop = _PRIVATE_END.search(text, m.end())
        nxt = _PRIVATE.search(text, m.end())
        if stop and (not nxt or stop.start() < nxt.start()):
            end = stop.end()
        else:  # truncated: as far as the lines look like a key's
            body = re.compile(r"(?:[ \t]*[A-Za-z0-9+/=]*[ \t]*(?:\r?\n|\\n))*[A-Za-z0-9+/=]*").match(text, m.end())
            end = body.end() if body else m.end()
        found.append((m.start(), end))
    for pattern in (_JWT, _SHAPES):
        found += [m.span() for m in pattern.finditer(text)]
    at = 0
    for line in text.split("\n"):
        start, end = at, at + len(line.rstrip("\r"))
        at += len(line) + 1
        if end - start < 5:
            continue
        # What a pattern needs is looked for before the pattern.
        low = line.lower()
        telling = _TELLING.search(low) is not None
        comment = re.search(r"(?:^|\s)(?:#|//|;)\s", text[start:end]) if telling else None
        for m in _NAME.finditer(text, start, end) if telling else ():
            if not secret_name(m["name"]):
                continue
            inside = comment is not None and start + comment.start() <= m.start()
            got = _value(text, m.end(), end, not code and not inside, m["sep"] == ":" or m["q"] != "")
            if got and m["name"].lower().endswith("authorization"):
                got = None  # the scheme's pattern takes the part behind it
            if got and literal(got[2]) and not _SCHEME.match(got[2]) and not (got[2][:1] in "'\"" or m["sep"] == ":" and not m["q"] and text[m.start() - 1 : m.start()] in ("'", '"')):
                found.append(got[:2])
        for m in _GETENV.finditer(text, start, end) if "env" in low or "config" in low else ():
            if secret_look(m["name"]):
                found.append(m.span("name"))
            if m["default"] and secret_name(m["name"]) and literal(m["default"]):
                found.append(m.span("default"))
        for pattern in [x for x, sign in ((_URL, "://"), (_USER_OPTION, "-u")) if sign in line]:
            found += [m.span("v") for m in pattern.finditer(text, start, end) if literal(m["v"])]
        for m in _SCHEME.finditer(text, start, end) if telling or "basic" in low else ():
            if m["kind"].lower() == "basic":
                try:
                    user, colon, word = base64.b64decode(m["v"] + "=" * (-len(m["v"]) % 4)).decode("utf-8").partition(":")
                except (binascii.Error, ValueError):
                    continue
                if colon and literal(word):
                    found.append(m.span("v"))
            elif literal(m["v"]) and any(c.isdigit() for c in m["v"]):
                found.append(m.span("v"))
        if telling and (m := _COMMENT.search(text[start:end])) and secret_name(m["name"].strip()) and literal(m["v"]) and not _PROSE.match(m["v"]):
            found.append((start + m.start("v"), start + m.end("v")))
    if deep:
        known: dict[str, bool] = {}
        for a, b, joined in encoded(text):
            value = text[a:b] if joined is None else joined
            if value not in known:
                known[value] = hidden(value)
            if known[value]:
                found.append((a, b))
    out: list[Span] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


def with_names(text: str, spans: list[Span], names: list[str]) -> list[Span]:
    """Adds the places of literals that stand for environment variables' names, as references show them."""
    for name in names:
        if secret_look(name):
            at = text.find(name)
            while at >= 0:
                if not any(a < at + len(name) and at < b for a, b in spans):
                    spans = sorted([*spans, (at, at + len(name))])
                at = text.find(name, at + len(name))
    return spans


_QUOTED_LINE = re.compile(r"""(?P<lead>\s*(?:\+\s*)?[rbuRBU]{0,2})(?P<q>["'])(?P<body>.*?)(?P<tail>(?P=q)[ \t]*[,+\\]?[ \t]*\r?)?$""")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each place replaced; quotes and line breaks within a place stay, so the code and its line numbers hold."""
    parts, at = [], 0
    for a, b in spans:
        parts += (text[at:a], _blanked(text, a, b))
        at = b
    return "".join(parts) + text[at:]


def _blanked(text: str, a: int, b: int) -> str:
    first, *rest = text[a:b].split("\n")
    out = [MARK]
    quote = text[a - 1 : a]
    if rest and quote in "\"'" and quote and (m := re.search(rf"{quote}[ \t]*[,+\\]?[ \t]*\r?$", first)):
        out[0] += m[0]  # the literal is closed on its line
    elif rest and first.endswith("\r"):
        out[0] += "\r"
    elif not rest and quote in "\"'" and quote and (inner := re.findall(rf"{quote}\s*\+?\s*[rbuRBU]?{quote}", first)):
        out[0] += "".join(inner)  # pieces on one line
    for k, line in enumerate(rest):
        m = _QUOTED_LINE.match(line)
        if m and (m["tail"] or k == len(rest) - 1):
            out.append(m["lead"] + m["q"] + (m["tail"] or ""))
        else:
            out.append("\r" if line.endswith("\r") else "")
    return "\n".join(out)


def _files(sources: DataFrame, env_refs: DataFrame | None) -> DataFrame:
    """(file_id, received_at, submitted_at, content, names): every submission, with the names that references show."""
    path = F.regexp_replace("path", r"\\", "/")
    files = sources.select("file_id", "received_at", "submitted_at", "task_id", path.alias("path"), "content")
    if env_refs is None:
        return files.select("file_id", "received_at", "submitted_at", "content", F.array().cast("array<string>").alias("names"))
    names = env_refs.where(F.length("name") >= 12).where(~F.col("name").rlike("^[A-Z_]+$")).groupBy("task_id", F.regexp_replace("source_file", r"\\", "/").alias("path")).agg(F.collect_set("name").alias("names"))
    return files.join(names, ["task_id", "path"], "left").select("file_id", "received_at", "submitted_at", "content", "names")


def _spans(content: str, names: list[str] | None) -> list[Span]:
    return with_names(content, scan(content), names or [])


def found(sources: DataFrame, env_refs: DataFrame | None = None) -> DataFrame:
    """(file_id, line_no) of every line on which a literal credential begins.

    Submissions are scanned where they lie; their lines, not their contents, are exchanged to find each file's latest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [None if c is None else sorted({c.count("\n", 0, a) + 1 for a, _ in _spans(c, names)}) for c, names in zip(b.column("content").to_pylist(), b.column("names").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(lines, pa.list_(pa.int32()))], names=[*kept, "lines"])

    rows = _files(sources, env_refs).withColumn("digest", F.md5("content"))
    kept = ["file_id", "received_at", "submitted_at", "digest"]
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept) + ", lines array<int>"
    each = rows.select(*kept, "content", "names").mapInArrow(run, schema)
    latest = each.groupBy("file_id").agg(F.max_by("lines", F.struct("received_at", "submitted_at", "digest")).alias("lines"))
    return latest.select("file_id", F.explode("lines").alias("line_no"))


def redacted(sources: DataFrame, env_refs: DataFrame | None = None) -> DataFrame:
    """(file_id, content, n_redacted) of every file with content."""
    w = Window.partitionBy("file_id").orderBy(F.desc("received_at"), F.desc("submitted_at"), F.desc(F.md5("content")))
    files = _files(sources, env_refs).withColumn("place", F.row_number().over(w)).where("place = 1 AND content IS NOT NULL").select("file_id", "content", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, c, _spans(c, names)) for i, c, names in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([redact(c, s) for _, c, s in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int32())], names=["file_id", "content", "n_redacted"])

    return files.mapInArrow(run, "file_id long, content string, n_redacted int")
