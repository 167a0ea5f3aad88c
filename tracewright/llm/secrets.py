"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "named")

#: An assignment: name, operator, then a chain of literals and names joined by + or white-space-free concatenation.
_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:[.\-][A-Za-z_][A-Za-z0-9_]*)*"
_VALUE = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`|\$\{?[A-Za-z_][A-Za-z0-9_]*\}?|[A-Za-z0-9_+/.=@%!$&*~^-]+"""
PAIR = re.compile(rf"(?<![A-Za-z0-9_.\-])(?P<q>[\"'])?(?P<name>{_NAME})(?(q)(?P=q)|(?:\[(?:\"[^\"\n]*\"|'[^'\n]*')\])?)[\x20\t]*(?:\x20:\x20?{_NAME}[\x20\t]*=|:=|=>|(?<![=!<>])=(?!=)|:(?![:/]))[\x20\t]*")
TERM = re.compile(rf"(?:{_VALUE})")
PLUS = re.compile(r"[\x20\t]*\+[\x20\t]*")
XML = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*)>(?P<value>[^<>\n]+)</(?P=name)>")

#: Words of a name, and how strongly each says that the value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.5, "bearer": 0.8, "private": 0.5, "signing": 0.4, "encryption": 0.4, "access": 0.3, "api": 0.3, "key": 0.5, "client": 0.1, "session": 0.3, "salt": 0.4,
}
#: Words of a name that say the value only describes a secret.
HARMLESS = {"name", "path", "file", "url", "uri", "field", "label", "length", "size", "type", "count", "prompt", "hint", "policy", "expiry", "ttl", "public", "id", "header", "format"}
PLACEHOLDER = re.compile(r"(?i)(?:x{3,}|\*{3,}|\.{3,}|<.*>|\$\{.*|%\(.*|\{\{.*|changeme|change_me|example.*|placeholder|your[_-].*|none|null|true|false|undefined|todo|test|dummy|default|redacted)$")
OPEN_PLACEHOLDER = re.compile(r"(?i)(?:\$\{|%\(|\{\{|example|your[_-])")
#: Characters of a value that are kept as they are; longer than every closed placeholder.
HEAD = 32
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
SCORE = 1.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind that are long enough. Offsets are code points."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    return max(min(1.0, sum(SENSITIVE.get(w, 0.0) for w in words)), SENSITIVE.get("".join(words), 0.0))


def literal_score(value: str) -> float:
    """0 for short, blank, placeholder or prose values; else up to 1 by entropy and mix of characters."""
    return Value(0, 0, value).score()


class Value:
    """A literal at [start, end), or a chain of values joined by +. A chain refers to its parts and keeps what its score needs of the whole string, so that constants built from constants are never written out."""

    __slots__ = ("counted", "end", "head", "n", "parts", "start", "tail", "text")

    def __init__(self, start: int, end: int, text: str, parts: tuple[Value, ...] = ()):
        self.start, self.end, self.text, self.parts = start, end, text, parts
        self.counted: Counter | None = None
        self.n, self.head, self.tail = len(text), text[:HEAD], text[-1:]
        if parts:
            self.counted = Counter()
            for p in parts:
                self.counted.update(p.counts())
                self.head, self.n = (self.head + p.head)[:HEAD] if self.n < HEAD else self.head, self.n + p.n
                self.tail = p.tail or self.tail

    def counts(self) -> Counter:
        if self.counted is None:
            self.counted = Counter(self.text)
        return self.counted

    def score(self) -> float:
        if self.n < 8:
            return 0.0
        counts = self.counts()
        if any(map(str.isspace, counts)) or self._placeholder():
            return 0.0
        bits = -sum(k / self.n * math.log2(k / self.n) for k in counts.values())
        kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-" for c in counts}
        return min(1.0, bits / 4.0) * (0.5 + 0.25 * min(2, len(kinds) - 1))

    def _placeholder(self) -> bool:
        """PLACEHOLDER on the whole value; of values longer than their kept head, by head, last character and the set of characters."""
        if self.n <= HEAD:
            return bool(PLACEHOLDER.match(self.head))
        used = set(self.counts())
        return used <= {"x", "X"} or used in ({"*"}, {"."}) or bool(OPEN_PLACEHOLDER.match(self.head)) or (self.head[0] == "<" and self.tail == ">")


def lex_pairs(text: str) -> list[tuple[str, list[tuple[int, int, str]], bool]]:
    """Name-value pairs in order: (name, parts, quoted). A part is (start, end, source text) of a literal or a name; several are joined by +."""
    found, at = [], 0
    while m := PAIR.search(text, at):
        at, parts, quoted = m.end(), [], False
        while t := TERM.match(text, at):
            token = t.group()
            if token[0] in "\"'`":
                quoted = True
                parts.append((t.start() + 1, t.end() - 1, token))
            else:
                token = token.rstrip(".,")
                if not token:
                    break
                parts.append((t.start(), t.start() + len(token), token))
            at = parts[-1][1] + (token[0] in "\"'`")
            if not (p := PLUS.match(text, at)):
                break
            at = p.end()
        if parts:
            found.append((m.group("name"), parts, quoted))
    found += [(m.group("name"), [(m.start("value"), m.end("value"), m.group("value"))], True) for m in XML.finditer(text)] if "</" in text else []
    return found


def named_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly, through constants assigned before, or joined by +, however many. Each is reported where it is written, short pieces of a secret included."""
    constants: dict[str, Value] = {}
    spans: set[tuple[int, int, str]] = set()
    told: dict[int, Value] = {}
    for name, parts, _ in lex_pairs(text):
        values = []
        for a, b, token in parts:
            bare = token[1:].strip("{}") if token[0] == "$" else token
            if token[0] in "\"'`":
                values.append(Value(a, b, token[1:-1]))
            elif bare in constants:
                values.append(constants[bare])
            elif token[0] != "$":
                values.append(Value(a, b, token))
        value = constants[name] = values[0] if len(values) == 1 else Value(0, 0, "", tuple(values))
        weight = name_score(name)
        if weight and (strong := value.score()) >= 0.5 and weight + strong > SCORE:
            open_ = [value]
            while open_:  # every value is told once, so shared parts cost nothing again
                if id(v := open_.pop()) not in told:
                    told[id(v)] = v
                    open_ += v.parts
                    if not v.parts and v.n:
                        spans.add((v.start, v.end, "named"))
    return sorted(spans)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_text(text: str | None) -> tuple[int, int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    n = Counter(k for _, _, k in base)
    named = named_spans(text) if "=" in text or ":" in text or "</" in text else []
    return n["assign"], n["access"], n["hex"], len(named), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + named)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_named long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row per row: counts by kind, SHA-256 of the base spans, all spans as kind:start:end (code points, end exclusive).

    Each text is lexed whole in its own task; nothing is shuffled. Null or empty text: no spans, digest of the empty string. Null doc_id and repeated rows stay as they are. Other columns are not read. Empty table: no rows.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                some = b.slice(k, 512)
                found = list(zip(*(scan_text(t) for t in some.column(1).to_pylist()), strict=True))
                columns = [pa.array(c, pa.int64()) for c in found[:4]] + [pa.array(c, pa.string()) for c in found[4:]]
                yield pa.record_batch([some.column(0), *columns], names=names)

    return bounded_batches(pick(docs, doc_id="long", text="string")).mapInArrow(run, SCHEMA)
