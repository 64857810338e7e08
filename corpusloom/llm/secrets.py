"""Secret scans: base patterns, and assignment-aware lexing that follows literals to sensitively named targets."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship

# The base kinds, in order, and their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the same as all runs of [0-9a-f]+ with the short ones dropped
KINDS = ("assign", "access", "hex", "literal")

#: How strongly one part of a target's name, or two adjacent parts joined, speaks for a secret.
NAME_WEIGHT = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "connectionstring": 0.7,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%\(.*\).*|your[_-].*|changeme|change_me|example.*|placeholder|dummy|none|null|nil|true|false|undefined|todo)$")
#: A literal is reported from this product of its name's and its own score.
LEAST_SCORE = 0.5

# Of names of passphrases, literals may hold blanks.
PHRASES = frozenset("password passwd pwd passphrase phrase".split())
#: Distinct characters that an entropy is taken over: code points modulo this.
_ALPHABET = 128

# The token classes of source and configuration text. Names may be dotted; runs are possessive, so lexing is linear.
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+(?:(?:\.|->|::|-)[A-Za-z0-9_$]++)*+"
_STRING = (
    r'"""(?:[^"\\]|\\.|"(?!""))*+"""' + r"|'''(?:[^'\\]|\\.|'(?!''))*+'''"
    r'|"(?:\\.|[^"\\\n])*+"' + r"|'(?:\\.|[^'\\\n])*+'|`[^`\n]*+`"
)
#: A target and its operator: `a =`, `a :`, `"a":`, `a["b"] :=`, `a =>`, `a: str =`; the name is group 1.
_ANNOTATION = r"(?:[\x20\t]*+:[\x20\t]*+[A-Za-z_][A-Za-z0-9_.\[\]]*+(?=[\x20\t]*+=(?!=)))?"
TARGET = re.compile(rf"""(?<![A-Za-z0-9_$.-])({_NAME})["'`]?+\]?+{_ANNOTATION}[\x20\t]*+(?::=|=>|=(?![=>~])|:(?![=:]))""")
_TERM = re.compile(rf"[\x20\t]*+(?:[\x20\t(]*+)(?:[rbuf]{{1,2}}(?=[\"']))?(?:({_STRING})|({_NAME})(?![A-Za-z0-9_(/+=~@#%^&*]))", re.S)
#: What joins terms: an operator, or nothing between two strings. A name must follow an operator.
_JOIN = re.compile(r"""[\x20\t)]*+(?:(\+(?!=)|\.\.?(?![.\d])|&(?!&)|\|\|)(?:[\x20\t]*+\\?\n)?|(?=["']))""")
_BARE = re.compile(r"[\x20\t]*+([A-Za-z0-9_$+/.=~!@#%^&*-]++)")
_BLANKS = re.compile(r"[\x20\t]*+")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


class Value:
    """What a name stands for: a literal, or two values joined. It keeps what a score needs, never its whole text."""

    __slots__ = ("blank", "counts", "kinds", "left", "length", "placeholder", "reported", "right", "span")

    @classmethod
    def literal(cls, text: str, start: int) -> Value:
        own = cls()
        own.span, own.left, own.right, own.reported = (start, start + len(text)), None, None, False
        own.length = float(len(text))
        own.counts = Counter(ord(c) % _ALPHABET for c in text)
        own.kinds = frozenset("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in set(text))
        own.blank = " " in text.strip()
        own.placeholder = not text or PLACEHOLDER.match(text) is not None
        return own

    @classmethod
    def joined(cls, left: Value, right: Value) -> Value:
        own = cls()
        own.span, own.left, own.right, own.reported = None, left, right, False
        own.length = left.length + right.length
        own.counts = Counter(left.counts)
        for c, n in right.counts.items():
            own.counts[c] += n
        if own.length > 1e12:  # joined with itself again and again: only proportions count
            own.length, own.counts = 1e6, Counter({c: n * 1e6 / own.length for c, n in own.counts.items()})
        own.kinds = left.kinds | right.kinds
        own.blank = left.blank or right.blank
        own.placeholder = left.placeholder and right.placeholder
        return own

    def score(self, phrase: bool) -> float:
        """0 for short values and placeholders; rises with length, alphabet and entropy to 1, less than half for blanks."""
        if self.length < 6 or self.placeholder:
            return 0.0
        total = sum(self.counts.values())
        bits = -sum(n / total * math.log2(n / total) for n in self.counts.values() if n)
        whole = min(1.0, 0.35 + 0.1 * len(self.kinds) + 0.1 * bits + 0.01 * min(self.length, 20))
        return 0.45 * whole if self.blank and not phrase else whole

    def report(self) -> Iterator[tuple[int, int]]:
        """Spans of its literals that were not reported before."""
        todo = [self]
        while todo:
            one = todo.pop()
            if one.reported:
                continue
            one.reported = True
            if one.span:
                yield one.span
            else:
                todo += [one.left, one.right]


@functools.lru_cache(4096)
def name_parts(name: str) -> tuple[float, bool]:
    """(how strongly a target's name speaks for a secret, whether it may be a phrase)."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    words = [*parts, *joined]
    return max((NAME_WEIGHT.get(p, 0.0) for p in words), default=0.0), not PHRASES.isdisjoint(words)


def name_score(name: str) -> float:
    return name_parts(name)[0]


def literal_score(text: str) -> float:
    return Value.literal(text, 0).score(False)


def _expression(text: str, at: int, held: dict[str, Value]) -> tuple[Value | None, int]:
    """(value, end) of `term (join term)*` from `at`, a term being a string or a name. None if no part is known."""
    value, joins = None, False
    while True:
        term = _TERM.match(text, at)
        if term is None:
            return value, at
        string, name = term.group(1, 2)
        if string is not None:
            quote = 3 if string[:3] in ('"""', "'''") and len(string) >= 6 else 1
            own = Value.literal(string[quote:-quote], term.start(1) + quote)
        elif joins or at == term.start() and value is None:
            own = held.get(name)
        else:
            return value, at
        if own is not None:
            value = own if value is None else Value.joined(value, own)
        at = term.end()
        join = _JOIN.match(text, at)
        if join is None or (join.group(1) is None and string is None):
            return value, at
        if join.group(1) is None and _TERM.match(text, join.end()) is None:
            return value, at
        joins = join.group(1) is not None
        at = join.end()


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitively named target: directly, joined with others, or through named constants.

    Targets of a chain `a = b = "x"` all get the value; a name keeps the last one. A value is scored as a whole, and
    all its literals are reported. Unquoted values are literals up to the next blank or delimiter.
    """
    if "=" not in text and ":" not in text:
        return []
    held: dict[str, Value] = {}
    found: list[Span] = []
    targets: list[str] = []
    at = 0
    while (m := TARGET.search(text, at)) is not None:
        targets.append(m.group(1))
        at = m.end()
        further = _BLANKS.match(text, at).end()
        chained = TARGET.match(text, further)
        if chained is not None and "=" in text[m.end(1) : m.end()] and "=" in text[chained.end(1) : chained.end()]:
            at = further
            continue
        value, end = _expression(text, at, held)
        bare = _BARE.match(text, at) if value is None else None
        # Without a string or a known name: a bare word of a configuration, unless it is called or indexed.
        if bare is not None and (end == at or bare.end() <= end) and text[bare.end() : bare.end() + 1] not in ("(", "["):
            value, end = Value.literal(bare.group(1).rstrip(".,;"), bare.start(1)), bare.end()
        for name in targets:
            if value is None:
                held.pop(name, None)
                continue
            held[name] = value
            weight, phrase = name_parts(name)
            if weight and weight * value.score(phrase) >= LEAST_SCORE:
                found += [(a, 3, b) for a, b in value.report() if b > a]
        targets = []
        at = max(end, at)
    return sorted(set(found))


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each by start and then kind; null counts as empty."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted({*base, *literal_spans(text)})


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of docs.

    Positions are code points, ends exclusive. The base kinds are found leftmost and without overlap, each by itself;
    `literal` spans come from lexing. A name keeps its last value within its text. Time grows with a text's length and
    not with the lengths of chains of constants. Null and empty texts have no spans and the digest of the empty string.
    Ids may be null or repeated, each row is judged by itself; other columns are ignored; empty tables stay empty.
    """
    ship(docs.sparkSession)

    def scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = scan(text.as_py())
                n = [0, 0, 0]
                for _, kind, _ in base:
                    n[kind] += 1
                rows.append((*n, hashlib.sha256(digest(base).encode()).hexdigest(), digest(every)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        scan_all, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
