"""BPE by automaton: merges compiled into a deterministic automaton over tokens, words encoded along its one path."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship

#: Words and transitions that a worker remembers; beyond that it starts anew.
WORDS_HELD, STEPS_HELD = 250_000, 500_000
#: No code point below is unassigned, or a mark of which tables differ.
FIRST_ODD = 0x378


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def unknown_letters() -> str:
    """Letters and numbers of the regex library's Unicode that the vocabulary's library does not know yet, as the
    inside of a regex class. Only code points without a category in Python's Unicode can differ."""
    import tokenizers

    both = regex.compile(r"[\p{L}\p{N}]")
    open_ = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn" and both.match(c))
    left = tokenizers.normalizers.Replace(tokenizers.Regex(r"[\p{L}\p{N}]"), "").normalize_str(open_)
    return "".join(f"\\U{ord(c):08x}" for c in left) or r"\x00"


def odd_letters() -> np.ndarray:
    """Whether Python and the vocabulary's library may differ on the normal form or case of a code point: those that
    Python's Unicode tables do not know, and marks and composed letters that the library does not order or compose as
    Python does. All others are fixed by the standard."""
    from tokenizers import normalizers

    nfc = normalizers.NFC().normalize_str
    odd = np.zeros(0x110000, bool)
    marks = []
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        if unicodedata.category(c) == "Cn":
            odd[point] = True
            continue
        if unicodedata.combining(c):
            marks.append(c)
        if unicodedata.decomposition(c):
            spelled = unicodedata.normalize("NFD", c)
            if spelled != c and nfc(spelled) != unicodedata.normalize("NFC", c):
                odd[[ord(x) for x in spelled + c]] = True
    by_class = {unicodedata.combining(c): c for c in marks}
    for c in marks:
        probes = [t for m in by_class.values() for t in (f"a{m}{c}", f"a{c}{m}")]
        odd[ord(c)] |= any(nfc(t) != unicodedata.normalize("NFC", t) for t in probes)
    return odd


class Automaton:
    """A deterministic automaton over tokens that accepts, for each string of symbols, its BPE tokenisation alone.

    It starts with one state that every symbol leads back to. The merge of u and v is a gadget on it: for the state q
    that u leads to, every arc u is led to a copy of q that has no arc v, and beside each arc u an arc uv leads where
    v led from q. A token's arcs all lead to one state, named by the token, so there is one copy for each merge at
    most. A copy is held as what its gadget took: the state of u lacks v since that merge, and what the state of its
    right part lacked when u was born. A state has an arc if neither the arc nor, at the time it was made, what it was
    made from was taken.
    """

    START = 0xFFFFF

    def __init__(self, symbols: list[int], merges: list[tuple[int, int, int]]) -> None:
        self.tokens = set(symbols)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born = dict.fromkeys(symbols, -1)
        self.lacks: dict[int, dict[int, int]] = {}  # state -> arc -> the merge that took it
        for time, (u, v, w) in enumerate(merges):
            if u not in self.tokens or v not in self.tokens or not self.has(u, v):
                continue  # no tokenisation so far has u before v: the arc never comes to be
            self.left[w], self.right[w], self.born[w] = u, v, time
            self.tokens.add(w)
            self.lacks.setdefault(u, {})[v] = time

    def has(self, state: int, token: int) -> bool:
        """Whether the state has an arc with the token."""
        if state == self.START:
            return True
        until = None  # the merge that bore the longer token, whose state is a copy of this one as it was then
        while state is not None:
            lacks = self.lacks.get(state)
            if lacks:
                arc, after = token, None  # the merge that made the longer arc from this one
                while arc is not None:
                    taken = lacks.get(arc)
                    if taken is not None and (until is None or taken < until) and (after is None or taken <= after):
                        return False
                    after, arc = self.born[arc], self.left.get(arc)
            until, state = self.born[state], self.right.get(state)
        return True


class Tokenizer:
    """A byte-level BPE with word ends, lower-cased, from a tokenizers JSON file."""

    # The file's split pattern, on lower-cased text. \s there is Unicode white space.
    SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"

    def __init__(self, config: dict) -> None:
        plain = self.SPLIT.format(L=r"\p{L}", N=r"\p{N}", S=self.SPACE)
        self.split = regex.compile(plain)
        # Beyond U+0530 the regex library may know letters that the vocabulary's library does not.
        new = unknown_letters()
        known = "(?V1)" + self.SPLIT.format(L=rf"[\p{{L}}--[{new}]]", N=rf"[\p{{N}}--[{new}]]", S=self.SPACE)
        self.split_far, self.far = regex.compile(known), re.compile("[^\x00-\u052f]")
        self.odd = odd_letters()
        model = config["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.automaton = Automaton([*self.inner, *self.final], merges)
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.label = [""] * (max(chain(vocab.values(), self.special.values())) + 1)
        for text, i in chain(vocab.items(), self.special.items()):
            self.label[i] = text
        spelled: dict[int, tuple[int, ...]] = {s: (s,) for s in chain(self.inner, self.final)}
        for u, v, w in merges:
            spelled[w] = spelled[u] + spelled[v]
        # Table of the tokens' spellings in symbols: state -> symbol -> state; where to go on when there is no such arc;
        # and the tokens that end there, longest first, as (symbols, token).
        self.goto: list[dict[int, int]] = [{}]
        own: dict[int, tuple[int, int]] = {}
        for token in sorted(self.automaton.tokens):
            at = 0
            for s in spelled[token]:
                step = self.goto[at].get(s)
                if step is None:
                    step = self.goto[at][s] = len(self.goto)
                    self.goto.append({})
                at = step
            own[at] = (len(spelled[token]), token)
        self.size = {token: len(spelled[token]) for token in self.automaton.tokens}
        self.fail = [0] * len(self.goto)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.goto)
        todo = deque([0])
        while todo:  # breadth first: shorter suffixes are ready
            at = todo.popleft()
            for s, step in self.goto[at].items():
                back = self.fail[at]
                while at and back and s not in self.goto[back]:
                    back = self.fail[back]
                self.fail[step] = self.goto[back].get(s, 0) if at else 0
                self.ends[step] = ((own[step],) if step in own else ()) + self.ends[self.fail[step]]
                todo.append(step)
        self.steps: dict[int, int] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def __getstate__(self):
        return self.__dict__ | {"steps": {}, "words": {}}

    def step(self, state: int, token: int) -> int:
        """The transition table, filled as it is used: the next state, or -1."""
        key = state << 20 | token
        after = self.steps.get(key)
        if after is None:
            if len(self.steps) >= STEPS_HELD:
                self.steps.clear()
            after = self.steps[key] = token if self.automaton.has(state, token) else -1
        return after

    def word(self, word: str) -> bytes:
        """Ids of one pre-split word as little-endian 32-bit integers: the automaton's one path that spells it.

        Each prefix has one path too. A prefix's last token is the one token that ends there and has an arc from the
        state of what is before it.
        """
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        state = [Automaton.START]
        goto, fail, ends, steps = self.goto, self.fail, self.ends, self.steps
        at = 0
        for s in symbols:
            step = goto[at].get(s)
            while step is None:
                at = fail[at]
                step = goto[at].get(s)
            at = step
            for size, token in ends[at]:
                key = state[-size] << 20 | token
                after = steps.get(key)
                if after is None:
                    after = self.step(state[-size], token)
                if after >= 0:
                    state.append(after)
                    break
        out, at = [], len(symbols)
        while at:
            token = state[at]
            out.append(token)
            at -= self.size[token]
        return np.array(out[::-1], "<u4").tobytes()

    def __missing_word(self, word: str) -> bytes:
        ids = self.word(word)
        if len(word) <= 64:
            if len(self.words) >= WORDS_HELD:
                self.words.clear()
            self.words[word] = ids
        return ids

    def normal(self, text: str) -> str:
        """The text in composed form and lower case, as the vocabulary's library has them."""
        if text.isascii():
            return text.lower()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if points.max() >= FIRST_ODD and self.odd[points].any():
            from tokenizers import normalizers

            return normalizers.Lowercase().normalize_str(normalizers.NFC().normalize_str(text))
        text = unicodedata.normalize("NFC", text)
        # Lower-casing is by character: a capital sigma has no final form here.
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self.specials.split(text) if self.specials and "<|" in text else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            part = self.normal(part)
            words = (self.split_far if self.far.search(part) else self.split).findall(part)
            held = self.words
            got = list(map(held.get, words))
            if None in got:
                for k, ids in enumerate(got):
                    if ids is None:
                        got[k] = held.get(words[k]) or self.__missing_word(words[k])
            out += got
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The arc labels of the ids in turn; the file names no decoder, so they are joined by spaces as they are."""
        return " ".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(doc_id, ids binary, decoded string) for each row of docs: ids are little-endian unsigned 32-bit integers.

    `path` is a tokenizers JSON file that the driver reads and compiles; workers get the automaton. Null and empty
    texts have no ids and decode to the empty string. Ids may be null or repeated; other columns are ignored.
    """
    spark = ship(docs.sparkSession)
    compiled = spark.sparkContext.broadcast(Tokenizer.from_file(path))  # bounded by the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [tokenizer.encode(t.as_py()) for t in batch.column(1)]
                text = [tokenizer.decode(i) if decode else None for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        encode, "doc_id long, ids binary, decoded string"
    )
