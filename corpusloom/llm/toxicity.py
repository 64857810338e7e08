"""Toxicity: Levenshtein automata intersected with a lexicon trie, hits weighed by the window around them."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import ship

#: Labelled rows that a model is fitted on at most, taken by a hash of the id, and characters of their whole texts.
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 64_000_000
#: Whole terms from this length on also match at one edit.
FUZZY_LENGTH = 5
#: Words on either side of a hit that tell quotation from abuse.
WINDOW = 6
THRESHOLD = 0.7

# A general starting lexicon, words that report speech, words that address somebody.
SEED_TERMS = "idiot idiots moron morons stupid loser losers pathetic worthless disgusting scum trash clown imbecile retard bastard bitch asshole".split()
REPORTING = frozenset("said says say quote quoted quoting called calling word words term wrote told tells alleged reported reportedly sagte nannte wort dit mot appelle dijo palabra llamó".split())
ADDRESS = frozenset("you your youre yourself du dein dich tu ton toi vous usted eres".split())
LEET = {ord(a): ord(b) for a, b in zip("013457@$", "oieastas")}
QUOTES = frozenset(map(ord, "\"“”„«»‘’`'"))


def held_out(doc_id: Column) -> Column:
    """Rows of which no label is learned: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


_WORD = None


def _word_table() -> np.ndarray:
    """Which code points are of words: letters, digits, and signs that stand for letters."""
    global _WORD
    if _WORD is None:
        _WORD = np.zeros(0x110000, bool)
        _WORD[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]] = True
        _WORD[[ord("@"), ord("$")]] = True
    return _WORD


class Matcher:
    """One table-driven automaton: the trie of all terms met by the Levenshtein automata of at most one edit.

    A state is a set of (trie node, edits, whether the node is past a stem); sets are made deterministic when built.
    Terms are (text, is_stem): a stem matches the start of a word, exactly; a whole term matches a word, at one edit
    too from FUZZY_LENGTH letters on.
    """

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms = terms
        child: list[dict[str, int]] = [{}]
        whole: dict[int, int] = {}
        stems: dict[int, int] = {}
        fuzzy = [False]  # whether a long whole term goes through the node
        for t, (text, stem) in enumerate(terms):
            at = 0
            for c in text:
                if c not in child[at]:
                    child[at][c] = len(child)
                    child.append({})
                    fuzzy.append(False)
                at = child[at][c]
                fuzzy[at] |= not stem and len(text) >= FUZZY_LENGTH
            (stems if stem else whole).setdefault(at, t)
        fuzzy[0] = any(not s and len(x) >= FUZZY_LENGTH for x, s in terms)
        letters = sorted({c for text, _ in terms for c in text})
        self.symbol = np.zeros(0x110000, np.int16)
        for k, c in enumerate(letters):
            self.symbol[ord(c)] = k + 1
        for a, b in LEET.items():
            self.symbol[a] = self.symbol[b]

        def closed(items: set[tuple[int, int]]) -> frozenset:
            out = set(items)
            for node, edits in items:
                if node >= 0 and edits == 0 and fuzzy[node]:
                    out.update((n, 1) for n in child[node].values() if fuzzy[n])  # a letter left out
            return frozenset(out)

        def after(state: frozenset, c: str | None) -> frozenset:
            out = set()
            for node, edits in state:
                if node < 0:
                    out.add((node, edits))
                    continue
                n = child[node].get(c) if c is not None else None
                if n is not None:
                    if edits == 0 or fuzzy[n]:
                        out.add((n, edits))
                    if edits == 0 and n in stems:
                        out.add((-1 - stems[n], 0))  # past a stem: the rest of the word is free
                if edits == 0 and fuzzy[node]:
                    out.add((node, 1))  # a letter too many
                    out.update((m, 1) for m in child[node].values() if fuzzy[m])  # a wrong letter
            return closed(out)

        start = closed({(0, 0)})
        states, todo, rows = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters) + 1)]
        while todo:
            state = todo.pop(0)
            row = []
            for c in (None, *letters):
                n = after(state, c)
                if n not in states:
                    states[n] = len(states)
                    todo.append(n)
                row.append(states[n])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.term = np.full(len(states), -1, np.int32)
        self.edits = np.zeros(len(states), np.int8)
        for state, s in states.items():
            ends = [(e, -1 - n) for n, e in state if n < 0]
            ends += [(e, whole[n]) for n, e in state if n in whole and (e == 0 or len(terms[whole[n]][0]) >= FUZZY_LENGTH)]
            if ends:
                self.edits[s], self.term[s] = min(ends)

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The final state of each word, all words stepped together; words that cannot match any more are left."""
        symbols = self.symbol[codes]
        state = np.ones(len(starts), np.int32)
        live = np.arange(len(starts))
        sizes = ends - starts
        k = 0
        while len(live):
            state[live] = self.table[state[live], symbols[starts[live] + k]]
            k += 1
            live = live[(state[live] > 0) & (sizes[live] > k)]
        return state


class Model:
    """Weights of the terms and a logistic score on what a text's hits add up to."""

    def __init__(self, terms: list[tuple[str, bool, float]], base: float = 0.05) -> None:
        self.matcher = Matcher([(t, s) for t, s, _ in terms])
        self.weight = np.array([w for _, _, w in terms])
        rate = min(max(base, 1e-3), 0.5)
        self.coefficients = np.array([math.log(rate / (1 - rate)) - 1.0, 6.0, 4.0, 1.5])
        #: Misspelt forms that clean texts use: words of their own.
        self.cleared: frozenset[str] = frozenset()

    def features(self, texts: list[str | None]) -> np.ndarray:
        """(1, strongest exact hit, strongest misspelt one, log of 1 + all exact hits) of each whole text."""
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        table = _word_table()
        at = 0
        while at < len(texts):
            # About a megabyte of text a step.
            step, size = at, 0
            while step < len(texts) and (size == 0 or size + len(texts[step] or "") <= 1 << 20):
                size += len(texts[step] or "")
                step += 1
            joined = "\n".join((t or "").lower() for t in texts[at:step])
            lengths = np.array([len((t or "").lower()) + 1 for t in texts[at:step]])
            bounds = np.cumsum(lengths)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = table[codes]
            edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            begin, end = bounds - lengths, bounds - 1  # of each text
            first, past = np.searchsorted(starts, begin), np.searchsorted(starts, end)  # its words
            state = self.matcher.match(codes, starts, ends)
            found = np.flatnonzero(self.matcher.term[state] >= 0)
            for w in found.tolist():
                edits = self.matcher.edits[state[w]]
                if edits and joined[starts[w] : ends[w]] in self.cleared:
                    continue
                k = int(np.searchsorted(bounds, starts[w], "right"))
                text, own = at + k, (int(first[k]), int(past[k]), int(begin[k]), int(end[k]))
                value = self.weight[self.matcher.term[state[w]]] * self._context(joined, codes, starts, ends, w, own)
                kind = 2 if edits else 1
                out[text, kind] = max(out[text, kind], value)
                out[text, 3] += 0.0 if edits else value
            at = step
        out[:, 3] = np.log1p(out[:, 3])
        return out

    def clear(self, clean_texts: list[str]) -> None:
        """Learn which misspelt forms are words of clean texts."""
        table, found = _word_table(), set()
        for text in clean_texts:
            words = list({w for w in "".join(c if table[ord(c)] else " " for c in text.lower()).split()} - found)
            if not words:
                continue
            codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum([len(w) for w in words])
            state = self.matcher.match(codes, np.concatenate(([0], ends[:-1])), ends)
            for k in np.flatnonzero((self.matcher.term[state] >= 0) & (self.matcher.edits[state] > 0)).tolist():
                found.add(words[k])
        self.cleared = frozenset(found)

    @staticmethod
    def _context(text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: int, own: tuple[int, int, int, int]) -> float:
        """Under 1 for a hit in quotation marks or reported speech, over 1 for one aimed at somebody.

        own: the first word of the hit's text and the one past its last, where the text begins and ends. Nothing
        outside them counts; signs before its first and behind its last word do.
        """
        first, past, begin, end = own
        a, b = max(first, w - WINDOW), min(past, w + WINDOW + 1)
        lo, hi = starts[a], ends[b - 1]
        before = QUOTES.intersection(codes[max(begin, starts[w] - 2) : starts[w]].tolist())
        behind = QUOTES.intersection(codes[ends[w] : min(end, ends[w] + 2)].tolist())
        near = set(text[lo:hi].split())
        factor = 1.0
        if before and behind:
            factor *= 0.45
        if near & REPORTING:
            factor *= 0.7
        if near & ADDRESS:
            factor *= 1.2
        return factor

    def fit(self, texts: list[str | None], labels: np.ndarray) -> None:
        """Ridge logistic regression towards the starting coefficients, by Newton steps that are halved until they help."""
        x, y, c0 = self.features(texts), labels.astype(float), self.coefficients
        c, ridge = c0.copy(), np.eye(4) * 0.5

        def loss(c: np.ndarray) -> float:
            z = x @ c
            return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (c - c0) @ ridge @ (c - c0))

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ (c - c0))
            size = 1.0
            while size > 1e-6 and loss(c - size * step) > loss(c):
                size /= 2
            c = c - size * step
            if np.abs(size * step).max() < 1e-8:
                break
        # More and stronger hits never lower a score.
        self.coefficients = np.array([c[0], *np.maximum(c[1:], 0.0)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        # Row by row: a matrix product may round by the number of rows.
        return 1 / (1 + np.exp(-np.clip((self.features(texts) * self.coefficients).sum(axis=1), -30, 30)))


def learn_terms(texts: list[str], labels: np.ndarray) -> list[tuple[str, bool, float]]:
    """Terms of toxic texts, (text, is_stem, weight): whole words and word starts whose presence speaks for the label
    beyond what chance allows among as many terms, chosen greedily until no more toxic texts are covered."""
    table = _word_table()
    base = float(np.mean(labels)) if len(labels) else 0.0
    if not 0 < base < 1:
        return []

    def places(text: str) -> tuple[list[str], dict[str, str]]:
        """A text's words, and its terms, stems with a star, with a word that each stands for."""
        words = "".join(c if table[ord(c)] else " " for c in text.lower()).split()
        distinct = [w for w in dict.fromkeys(words) if not w.isdigit()]
        terms = {w: w for w in distinct if len(w) >= 3}
        return words, terms | {w[:k] + "*": w for w in distinct for k in (4, 5, 6) if len(w) >= k}

    # Only terms of toxic texts can be chosen; of the others it is only counted how many there are.
    toxic, clean = np.flatnonzero(labels).tolist(), np.flatnonzero(labels == 0).tolist()
    n_toxic = Counter(t for i in toxic for t in places(texts[i])[1])
    n_clean: Counter[str] = Counter()
    others = set()
    for i in clean:
        for t in places(texts[i])[1]:
            if t in n_toxic:
                n_clean[t] += 1
            else:
                others.add(hash(t))
    need = math.log(len(n_toxic) + len(others) + 1) + 3
    del others
    # Copies of a text can only lower a term's rate: where it is too low with all of them, no more need be known.
    open_ = {t for t, k in n_toxic.items() if (k + 0.5) / (n_clean[t] + k + 1) > 0.8}
    toxic_with: dict[str, list[int]] = defaultdict(list)
    around: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for i in toxic:
        words, terms = places(texts[i])
        place = {w: k for k, w in enumerate(words)}
        for t in terms.keys() & open_:
            toxic_with[t].append(i)
            k = place[terms[t]]
            around[t].add((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
    good, rates = {}, {}
    for name in sorted(toxic_with):
        docs, t = toxic_with[name], (name.rstrip("*"), name.endswith("*"))
        # Copies of one text share the words around a term and count once.
        k = min(len(docs), len(around[name]))
        n = n_clean[name] + k
        rate = rates[t] = (k + 0.5) / (n + 1)
        if rate > 0.8 and k * math.log(rate / base) + (n - k) * math.log((1 - rate) / (1 - base)) > need:
            good[t] = (set(docs), rate)
    out, covered = [], set()
    # The widest reach first; word starts have to reach further than whole words, longer terms win ties.
    for t in sorted(good, key=lambda t: (-len(good[t][0]) * (0.9 if t[1] else 1.0), -len(t[0]), t[0])):
        if len(good[t][0] - covered) >= max(2, 0.25 * len(good[t][0])):
            out.append((*t, good[t][1]))
            covered |= good[t][0]
    if out:
        # Words that came with a chosen one in the same texts are of the lexicon as well.
        have = {t for t, _, _ in out}
        more = sorted((t for t in good if not t[1] and t[0] not in have), key=lambda t: (-len(good[t][0]), t[0]))
        stems = tuple(t for t, s, _ in out if s)
        out += [(*t, good[t][1]) for t in more if not (stems and t[0].startswith(stems))]
        # A stem matches exactly. The words that it stands for match at one edit too, rarer ones on its evidence.
        under = [t for t, rate in rates.items() if not t[1] and len(t[0]) >= FUZZY_LENGTH and rate > 0.8 and t[0] not in have and stems and t[0].startswith(stems)]
        under.sort(key=lambda t: (-len(toxic_with[t[0]]), t[0]))
        out += [(*t, rates[t]) for t in under]
    return out


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS
) -> Model:
    """A model of at most sample_rows labelled rows of sample_chars characters, none of them held out, taken in an order
    by a hash of the id; rows of null text or label teach nothing. Of an id's labels the highest counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic")).filter("toxic is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The labels' ids are ranked before any text is read; the sample's rows then meet their texts.
    place = F.xxhash64("doc_id", F.lit(17)).alias("place")
    chosen = known.select("doc_id", "toxic", place).orderBy("place", "doc_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    met = texts.join(F.broadcast(chosen), "doc_id")
    # A row is in if those before it and itself have no more than sample_chars characters.
    sizes = met.select("place", "doc_id", F.length("text").alias("n")).orderBy("place", "doc_id", "n").limit(sample_rows).collect()
    total, ids = 0, []
    for r in sizes:
        total += r.n
        if total <= sample_chars:
            ids.append(r.doc_id)
    fits = docs.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "doc_id long")
    rows = met.join(F.broadcast(fits), "doc_id").orderBy("doc_id", "text").limit(sample_rows).collect()
    sample, y = [r.text for r in rows], np.array([int(r.toxic) for r in rows])
    terms = learn_terms(sample, y)
    have = {t for t, _, _ in terms}
    model = Model(terms + [(t, False, 0.9) for t in SEED_TERMS if t not in have], float(y.mean()) if len(y) else 0.05)
    model.clear([t for t, label in zip(sample, y) if not label])
    if len(y) and 0 < y.mean() < 1:
        model.fit(sample, y)
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with two columns more, prefixed: score (0 to 1, higher: likelier toxic) and predicted (1 from THRESHOLD on).

    Only the text is an input. Null, empty and wordless texts have no hits and so the lowest score there is. Whole
    texts are read. Columns of any name pass through; empty tables stay empty.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # bounded by the fitted sample
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__corpusloom_score", T.DoubleType()), T.StructField("__corpusloom_predicted", T.IntegerType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                score = shared.value.score(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names
                )

    return docs.mapInArrow(run, schema)
