"""Nulls, repeats, ties, empty tables, long texts and clashing columns of the llm operators, and what hashes must not do."""

import hashlib
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, hnsw, linedup, minhash, mixing, queries, rabitq, secrets, substring, toxicity, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
CLASH = "doc_id long, text string, h long, g long, node long, key long, later string, score double, component string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "later", 0.5, "c") for i, t in rows], CLASH)


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_and_lines_that_collide_in_polynomials(spark):
    u, v = thue_morse(1024, 0), thue_morse(1024, 1)
    words = spark.createDataFrame([(1, " ".join([u] * 13)), (2, " ".join([v] * 13)), (3, " ".join([u] * 13))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.substring_dedup(words).collect()} == {1: 0, 2: 0, 3: 13}
    lines = spark.createDataFrame([(1, f"{u}\n{u}\n{v}"), (2, f"{v}\n{v}\n{u}"), (3, f"{u}\n{u}\n{v}")], "doc_id long, text string")
    assert {r.doc_id: r["__corpusloom_n_removed"] for r in linedup.line_dedup(lines).collect()} == {1: 0, 2: 0, 3: 3}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(words).collect()} == {1: 1, 2: 2, 3: 1}


def test_sketches_merge_over_groups(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdef", k=60))) for i in range(300)]
    rows += [(i + 300, t) for i, t in rows[:100]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    plain = sorted(map(tuple, substring.substring_dedup(df).collect()))
    monkeypatch.setattr(substring, "GROUP_CHARS", 500)
    monkeypatch.setattr(substring, "FAN", 3)
    monkeypatch.setattr(substring, "FLUSH", 100)
    assert sorted(map(tuple, substring.substring_dedup(df).collect())) == plain


def test_repeats_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    other = " ".join(f"x{i}" for i in range(20))
    rows = [(None, text), (5, text), (5, text), (5, other), (3, other), (9, text), (None, None), (7, ""), (8, None)]
    df = clashing(spark, rows)
    cut = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed) for r in substring.substring_dedup(df).collect())
    assert cut == [(-1, 0, 0), (-1, 20, 0), (3, 20, 0), (5, 20, 0), (5, 20, 0), (5, 20, 20), (7, 0, 0), (8, 0, 0), (9, 20, 20)]
    near = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    assert near == sorted([("None", 16, "None", True), ("None", 0, "None", True), ("5", 16, "5", True), ("5", 16, "5", True), ("5", 16, "3", False), ("3", 16, "3", True), ("9", 16, "5", False), ("7", 0, "7", True), ("8", 0, "8", True)])
    stay = minhash.without_near_duplicates(df)
    assert stay.columns == df.columns
    assert sorted((repr(r.doc_id), r.text or "") for r in stay.collect()) == sorted([("None", text), ("None", ""), ("5", text), ("3", other), ("7", ""), ("8", "")])
    assert minhash.without_near_duplicates(df.limit(0)).count() == 0
    lines = clashing(spark, [(None, "a\nb\nc"), (2, "a\nb\nc"), (2, "a\nb\nc"), (4, "z\na\nb\nc"), (None, None), (6, None), (7, "a\nb")])
    got = sorted((repr(r.doc_id), r.text or "-", r.h, r["__corpusloom_n_lines"]) for r in linedup.line_dedup(lines).collect())
    assert got == sorted([("None", "a\nb\nc", 1, 3), ("2", "a\nb\nc", 1, 3), ("2", "a\nb\nc", 1, 3), ("4", "z", 1, 4), ("None", "-", 1, 0), ("6", "-", 1, 0), ("7", "a\nb", 1, 2)])


def test_near_duplicate_texts_of_one_id_are_both_judged(spark):
    base = [f"w{i}" for i in range(60)]
    close = " ".join([*base[:59], "y"])
    df = spark.createDataFrame([(4, close), (4, " ".join(base)), (4, " ".join(base)), (6, close)], "doc_id long, text string")
    kept = minhash.without_near_duplicates(df).collect()
    assert len(kept) == 1 and kept[0].doc_id == 4


def test_mixing_repeated_ids_and_nulls(spark):
    rows = [(1, "a b c d", "s"), (1, "a b c d", "s"), (None, "x y", None), (None, None, None), (2, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.with_taken(df).collect()
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + r["__corpusloom_taken"]
        assert 0 <= r["__corpusloom_taken"] <= 2 * r["__corpusloom_size"]
    assert by["s"] == pytest.approx(next(r["__corpusloom_target"] for r in got if r.source == "s"), abs=2) and by["t"] == 0


def test_secrets_against_plain_scans(spark):
    rng = random.Random(1)
    pieces = ["password", "API_KEY", "apikey", "toKen", "secret", '"', "'", " ", ":", "=", "  ", "abc123", "Zz+/=._-9", "AKIA", "A1" * 9, "0a" * 13, "é", "\n", "x", "\t"]

    def run_of(text, at, letters):
        end = at
        while end < len(text) and text[end] in letters:
            end += 1
        return end

    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def assigns(text):
        out, at = [], 0
        while at < len(text):
            found = next((n for n in ("password", "passwd", "secret", "token", "apikey", "api_key") if text[at : at + len(n)].lower() == n and text[at : at + len(n)].isascii()), None)
            ends = []
            if found:
                i = at + len(found)
                for quote in (1, 0):
                    j = i + quote if quote and text[i : i + 1] in ("'", '"') and text[i : i + 1] else i
                    k = run_of(text, j, " ")
                    if text[k : k + 1] in (":", "=") and text[k : k + 1]:
                        k = run_of(text, k + 1, " ")
                        for q in (1, 0):
                            m = k + 1 if q and text[k : k + 1] in ("'", '"') and text[k : k + 1] else k
                            e = run_of(text, m, value)
                            if e > m:
                                ends.append((m, e))
            if ends:
                m, e = ends[0]
                out += [(at, 0, e)] if e - m >= 6 else []
                at = e
            else:
                at += 1
        return out

    def runs(text, kind, head, letters, least):
        out, at = [], 0
        while at < len(text):
            end = run_of(text, at + len(head), letters) if text.startswith(head, at) else at
            if end > at + len(head) or (not head and end > at):
                out += [(at, kind, end)] if end - at >= least else []
                at = end
            else:
                at += 1
        return out

    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        want = sorted(assigns(text) + runs(text, 1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20) + runs(text, 2, "", set("0123456789abcdef"), 24))
        base, every = secrets.scan(text)
        assert base == want, text
        assert set(base) <= set(every) and every == sorted(every)


def literals(text):
    return [text[a:b] for a, _, b in secrets.literal_spans(text)]


def test_lexer():
    assert literals('token = PREFIX + "abcDEF123456"') == ["abcDEF123456"]
    assert literals('P = "sk_live_"\ntoken = P + "abcDEF123456"') == ["sk_live_", "abcDEF123456"]
    assert literals("x = 'abc'\ny = x + 'DEF123!'\nclient_secret = y") == ["abc", "DEF123!"]
    assert literals('password = """correct horse\nbattery staple"""') == ["correct horse\nbattery staple"]
    assert literals('secret = "two words of prose"') == [] == literals("password=changeme") == literals('token = os.getenv("X")') == literals('if token == "abc123DEF": pass')
    assert literals('a = secret = "qwErty987!"') == ["qwErty987!"] and literals('api_key: str = "Zx81Kq72Lm"') == ["Zx81Kq72Lm"]
    assert literals('{"api_key": "Zx81Kq72Lm", "name": "Zx81Kq72Ln"}') == ["Zx81Kq72Lm"] and literals("a.b.c.d.e.f.g.h.password = 'Zx81Kq72Lm'") == ["Zx81Kq72Lm"]
    chain = 'n0 = "abcdeF1"\n' + "".join(f'token{i} = "abcdeF" + {"n0" if i == 1 else f"token{i - 1}"}\n' for i in range(1, 120_000))
    began = time.perf_counter()
    assert len(literals(chain)) == 120_000 and len(chain) > 4_000_000
    assert time.perf_counter() - began < 60
    began = time.perf_counter()
    assert literals('a = "abcdeF1"\n' + "a = a + a\n" * 50_000 + "token = a") == ["abcdeF1"]
    for bad in ("a" * 10**6, "a = " * 10**5, "a='''" * 10**5, "a=(" * 10**5, "a" + " " * 10**6, '"' * 10**6):
        secrets.scan(bad)
    assert time.perf_counter() - began < 60


def test_secret_rows(spark):
    df = clashing(spark, [(1, "password=abc123"), (1, "password=abc123"), (None, None), (2, "")])
    got = sorted((repr(r.doc_id), r.n_assign, r.spans) for r in secrets.secret_scan(df).collect())
    assert got == [("1", 1, "assign:0:15,literal:9:15")] * 2 + [("2", 0, ""), ("None", 0, "")]
    assert secrets.secret_scan(df.limit(0)).count() == 0


def test_bpe_rows_and_odd_letters(spark):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    odd = ["᫄", "፞", "᳭", "̲", "Ɤ", "\U00010d50", "࢘", "a", "E", " ", "İ", "Σ", "́", "가", "ᆨ"]
    texts = ["".join(rng.choices(odd, k=12)) for _ in range(200)] + ["same", "same"]
    df = clashing(spark, [*enumerate(texts), (None, None)])
    got = {(r.doc_id): bytes(r.ids) for r in bpe.encoded(df, path).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert got[i] == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), ascii(t)
    assert bpe.encoded(df.limit(0), path).count() == 0


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_toxicity_against_brute_force():
    terms = [("idiot", False, 0.9), ("blorg", True, 0.95), ("moron", False, 0.8), ("scum", False, 0.7), ("blorgon", False, 0.85)]
    model = toxicity.Model(terms)
    rng = random.Random(3)

    def plain(text):
        low = text.lower()
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+|[@$]+", low)]
        words, merged = [m.span() for m in re.finditer(r"(?:[^\W_]|[@$])+", low)], []
        exact, fuzzy, total = 0.0, 0.0, 0.0
        for k, (s, e) in enumerate(words):
            word = low[s:e].translate(toxicity.LEET)
            options = []
            for t, (term, stem, _) in enumerate(terms):
                if (stem and word.startswith(term)) or (not stem and word == term):
                    options.append((0, t))
                elif not stem and len(term) >= toxicity.FUZZY_LENGTH and distance_at_most_one(word, term):
                    options.append((1, t))
            if not options:
                continue
            edits, t = min(options)
            near = set(low[words[max(0, k - 6)][0] : words[min(len(words), k + 7) - 1][1]].split())
            quoted = any(ord(c) in toxicity.QUOTES for c in low[max(0, s - 2) : s]) and any(ord(c) in toxicity.QUOTES for c in low[e : e + 2])
            value = terms[t][2] * (0.45 if quoted else 1) * (0.7 if near & toxicity.REPORTING else 1) * (1.2 if near & toxicity.ADDRESS else 1)
            exact, fuzzy, total = (exact, max(fuzzy, value), total) if edits else (max(exact, value), fuzzy, total + value)
        x = np.array([1, exact, fuzzy, math.log1p(total)])
        return 1 / (1 + math.exp(-float((x * model.coefficients).sum())))

    vocab = ["idiot", "idi0t", "idot", "idiiot", "ixiot", "idioc", "blorgonaut", "bl0rg", "blrgon", "m0ron", "mroon", "scum", "scam", "said", "you", '"idiot"', "“scum”", "word", "w", "a_idiot", "@$", "IDIOT", "é", "idiots"]
    texts = [rng.choice([" ", "\n", ", "]).join(rng.choices(vocab, k=rng.randrange(0, 12))) for _ in range(600)]
    assert model.score(texts) == pytest.approx([plain(t) for t in texts], abs=1e-12)


def test_toxicity_rows(spark):
    model = toxicity.Model([("idiot", False, 0.9)])
    df = clashing(spark, [(1, "you idiot"), (1, "you idiot"), (None, "idiot"), (2, None), (3, "")])
    got = toxicity.toxicity(df, model)
    rows = {(r.doc_id, r.text): (r.score, r["__corpusloom_score"]) for r in got.collect()}
    assert len(rows) == 4 and all(own == 0.5 for own, _ in rows.values()) and rows[2, None][1] == rows[3, ""][1]
    assert toxicity.toxicity(df.limit(0), model).count() == 0
    empty = toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert 0 < empty.score(["x"])[0] < empty.score(["you idiot"])[0] <= 1


def test_toxicity_sample_is_bounded_in_characters(spark):
    rows = [(i, "w " * 50) for i in range(60)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    taken = []
    old = toxicity.learn_terms
    try:
        toxicity.learn_terms = lambda texts, y: taken.append(len(texts)) or old(texts, y)
        toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample_chars=1_050)
    finally:
        toxicity.learn_terms = old
    assert taken == [10]


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [0.0, 1.0], "x"), (2, [0.0, 1.0], "x"), (2, [0.0, 1.0], "x"), (None, [1.0, 0.0], "x"), (5, [1.0], "x"), (6, None, "x"), (7, [2.0, 0.01], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = sorted((repr(r.vec_id), r.n_links, repr(r.component_id)) for r in rabitq.embedding_near_duplicates(df).collect())
    assert got == sorted([("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1"), ("2", 2, "1"), ("None", 0, "None"), ("5", 2, "1"), ("6", 0, "6"), ("7", 2, "1")])


def test_codes_rule_out_most_pairs_and_lose_none():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 64))
    x[2000:] = x[:2000] + rng.standard_normal((2000, 64)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits, factor = rabitq.encode(x, rabitq.rotation(64, rabitq.CODE_BITS, 5))
    code = np.packbits(bits, axis=1).view(np.uint64)
    a, b = np.arange(2000), np.arange(2000, 4000)
    true = (x[a] * x[b]).sum(axis=1)
    estimate = rabitq.estimates(code[a], code[b], factor[a], factor[b], rabitq.CODE_BITS)
    assert abs((estimate - true).mean()) < 0.01 and np.abs(estimate - true).max() < 0.2
    far = rabitq.differing(code[a], code[np.roll(b, 7)]) > rabitq.open_bound(0.95, rabitq.CODE_BITS)
    assert far.all()
    assert (rabitq.differing(code[a], code[b])[true >= 0.95] <= rabitq.open_bound(0.95, rabitq.CODE_BITS)).all()


def test_nearest_recall_with_a_beam_far_below_the_shard(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 32)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = hnsw.nearest(df, df.filter("vec_id % 50 = 0"), shard_rows=3000).collect()
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * 600


def test_nearest_edges(spark):
    rows = [(i, [1.0, 0.0], "x") for i in (3, 1, 2, 2)] + [(None, [1.0, 0.0], "x"), (4, [1.0], "x"), (5, [0.0, 1.0], "x"), (6, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.nearest(df, df.filter("vec_id in (2, 6) or vec_id is null"), k=3).collect()]
    assert sorted(got) == [(2, 1, 1, 1.0), (2, 2, 3, 1.0), (2, 3, 4, 1.0)]
    assert hnsw.nearest(df, df.limit(0)).count() == 0


def test_warc_repeats_and_headers(spark):
    df = spark.createDataFrame([(2, "u", "same", "x"), (1, "http://v", "same", "x"), (1, "http://v", "same", "x"), (3, None, None, "x"), (4, None, "", "x")], "page_id long, url string, html string, sha string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3)]
    head = dict(warc.read_archive(warc.write_archive([warc.record(2, "u", b"same", "D", (1, "http://v"))])).__next__()[0])
    first = dict(warc.read_archive(warc.write_archive([warc.record(1, "http://v", b"same", "D", None)])).__next__()[0])
    assert head["WARC-Refers-To"] == first["WARC-Record-ID"] and head["WARC-Refers-To-Target-URI"] == "http://v" and first["Content-Type"].startswith("text/html")


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(6))
    other = " ".join(f"y{i}" for i in range(40))
    rows = [(5, text), (5, other), (3, other), (9, text), (None, text), (None, text), (11, None), (12, ""), (13, "z " * 30_000), (2, "head\n" + text), (2, "head\n" + text)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, "c") for (i, t), s in zip(rows, "abababababa")], "doc_id long, text string, lang string, source string, n_chars int, node string")
    spark.createDataFrame([(5, 0, 0), (3, 1, 1), (11, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    near = sorted((repr(r.doc_id), (r.text or "")[:4]) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect())
    assert near == sorted([("2", "head"), ("3", "y0 y"), ("None", "w0x0"), ("None", "w0x0"), ("11", ""), ("12", ""), ("13", "z z ")])
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            kept = out.collect()
            assert len(kept) == 0 if table is not docs else all(r.node == "c" for r in kept)
            assert all(r.text is None or r.n_chars == len(r.text) for r in kept)
        tokens = corpus_pipeline.encode_tokens(spark, table, str(tmp_path))
        assert tokens.count() == table.count()


def test_pipeline_is_its_stages_one_after_another(spark, tmp_path):
    from corpusloom.session import Table

    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choices(vocab, k=8)) for _ in range(5)]
        lines += ["shared one two", "shared three four", "shared five six"] if i % 6 == 0 else []
        rows.append((i, "\n".join(lines) + (" blorgon" if i % 10 == 1 else "")))
    rows += [(200 + i, t) for i, t in rows[:15]]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("blorgon" in t)) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # By hand: toxic ones go, later shared windows go, copies go.
    left = {i: t for i, t in rows if "blorgon" not in t}
    seen = set()
    for i in sorted(left):
        lines, gone = left[i].split("\n"), set()
        for k in range(len(lines) - 2):
            if tuple(lines[k : k + 3]) in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(tuple(lines[k : k + 3]))
        left[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())(WORD.findall(t.lower())) for i, t in left.items()}
    kept = [i for i in sorted(left) if not any(j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in left)]
    staged = Table(corpus_pipeline.drop_near_copies(spark, Table(corpus_pipeline.drop_repeated_lines(spark, Table(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))).df, "")).df, "")).df
    assert sorted(r.doc_id for r in staged.select("doc_id").collect()) == kept
    taken = {}
    for r in mixing.with_taken(staged).collect():
        size, words = r["__corpusloom_size"], r["__corpusloom_taken"]
        taken[r.doc_id] = [size] * (words // size if size else 0) + ([words % size] if size and words % size else [])
    assert sorted(i for i, _, _ in got) == sorted(i for i, parts in taken.items() for _ in parts)
    assert {i for i, _, _ in got} <= set(kept) and zlib.crc32(b"") == 0 and hashlib.sha256(b"").digest()


def test_own_tables_have_no_side_files_and_their_pages_are_verified(spark):
    from corpusloom.session import Table

    table = Table(spark.range(0, 4000, 1, 4).select("id", F.xxhash64("id").alias("h")))
    folder = Path(table.path.removeprefix("file://").removeprefix("file:"))
    assert [p.name for p in folder.iterdir() if not p.name.startswith("part-")] == []
    assert {(r.id, r.h) for r in table.df.collect()} == {(r.id, r.h) for r in spark.range(4000).select("id", F.xxhash64("id").alias("h")).collect()}
    for part in folder.iterdir():
        raw = bytearray(part.read_bytes())
        raw[len(raw) // 2] ^= 1
        part.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        table.df.collect()


def test_every_query_is_registered_over_whole_tables():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert F.lit(1) is not None
