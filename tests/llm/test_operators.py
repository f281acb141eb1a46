"""Every operator against plain Python on tables with nulls, empty, long and repeated texts and clashing names."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm import contamination, fingerprint, graph, langid, maintext, mixing, pii, queries, simhash, substrings, tokens, urls
from ledgerlens.llm.prefix import PrefixHash
from ledgerlens.session import scratch_path

PARA = "The quick brown fox jumps over the lazy dog while seven wizards boxed daily near Paris. "
ODD_DOCS = [
    (None, "a text without an id, short", "en", "s1"),
    (1, None, "en", "s1"),
    (2, "", "en", "s1"),
    (3, " \t\n ", None, "s2"),
    (4, PARA * 12, "en", "s1"),
    (5, PARA * 12, "en", None),
    (5, PARA * 12, "en", None),
    (6, "x" * 300 + PARA * 9 + "y" * 500, "en", "s2"),
    (7, "der Hund und die Katze " * 40 + "ÄÖÜ ß 123", "de", "s2"),
    (8, "der Hund und die Katze " * 39 + "ÄÖÜ ß 123 mail: a.b+c@ex-am.ple.org", "de", "s3"),
    (9, "12345 67890 !!! ???", "de", "s3"),
    (10, "日本語のテキスト🙂 " * 30, None, "s3"),
    (11, ("word%d " * 3000) % tuple(range(3000)), "en", "s1"),
    (12, "a" * 5000, "en", "s1"),
    (13, "one two", "en", "s4"),
    (14, "Call +49 (30) 1234-5678 or 192.168.0.1 or 300.1.1.1, card 4111 1111 1111 1111.", "en", "s4"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names clash with those the operators add."""
    rows = [(*r, 7, "x", "y", 1.5) for r in ODD_DOCS]
    ddl = "doc_id long, text string, lang string, source string, N_Words long, `a.b` string, lang_pred string, size double"
    return spark.createDataFrame(rows, ddl).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, PARA), (2, "seven wizards boxed"), (2, None), (None, "hund und die katze"), (4, "!!!"), (5, " ".join(f"word{i}" for i in range(100, 140)))]
    return spark.createDataFrame(items, "item_id long, text string")


def empty(df):
    return df.where("false")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1 ------------------------------------------------------------------------------------------------

def plain_grams(text):
    words = "".join(c.lower() if len(c.lower()) == 1 else c for c in (c if c.isalpha() else " " for c in text)).split()
    out = Counter()
    for w in words:
        out.update(w)
    line = " " + " ".join(words) + " "
    if words:
        for n in (2, 3):
            for k in range(len(line) - n + 1):
                gram = line[k : k + n]
                if " " not in gram[1:-1]:
                    out[gram] += 1
    return out


def plain_rank(counts, size=300):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def plain_language(rows, training):
    totals = defaultdict(Counter)
    for text, lang in training:
        if lang is not None and text:
            if grams := plain_grams(text):
                totals[lang] += grams
    profiles = {k: {g: i for i, g in enumerate(plain_rank(totals[k]))} for k in sorted(totals)}
    out = []
    for text in rows:
        mine = plain_rank(plain_grams(text or ""))
        if not mine or not profiles:
            out.append(("und", 0.0))
            continue
        best = min((sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(mine)), k) for k, p in profiles.items())
        out.append((best[1], 1 - best[0] / (300 * len(mine))))
    return out


def test_language_is_that_of_plain_profiles(spark, odd, docs):
    for df in (odd, docs):
        data = [tuple(r) for r in df.select("doc_id", "text", "lang").collect()]
        profiles = langid.learn(df)
        got = rows_of(langid.identify(df, profiles), "doc_id", "text", "lang_pred", "score")
        want = plain_language([t for _, t, _ in data], [(t, lang) for _, t, lang in data])
        want = sorted(((i, t, *w) for (i, t, _), w in zip(data, want, strict=True)), key=repr)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    found = langid.identify(odd, langid.learn(odd))
    assert found.columns == ["doc_id", "text", "lang", "source", "N_Words", "a.b", "size", "lang_pred", "score"]
    assert langid.learn(empty(odd)) == {} and langid.identify(empty(odd), {}).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_language_of_held_out_documents(spark):
    found = queries.op1_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(docs, "doc_id")
    assert held.where("lang = lang_pred").count() > 0.97 * held.count() > 0
    assert {r[0] % 2**32 for r in held.select(F.crc32(F.col("doc_id").cast("string"))).collect() if r[0] % 3 != 1} == set()


# 2 ------------------------------------------------------------------------------------------------

def plain_tokens(rows):
    tk, at, out = Tokenizer.from_file(queries.TOKENIZER), 0, []
    for key, text in rows:
        ids = tk.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_files_round_trip(spark, odd, docs, which):
    df = {"odd": odd, "docs": docs}[which]
    path = tokens.write_tokens(df, scratch_path(spark, "test"), queries.TOKENIZER, shard_tokens=5000)
    got = [tuple(r) for r in tokens.read_tokens(spark, path).orderBy("start").collect()]
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = plain_tokens(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
    assert got == want
    ids = {r["doc_id"]: r["ids"] for r in tokens.read_tokens(spark, path, with_ids=True).collect()}
    shard = spark.read.parquet(f"{path}/shards").orderBy(F.desc("n_tokens")).first()
    grammar = np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2)
    lengths, symbols = np.frombuffer(shard["expansions"], np.uint32), np.frombuffer(shard["symbols"], np.uint32)
    whole = [x for k in shard["doc_ids"] for x in ids[k]]
    assert len(symbols) < len(whole)
    for a, b in ((0, 10), (17, 700), (len(whole) - 5, len(whole)), (3, 3)):
        assert tokens.stretch(grammar, lengths, symbols, a, b).tolist() == whole[a:b]


def test_token_files_of_nothing(spark, odd):
    path = tokens.write_tokens(empty(odd), scratch_path(spark, "test"), queries.TOKENIZER)
    assert tokens.read_tokens(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400))
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.uint32)
    rules, symbols = tokens.compress(ids, rounds=5, rules=3, least=2)
    assert tokens.expand(rules, symbols).tolist() == ids.tolist()
    lengths = tokens.expansions(rules)
    for k, n in enumerate(lengths.tolist()):
        assert len(tokens.expand(rules, np.array([rules[0, 0] + k], np.uint32))) == n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.\n\t\r\x1c\x85\xa0 é1's", max_size=40), max_size=5))
def test_pieces_encode_like_whole_texts(texts):
    encoder = tokens.Encoder(queries.TOKENIZER)
    ids, counts = encoder.encode(texts) if texts else (np.empty(0, np.uint32), np.empty(0, np.int64))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "Bé", "жё", "ß", "ÿ", " word", " ", "\n", "\nWord", ".", ",", "!!", "a!", "é;", "'s", "7", "ª", "世", "\0", "\t", "<|endoftext|>"])).map("".join), max_size=6))
def test_pieces_cut_by_bytes(texts):
    """Slices of Arrow arrays are cut into pieces that make up the texts and encode like them."""
    encoder = tokens.Encoder(queries.TOKENIZER)
    pieces, counts = tokens.cut_all(pa.array(["before", *texts])[1:])
    stops = np.cumsum(counts).tolist()
    assert ["".join(pieces[b - n : b].to_pylist()) for b, n in zip(stops, counts.tolist(), strict=True)] == texts
    ids, sizes = encoder.encode(pa.array(["before", *texts])[1:])
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_many_pieces_are_encoded_once():
    """Half a million different words stay known, so that later texts of a worker find them."""
    letters = "abcdefghijklmnopqrstuvwxyzé"
    words = [f" {a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters]
    texts = ["".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
    encoder = tokens.Encoder(queries.TOKENIZER)
    ids, sizes = encoder.encode(texts)
    known = encoder.count
    again, _ = encoder.encode(texts)
    assert known == encoder.count and np.array_equal(ids, again)
    assert ids[: sizes[0]].tolist() == encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_trim_keeps_the_most_seen(monkeypatch):
    """An encoder with more frequent pieces than it may keep still knows those that are seen most."""
    monkeypatch.setattr(tokens, "KEPT_PIECES", 100)
    words = [f" w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)]
    encoder = tokens.Encoder(queries.TOKENIZER)
    encoder.encode(["".join(words + words[:80] + words[:30])])
    ids, _ = encoder.encode(["".join(words[:30])])
    assert encoder.count == len(encoder.place) == 30
    assert ids.tolist() == encoder.tokenizer.encode("".join(words[:30]), add_special_tokens=False).ids


# 3 ------------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add("" if item is None else str(item))
    out = []
    for key, text in rows:
        w, hit, ids = WORDS.findall((text or "").translate(LOWER)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    ids |= found
        out.append((key, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [contamination.BLOCK_BYTES, 120])
def test_contamination(odd, bench, block):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = contamination.contaminated(odd, bench, block_bytes=block)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "item_ids") == plain_contamination(rows, [tuple(r) for r in bench.collect()])
    assert got.columns == ["doc_id", "text", "lang", "source", "a.b", "lang_pred", "size", "n_words", "n_hit", "item_ids", "spans"]
    for r in got.collect():
        for s in r["spans"]:
            inside = WORDS.findall(r["text"][s["start"] : s["stop"]].translate(LOWER))
            assert inside == WORDS.findall(r["text"].translate(LOWER))[s["first"] : s["last"] + 1]


def test_contamination_of_nothing(odd, bench):
    assert contamination.contaminated(empty(odd), bench).count() == 0
    assert {r["n_hit"] for r in contamination.contaminated(odd, empty(bench)).collect()} == {0}


# 4 ------------------------------------------------------------------------------------------------

def plain_repeats(rows, size=400):
    seen = Counter()
    raws = [(k, (t or "").encode()) for k, t in rows]
    for _, raw in raws:
        seen.update(raw[i : i + size] for i in range(len(raw) - size + 1))
    out = []
    for key, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if seen[raw[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((key, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


OUT4 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def planted_repeats():
    """Texts that share stretches of 100 to 1,500 bytes at random places, near ends and within themselves."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefgh é\n"))
    word = lambda n: "".join(rng.choice(letters, n))
    shared = [word(n) for n in (100, 200, 390, 398, 400, 401, 420, 650, 671, 673, 900, 1500)]
    out = []
    for k in range(60):
        parts = [word(int(rng.integers(0, 600)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(len(shared)))]
            a = int(rng.integers(0, len(s) // 3 + 1)) * int(rng.integers(0, 2))
            parts += [s[a:], word(int(rng.integers(0, 300)))]
        out.append((k, "".join(parts)))
    return out + [(100, out[3][1]), (101, shared[-1] * 3), (101, shared[-1] * 3)]


def test_substrings(spark, odd):
    for rows in (planted_repeats(), [tuple(r) for r in odd.select("doc_id", "text").collect()]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        found = substrings.remove_repeats(df)
        assert rows_of(found, *OUT4) == plain_repeats(rows)
    for r in found.collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["spans"]) == r["n_spans"]


def test_substrings_of_documents(spark, sf, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(queries.op4_substrings(spark, sf), *OUT4) == plain_repeats(rows)
    assert substrings.remove_repeats(empty(docs)).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    raw = np.frombuffer("".join(t for _, t in planted_repeats()).encode(), np.uint8)
    whole = substrings._samples(raw, 400)
    monkeypatch.setattr(substrings, "PIECE", 1000)
    for a, b in zip(whole, substrings._samples(raw, 400), strict=True):
        assert sorted(a.tolist()) == sorted(b.tolist())


def test_difference_cover():
    cover = substrings.difference_cover()
    assert {(a - b) % 273 for a in cover.tolist() for b in cover.tolist()} == set(range(273)) and len(cover) == 17


# 5 ------------------------------------------------------------------------------------------------

def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(sizes.values())
    full = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in full}
        full |= over


@pytest.mark.parametrize("slices", [mixing.SLICE_ROWS, 4])
def test_mix(odd, docs, slices):
    for df, near in ((odd, None), (docs, 0.35)):
        got = mixing.mix(df, slice_rows=slices).collect()
        for r in got:
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["taken_copies"] <= 3
        sizes = Counter()
        for r in got:
            sizes[r["source"]] += r["size"]
        want = plain_targets(sizes)
        assert {r["source"]: r["target"] for r in got} == pytest.approx(want)
        for s in want if near else ():
            taken = sum(r["size"] * r["taken_copies"] for r in got if r["source"] == s)
            largest = max(r["size"] for r in got if r["source"] == s)
            assert abs(taken - want[s]) <= max(near * want[s], 2 * largest)
        again = mixing.mix(df.repartition(7), slice_rows=slices)
        assert rows_of(again, "doc_id", "source", "size", "taken_copies") == sorted(
            ((r["doc_id"], r["source"], r["size"], r["taken_copies"]) for r in got), key=repr
        )
    assert mixing.mix(empty(odd)).count() == 0 and mixing.mixed(empty(odd)).count() == 0


def test_mixed_rows(odd):
    times = Counter()
    for r in mixing.mix(odd).collect():
        times[r["doc_id"], r["text"]] += r["taken_copies"]
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns
    assert Counter((r["doc_id"], r["text"]) for r in rows.collect()) == +times


def test_mix_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 6 ------------------------------------------------------------------------------------------------

def test_grammar_leaves_no_frequent_pair():
    """A passage in thousands of copies becomes one symbol; no pair that stands often enough is left."""
    rng = np.random.default_rng(6)
    passage = rng.permutation(np.arange(1, 501))
    for high in (1000, 65_000, 70_000):
        shard = np.concatenate([np.concatenate([passage, rng.integers(600, high, 5), [0]]) for _ in range(1000)]).astype(np.uint32)
        rules, left = tokens.compress(shard)
        assert np.array_equal(tokens.expand(rules, left), shard) and len(left) <= 8 * 1000
        pairs = Counter(p for p in zip(left[:-1].tolist(), left[1:].tolist()) if 0 not in p)
        assert max(pairs.values(), default=0) < tokens.LEAST


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcé", min_size=1, max_size=60), st.text(alphabet="abcé", min_size=1, max_size=60), st.data())
def test_prefix_hashes(a, b, data):
    x, y = PrefixHash(fingerprint.points(a)), PrefixHash(fingerprint.points(b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    k = 0
    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    assert x.extension(i, y, j) == k
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert x.same(i, y, j, n) == (a[i : i + n] == b[j : j + n])


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_fingerprints(odd, docs, which):
    df = {"odd": odd, "docs": docs}[which]
    if which == "odd":
        df = df.dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for k, (key, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        want.append((key, len(text), hashlib.sha256(new.encode()).hexdigest()))
    found = fingerprint.compare_with_next(df)
    assert rows_of(found, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)
    texts, out = dict(rows), found.collect()
    prints = {}
    for r in out:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        again = fingerprint.likeness(fingerprint.sketch_of(r["fingerprint"]), fingerprint.sketch_of(r["edited_fingerprint"]))
        assert again == pytest.approx(r["near_edited"])
    assert len(set(prints.values())) == len(prints)
    long = [r["near_edited"] for r in out if r["n_chars"] > 400 and len(set(texts[r["doc_id"]])) > 10]
    assert 0.5 < float(np.median(long)) < 0.85


def test_short_texts_keep_their_likeness():
    """Against the exact share of spans for texts of every short length; the edit leaves two thirds."""
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    for n in range(9, 200):
        text, after = letters(n), letters(n // 2 if n % 2 else 3)
        new = fingerprint.edited(text, after)
        kind = 16 if min(n, len(new)) >= 64 else 4
        a, b = ({t[k : k + kind] for k in range(len(t) - kind + 1)} for t in (text, new))
        got = fingerprint.Fingerprint(text).likeness(fingerprint.Fingerprint(new))
        assert got == pytest.approx(2 * len(a & b) / (len(a) + len(b)), abs=0.2 if len(a | b) > 64 else 1e-9) and got > 0.3, n
        assert fingerprint.Fingerprint(text).likeness(fingerprint.Fingerprint(text)) == 1
        assert fingerprint.Fingerprint(text).likeness(fingerprint.Fingerprint(letters(n))) < 0.2


def test_fingerprints_of_few_rows(spark, odd):
    assert fingerprint.compare_with_next(empty(odd)).count() == 0
    one = fingerprint.compare_with_next(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert fingerprint.compare_with_next(odd).count() == odd.count()


# 7 ------------------------------------------------------------------------------------------------

def test_urls(spark):
    given = [
        ("https://www.Example.com/en/1?x=1#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/2", "a.example.com", "/en/2", "example.com/en/", "block"),
        ("http://example.com/de/2", "example.com", "/de/2", "com/", "allow"),
        ("http://notexample.com/en/2", "notexample.com", "/en/2", "com/", "allow"),
        ("ftp://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("ftp://x.net/es", "x.net", "/es", None, "block"),  # by its template, which it shares with the url above
        ("http://com?x=/en/", "com", "", None, "allow"),
        ("http://x.org/a?u=http://y.com/en/", "x.org", "/a", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "z") for i, u in enumerate(given)] * 2, "page_id long, url string, Host string")
    got = urls.judge(df, queries.RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "template", "purity", "verdict"]
    want = [(i, *u[1:]) for i, u in enumerate(given)] * 2
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert urls.judge(empty(df), queries.RULES).count() == 0
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_url_templates_reject_by_purity(spark):
    rows = [(f"http://h.org/{part}/{k}.html", bad) for part, bad, n in (("spam", True, 30), ("news", False, 30), ("spam", None, 10), ("news", None, 10), ("new", None, 10)) for k in range(n)]
    got = urls.judge(spark.createDataFrame(rows, "url string, bad boolean"), [], label="bad")
    assert {(r["path"].split("/")[1], r["verdict"]) for r in got.collect()} == {("spam", "block"), ("news", "allow"), ("new", "allow")}
    assert {r["template"] for r in got.collect()} == {"/spam/*", "/news/*", "/new/*"}


def test_alike_branches_are_merged(spark):
    rows = [(f"http://h.org/{part}/{k}", k % 4 > 0) for part in ("a", "b", "c") for k in range(40)] + [(f"http://h.org/d/{k}", None) for k in range(9)]
    got = urls.judge(spark.createDataFrame(rows, "url string, bad boolean"), [], label="bad").collect()
    assert {(r["path"].split("/")[1], r["template"]) for r in got} == {("a", "/*/*"), ("b", "/*/*"), ("c", "/*/*"), ("d", "/d/*")}


# 8 ------------------------------------------------------------------------------------------------

def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, distance=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_near_duplicates(odd, docs, which):
    df = {"odd": odd, "docs": docs}[which]
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    prints = [plain_simhash(t) for _, t in rows]
    classes = plain_classes(prints)
    first = {c: min((rows[i][0] for i in range(len(rows)) if classes[i] == c and rows[i][0] is not None), default=None) for c in classes}
    want = sorted(((k, f"{p:016x}", first[c]) for (k, _), p, c in zip(rows, prints, classes, strict=True)), key=repr)
    found = simhash.near_duplicates(df)
    assert rows_of(found.withColumn("f", F.lower(F.lpad(F.hex("simhash"), 16, "0"))), "doc_id", "f", "component_id") == want
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(set(classes))
    clash = df.withColumnRenamed("source", "SimHash")
    assert simhash.first_of_each(clash).columns == clash.columns
    assert rows_of(kept, "doc_id") == sorted(((first[c],) for c in set(classes)), key=repr)


def test_near_duplicates_of_nothing(odd):
    assert simhash.near_duplicates(empty(odd)).count() == 0 and simhash.first_of_each(empty(odd)).count() == 0


def test_count_filter_rejects_pairs_of_a_list_but_none_within_the_distance():
    rng = np.random.default_rng(8)
    one_list = rng.integers(0, 2**40, 2000, dtype=np.uint64)  # three bytes agree
    one_list[1::2] = one_list[::2] ^ (np.uint64(1) << rng.integers(0, 40, 1000).astype(np.uint64))
    x = one_list[:-1] ^ one_list[1:]
    stays = simhash.enough_matches(x, 4)
    assert 0 < stays.sum() < len(x) // 2 + 20 and stays[np.bitwise_count(x) <= 4].all()


@pytest.mark.parametrize("key_bytes, long_list", [(2, 4096), (3, 4096), (4, 4096), (2, 12), (3, 1)])
def test_links_connect_dense_and_random_fingerprints(spark, key_bytes, long_list):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = set()
    for c in centres.tolist():
        for _ in range(40):
            v = c
            for b in rng.integers(0, 64, int(rng.integers(0, 9))).tolist():
                v ^= 1 << b
            prints.add(v)
    prints = sorted(prints)
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), key_bytes=key_bytes, long_list=long_list)
    roots = {r["node"]: r["root"] for r in graph.components(links).collect()}
    for r in links.collect():
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4
    classes = plain_classes(prints)
    got = {}
    for v, c in zip(signed, classes, strict=True):
        assert got.setdefault(c, roots.get(v, v)) == roots.get(v, v)
    assert len(set(got.values())) == len(got)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1000), (2000, 1999)], "a long, b long")
    got = {(r["node"], r["root"]) for r in graph.components(chain).collect()}
    assert got == {(i, 0) for i in range(301)} | {(1999, 1999), (2000, 1999)}


# 9 ------------------------------------------------------------------------------------------------

def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a.@-1 +9", max_size=50), st.text(alphabet="0123456789. -+()", max_size=60), st.text(max_size=30)))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_pii(text)


@pytest.mark.parametrize("block", [pii.BLOCK_TERMS, 1])
def test_disclosing_terms(spark, odd, block):
    rng = np.random.default_rng(2)
    common = ["river", "house", "green", "people", "story", "number", "letter", "paper"]
    say = lambda n: " ".join(rng.choice(common, n))
    rows = [(k, f"{say(6)} Zanzibar {say(3)} anna@mail.org {say(8)} ") for k in range(12)]
    rows += [(k, f"{say(4)} Quorum {say(2)} bob{k}@mail.org {say(5)}") for k in range(12, 20)]
    rows += [(k, say(20)) for k in range(20, 200)] + [(200, "about Zanzibar alone"), (201, None), (202, "")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, N_Email int, `a.b` string")
    terms = pii.disclosing_terms(df, block_terms=block)
    assert [(r["term"], r["action"]) for r in terms.collect()] == [("zanzibar", "remove")]
    got = {r["doc_id"]: r for r in pii.sanitise(df, terms=terms.union(terms.withColumn("term", F.lit("quorum"))), block_terms=block).collect()}
    assert got[200]["spans"] == "term:6:14" and got[200]["clean_text"] == "about  alone" and got[200]["n_email"] == 0
    at = rows[3][1].index("Zanzibar")
    assert f"term:{at}:{at + 8}" in got[3]["spans"] and "[EMAIL]" in got[3]["clean_text"] and got[3]["n_email"] == 1
    assert got[201]["spans"] == got[202]["spans"] == "" and "term:" in got[15]["spans"]
    assert pii.sanitise(empty(df)).count() == 0
    for r in pii.sanitise(odd).collect():
        assert r["base_spans"] == pii.digest_text(plain_pii(r["text"] or ""))


def test_copies_of_a_passage_reveal_nothing(spark):
    df = spark.createDataFrame([(k, "some Unique words near eve@mail.org in one passage") for k in range(9)] + [(k, "other words") for k in range(9, 40)], "doc_id long, text string")
    assert pii.disclosing_terms(df).count() == 0


@pytest.mark.parametrize("block", [pii.BLOCK_TERMS, 100])
def test_terms_near_rare_entities(spark, block):
    """Entities mentioned once or twice, against the estimate in plain Python; copies are no more than one mention."""
    rng = np.random.default_rng(5)
    common = ["river", "house", "green", "people", "story", "number", "letter", "paper"]
    say = lambda n: " ".join(rng.choice(common, n))
    twice = [f"{say(2)} Kinshasa {say(3)} eve@mail.org {say(4)}" for _ in range(2)]
    texts = [*twice, f"{say(3)} Timbuktu {say(2)} +49 30 1234 5678 {say(3)}", *[f"{say(3)} Xanadu {say(2)} 10.0.0.1 {say(3)}"] * 6]
    texts += [say(12) for _ in range(1500)]
    contexts, n_te, n_e = defaultdict(set), Counter(), Counter()
    for text in texts:
        for a, _, b in plain_pii(text):
            words = re.findall(r"[^\W\d_]{4,}", text[:a].lower())[-8:] + re.findall(r"[^\W\d_]{4,}", text[b:].lower())[:8]
            n_e[text[a:b]] += 1
            for w in set(words):
                contexts[text[a:b], w].add(" ".join(words))
                n_te[text[a:b], w] += 1
    sizes = Counter(map(len, contexts.values()))
    d, want = sizes[1] / (sizes[1] + 2 * sizes[2]), {}
    for (e, w), c in contexts.items():
        n_t = sum(w in t.lower().split() for t in texts)
        value = np.log2((1 - d / len(c)) * n_te[e, w] * len(texts) / (n_t * n_e[e])) / np.log2(len(texts) / n_e[e])
        if value >= 0.5:
            want[w] = max(value, want.get(w, 0))
    got = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string"), block_terms=block).collect()}
    assert got == pytest.approx(want) and set(got) == {"kinshasa", "timbuktu", "xanadu"}
    assert got["kinshasa"] > got["timbuktu"] > got["xanadu"]


# 10 -----------------------------------------------------------------------------------------------

PAGES = {
    "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a>Menu</a></nav>"
    "<div class='ad'>Buy this now, a long advert text that goes on and on.</div><article><h1>Title &amp; more</h1><p>First\n  block"
    " with <b>bold</b>&nbsp;text<br>next.<p>So.</p><div class='comments'>Nice!</div></article><footer>&copy; x</footer></body></html>":
        "Title & more\nFirst block with bold text next.\nSo.",
    "<div id=sidebar>links links</div><div class=story><p>The story has many words and no menu at all in it.</p><p>Short.</p>"
    "<form><input><label>Mail</label></form></div><div class='cookie-notice'>We use cookies.</div>":
        "The story has many words and no menu at all in it.\nShort.",
    "": "",
    "<nav>only a menu</nav>": "",
    "plain words": "plain words",
    "<p>unclosed <b>tags": "unclosed tags",
    "<body><main><header><h1>Head</h1></header><section>A longer paragraph of main text here.</section></main><aside>x</aside></body>":
        "Head\nA longer paragraph of main text here.",
}


def test_main_text(spark):
    rows = [(k, "u", h) for k, h in enumerate([*PAGES, None])] * 2
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, TEXT string")
    got = maintext.extract(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    want = [(k, t, len(t)) for k, t in enumerate([*PAGES.values(), ""])] * 2
    assert rows_of(got, "page_id", "text", "n_chars") == sorted(want, key=repr)
    assert maintext.extract(empty(df)).count() == 0


def _told(name, n):
    return " ".join(f"{name} tells what happened on day {k} of the long journey." for k in range(n))


PARTS = [_told(name, 18) for name in ("Ann", "Bob", "Eve", "Max", "Kim", "Zoe")]
BODY, LAST = "".join(f"<p>{x}</p>" for x in PARTS[:5]), f"<p>{PARTS[5]}</p>"
MENU = "<p><a>More</a></p><p><a>Next</a></p><p><b><a>Day</a></b></p>"


@pytest.mark.parametrize("page, want", [
    pytest.param(f"<body><div class=story>{BODY * 4}</div><article>{LAST * 4}</article></body>", PARTS[:5] * 4, id="teaser article"),
    pytest.param(f"<body><p>Top</p><main><div>{BODY}</div><article>{LAST}</article></main></body>", PARTS, id="teaser article in main"),
    pytest.param(f"<body><p>Top</p><section><article>{BODY}</article><article>{LAST}</article></section></body>", PARTS, id="small last article"),
    pytest.param(f"<body><p>Top</p><section><article>{BODY[: len(BODY) // 5]}</article><article>{LAST}</article></section></body>", [PARTS[0], PARTS[5]], id="two articles"),
    pytest.param(f"<body><section><article>{BODY}{LAST}</article>{f'<article>{MENU}</article>' * 9}</section></body>", PARTS, id="cards of links"),
    pytest.param(f"<body><p>Top</p><article>{BODY}<article>{LAST}</article></article></body>", PARTS, id="nested articles"),
    pytest.param(f"<body><div>{MENU}</div><div>{BODY}{LAST}</div><div>{MENU}</div></body>", PARTS, id="no article"),
])
def test_main_text_without_a_single_article(page, want):
    assert maintext.main_text(page) == "\n".join(want)


def test_main_text_of_pages(spark, sf):
    """The pages' articles as a regular expression finds them."""
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op10_maintext(spark, sf).collect():
        body = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|table|tr|td|blockquote|pre)\b[^>]*>", body)
        import html as h

        plain = [" ".join(h.unescape(re.sub(r"<br\s*/?>", " ", b)).split()) if "<" not in re.sub(r"</?(b|i|em|strong|a|br|span|code|u)\b[^>]*>", "", b) else None for b in blocks]
        if None not in plain:
            plain = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
            assert r["text"] == "\n".join(x for x in plain if x)
    page = maintext.main_text("<p>" + "long words in a line " * 50000 + "</p>")
    assert len(page) == 21 * 50000 - 1


# pipeline -----------------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), None
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = docs.union(spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34 !", "en", "s", 7)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "test")
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "token_files":
            assert after.schema == docs.schema
            kept = sorted(r["doc_id"] for r in after.select("doc_id").collect())
        if name == "language":
            assert kept == sorted(k for k, t in before if any(c.isalpha() for c in t or ""))
        elif name == "near_duplicates":
            classes = plain_classes([plain_simhash(t) for _, t in before])
            first = {}
            for (k, _), c in zip(before, classes, strict=True):
                first[c] = min(k, first.get(c, k))
            assert kept == sorted(first.values())
        elif name == "decontamination":
            found = plain_contamination(before, bench)
            assert kept == sorted(k for k, n, hit, _ in found if not (hit and 20 * hit >= n)) and len(kept) < len(before)
        elif name == "mixing":
            times = Counter({r["doc_id"]: r["taken_copies"] for r in mixing.mix(docs).collect()})
            assert Counter(kept) == +times and max(times.values()) > 1
        else:
            rows = sorted(before, key=lambda r: (r[0], r[1]))
            assert [tuple(r) for r in after.orderBy("start").collect()] == plain_tokens(rows)
        docs = after
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
