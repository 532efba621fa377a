"""The ten operators against brute force on small tables with nulls, ties, repeats, long and empty texts."""

import base64
import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oddlight.llm import decontamination, exact_dedup, language_id, lm_scoring, near_dedup, packing, sharding, textbytes, token_orc, tokens, toxicity, warc
from oddlight.llm.shared import work_path

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, kept string, row string"


def frame(spark, rows):
    """Extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA)


def prose(seed, n, vocabulary=60):
    rng = random.Random(seed)
    return " ".join(rng.choice([f"w{i}" for i in range(vocabulary)]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base = [prose(s, 80, 400) for s in range(12)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t))
        words = t.split()
        for c in range(6):
            copy = list(words)
            for _ in range(c):
                copy[(7 * c + 13 * _ + i) % len(copy)] = f"new{c}{_}"
            rows.append((100 + 10 * i + c, " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE  two"), (None, base[0]), (5, base[5]), (1005, "x" * 5000 + " " + prose(99, 3000, 5000))]
    return rows


# ---- near duplicates ---------------------------------------------------------------------------------------------


def brute_components(rows, k):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    best = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return Counter((rows[i][0], len(sets[i]), best[root(i)]) for i in range(len(rows)))


def test_near_duplicates(spark, corpus):
    got = near_dedup.near_duplicates(frame(spark, corpus), shingle=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(corpus, 4)
    assert sum(r["first_row"] for r in got) == len({r["component_id"] if r["n_shingles"] else ("empty", r["row"]) for r in got})


def test_large_bucket_in_blocks(spark, monkeypatch):
    """More near copies than a block holds, in chains: blocks and the last round lose no link."""
    words = prose(3, 120, 1000).split()
    rows = [(i, " ".join(words[i % 40 : i % 40 + 70] + [f"own{i}"])) for i in range(200)]
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = near_dedup.near_duplicates(frame(spark, rows), shingle=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 4)


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(200):
        x = rng.integers(0, 2**63, 500, dtype=np.uint64)
        y = np.concatenate([x[:450], rng.integers(0, 2**63, 50, dtype=np.uint64)])
        a, b = (near_dedup.odd_sketch(near_dedup.min_hashes(np.unique(v))) for v in (x, y))
        errors.append(near_dedup.sketch_similarity(np.bitwise_count(a ^ b).sum()) - 450 / 550)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, []), shingle=5).count() == 0
    assert near_dedup.near_duplicates(frame(spark, [(1, None)])).first()["component_id"] == 1


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "a b c d", "a b c d e f", ""])
def test_shingles_of_one_short_text(text):
    n = len(text.split())
    assert len(near_dedup.shingle_sets(pa.array([text]), 5)[0]) == (0 if n == 0 else max(n - 4, 1))


def test_word_hashes_follow_words(monkeypatch):
    texts = ["A b\tc", None, "", "é A\x0bÉ", "x" * 3000 + " y", " lead trail "]
    monkeypatch.setattr(textbytes, "SLICE", 64)
    h, at = textbytes.hashed_words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        assert at[i + 1] - at[i] == len(words)
        for w, v in zip(words, h[at[i] : at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)


# ---- exact duplicates --------------------------------------------------------------------------------------------


def test_exact_dedup(spark, corpus):
    rows = [*corpus, (2000, "a b"), (2001, "ab"), (2002, "a  b"), (2003, "a \n b")]
    key = lambda t: hashlib.sha256((t or "").encode().translate(None, b" \t\n\x0b\x0c\r")).hexdigest()
    groups = defaultdict(list)
    for i, t in rows:
        groups[key(t)].append((-len(t or ""), i is None, i or 0, i))
    want = Counter((i, min(groups[key(t)])[3], len(groups[key(t)]), key(t)) for i, t in rows)
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_against_history(spark):
    history, docs = frame(spark, [(1, "old text"), (2, "oldtext")]), frame(spark, [(10, "old  text"), (11, "new"), (12, "n ew"), (13, None)])
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in exact_dedup.exact_dedup(docs, history).collect()}
    assert got == {10: (1, False, 2), 11: (12, False, 2), 12: (12, True, 2), 13: (13, True, 1)}


def test_perfect_hash_is_minimal_and_byte_checked():
    raw = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    keys = raw.view("<u8")[:, :2]
    mph = exact_dedup.PerfectHash.build(keys[:4000])
    assert sorted(mph.slots(keys[:4000]).tolist()) == list(range(4000))
    assert (mph.slots(keys[4000:]) < 4000).all()  # some slot or none: the digest decides
    assert exact_dedup.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


# ---- tokens, packing, token files --------------------------------------------------------------------------------

ODD = ["", None, " ", "  a", "a  b", "a b ", "don't stop. A b c", "\n\n a \n\tb\t c\n", "a\xa0 \xa0b", "é. à! b|", "l'été d'or. 'tis", "x\x1cy z", "İI. ΣΑΣ.", "1234. 5,6", "<|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|>", "<|STARTOFTEXT|> y. <|startoftext|>", "<|endoftext <||"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("size", [1 << 18, 64])
def test_unit_tokens_equal_whole_texts(monkeypatch, name, size):
    monkeypatch.setattr(tokens, "SLICE", size)
    rng = random.Random(4)
    texts = [*ODD, prose(1, 500), *("".join(rng.choice("ab Z.,' \n\t1é|!?s’ ") for _ in range(rng.randint(0, 50))) for _ in range(500))]
    for plain in (False, True):
        model = Tokenizer.from_file(public_tokenizers.path(name))
        if plain:
            model.encode_special_tokens = True
        ids, at = tokens.UnitEncoder(public_tokenizers.path(name), plain).encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == model.encode(t or "", add_special_tokens=False).ids, t


def test_full_unit_table_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE", 1 << 10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, model = tokens.UnitEncoder(path), Tokenizer.from_file(path)
    for s in range(8):
        t = prose(s, 300, 10**6)
        assert e.encode(pa.array([t]))[0].tolist() == model.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(spark, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    model, corpus = Tokenizer.from_file(path), [*corpus, (701, "a <|endoftext|> b")]
    got = packing.pack(frame(spark, corpus), path, longest=64).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0 and 4 * r["length"] == len(r["ids"]) for r in got)
    docs = defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
    for i, t in corpus:
        if i in (5, None):
            continue  # repeated below
        pieces = sorted(docs[i], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4").tolist()
        assert ids == [*model.encode(t or "", add_special_tokens=False).ids, 2] and pieces[0]["doc_tokens"] == len(ids)
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces[:-1]]]).tolist()
    assert sum(r["start"] == 0 for r in got) == len(corpus)
    assert packing.pack(frame(spark, []), path).count() == 0
    assert packing.binary_pieces(8192 + 13, 4096) == [4096, 4096, 8, 4, 1]
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), path, longest=100)


def test_token_files(spark, corpus):
    name = public_tokenizers.path("byte_bpe_50k.json")
    model, path, corpus = Tokenizer.from_file(name), work_path(spark, "test-orc"), [*corpus, (701, "a<|endoftext|>b")]
    token_orc.write_tokens(frame(spark, corpus), path, name, parts=3)
    got = token_orc.token_summary(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in corpus), key=lambda i: (i is not None, i))
    texts, at = defaultdict(list), 0
    for i, t in corpus:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        texts[i].append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in texts[r["doc_id"]]
        at += r["n_tokens"]
    some = token_orc.read_tokens(spark, path, [100, 101])
    assert sorted(r["doc_id"] for r in some.collect()) == [100, 101]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan.replace(" ", "", 0) or "In(doc_id" in plan
    path = work_path(spark, "test-orc")
    token_orc.write_tokens(frame(spark, []), path, name, parts=1)
    assert token_orc.token_summary(spark, path).count() == 0


# ---- sharding ----------------------------------------------------------------------------------------------------


def test_sharding(spark, corpus, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 16)
    got = sharding.shard_documents(frame(spark, corpus), 4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus)
    place = defaultdict(set)
    for r in got:
        place[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(len(s) == 1 for s in place.values())
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sums = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    largest = max(sum(r["size"] for r in got if (r["size"], r["text_crc32"]) == k) for k in place)
    assert max(sums) - min(sums) <= largest
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def brute_differencing(sizes, k):
    """Sums of the shards: lists of (sum, members), the two of largest spread joined until one is left; first in, first out."""
    parts = [(n, [(0, []) for _ in range(k - 1)] + [(s, [n])]) for n, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[1][0][0] - p[1][-1][0], p[0]))
        (_, a), (_, b) = parts.pop(0), parts.pop(0)
        joined = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: x[0])
        parts.append((made, joined))
        made += 1
    return sorted(x[0] for x in parts[0][1])


def test_differencing_equals_brute_force():
    rng = random.Random(11)
    for k, n in ((2, 1), (2, 9), (3, 20), (8, 60)):
        sizes = [rng.randint(1, 10**6) for _ in range(n)]
        to = [s[0] for s in sharding.difference([[x] + [0] * (k - 1) for x in sizes])]
        sums = [0] * k
        for x, shard in zip(sizes, to, strict=True):
            sums[shard] += x
        assert sorted(sums) == brute_differencing(sizes, k)


def test_differencing_beats_dealing():
    rng = np.random.default_rng(0)
    sizes = rng.lognormal(6, 1, 2000).astype(int).tolist()
    places = sharding.difference([[n] + [0] * 7 for n in sizes])
    sums = np.bincount([p[0] for p in places], sizes, minlength=8)
    assert sums.max() - sums.min() < 5
    assert sorted(places[0]) == list(range(8))
    assert sharding.difference([[5, 0]]) == [[0, 1]]


# ---- decontamination ---------------------------------------------------------------------------------------------

ITEMS = [("i1", " ".join(f"q{i}" for i in range(15))), ("i2", "Short one"), ("i3", "short one"), ("i4", None), ("i5", "..."), ("i6", " ".join(f"q{i}" for i in range(3, 18))), ("i,7", "zig zag zog")]


def brute_hits(text, items, window):
    words = textbytes.alnum_words(text)
    hit, names = set(), set()
    for name, t in items:
        w = textbytes.alnum_words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[a : a + n]:
                    hit.update(range(i, i + n))
                    names.add(name)
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block", [200_000, 12])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    q = [f"Q{i}" for i in range(18)]
    docs = [(1, "a " + ", ".join(q[2:14]) + " b"), (2, "a short. ONE b"), (3, "nothing"), (4, None), (5, ""), (6, " ".join(q[:9])), (7, " ".join(q) + " zig zag zog zig zag"), (8, "short one " + " ".join(q[0:12]) + " x " + " ".join(q[5:18])), (8, "zig-zag zog")]
    rng = random.Random(1)
    docs += [(100 + i, " ".join(rng.choice(q + ["short", "one"]) for _ in range(60))) for i in range(30)]
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = decontamination.contamination(frame(spark, docs), items, 10).collect()
    have = Counter((r["doc_id"], r["n_words"], sum(r["ends"]) - sum(r["starts"]), tuple(r["items"])) for r in got)
    want = Counter((i, n, h, tuple(names)) for i, t in docs for n, h, names in [brute_hits(t, ITEMS, 10)])
    assert have == want


def test_decontaminate_text(spark):
    q = " ".join(f"q{i}" for i in range(12))
    clean = "Clean text, kept as it is. " * 3
    docs = spark.createDataFrame([(1, f"Before it: {q.upper()}! After it comes more and more and more of the text, twelve words.", 0, "z"), (2, clean, 7, "z"), (3, q, 1, None), (4, None, None, "z"), (5, "", 0, "z")], "doc_id long, text string, n_chars int, n_words string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, items).collect()}
    assert sorted(got) == [1, 2, 4, 5] and got[2]["text"] == clean and got[2]["n_chars"] == 7
    assert got[1]["text"].startswith("Before it: ! After") and got[1]["n_chars"] == len(got[1]["text"]) and got[1]["n_words"] == "z"
    assert decontamination.decontaminate(docs, items.limit(0)).count() == 5


def test_decontaminate_over_several_blocks(spark, monkeypatch):
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    rest = [f"w{i}" for i in range(16)]
    joined = b[:6] + a + b[6:]  # cutting a joins b
    docs = spark.createDataFrame([(1, " ".join(a + b + rest), 0), (2, " ".join(rest + a + rest), 0), (3, " ".join(rest + joined + rest), 0), (4, None, 5), (2, " ".join(rest), 9)], "doc_id long, text string, n_chars int")
    items = spark.createDataFrame([("a", " ".join(a)), ("b", " ".join(b))], "item_id string, text string").coalesce(1)
    got = []
    for block in (200_000, 12):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
        got.append(sorted(map(str, decontamination.decontaminate(docs, items).collect())))
        got.append(sorted(map(str, decontamination.decontaminate(docs, items.orderBy(F.desc("item_id"))).collect())))
    assert got[0] == got[1] == got[2] == got[3]
    assert len(got[0]) == 4 and not any("doc_id=1," in r or "b0" in r for r in got[0])


@pytest.mark.parametrize("block", [200_000, 12])
def test_decontaminate_keeps_any_column(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    q = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before {q} after it more and more words than are cut out of the text here", "mine", 2, None, "d", "e", 3)], "doc_id long, text string, _cut string, _row int, _text string, `a.b` string, `a``b` string, c1 int")
    items = spark.createDataFrame([("a", q), ("b", q.replace("q", "r"))], "item_id string, text string").coalesce(1)
    got = decontamination.decontaminate(docs, items)
    assert got.dtypes == docs.dtypes
    (row,) = got.collect()
    assert tuple(row)[2:] == ("mine", 2, None, "d", "e", 3) and "q3" not in row["text"] and row["text"].startswith("before ")


# ---- language ----------------------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(0)
    syllables = {"aa": ["la", "mo", "ri", "sen"], "bb": ["kch", "zzt", "pfo", "ü"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    train = spark.createDataFrame([*rows[:40], (90, None, "aa"), (91, "la mo", None)], "doc_id long, text string, lang string")
    profiles = language_id.fit_profiles(train)
    assert sorted(profiles) == ["aa", "bb"]
    test = spark.createDataFrame([*[(i, t, "?") for i, t, _ in rows[40:]], (70, None, None), (71, "123 ... !", None), (72, "", None), (73, rows[1][1] * 3000, None)], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in language_id.identify(test, profiles, ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1 for i, _, lang in rows[40:])
    assert [got[i]["lang_pred"] for i in (70, 71, 72, 73)] == ["und", "und", "und", "bb"]
    assert language_id.identify(test, {}, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def plain_grams(text):
    """N-gram counts by the definition: fold, collapse, pad, count every window."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    raw = re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), raw)
    raw = b" " + b" ".join(raw.split(b" ")) + b" "
    raw = re.sub(rb" +", b" ", raw)
    return Counter(raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1) if raw[i : i + n] != b" ")


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_gram_counts_for_any_piece(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    rng = random.Random(8)
    for text in ["", " ", "a", "  Ab ", "É!ÀÉ Ü×ü", "日本 語", *("".join(rng.choice("aB É×. é日") for _ in range(rng.randint(0, 40))) for _ in range(60))]:
        codes, counts = language_id.gram_counts(np.frombuffer(text.encode(), np.uint8))
        got = {(int(c) & (1 << 8 * (1 + (int(c) >> 24))) - 1).to_bytes(1 + (int(c) >> 24), "big"): int(n) for c, n in zip(codes, counts, strict=True)}
        assert got == plain_grams(text), text


def test_profiles_for_any_piece(spark, monkeypatch):
    rows = [(i, prose(i, 50) + " ÉÀ", "aa" if i % 2 else "bb") for i in range(20)]
    want = {lang: sum((plain_grams(t) for _, t, x in rows if x == lang), Counter()) for lang in ("aa", "bb")}
    monkeypatch.setattr(language_id, "HELD", 100)
    monkeypatch.setattr(language_id, "PIECE", 13)
    batch = pa.record_batch([pa.array([x for _, _, x in rows]), pa.array([t for _, t, _ in rows])], ["lang", "text"])
    got = defaultdict(dict)
    for lang, gram, n in (r for b in language_id._profile_counts([batch]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        size = 1 + (gram >> 24)
        got[lang][(gram & (1 << 8 * size) - 1).to_bytes(size, "big")] = n
    assert got == want


def test_language_columns_may_clash(spark):
    rows = [(i, "la mo ri", "aa", "x", 1, "y", "z") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `lang_pred` string, `_text` string, Score int, `a``b` string, `c.d` string")
    got = language_id.identify(docs, {"aa": [1, 2]}, docs.columns)
    assert got.columns == ["doc_id", "text", "_text", "a`b", "c.d", "lang_pred", "score"]
    assert {tuple(r)[2:6] for r in got.collect()} == {("x", "y", "z", "aa")}
    got = language_id.identify(docs, {"aa": [1, 2]}, docs.columns, pred_col="p", score_col="s")
    assert got.columns == [*docs.columns, "p", "s"] and got.count() == 3


def brute_grams(text):
    t = "".join(c.lower() if c.isascii() and c.isalpha() or "\u00c0" <= c <= "\u00de" and c != "\u00d7" else c if ord(c) > 127 else " " for c in text)
    raw = b" " + " ".join(t.split(" ")).encode() + b" "
    raw = re.sub(b" +", b" ", raw)
    counts = Counter(raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1))
    del counts[b" "]
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))], counts


def test_language_id_equals_brute_force(spark):
    rng = random.Random(5)
    words = {"aa": ["\u00c9t\u00e9", "chat", "Noir", "la", "le"], "bb": ["summer", "Cat", "the", "a1b", "of"], "cc": ["\u043b\u0435\u0442\u043e", "\u043a\u043e\u0442", "\u0438"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 60))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    odd = [(100, None, "aa"), (101, "", "bb"), (102, "1 2", None), (103, "Chat of", None), (104, "\u00d7 x", "aa")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    size, own = language_id.PROFILE, language_id.DOCUMENT
    total = defaultdict(Counter)
    for _, text, lang in rows + odd:
        if lang and text is not None:
            total[lang] += brute_grams(text)[1]
    profiles = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:size] for lang, c in total.items()}
    want = {}
    for i, text, _ in rows + odd:
        if not text or not any(c.isalpha() for c in text):
            want[i] = ("und", 0.0)
            continue
        mine = brute_grams(text)[0][:own]
        spread = size / max(len(mine), own)
        far = {lang: sum(abs(p.index(g) - r * spread) if g in p else size for r, g in enumerate(mine)) / (size * len(mine)) for lang, p in profiles.items()}
        lang = min(sorted(far), key=far.__getitem__)
        want[i] = (lang, 1 - far[lang])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.fit_profiles(docs), ["doc_id"]).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_out_of_place_distance_by_hand():
    p = language_id.Profiles({"x": [10, 20, 30]}, 3)
    own = np.array([10, 40], np.uint32)
    place = 3 / language_id.DOCUMENT
    assert p.distances(own)[0] == pytest.approx((abs(0 - 0) + 3) / (3 * 2)) and place > 0


# ---- WARC --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [0, 1000])
def test_warc_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    html = ["<p>é</p>", "<p>é</p>", "", None, "a\r\n\r\nWARC/1.1\r\nx", "big" * 9000, "<p>é</p>"]
    rows = [(7 - i, f"http://h.example/p{i} q", h, "t") for i, h in enumerate(html)] + [(2**62 + 5, None, "id", "t"), (-9, "http://x", "neg", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type string")
    path = work_path(spark, "test-warc")
    warc.write_warc(pages, path)
    got = warc.assemble(warc.read_warc(spark, path)).collect()
    assert len(got) == len(rows) and all(r["capture"] and r["request"] and r["metadata"] for r in got)
    seen = {}
    first = {}
    for i, _, h, _ in sorted(rows):
        first.setdefault(h or "", i)
    for r in got:
        page = warc.page_of(r["capture"]["record_id"])
        seen[page] = (r["capture"]["type"], r["capture"]["payload_digest"], warc.page_of(r["capture"]["refers_to"]))
    for i, _, h, _ in rows:
        digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        own = first[h or ""] == i
        assert seen[i] == ("response" if own else "revisit", digest, None if own else first[h or ""])
    block = next(r["capture"]["block"] for r in got if warc.page_of(r["capture"]["record_id"]) == 3)
    assert bytes(block).partition(b"\r\n\r\n")[2] == html[4].encode()
    urn = spark.createDataFrame([(r["capture"]["record_id"],) for r in got], "u string")
    assert sorted(x[0] for x in urn.select(warc.page_of_column(F.col("u"))).collect()) == sorted(r[0] for r in rows)


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    path = work_path(spark, "test-warc")
    warc.write_warc(pages, path, least=5)
    assert warc.read_warc(spark, path).where("type = 'revisit'").count() == 0
    path = work_path(spark, "test-warc")
    warc.write_warc(pages.limit(0), path)
    assert warc.assemble(warc.read_warc(spark, path)).count() == 0


def test_warc_repeated_page_ids(spark):
    rows = [(1, "http://a/1", "x"), (1, "http://a/1", "y"), (1, "http://a/1", "x"), (2, "http://a/2", "x"), (None, "http://a/n", "x"), (None, "http://a/n", "z")]
    path = work_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    records = warc.read_warc(spark, path)
    assert records.select("record_id").distinct().count() == 3 * len(rows)
    got = warc.assemble(records).withColumn("page", warc.page_of_column(F.col("capture.record_id"))).withColumn("refers", warc.page_of_column(F.col("capture.refers_to"))).collect()
    assert all(r["request"] and r["metadata"] and r["page"] == warc.page_of(r["capture"]["record_id"]) for r in got)
    digest = {warc.payload_digest(h.encode()): h for _, _, h in rows}
    seen = sorted((str(r["page"]), digest[r["capture"]["payload_digest"]], r["capture"]["type"], r["refers"]) for r in got)
    assert seen == [("1", "x", "response", None), ("1", "x", "response", None), ("1", "y", "response", None), ("2", "x", "revisit", 1), ("None", "x", "revisit", 1), ("None", "z", "response", None)]


# ---- language model ----------------------------------------------------------------------------------------------


def raw_record(kind, name, block, *more, length=True):
    lines = ["WARC/1.0", f"warc-type:{kind}", f"WARC-Record-ID: <{name}>", *([f"Content-Length: {len(block)}"] if length else []), *more]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_reader_keeps_bad_records_apart(spark, tmp_path):
    response = raw_record("response", "r", b"HTTP/1.1 200 OK\r\n\r\nbody")
    request = raw_record("request", "q", b"GET /", "WARC-Concurrent-To: <r>", "WARC-Concurrent-To: <other>")
    metadata = raw_record("metadata", "m", b"no colon here\r\npayload_bytes: many\r\n", "WARC-Concurrent-To: <r>", "line without a mark")
    bad = [raw_record("response", "b1", b"x", length=False), b"no record", raw_record("response", "b2", b"abc")[:-6].replace(b"Length: 3", b"Length: 99")]
    zipped = b"".join(map(gzip.compress, [response, *bad, request])) + gzip.compress(metadata)
    broken = bytearray(gzip.compress(response))
    broken[len(broken) // 2] ^= 255
    files = [zipped, response + request + metadata, bytes(broken) + gzip.compress(request), response + bad[0] + metadata, gzip.compress(metadata)[:-20], b""]
    kinds = []
    for n, raw in enumerate(files):
        (tmp_path / f"{n}").mkdir()
        (tmp_path / f"{n}" / "a.warc").write_bytes(raw)
        kinds.append(sorted(r["type"] for r in warc.read_warc(spark, str(tmp_path / f"{n}")).collect()))
    assert kinds[0] == ["invalid"] * 3 + ["metadata", "request", "request", "response"]
    assert kinds[1] == ["metadata", "request", "request", "response"]
    assert kinds[2] == ["invalid", "request", "request"]
    assert kinds[3] == ["invalid", "metadata", "response"]
    assert kinds[4:] == [["invalid"], []]
    got = {r["capture_id"]: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path / "0"))).collect()}
    assert set(got) == {"<r>", "<other>"} and got["<other>"]["capture"] is None
    assert got["<r>"]["capture"]["payload_bytes"] == 4 and got["<r>"]["request"]["record_id"] == "<q>"
    assert got["<r>"]["metadata"]["payload_bytes"] is None


def test_base_scores(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 50)  # most words take the joined way
    held = F.col("doc_id") % 7 == 2
    got = lm_scoring.score_documents(frame(spark, corpus), held).collect()
    train = Counter()
    for i, t in corpus:
        if i is None or i % 7 != 2:
            train.update([*lm_scoring.tokens((t or "").encode()), lm_scoring.END])
    n, v = sum(train.values()), len(train) + 1
    want = Counter()
    for i, t in corpus:
        w = [*lm_scoring.tokens((t or "").encode()), lm_scoring.END]
        want[(i, len(w), sum(train[x] > 0 for x in w), n, round(sum(np.log10((train[x] + 1) / (n + v)) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    assert lm_scoring.score_documents(frame(spark, []), held).count() == 0


def test_mixing_learns_structure():
    """Frequent words become likely, probabilities of continuations add up, and unseen words stay possible."""
    words = [b"the", b"of", b"thesis", b"ox"] * 400 + [b"rare%d" % i for i in range(200)] + [lm_scoring.END] * 100
    counts = Counter(words)
    tables = np.zeros((2, lm_scoring.TABLE), np.float32)
    lm_scoring.add_counts(tables, list(counts), np.array(list(counts.values())))
    mixer = lm_scoring.Mixer(tables)
    rng = np.random.default_rng(0)
    before = None
    for step in range(60):
        mixer.learn([words[i] for i in rng.integers(0, len(words), 256)], 0.05)
    mixer.freeze()
    p = 10 ** mixer.log10([b"the", b"of", b"thesis", b"ox", lm_scoring.END, b"zzzz"])
    assert all(x > 0.1 for x in p[:4]) and p[5] > 0 and p.sum() < 1 and before is None
    # the bits of one byte: over all first bytes the probabilities sum to one
    firsts = [bytes([b]) + b"\xff" for b in range(256)]
    c = lm_scoring.Coded(firsts)
    total = np.zeros(len(c.raw))
    for shift, (bit, slots) in enumerate(c.bits()):
        q = mixer.predict(shift, slots)[0]
        total += np.log(np.where(bit == 1, q, 1 - q))
    start = np.cumsum(c.size) - c.size
    assert np.exp(total[start]).sum() == pytest.approx(1, abs=1e-5)


def test_mixer_learns_from_every_training_word(spark):
    """Sums over tasks equal those of all words at once, and the words beyond any fixed number change the weights."""
    counts = {b"w%dx%d" % (i, i * i % 997): 1 + i % 5 for i in range(6000)} | {b"the": 5000}
    words = list(counts)
    n = np.array([counts[w] for w in words])
    got = lm_scoring.fit(spark.createDataFrame(list(counts.items()), "word binary, n long").repartition(5))
    tables = np.zeros((2, lm_scoring.TABLE), np.float32)
    lm_scoring.add_counts(tables, words, n)
    want = lm_scoring.Mixer(tables)
    first = want.weights.copy()
    for curves in (True, False):
        total = lm_scoring.Sums()
        want.sums(words, n, total, curves)
        want.step(total) if curves else want.set_map(total)
    assert np.allclose(got.weights, want.weights, atol=1e-6) and np.allclose(got.refine, want.refine, atol=1e-6)
    half, total = lm_scoring.Mixer(tables), lm_scoring.Sums()
    half.sums(words[:3000], n[:3000], total)
    half.step(total)
    assert abs(half.weights - want.weights).max() > 1e-3 and abs(first - want.weights).max() > 1e-3


# ---- toxicity ----------------------------------------------------------------------------------------------------


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        t = np.unique(rng.integers(0, 40, rng.integers(1, 9)))
        w = rng.random(len(t))
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, 40)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 700, 7):
        found, cosine = index.search(*vectors[i], 10)
        want = dense @ dense[i]
        assert cosine == pytest.approx(np.sort(want)[::-1][:10], abs=1e-12)
        assert want[found] == pytest.approx(cosine, abs=1e-12) and i in found
    assert len(index.search(np.zeros(0, np.int64), np.zeros(0), 5)[0]) == 0


def test_toxicity(spark):
    rows = [(i, prose(i, 60, 3000) + (" scumbag idiotic" if i % 4 == 0 else "")) for i in range(400)]
    docs = frame(spark, [*rows, (900, None), (901, ""), (902, "scumbag idiotic " * 2000), (None, "scumbag idiotic")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [(got[i]["score"], i % 4 == 0) for i in range(300, 400)]
    assert min(s for s, y in held if y) > 0.8 and max(s for s, y in held if not y) < 0.2
    assert got[900]["score"] < 0.2 and got[901]["evidence"] == [] and got[902]["score"] > 0.8 and got[None]["score"] > 0.8
    assert all(e["toxic"] == 1 for e in got[300]["evidence"]) and 0 <= got[300]["score"] <= 1
    odd = docs.where("doc_id = 0").selectExpr("doc_id", "text", "'x' as Score", "'y' as _text", "'z' as `a.b`", "1 as `a``b`")
    (row,) = toxicity.score(odd, model, odd.columns).collect()
    assert row.asDict().keys() == {"doc_id", "text", "_text", "a.b", "a`b", "score", "evidence"} and row["score"] == got[0]["score"] and row["a.b"] == "z"
    assert toxicity.score(odd, model, odd.columns, score_col="s", evidence_col="e").columns == [*odd.columns, "s", "e"]
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none, ["doc_id"]).agg(F.max("score")).first()[0] == 0


def test_toxicity_rare_marks_whatever_the_sample(spark):
    # a word in 6 of 100 toxic and none of 1100 clean rows: equal samples of 100 alone don't tell it from chance
    rows = [(i, prose(i, 60, 3000) + (" zorgle" if i < 6 else " scumbag idiotic" if i < 100 else "")) for i in range(1200)]
    docs = frame(spark, [*rows, (5000, "zorgle"), (5001, prose(5001, 60, 3000) + " zorgle")])
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(1200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_examples=100)
    got = {r["doc_id"]: r for r in toxicity.score(docs.where("doc_id >= 5000"), model, ["doc_id"]).collect()}
    assert b"zorgle" in model.place and got[5000]["evidence"] and all(e["toxic"] == 1 for e in got[5000]["evidence"])
    assert min(r["score"] for r in got.values()) > 0.8


def test_labels_reach_texts_without_a_shuffle(spark, monkeypatch):
    texts = spark.createDataFrame([(i % 50, f"t{i}") for i in range(90)] + [(None, "x"), (99, None)], "id long, text string")
    single = spark.createDataFrame([(i, i % 2) for i in range(0, 120, 3)] + [(9, 0), (99, 0)], "id long, label int")
    got = toxicity._with_labels(texts, single, 42)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(toxicity, "MAX_IDS", 0)
    want = toxicity._with_labels(texts, single, 42)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("id = 9").count() == 4


def test_isotonic_is_monotone():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(y) >= 0).all() and y.tolist() == [0, 0.5, 1] and json.dumps(x.tolist())


def test_batches_are_cut_by_bytes(monkeypatch):
    from oddlight.llm import shared

    monkeypatch.setattr(shared, "BATCH_BYTES", 10)
    texts = ["a" * 4, "b" * 4, None, "c" * 30, "", "d" * 9, "e"]
    batch = pa.record_batch([pa.array(range(8)), pa.array(["skip", *texts])], ["i", "t"]).slice(1)
    parts = list(shared.lean(lambda batches: batches)([batch]))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts and [p.num_rows for p in parts] == [3, 1, 3]
