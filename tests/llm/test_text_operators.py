"""Text operators against brute force on whole small tables, and on odd rows."""
from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quartier.llm import bpe, common, exact, langid, lm, minhash, mixing, pii, quality, queries, simhash, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WHITE = re.compile(r"[\x20\x09-\x0D]")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- op1 -------------------------------------------------------------------------------------------------------------

def test_order_minhash_minds_order():
    words = [f"word{i} some" for i in range(300)]
    text, swapped = " ".join(words), " ".join(reversed(words))
    a, b, c = (minhash.order_minhash(x) for x in (text, swapped, text + " end"))
    assert minhash.likeness(a, c) > 0.9 and minhash.likeness(a, b) < 0.75 * minhash.likeness(a, c)
    assert minhash.likeness(minhash.order_minhash(""), minhash.order_minhash("")) == 1.0


def plain_order_minhash(text):
    """The definition with whole 64-bit hashes; a text under 8 code points is one k-mer."""
    top = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & top
        x = ((x ^ (x >> 29)) * 0xC2B2AE3D27D4EB4F) & top
        return x ^ (x >> 32)

    a, seen, sketches = 0x9E3779B97F4A7C15, {}, [[] for _ in range(minhash.SKETCHES)]
    # pow(a, 7 - j) is what doubling the width three times gives the j-th code point
    kmers = [mixed(sum(ord(text[i + j]) * pow(a, 7 - j, 1 << 64) for j in range(8)) & top) for i in range(len(text) - 7)]
    if 0 < len(text) < 8:
        kmers = [mixed((len(text) * pow(a, len(text), 1 << 64) + sum(ord(x) * pow(a, len(text) - 1 - j, 1 << 64) for j, x in enumerate(text))) & top)]
    for i, k in enumerate(kmers):
        seen[k] = seen.get(k, 0) + 1
        h = mixed((k + a * seen[k]) & top)
        sketches[h >> 57].append((h, i))
    out = []
    for s in sketches:
        value = 0
        for i in sorted(i for _, i in sorted(s)[: minhash.TUPLE]):
            value = mixed((value * a + kmers[i]) & top)
        out.append(value % 65535 + 1 if s else 0)
    return out


def test_order_minhash_whole_hashes(rows):
    for text in [rows[0][1][:700], "abcabcabc" * 30, rows[5][1][:300], "a" * 3000, "abcdefgh"]:
        assert minhash.order_minhash(text).tolist() == plain_order_minhash(text)


@pytest.mark.parametrize("n", range(10))
def test_order_minhash_of_short_texts(n):
    """Texts of 1 to 8 code points are one k-mer, so they fill one sketch and differ wherever they differ."""
    texts = ["abcdefghi"[:n], "aaaaaaaaa"[:n], "\0é😀xyzäbc"[:n]]
    for text in texts:
        assert minhash.order_minhash(text).tolist() == plain_order_minhash(text)
        assert (minhash.order_minhash(text) != 0).sum() == 1 if 0 < n < 9 else True
    if n > 1:
        assert minhash.likeness(*(minhash.order_minhash(t) for t in texts[:2])) < 1
        assert minhash.likeness(minhash.order_minhash(texts[0]), minhash.order_minhash(texts[0][:-1])) < 1


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_order_minhash_across_powers_of_two(n):
    """Near copies whose k-mer counts lie on different sides of a power of two stay alike."""
    text = "".join(map(chr, np.random.default_rng(n).integers(97, 123, n + 20)))
    shorter, longer = (minhash.order_minhash(text[: k + 7]) for k in (n - 10, n + 10))
    assert minhash.likeness(shorter, longer) > 0.85


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op1(table, request):
    df = request.getfixturevalue(table)
    given = sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0))
    got = minhash.edited_pairs(df).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i is not None, i or 0, len(t)) for i, t in given)
    ids = [i for i, _ in given]
    for r in got:
        if r["doc_id"] is None or ids.count(r["doc_id"]) > 1 or table == "odd" and r["doc_id"] == -3:
            continue
        at = ids.index(r["doc_id"])
        text, follower = given[at][1], given[(at + 1) % len(given)]
        if ids.count(follower[0]) > 1 and table == "odd" and follower[0] is None:
            continue
        edited = text[: len(text) - len(text) // 2] + follower[1][: len(text) // 2]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (minhash.order_minhash(x) for x in (text, edited, follower[1]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (minhash.as_text(a), minhash.as_text(b))
        assert (r["near_edited"], r["near_next"]) == (minhash.likeness(a, b), minhash.likeness(a, c))


# --- op2 -------------------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


ODD_SPANS = [
    "a@b.c@d.e x@y.z", "a@b-c.d_x@y.z", "..a@b.c", "a@@b.c a@b", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 12345678901234567890.1.1.1", "4111-1111 1111 1111 and 4111111111111112",
    "+1 (234) 567-8901, +12 34 +1.2.3.4.5.6.7.8.9", "+1-2-3-4-5-6-7-8-9-", "9" * 5000, "1 " * 4000, "a." * 3000 + "@x", "é@b.c 😀a@b.co 😀+49 30 1234567", "", " ",
]


def test_op2_base(spark, rows):
    texts = [r[1] for r in rows] + ODD_SPANS + [" ".join(ODD_SPANS[:8]) + " 8.8.8.8" * 1500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(pii.KINDS[x["k"]], x["s"], x["e"]) for x in r["spans"]] for r in pii.base_spans(df).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute_spans(text), text[:80]


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op2(table, request):
    df = request.getfixturevalue(table)
    got = pii.find_spans(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert set(r["base"]) <= set(r["spans"]) and list(r["spans"]) == sorted(r["spans"])


def test_op2_learns_unmarked_spans(spark):
    """Addresses in one format: the trees take those whose mark is missing, and no plain numbers."""
    texts = [f"word word +1 ({i % 900 + 100}) 555-{i % 9000 + 1000} word" if i % 3 else f"total {i % 9000 + 1000} {i * 7 % 9000 + 1000} items" for i in range(1500)]
    texts += ["word word 1 (321) 555-1234 word"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(df).collect()}
    assert all(any(x["k"] == 3 for x in got[i]) for i in range(1500, 1503))
    assert not any(got[i] for i in range(0, 1500, 3))


def test_op2_thresholds_cover_all_rows(spark):
    """A kind too rare for the sample's held third has its threshold from all rows, and its unmarked spans are added."""
    texts = [f"word word +1 ({i % 900 + 100}) 555-{i % 9000 + 1000} word" if i % 10 == 0 else f"total {i % 9000 + 1000} {i * 7 % 9000 + 1000} items" for i in range(1500)]
    texts += ["word word 1 (321) 555-1234 word"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(df, sample=240).collect()}
    assert all(any(x["k"] == 3 for x in got[i]) for i in range(1500, 1503))
    assert not any(got[i] for i in range(1500) if i % 10)


def test_op2_has_no_python(spark, docs):
    plan = pii.find_spans(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redact(spark):
    rows = [(1, "mail a@b.c or 8.8.8.8 now"), (2, None), (1, "8.8.8.8"), (None, "x@y.zz"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, "[ip]"), (1, "mail [email] or [ip] now"), (2, ""), (None, "[email]"), (None, "none")]
    assert sorted(map(tuple, pii.redact(pii.base_spans(df, text=True)).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, pii.redact(pii.find_spans(df, text=True)).collect()), key=repr) == sorted(want, key=repr)


def test_op2_marks_of_candidates(spark, rows):
    """Whether a candidate is a rule's span, or meets one, as told by looking at all of them; 20,000 spans in one text in seconds."""
    import time

    texts = [r[1] for r in rows[:60]] + ODD_SPANS + ["a@b.co 1.2.3.4 +49 30 1234567 4111-1111 1111 1111 12.3.4.5@x.yy " * 40]
    read = pii.read_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(len(r["wide"]) for r in read) > 100
    for r in read:
        for c in r["wide"]:
            assert c["label"] == float(any((b["k"], b["s"], b["e"]) == (c["k"], c["s"], c["e"]) for b in r["base"]))
            assert c["meets"] == any(b["s"] < c["e"] and c["s"] < b["e"] for b in r["base"])
    start = time.time()
    many = spark.createDataFrame([(1, "8.8.8.8 " * 20_000)], "doc_id long, text string")
    assert pii.read_spans(many).selectExpr("size(base)", "size(wide)").first()[0] == 20_000
    assert time.time() - start < 40


# --- op3 -------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op3(table, request):
    df = request.getfixturevalue(table)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = []
    for i, t in pairs(df):
        ids = encoding.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_long_pieces_agree():
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for piece in [b"abcabcab" * 30, b"hellohello" * 20, bytes(range(200)) * 2]:
        assert encoder._long(piece) == encoder._contract([piece])[0].tolist()


def test_many_long_runs(spark):
    """Thousands of distinct runs of 30 to 500 bytes, more than one query can hold, in one text and in one chunk of texts."""
    rng = np.random.default_rng(4)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ACGT", "的一是不了人我在有他这为之大来以个中上们", "กขคงจฉชซญดตถทธนบปผพฟ"]
    runs = []
    for i in range(2400):
        some = letters[i % 4]
        size = int(rng.integers(30, 501)) // len(some[0].encode())
        runs.append("".join(some[k] for k in rng.integers(0, len(some), size)))
    texts = [" ".join(runs[:1200]), *runs[1200:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == encoding.encode_ordinary(t)
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_pieces_that_return_are_not_contracted_again(monkeypatch):
    """A task meets far more distinct pieces than are frequent: those of 150,000 that return after all others are still known."""
    encoder, contracted = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), []
    monkeypatch.setattr(encoder, "_contract", lambda pieces: contracted.extend(pieces) or [np.array([len(p)]) for p in pieces])
    texts = [" ".join(str(1_000_000 + i) for i in range(at, at + 10_000)) for at in range(0, 150_000, 10_000)]
    first = [encoder.encode([t]) for t in texts]
    assert len(contracted) > 100_000
    contracted.clear()
    assert [encoder.encode([t]) for t in texts] == first and contracted == []


def test_remembered_pieces_are_bounded_by_bytes(monkeypatch):
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    monkeypatch.setattr(encoder, "_contract", lambda pieces: [np.arange(1_000, 1_000 + len(p)) for p in pieces])
    for at in range(0, 40_000, 1_000):
        encoder.encode([" ".join(str(10**400 + i) for i in range(at, at + 1_000))])
    chunk = 1_000 * 3_000
    assert sum(sys.getsizeof(p) + sys.getsizeof(ids) for d in (encoder.known, encoder.older) for p, ids in d.items()) < 2 * (20_000_000 + chunk)


# --- op4 -------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("digest", [True, False])
@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op4(table, digest, request):
    df = request.getfixturevalue(table)
    groups = {}
    for i, t in pairs(df):
        groups.setdefault(WHITE.sub("", t), []).append((-len(t), i is None, i or 0, i))
    got = exact.exact_groups(df, digest).collect()
    assert len(got) == df.count()
    want = sorted((repr(x[3]), repr(min(g)[3]), len(g)) for g in groups.values() for x in g)
    assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    if digest:
        assert {r["sha"] for r in got} == {hashlib.sha256(k.encode()).hexdigest() for k in groups}
    stay = exact.exact_dedup(df)
    assert stay.columns == df.columns
    assert sorted(map(repr, pairs(stay))) == sorted(repr((min(g)[3], next(t for i, t in pairs(df) if i == min(g)[3] and WHITE.sub("", t) == k and len(t) == -min(g)[0]))) for k, g in groups.items())


# --- op5 -------------------------------------------------------------------------------------------------------------

def test_op5_held_out(spark, sf, rows):
    got = {r["doc_id"]: r for r in queries.op5_language_codes(spark, sf).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    held = [(got[i]["lang_pred"], lang) for i, _, lang, _ in rows if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_op5_odd(spark, odd, none):
    model = langid.fit_languages(odd)
    got = langid.predict_languages(odd, model).select("doc_id", "text", "language.*").collect()
    assert all((r["lang_pred"] == "und") == (not langid.has_letter(r["text"] or "")) for r in got)
    assert langid.predict_languages(none, model).count() == 0
    empty = langid.predict_languages(odd, langid.fit_languages(none)).select("language.lang_pred").distinct().collect()
    assert [r[0] for r in empty] == ["und"]
    assert langid.keep_known_languages(odd).columns == odd.columns


def test_gram_counts_in_blocks(monkeypatch, rows):
    text = rows[0][1]
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 97)
    assert (langid.gram_counts(text) == whole).all()


@pytest.mark.parametrize("n", [2, 4, 6, 9, 40])
def test_codebook(n):
    codes = langid.codebook(n)
    assert all(set(c) == {1, -1} for c in codes.T)
    assert min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i]) >= max(1, codes.shape[1] // 5)


# --- op6 -------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op6(table, request):
    df = request.getfixturevalue(table)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    given = [(r["doc_id"], r["source"], size(r["text"])) for r in df.collect()]
    got = mixing.mix_sizes(df).collect()
    assert sorted(repr((r["doc_id"], r["source"], r["size"])) for r in got) == sorted(map(repr, given))
    sizes = {}
    for _, s, n in given:
        sizes[s] = sizes.get(s, 0) + n
    assert sum(r["target"] for r in {r["source"]: r for r in got}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, n in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == n and 0 <= r["copies"] <= 2 for r in own)
        by_id = {}
        for r in own:
            by_id[r["doc_id"]] = by_id.get(r["doc_id"], 0) + r["size"]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= max(by_id.values())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in got)


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": pytest.approx(500 / 3), "c": pytest.approx(250 / 3)}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, None: 10}) == {"a": 0.0, None: 15.0}


# --- op7 -------------------------------------------------------------------------------------------------------------

def test_op7_held_out(spark, rows):
    sf = "/root/testdata/sf0.1"
    got = queries.op7_fourier_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([np.mean([g > b for g in good]) for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93


def test_op7_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (5, None), (None, 1), (9, 1)], "doc_id long, label int")
    for df, given in [(odd, labels), (odd, labels.limit(0)), (none, labels)]:
        got = quality.quality_scores(df, given).collect()
        assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)


def test_isotonic():
    x, p = quality.isotonic(np.arange(6), np.array([0, 3, 1, 4, 9, 10]), np.full(6, 10))
    assert (np.diff(p) > 0).all() and x.tolist() == [0, 1.5, 3, 4, 5]


# --- op8 -------------------------------------------------------------------------------------------------------------


def test_op8_base_and_sum(spark, sf, rows):
    got = {r["doc_id"]: r for r in queries.op8_recurrent_lm(spark, sf).collect()}
    words = {i: [w.lower() for w in (t or "").encode().split()] + [b""] for i, t, *_ in rows}
    count = {}
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        r = got[i]
        base = sum(np.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in count for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op8_joined_words_agree(spark, docs, monkeypatch):
    """A lookup that leaves most words to the join gives the base scores of one that holds all."""
    all_held = {r["doc_id"]: r for r in lm.likelihoods(docs, docs).collect()}
    monkeypatch.setattr(lm, "LOOKUP", 3 * lm.HEAD)
    joined = {r["doc_id"]: r for r in lm.likelihoods(docs, docs).collect()}
    for i, r in all_held.items():
        assert joined[i]["base_score"] == pytest.approx(r["base_score"]) and joined[i]["n_known"] == r["n_known"]
        assert joined[i]["score"] == pytest.approx(r["score"], rel=1e-3)


def test_op8_chances_sum_to_one():
    words = [(bytes([97 + i % 26]) * (1 + i // 26), 2000 - i) for i in range(1200)]
    tail_n, tail_v = np.ones(lm.TAIL_CLASSES), np.ones(lm.TAIL_CLASSES)
    model = lm.LanguageModel(words, 10**6, 1200, tail_n, tail_v)
    h = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.HEAD + lm.TAIL_CLASSES)
    logs, _ = model.log_chances(np.repeat(h, len(every), axis=0), every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_op8_gradient(monkeypatch):
    """Backpropagation of one window against finite differences of its loss."""
    words = [(bytes([97 + i % 26]) * (1 + i // 26), 2000 - i) for i in range(1200)]
    model = lm.LanguageModel(words, 10**6, 1200, np.ones(lm.TAIL_CLASSES), np.ones(lm.TAIL_CLASSES))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(1)
    doc = rng.integers(0, lm.HEAD + lm.TAIL_CLASSES, 9)
    loss = lambda: -model.log_likelihoods([doc])[0] * np.log(10) / len(doc)
    before = {k: v.copy() for k, v in model.p.items()}
    base = loss()
    monkeypatch.setattr(lm, "PASSES", 1)
    monkeypatch.setattr(lm, "FIT_ROWS", 1)
    monkeypatch.setattr(lm, "WINDOW", len(doc))  # a full window takes a whole step
    model.fit([doc])  # one Adam step from zero moments goes against the gradient's sign
    moved = {k: model.p[k] - before[k] for k in before}
    model.p = {k: v.copy() for k, v in before.items()}
    checked = 0
    for k in ("state", "input", "class", "word"):
        flat = np.flatnonzero(np.abs(moved[k]).ravel() > 0.9 * lm.RATE)
        for i in rng.choice(flat, 8, replace=False):
            model.p[k].flat[i] += 1e-3
            slope = (loss() - base) / 1e-3
            model.p[k].flat[i] -= 1e-3
            if abs(slope) > 1e-4:
                assert np.sign(slope) == -np.sign(moved[k].flat[i]), k
                checked += 1
    assert checked >= 8


def test_op8_state_crosses_windows(monkeypatch, rows):
    words = [lm.tokens(r[1]) for r in rows[:20]]
    counts = {}
    for d in words:
        for w in d:
            counts[w] = counts.get(w, 0) + 1
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    model = lm.LanguageModel(top, sum(counts.values()), len(counts), np.ones(lm.TAIL_CLASSES), np.ones(lm.TAIL_CLASSES))
    docs = [model.numbers(d) for d in words]
    want = model.log_likelihoods(docs)
    monkeypatch.setattr(lm, "WINDOW", 7)
    monkeypatch.setattr(lm, "SCORE_ROWS", 3)
    assert model.log_likelihoods(docs) == pytest.approx(want, rel=1e-5)


def test_op8_learns_from_all_rows(spark, monkeypatch):
    """Each of 2,400 documents has a word of its own; all but the judging ones move their word's input weights."""
    monkeypatch.setattr(lm, "OFTEN", 1)
    df = spark.createDataFrame([(i, f"w{i} " + "the of " * 15) for i in range(2400)], "doc_id long, text string").repartition(2)
    counts = lm.count_words(df)
    model = lm.fit_language_model(df, counts)
    before = lm.LanguageModel(lm.frequent_words(counts, lm.LOOKUP), model.total, model.distinct, np.ones(lm.TAIL_CLASSES), np.ones(lm.TAIL_CLASSES))
    moved = np.abs(model.p["input"] - before.p["input"]).max(axis=1) > 1e-6
    assert moved.sum() > 0.8 * 2400


def test_op8_head_follows_the_counts():
    words = [(b"w%d" % i, 5000) for i in range(2500)]
    model = lm.LanguageModel(words, 12_500_000, 2500, np.ones(lm.TAIL_CLASSES), np.ones(lm.TAIL_CLASSES))
    assert model.head == 2500 and model.input_of(b"w2400") == 2400
    every = np.arange(model.head + lm.TAIL_CLASSES)
    logs, _ = model.log_chances(np.ones((len(every), lm.HIDDEN), dtype=np.float32), every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_op8_odd(odd, none):
    got = lm.likelihoods(odd, odd.where("doc_id > 3")).collect()
    assert len(got) == odd.count() and all(np.isfinite(r["score"]) for r in got)
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    assert lm.likelihoods(none, odd).count() == 0
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in lm.likelihoods(odd, none).collect())


def test_op8_words_of_many_texts_at_once(rows, monkeypatch):
    """Tokens, counts, outputs and words beyond the lookup of many texts, as of one text and one word after the other."""
    odd = ["", " \t", "a b", "  A  b\x0bC\x0c", "x\x1cy\x85z\xa0w", "Straße ÉTÉ\r\n", "\x1f", "a\x00b c", "é" * 40 + " " + "ß " * 9]
    texts = [*odd, *((r[1] or "") for r in rows[:200]), ""]
    want = [[*t.encode().lower().split(), b""] for t in texts]
    words, ends = lm.split(texts)
    assert words.to_pylist() == [w for t in want for w in t] and np.diff(ends).tolist() == [len(t) for t in want]
    assert [lm.tokens(t) for t in odd] == want[: len(odd)]
    counts = Counter(w for t in want for w in t)
    monkeypatch.setattr(lm, "COUNTED", 5_000)
    got = Counter()
    batches = list(lm._count(iter([pa.RecordBatch.from_pydict({"text": texts[:50]}), pa.RecordBatch.from_pydict({"text": texts[50:]})])))
    for batch in batches:
        got.update(dict(zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True)))
    assert got == counts and len(batches) > 10
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:1500]
    for lookup in (top, []):
        model = lm.LanguageModel(lookup, sum(counts.values()), len(counts), np.ones(lm.TAIL_CLASSES), np.ones(lm.TAIL_CLASSES))
        head = {w: i for i, (w, _) in enumerate(lookup[: model.head])}
        outputs = [[head.get(w, model.head + lm.tail_class(w) - lm.HEAD_CLASSES) for w in t] for t in want]
        assert [d.tolist() for d in model.documents(texts)] == outputs == [model.numbers(t).tolist() for t in want]
        known, frame = dict(lookup), model.score(texts)
        for t, r in zip(want, frame.itertuples(), strict=True):
            assert r.n_tokens == len(t) and r.n_known == sum(w in known for w in t)
            assert dict(zip(r.words, r.times, strict=True)) == Counter(w for w in t if w not in known)
            assert r.base_score == pytest.approx(sum(np.log10(known[w] + 1) if w in known else 0 for w in t) - len(t) * model.base_z)
        tails = [sum((np.log10(known[w] + 1) if w in known else 0) - model.tail_z[lm.tail_class(w) - lm.HEAD_CLASSES] for w in t if w not in head) for t in want]
        assert frame["score"].tolist() == pytest.approx((np.array(tails) + model.log_likelihoods([np.array(o) for o in outputs])).tolist())


# --- op9 -------------------------------------------------------------------------------------------------------------

def test_op9_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1
    model = toxicity.fit_toxicity(docs, labels.where(~held).select("doc_id", F.col("toxic").alias("label")))
    assert (np.diff(model.theta) > 0).all()
    got = toxicity.toxicity_grades(docs, model).join(labels.where(held), "doc_id").selectExpr("toxicity.*", "toxic").collect()
    toxic, clean = ([r for r in got if r["toxic"] == t] for t in (1, 0))
    assert np.mean([r["chance"] >= 0.5 for r in clean]) < 0.01
    assert np.mean([r["chance"] >= 0.5 for r in toxic]) > 0.55  # a third of the toxic labels mark texts without telling words
    assert np.mean([r["severity"] for r in toxic]) > 10 * np.mean([r["severity"] for r in clean])


def test_op9_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (5, None), (None, 1), (6, 0)], "doc_id long, label int")
    for df, given in [(odd, labels), (odd, labels.limit(0)), (none, labels)]:
        got = toxicity.toxicity_grades(df, toxicity.fit_toxicity(df, given)).select("toxicity.*").collect()
        assert len(got) == df.count() and all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in got)


# --- op10 ------------------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(root)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in every}


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op10(table, request):
    df = request.getfixturevalue(table)
    given = [(i, brute_fingerprint(t)) for i, t in pairs(df)]
    root = brute_components([f for _, f in given])
    least = {}
    for i, f in given:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_components(df).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, f, least.get(root[f]))) for i, f in given)
    assert simhash.near_dedup(df).columns == df.columns


@pytest.mark.parametrize("shard", [simhash.SHARD, 8])
def test_links_of_dense_prints(spark, shard):
    """Chains and clusters of prints; a small shard size forces the further levels and the pieces."""
    rng = np.random.default_rng(2)
    prints = []
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64):
        f = int(base) * 2 % 2**64
        for _ in range(25):
            prints.append(f)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                f ^= 1 << int(b)
    prints = list(set(prints) | {0, 7, 15})
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "fp long")
    links = simhash.near_links(df, 3, shard)
    got = {r["node"] % 2**64: r["component"] % 2**64 for r in common.connected(links, "a", "b").collect()}
    want = brute_components(prints)
    alike = {}
    for f in prints:
        alike.setdefault(got.get(f, f), set()).add(f)
    expected = {}
    for f in prints:
        expected.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, alike.values())) == sorted(map(sorted, expected.values()))


def test_tree_follows_only_near_edges(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 2**12, 600, dtype=np.uint64))
    a, b = simhash.shard_links(prints, 1)
    root = {int(f): int(f) for f in prints} | dict(zip(map(int, a), map(int, b), strict=True))
    assert root == brute_components([int(f) for f in prints], 1)


def test_connected_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r["component"] for r in common.connected(edges, "a", "b").collect()} == {0}
    assert common.connected(edges.limit(0), "a", "b").count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf, rows):
    docs, kept = common.documents(spark, sf), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns, name
        before, after = pairs(docs), pairs(out)
        if name == "language":
            assert {i for i, _ in after} == {i for i, t in before if langid.has_letter(t)}
        elif name == "exact_duplicates":
            assert len(after) == len({WHITE.sub("", t) for _, t in before})
        elif name == "near_duplicates":
            root = brute_components([brute_fingerprint(t) for _, t in before])
            assert len(after) == len(set(root.values()))
        else:
            assert set(after) <= set(before)
        docs = out
        kept = after
    got = corpus_pipeline.run(spark, sf)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = [(i, len(encoding.encode_ordinary(t))) for i, t in kept]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == sorted(want)


def test_pipeline_on_odd_rows(spark, odd, none):
    for df in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "")
        df.collect()
