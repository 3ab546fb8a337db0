"""Text operators against plain versions, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers as P
from tetrad.llm import backoff, bpe, components, fertility, fingerprint, hilbert, minhash, packing, quality, repeats, suffix, toxicity, words
from tetrad.llm.queries import fold, vocabulary

WORDS = "the of and thing erth reading blend worth tion hean ".split()


def sentence(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n)) + f" unique{seed}"


LONG = " ".join(f"w{i % 997}x{i // 7}" for i in range(40_000))
BASE = " ".join(f"word{i}" for i in range(60))
EDGE = [
    (1, BASE), (2, BASE), (3, BASE + " tail"), (3, BASE + " tail"), (4, None), (5, ""), (6, "   \n\t "), (None, "no id here at all"), (7, LONG), (8, "x" * 70_000), (9, "one two"), (10, "ONE two"),
    (11, "a  b   c \n\n d\t "), (12, "it's 123 ²½ é ☃ 日本　語 Σ İ"), (13, "\n \n a"), (14, sentence(80, 1)), (15, sentence(80, 1) + " " + BASE), (16, "nul\x00in the text"), (17, "ctrl\x1cspace"),
    (18, "a <|endoftext|> b<|StartOfText|>c <|startoftext|>"),
]

#: Running text of several languages and lengths, which no band may reject.
RUNNING = [
    "The river had risen in the night, and by the time we reached the bridge the lower road was under water and the farmers were leading their cattle up to the church.",
    "She opened the letter, read it twice, and put it back on the table. It was raining. The boy asked whether the train would still come, and she said that it would, but she did not believe it, and he did not believe her either.",
    "Am Abend saßen sie noch lange vor dem Haus und sprachen über die Ernte, über den Krieg und über die Kinder, die in der Stadt lebten und nur selten schrieben.",
    "Le marché ouvrait à six heures, et déjà les femmes du village arrivaient avec leurs paniers, en parlant du prix des œufs, du curé et de la nouvelle route qu'on allait construire.",
    "Cuando llegó el invierno, los hombres bajaron de la montaña con las ovejas y la casa volvió a llenarse de voces, de humo y de olor a pan recién hecho.",
    "Κάθε πρωί ο γέρος κατέβαινε στο λιμάνι, μιλούσε με τους ψαράδες για τον καιρό και γύριζε στο σπίτι του με δύο ψάρια τυλιγμένα σε μια παλιά εφημερίδα για τη γάτα.",
    "Утром он вышел из дома раньше обычного, потому что хотел успеть на первый поезд, но на станции ему сказали, что поезда сегодня не будет и что дорогу занесло снегом.",
]
RUNNING.append(" ".join(RUNNING[:2]) + " " + "By noon the water had fallen, and the men went down with shovels to see what was left of the mill, the two boats and the fence that had cost so much the year before.")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, None, "src" if k % 2 else None, None, k, 0.5, "x") for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block int, score double, cid string")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


def text_of(rows):
    return sorted(((i if i is not None else -1, t or "") for i, t in rows))


def test_bpe_equals_the_library(edge, empty):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary("byte_bpe_50k.tiktoken")), special_tokens={})
    got = bpe.encode_documents(edge, vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN, keep=True).collect()
    want = collections.Counter((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in EDGE)
    assert collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.n_tokens == len(r.ids) // 4 for r in got)
    assert bpe.encode_documents(empty, vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_packing_round_trip(edge, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = packing.pack_documents(edge, vocabulary("word_bpe_49k.json"), keep=True).collect()
    docs = collections.defaultdict(list)
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and 1 << r.bucket == r.length
        docs[r.doc_id].append(r)
    assert len({r.sequence_id for r in got}) == len(got)
    for i, text in EDGE:
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = sorted(docs[i], key=lambda r: (r.sequence_id, r.start))
        assert want in b"".join(bytes(r.ids) for r in pieces) and all(r.doc_tokens == len(want) // 4 for r in pieces if i not in (3, None))
    assert packing.pack_documents(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_workers_that_forget_words_code_as_before():
    import regex
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    from tetrad.llm.common import Cache, held

    cache = Cache(lambda keys: [k * 2 for k in keys], 3)
    for keys in ("ab", "bcd", "efghh"):
        cache.want(k for k in keys)
        assert all(cache[k] == 2 * k for k in keys)
    lots = [[sentence(30, 1), BASE], [BASE + " tail", "it's 123 a-b", ""], [sentence(9, 2)]]
    ranks = bpe.load_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = bpe.Pieces(bpe.Coder(ranks), regex.compile(P.PATTERN).findall, True, 3)
    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    with open(vocabulary("word_bpe_49k.json"), "rb") as f, open(vocabulary("piece_bpe_32k.model"), "rb") as g:
        words, model = packing.WordCoder(f.read(), 3), g.read()
    few, many = fertility.Vocabulary(model, 3), fertility.Vocabulary(model)
    for lot in lots:
        assert pieces.code(lot) == [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in lot]
        assert words.code(lot) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in lot]
        x, y = (fertility.measure(lot, v, fertility.BANDS) for v in (few, many))
        assert all(list(x[k]) == list(y[k]) for k in x)
    first = held("one", list)
    assert held("one", list) is first and held("two", dict) == {} and held("one", list) is not first


def test_words_on_both_sides_of_the_length_from_which_a_heap_contracts():
    import tiktoken

    ranks = bpe.load_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    core = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    r = np.random.default_rng(11)
    words = ["".join(r.choice(list("aeinrst"), n)) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3 * bpe.LONG)] + ["a" * (bpe.LONG - 2), "a" * (bpe.LONG + 2)]
    coder = bpe.Coder(ranks)
    assert coder.words(words) == [np.array(core.encode_single_piece(w.encode()), "<u4").tobytes() for w in words]
    assert coder.words(words) == [coder._long(w.encode()) for w in words]


def test_decoding_puts_lots_together(monkeypatch):
    ranks = bpe.load_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    coder = bpe.Coder(ranks)
    bodies = [bytes(range(256)) * 3, b"", b"\0\0", "naïve ☃".encode()]
    coded = [np.array([ranks[bytes([b])] for b in x], "<u4").tobytes() for x in bodies]
    assert coder.decode(coded) == bodies
    monkeypatch.setattr(bpe, "IDS", 7)
    assert coder.decode(coded) == bodies


@given(st.integers(1, 100_000))
def test_decomposition(n):
    parts = packing.decompose(n, 2048)
    assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)


def base_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, edge, empty):
    extra = spark.createDataFrame([(100, "a b c d e f g h i j " * 4 + "\nx|y\nx|y\n***"), (101, "word ".join(map(str, range(50))))], "doc_id long, text string")
    for df, rows in ((edge, EDGE), (extra, [(r.doc_id, r.text) for r in extra.collect()])):
        got = fertility.rule_measures(df, vocabulary("piece_bpe_32k.model")).collect()
        want = collections.Counter((i, *base_counts(t or "")) for i, t in rows)
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    kept = fertility.keep_documents(edge, vocabulary("piece_bpe_32k.model"))
    assert kept.columns == edge.columns and {14, 15}.isdisjoint({r.doc_id for r in kept.collect()})  # of nine words each
    running = spark.createDataFrame(list(enumerate(RUNNING)), "doc_id long, text string")
    assert {r.doc_id for r in fertility.keep_documents(running, vocabulary("piece_bpe_32k.model")).collect()} == set(range(len(RUNNING)))
    assert fertility.rule_measures(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def test_bands_tell_laden_texts_from_running_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = [r for r in fertility.rule_measures(docs, vocabulary("piece_bpe_32k.model")).join(labels, "doc_id").collect() if not r.base_failed]
    bad, good = ([r.kept for r in got if r.quality == q] for q in (0, 1))
    assert len(good) > 200 and all(good) and len(bad) > 15 and sum(bad) < 0.35 * len(bad)


@given(st.integers(1, 20_000))
def test_least_entropy_is_interpolated(n):
    floors = np.array([fertility.BANDS["LATIN"][2]])
    want = np.interp(np.log2(n), range(5, 13), floors[0]) if n >= 32 else floors[0][0] * np.log2(n) / 5
    assert math.isclose(fertility.least_entropy(floors, np.array([n]))[0], want, abs_tol=1e-9) and want <= max(6.45, np.log2(n))


def test_fertility_by_library(edge):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    r = fertility.rule_measures(edge, vocabulary("piece_bpe_32k.model")).where("doc_id = 14").first()
    ids = [i for w in sentence(80, 1).split() for i in sp.encode(w)]
    p = np.array(list(collections.Counter(ids).values())) / len(ids)
    assert math.isclose(r.chars_per_token, r.word_chars / len(ids)) and math.isclose(r.token_entropy, -(p * np.log2(p)).sum()) and r.script == "LATIN"


def test_texts_of_private_characters_fail(spark):
    r = np.random.default_rng(9)
    junk = " ".join("".join(map(chr, r.integers(0xE000, 0xF000, 5))) for _ in range(60))
    numbers = " ".join(map(str, r.integers(0, 10**6, 60)))
    got = {x.doc_id: x for x in fertility.rule_measures(spark.createDataFrame([(1, junk), (2, numbers)], "doc_id long, text string"), vocabulary("piece_bpe_32k.model")).collect()}
    assert got[1].script == got[2].script == "NONE" and not got[1].base_failed and not got[1].kept and got[2].kept


def test_shards(edge, empty):
    got = hilbert.hilbert_shards(edge, 5).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(got) == len(EDGE) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in EDGE)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    order = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in got}
    a, b = order[1, zlib.crc32(BASE.encode())], order[2, zlib.crc32(BASE.encode())]
    assert abs((a[0] - b[0]) * 100 + a[1] - b[1]) <= 100
    assert hilbert.hilbert_shards(empty).count() == 0


def test_shards_follow_the_curve(spark):
    """Against a plain sort by cell, and copies at the place of their first one."""
    r = np.random.default_rng(13)
    rows = [(i, " ".join(r.choice(WORDS, int(r.integers(1, 9)))), "ab"[i % 2], f"s{i % 5}") for i in range(300)] + [(1000 + i, "the same text", "ab"[i % 2], f"s{i % 7}") for i in range(200)]
    got = hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 7).collect()
    placed = [x.hilbert for x in sorted(got, key=lambda x: (x.shard, x.slot))]
    assert placed == sorted(placed) and len({x.hilbert for x in got if x.doc_id >= 1000}) == 1
    assert len(got) == len(rows)


def test_written_shards_hold_every_row(spark, edge, tmp_path):
    hilbert.write_shards(edge, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(str, back.select(*edge.columns).collect())) == sorted(map(str, edge.collect())) and back.select("__shard").distinct().count() == 4


def test_written_buckets_hold_equal_lengths(spark, edge, tmp_path):
    packing.write_buckets(packing.pack_documents(edge, vocabulary("word_bpe_49k.json"), keep=True), f"{tmp_path}/buckets")
    back = spark.read.parquet(f"{tmp_path}/buckets").collect()
    assert all(1 << r.bucket == r.length for r in back) and len(back) == packing.pack_documents(edge, vocabulary("word_bpe_49k.json")).count()


def test_groups_are_dealt_to_several_tasks(spark):
    from pyspark.sql import functions as F

    from tetrad.llm.common import attached

    rows = spark.range(1000).selectExpr("id", "IF(id < 700, NULL, id % 50) AS k", "id * 7 % 31 AS v")
    got = attached(rows.where("k IS NOT NULL"), ["k"], ["id"], [F.min("v").alias("m"), F.count("*").alias("n")], [F.min("m").alias("m"), F.sum("n").alias("n")], "left", "n > 5")
    want = rows.where("k IS NOT NULL").join(rows.groupBy("k").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("n > 5"), "k", "left")
    assert sorted(map(str, got.select("id", "k", "m", "n").collect())) == sorted(map(str, want.select("id", "k", "m", "n").collect()))


def test_hilbert_curve_is_one_path():
    for dims, bits in ((2, 4), (3, 3)):
        g = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1)
        path = g[:, np.argsort(hilbert.hilbert_index(list(g), bits))]
        assert np.abs(np.diff(path, axis=1)).sum(0).max() == 1


def test_fingerprints(spark, edge, empty):
    every = fingerprint.fingerprint_documents(edge, block_bytes=60_000).collect()
    got = {(r.doc_id, r.n_chars): r for r in every}
    rows = sorted(((i, t or "") for i, t in EDGE), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    edited = collections.Counter((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest()) for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in every) == edited
    assert all(0 <= r.near_edited <= 1 and (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint) for r in every)
    assert got[1, len(BASE)].fingerprint == got[2, len(BASE)].fingerprint and got[1, len(BASE)].near_next == 1.0
    assert fingerprint.fingerprint_documents(empty).count() == 0
    one = fingerprint.fingerprint_documents(edge.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].fingerprint == got[7, len(LONG)].fingerprint


def plain_hash(word):
    """The hash of a word, byte by byte."""
    low = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & low
        x = (x ^ x >> 27) * 0x94D049BB133111EB & low
        return x ^ x >> 31

    if len(word) > words.LONG:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    h = mix(len(word) * 0x9E3779B97F4A7C15 & low)
    for k in range(0, len(word), 8):
        h = mix(h * 0x9E3779B97F4A7C15 & low ^ int.from_bytes(word[k : k + 8], "little"))
    return h


@given(st.lists(st.text(alphabet=st.sampled_from("aAbZé \n\x0b\x1c☃0123456789"), max_size=60), max_size=8))
def test_words_are_hashed_alike_wherever_they_stand(bodies):
    h, sizes = words.hashed_words(bodies)
    assert h.tolist() == [plain_hash(w) for t in bodies for w in t.encode().lower().split()] and sizes.tolist() == [len(t.encode().split()) for t in bodies]


def test_long_words_are_hashed_whole():
    some = ["x" * n + t for n in (7, 8, 9, words.LONG - 1, words.LONG, words.LONG + 1, 5000) for t in "ab"]
    assert words.hashed_words([" ".join(some)])[0].tolist() == [plain_hash(w.encode()) for w in some]


def test_fingerprints_by_plain_sampling():
    """Term by term and sample by sample, with the same variates; and the terms of edited texts from their words."""
    r = np.random.default_rng(12)
    bodies = [" ".join(r.choice(WORDS, r.integers(0, 30))) + " " * int(r.integers(0, 3)) for _ in range(60)] + ["", "one", " one", LONG[:5000]]

    def plain_terms(text):
        h = [np.uint64(plain_hash(w)) for w in text.encode().lower().split()]
        with np.errstate(over="ignore"):
            keys = [int(fingerprint.mixed(np.array([a * np.uint64(3) + b * fingerprint._G]))[0]) for a, b in zip(h, h[1:])] if len(h) > 1 else [int(x) for x in h]
        return collections.Counter(keys)

    edited = [fingerprint.edit(t, u) for t, u in zip(bodies, bodies[1:])]
    got = fingerprint.batch_terms(bodies + edited)
    assert [dict(zip(t.tolist(), w.tolist())) for t, w in got] == [dict(plain_terms(t)) for t in bodies + edited]

    def plain(t, w):
        if not len(t):
            return [0] * 16
        v2, v1, a1 = fingerprint.variates(t, 16)
        part = -np.log(v2)
        rate = part - np.log(v1)
        clock = np.where((w > 1)[:, None], a1 * np.exp(-rate * np.floor((np.log(w.astype(np.float32))[:, None] + part) / rate)), a1)
        return clock.min(0).astype(np.float32).view(np.uint32).tolist()

    want = [plain(t, w) for t, w in got]
    assert fingerprint.signatures(got, 16).tolist() == want
    assert fingerprint.signatures(got, 16, 7).tolist() == want  # in lots, and long texts in parts


def test_sampling_is_unbiased():
    r = np.random.default_rng(5)
    err = []
    for _ in range(40):
        a = [str(x) for x in r.integers(0, 12, 300)]
        b = a[:150] + [str(x) for x in r.integers(0, 12, 150)]
        x, y = fingerprint.batch_terms([" ".join(a), " ".join(b)])
        s = fingerprint.signatures([x, y], 512)
        p, q = (dict(zip(*z)) for z in (x, y))
        true = sum(min(p.get(k, 0), q.get(k, 0)) for k in p | q) / sum(max(p.get(k, 0), q.get(k, 0)) for k in p | q)
        err.append(fingerprint.likeness(*s) - true)
    assert abs(np.mean(err)) < 0.01 and np.std(err) < 0.04


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_groups(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, s) in enumerate(sets):
        for j, u in sets[:k]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (find(i), len(s)) for i, s in sets}


def variants():
    r = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(90)]
        for _ in range(12):
            w = base.copy()
            for at in r.integers(0, 90, r.integers(0, 5)):
                w[at] = f"edit{n}x{at}"
            rows.append((1000 + n, " ".join(w)))
            n += 1
    return rows


def test_near_duplicates(spark, edge, empty):
    rows = variants() + [(5000 + k, t) for k, (_, t) in enumerate(EDGE) if t]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = near_groups(rows)
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    r = {x.doc_id: x for x in minhash.near_duplicates(edge).collect()}
    assert r[2].component_id == 1 and r[3].component_id == 1 and r[10].component_id == 9 and r[4].kept and r[5].n_shingles == 0
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and {2, 3, 10}.isdisjoint({x.doc_id for x in kept.collect()})


def test_sets_of_one_class_id_are_told_apart(spark, monkeypatch):
    plain = minhash._class_ids
    monkeypatch.setattr(minhash, "_class_ids", lambda sets, salt: plain(sets, salt) & 1 if salt == 0 else plain(sets, salt))
    rows = variants()[:14] + [(7000, BASE), (7001, BASE)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == near_groups(rows)


def test_bands_miss_no_pair_at_the_threshold():
    """Recall of pairs, without the help of other links: 3,000 pairs of similarity 0.75 share a band each."""
    r = np.random.default_rng(14)
    n, common = 3000, 60  # 60 of 80 in common
    sets = []
    for _ in range(n):
        x = r.integers(0, 2**63, 80).astype(np.uint64)
        sets += [np.sort(x[:70]), np.sort(np.concatenate([x[:common], x[70:]]))]
    assert all(minhash.similar(sets[2 * i], sets[2 * i + 1], 75) for i in range(50))
    low = minhash.minima(sets)
    keys, bits = minhash.band_keys(low), minhash.packed(low)
    assert (keys[::2] == keys[1::2]).any(1).all() and (minhash.estimate(bits[::2], bits[1::2]) >= minhash.LEAST_ESTIMATE).all()


def test_near_copies_without_an_id(spark):
    r = np.random.default_rng(7)

    def near(words, n):
        w = words.copy()
        w[int(r.integers(0, len(w)))] = f"edit{n}"
        return " ".join(w)

    rows, nameless = [], {}
    for g in range(8):  # which side of a pair a text is on goes by its hash
        words = [f"h{g}w{k}" for k in range(80 + g)]
        rows += [(100 + g, " ".join(words)), (None, near(words, g))]
        nameless[len(words) - 4] = 100 + g
    for g in range(4):
        words = [f"n{g}w{k}" for k in range(60 + g)]
        rows += [(None, " ".join(words)), (None, near(words, 50 + g))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.doc_id is not None and r.kept and r.component_id == r.doc_id} == set(nameless.values())
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles in nameless) == sorted((n, i, False) for n, i in nameless.items())
    assert all(r.component_id is None and r.kept for r in got if r.n_shingles not in nameless)


def test_bit_estimates():
    r = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        err = []
        for _ in range(30):
            a = r.integers(0, 2**63, 400).astype(np.uint64)
            n = int(400 * 2 * share / (1 + share))
            b = np.concatenate([a[:n], r.integers(0, 2**63, 400 - n).astype(np.uint64)])
            x, y = minhash.packed(minhash.minima([a, b]))
            err.append(minhash.estimate(x, y) - share)
        assert abs(np.mean(err)) < 0.03 and np.max(np.abs(err)) < 0.25


def test_components(spark):
    r = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {n: n for e in links for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}


def removed(rows):
    seen, out = set(), []
    for i, t in rows:
        b, mask = t.encode(), bytearray(len(t.encode()))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                mask[k : k + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(x for x, m in zip(b, mask) if not m)
        out.append((i, len(b), sum(mask), len(bytes(mask).replace(b"\0", b" ").split()), hashlib.sha256(rest).hexdigest()))
    return out


def test_repeats(spark, edge, empty, monkeypatch):
    rows = [(i, t) for i, t in EDGE if i != 7 and i is not None] + variants()[:30] + [(9000, "ab" * 400 + BASE[:150] + "\x00" * 210)]
    rows = sorted(((i, t or "") for i, t in rows))
    monkeypatch.setattr(repeats.repeated_bytes, "__defaults__", (20_000, 30_000, ()))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == collections.Counter(removed(rows))
    cut = repeats.cut_repeats(edge)
    assert cut.columns == edge.columns and cut.count() == len(EDGE) and cut.where("doc_id = 4").first().text is None and cut.where("doc_id = 2").first().text == ""
    assert repeats.remove_repeats(empty).count() == 0


def test_equal_identities_are_compared_by_bytes(spark, monkeypatch):
    flat = np.frombuffer(b"abcabdabcabd", np.uint8)
    start, sizes = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 3])
    told = repeats.told_apart(np.zeros(4, np.uint64), start, sizes, flat)
    assert told[0] == told[2] and told[1] == told[3] and told[0] != told[1]
    assert repeats.told_apart(np.zeros(2, np.uint64), start[:2], np.array([3, 2]), flat)[1] != 0
    # with identities of three bits all is as before
    plain = repeats.Stretches.__init__

    def short(self, *a):
        plain(self, *a)
        self.same = self.same & np.uint64(7)

    monkeypatch.setattr(repeats.Stretches, "__init__", short)
    rows = [(i, t) for i, t in EDGE if i not in (7, None)] + variants()[:12]
    blocks = [repeats.Block(repeats.pa.table({"doc_id": [i for i, _ in rows], "tag": list(range(len(rows))), "text": [t or "" for _, t in rows]}))]
    z = blocks[0].stretches
    same = repeats.told_apart(z.same, z.start, z.count + 99, blocks[0].flat)
    by = collections.defaultdict(set)
    for s, a, n in zip(same.tolist(), z.start.tolist(), (z.count + 99).tolist()):
        by[s].add(blocks[0].flat[a : a + n].tobytes())
    assert len(by) > 8 and all(len(x) == 1 for x in by.values())


def test_only_strings_that_may_recur_are_sorted(monkeypatch):
    r = np.random.default_rng(3)
    text = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    phrase, passage = text(60), text(130)
    # a phrase too short to be a repeat, and a passage in three texts that lacks its ends in one
    rows = [(i, text(150) + phrase + text(150)) for i in range(40)] + [(50, text(99) + passage + text(99)), (51, text(99) + passage + text(99)), (52, text(99) + passage[10:-5] + text(99))]
    block = repeats.Block(repeats.pa.table({"doc_id": [i for i, _ in rows], "tag": [0] * len(rows), "text": [t for _, t in rows]}))
    z, sizes, sorted_at = block.stretches, block.stretches.count + 99, []
    row = np.searchsorted(block.ends, z.start, side="right")
    begin = z.start - np.concatenate([[0], block.ends[:-1]])[row]
    plain = repeats.suffix_array
    monkeypatch.setattr(repeats, "suffix_array", lambda t: sorted_at.append(len(t)) or plain(t))
    strings = np.concatenate([block.flat[a : a + n] for a, n in zip(z.start, sizes)])
    entries = {"anchor": z.anchor, "same": z.same, "count": z.count, "doc": block.id[row], "tag": block.tag[row], "start": begin}
    bits = repeats._judge(entries, strings, np.cumsum(sizes) - sizes)
    seen, want = set(), np.zeros_like(bits)
    for i in np.argsort(z.start):
        for k in range(z.count[i]):
            w = block.flat[z.start[i] + k : z.start[i] + k + 100].tobytes()
            want[i, k] = w not in seen
            seen.add(w)
    assert (bits == want).all() and not want[:, :69].all()
    # at most the passage and its cuts, each anchor's stretches apart; every text with the phrase was sorted before
    assert 0 < sum(sorted_at) < 2_000


def test_hashes_do_not_depend_on_the_place():
    t = np.random.default_rng(4).integers(0, 256, 2 * repeats.STEP + 300).astype(np.uint8)
    h = repeats.Hashes(t)
    plain = lambda w: sum((int(b) + 1) * pow(repeats._B, len(w) - 1 - i, 1 << 64) for i, b in enumerate(w)) % (1 << 64)
    at = np.array([0, 1, repeats.STEP - 50, repeats.STEP, 2 * repeats.STEP + 7, len(t) - 100])
    assert h.at(at, 100).tolist() == [plain(t[a : a + 100]) for a in at]
    assert h.row(repeats.STEP, 200, 32).tolist() == h.at(np.arange(200) + repeats.STEP, 32).tolist()
    # the stretches of a text are the same wherever it lies, over bounds of steps too
    one, size = t[: repeats.STEP + 500], repeats.STEP + 500
    alone = repeats.Stretches(one, np.array([size]))
    moved = repeats.Stretches(np.concatenate([t[:777], one]), np.array([777, 777 + size]))
    mine = moved.start >= 777
    assert (moved.start[mine] - 777).tolist() == alone.start.tolist()
    assert all((getattr(moved, k)[mine] == getattr(alone, k)).all() for k in ("count", "at", "anchor", "same"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(2, 9))
def test_recursion_of_suffix_arrays(values, base):
    t, b = np.array(values * 3, np.uint8), bytes(values * 3)
    before, suffix.BASE = suffix.BASE, base
    try:
        assert suffix.suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    finally:
        suffix.BASE = before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_suffix_arrays(values):
    t = np.array(values, np.uint8)
    order, b = suffix.suffix_array(t), t.tobytes()
    assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    common = suffix.permuted_common_prefixes(t, order, 16)
    for k in range(1, len(b)):
        x, y = b[order[k] :], b[order[k - 1] :]
        assert common[order[k]] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q or i == 16), min(len(x), len(y), 16))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=300, unique=True), st.integers(0, 60))
def test_keys_and_counts_travel_whole(keys, shift):
    x = np.sort(np.array(keys, np.uint64) >> np.uint64(shift))
    data = backoff.squeezed(x)
    assert backoff.expanded(data).tolist() == x.tolist() and backoff.count_of(data) == len(x)
    counts = (x >> np.uint64(4)).astype(np.int64)
    assert backoff.unplaned(backoff.planes(counts)).tolist() == counts.tolist()
    mixed = x[::-1].copy()
    assert backoff.in_order(mixed).tolist() == np.argsort(mixed, kind="stable").tolist() == backoff.in_order(mixed, 64 - shift).tolist()


@pytest.mark.parametrize("order", [2, 3])
def test_backoff(spark, edge, empty, order):
    rows = [(i, t or "") for i, t in EDGE]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, round(r.log_score, 4), r.backed_off) for r in backoff.backoff_scores(edge, order, block_bytes=50_000).collect())
    words = [(i, t.encode().lower().split()) for i, t in rows]
    count, total = collections.Counter(), sum(len(w) for _, w in words)
    grams = lambda w: collections.Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    for _, w in words:
        count.update(grams(w))
    want = []
    for i, w in words:
        own, s, back = grams(w), 0.0, 0
        for k in range(len(w)):
            most = min(k + 1, order)
            for n in range(most, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                c = count[g] - own[g]
                if n == 1 or c > 0:
                    under = total - len(w) + 1 if n == 1 else max(count[g[:-1]] - own[g[:-1]], c)
                    s += math.log(max(c, 1) / under) + (most - n) * math.log(0.4)
                    back += n < most
                    break
        want.append((i if i is not None else -1, len(w), s, back))
    for x, y in zip(got, sorted(want)):
        assert x[:2] == y[:2] and x[3] == y[3] and math.isclose(x[2], y[2], rel_tol=1e-6, abs_tol=1e-3)
    assert backoff.backoff_scores(empty).count() == 0


def test_registered_backoff_looks_two_words_back(spark, tmp_path):
    from tetrad.llm.queries import op5_stupid_backoff

    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x b c"), (4, "x b d")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (round(r.log_score, 6), r.backed_off) for r in op5_stupid_backoff(spark, str(tmp_path)).collect()}
    bigrams, trigrams = ({r.doc_id: (round(r.log_score, 6), r.backed_off) for r in backoff.backoff_scores(docs, n).collect()} for n in (2, 3))
    assert got == trigrams and got != bigrams


def test_automaton_finds_what_edit_distance_finds():
    trie = toxicity.Trie(["idiot", "moron", "worthless", "scum"])
    for w, hit in [("idiot", (0, 0)), ("idoit", (0, 1)), ("idiott", (0, 1)), ("diot", (0, 1)), ("moran", (1, 1)), ("wortless", (2, 1)), ("scam", None), ("scum", (3, 0)), ("idt", None), ("worths", None)]:
        assert trie.find(w) == hit, w
    m = toxicity.Model(["idiot", "moron"], [2.0, 2.0])
    assert m.code("1d10t!") and m.code("m0r0n") and m.code("idiooooot") and not m.code("patriot")


def test_automaton_equals_a_table_of_edits():
    r = np.random.default_rng(15)
    terms = sorted({"".join(r.choice(list("abcd"), int(r.integers(3, 9)))) for _ in range(60)})
    trie = toxicity.Trie(terms)

    def distance(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    hits = 0
    for _ in range(1500):
        w = "".join(r.choice(list("abcd"), int(r.integers(1, 10))))
        found = [(distance(w, t), k) for k, t in enumerate(terms)]
        best = min(((d, k) for d, k in found if d <= toxicity.edits_allowed(terms[k]) and (d == 0 or len(w) >= 4)), default=None)
        assert trie.find(w) == (best and (best[1], best[0])), w
        hits += best is not None
    assert hits > 100


def test_lexicon_equals_a_plain_count(spark):
    r = np.random.default_rng(16)
    rows = []
    for i in range(500):
        y = int(i % 9 == 0)
        w = list(r.choice([f"w{k}" .replace("0", "o").replace("1", "l") for k in range(40)] + ["alpha", "beta", "gamma"], 12))
        w += (["vile"] if y and i % 2 else []) + (["rare"] if y and i < 30 else []) + (["nasty"] if r.random() < (0.9 if y else 0.02) else [])
        rows.append((" ".join(w), y))
    terms, weights = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    count = {y: collections.Counter(w for t, z in set(rows) if z == y for w in set(t.split()) if w.isalpha() and len(w) > 2) for y in (0, 1)}
    n1, n0 = (sum(z == y for _, z in set(rows)) for y in (1, 0))
    tested, gains = [w for w in count[0] | count[1] if count[0][w] + count[1][w] >= 4], {}
    for w in tested:
        a, b = count[1][w], count[0][w]
        odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if odds > math.log(20):
            gains[w] = 2 * sum(x * math.log(x / ((a + b) * s / (n1 + n0))) for x, s in ((a, n1), (b, n0)) if x), odds / math.log(20)
    ranked = sorted(gains, key=lambda w: (-gains[w][0], w))
    passed = [k for k, w in enumerate(ranked, 1) if math.erfc(math.sqrt(gains[w][0] / 2)) <= 0.05 * k / len(tested)]
    want = {w: gains[w][1] for w in ranked[: passed[-1]]}
    assert {"vile", "nasty"} <= set(want) and set(terms) == set(want) and all(math.isclose(x, want[t]) for t, x in zip(terms, weights))


def test_labels_that_disagree_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    assert sorted(map(tuple, toxicity.labelled(docs, labels, "toxic", lambda i: F.lit(False)).collect())) == [(1, "a", 1), (2, "", 0)]


def test_quotation_is_told_from_abuse():
    m = toxicity.Model(["idiot"], [2.0])
    (x, _, q), (y, _, p) = m.features('she wrote that the word "idiot" is rude'), m.features("you are such an idiot really")
    assert q == 1 and p == 0 and x[1] < y[1]


def test_toxicity_learns(spark, edge, empty):
    r = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = list(r.choice(WORDS, 60)) + (["vilething"] * 2 if bad else [])
        docs.append((i, " ".join(r.permutation(w))))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.train_model(d, y, lambda i: fold(i, 4) == 2)
    got = {r.doc_id: r.score for r in toxicity.score_documents(d, m).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, t in labels)
    assert toxicity.score_documents(edge, m).count() == len(EDGE) and toxicity.score_documents(empty, m).count() == 0
    assert toxicity.drop_toxic(edge, m).columns == edge.columns and toxicity.drop_toxic(edge, m).count() == len(EDGE)
    none = toxicity.train_model(d, y.where("false"))
    assert {r.score for r in toxicity.score_documents(d, none).collect()} <= {toxicity.Model([], []).score([1.0, 0, 0, 0, 0])}


def test_quality_learns(spark, edge, empty):
    r = np.random.default_rng(6)
    docs, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        w = list(r.choice(WORDS, r.integers(20, 90)))
        docs.append((i, " ".join(x + ("%%%" if bad else "") for x in w)))
        labels.append((i, int(not bad)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    m = quality.train_model(d, y, lambda i: fold(i, 5) == 0)
    got = {r.doc_id: r.score for r in quality.score_documents(d, m).collect()}
    assert all((got[i] >= 0.3) == bool(q) for i, q in labels)
    scores = [r.score for r in quality.score_documents(edge, m).collect()]
    assert len(scores) == len(EDGE) and all(0 <= s <= 1 for s in scores)
    assert quality.score_documents(empty, m).count() == 0
    assert {r.score for r in quality.score_documents(edge, quality.train_model(d, y.where("false"))).collect()} == {0.5}


def test_discriminant_is_the_log_density_ratio():
    r = np.random.default_rng(8)
    n = len(quality.NAMES)
    x = {0: r.normal(0, 1, (400, n)), 1: r.normal(1, 2, (400, n))}
    m = quality.Discriminant({k: (400, v.sum(0), v.T @ v) for k, v in x.items()}, pooled=0.0, diagonal=0.0)
    p = r.normal(0, 1, (5, n))

    def log_density(k):
        mean, cov = x[k].mean(0), np.cov(x[k].T, bias=True) + 1e-4 * np.eye(n)
        d = p - mean
        return -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])

    assert np.allclose(m.difference(p), log_density(1) - log_density(0))


def test_pipeline_on_the_small_tables(spark, sf):
    """Every stage against plain rules on its own input."""
    import corpus_pipeline as c

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    stages = dict(c.STAGES)
    rows_of = lambda df: {r.doc_id: r.text for r in df.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    given_ = rows_of(docs)
    clean = stages["toxicity"](spark, docs, sf).cache()
    kept = rows_of(clean)
    assert clean.columns == columns and set(kept) < set(given_) and len(toxic - set(kept)) >= 0.6 * len(toxic) and len(kept) >= len(given_) - 3 * len(toxic)

    ruled = stages["quality rules"](spark, clean, sf).cache()
    fine = rows_of(ruled)
    counts = {i: base_counts(t) for i, t in kept.items()}
    failed = {i for i, x in counts.items() if x[0] < 20 or 100 * x[4] > 30 * x[0]}
    assert ruled.columns == columns and failed.isdisjoint(fine) and len(fine) >= 0.85 * (len(kept) - len(failed))

    one = stages["MinHash near-dedup"](spark, ruled, sf).cache()
    left = rows_of(one)
    groups = near_groups(sorted(fine.items()))
    assert one.columns == columns and set(left) == {i for i, (least, _) in groups.items() if i == least} and len(left) < len(fine)

    cut = stages["suffix-array dedup"](spark, one, sf).cache()
    short, sizes = rows_of(cut), {i: n for i, _, n, _, _ in removed(sorted(left.items()))}
    assert cut.columns == columns and set(short) == set(left) and all((short[i] == left[i]) == (n == 0) and len(short[i].encode()) >= len(left[i].encode()) - n - 6 * (n > 0) for i, n in sizes.items())
    assert any(sizes.values()) and all(r.n_chars == len(r.text) for r in cut.collect())

    pieces = stages["packing"](spark, cut, sf).collect()
    total = collections.Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert set(total) == set(short) and all(total[r.doc_id] == r.doc_tokens for r in pieces)
