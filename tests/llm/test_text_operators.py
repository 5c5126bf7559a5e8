"""Operators over documents: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isoloom.llm import bpe, media, ngram_join, packing, quality, suffix_dedup, textkernel, toxicity

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, key long, kind string, marks string, h long, _text string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "k", "m", 2, "x") for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice(["the", "on", "er", "ti", "na", "é", "sch"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, out = say(30), []
    for i in range(n):
        kind = r.random()
        if kind < 0.3 and out:
            base = r.choice(out)[1].split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                base[r.randrange(len(base))] = r.choice(words)
            out.append((i, " ".join(base)))
        elif kind < 0.5:
            out.append((i, f"{say(r.randint(1, 40))} {passage} {say(r.randint(0, 40))}"))
        else:
            out.append((i, say(r.randint(1, 120))))
    return out


ODD = [(1000, None), (1001, ""), (1002, "  \n\t"), (1003, "one"), (1004, "one"), (1005, "a b c"), (1006, "x" * 70000), (1007, "long word " * 9000), (1008, "Straße İstanbul Σίσυφος <|endoftext|> 日本 😀"), (None, "no id")]


def test_word_spans_match_a_plain_split():
    texts = ["", " a", "b ", "c", "\td\ne", "é è", "x"]
    for _, _, buf, offsets in textkernel.text_chunks(pa.array(texts), 5):
        starts, ends, bounds = textkernel.word_spans(buf, offsets)
        words = [bytes(buf[s:e]) for s, e in zip(starts, ends, strict=True)]
        for i in range(len(offsets) - 1):
            assert words[bounds[i] : bounds[i + 1]] == bytes(buf[offsets[i] : offsets[i + 1]]).split()


# ---- suffix arrays ----


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 4))
def test_suffix_array_and_prefixes(letters, times):
    t = np.array(letters * times)
    sa = suffix_dedup.suffix_array(t)
    plain = t.tolist()
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: plain[i:])
    plcp = suffix_dedup.permuted_lcp(t.astype(np.uint8), sa)
    for a, b in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
        n = 0
        while max(a, b) + n < len(t) and plain[a + n] == plain[b + n]:
            n += 1
        assert plcp[a] == n


def removed_by_hand(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                hit[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if hit[k] and not (k and hit[k - 1]))
        out[i] = (len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest())
    return out


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup_against_all_windows(spark, most):
    rows = [*corpus(3), *ODD[:-1], (2000, "ab" * 400), (2001, "é" * 300)]
    nameless = (None, rows[0][1] * 3)
    got = suffix_dedup.digests(table(spark, [*rows, nameless]).repartition(5), most=most, shard_bytes=3000).collect()
    size = len(nameless[1].encode())
    assert {r[0]: tuple(r)[1:] for r in got} == {**removed_by_hand(rows, 100), None: (size, 0, 0, hashlib.sha256(nameless[1].encode()).hexdigest())}
    assert len(got) == len(rows) + 1


def test_suffix_dedup_repeated_rows_and_empty(spark):
    rows = [(1, "word " * 60), (1, "word " * 60), (2, "other text " * 30)]
    got = suffix_dedup.digests(table(spark, rows)).collect()
    want = removed_by_hand([rows[0], rows[2]], 100)
    assert sorted(tuple(r) for r in got) == sorted([(1, *want[1]), (1, *want[1]), (2, *want[2])])
    assert suffix_dedup.digests(table(spark, [])).collect() == []
    kept = {r.doc_id: r.kept for r in suffix_dedup.kept(table(spark, [(1, "a" * 150), (2, "a" * 120)])).collect()}
    assert kept == {1: b"", 2: b""} or kept[2] == b""


# ---- joins ----


def linked_by_hand(rows, n, num, den):
    sets = {}
    for i, text in rows:
        words = ("".join(c.lower() if c.isascii() else c for c in text or "")).split()
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("parameters", [{}, {"long": 3, "block": 2}, {"survey": 2, "block": 3}])
def test_ngram_join_against_all_pairs(spark, parameters):
    rows = [*corpus(5, 90), *ODD[:-1]]
    want = linked_by_hand(rows, 4, 85, 100)
    for text, component in (("no id", None), (rows[3][1], want[rows[3][0]][1])):
        got = ngram_join.joined(table(spark, [*rows, (None, text)]), 4, 85, 100, **parameters).collect()
        assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == want
        assert [r[2] for r in got if r[0] is None] == [component]


def test_ngram_join_group_headed_by_a_much_longer_document(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(200)]
    rows = [(0, " ".join([*base, *(f"z{i}" for i in range(60))]))]
    for i in range(10):
        words = list(base)
        words[10 + 18 * i] = f"q{i}"
        rows.append((1 + i, " ".join(words)))
    got = {x[0]: (x[1], x[2]) for x in ngram_join.joined(table(spark, rows), 4, 85, 100, long=3).collect()}
    assert got == linked_by_hand(rows, 4, 85, 100)
    assert {got[i][1] for i in range(1, 11)} == {1} and got[0][1] == 0


@pytest.mark.parametrize("parts", [1, 12])
def test_ngram_join_heads_of_other_sizes_over_many_parts(spark, parts):
    """Near copies headed by a document that holds their text and much more, so that no head links; seen too seldom in a task to be known as frequent."""
    r = random.Random(8)
    base = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(260)]
    rows = [(0, " ".join([*base, *(f"z{i}" for i in range(200))]))]
    for i in range(60):
        words = list(base)
        words[4 * i] = f"q{i}"
        rows.append((1 + i, " ".join(words)))
    for i in range(20):  # others that share nothing
        rows.append((100 + i, " ".join("".join(r.choice("klmnop") for _ in range(8)) for _ in range(60))))
    got = {x[0]: (x[1], x[2]) for x in ngram_join.joined(table(spark, rows).repartition(parts), 5, 80, 100).collect()}
    assert got == linked_by_hand(rows, 5, 80, 100)
    assert {got[i][1] for i in range(1, 61)} == {1} and got[0][1] == 0


def test_ngram_join_product_is_no_larger_over_more_tasks(spark, monkeypatch):
    """Near copies share n-grams in every task: what a task tells of them is a row a column, not a row a pair and task."""
    rows = []
    for group in range(12):
        words = [f"w{group}x{i}" for i in range(300)]
        rows += [(10 * group + i, " ".join([*words, f"end{i}"])) for i in range(6)]

    class Made(Exception):
        pass

    def counted(df, name, written=ngram_join.written):
        made = written(df, name)
        if name == "product":
            raise Made(made.count())
        return made

    monkeypatch.setattr(ngram_join, "written", counted)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    made = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (2, 16):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            with pytest.raises(Made) as told:
                ngram_join.joined(table(spark, rows))
            made.append(told.value.args[0])
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert made[0] == made[1] > 0


def test_ngram_join_empty_and_defaults(spark):
    assert ngram_join.joined(table(spark, [])).collect() == []
    rows = [(5, "a b c d e f g h i j k l"), (3, "A B C D E F G H I J K L"), (4, ""), (6, None)]
    got = ngram_join.joined(table(spark, rows)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {5: (8, 3), 3: (8, 3), 4: (0, 4), 6: (0, 6)}


# ---- tokens ----


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(TOKENIZER)


def test_bpe_is_the_librarys(spark, tokenizer):
    rows = [*corpus(7, 40), *ODD]
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(table(spark, rows), TOKENIZER).collect()}
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    full = bpe.encoded(table(spark, rows), TOKENIZER)
    texts = {r.doc_id: r.text for r in bpe.decoded(full, TOKENIZER).collect()}
    assert texts[1008] == tokenizer.decode(tokenizer.encode(ODD[8][1], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.digests(table(spark, []), TOKENIZER).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="thenringsotaiue'ß.é9", min_size=1, max_size=24))
def test_bpe_words(word):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER) if not hasattr(test_bpe_words, "t") else test_bpe_words.t
    test_bpe_words.t = library
    assert bpe.encoder(TOKENIZER).encode_words([word])[0] == library.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "acgt", "a", "ab"])
def test_bpe_very_long_words(letters, tokenizer):
    import time

    r = random.Random(3)
    word = "".join(r.choice(letters) for _ in range(100_000))
    e = bpe.Encoder(TOKENIZER)
    began = time.process_time()
    symbols = e.symbols(word)
    ids = e.merged(symbols)
    assert time.process_time() - began < 2
    assert ids == tokenizer.encode(word, add_special_tokens=False).ids == e.encode_words([word])[0]


def test_packing_cuts_every_id_once(spark, tokenizer):
    rows = [*corpus(9, 50), *ODD, (1003, "one")]
    got = packing.packed(table(spark, rows).repartition(3), TOKENIZER, window=256, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, text in dict(rows).items():
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        times = sum(1 for j, _ in rows if j == i)
        assert sum(p[1] for p in pieces[i]) == times * len(want) and {p[3] for p in pieces[i]} == {len(want)}
        if times == 1:
            assert [t for p in sorted(pieces[i]) for t in p[2]] == want
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        padding += 0 if not at & (at - 1) else 256 - at
    assert padding == 0
    assert packing.packed(table(spark, []), TOKENIZER).collect() == []


def test_packer_prefers_the_level_of_smallest_squares():
    p = packing.Packer(10, 0)
    for size in (6, 6, 4):
        p.add(size, np.zeros(size, np.uint32))
    assert p.levels[6] == 1 and len(p.out) == 2  # the last one filled a window of 6


# ---- quality ----


def test_quality_counts_and_edges(spark):
    text = "a b c d e f g h\na b c d e f g h\n\nx"
    rows = [(1, text), (2, None), (3, ""), (4, "w " * 19), (5, "one two three four five six seven eight nine ten. " * 40), (6, "SHOUT!! " * 30), (None, "x y")]
    got = {r.doc_id: r for r in quality.judged(table(spark, rows)).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_dup_lines, got[1].n_repeat_words) == (17, 17, 1, 16)
    assert got[1].base_failed and got[4].base_failed and got[4].n_repeat_words == 19 and got[5].n_repeat_words == 400
    assert got[2].n_words == got[3].n_words == 0 and got[2].base_failed and not got[3].kept
    assert None in got and len(got) == len(rows)
    assert quality.judged(table(spark, [])).collect() == []


def test_quality_repeated_rows_and_very_long_texts(spark):
    r = random.Random(21)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(120_000))
    rows = [(1, "a b c " * 30), (1, "a b c " * 30), (1, "other text of the same id"), (2, long), (3, "x" * 300_000)]
    got = quality.judged(table(spark, rows), keep=("doc_id", "text", "lang")).collect()
    assert sorted((g.doc_id, g.n_words) for g in got) == [(1, 6), (1, 90), (1, 90), (2, 120_000), (3, 1)]
    assert all(g.row.text == dict(enumerate(t for _, t in rows))[i] for g in got for i in [next(k for k, (_, t) in enumerate(rows) if t == g.row.text)])
    assert next(g for g in got if g.doc_id == 2).n_repeat_words == 0


def test_quality_filters_do_not_split_texts_again(spark):
    rows = [(1, "the cat and the dog " * 2), (2, "of the " + " ".join(f"word{i}" for i in range(20_000))), (3, "the " * 9000), (4, None)]
    judged = quality.judged(table(spark, rows), keep=("doc_id", "text"))
    kept = judged.where("kept AND n_words > 100 AND n_repeat_words < 5").select("row.*")
    plan = kept._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("Filter" in line for line in plan) and not any("Filter" in line and "split(" in line for line in plan)
    assert [(r.doc_id, r.text) for r in kept.collect()] == [rows[1]]


def test_quality_accuracies_follow_the_votes(spark):
    """The prior is worth ten documents: where many vote, the estimate is theirs."""
    patterns = [(sum(2 * 3**i for i in range(len(quality.RULES))), 50_000), (sum(2 * 3**i for i in range(1, len(quality.RULES))), 10_000)]
    got = {(r.rule, r.vote): r for r in quality.accuracies(spark.createDataFrame(patterns, "pattern int, n long")).collect()}
    assert abs(got["shouting", 1].good - 1) < 0.001 and got["shouting", 1].good != 0.9
    assert abs(sum(got["symbols", v].good for v in (-1, 0, 1)) - 1) < 1e-9


def test_quality_prefers_clean_texts(spark):
    rows = corpus(11, 60)
    clean = [(i, " ".join(f"the {w} of" for w in t.split())) for i, t in rows if len(t.split()) > 30]
    junk = [(5000 + i, " ".join(f"{w.upper()}!!%%%" for w in t.split())) for i, t in rows if len(t.split()) > 30][:5]
    got = {r.doc_id: r for r in quality.judged(table(spark, clean + junk)).collect()}
    assert all(got[i].kept or got[i].base_failed for i, _ in clean)
    assert not any(got[i].kept for i, _ in junk)


# ---- toxicity ----


def test_toxicity_learns_a_word_and_finds_its_sentence(spark):
    r = random.Random(2)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(r.choice(words) for _ in range(8)) for _ in range(r.randint(2, 6))]
        toxic = int(r.random() < 0.2)
        if toxic:
            sentences[r.randrange(len(sentences))] += " scoundrel here"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, 1, toxic))
    docs, marks = table(spark, [*rows, *ODD]), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.scored(docs, marks).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held)
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert len(got) == len(rows) + len(ODD) and got[1000].score == got[1001].score
    model = toxicity.train(docs, marks)
    worst = toxicity.score(docs, model, locate=True).where("score > 0.7").collect()
    text = dict(rows)
    assert worst and all("scoundrel" in text[w.doc_id].encode()[w.worst_start : w.worst_end].decode() for w in worst)
    assert toxicity.scored(table(spark, []), marks).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(x.predicted == 0 for x in toxicity.scored(docs, none).collect())


def test_noisy_or_against_a_plain_computation(spark):
    """Scores from the model's weights, one word, sentence and document at a time."""
    import math
    import re

    rows = [*corpus(17, 40), (500, "One. two two! three\nfour? FIVE"), (501, "..."), *ODD[:6], ODD[8], ODD[9]]
    r = np.random.default_rng(5)
    model = toxicity.Model(np.where(r.random(1 << toxicity.BUCKET_BITS) < 0.3, r.random(1 << toxicity.BUCKET_BITS) * 4, 0).astype(np.float32), -5.0, 0.25)

    def bucket(word: bytes) -> int:
        buf = np.frombuffer(word, np.uint8)
        return int(textkernel.span_hash(textkernel.prefix_hash(buf, lower=True), np.array([0]), np.array([len(word)]))[0]) >> (64 - toxicity.BUCKET_BITS)

    def plain(text: str) -> float:
        survive = 1.0
        some = False
        for sentence in re.split(rb"[\n!.?]", text.encode()):
            words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
            if words:
                some = True
                z = model.bias + sum(float(model.weights[bucket(w[:n] if n else w)]) for w in words for n in toxicity.FEATURES)
                survive *= 1 - 1 / (1 + math.exp(-z))
        return 1 - survive if some else model.prior

    got = sorted((x.doc_id or -1, x.score) for x in toxicity.score(table(spark, rows), model).collect())
    assert got == [(i, pytest.approx(s, abs=2e-6)) for i, s in sorted((i or -1, plain(t or "")) for i, t in rows)]


def test_toxicity_repeated_rows_train_once(spark, monkeypatch):
    rows = [(0, "b"), (0, "a"), (0, "b")] * 5 + [(2, None), (2, None)]
    marks = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, epochs: taken.append((texts.to_pylist(), y.tolist())))
    toxicity.train(table(spark, rows), marks)
    assert taken in ([(["a", None], [True, False])], [(["a"], [True])], [([None], [False])])


def test_toxicity_learns_words_of_rare_labels():
    r = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(12)) for _ in range(2400)]
    toxic = np.zeros(2400, bool)
    toxic[::300] = True
    texts = [t + " scoundrel here" if y else t for t, y in zip(texts, toxic, strict=True)]
    model = toxicity.fit(pa.array(texts, pa.large_string()), toxic)
    _, _, buf, offsets = next(iter(textkernel.text_chunks(pa.array(texts, pa.large_string()))))
    buckets, first, bounds, _, _ = toxicity.sentences(buf, offsets)
    flagged = toxicity.noisy_or(model, buckets, first, bounds)[0] >= toxicity.THRESHOLD
    assert (flagged == toxic[: len(flagged)]).all()


def test_toxicity_sample_follows_the_hash_and_passes_over_what_does_not_fit(spark, monkeypatch):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect()]
    big = order[1]
    rows = [(i, f"d{i} ".ljust(1000 if i == big else 100, "x")) for i in ids]
    marks = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, epochs: taken.extend(texts.to_pylist()))
    toxicity.train(table(spark, rows), marks, sample_bytes=500)
    assert {int(t.split()[0][1:]) for t in taken} == set([i for i in order if i != big][:5])


# ---- media ----


def test_media_round_trip(spark):
    rows = [*corpus(13, 10), *ODD]
    got = {r.doc_id: r for r in media.digests(table(spark, rows)).collect()}
    for i, text in rows:
        b = (text or "").encode()
        payload = b.ljust(max(1, -(-len(b) // 576)) * 576, b"\xff")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.text_image(b)).hexdigest() and r.media_bytes == len(media.text_image(b))
    assert got[1003].feature == got[1004].feature
    assert media.digests(table(spark, [])).collect() == []
    images = media.text_media(table(spark, rows))
    assert all(r.error is None and r.width == 24 for r in media.features(images).collect())


def test_media_feature_against_a_plain_computation(spark):
    """The difference hash from cell means added up sample by sample, in fractions."""
    from fractions import Fraction

    rows = [*corpus(19, 8), (700, ""), (700, ""), (701, "z" * 4000)]
    got = {r.doc_id: r.feature for r in media.digests(table(spark, rows)).collect()}
    assert media.digests(table(spark, rows)).count() == len(rows)

    def share(i, n, cells):  # how much of cell c (of `cells` over n samples) sample i is
        return {c: part for c in range(i * cells // n, ((i + 1) * cells - 1) // n + 1) if (part := min(Fraction(i + 1), Fraction((c + 1) * n, cells)) - max(Fraction(i), Fraction(c * n, cells))) > 0}

    for i, text in dict(rows).items():
        b = text.encode()
        b = b.ljust(max(1, -(-len(b) // 576)) * 576, b"\xff")
        high, wide = len(b) // 24, 24
        down, along = [share(y, high, 8) for y in range(high)], [share(x, wide, 9) for x in range(wide)]
        cells = [[Fraction(0)] * 9 for _ in range(8)]
        for y in range(high):
            line = [Fraction(0)] * 9
            for x in range(wide):
                for c, part in along[x].items():
                    line[c] += part * b[y * wide + x]
            for r, part in down[y].items():
                for c in range(9):
                    cells[r][c] += part * line[c]
        area = Fraction(high, 8) * Fraction(wide, 9)
        bits = "".join("1" if round(float(row[c] / area), 6) < round(float(row[c + 1] / area), 6) else "0" for row in cells for c in range(8))
        assert got[i] == f"{int(bits, 2):016x}"


def test_media_formats_and_area_resize():
    r = np.random.default_rng(3)
    grey = r.integers(0, 256, (37, 23), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    assert media.decode(b"P2\n# comment\n2 1\n15\n0 15\n").tolist() == [[0, 255]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n9 1\n" + bytes([0b10000000, 0b10000000])).tolist() == [[0, *[255] * 7, 0]]
    assert media.decode(b"P6\n1 1\n255\nabc").tolist() == [[[97, 98, 99]]]
    assert abs(media.resize(grey, 1, 1)[0, 0] - grey.mean()) < 1e-9
    big = np.repeat(np.repeat(grey, 9, 0), 7, 1)
    assert np.allclose(media.resize(big, 37, 23), grey)
    tall = np.tile(grey, (300, 1))
    whole = media.resize(tall, 8, 9)
    media.STRIP_ROWS, old = 100, media.STRIP_ROWS
    assert np.allclose(media.resize(tall, 8, 9), whole)
    media.STRIP_ROWS = old
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")
