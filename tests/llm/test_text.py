"""Language model (1), fingerprints (4), packing (5), license scan (7), BPE (8) and token counts (10)."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import bpe_codec, bytescan, class_lm, license_scan, merkle, packing, token_counts
from keyloom.llm.queries import word_bpe_path
from keyloom.llm.word_bpe import WordBpe

from .brute import edit_distance
from .helpers import edge_frame, edge_rows, empty_frame, same_rows

# -- language model ----------------------------------------------------------


def test_classes_dont_depend_on_blocks(spark):
    rng = random.Random(9)
    common = [f"{x}{k}" for x in "ab" for k in range(20)]
    rare = [f"rare{k}" for k in range(500) for _ in range(4)]
    rng.shuffle(rare)
    rows = []
    for i in range(400):
        words = [rng.choice(common[20:] if k % 2 else common[:20]) for k in range(100)]
        for w in rare[5 * i : 5 * i + 5]:
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r["doc_id"]: (r["score"], r["base_score"]) for r in class_lm.score_documents(frame).collect()} for frame in (df.coalesce(1), df.repartition(9)))
    assert all(many[k] == pytest.approx(one[k], rel=1e-9) for k in one)


def language_rows(n=300, seed=5):
    rng = random.Random(seed)
    tongues = [["le", "la", "et", "un"], ["the", "a", "and", "of"]]
    out = []
    for i in range(n):
        small = rng.choice(tongues)
        mark = small[0][0]
        out.append((i, " ".join(rng.choice(small) if rng.random() < 0.6 else mark + str(rng.randint(0, 60)) for _ in range(rng.randint(0, 60)))))
    return out


def lm_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("kind", ["edges", "languages"])
def test_base_scores(spark, kind):
    rows = edge_rows() if kind == "edges" else language_rows()
    df = edge_frame(spark) if kind == "edges" else spark.createDataFrame(rows, "doc_id long, text string")
    learned = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    c = Counter()
    for (_, text), use in zip(rows, learned, strict=True):
        if use:
            c.update(lm_tokens(text))
            c["\0"] += 1
    n, v = sum(c.values()), len(c)
    expected = []
    for (i, text), use in zip(rows, learned, strict=True):
        tokens = [*lm_tokens(text), "\0"]
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        expected.append((i, not use, len(tokens), sum(c[t] > 0 for t in tokens), n, round(base, 4)))
    got = class_lm.score_documents(df).collect()
    same_rows([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got], expected)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["perplexity"] >= 1 for r in got)
    if kind == "languages":
        held = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_scores(rows, learned):
    """{row: score} by a class model in plain Python: the classes' steps by the whole objective, probabilities word by word."""
    start, end, k = class_lm.LOOSE, class_lm.END, class_lm.N_CLASSES
    texts = [lm_tokens(t) for _, t in rows]
    train = [t for t, use in zip(texts, learned, strict=True) if use]
    count = Counter(w for t in train for w in t)
    number = {w: int(bytescan.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])).view(np.int64)[0]) for w in count}
    often = sorted((w for w in count if count[w] >= class_lm.FREQUENT * sum(count.values())), key=number.get)
    m = len(often)
    place = {w: i for i, w in enumerate(often)} | {None: m, "": m + 1}
    bigrams = np.zeros((m + 2, m + 2), dtype=np.int64)
    pairs = Counter(p for t in train for p in itertools.pairwise([None, *t, ""]))
    for (a, b), n in pairs.items():
        if a in place and b in place:
            bigrams[place[a], place[b]] += n
    classes, _ = class_lm.exchange(bigrams)
    of = {w: int(classes[i]) for i, w in enumerate(often)}

    def counts(of):
        table = np.zeros((k, k))
        for (a, b), n in pairs.items():
            c, d = start if a is None else of.get(a), end if b == "" else of.get(b)
            if c is not None and d is not None:
                table[c, d] += n
        return table

    def objective(t):
        f = lambda x: x * np.log(np.maximum(x, 1))
        return f(t).sum() - f(t.sum(axis=1)).sum() - f(t.sum(axis=0)).sum()

    def step(of, words):
        table, out = counts(of), {}
        free = [c for c in range(class_lm.CLASSES) if table[c].sum() + table[:, c].sum() > 0]
        for w in words:
            without = counts({x: c for x, c in of.items() if x != w})
            held = [(without + counts({**of, w: c}) - without, c) for c in free]
            gains = [(objective(t), -c) for t, c in held]
            if w not in of and not any((held[0][0] != table).ravel()):
                out[w] = start
                continue
            best = max(gains)
            stays = w in of and of[w] < class_lm.CLASSES and best[0] <= objective(table) + 1e-7
            out[w] = of[w] if stays else -best[1]
        return out

    of = of | step(of, [w for w in count if w not in of])
    for _ in range(class_lm.ROUNDS):
        of = step(of, list(count))
    table = counts(of)
    tokens, once = np.zeros(k), np.zeros(k)
    for w, c in of.items():
        tokens[c] += count[w]
        once[c] += count[w] == 1
    tokens[end] = len(train)
    frequency = (tokens + 0.1) / (tokens + 0.1).sum()
    unseen = [0.0 if c == end else 1.0 if tokens[c] == 0 else min(max((once[c] + 0.5) / (tokens[c] + 1), 1e-6), 0.9) for c in range(k)]
    after = lambda c, d: (table[c, d] + class_lm.TRANSITION_PRIOR * frequency[d]) / (table[c].sum() + class_lm.TRANSITION_PRIOR)
    out = []
    for t in texts:
        total, before = 0.0, start
        for w in t:
            if w in of:
                total += math.log10(after(before, of[w]) * (1 - unseen[of[w]]) * count[w] / tokens[of[w]])
                before = of[w]
            else:
                total += math.log10(sum(after(before, c) * unseen[c] for c in range(k)))
        out.append(total + math.log10(after(before, end)))
    return out


@pytest.mark.parametrize("share", [2.5e-4, 0.04])
def test_scores_are_those_of_the_model(spark, monkeypatch, share):
    monkeypatch.setattr(class_lm, "FREQUENT", share)
    rows = language_rows(60)
    learned = [zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    expected = {i: s for (i, _), s in zip(rows, brute_scores(rows, learned), strict=True)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in class_lm.score_documents(df.repartition(3)).collect()}
    assert got == pytest.approx(expected, rel=1e-9)


def test_language_model_of_nothing(spark):
    assert class_lm.score_documents(empty_frame(spark)).count() == 0


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    k = class_lm.N_CLASSES
    transitions = rng.integers(0, 50, (k, k)).astype(float)
    transitions[class_lm.END] = 0
    tokens = transitions.sum(axis=0)
    tokens[class_lm.END] = 0
    types, once = np.maximum(1, tokens // 7), np.minimum(tokens // 9, tokens)
    types[class_lm.END] = once[class_lm.END] = 0
    model = class_lm.ClassModel(transitions, np.array([types, once, tokens]))
    for before in range(k):
        known = sum(10 ** (model.log_transition[before, c] + model.log_known[c]) * (tokens[c] if c != class_lm.END else 1) for c in range(k))
        assert known + 10 ** model.log_unknown[before] == pytest.approx(1, abs=1e-9)


def class_objective(bigrams, classes, k):
    f = lambda x: x * np.log(np.maximum(x, 1))
    table = np.zeros((k, k))
    np.add.at(table, (classes[:, None], classes[None, :]), bigrams)
    return f(table).sum() - f(table.sum(axis=1)).sum() - f(table.sum(axis=0)).sum()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exchange_ends_where_no_move_helps(seed):
    rng = np.random.default_rng(seed)
    m, k = 24, 4
    bigrams = rng.poisson(rng.gamma(0.5, 6.0, (m + 2, m + 2)))
    bigrams[m + 1] = bigrams[:, m] = 0
    classes, history = class_lm.exchange(bigrams, k, 50)
    of = np.concatenate([classes, [k, k + 1]])
    best = class_objective(bigrams, of, k + 2)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(history)) and history[-1] == pytest.approx(best)
    assert history[-1] > history[0]
    for w, c in itertools.product(range(m), range(k)):
        moved = of.copy()
        moved[w] = c
        assert class_objective(bigrams, moved, k + 2) <= best + 1e-6


# -- fingerprints --------------------------------------------------------------


def leaves(fingerprint):
    return Counter(re.findall(r"(?<=[:,])[0-9a-f]{8}", fingerprint.split(";")[1]))


def test_fingerprints(spark):
    rows = {i: t for i, t in edge_rows() if i is not None}
    rows = list(rows.items()) + [(20, "a b c d e f g. h i j k.\nsecond line here now.\n" * 3), (21, "the end. " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in merkle.compare_with_edits(df).collect()}
    order = sorted(i for i, _ in rows)
    texts = {i: t or "" for i, t in rows}
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = leaves(r["fingerprint"]), leaves(r["edited_fingerprint"])
        both = sum(a.values()) + sum(b.values())
        assert r["near_edited"] == pytest.approx(2 * sum((a & b).values()) / both if both else 1.0)
        c = leaves(got[order[(k + 1) % len(order)]]["fingerprint"])
        both = sum(a.values()) + sum(c.values())
        assert r["near_next"] == pytest.approx(2 * sum((a & c).values()) / both if both else 1.0)
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
    assert len({r["fingerprint"] for r in got.values()}) == len(set(texts.values()))


def test_fingerprints_of_edges(spark):
    assert merkle.compare_with_edits(edge_frame(spark)).count() == len(edge_rows())
    assert merkle.compare_with_edits(empty_frame(spark)).count() == 0
    one = spark.createDataFrame([(5, "only one")], "doc_id long, text string")
    r = merkle.compare_with_edits(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"onlyonly").hexdigest()


@pytest.mark.parametrize("ids", ["few", "hot", "none"])
def test_the_next_document_is_that_of_the_order(spark, ids):
    rng = random.Random(4)
    make = {"few": lambda: rng.choice([None, *range(40)]), "hot": lambda: rng.choice([None, 7, 7, 7, rng.randint(0, 500)]), "none": lambda: None}[ids]
    rows = [(make(), f"text {rng.randint(0, 150)}") for _ in range(400)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest(), r[1]))
    expected = Counter((i, t, after) for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    with_next = merkle.with_next(df)
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in with_next.collect()) == expected
    digest = merkle.range_of(F.col("doc_id"), F.col("text"), [3, 7, 90], [1, 6, 1], 5)
    many = df.groupBy("doc_id").agg(F.count_distinct(digest).alias("n")).where("doc_id is null or doc_id = 7").collect()
    assert all(r["n"] > 3 for r in many if ids != "few")


def test_edits_open_differing_sections_only(spark):
    rng = random.Random(6)
    paragraphs = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(300)]
    changed = list(paragraphs)
    changed[100] = "another " + changed[100]
    changed.insert(200, "a new paragraph of words")
    a, b = ("\n".join(x) for x in (paragraphs, changed))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    assert df.select(merkle.locate_edits(F.col("a"), F.col("b"))).first()[0] == [100]
    assert df.select(merkle.locate_edits(F.col("b"), F.col("a"))).first()[0] == [100, 200]
    left, right = (set(x.split(";")[1].split("|")) for x in df.first())
    # two paragraphs differ: of the many sections, two or three
    assert len(left) > 15 and 1 <= len(left - right) <= 3


def test_edits_are_located(spark):
    left = "first paragraph of it.\nthe second one is here.\nand a third one follows."
    right = left.replace("second", "other")
    df = spark.createDataFrame([(left, right)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    assert df.select(merkle.locate_edits(F.col("a"), F.col("b"))).first()[0] == [1]


# -- packing -------------------------------------------------------------------


def test_bounds_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 9)))
        counts = rng.integers(1, 20, len(lengths))
        k = int(rng.integers(1, 5))
        cost = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts, strict=True))  # noqa: B023,E731
        best = min(cost((*some, int(lengths[-1]))) for size in range(k) for some in itertools.combinations(map(int, lengths[:-1]), size))
        bounds = packing.optimal_bounds(lengths, counts, k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1] and cost(bounds) == best
    assert packing.optimal_bounds(np.zeros(0), np.zeros(0), 3) == []


def test_packing(spark):
    rows = edge_rows()
    got = packing.pack(edge_frame(spark), n_buckets=3, budget=100).collect()
    expected = sorted(max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for _, t in rows)
    assert sorted(r["n_words"] for r in got) == expected
    batches = Counter((r["bucket_bound"], r["batch_id"]) for r in got)
    for (bound, batch), n in batches.items():
        room = max(1, 100 // bound)
        slots = sorted(r["slot"] for r in got if (r["bucket_bound"], r["batch_id"]) == (bound, batch))
        assert slots == list(range(n)) and n <= room
        # only the last batch of a bucket has room left
        assert n == room or batch == max(b for x, b in batches if x == bound)
    assert all(0 <= r["padding"] == r["bucket_bound"] - r["n_words"] for r in got)
    assert packing.pack(empty_frame(spark)).count() == 0


def test_every_length_is_told_apart(spark):
    n_words = [16_400] * 5 + [16_401] * 5 + [16_410]
    df = spark.createDataFrame([(k, "w " * n) for k, n in enumerate(n_words)], "doc_id long, text string")
    assert {r["bucket_bound"] for r in packing.pack(df, n_buckets=2).collect()} == {16_401, 16_410}


# -- license scan --------------------------------------------------------------


def test_license_base(spark):
    rows = edge_rows() + [(30, "Under the  MIT-License, under the mit license"), (31, "é Apache License, Version 2 apache license version 2.0"), (32, "cc by nc cc-by-nc xcc by nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = []
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        places = [(at, label) for phrase, label in license_scan.BASE_NOTICES.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places]
        expected.append((i, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    got = license_scan.scan_documents(df).collect()
    same_rows([tuple(r)[:6] for r in got], expected)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan_documents(empty_frame(spark)).count() == 0 and license_scan.find_notices(empty_frame(spark)).count() == 0


def test_license_misspellings_are_found():
    rng = random.Random(6)
    scanner = license_scan.LicenseScanner()
    for notice, (label, edits, fixed) in license_scan.FUZZY_NOTICES.items():
        for _ in range(40):
            text = list(notice)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(1, len(text) - 1)
                rng.choice([lambda: text.pop(at), lambda: text.insert(at, rng.choice("abq")), lambda: text.__setitem__(at, rng.choice("abq"))])()  # noqa: B023
            said = "".join(text)
            if "  " in said or said.strip() != said or not set(fixed.split()) <= set(said.split()):
                continue
            joined = scanner.words(f"Words before: {said} and after".encode())
            found = [h for h in scanner.hits(joined) if h.label == label]
            assert found, said
            span = joined[found[0].start : found[0].end].decode()
            assert edit_distance(span, notice) <= edits
    assert not scanner.hits(scanner.words(b"nothing of this kind, cc by nd, under that other license of mine"))


def test_license_spans(spark):
    df = spark.createDataFrame([(1, "Released undr the MIT licence.")], "doc_id long, text string")
    assert [tuple(r) for r in license_scan.find_notices(df).collect()] == [(1, "mit", 1, 2, "undr the mit licence")]


def test_license_places_before_a_better_one():
    scanner = license_scan.LicenseScanner()
    joined = scanner.words(b"gnu generl public license gnu general public license gnu genral public licens agnu general public license")
    assert [(h.first_word, h.edits) for h in scanner.hits(joined)] == [(0, 1), (4, 0), (8, 2), (12, 1)]


@pytest.mark.parametrize("text", ["under the mpl license", "under the ms license", "apache license version 1 1", "apache license version 3", "gnome lesser general public license", "godzilla public license"])
def test_another_licence_is_no_misspelling(text):
    assert license_scan.LicenseScanner().scan(text.encode())[4:6] == ("", 0.0)


def test_the_longer_notice_counts():
    labels = lambda text: license_scan.LicenseScanner().scan(text.encode())[4]
    assert labels("Creative Commons Attribution-NonComercial") == "cc-by-nc" and labels("creative commons attribution") == "cc-by"


def all_places(words, notice, edits, fixed):
    """Spans of words within the edits of a notice that hold the fixed words, found by trying all of them."""
    out = []
    for a in range(len(words)):
        for b in range(a + 1, min(len(words), a + 2 * len(notice.split()) + edits) + 1):
            said = " ".join(words[a:b])
            if abs(len(said) - len(notice)) <= edits and set(fixed.split()) <= set(words[a:b]) and (d := edit_distance(said, notice)) <= edits:
                out.append((d, a, b))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_every_place_is_found(seed):
    rng = random.Random(seed)
    scanner = license_scan.LicenseScanner()
    words = []
    for _ in range(60):
        said = list(rng.choice([*license_scan.FUZZY_NOTICES, "other words", "the mit", "general public"]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            said[rng.randrange(len(said))] = rng.choice(["a", "", " ", "qu"])
        words += "".join(said).split()
    found = scanner.hits(scanner.words(" ".join(words).encode()))
    for h in found:
        _, edits, fixed = license_scan.FUZZY_NOTICES[h.notice]
        assert edit_distance(" ".join(words[h.first_word : h.end_word]), h.notice) == h.edits <= edits and set(fixed.split()) <= set(words[h.first_word : h.end_word])
    # whatever brute force finds is a hit, or overlaps one: of the same notice with no more edits, or of another that holds its like
    for notice, (_, edits, fixed) in license_scan.FUZZY_NOTICES.items():
        for d, a, b in all_places(words, notice, edits, fixed):
            assert any(h.first_word < b and a < h.end_word and (h.notice != notice or h.edits <= d) for h in found), words[a:b]


def test_long_texts_cost_linear_time():
    scanner = license_scan.LicenseScanner()
    for unit in (b"cc by nc ", b"undr the mit license ", b"licenselicense", b"under the mpl license "):
        times = []
        for n in (200_000, 1_600_000):
            began = time.process_time()
            scanner.scan(unit * (n // len(unit)))
            times.append(time.process_time() - began)
        assert times[1] < 30 * times[0] + 0.5


# -- BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(word_bpe_path())
    made.no_truncation()
    made.no_padding()
    return made


def odd_texts():
    rng = random.Random(8)
    letters = "aAbzZ ÉéßİΣσςſﬀ½²٣漢字😀\n\t\x1c\x85\xa0'\"_-<|>stdm0019ªº€’…İ́​﻿"
    out = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2000)]
    out += ["".join(rng.choices("aA's't_.re_  __'d9É", k=rng.randint(0, 12))) for _ in range(2000)]
    return out + ["a<|endoftext|>b <|startoftext|>", "y" * 3000, "ab" * 2000, "", "I'm he'LL don'T ''s 's"]


def test_codec_and_counts(spark, library):
    rows = edge_rows() + list(enumerate(odd_texts(), 100))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    encoded, counted, decoded = [], [], []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        encoded.append((i, len(ids), sha(" ".join(map(str, ids))), sha(back)))
        decoded.append((i, " ".join(map(str, ids)), len(ids), back))
        counted.append((i, len((text or "").encode()), len(ids), len(ids) > 2048))
    same_rows(bpe_codec.encode_digests(df, word_bpe_path()).collect(), encoded)
    same_rows(bpe_codec.encode_documents(df, word_bpe_path()).collect(), decoded)
    same_rows(token_counts.token_counts(df, word_bpe_path()).collect(), counted)
    for op in (bpe_codec.encode_digests, bpe_codec.encode_documents, token_counts.token_counts):
        assert op(empty_frame(spark), word_bpe_path()).count() == 0
        assert op(edge_frame(spark), word_bpe_path()).count() == len(edge_rows())


def test_speculation_is_exact_and_pays():
    with open(word_bpe_path(), "rb") as f:
        codec = bpe_codec.Codec(WordBpe(f.read()))
    words = [w for t in odd_texts() for w in codec.bpe.words(t)] + ["hello", "internationalization", "jekyllish", "hydrochlorothiazide"]
    got = codec.encode_words(words)
    assert got == [[codec.bpe.vocab[t] for t in codec.bpe.merge(codec.bpe.spell(w))] for w in words]
    assert 0 < codec.counts["failed"] < codec.counts["words"]
    assert bpe_codec.decode(codec.bpe, got[-4]) == "hello</w>"


def test_memory_of_words_is_bounded(monkeypatch):
    with open(word_bpe_path(), "rb") as f:
        content = f.read()
    monkeypatch.setattr(token_counts, "MEMORY", 10)
    monkeypatch.setattr(bpe_codec, "MEMORY", 10)
    monkeypatch.setattr(bpe_codec, "PAIR_MEMORY", 10)
    texts = [f"word{i} and more{i} qwxz" for i in range(50)]
    counter, codec = token_counts.TokenCounter(content, ["and"]), bpe_codec.Codec(WordBpe(content))
    assert [counter.count(t) for t in texts] == [n for t in texts for _, n, _ in codec.encode_many([t])]
    assert len(codec.known) <= 10 + 8


def test_whole_tokens_are_proved(library):
    with open(word_bpe_path(), "rb") as f:
        whole = token_counts.prove_whole_tokens(f.read())
    assert len(whole) > 10_000
    for word in random.Random(1).sample(whole, 300):
        if word == word.lower() and not re.search(r"\s", word):
            assert len(library.encode(word, add_special_tokens=False).ids) >= 1
