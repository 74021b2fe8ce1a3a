"""Toxicity (6), quality (9) and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from keyloom.llm import bytescan, digest_index, ngram_join, packing, quality, toxicity
from keyloom.llm.levenshtein import Term, build

from . import brute
from .helpers import SMALL, edge_frame, edge_rows, empty_frame, labels_frame, needs_data
from .brute import edit_distance
from .test_dedup import brute_near

# -- automaton -------------------------------------------------------------------


def matches(terms, words):
    automaton = build(terms)
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    starts, ends, _ = bytescan.runs(~bytescan.IS_SPACE[data], np.array([0, len(data)]))
    return {int(w): (int(t), int(e)) for w, t, e in zip(*automaton.match(data, starts, ends), strict=True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_automaton_is_edit_distance(seed):
    rng = random.Random(seed)
    letters = "abcd"
    terms = [Term("".join(rng.choices(letters, k=rng.randint(3, 7))), rng.random() < 0.3, 1.0, rng.randint(0, 2)) for _ in range(8)]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(3000)] + [t.text for t in terms]
    got = matches(terms, words)

    def best(word):
        found = []
        for k, t in enumerate(terms):
            lengths = range(len(word) + 1) if t.stem else [len(word)]
            d = min(edit_distance(word[:n], t.text) for n in lengths)
            if d <= t.edits:
                found.append((d, k))
        return min(found, default=None)

    for i, word in enumerate(words):
        expected = best(word)
        assert (got[i][1] if i in got else None) == (expected[0] if expected else None), word


def test_empty_lexicon_matches_nothing():
    assert matches([], ["a", "b"]) == {}


# -- toxicity --------------------------------------------------------------------


def toxic_rows(n=600, seed=3):
    rng = random.Random(seed)
    plain = [a + b for a in ("ta", "re", "mi", "so", "lu") for b in ("ne", "ri", "mo", "ka", "tu", "va")]
    bad = ["zwopple", "kravitz", "snorgbat"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_learns_and_finds_misspellings(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, "ta re zwoppel so"), (1001, "you KRAVITS go"), (1002, "ta re mi"), (1003, None)], "doc_id long, text string")
    labels = labels_frame(spark, [(i, 1, t) for i, _, t in rows])
    model = toxicity.fit(docs, labels)
    assert {t.text for t in model.lexicon.terms} >= {"zwopple", "kravitz", "snorgbat"}
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _, _ in held)
    assert np.mean([got[i]["predicted"] == t for i, _, t in held]) > 0.97
    assert [got[i]["predicted"] for i in (1001, 1002, 1003)] == [1, 0, 0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"] == 0}


def test_copies_of_a_long_toxic_text_leave_room_for_terms(spark):
    rng = random.Random(8)
    long_text = " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(1500))
    rows = [(i, text, t) for i, text, t in toxic_rows()]
    n_toxic = sum(t for _, _, t in rows)
    rows += [(1000 + i, long_text, 1) for i in range(2 * n_toxic)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, labels_frame(spark, [(i, 1, t) for i, _, t in rows]))
    assert {t.text for t in model.lexicon.terms} == {"zwopple", "kravitz", "snorgbat"}


def test_words_end_at_punctuation_beyond_ascii():
    terms = [Term("idiota", False, 1.0, 1), Term("zwopp", True, 1.0, 0), Term("größenwahn", False, 1.0, 0)]
    model = toxicity.ToxicityModel(toxicity.Lexicon(terms), np.ones(toxicity.N_FEATURES), 0.0)
    found = ["¡idiota!", "«idiota»", "“idiota”", "—idiota…", "x\xa0idiota\xa0y", "idiöta", "idióta", "idi\u0301ota", "“zwopple”", "„Größenwahn“", "漢字、idiota。", "😀idiota"]
    missed = ["", "ïdiöta", "“zwapple”", "é", "größenwähn", "idi漢字ta"]
    for text in found + missed:
        hits = model.features(*bytescan.buffers(pa.array([text.lower()])))
        assert bool(hits.any()) == (text in found), text
    # several texts at once: each keeps its own hits, and the bytes around a hit are its text's
    alone = [model.features(*bytescan.buffers(pa.array([t.lower()])))[0] for t in found + missed]
    assert (model.features(*bytescan.buffers(pa.array([t.lower() for t in found + missed]))) == np.array(alone)).all()


def test_code_points():
    text = "aé“漢😀\xa0z\U0010ffff"
    points, at = bytescan.code_points(np.frombuffer(text.encode(), np.uint8))
    assert points.tolist() == list(map(ord, text)) and at.tolist() == [len(text[:k].encode()) for k in range(len(text) + 1)]


def test_quotation_and_address():
    context = lambda text, word: toxicity.ToxicityModel._context(*(np.frombuffer(x.encode(), np.uint8) for x in text.split(word)))
    assert context('they said "zwopple here" again', "zwopple") == (1, 0)
    assert context("you are a zwopple!", "zwopple") == (0, 1)
    assert context("a plain zwopple of sorts", "zwopple") == (0, 0)


def test_windows_count_words_whatever_parts_them():
    model = toxicity.ToxicityModel(toxicity.Lexicon([Term("zwopple", False, 1.0, 0)]), np.ones(toxicity.N_FEATURES), 0.0)
    features = lambda text: model.features(*bytescan.buffers(pa.array([text])))[0]
    filler = ["w" * 90] * (toxicity.WINDOW - 1)
    for gap in (" ", "\t", "\n", " , "):
        assert features(gap.join(["you", *filler, "zwopple"]))[2] == features(gap.join(["zwopple", *filler, "you"]))[2] > 0
        assert features(gap.join(["you", "w", *filler, "zwopple"]))[2] == features(gap.join(["zwopple", *filler, "w", "you"]))[2] == 0


def test_lexicon_takes_in_any_number_of_terms_and_long_ones():
    rng = random.Random(2)
    made = {"".join(rng.choices("abcdefgh", k=rng.randint(5, 12))) for _ in range(3 * toxicity.TRIE_TERMS)} | {"x" * 5000, "y" * 33}
    terms = [Term(t, False, 1.0, int(len(t) < 33)) for t in sorted(made)]
    words = [t.text for t in terms] + ["".join(rng.choices("abcdefgh", k=8)) for _ in range(300)] + ["x" * 4999, "y" * 34, "y" * 32]
    points, starts, ends, _, _ = toxicity.words_of(*bytescan.buffers(pa.array([" ".join(words)])))
    got = {int(w): (int(e), int(t)) for w, t, e in zip(*toxicity.Lexicon(terms).match(points, starts, ends), strict=True)}
    for k, word in enumerate(words):
        near = ((edit_distance(word, t.text), i) for i, t in enumerate(terms) if abs(len(t.text) - len(word)) <= t.edits)
        assert got.get(k) == min((x for x in near if x[0] <= terms[x[1]].edits), default=None), word[:20]


def test_toxicity_scores_are_those_of_the_definition(spark):
    rng = random.Random(5)
    rows = toxic_rows(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, labels_frame(spark, [(i, 1, t) for i, _, t in rows]))
    spell = lambda w: w[: rng.randrange(len(w))] + rng.choice("xyzé") + w[rng.randrange(len(w)) :]
    texts = [t for _, t in edge_rows() if t and len(t) < 5000] + ["", 'they said "snorgbat" here', "you zwopple!", "«kravitz» “snorgbat”, tu\n" * 5]
    for _, text, _ in rows[:120]:
        words = text.split()
        for k in rng.sample(range(len(words)), min(3, len(words))):
            words[k] = rng.choice([words[k].upper(), spell(words[k]), '"' + words[k] + '"', words[k] + "!", "zwopple", spell("snorgbat"), "you"])
        texts.append(rng.choice([" ", "\t", "\n"]).join(words))
    assert model.logits(pa.array(texts)).tolist() == pytest.approx([brute.toxicity_logit(model, t) for t in texts])


# -- quality ---------------------------------------------------------------------


def quality_rows(n=500, seed=4):
    rng = random.Random(seed)
    words = [a + b for a in ("ta", "re", "mi", "so", "lu") for b in ("ne", "ri", "mo", "ka", "tu", "va")]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(3, 80)))
        kind = rng.random()
        if kind < 0.1:
            text = " ".join(w + rng.choice(["***", "&&&"]) for w in text.split())
        elif kind < 0.2:
            text = text.upper().replace(" ", "!! ")
        elif kind < 0.3:
            text = " ".join([text.split()[0]] * 20)
        rows.append((i, text, int(kind >= 0.3)))
    return rows


def test_quality_learns(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = labels_frame(spark, [(i, q, 0) for i, _, q in rows])
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, _, _ in held)
    assert np.mean([got[i]["predicted"] == q for i, _, q in held]) > 0.95
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"] == 1}


def test_features_stay_inside_documents():
    texts = ["ab cd cd ef", "", "x", "cd ab", "abcdefg"]
    data, offsets = bytescan.buffers(pa.array(texts))
    together = [np.zeros(0, np.int64) for _ in texts]
    for buckets, per_doc in quality.features(data, offsets):
        ends = np.cumsum(per_doc)
        together = [np.concatenate([t, buckets[e - n : e]]) for t, e, n in zip(together, ends, per_doc, strict=True)]
    for text, got in zip(texts, together, strict=True):
        alone = [b for b, _ in quality.features(*bytescan.buffers(pa.array([text])))]
        assert sorted(np.concatenate([np.zeros(0, np.int64), *alone])) == sorted(got), text


def test_quality_of_a_text_doesnt_depend_on_its_neighbours(spark):
    rows = quality_rows(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality.fit(docs, labels_frame(spark, [(i, q, 0) for i, _, q in rows]))
    together = model.logits(*bytescan.buffers(pa.array([t for _, t, _ in rows])))
    assert [model.logits(*bytescan.buffers(pa.array([t])))[0] for _, t, _ in rows] == together.tolist()
    again = quality.fit(docs.repartition(7), labels_frame(spark, [(i, q, 0) for i, _, q in rows]))
    assert again.bias == model.bias and (again.table == model.table).all()


def test_quality_scores_are_those_of_the_definition():
    rng = np.random.default_rng(2)
    model = quality.QualityModel(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.25)
    texts = [t for _, t in edge_rows() if t and len(t) < 5000] + ["", "a", "ab", "one", "one one", " x\ty "] + [t for _, t, _ in quality_rows(40)]
    assert model.logits(*bytescan.buffers(pa.array(texts))).tolist() == pytest.approx([brute.quality_logit(model, t) for t in texts], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("op", [toxicity, quality])
def test_classifiers_on_edges(spark, op):
    none, some = labels_frame(spark), labels_frame(spark, [(i, i % 2, i % 2) for i in range(1, 15)] + [(None, 1, 1), (4, None, None), (5, 9, 9), (6, 0, 0)])
    for labels in (none, some):
        model = op.fit(edge_frame(spark), labels)
        got = op.score(edge_frame(spark), model).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [True, True]
        assert op.score(empty_frame(spark), model).count() == 0
    op.fit(empty_frame(spark), some)
    keep = toxicity.keep_clean if op is toxicity else quality.keep_good
    # without labels nothing is rejected
    assert keep(edge_frame(spark), none).count() == len(edge_rows()) and keep(empty_frame(spark), none).columns == empty_frame(spark).columns


# -- pipeline --------------------------------------------------------------------


@needs_data
def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        ids = sorted(r[0] for r in kept.select("doc_id").collect())
        assert kept.columns == columns
        if name in ("toxicity", "quality"):
            op = {"toxicity": toxicity, "quality": quality}[name]
            scored = op.score(docs, op.fit(docs, labels)).collect()
            assert ids == sorted(r["doc_id"] for r in scored if r["predicted"] == (name == "quality"))
        elif name == "exact_dedup":
            assert ids == sorted(r["doc_id"] for r in digest_index.deduplicate(docs).collect() if r["kept"])
        else:
            assert ids == sorted({r["component_id"] for r in ngram_join.near_duplicates(docs).collect()})
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    expected = sorted(map(tuple, packing.pack(docs).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == expected


@needs_data
def test_pipeline_is_that_of_the_definitions(spark):
    """All five stages in plain Python but for what the two models learn."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    frame = lambda: docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id")
    model = toxicity.fit(frame(), labels)
    rows = [r for r in rows if brute.toxicity_logit(model, r[1]) < 0]
    model = quality.fit(frame(), labels)
    rows = [r for r in rows if brute.quality_logit(model, r[1]) >= 0]
    kept = brute.exact_kept(rows)
    rows = [r for r in rows if r[0] in kept]
    rows = [r for r, (i, _, component) in zip(rows, brute_near(rows), strict=True) if i == component]
    assert 0 < len(rows) < docs.count()
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "n_words", "bucket_bound", "batch_id", "slot", "padding").collect()
    assert sorted(map(tuple, got)) == brute.packed(rows)


def test_stages_on_edges(spark, tmp_path):
    labels_frame(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (edge_frame(spark), empty_frame(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, str(tmp_path)).columns == frame.columns
            stage(spark, frame, str(tmp_path)).count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == frame.count()
