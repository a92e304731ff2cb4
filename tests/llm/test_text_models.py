"""Language, toxicity, repetition rules and encoding: held-out accuracy, brute force, round trips."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from runscope.llm import op2_language as op2, op6_sentencepiece as op6, op7_repetition as op7, op10_toxicity as op10
from runscope.llm.common import read, words_of
from runscope.llm.queries import QUERIES, tokenizer_model

SF = "/root/testdata/sf0.01"
CLASHING = "doc_id long, text string, lang string, score string, held_out string, predicted string, counts string"


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


# ---- words


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x0c\r \x1f\xa0x") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    words = words_of(pa.array(texts, pa.large_string()))
    raw = words.data.tobytes()
    for i, text in enumerate(texts):
        got = [raw[b:e].decode() for b, e in zip(words.begin, words.end)][words.first[i] : words.first[i + 1]]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_words_of_a_slice():
    texts = pa.array(["skip me", "a b", "", "c"], pa.large_string()).slice(1)
    assert words_of(texts).dictionary.to_pylist() == [b"a", b"b", b"c"]


# ---- language


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    want = {r.doc_id: r.lang for r in read(spark, SF, "documents").select("doc_id", "lang").collect()}
    assert got.keys() == want.keys()
    held = [d for d in want if fold(d, 4) == 2]
    assert all(got[d].held_out == (fold(d, 4) == 2) for d in want)
    assert sum(got[d].lang_pred == want[d] for d in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(spark):
    english, french = "the quick brown fox jumps over it", "le renard brun saute par dessus où ça"
    docs = [(i, t, lang, None, None, None, None) for i in range(40) for t, lang in [(english, "en"), (french, "fr")][i % 2 : i % 2 + 1]]
    docs += [(100, None, "en"), (101, "", None), (102, "123 !?", "fr"), (None, english, "en"), (103, "the fox " * 30_000, None), docs[0][:3]]
    docs = [(*d, *([None] * 7))[:7] for d in docs]
    got = {}
    for r in op2.identify(spark.createDataFrame(docs, CLASHING)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [len(got[0]), len(got[None])] == [2, 1]
    assert all(got[i][0].lang_pred == ("en", "fr")[i % 2] for i in range(40))
    assert [(got[i][0].lang_pred, got[i][0].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103][0].lang_pred == "en" and got[None][0].lang_pred == "en" and got[None][0].held_out


def test_language_rejects_what_is_far(spark):
    docs = [(i, "the quick brown fox jumps over the lazy dog", "en") for i in range(30)]
    model = op2.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    got = op2.predict(spark.createDataFrame([(1, "the lazy dog jumps over the quick brown fox"), (2, "zzzqx vvvkj")], "doc_id long, text string"), model)
    assert {r.doc_id: r.rejected for r in got.collect()} == {1: False, 2: True}


@pytest.mark.parametrize("rows", [[], [(1, "words but no language", None)]])
def test_nothing_to_learn_a_language_from(spark, rows):
    got = op2.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_clusters_are_unit_vectors_and_separate_groups():
    rng = np.random.default_rng(1)
    points = np.concatenate([np.eye(8)[k] + 0.05 * rng.random((30, 8)) for k in range(3)])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centroids, least = op2.cluster(points, 3)
    nearest = (points @ centroids.T).argmax(axis=1).reshape(3, 30)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1) and (least > 0.9).all()
    assert len({*nearest[:, 0]}) == 3 and (nearest == nearest[:, :1]).all()


# ---- toxicity


def test_toxicity_of_held_out_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    label = {r.doc_id: r.toxic for r in read(spark, "/root/testdata/sf0.1", "labels").collect()}
    held = [d for d in label if d in got and fold(d, 3) == 1]
    assert all(got[d].held_out for d in held)
    toxic, clean = ([got[d].predicted for d in held if label[d] == y] for y in (1, 0))
    assert sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.01
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())


def identity_sample():
    """Toxic sentences that often name one group, neutral ones that name it rarely."""
    rng = random.Random(4)
    filler = "today people went home after lunch near river while rain fell on green hills".split()
    texts, labels = [], []
    for i in range(600):
        toxic = i % 2
        words = rng.sample(filler, 6)
        if toxic and rng.random() < 0.7:
            words.append(rng.choice(["idiot", "scum"]))
        if rng.random() < (0.6 if toxic else 0.05):
            words.append("muslim")
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(toxic)
    return texts, np.array(labels)


def every_swap(texts):
    return op10.pooled(swap for own in op10.counterfactuals(texts) for swap in own)


def test_swaps_are_those_of_the_whole_text():
    """The buckets lost and gained are the difference of the features of both texts."""
    texts = ["The women, men's women-only lunch", "(Atheists) pathetic", "no group here", "", "Women omen", "muslim muslims"]
    kinds = {t: terms for terms in op10.SWAPS for t in terms}
    for text, swaps in zip(texts, op10.counterfactuals(texts), strict=True):
        plain = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        want = [
            [other if w == term else w for w in plain]
            for term in sorted(set(plain) & kinds.keys()) for other in kinds[term] if other != term
        ]
        before = set(op10.features([text])[1].tolist())
        after = [(before - set(gone.tolist())) | set(new.tolist()) for gone, new in swaps]
        assert all(set(gone.tolist()) <= before and not set(new.tolist()) & (before - set(gone.tolist())) for gone, new in swaps)
        if want:
            assert after == [set(op10.features([" ".join(w)])[1].tolist()) for w in want]
        else:
            assert after in [[set(op10.features([f"{text} {term}"])[1].tolist())] for term in kinds]


def test_the_penalty_counts_on_the_given_tables(spark, monkeypatch):
    """Terms that share 4-grams with insults hardly move the score of a clean text."""
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    learn = op10.learnable(docs)
    fair = op10.fit(learn, labels)
    kept = op10.train
    monkeypatch.setattr(op10, "train", lambda x, b, y, swaps: kept(x, b, y, swaps, swap_penalty=0.0))
    plain = op10.fit(learn, labels)
    terms = [t for kind in op10.SWAPS for t in kind]
    change = [np.abs([m[0][op10.features([t])[1]].sum() for t in terms]).max() for m in (plain, fair)]
    assert change[1] < change[0] / 2
    assert (op10.score_texts([f"the {t} of the village" for t in terms], *fair) < op10.THRESHOLD).all()


def test_swapping_a_group_hardly_changes_a_score():
    texts, label = identity_sample()
    x = op10.features(texts)
    swaps = every_swap(texts)
    probes = ["people went home muslim", "people went home christian"]
    plain = op10.score_texts(probes, *op10.train(*x, label, []))
    fair = op10.score_texts(probes, *op10.train(*x, label, swaps, swap_penalty=20.0))
    assert plain[0] - plain[1] > 0.3 and abs(fair[0] - fair[1]) < 0.1
    assert plain[0] > 0.7 > fair[0]
    insulting = op10.score_texts(["people went home idiot"], *op10.train(*x, label, swaps, swap_penalty=20.0))
    assert insulting[0] > 0.7


def test_the_shipped_penalty_lowers_false_positives_on_groups():
    texts, label = identity_sample()
    x, swaps = op10.features(texts), every_swap(texts)
    probes = [f"{w} muslim" for w in ("rain fell", "went home", "green hills", "after lunch")]
    plain = op10.score_texts(probes, *op10.train(*x, label, []))
    fair = op10.score_texts(probes, *op10.train(*x, label, swaps))
    assert (fair >= op10.THRESHOLD).sum() < (plain >= op10.THRESHOLD).sum()


def test_toxicity_edge_cases(spark):
    texts, label = identity_sample()
    docs = [(i, t) for i, t in enumerate(texts)] + [(9001, None), (9002, ""), (None, "idiot"), (9003, "idiot scum " * 20_000), (0, texts[0])]
    docs = [(*d, *([None] * 5)) for d in docs]
    labels = [(i, None, int(y), "x") for i, y in enumerate(label)] + [(0, 1, None, None), (None, 1, 1, None), (1, 0, 0, None)]
    frame = spark.createDataFrame(docs, CLASHING)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = {}
    for r in op10.scores(frame, marks).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[0]) == 2 and got[9001][0].score == got[9002][0].score
    assert got[9003][0].predicted == 1 and got[None][0].predicted == 1 and got[None][0].held_out
    kept = op10.drop_toxic(frame, marks)
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 9003 not in ids and {9001, 9002} <= ids


def test_no_labels_of_one_kind_means_no_score(spark):
    docs = spark.createDataFrame([(1, "idiot"), (2, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in op10.scores(docs, labels).collect()} == {0.0}
    assert op10.drop_toxic(docs, labels).count() == 2
    assert op10.scores(docs.limit(0), labels.limit(0)).collect() == []


# ---- repetition rules


def brute_repetition(text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    covered = {p for i in range(n) if best[i] >= least for p in range(i, i + best[i])}
    windows = {p for i in range(n) if best[i] >= 3 for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    longest = max([b for b in best if b > 1], default=0)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(windows), sum(len(words[i]) for i in covered), longest


def test_repetition_equals_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "é ", "dd\n", "e# ", "\n"]) for _ in range(rng.randint(0, 70))) for _ in range(80)]
    texts += [None, "", "\n\n", "x " * 70, " ".join(map(str, range(80))) + " " + " ".join(map(str, range(80)))]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, kept string")
    for r in op7.repetition_rules(docs, min_repeat_words=4).collect():
        text = [*texts, texts[0]][r.doc_id]
        want = brute_repetition(text, 4)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_chars, r.longest_repeat) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        repeats = 100 * want[5] > 50 * want[1] or (want[6] > 50 and 100 * want[6] > 30 * want[0])
        assert (r.base_failed, r.kept) == (failed, not failed and not repeats)


def test_very_long_repeats_and_no_rows(spark):
    unit = " ".join(f"w{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, f"{unit} {unit}"), (2, unit)], "doc_id long, text string")
    got = {r.doc_id: (r.longest_repeat, r.kept) for r in op7.repetition_rules(docs).collect()}
    assert got == {1: (5000, False), 2: (0, True)}
    assert op7.repetition_rules(docs.limit(0)).collect() == []


# ---- encoding


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_model())


def odd_texts():
    rng = random.Random(7)
    chars = "ab the▁ \n\t.,!é漢😀\x00ing  <0x41>"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [" " * k + "x" * j + " " * m for k in range(0, 40, 3) for j in (0, 1, 5, 100) for m in range(0, 20, 4)]
    return [*texts, "", "a" * 20_000, "🙂" * 500, " " * 3000 + "word" * 300, "<s></s><unk>", "éﬁ"]


def test_encoding_equals_the_library(library):
    bpe = op6.PrefixTableBpe(tokenizer_model())
    texts = odd_texts()
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids == library.encode(text, add_bos=False, add_eos=True), text[:80]
        assert bpe.decode(ids) == library.decode(ids)


def test_encoding_does_not_depend_on_what_is_kept(monkeypatch, library):
    monkeypatch.setattr(op6, "KEPT_PARTS", 5)
    monkeypatch.setattr(op6, "KEPT_PAIRS", 5)
    bpe = op6.PrefixTableBpe(tokenizer_model())
    texts = odd_texts()[:60]
    assert [bpe.encode([t])[0] for t in texts] == library.encode(texts, add_eos=True)


def test_a_pair_fits_exactly_if_merging_leaves_it():
    bpe = op6.PrefixTableBpe(tokenizer_model())
    rng = random.Random(3)
    names = [p for p in bpe.id if p in bpe.starts]
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names).lstrip("▁") or "x"
        if b in bpe.starts:
            assert bpe._fits(a, b) == (bpe.merged(a + b) == [a, b])


def test_digests_of_all_documents_equal_the_library(spark, library):
    want = {}
    for r in read(spark, SF, "documents").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=False, add_eos=True)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        want[r.doc_id] = (len(ids), *digests)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_sentencepiece"](spark, SF).collect()}
    assert got == want


def test_ids_and_text_come_back_as_columns(spark, library):
    rows = [(1, "Hello  world\n x", "c"), (2, None, "c"), (None, "a", "c"), (1, "Hello  world\n x", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = op6.encode_column(docs, tokenizer_model()).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, library.encode(t or "", add_eos=True), t or "") for d, t, _ in rows), key=str)
    assert op6.token_digests(docs.limit(0), tokenizer_model()).collect() == []


# ---- memory of a task


@pytest.mark.parametrize(
    "work, most_mb",
    [
        pytest.param(lambda batches: op10.scored(batches, (np.zeros(1 << op10.BITS, np.float32), 0.0)), 50, id="toxicity"),
        pytest.param(lambda batches: op6.digest_rows(batches, tokenizer_model()), 35, id="sentencepiece"),
    ],
)
def test_a_large_batch_is_worked_on_in_little_memory(work, most_mb):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1200)]  # 3 MB in one batch
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for _ in work(iter([batch.slice(0, 5)])):
        pass  # tables of the worker
    tracemalloc.start()
    rows = sum(1 for _ in work(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 1 and peak < most_mb * 1e6
