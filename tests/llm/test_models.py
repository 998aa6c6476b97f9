import random
import zlib
from collections import Counter

import numpy as np
import pytest

from monthmill.llm import lm_score, quality, toxicity
from monthmill.llm.common import remainder
from tests.llm.data import by_id, corpus, documents


def rated(seed=4, n=400):
    """Texts of plain words, some with words of abuse, some of shouted or marked words; and their labels."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    abuse = ["vugrobnak", "drimpfwoz", "zeckbulp"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(30, 90))]
        toxic, poor = i % 5 == 0, i % 5 == 1
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(abuse))
        if poor:
            words = [w.upper() + "!!" if i % 2 else w + "%%%" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


ODD = [(9000, None), (9001, ""), (9002, "x"), (None, "vugrobnak " * 3), (9003, "word " * 30000), (9003, "word " * 30000), (9004, "\x00é日本")]
LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_held_out(spark):
    rows, labels = rated()
    docs = documents(spark, rows + ODD)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None), (1, 1, 0), (77777, 1, 1)], LABELS)
    model = toxicity.train(docs, marks)
    got = by_id(toxicity.score(docs, model), "score")
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for _, s in got)
    score = dict((i, s) for i, s in got if i is not None)
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40
    assert np.mean([(score[i] >= 0.5) == t for i, t in held]) > 0.95
    assert score[9001] < 0.5 and score[9000] == score[9001]
    # the score depends on the text alone
    again = by_id(toxicity.score(documents(spark, [(5, rows[3][1])]), model), "score")
    assert again[0][1] == score[rows[3][0]]


def test_toxicity_without_a_class(spark):
    docs = documents(spark, corpus()[:5])
    for marks in ([], [(1, 1, 0), (2, 1, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(marks, LABELS))
        assert {s for _, s in by_id(toxicity.score(docs, model), "score")} == {0}
    assert toxicity.score(documents(spark, []), model).collect() == []


def test_windows_hold_the_whole_text():
    for _, text in corpus() + ODD:
        assert b"".join(toxicity.windows(text or "")) == (text or "").lower().encode()


def test_quality_held_out(spark):
    rows, labels = rated()
    docs, held = documents(spark, rows + ODD), remainder(quality.F.col("doc_id")) == 0
    marks = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], LABELS)
    model = quality.train(docs, quality.graded(marks), 3, held_out=held)
    assert model.thresholds[0] < model.thresholds[1]
    got = by_id(quality.score(docs, model), "expected_grade", "tails")
    assert len(got) == len(rows) + len(ODD)
    assert all(1 >= t[0] >= t[1] >= 0 and abs(e - sum(t)) < 1e-9 for _, e, t in got)
    tails = {i: t for i, _, t in got if i is not None}
    test = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(tails[i][0] >= 0.5) == q for i, q in test]) > 0.95
    kept = quality.select(docs, model, 1, 0.5)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, t in got if t[0] >= 0.5)
    assert quality.select(documents(spark, []), model, 1, 0.5).collect() == []


def test_quality_gradient_direction():
    one = np.ones(1)
    model = quality.OrdinalModel([np.array([k]) for k in (1, 2, 3)] * 30, [one] * 90, [0, 1, 2] * 30, 3)
    assert model.weights[1] < model.weights[2] < model.weights[3]


def test_quality_without_ratings(spark):
    docs = documents(spark, corpus()[:3])
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert len(quality.score(docs, model).collect()) == 3


def test_lm_base_against_counts(spark):
    rows = corpus(n=40) + [(None, "one two one"), (5, corpus()[5][1]), (301, "ÀB Ab ab c\x1cd"), (302, "new line")]
    docs, held = documents(spark, rows), remainder(lm_score.F.col("doc_id")) == 1
    split = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\f\r" else c for c in t or "").split(" ")
    tokens = [[w for w in split(t) if w] + [None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total = sum(counts.values())
    want = sorted(((i, len(ws), sum(counts[w] > 0 for w in ws), total) for (i, _), ws in zip(rows, tokens)), key=str)
    base = {(i, t): sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in ws) for (i, t), ws in zip(rows, tokens)}
    for share in (5e-6, 0.02, 2.0):
        model = lm_score.train(docs, held, rate=2, rounds=2, share=share)
        out = lm_score.score(docs, model)
        assert by_id(out, "n_tokens", "n_known", "train_tokens") == want
        assert sorted(round(r.base_score, 6) for r in out.collect()) == sorted(round(base[r], 6) for r in rows)
    assert all(r.score < 0 for r in out.collect())
    assert lm_score.score(documents(spark, []), model).collect() == []
    nothing = lm_score.train(docs, lm_score.F.lit(True))
    assert {r.n_known for r in lm_score.score(docs, nothing).collect()} == {0}



def ranks():
    import base64

    with open(lm_score.RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_subwords_are_those_of_single_words():
    words = [b"plain", " a ".encode(), b"it's", b"12", "日本".encode(), b"\x1c\x1d", b"...x", "é ".encode()]
    sub = lm_score.Subwords(ranks())
    _, at, ends = sub.place([words, [], words[:2]])
    ids, stops = sub.flat(at, ends)
    one = [sub.encode(" " + w.decode()) for w in words]
    assert ids.tolist() == sum(one, []) + [lm_score.END, lm_score.END] + one[0] + one[1] + [lm_score.END]
    assert stops.tolist() == [sum(map(len, one)) + 1, sum(map(len, one)) + 2, len(ids)]


def test_words_of_texts_are_looked_up_once():
    """Texts are split as bytes split, and the cache is asked once for each different word of a chunk."""
    rows = ["", " \n", "\x1c a\x1f", "".join(map(chr, range(0x250))), "A\u0085B C\u2003d\u3000E İ ẞ", "x  Y x\x0b", "日本 Ab x x"]
    split = lm_score.split_words(rows)
    assert split.to_pylist() == [t.encode().lower().split() for t in rows]
    sub, asked = lm_score.Subwords(ranks()), []
    places = sub.places
    sub.places = lambda words: asked.extend(words) or places(words)
    words, at, ends = sub.place(split)
    assert Counter(asked) == Counter({*words.to_pylist(), None})
    assert [sub.known[w] for w in split.to_pylist()[-1]] == at[ends[-2]:-1].tolist() and at[ends[0] - 1] == sub.known[None]
    assert sub.place(lm_score.split_words(["", " "]))[1].tolist() == [sub.known[None]] * 2


def test_only_positions_in_use_pass_the_hidden_layer():
    net = lm_score.Attention(lm_score.Attention.initial(np.zeros(lm_score.CLASSES, dtype=np.float32)))
    rng = np.random.default_rng(0)
    slots, kinds = (rng.integers(0, n, (5, lm_score.WIDTH)) for n in (lm_score.INPUTS, lm_score.CLASSES))
    use = rng.random(slots.shape) < 0.6
    assert net.forward(slots, np.flatnonzero(use))["y"].shape == (use.sum(), lm_score.DIM)
    every = net.class_logs(slots, kinds, np.ones_like(use))
    assert np.allclose(net.class_logs(slots, kinds, use), every[use.ravel()], atol=1e-5)
    loss, g = net.gradient(slots, kinds, np.zeros_like(use))
    assert loss == 0 and not g.any()


def test_frozen_weights_score_as_the_model_in_training():
    """Whichever positions are in use, log probabilities are those of the forward pass, in the order of the positions."""
    rng = np.random.default_rng(0)
    net = lm_score.Attention(lm_score.Attention.initial(rng.normal(size=lm_score.CLASSES)))
    slots, kinds = (rng.integers(0, n, (200, lm_score.WIDTH)) for n in (lm_score.INPUTS, lm_score.CLASSES))
    use = rng.random(slots.shape) < 0.6
    use[::3, :lm_score.OVERLAP] = False
    at = np.flatnonzero(use)
    p = net.forward(slots, at)["y"] @ net.u + net.b
    want = p[np.arange(len(at)), kinds.ravel()[at]] - np.log(np.exp(p).sum(axis=1))
    assert np.allclose(net.class_logs(slots, kinds, use), want, atol=1e-4)
    queries = []
    logs = lm_score.Frozen.logs
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm_score.Frozen, "logs", lambda self, s, k: queries.append(k.shape) or logs(self, s, k))
        net.class_logs(slots, kinds, use)
    # windows of which the first positions are only context have no queries there
    assert {q for _, q in queries} == {lm_score.WIDTH, lm_score.WIDTH - lm_score.OVERLAP}
    assert sum(n for n, _ in queries) == len(slots)


def test_texts_are_coded_once(spark):
    """Training and scoring read stored ids, not texts: every text is split into its subwords in one pass."""
    rows = [*corpus(n=40), *ODD, (7, "one two"), (7, "one two")]
    docs, held = documents(spark, rows), remainder(lm_score.F.col("doc_id")) == 1
    words = lm_score.counted(docs, held)
    coded = lm_score.coded(docs, words, ~held)
    assert "text" not in coded.columns
    sub, got, want = lm_score.Subwords(ranks()), Counter(), Counter()
    for r in coded.collect():
        got[r.doc_id, tuple(np.frombuffer(r.ids, dtype=np.uint16).tolist()), r.size, r.learn] += 1
    for i, t in rows:
        _, at, ends = sub.place(lm_score.split_words([t or ""]))
        learn = i is None or zlib.crc32(str(i).encode()) % 5 != 1
        want[i, tuple(sub.flat(at, ends)[0].tolist()), len(t or ""), learn] += 1
    assert got == want
    scores = by_id(lm_score.rated(coded, lm_score.fitted(coded, words)), "n_tokens", "score")
    assert scores == by_id(lm_score.score(docs, lm_score.train(docs, held)), "n_tokens", "score")


def test_every_token_is_scored_once():
    lengths = np.array([1, 2, 4, 5, 15, 16, 17, 28, 29, 100])
    ids = np.arange(lengths.sum()).astype(np.int32)
    before, target, use, owner = lm_score.windows(ids, np.cumsum(lengths))
    assert sorted(target[use].tolist()) == ids.tolist()
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    assert all(b == (lm_score.END if t in starts else t - 1) for b, t in zip(before[use], target[use]))
    assert all(np.diff(owner) >= 0)


def test_model_is_causal_and_a_distribution():
    net = lm_score.Attention(lm_score.Attention.initial(np.zeros(lm_score.CLASSES, dtype=np.float32)))
    rng = np.random.default_rng(0)
    slots = rng.integers(0, lm_score.INPUTS, (1, lm_score.WIDTH))
    use = np.ones_like(slots, dtype=bool)
    every = np.stack([net.class_logs(slots, np.full_like(slots, k), use) for k in range(lm_score.CLASSES)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    later = slots.copy()
    later[0, 9:] = 3
    kinds = np.zeros_like(slots)
    assert np.allclose(net.class_logs(slots, kinds, use)[:9], net.class_logs(later, kinds, use)[:9], atol=1e-5)
    vocabulary = lm_score.Vocabulary(np.random.default_rng(1).poisson(2, lm_score.END + 1).astype(float))
    assert np.allclose(np.bincount(vocabulary.kind, weights=np.exp(vocabulary.within.astype(float))), 1, atol=1e-3)


def test_gradient():
    flat = lm_score.Attention.initial(np.zeros(lm_score.CLASSES)).astype(np.float64)
    rng = np.random.default_rng(0)
    slots, kinds = rng.integers(0, lm_score.INPUTS, (3, lm_score.WIDTH)), rng.integers(0, lm_score.CLASSES, (3, lm_score.WIDTH))
    use = rng.random(slots.shape) < 0.7
    g = lm_score.Attention(flat).gradient(slots, kinds, use)[1]
    for i in [*rng.integers(len(flat) - 3000, len(flat), 12), slots[0, 0] * lm_score.DIM + 1]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (lm_score.Attention(up).gradient(slots, kinds, use)[0] - lm_score.Attention(down).gradient(slots, kinds, use)[0]) / 2e-5
        assert slope == pytest.approx(g[i], abs=1e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    slots = np.cumsum(rng.integers(1, 3, (600, lm_score.WIDTH)), axis=1) % 50
    kinds, use = (slots + 1) % 50, np.ones((600, lm_score.WIDTH), dtype=bool)
    flat = lm_score.Attention.initial(np.zeros(lm_score.CLASSES, dtype=np.float32))
    before = lm_score.Attention(flat).gradient(slots, kinds, use)[0]
    for _ in range(4):
        flat = lm_score.descend(flat, slots, kinds, use, np.random.default_rng(1))
    assert lm_score.Attention(flat).gradient(slots, kinds, use)[0] < before / 2


def test_language_model_is_whole(spark):
    """Every training text is in exactly one round, and a scored token has the context of an overlap of four."""
    rows = [*corpus(), *ODD]
    learn = lm_score.texts(documents(spark, rows))
    parts = [Counter((r.doc_id, r.text) for r in lm_score.part_of(learn, k, lm_score.ROUNDS, lm_score.RATE).collect()) for k in range(lm_score.ROUNDS)]
    assert sum(parts, Counter()) == Counter((i, t or "") for i, t in rows)
    assert all(len([p for p in parts if key in p]) == 1 for key in sum(parts, Counter()))
    assert lm_score.OVERLAP >= 4 and lm_score.DIM >= 16 and lm_score.CLASSES >= 64
