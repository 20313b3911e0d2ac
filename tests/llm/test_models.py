import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from llm_fixtures import SF_MID, edge, empty, labels  # noqa: F401

from crisismap.llm import language_id as L
from crisismap.llm import lm_score as M
from crisismap.llm import toxicity as T

PIECES = ["<u>", "▁", "a", "b", "ab", "▁a", "ba", "aba"]


def cuts(text):
    if not text:
        yield ()
    for k in range(1, len(text) + 1):
        if text[:k] in PIECES or k == 1:
            for rest in cuts(text[k:]):
                yield (PIECES.index(text[:k]) if text[:k] in PIECES else 0, *rest)


@pytest.mark.parametrize("words", [["▁aba", "▁bab", "▁xab"], ["▁"], ["▁ababab", "▁bbbbbb"]])
def test_lattice_sums_over_all_cuts(words):
    p = np.random.default_rng(0).dirichlet(np.ones(8), 2).T
    lattice = L.Lattice(words, L.Pieces(PIECES))
    want = [[sum(math.prod(p[i, l] for i in c) for c in cuts(w)) for l in (0, 1)] for w in words]
    assert np.allclose(lattice.forward(p), want)
    language, got, expected = np.arange(len(words)) % 2, np.zeros((8, 2)), np.zeros((8, 2))
    lattice.expected(p, language, np.arange(1.0, len(words) + 1), got)
    for w, word in enumerate(words):
        l = language[w]
        total = sum(math.prod(p[i, l] for i in c) for c in cuts(word))
        for c in cuts(word):
            for i in c:
                expected[i, l] += (w + 1) * math.prod(p[i, l] for i in c) / total
    assert np.allclose(got, expected)


def by_fractions(word, p, l):
    """Totals from the left and from the right and the expected use of each piece, in exact arithmetic."""
    n, edges = len(word), []
    for i in range(n):
        for k in range(1, 4):
            if i + k <= n and (k == 1 or word[i:i + k] in PIECES):
                edges.append((i, i + k, PIECES.index(word[i:i + k]) if word[i:i + k] in PIECES else 0))
    share = [Fraction(float(x)) for x in p[:, l]]
    left, right = [Fraction(0)] * (n + 1), [Fraction(0)] * (n + 1)
    left[0] = right[n] = Fraction(1)
    for i, j, x in edges:
        left[j] += left[i] * share[x]
    for i, j, x in reversed(edges):
        right[i] += right[j] * share[x]
    used = np.zeros(len(p))
    for i, j, x in edges:
        used[x] += float(left[i] * share[x] * right[j] / left[n])
    return left[n], used


def log_of(x):
    return math.log(x.numerator) - math.log(x.denominator)


@pytest.mark.parametrize("block", [L.BATCH_CHARS, 40])
def test_long_runs_are_summed_whole(monkeypatch, block):
    monkeypatch.setattr(L, "BATCH_CHARS", block)
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(8), 2).T
    p[[0, 2], 0] = 1e-12  # 500 rare characters are far below the smallest double
    words = ["▁" + "".join(rng.choice(list("abx"), n)) for n in (500, 463, 40, 15, 16, 31, 32, 1)] + ["▁" + "xa" * 250]
    language, weight = np.arange(len(words)) % 2, np.arange(1.0, len(words) + 1)
    lattice, got, want = L.Lattice(words, L.Pieces(PIECES)), np.zeros((8, 2)), np.zeros((8, 2))
    logs = lattice.log_forward(p)
    assert np.allclose(logs, [[log_of(by_fractions(w, p, l)[0]) for l in (0, 1)] for w in words], rtol=1e-12)
    assert logs.min() < -5000
    lattice.expected(p, language, weight, got)
    for w, word in enumerate(words):
        want[:, language[w]] += weight[w] * by_fractions(word, p, language[w])[1]
    assert np.allclose(got, want, rtol=1e-9)


def test_language_of_a_text_without_spaces(spark):
    docs = spark.createDataFrame([(0, "abcab" * 40, "p"), (1, "xyzxy" * 40, "q")], "doc_id long, text string, lang string")
    model = L.train(docs)
    long = spark.createDataFrame([(2, "abcab" * 60_000), (3, "xyzxy" * 60_000 + "!")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.identify(long, model).collect()} == {2: "p", 3: "q"}
    batches = list(L.by_length(["a" * n for n in (1, 1, 7, 8, 9, 10, 100, 112, 113)]))
    assert batches == [[0, 1], [2], [3, 4], [5], [6, 7], [8]]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    truth = dict(docs.select("doc_id", "lang").collect())
    rows = L.op5_language_id(spark, SF_MID).collect()
    apart = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in apart) >= 0.98 * len(apart)


def test_language_edges(edge, empty):
    model = L.train(edge)
    rows = {r.doc_id: r for r in L.identify(edge, model).collect()}
    assert len(rows) == 9 and rows[6]["rank"] == "other"
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 8))
    assert rows[6].lang_pred in ("en", "fr")
    none = L.train(empty)
    assert {r.lang_pred for r in L.identify(edge, none).collect()} == {"und"}
    assert L.identify(empty, model).count() == 0


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = T.op9_toxicity(spark, SF_MID).collect()
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    apart = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in apart)
    assert right >= 0.95 * len(apart)


def plain_logit(model, text):
    """The bias, each present term's weight, and the product of the factors of each pair of present terms."""
    present = sorted({t for w in T.words(text) for t in T.word_terms(w)} & set(model.terms.tolist()))
    at = [int(np.flatnonzero(model.terms == t)[0]) for t in present]
    pairs = sum(float(model.factors[a] @ model.factors[b]) for i, a in enumerate(at) for b in at[i + 1:])
    return model.bias + sum(float(model.weights[a]) for a in at) + pairs


def test_scores_are_sums_over_all_pairs(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}x" for i in range(30)]
    terms = np.unique([t for w in vocabulary[:20] for t in T.word_terms(w)])
    model = T.Model(terms, rng.normal(0, 0.3, terms.size), rng.normal(0, 0.3, (terms.size, T.FACTORS)), -0.4)
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 5, 20, 300, 3000)] + ["", "nothing known"]
    want = [1 / (1 + math.exp(-plain_logit(model, t))) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=1e-12)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.score, r.predicted) for r in T.score(docs, model).collect()}
    assert all(abs(got[i][0] - w) < 1e-12 and got[i][1] == int(w >= 0.3) for i, w in enumerate(want))


def test_a_step_follows_the_gradient():
    """One batch moves weights, factors and bias against differences of the written-out loss."""
    docs, labels = [["good", "day"], ["bad", "day"], ["bad", "cat", "day"]], np.array([0.0, 1.0, 0.0])
    terms = [np.unique([t for w in d for t in T.word_terms(w)]) for d in docs]
    kept = np.unique(np.concatenate(terms))

    def loss(model):
        logits = np.array([plain_logit(model, " ".join(d)) for d in docs])
        shrink = T.SHRINK / 2 * ((model.weights ** 2).sum() + (model.factors ** 2).sum())
        return float((np.log1p(np.exp(logits)) - labels * logits).sum()) + shrink

    def after(epochs):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(T, "EPOCHS", epochs)
            return T._fitted(terms, labels, kept)

    start, one = after(0), after(1)
    for name, rate in (("weights", T.RATE), ("factors", T.RATE * 0.3)):
        values, moved = getattr(start, name), getattr(one, name)
        for at in np.ndindex(values.shape):
            old, sides = values[at], []
            for d in (1e-6, -1e-6):
                values[at] = old + d
                sides.append(loss(start))
            values[at] = old
            g = (sides[0] - sides[1]) / 2e-6
            assert abs(moved[at] - (old - rate * g / math.sqrt(g * g + 1e-6))) < 1e-4, (name, at)


def test_pairs_count_that_linear_weights_miss():
    # either word alone is toxic, the two together are not: no sum of single weights says so
    docs = [("bad", "cat")] * 300 + [("bad",)] * 300 + [("cat",)] * 300 + [("dog",)] * 900
    labels = np.array([0.0] * 300 + [1.0] * 600 + [0.0] * 900)
    model = T.fit([np.unique([t for w in d for t in T.word_terms(w)]) for d in docs], labels)
    both, one, other, none = model.scores(["bad cat", "bad", "cat", "dog"])
    assert both < 0.3 and none < 0.3 and one > 0.7 and other > 0.7


def test_pairs_count_whose_words_tell_nothing_alone():
    # each of the two words is in half of the toxic and in half of the clean texts, both are in toxic ones only
    docs = [("gruppe", "wichtig")] * 300 + [("foul",)] * 300 + [("gruppe",)] * 600 + [("wichtig",)] * 600
    labels = np.array([1.0] * 600 + [0.0] * 1200)
    terms = [np.unique([t for w in d for t in T.word_terms(w)]) for d in docs]
    assert not set(T.word_terms("gruppe") + T.word_terms("wichtig")) & set(T.screened(terms, labels).tolist())
    both, foul, one, other = T.fit(terms, labels).scores(["gruppe wichtig", "foul", "gruppe", "wichtig"])
    assert both > 0.7 and foul > 0.7 and one < 0.3 and other < 0.3


def test_every_pair_of_words_once():
    for n in range(7):
        pairs = [tuple(sorted(p)) for a, b in T._pairs(np.arange(n)) for p in zip(a.tolist(), b.tolist())]
        assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_toxicity_edges(edge, empty, labels):
    model = T.train(edge, labels)
    rows = T.score(edge, model).collect()
    assert len(rows) == edge.count() and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    kept = T.drop_toxic(edge, labels, 2.0)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    assert T.drop_toxic(empty, labels).count() == 0
    assert T.score(edge, T.train(edge, labels.limit(0))).count() == edge.count()


def test_model_is_a_distribution():
    rng = np.random.default_rng(5)
    model = M.Model.start(rng.integers(1, 99, M.CLASSES).astype(float), rng.integers(1, 99, (M.FREQUENT, M.WIDTH)).astype(float))
    model.outer += rng.normal(0, 1, model.outer.shape).astype(np.float32)
    model.inner += rng.normal(0, 1, model.inner.shape).astype(np.float32)
    codes = np.array([c * M.WIDTH + w for c in range(M.CLASSES) for w in (range(M.WIDTH) if c < M.FREQUENT else [0])])
    one, two = np.full(codes.size, 12345, np.uint64), np.full(codes.size, 777, np.uint64)
    assert abs(np.exp(model.logs(one, two, codes)).sum() - 1) < 1e-4


def test_scores_by_definition(spark):
    texts = dict(spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect())
    rows = M.op6_lm_score(spark, SF_MID).collect()
    counts = Counter()
    for i, text in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(M.tokens(text or ""))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = M.tokens(texts[r.doc_id] or "")
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert abs(base - r.base_score) < 1e-6 and r.n_tokens == len(own) and r.train_tokens == n
        assert r.n_known == sum(counts[w] > 0 for w in own)
    apart = [r for r in rows if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_lm_edges(edge, empty):
    rows = M.score(edge).collect()
    assert len(rows) == edge.count()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert M.score(empty).count() == 0


def test_lm_scores_hardly_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r for r in M.score(docs.repartition(n, "doc_id")).collect()} for n in (1, 50))
    for held in (False, True):
        a, b = (sum(r.score for r in rows.values() if r.held_out == held) for rows in (one, many))
        assert abs(a - b) < 0.004 * abs(a)


def test_lm_rows_are_weighted_by_their_tokens():
    def moved(weight, uses):
        of = [np.full((M.ROWS, w), weight, np.float32) for w in (M.CLASSES, M.WIDTH)]
        return list(M._blocks(*of, np.ones((2, M.ROWS), np.float32), np.full((2, M.ROWS), uses)))
    assert moved(1.0, 0) == []  # a learner without the context doesn't take part
    for batch in M._mean(iter(moved(1.0, 30) + moved(3.0, 10))):
        outer, inner, _, uses = M._block_of(*(batch.column(i)[0].as_py() for i in range(1, 5)))
        assert np.allclose(outer, 1.5) and np.allclose(inner, 1.5) and (uses == 40).all()


def test_lm_turns_follow_the_counts_of_all_words():
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 1 << 32, 400)
    hashes[200:] = (hashes[:200] & ~0xFFFF) | rng.integers(0, 1 << 16, 200)  # pairs that only the last bits tell apart
    counts = np.concatenate((rng.integers(1, 50, 300), np.zeros(100, np.int64)))  # a quarter is unseen
    codes = np.full(400, (M.FREQUENT + 3) * M.WIDTH)
    top = np.zeros((2, M.SHAPES, M.TOPS + 1), np.int64)
    for h, c in zip(hashes[:300].tolist(), counts.tolist()):
        top[:, 3, (h >> 16) + 1] += (c, 1)
    vocab = M.Vocabulary({}, np.zeros((M.FREQUENT, M.WIDTH)), np.zeros(M.SHAPES), np.zeros(M.SHAPES), 0, 0, *top.cumsum(axis=2))
    paths, share = M.paths_of(vocab, counts, hashes, codes, *M.deep_turns(np.full(400, 3), hashes, counts))
    model = M.Model.start(np.ones(M.CLASSES), np.ones((M.FREQUENT, M.WIDTH)))
    context = np.full(400, 12345, np.uint64)
    got = model.turn_logs(context, context, np.arange(400), paths) + share
    known = list(zip(hashes[:300].tolist(), counts.tolist()))
    for h, c, log in zip(hashes.tolist(), counts.tolist(), got.tolist()):
        inside, bit, want = known, 31, 0.0
        while len(inside) > 1 and bit >= 0:
            sides = [[x for x in inside if x[0] >> bit & 1 == side] for side in (0, 1)]
            mass = [sum(n for _, n in s) + 0.1 * (len(s) + 1) for s in sides]
            side = h >> bit & 1
            want += math.log(mass[side] / sum(mass))
            inside, bit = sides[side], bit - 1
        want += math.log((c + 0.1) / (sum(n for _, n in inside) + 0.1 * (len(inside) + 1)))
        assert abs(log - want) < 0.01


def test_lm_words_of_one_shape_depend_on_their_contexts(spark):
    """Words of one shape beyond the frequent ones: pairs as learned outscore the same words with other partners."""
    def word(head, i):
        return head + "".join(chr(97 + i // 26 ** k % 26) for k in range(3))

    n = 100
    learned, apart = ([i for i in range(20_000) if (zlib.crc32(str(i).encode()) % 10 == 0) == held] for held in (False, True))
    rows = [(learned[i], " ".join(word("a", k) for k in range(256))) for i in range(40)]  # these take the frequent places
    rows += [(learned[40 + 20 * i + k], f"{word('y', i)} {word('z', i)}") for i in range(n) for k in range(20)]
    right = [(apart[i], f"{word('y', i)} {word('z', i)}") for i in range(n)]
    wrong = [(apart[n + i], f"{word('y', i)} {word('z', (i + 1) % n)}") for i in range(n)]
    got = {r.doc_id: r.score for r in M.score(spark.createDataFrame(rows + right + wrong, "doc_id long, text string").coalesce(1), 8).collect()}
    assert sum(got[i] for i, _ in right) - sum(got[i] for i, _ in wrong) > 0.3 * n


def test_lm_run_sums_equal_those_of_whole_runs():
    """Runs of few and of many rows, bit by bit as one ``reduceat`` over all has them."""
    rng = np.random.default_rng(9)
    for lengths in (np.array([1]), np.array([9, 40]), np.ones(5, np.int64), np.concatenate((rng.integers(1, 13, 300), [500, 8, 9, 2]))):
        values = rng.normal(0, 1, (int(lengths.sum()), 7)).astype(np.float32)
        order, heads = rng.permutation(len(values)), np.cumsum(lengths) - lengths
        which, sums = M._run_sums(values, order, heads, lengths)
        assert sorted(which.tolist()) == list(range(lengths.size))
        assert np.array_equal(sums, np.add.reduceat(values[order], heads, axis=0)[which])


def test_lm_upper_trees_follow_the_words_way():
    """Log odds, steps and leaves of hashes' first bits, each by going down from the root."""
    rng = np.random.default_rng(10)
    top = np.zeros((2, M.SHAPES, M.TOPS + 1), np.int64)
    for place in rng.integers(0, M.TOPS, 300).tolist() + [5, 5, 4]:
        top[:, 3, place + 1] += (int(rng.integers(1, 50)), 1)
    top[:, 7, 10] += (4, 1)
    vocab = M.Vocabulary({}, np.zeros((M.FREQUENT, M.WIDTH)), np.zeros(M.SHAPES), np.zeros(M.SHAPES), 0, 0, *top.cumsum(axis=2)).sent()
    odds, depth, *leaf = vocab.top
    assert vocab.top_tokens is None
    for shape, place in [(s, p) for s in (0, 3, 7) for p in [4, 5, 9, *rng.integers(0, M.TOPS, 50).tolist()]]:
        a, b, level = 0, M.TOPS, 0
        while level < M.TOP_BITS and top[1, shape, a + 1:b + 1].sum() > 1:
            middle = (a + b) // 2
            left, right = (top[:, shape, x + 1:y + 1].sum(axis=1) for x, y in ((a, middle), (middle, b)))
            want = math.log(right[0] + 0.1 * (right[1] + 1)) - math.log(left[0] + 0.1 * (left[1] + 1))
            assert abs(odds[shape, (1 << level) + (place >> (M.TOP_BITS - level))] - want) < 1e-5
            a, b, level = (middle, b, level + 1) if place >= middle else (a, middle, level + 1)
        assert depth[shape, place] == level
        assert [x[shape, place] for x in leaf] == top[:, shape, a + 1:b + 1].sum(axis=1).tolist()
