"""Language models, language identification and importance resampling."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blobsmith.llm import importance, lang_crf, ppm


def ppm_plainly(train, texts, order):
    """log10 probabilities with exclusion, method D and update exclusion, from plain dictionaries."""
    edge = 255
    top = defaultdict(Counter)
    for t in train:
        seq = [edge] * order + [*t.encode().lower(), edge]
        for i in range(order, len(seq)):
            top[tuple(seq[i - order : i])][seq[i]] += 1
    levels = {order: top}
    for k in range(order - 1, -1, -1):
        low = defaultdict(Counter)
        for ctx, f in levels[k + 1].items():
            for s in f:
                low[ctx[1:]][s] += 1
        levels[k] = low
    out = []
    for t in texts:
        seq, total = [edge] * order + [*t.encode().lower(), edge], 0.0
        for i in range(order, len(seq)):
            excluded, s = set(), seq[i]
            for k in range(order, -1, -1):
                f = levels[k].get(tuple(seq[i - k : i]))
                if f is None:
                    continue
                left = {x: n for x, n in f.items() if x not in excluded}
                if left:
                    mass = 2 * sum(left.values())
                    if s in left:
                        total += math.log10((2 * left[s] - 1) / mass)
                        break
                    total += math.log10(len(left) / mass)
                excluded |= set(f)
            else:
                total -= math.log10(256 - len(excluded))
        out.append(total)
    return out


def test_ppm_equals_plain_form(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcD é\n") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score(docs, F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 0).collect()}
    train = [t for i, t in enumerate(texts) if i % 3]
    tokens = Counter(w for t in train for w in [*t.encode().lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    for i, want in enumerate(ppm_plainly(train, texts, ppm.ORDER)):
        own = [*texts[i].encode().lower().split(), None]
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["held_out"] == (i % 3 == 0)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(tokens[w] > 0 for w in own), n)


def test_ppm_probabilities_add_up():
    """Over all next bytes the plain form, which equals the operator's, gives probabilities that sum to one."""
    ends = ppm_plainly(["abab", "abc"], ["ab"], 2)
    assert ends[0] < 0


def test_grams_and_costs_in_blocks():
    """Blocks that end inside texts give the grams and sums of one block."""
    texts = [b"", b"abcabc", b"x", b"", b"hello world, hello"]
    (_, whole), = ppm.gram_blocks(texts)
    parts = list(ppm.gram_blocks(texts, 4))
    assert len(whole) == sum(len(t) + 1 for t in texts) and np.concatenate([g for _, g in parts]).tolist() == whole.tolist()
    assert [at for at, _ in parts] == np.cumsum([0, *(len(g) for _, g in parts)])[:-1].tolist()
    chunk = ppm.Chunk()
    chunk.add(texts[:3], [True, False, True])
    chunk.add(texts[3:], [False, True])
    grams, n = chunk.merged_grams()
    known = Counter(g for i, t in enumerate(texts) if i in (0, 2, 4) for g in next(ppm.gram_blocks([t]))[1].tolist())
    assert dict(zip(grams.tolist(), n.tolist(), strict=True)) == {g: known[g] for g in sorted(set(whole.tolist()))}
    words = dict(zip(*(c.tolist() for c in chunk.merged_words()), strict=True))
    assert words == {"abcabc": 0, "x": 1, "hello": 2, "world,": 1} and chunk.ends == 3
    many = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000))
    costs = ppm.Costs(many, np.arange(len(many), dtype=float))
    assert costs.of(many[::-1]).tolist() == list(range(len(many)))[::-1]
    with pytest.raises(KeyError):
        costs.of(np.array([(1 << 48) + 5]))


def test_words_of_a_chunk():
    """A chunk that merges its parts again and again counts as one that does not, and words keep to their texts."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "ü", "b\x1cc", "\u3000", "long" * 9], k=rng.randrange(9))).encode() + b"\t" * rng.randrange(2) for _ in range(200)]
    chunk, plain = ppm.Chunk(), Counter()
    for k in range(0, len(texts), 7):
        part = texts[k : k + 7]
        chunk.add(part, [i % 2 == 0 for i in range(len(part))])
        chunk.merged_words(), chunk.merged_grams()
        plain.update(w for i, t in enumerate(part) if i % 2 == 0 for w in t.split())
    found = dict(zip(*(c.tolist() for c in chunk.merged_words()), strict=True))
    assert {w.encode(): n for w, n in found.items() if n} == plain
    order = sorted(w.encode() for w in found)
    parts = [texts[:50], texts[50:]]
    sums = ppm.Counts.of(iter(parts), np.array([*(plain[w] for w in order), 5])).sums(texts)
    for i, t in enumerate(texts):
        own = [plain[w] for w in t.split()] + [5]
        assert (sums["n_tokens"][i], sums["n_known"][i]) == (len(own), sum(c > 0 for c in own))
        assert sums["log_sum"][i] == pytest.approx(sum(math.log10(c + 0.1) for c in own))


def test_ppm_odd_rows(spark, odd_docs, no_docs):
    got = ppm.score(odd_docs, F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1)
    assert got.count() == odd_docs.count() and got.where("score is null or score >= 0 or base_score is null").count() == 0
    assert ppm.score(no_docs, F.lit(True), F.lit(False)).count() == 0
    nothing = ppm.score(odd_docs, F.lit(False), F.lit(True)).where("doc_id = 3").first()
    assert nothing["train_tokens"] == 0 and nothing["score"] == pytest.approx(-4 * math.log10(256))


LANGS = {"aa": "ka ti po ru se".split(), "bb": "xo wy zu qe vö".split()}


def code_switched(rng, n):
    return [(lang, [rng.choice(LANGS[lang]) + rng.choice(LANGS[lang]) for _ in range(12)]) for lang in rng.choices(["aa", "bb"], k=n)]


def test_crf_labels_switches():
    rng = random.Random(2)
    windows = code_switched(rng, 400)
    model = lang_crf.fit(lang_crf.sequences_from(windows, ["aa", "bb"]), ["aa", "bb"])
    text = "kati posese rupo tika xowy zuqe vözu wyqe kapo"
    each = next(iter(model.label([text])))
    assert [model.labels[i] for i in each.argmax(1)] == ["aa"] * 4 + ["bb"] * 4 + ["aa"]
    assert np.allclose(each.sum(1), 1) and model.switches[0, 0] > model.switches[0, 1]


def test_long_runs_of_letters_are_seen_whole():
    """A run of letters without blanks is labelled to its end, not by its first letters."""
    rng = random.Random(4)
    model = lang_crf.fit(lang_crf.sequences_from(code_switched(rng, 400), ["aa", "bb"]), ["aa", "bb"])
    start, rest = ("".join(rng.choices(LANGS[x], k=n)) for x, n in (("bb", 20), ("aa", 400)))
    each = next(iter(model.label([start + rest])))
    assert len(start) == 40 and "".join(lang_crf.words_of(start + rest)) == start + rest
    assert [model.labels[i] for i in each.argmax(1)] == ["bb"] + ["aa"] * 20


def test_features_do_not_depend_on_neighbours():
    """Each word's features are those of its n-grams, whatever words stand beside it; equal n-grams have equal features."""
    words = ["a", "ab", "banana", "日本語", "x" * 100, "straße", "an"]
    together = lang_crf.Features.of(words)
    ends = [*together.starts[1:].tolist(), len(together.grams)]
    for word, a, b in zip(words, together.starts.tolist(), ends, strict=True):
        alone = lang_crf.Features.of([word])
        assert alone.grams.tolist() == together.grams[a:b].tolist()
        marked = f"^{word[:lang_crf.LONGEST]}$"
        for i, row in enumerate(alone.grams.tolist()):
            for k, n in enumerate(lang_crf.GRAMS):
                assert (row[k] == lang_crf.FEATURES) == (i + n > len(marked))
    banana = lang_crf.Features.of(["banana"]).grams
    assert banana[2, 0] == banana[4, 0] and banana[2, 1] == banana[4, 1] != banana[1, 1]  # an, ana
    weights = np.random.default_rng(3).random((lang_crf.FEATURES + 1, 2)).astype(np.float32)
    weights[-1] = 0
    got, of_word = together.sums(weights), np.arange(1.0, len(words) + 1)
    assert np.allclose(of_word @ got[:, 0], together.spread(of_word) @ weights[:, 0])


def test_blocks_equal_one_pass():
    """Marginals over blocks are those of forward-backward over the whole chain."""
    rng = np.random.default_rng(5)
    model = lang_crf.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), rng.normal(size=(3, 3)), rng.normal(size=3))
    sizes = np.array([1, 31, 32, 33, 200])
    scores = rng.normal(size=(int(sizes.sum()), 3)) * 3
    got, at = model.marginals(scores, sizes), 0
    for n in sizes:
        e, step = np.exp(scores[at : at + n]), np.exp(model.switches)
        alpha, beta = [np.exp(model.start) * e[0]], [np.ones(3)]
        for t in range(1, n):
            alpha.append(alpha[-1] @ step * e[t])
            alpha[-1] /= alpha[-1].sum()
        for t in range(n - 1, 0, -1):
            beta.append(step @ (e[t] * beta[-1]))
            beta[-1] /= beta[-1].sum()
        both = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[at : at + n], both / both.sum(1, keepdims=True))
        at += n


def test_language_of_documents(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows = [(i, " ".join(w), lang) for i, (lang, w) in enumerate(code_switched(rng, 200))]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "123 ²½ !", "bb"), (None, "ka", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    fold = lang_crf.fold(F.col("doc_id"), 3)
    model = lang_crf.learn(docs.where(fold != 1))
    got = lang_crf.predict(docs, model, runs=True).join(docs.withColumnRenamed("lang", "truth").drop("text"), "doc_id").where("doc_id < 900")
    assert got.where("lang_pred = truth and score > 0.9").count() == 200
    rest = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_crf.predict(docs, model).where("doc_id >= 900").collect()}
    assert set(rest.values()) == {("und", 0.0)}
    assert lang_crf.learn(no_docs) is None and lang_crf.predict(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in lang_crf.predict(odd_docs, None).collect()} == {"und"}
    assert lang_crf.screen(odd_docs.unionByName(docs.limit(5), allowMissingColumns=True), model, 0.9).columns == odd_docs.columns


def test_crf_marginals_are_the_gradient():
    """Expected passages and marginals of a sequence against sums over all labellings."""
    rng = np.random.default_rng(2)
    model = lang_crf.Model(["a", "b", "c"], np.zeros((lang_crf.FEATURES + 1, 3), np.float32), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores = rng.normal(size=(1, 5, 3))
    single, double, total = np.zeros((5, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=5):
        weight = math.exp(model.start[path[0]] + sum(scores[0, t, y] for t, y in enumerate(path)) + sum(model.switches[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += weight
        for t, y in enumerate(path):
            single[t, y] += weight
        for a, b in zip(path, path[1:], strict=False):
            double[a, b] += weight
    got = lang_crf._expected(model, scores, np.array([5]))
    assert np.allclose(got[0][0], single / total) and np.allclose(got[1], double / total)


def test_resampling_draws_towards_the_target(spark, odd_docs, no_docs):
    rng = random.Random(8)
    good, bad = "the quick brown fox runs home".split(), "$$$ spam ### click buy now".split()
    docs = spark.createDataFrame([(i, " ".join(rng.choices(good if i % 2 else bad, k=30))) for i in range(400)], "doc_id long, text string")
    got = importance.select(docs, docs.where("doc_id % 2 = 1 and doc_id < 100"), 0.5).toPandas()
    assert got["kept"].sum() == 200 and got[got["kept"]]["doc_id"].mod(2).mean() > 0.99
    again = importance.select(docs, docs.where("doc_id % 2 = 1 and doc_id < 100"), 0.5).toPandas()
    assert set(again[again["kept"]]["doc_id"]) == set(got[got["kept"]]["doc_id"])
    odd = importance.select(odd_docs, odd_docs.where("doc_id = 4"), 0.5)
    assert odd.count() == odd_docs.count() and importance.select(no_docs, no_docs, 0.5).count() == 0
    assert importance.select(docs, docs.limit(0), 1.0).where("log_weight = 0 and kept").count() == 400


def test_resampling_equals_the_plain_way(spark):
    """Counts, weights, keys and the draw, worked out text by text."""
    rng = random.Random(10)
    texts = {i: " ".join(rng.choices(["Alpha", "beta", "gamma", "delta", "ÉTÉ"], k=rng.randrange(12))) for i in range(60)}
    docs = spark.createDataFrame([*texts.items(), (7, texts[7]), (None, "beta"), (None, None)], "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in (*range(0, 60, 4), None, 0, 999)], "doc_id long")
    rows = importance.select(docs, good, 0.4, buckets=50).collect()

    def features(text):
        words = [zlib.crc32(bytes(c + 32 if 65 <= c <= 90 else c for c in w)) for w in (text or "").encode().split()]
        pairs = [(a * 0x9E3779B1 + b * 0x85EBCA77 + 1) & 0x7FFFFFFFFFFFFFFF for a, b in zip(words, words[1:], strict=False)]
        return [x % 50 for x in [*words, *(p ^ (p >> 29) for p in pairs)]]

    all_texts = [r["text"] for r in docs.collect()]
    raw, target = Counter(b for t in all_texts for b in features(t)), Counter(b for i in range(0, 60, 4) for b in features(texts[i]))
    n_raw, n_target = sum(raw.values()) + 50, sum(target.values()) + 50

    def weight(text):
        return sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in features(text))

    assert len(rows) == 63 and sum(r["kept"] for r in rows) == round(0.4 * 63)
    noise = defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["n_features"] == len(features(texts[r["doc_id"]])) and r["log_weight"] == pytest.approx(weight(texts[r["doc_id"]]), abs=1e-9)
        noise[r["doc_id"]].add(round(r["gumbel_key"] - r["log_weight"], 9))
    assert all(len(x) == 1 for x in noise.values()) and len(set.union(*noise.values())) == len(noise)
    assert min(r["gumbel_key"] for r in rows if r["kept"]) >= max(r["gumbel_key"] for r in rows if not r["kept"])


@pytest.mark.parametrize("k", [0, 1, 3, 6])
def test_resampling_draws_as_many_as_asked_for(spark, k):
    """Rows that repeat an id and rows without one have equal keys."""
    for key in (5, None):
        rows = spark.createDataFrame([(key, 0.5, i) for i in range(6)], "doc_id long, log_weight double, row long")
        assert importance.resample(rows, k).where("kept").count() == k


@pytest.mark.parametrize("k", [1, 3, 50, 299, 300])
def test_kth_largest(spark, k):
    rng = random.Random(9)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(-1e6, 1), 0.5]) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "key double")
    assert importance.kth_largest(rows, k) == sorted(values, reverse=True)[k - 1]
