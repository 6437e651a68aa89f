"""The classifiers against plain versions: features as strings, weights in dictionaries."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_llm_queries import held_out
from tidemark.llm import hashing, language, quality, toxicity
from tidemark.llm.hashing import Tables, Words


def sample(n, seed):
    rng = random.Random(seed)
    words = ["the", "sun", "is", "warm", "worthless", "idiots", "Haus", "été", "x.", "42", "%%%", "SHOUT!!", "longerword", "longerwords"]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.4
        text = [rng.choice(words) for _ in range(rng.randint(0, 25))] + (["ye", "stupid", "fools"] if bad else ["kind", "regards"])
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(text), int(not bad or rng.random() < 0.2), int(bad)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id bigint, quality int, toxic int")
    return docs, labels


def toxic_features(text):
    words = re.findall(r"[a-z\x80-\xff]+", text.lower().encode().decode("latin-1"))
    found = {("w", w) for w in words} | {("5", w[:5]) for w in words if len(w) > 5} | {("7", w[:7]) for w in words if len(w) > 7}
    return found | {("p", *p) for p in zip(words, words[1:], strict=False)} | {("s", *p) for p in zip(words, words[2:], strict=False)}


def test_toxicity_is_plain_ftrl(spark):
    rows = sample(160, 2)
    docs, labels = frames(spark, rows)
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, toxicity.fit(docs, labels, "toxic", l1=0.3)).collect()}
    known = [r for r in rows if not held_out(r[0])]
    z, n, alpha, beta, l1, l2 = {}, {}, 0.3, 1.0, 0.3, 0.1

    def weight(f):
        small = 0 if f == "bias" else l1
        v = z.get(f, 0.0)
        return -math.copysign(max(abs(v) - small, 0), v) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    for _ in range(4):
        for k in np.random.default_rng(3).permutation(len(known)):
            _, text, _, target = known[k]
            features = [*toxic_features(text), "bias"]
            w = {f: weight(f) for f in features}
            g = 1 / (1 + math.exp(-sum(w.values()))) - target
            for f in features:
                rate = (math.sqrt(n.get(f, 0) + g * g) - math.sqrt(n.get(f, 0))) / alpha
                z[f], n[f] = z.get(f, 0) + g - rate * w[f], n.get(f, 0) + g * g
    for i, text, _, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(map(weight, [*toxic_features(text), "bias"])))), abs=1e-4)


def quality_shares(text):
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    kind = lambda b: "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b) if 33 <= b < 127 and not 97 <= b <= 122 else "a"
    counts, seen = {}, set()

    def add(feature):
        counts[feature] = counts.get(feature, 0) + 1

    for i, w in enumerate(words):
        add(("word", w))
        add(("shape", kind(w[0]), *map(kind, w[-3:])))
        if i and w == words[i - 1]:
            add("again")
        if i > 1:
            three = tuple(words[i - 2 : i + 1])
            if three in seen:
                add("three")
            seen.add(three)
    return {f: 10.0 * n / max(1, len(words)) for f, n in counts.items()}


def test_quality_is_a_plain_cumulative_link_model(spark):
    rows = sample(150, 3)
    docs, labels = frames(spark, rows)
    model = quality.fit(docs, labels, "quality * (2 - toxic)", 3, rounds=6)
    got = {r["doc_id"]: r["expected_grade"] for r in quality.grades(docs, model).collect()}
    known = [(quality_shares(t), q * (2 - x)) for i, t, q, x in rows if not held_out(i)]
    names = {f: k for k, f in enumerate(dict.fromkeys(f for x, _ in known for f in x))}
    x = np.zeros((len(known), len(names)))
    for i, (shares, _) in enumerate(known):
        for f, v in shares.items():
            x[i, names[f]] = np.float32(v)
    y = np.array([g for _, g in known])
    theta = np.zeros(len(names) + 2)
    m, v, step, rng = np.zeros_like(theta), np.zeros_like(theta), 0, np.random.default_rng(7)

    def loss_gradient(at):
        def loss(t):
            edges = [-np.inf, t[-2], t[-2] + math.exp(t[-1]), np.inf]
            total = 0.0
            for xi, yi in zip(x[at], y[at], strict=True):
                s = xi @ t[:-2]
                tail = [1 / (1 + math.exp(min(700, e - s))) for e in edges]
                total -= math.log(max(1e-9, tail[yi] - tail[yi + 1]))
            return total / len(at)

        g = np.zeros_like(theta)
        for k in np.flatnonzero(np.append((x[at] != 0).any(0), [True, True])):
            d = np.zeros_like(theta)
            d[k] = 1e-5
            g[k] = (loss(theta + d) - loss(theta - d)) / 2e-5
        g[:-2] += 1e-4 * theta[:-2]
        return g

    for _ in range(6):
        order = rng.permutation(len(known))
        for start in range(0, len(order), 128):
            g, step = loss_gradient(order[start : start + 128]), step + 1
            m, v = m + 0.1 * (g - m), v + 0.01 * (g * g - v)
            theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    for i, text, _, _ in rows:
        s = sum(v * theta[names[f]] for f, v in quality_shares(text).items() if f in names)
        expected = sum(1 / (1 + math.exp(e - s)) for e in (theta[-2], theta[-2] + math.exp(theta[-1])))
        assert got[i] == pytest.approx(expected, abs=2e-3)


def plain_grams(text):
    """Gram counts by the bin of each gram; the bins are the operator's, everything else is plain."""
    read = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").lower().encode())
    out = np.zeros(1 << language.BITS)
    for size in (2, 3):
        for i in range(len(read) - size + 1):
            g = read[i : i + size]
            if g.count(b" ") <= 1 and not (size == 3 and g[1:2] == b" "):
                code = np.array([int.from_bytes(bytes([size]) + g, "big")], np.uint64)
                out[int(hashing.mixed(code)[0] >> np.uint64(64 - language.BITS))] += 1
    return out


def test_language_is_the_nearest_plain_centroid(spark):
    rng = random.Random(9)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zxcv", "qwer", "asdf"], "": ["ñandú", "über", "été"]}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(3, 20))), k) for i, k in enumerate(["aa", "bb", ""] * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, language.fit(docs, per_language=1)).collect()}
    counts = {i: plain_grams(t) for i, t, _ in rows}
    known = [(i, k) for i, _, k in rows if not held_out(i)]
    idf = np.log((1 + len(known)) / (1 + sum((counts[i] > 0).astype(int) for i, _ in known))) + 0.1
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    vector = {i: unit(np.sqrt(c) * idf) for i, c in counts.items()}
    centre = {k: unit(sum(vector[i] for i, own in known if own == k)) for k in words}
    for i, _, k in rows:
        cosines = {name: float(vector[i] @ c) for name, c in centre.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i][0] == best == k and got[i][1] == pytest.approx(cosines[best], abs=1e-4)


def test_cuts_of_long_texts_change_nothing(monkeypatch):
    rng = random.Random(5)
    words = [rng.choice(["ab", "cde", "x1", "%%", "été", "ab", "longlonglong", "...", "9"]) for _ in range(900)]
    texts = pa.array([" ".join(words + words), "short one", None, "   ".join(words[:500]) + "\n" * 300 + "é " * 300, "y" * 3000])
    weights = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32)
    runs = hashing.runs

    def results(piece):
        for module in (quality, toxicity, language):
            monkeypatch.setattr(module, "runs", lambda column, space, size=None: runs(column, space, piece))
        model = quality.Model(weights, np.array([0.0, 1.0]))
        grams = np.zeros((len(texts), 1 << language.BITS))
        for rows, counts in language.Grams().counts(texts):
            grams[rows] = counts
        return [quality.Scorer(model).tails(texts), quality._sparse()(texts), toxicity._sparse()(texts), grams]

    whole, cut = results(1 << 20), results(64)
    assert np.allclose(whole[0], cut[0], atol=1e-6) and (whole[3] == cut[3]).all()
    for a, b in ((whole[1], cut[1]), (whole[2], cut[2])):
        assert [x.to_pylist() for x in a] == [x.to_pylist() for x in b]


def test_long_texts_repeat_runs_of_words_over_cuts():
    tables = Tables()
    text = " ".join(f"w{i % 300}" for i in range(900)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = Words(data, np.array([0, len(data)]), tables)
    n = sum(int((at == 1).sum()) for _, at in quality.tokens(whole)[0][3:])
    three, total = np.zeros(0, np.uint64), 0
    (_, cut), = list(hashing.runs(pa.array([text.decode()]), tables.space, 100))
    for w, old in hashing.joined_words(cut, tables):
        found, three = quality.tokens(w, old, three)
        total += sum(int((at == 1).sum()) for _, at in found[3:])
    assert len(cut) > 5 and total == n == 898 - 300
