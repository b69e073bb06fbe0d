"""Toxicity and quality: held-out accuracy, calibration, edge cases; the kernel that their features rest on."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stratagraph.llm import quality, textkernel as tk, toxicity
from stratagraph.llm.trees import BoostedTrees, Isotonic, Logistic

DATA = "/root/testdata/sf0.01"


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = BoostedTrees().fit(x[:3000], y[:3000])
    assert ((m.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    p = Isotonic().fit(m.margin(x[:3000]), y[:3000])(m.margin(x[3000:]))
    assert p.min() >= 0 and p.max() <= 1 and len(m.margin(x[:0])) == 0


def test_isotonic_is_the_monotone_least_squares_fit():
    fit = Isotonic().fit(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert fit(np.array([1.0, 2.5, 4, 9])).tolist() == [0, 0.5, 1, 1]


def test_logistic():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 3))
    y = (r.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    assert abs(Logistic().fit(x, y)(x).mean() - y.mean()) < 0.01


def split(spark, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = labels.filter("pmod(xxhash64(doc_id, 5), 4) = 0")
    return spark.read.parquet(f"{DATA}/documents.parquet"), labels.join(held, "doc_id", "left_anti"), {r.doc_id: r[label] for r in held.collect()}


def test_toxicity_on_held_out_labels(spark):
    docs, train, held = split(spark, "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs, train).collect()}
    assert len(got) == docs.count()
    right = [got[d].toxic == bool(y) for d, y in held.items()]
    assert np.mean(right) > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, train).collect()}
    assert kept == {d for d, r in got.items() if not r.toxic}


def test_quality_on_held_out_labels(spark):
    docs, train, held = split(spark, "quality")
    got = {r.doc_id: r for r in quality.quality(docs, train).collect()}
    assert np.mean([got[d].keep == bool(y) for d, y in held.items()]) > 0.96


ROWS = [(1, "you are an idiot, you stupid clown", "a"), (2, "", "a"), (3, None, "b"), (None, "fine words", None), (1, "again", "a"), (4, "x " * 50_000, "b")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "en", 1, 2.0) for r in rows], "doc_id long, text string, source string, lang string, host long, p double")


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, None, 0), (None, 1, 1), (9, 5, 5)], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark), labels).collect()
    assert len(got) == len(ROWS) and [r.toxic for r in got] == [True, False, False, False, False, False] and got[2].score is None
    out = toxicity.drop_toxic(frame(spark), labels)
    assert out.count() == 5 and out.columns == frame(spark).columns
    q = quality.quality(frame(spark), labels).collect()
    assert len(q) == len(ROWS) and sum(r.quality is None for r in q) == 1 and all(r.evidence == 0.5 for r in q if r.evidence is not None)
    for f in (toxicity.score, toxicity.drop_toxic, quality.quality):
        assert f(frame(spark, []).limit(0), labels.limit(0)).count() == 0


def test_posteriors_shrink(spark):
    """A site of many good pages lifts a doubtful page more than a site of one."""
    rows = [(i, "Plain words in a sentence. " * 5, "good") for i in range(200)] + [(300 + i, "Xx%% ZZ## || !! " * 6, "bad") for i in range(200)] + [(700, "Plain words in a sentence. " * 5, "single")]
    rows += [(800, "Plain ZZ## words || in !! a sentence", "good"), (801, "Plain ZZ## words || in !! a sentence", "bad"), (802, "Plain ZZ## words || in !! a sentence", "new")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(300 + i, 0, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    q = {r.doc_id: r for r in quality.quality(frame(spark, rows), labels).collect()}
    assert q[800].evidence == q[801].evidence and q[800].quality > q[802].quality > q[801].quality
    assert q[802].path_posterior == pytest.approx(np.mean([r.evidence for r in q.values()]), abs=0.02)


def test_words_are_those_of_the_regex():
    r = random.Random(3)
    letters = "abcXYZ019_ .,-\n\tÀéßŒœ×÷İıΩж中«»ª² ́—😀'"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) for _ in range(400)] + [None, "", "a" * 70_000]
    seen, count = {}, []
    for lo, part in tk.slices(pa.array(texts)):
        w = tk.hash_words(*tk.lowered(part))
        count += w.count.tolist()
        for i in range(len(part)):
            own = re.findall(r"\w+", (texts[lo + i] or "").lower())
            for x, h in zip(own, w.hash[w.first[i] : w.first[i] + w.count[i]].tolist()):
                assert seen.setdefault(x, h) == h
    assert count == [len(re.findall(r"\w+", (t or "").lower())) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_obfuscated_words_count():
    f = toxicity.features(pa.array(["what an 1d10t", "what an idiot", "what an item"]), np.zeros(0, np.uint64), toxicity.hashes_of(["idiot"]), toxicity.hashes_of(["you"]))
    masked = toxicity.FEATURES.index("masked_hits")
    assert f[0, masked] > 0 == f[1, masked] == f[2, masked]


def slow_features(text, learned, abuse, second):
    """toxicity.features by plain loops."""
    low = text.lower()
    words = lambda t: re.findall(r"\w+", t)
    w = words(low)
    letter = lambda c: c.isascii() and c.isalpha() or not c.isascii() and c.encode()[0] >= 0xC0
    n, size = max(1, len(w)), max(1, len(text.encode()))
    hits = sum(x in abuse for x in w)
    masked = max(0, sum(x in abuse for x in words(low.translate(str.maketrans("013457@$", "oieastas")))) - hits)
    you = [k for k, x in enumerate(w) if x in second]
    near = sum((x in abuse or x in learned) and any(abs(k - y) <= toxicity.NEAR for y in you) for k, x in enumerate(w))
    raw = low.encode()
    is_letter = lambda b: 97 <= b <= 122 or b >= 0xC0
    mixed = sum(is_letter(a) and (48 <= b <= 57 or b in b"@$") or 48 <= a <= 57 and is_letter(b) for a, b in zip(raw, raw[1:]))
    again = sum(is_letter(a) and a == b == c for a, b, c in zip(raw, raw[1:], raw[2:]))
    signs = sum(33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in text.encode())
    own = sum(x in learned for x in w)
    return [np.log1p(len(w)), hits / n, np.log1p(hits), own / n, np.log1p(own), np.log1p(masked), np.log1p(near), len(you) / n, sum(c.isupper() for c in text) / max(1, sum(map(letter, text))),
            sum(c in "!?" for c in text) / size, signs / size, mixed / n, again / n]


def test_features_against_plain_loops():
    r = random.Random(6)
    bits = ["you", "idiot", "1d10t", "a$$hole", "IDIOT!", "Été", "ÉTÉ", "ПРИВЕТ", "мир", "plain", "x9", "sooo", "word", "’", "😀", "--", "?!", "vile"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(0, 30))) for _ in range(200)] + ["", "you are vile", "A" * 40_000]
    learned, abuse, second = {"vile"}, {"idiot", "asshole"}, {"you"}
    got = toxicity.features(pa.array(texts), *(toxicity.hashes_of(sorted(x)) for x in (learned, abuse, second)))
    odd = re.compile(r"[^\w\x00-\x7f]")
    for t, row in zip(texts, got):
        expect = slow_features(t, learned, abuse, second)
        plain = slow_features(odd.sub(" ", t), learned, abuse, second)
        expect = [p if k in (11, 12) else e for k, (e, p) in enumerate(zip(expect, plain))]
        assert row.tolist() == pytest.approx(expect, abs=1e-9), t


def test_masked_words_count_beside_any_character():
    masked, mixed = (toxicity.FEATURES.index(k) for k in ("masked_hits", "mixed_words"))
    texts = [f"you a$$hole and $hit{x}" for x in ("", " ’", " 😀", " Привет", " …", "\u00a0")]
    f = toxicity.features(pa.array(texts), np.zeros(0, np.uint64), toxicity.hashes_of(["asshole", "shit"]), toxicity.hashes_of(["you"]))
    assert (f[:, masked] == np.log1p(2)).all() and (f[:, mixed] > 0).all()


def test_posteriors_against_brute_force(spark):
    r = random.Random(7)
    good, bad = "Plain words in a sentence, and more of them. ", "Xx%% ZZ## || !! 99 "
    rows = [(i, "".join(r.choice([good, good, bad]) for _ in range(r.randrange(1, 9))), f"h{r.randrange(5)}") for i in range(150)] + [(500 + i, bad * 4, "h9") for i in range(40)] + [(900, None, "h1")]
    lang = [f"l{i % 3}" for i in range(len(rows))]
    df = spark.createDataFrame([(*x, y) for x, y in zip(rows, lang)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(d, int(d < 500), 0) for d, _, _ in rows if d % 2], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.quality(df, labels).collect()}
    p = {d: got[d].evidence for d, t, _ in rows if t is not None}
    site = {d: (h, y) for (d, _, h), y in zip(rows, lang)}
    mean = np.mean(list(p.values()))

    def prior(key):
        by = {}
        for d in p:
            by.setdefault(key(site[d]), []).append(p[d])
        within, n = mean * (1 - mean), len(p)
        between = sum(len(v) * (np.mean(v) - mean) ** 2 for v in by.values()) / n
        beyond = between - within * len(by) / n
        return by, min(1e6, max(1.0, (within - between) / beyond)) if beyond > 1e-12 else 1e6

    hosts, kh = prior(lambda s: s[0])
    paths, kp = prior(lambda s: s)
    for d in p:
        h, q = hosts[site[d][0]], paths[site[d]]
        host = (sum(h) - p[d] + kh * mean) / (len(h) - 1 + kh)
        path = (sum(q) - p[d] + kp * host) / (len(q) - 1 + kp)
        odds = lambda x: np.log(x / (1 - x))
        whole = 1 / (1 + np.exp(-(odds(min(1 - 1e-4, max(1e-4, p[d]))) + odds(path) - odds(mean))))
        assert (got[d].host_posterior, got[d].path_posterior, got[d].quality) == (pytest.approx(host, abs=1e-3), pytest.approx(path, abs=1e-3), pytest.approx(whole, abs=2e-2))
        assert got[d].keep == (got[d].quality >= 0.5)
    assert got[900].quality is None and not got[900].keep


def test_ids_of_any_type(spark):
    rows = [(f"d{i}", "you stupid idiot moron, you" if i % 3 == 0 else "plain words here", "a", "b") for i in range(60)] + [(None, "x", "a", "b")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, lang string")
    labels = spark.createDataFrame([(f"d{i}", 1 - int(i % 3 == 0), int(i % 3 == 0)) for i in range(60)], "doc_id string, quality int, toxic int")
    assert {r.doc_id for r in toxicity.score(df, labels).collect() if r.toxic} == {f"d{i}" for i in range(0, 60, 3)}
    assert toxicity.drop_toxic(df, labels).count() == 41 and quality.quality(df, labels).count() == 61
