"""Line dedup, the n-gram join and decontamination against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import common, decontaminate, line_dedup, ngram_join, setjoin, textkernel as tk

WORD = re.compile(r"\w+")
CLASH = "bucket long, id long, gone_doc long, gone_lines string, kept_text string, set_id long, row_key long, line int, size int, comp long, v long, token long"
EXTRA = (1, 2, 3, "x", "y", 4, 5, 6, 7, 8, 9, 10)


def documents(seed=0, n=120):
    """Random texts, copies and near copies; nulls, blanks, very long texts, odd letters and repeated rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Été", "straße", "naïve", "x×y", "ΩMEGA", "a_b"]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [line(k) for k in (3, 12, 60)]
    rows = []
    for i in range(n):
        if i > 10 and r.random() < 0.4:
            w = rows[r.randrange(len(rows))][1].split(" ")
            for _ in range(int(len(w) * r.choice([0, 0.02, 0.05, 0.1, 0.3]))):
                w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        else:
            text = "\n".join(line(r.randrange(1, 40)) for _ in range(r.randrange(1, 6)))
            if r.random() < 0.3:
                text += "\n" + r.choice(shared)
        rows.append((i, text))
    rows += [(n, ""), (n + 1, " \n\t "), (n + 2, "one"), (n + 3, "one"), (n + 4, "one two"), (n + 5, "!!!"), (n + 6, line(20_000)), (n + 7, rows[3][1]), (5, rows[5][1])]
    return rows


def frame(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*x, *EXTRA) for x in rows], "doc_id long, text string, " + CLASH).repartition(3)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def shingles(text, n):
    w = WORD.findall(text.lower())
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def similar(a, b, t):
    return len(a & b) >= t * len(a | b) - 1e-9


@pytest.mark.parametrize("shingle, threshold", [(3, 0.6), (1, 0.8), (2, 0.5)])
def test_ngram_join(spark, shingle, threshold):
    rows = documents(shingle)
    spec = setjoin.SetSpec(shingle, False, threshold, 0.1, 18)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.ngram_jaccard_join(frame(spark, rows, True), spec).collect()}
    sets = {d: s for d, t in rows if (s := shingles(t, shingle))}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    expect = {(first[s], d): 1.0 for d, s in sets.items() if first[s] != d}
    reps = sorted(first.values())
    expect |= {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(reps) for b in reps[i + 1 :] if similar(sets[a], sets[b], threshold)}
    assert got.keys() == expect.keys() and all(got[k] == pytest.approx(expect[k], abs=1e-6) for k in got)
    assert len(expect) > 10


def brute_classes(rows, shingle, threshold):
    sets = {d: s for d, t in rows if (s := shingles(t, shingle))}
    beside = {a: [b for b in sets if a != b and similar(sets[a], sets[b], threshold)] for a in sets}
    out = {}
    for d in sorted(sets):
        if d not in out:
            out[d], todo = d, [d]
            while todo:
                for x in beside[todo.pop()]:
                    if x not in out:
                        out[x] = d
                        todo.append(x)
    return {(d, out[d], min(x for x in sets if sets[x] == sets[d]), len(sets[d]), len(beside[d])) for d in sets}


@pytest.mark.parametrize("shingle, threshold", [(3, 0.6), (1, 0.8)])
def test_ngram_classes(spark, shingle, threshold):
    rows = documents(shingle + 20)
    got = ngram_join.ngram_classes(frame(spark, [*rows, (None, rows[0][1]), (901, None)], True), setjoin.SetSpec(shingle, False, threshold, 0.1, 18)).collect()
    expect = brute_classes(rows, shingle, threshold)
    assert len(got) == len(expect) and {tuple(r) for r in got} == expect and sum(r.n_links > 0 for r in got) > 10


def test_blocks_bound_what_a_task_holds(spark, monkeypatch):
    """A dense group beyond a block, and a chain of similar sets: every link is counted once, and no cell holds a whole group."""
    monkeypatch.setattr(setjoin, "BLOCK_SETS", 32)
    r = random.Random(4)
    base = [f"b{k}" for k in range(200)]
    dense = [(i, " ".join([*base, f"own{i}"])) for i in range(300)]
    chain = [(1000 + i, " ".join(f"c{k}" for k in range(i, i + 20))) for i in range(1500)]
    rows = [*dense, *chain, (5000, dense[7][1])]
    r.shuffle(rows)
    got = {x.doc_id: x for x in ngram_join.ngram_classes(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].class_id == 0 and got[i].n_links == 300 for i in [*range(300), 5000]) and got[5000].copy_of == 7
    near = lambda i: min(i, 4) + min(1499 - i, 4)
    assert all(got[1000 + i].class_id == 1000 and got[1000 + i].n_links == near(i) for i in range(1500))
    table = setjoin.profile(frame(spark, rows), ngram_join.SPEC)
    occ = setjoin.occurrences(table)
    classes = occ.groupBy("set_id", "rest").agg(F.min(F.struct("doc_id", "row_key", "line")).alias("f"), F.count("*").alias("n"), F.max("size").alias("size")).select("set_id", "rest", "f.*", "n", "size")
    cells = setjoin._cells(setjoin.candidates(frame(spark, rows), ngram_join.SPEC, setjoin.rarity(table, ngram_join.SPEC)), classes)
    assert max(x["count"] for x in cells.groupBy("lo", "hi").count().collect()) <= 120


def test_pairs_leave_their_bucket_once(spark, monkeypatch):
    """Near copies meet in most of their tokens, more often than a worker holds pairs; each pair is moved once by each bucket."""
    moved = []
    cls = type(spark.range(1))
    repartition = cls.repartition

    def watched(self, n, *by):
        if by == ("a",):
            moved.append(self)
        return repartition(self, n, *by)

    monkeypatch.setattr(cls, "repartition", watched)
    rows = [(i, " ".join([*(f"b{k}" for k in range(400)), f"own{i}"])) for i in range(250)]
    docs = frame(spark, rows)
    table = setjoin.profile(docs, ngram_join.SPEC)
    found = setjoin.candidates(docs, ngram_join.SPEC, setjoin.rarity(table, ngram_join.SPEC))
    entries = moved[0].select(F.spark_partition_id().alias("bucket"), "a", F.explode(F.arrays_zip("b", "shared")).alias("z")).select("bucket", "a", "z.*").collect()
    assert sum(r.shared for r in entries) > 2 * setjoin.HELD_PAIRS
    assert len(entries) == len({(r.bucket, r.a, r.b) for r in entries})
    pairs = {frozenset((r.a, r.b)) for r in found.filter("a IS NOT NULL").selectExpr("a", "explode(b) b").collect()}
    assert len(pairs) == 250 * 249 // 2


def test_words_whose_hashes_begin_alike(spark):
    """q6c2eab and q85dea9 agree in the upper 44 bits of their hashes."""
    words = ["q6c2eab", "q85dea9", "other"]
    h = tk.hash_words(*tk.lowered(pa.array(words))).hash
    assert h[0] >> np.uint64(20) == h[1] >> np.uint64(20) and h[0] != h[1]
    s = tk.token_sets(np.array([0, 0, 1, 2]), h[[0, 1, 0, 1]], 3)
    ids = list(zip(*(x.tolist() for x in tk.set_ids(s))))
    assert s.size.tolist() == [2, 1, 1] and len(set(ids)) == 3 and len(set(s.token[:2].tolist())) == 2
    rows = [(i, w) for i, w in enumerate(words)]
    assert sorted(r.doc_id for r in line_dedup.line_dedup(frame(spark, rows)).collect()) == [0, 1, 2]
    rows = [(i, f"a b c d e f g {w}") for i, w in enumerate(words)] + [(3, "a b c d e f g q6c2eab q85dea9")]
    got = {tuple(x) for x in ngram_join.ngram_classes(frame(spark, rows), setjoin.SetSpec(1, False, 0.85, 0.1, 18)).collect()}
    assert got == brute_classes(rows, 1, 0.85)


def test_ids_of_any_type(spark):
    rows = [(f"d{i:03d}", t) for i, t in documents(5, 60)[:60]] + [("x y", "a b c d e"), (None, "a b c d e"), ("zz", None)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id string, text string, own_id string").repartition(3)
    by = {d: i for i, d in enumerate(sorted(d for d, _ in rows if d))}
    whole = [(d, t) for d, t in rows if d and t]
    name = {v: k for k, v in by.items()}
    expect = {(name[a], name[b], name[c], n, m) for a, b, c, n, m in brute_classes([(by[d], t) for d, t in whole], 3, 0.6)}
    assert {tuple(r) for r in ngram_join.ngram_classes(df).collect()} == expect
    numbers = spark.createDataFrame([(by.get(d), t) for d, t in rows], "doc_id long, text string")
    for f in (line_dedup.line_dedup, ngram_join.drop_near_copies):
        got = collections.Counter((r.doc_id, r.text) for r in f(df).collect())
        assert f(df).columns == df.columns and got == collections.Counter((name.get(r.doc_id), r.text) for r in f(numbers).collect())
    item = [("i1", rows[0][1]), (None, "x")]
    bench = spark.createDataFrame(item, "item_id string, text string")
    leaks = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert ("d000", "i1") in leaks and ("d000",) not in {(r.doc_id,) for r in decontaminate.drop_contaminated(df, bench).collect()}


def test_near_copies_keep_the_first(spark):
    rows = documents(7)
    kept = sorted(r.doc_id for r in ngram_join.drop_near_copies(frame(spark, [*rows, (None, "lost id"), (900, None)], True)).collect() if r.doc_id is not None)
    sets = {d: s for d, t in rows if (s := shingles(t, 3))}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and similar(sets[a], sets[b], 0.6):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    gone = {d for d in sets if find(d) != d}
    assert kept == sorted([d for d, _ in rows if d not in gone] + [900])


def test_line_dedup(spark):
    rows = documents(3)
    df = frame(spark, [*rows, (None, rows[0][1]), (901, None)], True)
    out = collections.Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(df).collect())
    assert line_dedup.line_dedup(df).columns == df.columns
    seen, gone = [], collections.defaultdict(set)
    for d, t in sorted({(d, t) for d, t in rows}):
        for i, x in enumerate(t.split("\n")):
            s = frozenset(WORD.findall(x.lower()))
            if s:
                if any(similar(s, o, 0.8) for o in seen):
                    gone[d].add(i)
                seen.append(s)
    expect = collections.Counter({(None, rows[0][1]): 1, (901, None): 1})
    for d, t in rows:
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        if not gone[d] or kept.strip():
            expect[d, kept] += 1
    assert out == expect


def test_rows_that_repeat_an_id_with_other_texts(spark):
    out = [(r.doc_id, r.text) for r in line_dedup.line_dedup(frame(spark, [(1, "a b c d e\nf g h i j"), (1, "k l m n o\nf g h i j")])).collect()]
    assert sorted(len(t.split("\n")) for _, t in out) == [1, 2]


@pytest.mark.parametrize("f", [ngram_join.ngram_jaccard_join, ngram_join.drop_near_copies, line_dedup.line_dedup])
def test_nothing_to_do(spark, f):
    assert f(frame(spark, []).limit(0)).count() == 0
    assert f(frame(spark, [(1, None), (None, None), (2, "")])).count() in (0, 3)


def test_similar_pairs_derives_answers():
    r = np.random.default_rng(1)
    base = r.choice(10**6, 300, replace=False)
    sets = [np.unique(np.concatenate([r.choice(base, 280, replace=False), r.choice(10**6, 20)])) for _ in range(150)] + [np.unique(r.choice(10**6, 50)) for _ in range(20)]
    size = np.array([len(s) for s in sets])
    i, j, ov = setjoin.similar_pairs(np.concatenate(sets), size, 0.75)
    expect = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    expect = {k: v for k, v in expect.items() if v >= 0.75 * (size[k[0]] + size[k[1]] - v)}
    assert dict(zip(zip(i.tolist(), j.tolist()), ov.tolist())) == expect and len(expect) > 100


@pytest.mark.parametrize("seed", range(4))
def test_similar_in_cells(seed, monkeypatch):
    monkeypatch.setattr(setjoin, "PAIRS", [1 << 18, 50][seed % 2])
    r = np.random.default_rng(seed)
    sets, cell = [], []
    for c in range(60):
        base = r.choice(500, 30, replace=False)
        for _ in range(int(r.choice([1, 2, 3, 12, 13, 20]))):
            sets.append(np.unique(np.concatenate([r.choice(base, 26, replace=False), r.choice(500, 3)])))
            cell.append(c)
    size = np.array([len(s) for s in sets])
    i, j, ov = setjoin.similar_in_cells(np.concatenate(sets), size, np.array(cell), 0.7)
    expect = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets)) if cell[a] == cell[b]}
    expect = {k: v for k, v in expect.items() if v >= 0.7 * (size[k[0]] + size[k[1]] - v) - 1e-9}
    assert len(i) == len(expect) and dict(zip(zip(i.tolist(), j.tolist()), ov.tolist())) == expect and len(expect) > 50
    assert len(setjoin.similar_in_cells(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0.7)[0]) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (100, 102)]
    for small in (common.SMALL, 3):
        got = {r.v: r.comp for r in common.components(spark.createDataFrame(edges, "v long, u long").repartition(5), small).collect()}
        assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([], "v long, u long")).count() == 0


def brute_leaks(rows, items, n=5, share=0.5):
    out = {}
    for i, t in items:
        w = WORD.findall(t.lower())
        runs = [tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        for d, x in rows:
            v = WORD.findall(x.lower())
            have = [tuple(v)] if 0 < len(v) < n else [tuple(v[k : k + n]) for k in range(len(v) - n + 1)]
            best = max((len({*have[k : k + len(runs)]} & {*runs}) for k in range(len(have))), default=0)
            if runs and best and best >= share * len({*runs}):
                out[d, i] = max(out.get((d, i), 0), best)
    return out


@pytest.mark.parametrize("most", [decontaminate.MOST_SENT, 10])
def test_decontaminate(spark, most):
    rows = documents(11, 60)
    r = random.Random(2)
    words = [f"v{k}" for k in range(90)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(8, 50)))) for i in range(12)] + [(20, "one two"), (21, ""), (22, "v1 v1 v1 v1 v1 v1 v1 v1")]
    for i, t in items[:12]:
        w = t.split(" ")
        part = w[: max(5, int(len(w) * r.choice([0.3, 0.6, 1.0])))]
        rows.append((200 + i, f"{rows[i][1]} {' '.join(part).upper()}! {rows[i + 1][1]}"))
        rows.append((300 + i, " ".join(x if r.random() > 0.05 else "zz" for x in w)))
    rows.append((400, "v1 v1 v1 v1 v1 v1"))
    bench = spark.createDataFrame([*items, (None, "a b c d e f"), (23, None)], "item_id long, text string")
    docs = frame(spark, [*rows, (None, items[0][1]), (500, None)], True)
    got = {(x.doc_id, x.item_id): x.matched for x in decontaminate.contaminated(docs, bench, most_sent=most).collect()}
    expect = brute_leaks(rows, items)
    assert got == expect and len(expect) > 12
    kept = collections.Counter(x.doc_id for x in decontaminate.drop_contaminated(docs, bench).collect())
    bad = {d for d, _ in expect}
    assert kept == collections.Counter([d for d, _ in rows if d not in bad] + [None, 500])


def test_decontaminate_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b c d e f g")])
    assert decontaminate.contaminated(docs, bench).count() == 0 and decontaminate.drop_contaminated(docs, bench).count() == 1
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
