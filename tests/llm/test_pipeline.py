"""The pipeline's stages in a row against brute force, on a small corpus with planted cases."""

import collections
import random
import re

import corpus_pipeline
from stratagraph.llm import tokenizer

WORD = re.compile(r"\w+")


def corpus():
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprst") for _ in range(r.randrange(3, 8))) for _ in range(900)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    clean = [(i, "\n".join(line(r.randrange(10, 40)) for _ in range(4))) for i in range(150)]
    toxic = [(200 + i, " ".join(x for w in line(50).split() for x in ([w, "idiot"] if r.random() < 0.1 else [w])) + " you stupid moron") for i in range(40)]
    passage = line(60)
    shared = [(300 + i, f"{line(30)}\n{passage}\n{line(25)}") for i in range(6)]
    copies = [(400 + i, clean[i][1]) for i in range(5)]
    near = []
    for i in range(6):
        w = clean[20 + i][1].replace("\n", " ").split(" ")
        w[3], w[40] = "changed", "words"
        near.append((500 + i, " ".join(w)))
    items = [(i, line(30)) for i in range(5)]
    leaks = [(600 + i, f"{line(40)} {t} {line(40)}") for i, t in items]
    return clean, toxic, shared, copies, near, items, leaks


def test_stages(spark, tmp_path):
    clean, toxic, shared, copies, near, items, leaks = corpus()
    rows = [*clean, *toxic, *shared, *copies, *near, *leaks]
    docs = [(d, t, "en", "s", len(t)) for d, t in rows] + [(None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    bad = {d for d, _ in toxic}
    spark.createDataFrame([(d, 1, int(d in bad)) for d, _ in rows if d % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontaminate", "packing"]

    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = stage.columns, []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, stage, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert stage.columns == columns
            kept.append({r.doc_id: r.text for r in stage.collect()})
    # every toxic document goes, no other does
    assert kept[0].keys() == {None, *(d for d, _ in rows)} - bad
    # lines like an earlier one go; what is left of a document stays
    seen, expect = [], {None: None}
    for d, t in sorted((d, t) for d, t in kept[0].items() if d is not None):
        lines = []
        for x in t.split("\n"):
            s = frozenset(WORD.findall(x.lower()))
            if not any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                lines.append(x)
            seen.append(s)
        if lines:
            expect[d] = "\n".join(lines)
    assert kept[1] == expect
    assert not {d for d, _ in copies} & kept[1].keys() and sum(x.count(shared[0][1].split("\n")[1]) for x in kept[1].values() if x) == 1
    # the first of each group of near copies stays
    runs = lambda t: {tuple(w[i : i + 3]) for w in [WORD.findall(t.lower())] for i in range(len(w) - 2)}
    sets = {d: runs(t) for d, t in kept[1].items() if t}
    later = {b for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    assert kept[2].keys() == kept[1].keys() - later and {d for d, _ in near} <= later
    # leaks go
    assert kept[3].keys() == kept[2].keys() - {d for d, _ in leaks}
    # every token is packed once
    t = tokenizer.load()
    total = collections.Counter()
    for r in stage.collect():
        total[r.doc_id] += r.length
        assert r.offset + r.length <= 2048
    assert total == {d: len(t.encode(x)) for d, x in kept[3].items() if x}
    assert collections.Counter(corpus_pipeline.run(spark, str(tmp_path)).collect()).total() == stage.count()
