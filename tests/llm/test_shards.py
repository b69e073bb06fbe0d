"""The registered query of the training order writes its shards."""

import collections
import hashlib
import os
import random

import numpy as np

import __spark_entry__ as entry
from stratagraph.llm import shards, tokenizer


def test_op9_writes_whole_shards(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "ß", "42"]) for _ in range(r.randrange(0, 30)))) for i in range(1200)] + [(7, "again"), (None, "no id"), (8, None), (9, ""), (10, "long " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["op9_training_order"](spark, str(tmp_path))
    got = out.collect()
    t, size = tokenizer.load(), shards.LENGTH * 2
    files = {x.shard: (x.path, x.sha256) for x in got}
    assert len(files) == 1 and {(x.shard, x.path, x.sha256) for x in got} == {(k, *v) for k, v in files.items()}
    slots = {x.slot for x in got}
    assert slots == set(range(len(slots)))
    assert os.listdir(os.path.dirname(files[0][0])) == ["shard-00000000.bin"]
    data = open(files[0][0], "rb").read()
    assert len(data) == len(slots) * size and hashlib.sha256(data).hexdigest() == files[0][1]
    ids, found = np.frombuffer(data, t.dtype), collections.defaultdict(dict)
    texts = collections.Counter((i, (*t.encode(text), t.end)) for i, text in rows if text is not None)
    for x in got:
        found[x.doc_id].setdefault(x.piece, []).append(ids[x.byte_offset // 2 : x.byte_offset // 2 + x.n_tokens].tolist())
    for i in {i for i, _ in rows}:
        own = [k for (d, k), n in texts.items() if d == i for _ in range(n)]
        if len(own) == 1:
            assert tuple(y for p in sorted(found[i]) for y in found[i][p][0]) == own[0]
        else:
            assert sum(len(y) for p in found.get(i, {}).values() for y in p) == sum(map(len, own))
    before = {p: os.stat(p).st_mtime_ns for p, _ in files.values()}
    assert out.count() == len(got) and {p: os.stat(p).st_mtime_ns for p in before} == before


def test_no_rows_no_shards(spark):
    assert shards.training_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
