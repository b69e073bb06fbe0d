"""Fingerprints, HTML differencing, packing, chat formatting and training order."""

import collections
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import chat, fingerprint, html_diff, packing, shards, tokenizer


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_paragraphs long, fingerprint string")


def test_fingerprint_order_and_multiplicity(spark):
    got = {r.doc_id: (r.n_paragraphs, r.fingerprint) for r in fingerprint.fingerprints(docs(spark, [(1, "a\nb\nb"), (2, "b\n a \n\nb"), (3, "a\nb"), (4, ""), (5, None), (6, "ab"), (7, "x" * 100_000)])).collect()}
    assert got[1] == got[2] and got[1][0] == 3 and got[1][1] != got[3][1] != got[6][1]
    assert got[4] == (0, "0" * 512) and got[5] == (None, None) and len(got[7][1]) == 512
    same = [(r.doc_id, r["first"]) for r in fingerprint.same_paragraphs(docs(spark, [(1, "a\nb"), (2, "b\na"), (2, "b\na"), (3, "c"), (4, ""), (5, ""), (None, "c")])).collect()]
    assert same == [(2, 1)]
    assert fingerprint.fingerprints(docs(spark, []).limit(0)).count() == 0


def test_fingerprint_updates(spark):
    one = lambda c: spark.range(1).select(fingerprint.digits(c).alias("x")).first().x
    text = lambda t: fingerprint.text_vector(F.lit(t))
    assert one(fingerprint.add(text("a"), fingerprint.vector(F.lit("b")))) == one(text("b\na"))
    assert one(fingerprint.remove(text("a\nb\nc"), fingerprint.vector(F.lit("b")))) == one(text("c\na"))
    assert one(fingerprint.remove(text("a"), text("a"))) == one(fingerprint.zero())


def lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


def test_shared_lines_is_a_longest_common_subsequence():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice("abcdef") for _ in range(r.randrange(0, 25))] for _ in range(2))
        got = [a[i] for i in sorted(html_diff.shared_lines(a, b))]
        rest = iter(b)
        assert all(x in rest for x in got) and len(got) == lcs(a, b)


def brute_pages(rows):
    parsed = []
    for i, url, page in rows:
        m = __import__("re").match(r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)", url or "")
        parsed.append((i, m[1].lower() if m else "", m[2].rstrip("/") if m else "", html_diff.text_lines(page or "")))
    out = collections.Counter()
    common = lambda x, y: len(__import__("os").path.commonprefix([x, y]))
    for i, host, path, lines in parsed:
        sites = sorted({p for _, h, p, _ in parsed if h == host}) if host else []
        k = sites.index(path) if host else 0
        near = [sites[n] for n in (k - 1, k + 1) if host and 0 <= n < len(sites)]
        partner, gone = None, set()
        if near:
            best = max(near, key=lambda p: common(path, p))
            of = min(((x[0] is not None, x[0] or 0, x) for x in parsed if x[1] == host and x[2] == best), key=lambda x: (x[0], x[1], "\n".join(x[2][3])))[2]
            partner, gone = of[0], html_diff.shared_lines(lines, of[3])
        out[i, partner, len(lines), len(gone), "\n".join(x for n, x in enumerate(lines) if n not in gone)] += 1
    return out


def page(*body):
    return "<html><head><title>t</title></head><body><nav><ul><li>Home</li><li>News &amp; more</li></ul></nav><script>var a='</p>';</script><!-- c -->" + "".join(f"<p>{b}" for b in body) + "<footer>&copy; site</footer></body></html>"


def test_page_differences(spark):
    r = random.Random(5)
    rows = [(i, f"http{'s' * (i % 2)}://h{r.randrange(3)}.org/{r.choice('ab')}/{r.randrange(40)}{r.choice(['', '/', '?q=1', '#top'])}", page(f"text {i}", "same", f"<b>bold</b> {i % 3}")) for i in range(80)]
    rows += [(100, None, page("x")), (101, "nonsense", page("y")), (102, "http://alone.org/", page("z")), (103, "http://h1.org/a/1", None), (104, "http://h1.org/b/2", ""), (None, "http://h2.org/a/1", page("n")), (rows[3]), (105, "http://H1.ORG/long", page(*(f"l{k % 7}" for k in range(3000))))]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "page_id long, url string, html string, host string, range int").repartition(3)
    got = collections.Counter(tuple(x) for x in html_diff.page_differences(df).collect())
    assert got == brute_pages(rows)
    assert html_diff.page_differences(df.limit(0)).count() == 0


def test_text_lines():
    assert html_diff.text_lines(page("a <b>b</b><br>c", "&lt;d&gt;")) == ["Home", "News & more", "a b", "c", "<d>", "© site"]


@pytest.mark.parametrize("seed, most", [(0, 64), (1, 40), (2, 200)])
def test_plan_places_every_item_once(seed, most):
    r = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    n = r.integers(1, most + 1, 5000)
    np.add.at(counts, n[n <= 64], 1)
    rows = packing.plan(counts)
    used, left = collections.defaultdict(list), collections.defaultdict(list)
    for length, first, items, begin, offset in rows.tolist():
        for k in range(items):
            used[begin + k].append((offset, length))
            left[length].append(first + k)
    assert all(sorted(left[x]) == list(range(counts[x])) for x in range(1, 65))
    for items in used.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 64
    assert len(used) <= -(-int((counts * np.arange(65)).sum()) // 64) * 1.1 + 1


def test_plan_takes_exact_complements():
    counts = np.zeros(101, np.int64)
    for x in (70, 30, 60, 25, 15, 50, 20, 18, 12, 100):
        counts[x] += 1
    rows = packing.plan(counts)
    fill = collections.Counter()
    for length, _, items, begin, _ in rows.tolist():
        for k in range(items):
            fill[begin + k] += length
    assert sorted(fill.values()) == [100] * 4


def test_pack(spark):
    r = random.Random(6)
    rows = [(i, r.choice([1, 5, 100, 300, 511, 512, 513, 2000, None, 0])) for i in range(400)] + [(3, 77), (3, 77), (None, 9)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 512).collect()
    total = collections.Counter()
    bins = collections.defaultdict(list)
    for x in got:
        total[x.doc_id] += x.length
        bins[x.bin].append((x.offset, x.length))
    expect = collections.Counter()
    for d, n in rows:
        if d is not None and n:
            expect[d] += n
    assert total == expect and sorted(bins) == list(range(len(bins)))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 512
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_token_counts(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (None, "x"), (4, "é " * 5000)]
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(docs(spark, rows)).collect()}
    assert got == {1: 2, 2: 0, 4: len(tokenizer.load().encode("é " * 5000))}


def brute_chat(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "unknown", text or ""))
    out = {}
    for c, turns in by.items():
        merged = []
        for _, _, role, text in sorted(turns):
            if merged and merged[-1][0] == role:
                merged[-1][1].append(text)
            else:
                merged.append((role, [text]))
        out[c] = (len(turns), len(merged), "".join(f"<|im_start|>{r}\n" + "\n".join(t) + "<|im_end|>\n" for r, t in merged))
    return out


def test_chat(spark):
    r = random.Random(8)
    rows = [(r.randrange(9), r.randrange(6), r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "long " * 500])) for _ in range(200)]
    rows += [(None, 1, "user", "x"), (50, None, "system", "s"), (50, 0, "user", "u"), (50, 0, "user", "u"), (51, 0, None, None)] + [(60, k, "user", f"t{k}") for k in range(3000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, turns long")
    got = {x.conv_id: (x.n_turns, x.n_messages, x.chat) for x in chat.format_chats(df).collect()}
    assert got == brute_chat(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65536, 70001])
def test_feistel_is_a_permutation(n):
    a, b = (shards.feistel(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a.tolist()) == list(range(n)) and (n < 16 or a.tolist() != b.tolist())


def brute_shards(spark, rows, length, shard, key):
    """The shards' bytes and every piece's (slot, byte_offset, doc_id, piece, n_tokens), from the texts in the order of the stream."""
    t = tokenizer.load()
    keys = docs(spark, rows).filter("text IS NOT NULL").select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), F.xxhash64("text", F.lit(1)).alias("k")).collect()
    ids, pieces = [], []
    for x in sorted(keys, key=lambda x: (x.h, x.k)):
        own, begin, piece = [*t.encode(x.text), t.end], len(ids), 0
        ids += own
        while begin < len(ids):
            end = min(len(ids), (begin // length + 1) * length)
            pieces.append((begin // length, begin % length, x.doc_id, piece, end - begin))
            begin, piece = end, piece + 1
    n = -(-len(ids) // length)
    slot = shards.feistel(np.arange(n), n, key)
    whole = np.full((n, length), t.end, t.dtype)
    whole.reshape(-1)[: len(ids)] = ids
    ordered = np.empty_like(whole)
    ordered[slot] = whole
    size = t.dtype.itemsize
    return [ordered[k : k + shard].tobytes() for k in range(0, n, shard)], collections.Counter((int(slot[q]), (int(slot[q]) % shard * length + at) * size, d, p, c) for q, at, d, p, c in pieces)


def test_training_order(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "ß", "42"]) for _ in range(r.randrange(0, 60)))) for i in range(150)] + [(7, "again"), (None, "no id"), (8, None), (9, ""), (9, ""), (10, "long " * 900)]
    expect, pieces = brute_shards(spark, rows, 16, 10, 3)
    for parts in (5, 1):  # the layout of the input changes nothing
        ordered = shards.training_order(docs(spark, rows).repartition(parts), length=16, shard=10, key=3).cache()
        got = ordered.collect()
        assert collections.Counter((x.slot, x.byte_offset, x.doc_id, x.piece, x.n_tokens) for x in got) == pieces and all(x.shard == x.slot // 10 for x in got)
        placed = ordered.select(F.spark_partition_id().alias("p"), "shard").distinct().groupBy("shard").count().collect()
        assert all(x["count"] == 1 for x in placed)
        made = shards.write_shards(ordered, str(tmp_path / f"s{parts}"), length=16).collect()
        assert sum(m.sequences for m in made) == len({x.slot for x in got}) and [open(f"{tmp_path}/s{parts}/shard-{k:08d}.bin", "rb").read() for k in range(len(made))] == expect
        again = shards.write_shards(ordered, str(tmp_path / f"s{parts}"), length=16).collect()
        assert sorted(made) == sorted(again)
    assert shards.read_shard(f"{tmp_path}/s1/shard-00000000.bin", 3, length=16).tobytes() == expect[0][3 * 32 :]
    assert shards.training_order(docs(spark, []).limit(0)).count() == 0


def brute_plan(counts):
    """Bins by the stated rules, one item at a time."""
    top, left, bins = len(counts) - 1, list(counts), []

    def has(items):
        return all(left[x] >= n for x, n in collections.Counter(items).items())

    def pair(gap):
        return ((x, gap - x) for x in range(gap - 1, 0, -1) if x >= gap - x)

    def fill(length):
        gap = top - length
        if not gap:
            return (length,)
        tries = [(length, gap), *((length, *p) for p in pair(gap)), *((length, x, *p) for x in range(gap - 1, 0, -1) for p in pair(gap - x))]
        return next((x for x in tries if has(x)), None)

    def take(items):
        for x in items:
            left[x] -= 1
        bins.append(tuple(sorted(items)))

    for length in range(top, 0, -1):
        while left[length] and (items := fill(length)):
            take(items)
    while any(left):
        items = [max(x for x in range(top + 1) if left[x])]
        while fit := [x for x in range(1, top - sum(items) + 1) if left[x] > items.count(x)]:
            items.append(max(fit))
        take(items)
    return collections.Counter(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_against_brute_force(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(25 + seed, np.int64)
    n = r.integers(1, len(counts), int(r.integers(1, 90)))
    np.add.at(counts, n if seed % 3 else np.minimum(n * 3, len(counts) - 1), 1)
    got = collections.defaultdict(list)
    for length, _, items, begin, _ in packing.plan(counts).tolist():
        for k in range(items):
            got[begin + k].append(length)
    assert collections.Counter(tuple(sorted(x)) for x in got.values()) == brute_plan(counts.tolist())


def test_many_equal_lines():
    r = random.Random(2)
    a, b = ([r.choice("xyz") for _ in range(700)] for _ in range(2))
    got = [a[i] for i in sorted(html_diff.shared_lines(a, b))]
    rest = iter(b)
    assert all(x in rest for x in got) and len(got) == lcs(a, b)
    a, b = ([r.choice("xyz") for _ in range(20_000)] for _ in range(2))
    begin = time.time()
    html_diff.shared_lines(a, b)
    assert time.time() - begin < 20


def test_ids_of_any_type(spark):
    rows = [(f"p{i}", f"http://h.org/{i}", page(f"t {i}")) for i in range(6)] + [(None, "http://h.org/9", page("n"))]
    got = {(r.page_id, r.partner_id) for r in html_diff.page_differences(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {("p0", "p1"), ("p1", "p0"), ("p2", "p1"), ("p3", "p2"), ("p4", "p3"), ("p5", "p4"), (None, "p5")}
    texts = spark.createDataFrame([("a", "x y"), ("b", "z " * 5000), (None, "n"), ("c", "")], "doc_id string, text string")
    assert {r.doc_id for r in packing.pack_documents(texts).collect()} == {"a", "b"}
    assert {r.doc_id for r in shards.training_order(texts).collect()} == {"a", "b", None, "c"}
    assert fingerprint.fingerprints(texts).count() == 4
