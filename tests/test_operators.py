"""Hand-checked values of the operators."""

import datetime
import math
import os

import pytest
from pyspark.sql import functions as F

from stratagraph import storage
from stratagraph.functions import paths, scores, text
from stratagraph.operators import boosts, extract, graph, history, metrics, policy, prompts, render, resolve, runs, search
from stratagraph.params import Coordinates, Policy, RankingConfig, ScanConfig, to_config
from stratagraph.sources import catalog, files, gitlog
from stratagraph.streaming import history as streams


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first().x


def ranks(spark, edges, nodes=None, **how):
    e = spark.createDataFrame(edges, "src string, dst string, w long")
    names = nodes or sorted({x for a, b, _ in edges for x in (a, b)})
    n = spark.createDataFrame([(x, 1.0) for x in names], "node string, p double")
    return {r.node: r["rank"] for r in graph.pagerank(n, e, **how).collect()}


def test_pagerank_star_and_chain(spark):
    r = ranks(spark, [("b", "a", 1), ("c", "a", 1)])
    assert r["a"] == pytest.approx(0.574468, abs=1e-6) and r["b"] == pytest.approx(0.212766, abs=1e-6)
    r = ranks(spark, [("a", "b", 1), ("b", "c", 1)])
    assert r["c"] > r["b"] > r["a"] and sum(r.values()) == pytest.approx(1)


def test_pagerank_matches_plain_loop(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "a", 1)]
    names, p = "abcde", dict.fromkeys("abcde", 0.2)
    out = {n: sum(w for s, _, w in edges if s == n) for n in names}
    rank = dict(p)
    for _ in range(12):
        loose = sum(rank[n] for n in names if not out[n])
        rank = {n: 0.15 * p[n] + 0.85 * (sum(rank[s] * w / out[s] for s, d, w in edges if d == n) + loose * p[n]) for n in names}
    for small in (graph.SMALL, 0):  # in one task, and by joins; what comes from no node doesn't count
        got = ranks(spark, [*edges, ("x", "a", 5)], list(names), iterations=12, tolerance=0.0, small=small)
        assert got.keys() == rank.keys() and all(got[n] == pytest.approx(rank[n], abs=1e-9) for n in names)


def test_pagerank_convergence(spark):
    """Both ways stop at the same step, once nothing moves by the tolerance."""
    edges = [(chr(97 + i), chr(97 + (i * i + 1) % 12), 1 + i % 3) for i in range(12)]
    one, joined = (ranks(spark, edges, tolerance=1e-3, small=small) for small in (graph.SMALL, 0))
    exact = ranks(spark, edges, tolerance=0.0, iterations=200)
    assert all(one[n] == pytest.approx(joined[n], abs=1e-12) and one[n] == pytest.approx(exact[n], abs=5e-3) for n in exact)
    early, five = ranks(spark, [("a", "b", 1), ("b", "a", 1), ("c", "a", 1)], tolerance=1.0), ranks(spark, [("a", "b", 1), ("b", "a", 1), ("c", "a", 1)], tolerance=0.0, iterations=5)
    assert early == five
    assert sum(one.values()) == pytest.approx(1)


def test_function_ranks_weigh_depth_and_tell_lines_apart(spark):
    t = spark.createDataFrame([tag("a.py", "f", 1, "def"), tag("a.py", "f", 9, "def"), tag("a/b/c/d/e/g.py", "g", 1, "def"), tag("vendor/h.py", "h", 1, "def")], TAGS)
    calls = spark.createDataFrame([], "src_file string, src_name string, src_line int, src_parent string, dst_file string, dst_name string, dst_line int, dst_parent string, confidence double")
    got = {r.node: r["rank"] for r in policy.function_ranks(t, calls).collect()}
    assert set(got) == {"a.py::f::1::", "a.py::f::9::", "a/b/c/d/e/g.py::g::1::", "vendor/h.py::h::1::"}
    assert got["a.py::f::1::"] == pytest.approx(1 / 2.11) and got["a/b/c/d/e/g.py::g::1::"] == pytest.approx(0.1 / 2.11) and got["vendor/h.py::h::1::"] == pytest.approx(0.01 / 2.11)


def test_pagerank_empty(spark):
    e = spark.createDataFrame([], "src string, dst string, w long")
    assert graph.pagerank(spark.createDataFrame([], "node string, p double"), e).count() == 0


FOO = [("a", "foo", "b", "bar"), ("b", "bar", "c", "baz"), ("c", "baz", "d", "qux")]


@pytest.mark.parametrize("edges, seeds, hops, decay, expect", [
    (FOO[:1], ["foo"], 1, 0.5, {"foo": 1, "bar": 0.5}), (FOO, ["foo"], 2, 0.5, {"foo": 1, "bar": 0.5, "baz": 0.25}), (FOO, ["foo"], 1, 0.75, {"foo": 1, "bar": 0.75}),
    ([("a", "foo", "b", "bar"), ("c", "baz", "b", "bar")], ["bar"], 1, 0.5, {"bar": 1, "foo": 0.5, "baz": 0.5}), ([("a", "foo", "b", "bar"), ("b", "bar", "a", "foo")], ["foo"], 2, 0.5, {"foo": 1, "bar": 0.5}), ([], ["foo"], 2, 0.5, {}),
])
def test_expand(spark, edges, seeds, hops, decay, expect):
    e = spark.createDataFrame(edges, "from_file string, from_sym string, to_file string, to_sym string")
    got = graph.expand(e, spark.createDataFrame([(s,) for s in seeds], "sym string"), hops, decay)
    assert {r.sym: r.weight for r in got.collect()} == expect


TAGS = "file string, name string, line int, kind string, node_type string, parent string, receiver string, seq long"


def tag(file, name, line, kind, node="function", parent=None, receiver=None, seq=0):
    return (file, name, line, kind, "call" if kind == "ref" else node, parent, receiver, seq)


def test_call_graph(spark):
    t = spark.createDataFrame([tag("t.py", "main", 1, "def"), tag("t.py", "helper", 10, "def"), tag("t.py", "helper", 5, "ref"), tag("t.py", "unknown", 7, "ref")], TAGS)
    c = resolve.same_file(resolve.references(t), resolve.definitions(t))
    got = resolve.call_graph(t, c).collect()
    assert [(r.src_name, r.dst_name, r.confidence) for r in got] == [("main", "helper", 0.9)]
    s = resolve.statistics(resolve.references(t), c)
    assert (s.first().calls, s.first().unresolved, s.first().b4) == (2, 1, 1) and resolve.rates(s, resolve.typed_lookups(t, c)).first().resolution_rate == 0.5
    assert resolve.call_graph(t, c, dangling=True).filter("dst_file = '?'").count() == 1
    none = resolve.rates(resolve.statistics(resolve.references(t.limit(0)), c.limit(0)), resolve.typed_lookups(t.limit(0), c.limit(0))).first()
    assert tuple(none) == (1.0, 0.0, 0.0, 0.0, 0.0)
    assert [tuple(r) for r in resolve.functions_named(resolve.call_graph(t, c), name="helper").collect()] == [("t.py", "helper", 10, None)]
    assert resolve.functions_named(resolve.call_graph(t, c), file="t.py").count() == 2


def test_statistics_of_dropped_calls(spark):
    """Calls with best confidences 0.9, 0.5 twice and 0.3, put to a threshold of 0.6."""
    t = spark.createDataFrame([tag("a", f"n{i}", i, "ref", seq=i) for i in range(5)], TAGS)
    rows = [("a", "n0", 0, 0, "same_file", 3, 0.9, "a", "n0", 1), ("a", "n0", 0, 0, "name_match", 0, 0.85, "a", "n0", 1), ("a", "n1", 1, 1, "name_match", 0, 0.5, "b", "n1", 1), ("a", "n1", 1, 1, "name_match", 0, 0.45, "c", "n1", 1),
            ("a", "n2", 2, 2, "name_match", 0, 0.5, "b", "n2", 1), ("a", "n3", 3, 3, "name_match", 0, 0.3, "b", "n3", 1), ("a", "n3", 3, 3, "name_match", 0, 0.1, "c", "n3", 1)]
    c = spark.createDataFrame([(*r, None) for r in rows], "file string, name string, line int, seq long, strategy string, ordinal int, confidence double, t_file string, t_name string, t_line int, t_parent string")
    s = resolve.statistics(resolve.references(t), c, least=0.6).first()
    assert (s.calls, s.unresolved, s.dropped, s.by_same_file, s.b4, s.competition, s.agreement) == (5, 4, 3, 1, 1, 2, 1) and abs(s.near_misses - 0.2) < 1e-9
    s = resolve.statistics(resolve.references(t), c).first()  # by the gate: above 0.3
    assert (s.unresolved, s.dropped) == (2, 1) and abs(s.near_misses - 0.2) < 1e-9
    assert resolve.statistics(resolve.references(t), c, gated=False).first().dropped == 0


def test_cached_type(spark):
    t = spark.createDataFrame([tag("m.py", "save", 3, "def", "method", "User"), tag("v.py", "save", 42, "ref", receiver="user")], TAGS)
    cache = spark.createDataFrame([("v.py", 41, 0, "User")], "c_file string, c_line int, c_col int, type_name string")
    got = resolve.cached_type(resolve.references(t), resolve.definitions(t), cache).first()
    assert (got.confidence, got.type_hint) == (0.95, "user: User")
    assert resolve.cached_type(resolve.references(t), resolve.definitions(t), cache.limit(0)).count() == 0


def test_enclosing_takes_the_first_on_a_line(spark):
    t = spark.createDataFrame([tag("a", "one", 1, "def", seq=0), tag("a", "two", 4, "def", seq=1), tag("a", "also", 4, "def", seq=2), tag("a", "x", 4, "ref", seq=3), tag("a", "y", 3, "ref", seq=4), tag("b", "z", 1, "ref", seq=0)], TAGS)
    assert {r.name: r.caller for r in resolve.enclosing(t).collect()} == {"x": "two", "y": "one", "z": None}


def test_boosts(spark):
    t = spark.createDataFrame([tag("f", "s", 1, "def"), tag("f", "r", 2, "ref")], TAGS)
    fr = lambda r: spark.createDataFrame([("f", r)], "file string, rank double")
    w = lambda v: spark.createDataFrame([("f", v)], "file string, w double")
    focus = spark.createDataFrame([("f", "s", 0.5)], "file string, name string, w double")
    assert [r["rank"] for r in boosts.boosted(t, fr(0.5)).collect()] == [0.5]
    assert boosts.boosted(t, fr(0.01), idents=["s"], chat=["f"]).first()["rank"] == pytest.approx(2.0)
    assert boosts.boosted(t, fr(0.1), idents=["s"], files=["f"], chat=["f"], temporal=["f"], focus=focus, git=w(2.0), callers=w(1.5)).first()["rank"] == pytest.approx(3000)


@pytest.mark.parametrize("name, query, hit", [("authenticate", "auth", True), ("HTTPServer", "http", True), ("getUserName", "getuser", True), ("authorized", "auth", True), ("parser", "parsr", True), ("authenticate", "authentcate", True), ("AUTH_HANDLER", "auth", True), ("parser", "xyzabc", False), ("getUserName", "setpassword", False), ("parser", "compiler", False)])
def test_matches_query(spark, name, query, hit):
    assert one(spark, text.matches_query(F.col("n"), F.col("q")), n=name, q=query) is hit


@pytest.mark.parametrize("name, expect", [("get_user_name", ["get", "user", "name"]), ("getUserName", ["get", "user", "name"]), ("parse_JSONObject", ["parse", "json", "object"]), ("foo__bar--baz", ["foo", "bar", "baz"]), ("", [])])
def test_words(spark, name, expect):
    assert one(spark, text.words(F.col("n")), n=name) == expect


@pytest.mark.parametrize("word, stem", [("authorized", "auth"), ("parsing", "parse"), ("invalid", "valid"), ("unknown_word", None)])
def test_stems(spark, word, stem):
    assert one(spark, text.stem_of(F.col("w")), w=word) == stem


@pytest.mark.parametrize("last, first, n, phase", [(60, 200, 5, "crystal"), (1, 10, 3, "emergent"), (2, 100, 15, "rotting"), (20, 60, 7, "evolving")])
def test_phase(spark, last, first, n, phase):
    assert one(spark, scores.phase(F.col("l"), F.col("f"), F.col("n")), l=last, f=first, n=n) == phase


def test_badges_recency_churn(spark):
    assert one(spark, scores.badges(F.lit(2), F.lit(15), F.lit("rotting"))) == ["recent", "high-churn", "rotting"]
    assert 3 < one(spark, scores.recency(F.lit(30))) < 6
    assert 2.5 < one(spark, scores.churn(F.lit(10))) < 3


@pytest.mark.parametrize("message, files_, quality", [("fix: crash on empty input", ["src/a.rs", "src/b.rs"], 1.8), ("WIP: still working on this", ["src/a.rs", "src/b.rs"], 0.24), ("chore: format code with prettier", ["src/a.rs", "src/b.rs"], 0.0), ("refactor: rename foo to bar everywhere", [f"src/f{i}.rs" for i in range(20)], 0.24)])
def test_commit_quality(spark, message, files_, quality):
    df = spark.createDataFrame([("s", message, files_)], "sha string, message string, files array<string>")
    assert history.commit_quality(df).first().quality == pytest.approx(quality)


@pytest.mark.parametrize("message, intent", [("fix: null pointer in parser", "Debug"), ("refactor: clean up auth module", "Refactor"), ("add: user registration", "Extend"), ("update docs", "Explore")])
def test_intent(spark, message, intent):
    assert one(spark, text.intent(F.col("m")), m=message) == intent


@pytest.mark.parametrize("names, n", [(["src/parser.rs", "tests/test_parser.rs", "src/lexer.rs", "src/lexer_test.rs"], 2), (["mymodule.py", "test_mymodule.py", "utils.py", "utils_test.py"], 2), (["Button.tsx", "Button.spec.tsx", "utils.ts", "utils.test.ts"], 2), (["test_a.py", "test_b.py"], 0)])
def test_couplings(spark, names, n):
    c = history.couplings(spark.createDataFrame([(x,) for x in names], "path string"))
    assert c.count() == n and graph.symbol_edges(c).count() == 2 * n


def test_same_directory_is_sure(spark):
    c = history.couplings(spark.createDataFrame([("src/a.py",), ("src/test_a.py",)], "path string"))
    assert c.first().confidence == 1.0


def _eval(spark, ranking, truth, k=10):
    r = spark.createDataFrame([("c", i + 1, x) for i, x in enumerate(ranking)], "case string, pos int, item string")
    t = spark.createDataFrame([("c", *x) for x in truth.items()], "case string, item string, relevance double")
    return metrics.evaluate(r, t, k).first()


def test_metrics(spark):
    graded = {"a": 1.0, "b": 0.5, "c": 0.25}
    flat = dict.fromkeys("abc", 1.0)
    assert _eval(spark, "abc", graded).ndcg == pytest.approx(1)
    assert 0 < _eval(spark, "cba", graded).ndcg < 1
    assert [_eval(spark, "abxcy", flat, k).p_at_k for k in (2, 3, 5)] == pytest.approx([1, 2 / 3, 0.6])
    assert [_eval(spark, "axb", flat, k).r_at_k for k in (1, 3)] == pytest.approx([1 / 3, 2 / 3])
    assert _eval(spark, "xya", {"a": 1.0}).mrr == pytest.approx(1 / 3)
    assert _eval(spark, "axby", {"a": 1.0, "b": 1.0}).ap == pytest.approx(0.8333, abs=1e-4)
    assert _eval(spark, "", {"a": 1.0}).p_at_k == 0.0


def test_spearman(spark):
    a = spark.createDataFrame([(f"f{i}", 0.1 * i) for i in range(1, 6)], "k string, value double")
    b = spark.createDataFrame([(f"f{i}", 0.2 * i) for i in range(1, 6)], "k string, value double")
    assert metrics.spearman(a, b, ["k"]).first().rho == pytest.approx(1)
    v = spark.createDataFrame([(10,), (30,), (20,), (30,)], "v int")
    v = metrics.average_rank(v, "v", "r")
    assert sorted((r.v, r.r) for r in v.collect()) == [(10, 1.0), (20, 2.0), (30, 3.5), (30, 3.5)]
    assert metrics.spearman(a.limit(1), b, ["k"]).first().rho == 0.0


def test_site_score(spark):
    even = dict(weight_centrality=1.0, weight_uncertainty=1.0, weight_coherence=1.0, weight_causality=1.0, weight_bridge=1.0)
    s = lambda root, p: one(spark, scores.site_score(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.2), F.lit(5.0), F.lit(root), F.lit(2.0), p))
    assert s(True, Policy(**even)) == pytest.approx(math.log(0.5) + 0.8 + math.log(6) + 1 + math.log(3))
    assert s(False, Policy(**even, mixing=1.0)) == pytest.approx(math.log(0.5) + math.log(0.8) + math.log(6) + math.log(3) - 1)


def test_wave(spark):
    c = spark.createDataFrame([(1, 0.8), (2, 0.1)], "site int, score double")
    chosen = policy.select_wave(c, Policy(gate=100.0, exploration_floor=0.01)).filter("chosen").collect()
    assert [r.site for r in chosen] == [1]
    assert scores.should_continue(0.5, 0) and not scores.should_continue(0.001, 0)


def test_gate_and_softmax(spark):
    c = Coordinates()
    p = [one(spark, scores.acceptance(F.lit(x), c)) for x in (0.1, 0.3, 0.5)]
    assert p == sorted(p) and p[1] == pytest.approx(0.5)
    assert one(spark, scores.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))) == pytest.approx([1 / 3] * 3)
    assert Coordinates(bias=2.0).problems() and not Coordinates.final().problems()


def test_search(spark):
    g = search.grid(spark, ["pagerank_alpha", "focus_decay"], 3)
    assert g.count() == 9 and g.agg(F.min("pagerank_alpha")).first()[0] == pytest.approx(0.70)
    lhs = search.latin_hypercube(spark, ["pagerank_alpha"], 20).collect()
    assert sorted(int((r.pagerank_alpha - 0.70) / 0.25 * 20 - 1e-12) for r in lhs) == list(range(20))
    x = one(spark, scores.encode(scores.decode(F.lit(0.3), F.lit(2.0), F.lit(50.0), F.lit(True)), F.lit(2.0), F.lit(50.0), F.lit(True)))
    assert x == pytest.approx(0.3)
    assert to_config({"focus_max_hops": 2.6, "git_churn_threshold": 4.4}).focus_hops == 3
    s = search.importance(spark.createDataFrame([("baseline", 0.9), ("a", 0.5), ("b", 0.95)], "ablated string, score double")).collect()
    assert [(r.ablated, r.place, round(r.importance, 6)) for r in sorted(s, key=lambda r: r.place)] == [("a", 1, 0.4), ("b", 2, 0.0)]


def test_runs(spark):
    s = spark.createDataFrame([("p", i, 0.85) for i in range(5)], "k string, step int, v double")
    r = runs.plateaus(s, "k", "step", "v", 3, 0.01).first()
    assert r.plateau and not r.collapse
    assert not runs.plateaus(s.limit(2), "k", "step", "v").first().plateau
    there = spark.createDataFrame([("p", 0, 0.5), ("p", 1, 0.9), ("p", 2, 0.5), ("q", 0, 0.9), ("q", 1, 0.9), ("q", 2, 0.7)], "k string, step int, v double")
    assert {r.k: (r.plateau, r.collapse) for r in runs.plateaus(there, "k", "step", "v").collect()} == {"p": (True, False), "q": (False, True)}
    assert [(r.state, r.spread) for r in runs.convergence(there.filter("k = 'p'"), "k", "step", "v").orderBy("step").collect()] == [("moving", None), ("moving", None), ("moving", pytest.approx(0.16 / 3))]
    assert runs.convergence(s, "k", "step", "v").orderBy(F.desc("step")).first().state == "converged"
    v = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double").agg(metrics.population_variance(F.col("v")).alias("x")).first().x
    assert v == 2
    d = runs.deltas(spark.createDataFrame([("r", 0, 1.0, 2.0), ("r", 1, 1.5, 2.0)], "run string, step int, a double, b double"), ["run"], "step", ["a", "b"]).collect()
    assert [(x.name, x.delta) for x in d] == [("a", 0.5)]
    assert runs.pick(spark.createDataFrame([("a", 0), ("b", 9)], "k string, n int"), "k", "n", 0.5).first().k == "a"


def test_history(spark):
    day = lambda d: datetime.datetime(2024, 1, d, 12)
    rows = [("c1", "alice", day(15), "lib"), ("c1", "alice", day(15), "main"), ("c2", "bob", day(14), "lib"), ("c3", "alice", day(10), "main")]
    cf = spark.createDataFrame(rows, "sha string, author string, ts timestamp, file string")
    got = {r.file: (r.commit_count, r.authors, r.last_modified_days, r.first_seen_days) for r in history.file_stats(cf, F.lit(day(16))).collect()}
    assert got == {"lib": (2, 2, 1, 2), "main": (2, 1, 1, 6)}
    assert [(r.a, r.b, r.jaccard) for r in history.together(cf).collect()] == [("lib", "main", pytest.approx(1 / 3))]
    assert history.cases(cf).count() == 2
    s = history.sessions(cf.select("author", "ts").distinct(), "author", "ts", 86400 * 2)
    assert {(r.author, r.session) for r in s.collect()} == {("alice", 0), ("alice", 1), ("bob", 0)}


def test_log_text(spark):
    h = lambda s, t: "\x1f".join([s, "A", "a@x", "2024-01-15T10:00:00+00:00", str(t), "fix: x"])
    value = [h("c1", 1705312800), "", "src/a.rs", "src/b.rs", "", h("c2", 1705226400), "src/a.rs", h("c3", 1705000000)]
    got = {r.sha: (r.files, r.message) for r in gitlog.parse_log(spark.createDataFrame(list(enumerate(value)), "n bigint, value string")).collect()}
    assert got == {"c1": (["src/a.rs", "src/b.rs"], "fix: x"), "c2": (["src/a.rs"], "fix: x"), "c3": ([], "fix: x")}


def test_include(spark):
    hit = lambda path, **c: one(spark, paths.included(F.col("p"), ScanConfig(**c)), p=path)
    assert not hit("foo/node_modules/bar.js") and not hit("project/.git/config") and not hit("src/__pycache__/mod.pyc") and hit("src/main.py")
    assert not hit("srcfoo/bar.py", include=("src",)) and hit("src/bar.py", include=("src",))
    assert not hit("src/gui/old/widget.py", exclude=("src/gui/old/",))


SOURCES = [
    ("a.py", "class User:\n    def save(self):\n        helper(1)\n\ndef main():\n    user.save()\n\nLIMIT = 3\n"),
    ("b.rs", "pub struct Point;\nimpl Point {\n    pub fn new() -> Self { make() }\n}\nconst MAX: u32 = 1;\n"),
    ("c.ts", "export interface Shape {}\nexport class Box {}\nexport const area = (x) => x\ntype Id = string\n"),
    ("d.unknown", "class Nothing:"), ("e.md", "# Title\n## Part\n"), ("f.py", None),
]


def test_tags(spark):
    t = extract.tags(spark.createDataFrame(SOURCES, "file string, content string"))
    d = {(r.file, r.name, r.node_type, r.line) for r in t.filter("kind = 'def'").collect()}
    assert d == {("a.py", "User", "class", 1), ("a.py", "save", "method", 2), ("a.py", "main", "function", 5), ("a.py", "LIMIT", "constant", 8), ("b.rs", "Point", "struct", 1), ("b.rs", "Point", "impl", 2), ("b.rs", "new", "function", 3), ("b.rs", "MAX", "constant", 5), ("c.ts", "Shape", "interface", 1), ("c.ts", "Box", "class", 2), ("c.ts", "area", "function", 3), ("c.ts", "Id", "type", 4), ("e.md", "Title", "section", 1), ("e.md", "Part", "subsection", 2)}
    refs = {(r.file, r.name, r.receiver, r.line) for r in t.filter("kind = 'ref'").collect()}
    assert ("a.py", "helper", None, 3) in refs and ("a.py", "save", "user", 6) in refs
    assert t.filter("name = 'save' AND kind = 'def'").first().parent == "User"
    b = {(r.name, r.section) for r in extract.buckets(t.filter("file = 'a.py'")).collect()}
    assert b == {("User", "class"), ("save", "method"), ("main", "function"), ("LIMIT", "constant")}


def test_cache(spark):
    f = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 3, 0)], "file string, mtime_s long, mtime_ns int")
    c = spark.createDataFrame([("a", 1, 5, 10), ("b", 2, 6, 20)], "file string, mtime_s long, mtime_ns int, bytes int")
    assert [r.file for r in extract.cache_hits(f, c).collect()] == ["a"]
    assert sorted(r.file for r in extract.cache_misses(f, c).collect()) == ["b", "c"]
    up = extract.cache_upsert(c, c.filter("file = 'b'").withColumn("bytes", F.lit(99)))
    assert {r.file: r.bytes for r in up.collect()} == {"a": 10, "b": 99} and extract.cache_clear(c).count() == 0
    assert extract.cache_stats(c).first().human == "30 B"


def test_render(spark):
    sig = F.struct(F.array(F.struct(F.lit("x").alias("name"), F.lit("Dict[str, int]").alias("type")), F.struct(F.lit("y").alias("name"), F.lit(None).cast("string").alias("type"))).alias("parameters"), F.lit("std::io::File").alias("return_type"))
    r = spark.range(1).select(*(text.render_signature(sig, d).alias(d) for d in ("low", "medium", "high"))).first()
    assert tuple(r) == ("(x, y)", "(x: Dict, y) -> File", "(x: Dict[str, int], y) -> std::io::File")
    assert one(spark, text.wrap(F.array(*(F.lit("abcdefgh") for _ in range(4))), 20)) == ["abcdefgh, abcdefgh", "abcdefgh, abcdefgh"]
    assert one(spark, text.clean_hover(F.lit("```python\nint\n```"))) == "int"
    j = render.joined_files(spark.createDataFrame([("b", "2"), ("a", "1"), ("n", None)], "path string, content string"), "--").first()
    assert j.text == "--\na\n--\n1\n--\nb\n--\n2" and not j.large
    s = render.sparkline(spark.createDataFrame([("k", i, float(i)) for i in range(8)], "k string, i int, v double"), "k", "i", "v").first()
    assert s.spark == text.SPARKS + " " * 12


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    for name, content in {"src/a.py": b"x = 1", "src/b.png": b"\x89PNG", "src/bad.py": b"\xff\xfe\xff", "node_modules/x/c.js": b"1", "skip.log": b"log", ".gitignore": b"*.log\n"}.items():
        (tmp_path / name).write_bytes(content)
    got = [r.path for r in files.source_files(spark, str(tmp_path)).collect()]
    assert got == [".gitignore", "src/a.py"]
    assert [r.path for r in files.source_files(spark, str(tmp_path / "src" / "a.py")).collect()] == ["a.py"]
    with pytest.raises(FileNotFoundError):
        files.source_files(spark, str(tmp_path / "none"))
    (tmp_path / "tsconfig.json").write_text('{ // c\n "include": ["src"], "exclude": ["dist",] }')
    assert files.load_config(str(tmp_path)) == ScanConfig(("src",), (), ("dist",))
    (tmp_path / "stratagraph.toml").write_text('include = ["lib/**"]')
    assert files.load_config(str(tmp_path)).include == ("lib/**",)
    assert files.gitignore_globs("/a\nb/\nc\n!d\n# e") == ["a", "a/**", "**/b/**", "**/c", "**/c/**"]
    (tmp_path / "types.json").write_text('{"a:b.py:4:0": {"type_str": "User", "confidence": 0.9}}')
    assert files.type_cache(spark, str(tmp_path / "types.json")).first().c_file == "a:b.py"
    (tmp_path / "d.json").write_text('{"s.py": ["x", "y"]}')
    assert files.distractors(spark, str(tmp_path / "d.json")).count() == 2
    assert catalog.repositories(spark, language="rust", most=2).count() == 2
    good = catalog.repositories(spark, least_quality=0.85, most_size="medium").collect()
    assert good and all(r.quality >= 0.85 and r["size"] in ("small", "medium") for r in good)
    assert {r["size"] for r in catalog.repositories(spark, most_size="large").collect()} == {"small", "medium", "large"} and catalog.quick(spark).count() == 5


def test_streams(spark, tmp_path):
    rows = [("a", datetime.datetime(2024, 1, 1, h)) for h in (0, 1, 10)] + [("a", datetime.datetime(2024, 1, 3))]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.closed_sessions(s, "k", "ts", "2 hours").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("closed").collect()) == [1, 2]


def test_prompt_files(tmp_path):
    prompts.save_prompt(str(tmp_path), "p1", 2, {"Role": "You rank.\nWell.", "Task": "Go"}, "p0", ("Role",))
    got = prompts.load_prompts(str(tmp_path))["p1"]
    assert got == {"id": "p1", "version": 2, "parent": "p0", "immutable": ["Role"], "sections": {"Role": "You rank.\nWell.", "Task": "Go"}}


def test_focus(spark):
    t = spark.createDataFrame([(f, n) for f, n in [("src/lib.rs", "parse_config"), ("src/auth.rs", "authenticate"), ("tests/auth.rs", "check"), ("src/main.rs", "main")]], "file string, name string")
    ask = lambda *x: spark.createDataFrame([(y,) for y in x], "target string")
    got = lambda *x: tuple(sorted(r[0] for r in d.collect()) for d in graph.focus(ask(*x), t))
    assert got("lib.rs, auth") == (["src/lib.rs"], ["authenticate"])
    assert got("auth.rs") == (["src/auth.rs"], []) and got("", " , ") == ([], []) and got("parser") == ([], ["parse_config"]) and got("no/such.rs") == ([], [])


def test_languages_of_suffixes(spark):
    known = {"a.pyw": "python", "a.hxx": "cpp", "a.hh": "cpp", "Rakefile.rake": "ruby", "x.gemspec": "ruby", "i.php4": "php", "i.phtml": "php", "b.kts": "kotlin", "w.sc": "scala", "r.markdown": "markdown", "p.cs": "c_sharp", "n.txt": None, "none": None}
    got = {r.f: r.l for r in spark.createDataFrame([(k,) for k in known], "f string").select("f", paths.language(F.col("f")).alias("l")).collect()}
    assert got == known


def test_sparkline_width_and_floor(spark):
    line = lambda v, w: render.sparkline(spark.createDataFrame([("k", i, x) for i, x in enumerate(v)], "k string, i int, v double"), "k", "i", "v", w).first().spark
    assert line([0.0, 1.0], 4) == "▁█  " and line([0.5, 0.5001], 2) == "▁▂" and line([float(i) for i in range(8)], 4) == "▁▃▅▇"


def test_evaluate_uses_every_case_weight(spark):
    points = search.ablations(spark).filter("ablated IN ('baseline', 'focus_decay')")
    items = spark.createDataFrame([(1, "a.rs", 1, 0.9), (1, "b.rs", 2, 0.0), (2, "c/d/e/f/g/h.rs", 3, 0.2), (2, "k.rs", 4, 0.0)], "case int, item string, key int, coupling double")
    each = {c: {r.ablated: r.ndcg for r in search.evaluate(points, items.filter(F.col("case") == c), None, "ablated").collect()} for c in (1, 2)}
    both = search.evaluate(points, items, spark.createDataFrame([(1, 3.0), (2, 1.0)], "case int, weight double"), "ablated").collect()
    assert all(r.ndcg == pytest.approx((3 * each[1][r.ablated] + each[2][r.ablated]) / 4) for r in both) and len(both) == 2


def test_nested_ignores_and_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    tree = {"r/.gitignore": "*.log\n", "r/a.py": "1", "r/a.log": "1", "r/sub/.gitignore": "gen.py\n/only.py\n", "r/sub/gen.py": "1", "r/sub/deep/gen.py": "1", "r/gen.py": "1", "r/sub/only.py": "1", "r/sub/deep/only.py": "1",
            "r/.git/info/exclude": "secret.py\n", "r/x/secret.py": "1", "home/git/ignore": "*.swp\n", "r/b.swp": "1", "r/p.png": "1"}
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    got = [r.path for r in files.source_files(spark, str(tmp_path / "r")).collect()]
    assert got == [".gitignore", "a.py", "gen.py", "sub/.gitignore", "sub/deep/only.py"]
    assert [r.path for r in files.source_files(spark, str(tmp_path / "r"), include_all=True).collect()] == sorted([*got, "p.png"])
    (tmp_path / "r" / "big.py").touch()
    os.truncate(tmp_path / "r" / "big.py", files.MOST_BYTES + 1)
    with pytest.raises(Exception, match="exclude it"):
        files.source_files(spark, str(tmp_path / "r")).collect()
    assert [r.path for r in files.source_files(spark, str(tmp_path / "r"), ScanConfig(extend_exclude=("big.py",))).collect()] == got


def test_running_sums_over_ranges(spark):
    rows = [(i * 37 % 101, float(i % 5)) for i in range(101)]
    got = {r.k: r.before for r in storage.running(spark.createDataFrame(rows, "k int, v double").repartition(7), ["k"], "v").collect()}
    expect, total = {}, 0.0
    for k, v in sorted(rows):
        expect[k] = total
        total += v
    assert got == expect
    got = [(r.k, r.place) for r in storage.running(spark.createDataFrame(rows, "k int, v double"), [F.desc("k")], name="place").collect()]
    assert sorted(got) == [(k, 100 - k) for k in range(101)] and storage.running(spark.createDataFrame([], "k int"), ["k"]).count() == 0
    less = {r.x: (r.less, r.same) for r in metrics.less(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double"), "x").collect()}
    assert less == {None: (0, 1), 1.0: (1, 1), 2.0: (2, 2)}


def _many_tags(spark, n=400):
    """References and definitions of few names in few directories, so that strategies and keys meet often."""
    u = lambda i, s: (i * 7919 + s * 104729) % 10007
    rows = []
    for i in range(n):
        file, kind = f"d{u(i, 1) % 3}/s{u(i, 2) % 2}/f{u(i, 3) % 9}.py", "def" if u(i, 4) % 2 else "ref"
        parent, receiver = (None, "xyz"[u(i, 5) % 3] + "12"[u(i, 6) % 2]) if kind == "ref" else ("xyz"[u(i, 7) % 3] if u(i, 8) % 2 else None, None)
        rows.append(tag(file, "abcd"[u(i, 9) % 4], i % 60 + 1, kind, "method" if parent else "function", parent, receiver, i))
    t = storage.materialise(spark.createDataFrame(rows, TAGS), "many")
    types = spark.createDataFrame([(a + b, t) for a in "xyz" for b in "12" for t in (a, "y")], "t_of string, type_name string").distinct()
    imports = spark.createDataFrame([("a", "d1", "a"), ("a", "d1.s0", "a"), ("b", "d2", "c"), ("c", "d0.s1", "a"), ("c", "d0", "c")], "alias string, module string, original string")
    cache = t.filter("kind = 'ref'").select(F.col("file").alias("c_file"), (F.col("line") - 1).alias("c_line"), F.lit(0).alias("c_col"), F.substring("receiver", 1, 1).alias("type_name")).distinct()
    return t, types, imports, cache


@pytest.mark.parametrize("c", [Coordinates(), Coordinates.shadow(), Coordinates.final(), Coordinates(name_match=0.0, imports=2.0), Coordinates(name_match=1.9, same_file=0.1)])
def test_leading_candidates_keep_the_best(spark, c):
    t, types, imports, _ = _many_tags(spark)
    refs, defs = resolve.references(t), resolve.definitions(t)
    best = lambda x: sorted(map(repr, resolve.ranked(x, c).filter("rn = 1").select("file", "name", "line", "seq", "strategy", "weighted", "t_file", "t_name", "t_line", "type_hint").collect()))
    every, few = resolve.heuristics(refs, defs, types, imports), resolve.leading(refs, defs, types, imports)
    assert best(few) == best(every)
    assert few.groupBy("file", "name", "line", "seq").count().agg(F.max("count")).first()[0] <= 6 < every.groupBy("file", "name", "line", "seq").count().agg(F.max("count")).first()[0]


def test_statistics_of_leading_candidates(spark):
    t, types, imports, cache = _many_tags(spark)
    refs, defs = resolve.references(t), resolve.definitions(t)
    every, few = resolve.heuristics(refs, defs, types, imports), resolve.leading(refs, defs, types, imports, 2)
    for how in ({}, {"least": 0.65}, {"gated": False}):
        assert resolve.statistics(refs, few, **how).first() == resolve.statistics(refs, every, **how).first()
    every = every.unionByName(resolve.cached_type(refs, defs, cache))
    agreed = resolve.oracle_agreement(every).first()
    assert agreed.agreements and agreed.conflicts and resolve.counted_agreement(refs, defs, types, imports, cache).first() == agreed
    assert resolve.counted_lookups(t, types, imports, cache).first() == resolve.typed_lookups(t, every).first()
    none = resolve.counted_lookups(t.limit(0), types, imports, cache).first()
    assert tuple(none) == tuple(resolve.typed_lookups(t.limit(0), every.limit(0)).first()) == (0, 0, 0, 0)


def test_shared_names_are_the_listed_edges(spark):
    """Degrees and ranks by name, in one task and by joins, are those of the edges; some files lack definitions or only name their own."""
    u = lambda i, s: (i * 7919 + s * 104729) % 10007
    defs = spark.createDataFrame([(f"f{u(i, 1) % 12}", "abcdef"[u(i, 2) % 6]) for i in range(30)] + [("only", "own"), ("none", "unused")], "file string, name string")
    refs = spark.createDataFrame([(f"f{u(i, 3) % 15}", "abcdeg"[u(i, 4) % 6]) for i in range(60)] + [("only", "own")], "file string, name string")
    edges = graph.file_edges(defs, refs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.shared_degrees(defs, refs)) == rows(graph.degrees(edges))
    nodes = defs.select("file").union(refs.select("file")).distinct().select(F.col("file").alias("node"), (F.length("file") * 1.5).alias("p"))
    expect = dict(rows(graph.pagerank(nodes, edges, iterations=12, tolerance=0.0)))
    for small in (graph.SMALL, 0):
        got = dict(rows(graph.shared_pagerank(nodes, defs, refs, iterations=12, tolerance=0.0, small=small)))
        assert got.keys() == expect.keys() and all(got[k] == pytest.approx(expect[k], abs=1e-12) for k in expect)
    empty = nodes.limit(0)
    assert graph.shared_pagerank(empty, defs, refs).count() == 0 and graph.shared_degrees(defs.limit(0), refs).count() == 0


def test_sessions_and_days_count_parts_of_a_second(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("k", at(x)) for x in (0.2, 1800.2, 3600.4, 5400.39)]
    s = history.sessions(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 1800)
    assert [r.session for r in s.orderBy("ts").collect()] == [0, 0, 1, 1]
    cf = spark.createDataFrame([("c", "a", at(0.7), "f"), ("c", "a", at(0.3), "g")], "sha string, author string, ts timestamp, file string")
    assert {r.file: r.last_modified_days for r in history.file_stats(cf, F.lit(at(86400.5))).collect()} == {"f": 0, "g": 1}


def test_plateau_at_the_threshold(spark):
    """A fall of 0.3 as it is in binary: 0.01 / 25 lies below 7.51 / 25 - 0.3, but 0.01 / 25 - 7.51 / 25 not below -0.3."""
    s = spark.createDataFrame([("k", 0, 7.51 / 25), ("k", 1, 1.0), ("k", 2, 0.01 / 25)], "k string, step int, v double")
    r = runs.plateaus(s, "k", "step", "v", 3, 0.3).first()
    assert (r.plateau, r.collapse) == (abs(0.01 / 25 - 7.51 / 25) < 0.3, 0.01 / 25 < 7.51 / 25 - 0.3) == (False, True)


def test_sparkline_at_half_a_level(spark):
    """The place in the range comes first, then its seven levels; the other way round some halves fall to the other side."""
    half = [(v, hi) for hi in range(2, 400, 2) for v in range(1, hi) if math.floor((v / 25) / (hi / 25) * 7 + 0.5) != math.floor(7 * (v / 25) / (hi / 25) + 0.5)][:5]
    assert half
    for v, hi in half:
        s = render.sparkline(spark.createDataFrame([("k", 0, 0.0), ("k", 1, v / 25), ("k", 2, hi / 25)], "k string, i int, v double"), "k", "i", "v").first()
        assert s.spark[1] == text.SPARKS[math.floor((v / 25) / (hi / 25) * 7 + 0.5)]


@pytest.mark.parametrize("seeds, hops", [("a", 1), ("ab", 2), ("bd", 3), ("e", 2), ("f", 2)])
def test_expand_by_shared_names(spark, seeds, hops):
    u = lambda i, s: (i * 7919 + s * 104729) % 10007
    rows = [tag(f"f{u(i, 1) % 9}", "abcd"[u(i, 2) % 4], i, "def" if u(i, 3) % 5 < 2 else "ref") for i in range(14)] + [tag("g", "e", 1, "def"), tag("g", "e", 2, "ref"), tag("h", "f", 1, "ref"), tag("h", "a", 2, "def")]
    t = spark.createDataFrame(rows, TAGS)
    beside = spark.createDataFrame([("h", "f", "h", "a"), ("f1", "a", "f2", "b")], "from_file string, from_sym string, to_file string, to_sym string")
    listed = [(r[0], r[1], d[0], d[1]) for r in rows for d in rows if r[3] == "ref" and d[3] == "def" and r[1] == d[1] and r[0] != d[0]]
    s = spark.createDataFrame([(x,) for x in seeds], "sym string")
    found = lambda df: sorted(map(tuple, df.collect()))
    assert found(graph.expand_shared(beside, t, s, hops)) == found(graph.expand(beside.union(spark.createDataFrame(listed, beside.schema)), s, hops))


def test_pairs_by_cells_are_the_join(spark, monkeypatch):
    """Blocks of three rows and tasks of twenty pairs give the pairs of a join, duplicates and null keys too."""
    monkeypatch.setattr(resolve, "CELL", 3)
    monkeypatch.setattr(resolve, "MOST_PAIRS", 20)
    a = spark.createDataFrame([("pop", i % 9, "t") for i in range(20)] + [("rare", 1, "t"), ("none", 1, "t"), (None, 2, "t"), ("pop", 3, None)], "name string, i int, t string")
    b = spark.createDataFrame([("pop", i % 7, "t") for i in range(15)] + [("rare", 2, "t"), ("other", 1, "t"), (None, 3, "t"), ("pop", 4, None)], "t_name string, j int, u string")
    for keys in ({"name": "t_name"}, {"name": "t_name", "t": "u"}):
        on = None
        for x, y in keys.items():
            on = (F.col(x) == F.col(y)) if on is None else on & (F.col(x) == F.col(y))
        cells = resolve._paired(a, b, keys)
        assert sorted(map(repr, cells.collect())) == sorted(map(repr, a.join(b, on).collect()))
        most = max(len(x) for x in cells.rdd.glom().collect())
        assert cells.rdd.getNumPartitions() >= 15 and most < 150
    assert resolve._paired(a.limit(0), b, {"name": "t_name"}).count() == 0


def test_items_are_moved_once_for_all_points(spark):
    """Points multiply the rows after the last exchange of items, not before it."""
    items = spark.createDataFrame([(c, f"{c}/{i}.rs", c * 100 + i, (i % 3) / 2.0) for c in range(20) for i in range(12)], "case int, item string, key int, coupling double")
    got = search.evaluate(search.ablations(spark), items, None, "ablated")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(case" in plan and "hashpartitioning(ablated#" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(ablated" in x and "case" in x]
    one = {p: search.evaluate(search.ablations(spark).filter(F.col("ablated") == p), items, None, "ablated").first().ndcg for p in ("baseline", "depth_weight_root")}
    assert {r.ablated: r.ndcg for r in got.collect() if r.ablated in one} == pytest.approx(one)


def test_file_edges_by_blocks(spark, monkeypatch):
    """Pairs of blocks sum the names that their files share; no exchange moves pairs of files."""
    monkeypatch.setattr(graph, "BLOCK", 3)
    monkeypatch.setattr(graph, "MOST_PAIRS", 20)
    u = lambda i, s: (i * 7919 + s * 104729) % 10007
    defs, refs = [(f"f{u(i, 1) % 12}", "abcdef"[u(i, 2) % 6]) for i in range(40)], [(f"f{u(i, 3) % 15}", "abcdeg"[u(i, 4) % 6]) for i in range(80)]
    expect = {}
    for s, n in refs:
        for d, m in set(defs):
            if n == m and s != d:
                expect[s, d] = expect.get((s, d), 0) + 1
    edges = graph.file_edges(*(spark.createDataFrame(x, "file string, name string") for x in (defs, refs)))
    got = edges.collect()
    assert len(got) == len(expect) and {(r.src, r.dst): r.w for r in got} == expect
    assert "hashpartitioning(src" not in edges._jdf.queryExecution().executedPlan().toString()
    assert graph.file_edges(*(spark.createDataFrame([], "file string, name string") for _ in range(2))).count() == 0
