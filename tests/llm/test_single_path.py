"""Pages of a host with a single path are told apart by their query."""

from stratagraph.llm import html_diff


def test_pages_of_a_single_path_have_partners_by_query(spark):
    page = lambda x: f"<nav>Home</nav><p>{x}</p><footer>site</footer>"
    urls = [(1, "http://f.org/forum.php?id=10"), (2, "http://f.org/forum.php?id=11#top"), (3, "http://F.org/forum.php?id=20"), (4, "http://f.org/forum.php/?id=11"), (5, "http://f.org/forum.php")]
    urls += [(6, "http://one.org/a?x=1"), (7, "http://one.org/a?x=1#b"), (8, "http://two.org/a?x=1"), (9, "http://two.org/a?x=2"), (10, "http://two.org/b"), (11, "?x=1"), (12, "?x=2")]
    df = spark.createDataFrame([(i, u, page(f"text {i}")) for i, u in urls], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.partner_id, r.n_lines, r.n_shared, r.text) for r in html_diff.page_differences(df).collect()}
    partner = {1: 2, 2: 1, 3: 2, 4: 1, 5: 1, 8: 10, 9: 10, 10: 8}
    whole = lambda i: f"Home\ntext {i}\nsite"
    assert got == {i: (partner[i], 3, 2, f"text {i}") if i in partner else (None, 3, 0, whole(i)) for i, _ in urls}
