"""Queries and operators do the whole job: on small inputs that earlier, narrower code cut, against plain Python."""

import random

import pytest

from quillstone.operators import similar
from quillstone.plans import registry

registry.load()


def walked(edges, root):
    """Names that a breadth-first walk over (src, dst) meets."""
    seen, level = {root}, [root]
    while level:
        level = [b for a, b in edges if a in level and b not in seen]
        seen |= set(level)
    return seen


def test_reachable_all_orders(spark, tmp_path):
    r = random.Random(7)
    orders = [(k, r.randrange(1, 40)) for k in range(2900, 3200, 3)]
    # a chain of orders after the 3000th: customer 1 -> supplier 41 -> customer 50 -> suppliers 1 and 43
    orders += [(900001, 1), (900002, 50), (900003, 50), (900004, 50)]
    lines = [(k, r.randrange(1, 40)) for k, _ in orders[:-4] for _ in range(2)] + [(900001, 41), (900002, 41), (900003, 1), (900004, 43)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    of = dict(orders)
    got = [x.name for x in registry.QUERIES["graph_reachable"](spark, str(tmp_path)).collect()]
    edges = {(2 * of[k], 2 * s + 1) for k, s in lines}
    want = walked(edges | {(b, a) for a, b in edges if b % 4 == 3}, 2)
    assert {2 * 41 + 1, 2 * 43 + 1, 2 * 50, 2} <= want and sorted(got) == sorted(want)


@pytest.mark.parametrize(("chained", "total", "later"), [(8, 10, False), (7, 10, True), (18, 28, True), (9, 13, False)])
def test_briefing_early_exit(spark, chained, total, later):
    """Terms remove 70, 60, 60.7 and 61.5 percent; the two-day pass runs up to 60 whole percent."""
    e = [(i, "t", f"Planner step{i} word{i}", 0) for i in range(chained)] + [(i, "t", f"plain{i} other{i} line{i}", 0) for i in range(chained, total)]
    df = spark.createDataFrame([(*x, 1.0) for x in e], "entry_id long, topic string, body string, days_old int, relevance double")
    got = {r.entry_id: (r.chain, r.relevance) for r in similar.compressed(df).collect()}
    want = {chained - 1: ("term", 1.0 + chained)}
    rest = range(chained, total)
    want |= {total - 1: ("batch", 1.0 + len(rest))} if later else {i: (None, 1.0) for i in rest}
    assert got == want


def labelled(text):
    """The label of the first content line."""
    meta = ("[tags:", "[source:", "[confidence:", "[links:", "[modified:", "[type:", "[tier:")
    line = next((x for x in (text or "").split("\n") if x.strip() and not x.strip().startswith(meta)), "")
    words = []
    for w in line.lstrip("#*- ").split():
        if w[0] in "([" or "/" in w or w in ("→", "--", "—") or len(words) == 3:
            break
        words.append(w)
    return " ".join(words).rstrip(":,;—")


def test_labels_all_documents(spark, tmp_path):
    texts = [
        "Gotcha: one two", "alpha, beta, gamma, delta", "## head (rest) more", "a/b first", "run → stop now", "left -- right", "one — two", "see [x] y", "end three four;", "x" * 58 + " second third",
        "\n\n  late line here too", "[tags: a]\nbody words: here", "(all gone)", "", None, "- * plain | bar words", "go--on three four five", "just two:—",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.label for r in registry.QUERIES["label_words"](spark, str(tmp_path)).collect()}
    assert got == {i: labelled(t) for i, t in enumerate(texts)}


def test_jaccard_beyond_fifty(spark):
    r = random.Random(5)
    files = [(i, sorted({f"w{int(r.random() ** 2 * 60)}" for _ in range(r.randrange(1, 12))})) for i in range(120)] + [(120, []), (121, ["w1", "w2"]), (122, ["far", "off", "x"])]
    files[0] = (0, ["far", "off", "x"])
    got = {(x.a, x.b): x.jaccard for x in similar.all_jaccard_pairs(spark.createDataFrame(files, "file long, ws array<string>"), 0.4).collect()}
    sets = {i: set(w) for i, w in files}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] | sets[b]}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0.4}) and (0, 122) in got


def test_leader_clusters_whole_topic(spark):
    e = spark.createDataFrame([(i, "t", "same old words") if i in (0, 70) else (i, "t", f"only{i} text{i} here{i}") for i in range(80)], "entry_id long, topic string, body string")
    assert {r.entry_id: r.leader for r in similar.leader_clusters(e, most=None).collect()} == {i: 0 if i == 70 else i for i in range(80)}
    assert similar.leader_clusters(e).count() == 50
