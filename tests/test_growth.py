"""Steps that grew faster than their input: the whole result against plain Python, and a plan without the step that grew."""

import random

from quillstone.operators import similar


def plan(df):
    return df._jdf.queryExecution().toString()


def test_batch_pairs_by_joins(spark, monkeypatch):
    """No task compares all texts of a topic; words of many rows are dealt over tasks."""
    monkeypatch.setattr(similar, "_HOT", 7)
    r = random.Random(3)
    word = lambda: f"w{int(r.random() ** 3 * 40)}"
    texts = [" ".join(word() for _ in range(r.randrange(0, 9))) for _ in range(160)]
    # longer ones with a like text, equal heads, the threshold itself (7 of 10), and no words
    texts += [" ".join(f"x{k}" for k in range(n, n + 12)) for n in range(9)] + ["Same " * 14 + f"tail{k}" for k in range(3)]
    texts += [" ".join(f"y{k}" for k in range(n)) for n in (7, 8, 10)] + ["", "-", "--"]
    rows = [(i, ("a", "A", "b", None)[i % 4], t) for i, t in enumerate(texts)]
    held, want = {}, []
    for pos, topic, text in rows:
        head, s, mine = text[:60].lower(), set(text.replace("-", "").lower().split()), held.setdefault(topic and topic.lower(), [])
        if not any(h == head or (s | x and len(s & x) / len(s | x) > 0.7) for h, x in mine):
            mine.append((head, s))
            want.append((pos, topic, text))
    df = similar.batch_kept(spark.createDataFrame(rows, "pos long, topic string, text string"))
    assert "FlatMapGroupsInPandas" not in plan(df) and len(want) < len(rows)
    assert sorted(tuple(x) for x in df.collect()) == want


def lines(r, n, topics=2):
    """(entry_id, topic, days_old, relevance, body) with short and like lines, of which many are equal."""
    word = lambda: f"word{int(r.random() ** 2 * 12)}"
    return [(i, r.choice([f"t{k}" for k in range(topics)]), r.randrange(9), 1.0, " ".join(word() for _ in range(r.randrange(0, 8)))) for i in range(n)]


SCHEMA = "entry_id long, topic string, days_old int, relevance double, body string"


def overlaps(rows, above=0.5):
    sets = {i: set(x.split()) for i, *_, x in rows}
    found = {}
    for i, t, *_ in rows:
        for j, u, *_ in rows:
            if i < j and t == u and sets[i] & sets[j] and (share := len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j]))) > above:
                found[t, i, j] = share
    return found


def test_overlap_counts_without_pairs(spark, monkeypatch):
    """A count needs no pair of entries written out: equal lines are one class."""
    monkeypatch.setattr(similar, "_HOT", 5)
    rows = lines(random.Random(4), 220)
    df = similar.overlap_pair_counts(spark.createDataFrame(rows, SCHEMA))
    want = overlaps(rows)
    assert {x.topic: x.pairs for x in df.collect()} == {t: sum(k[0] == t for k in want) for t in ("t0", "t1")}
    same = spark.range(30_000).selectExpr("id AS entry_id", "'t' AS topic", "'all the same words' AS body")
    assert similar.overlap_pair_counts(same).first().pairs == 30_000 * 29_999 // 2


def test_overlap_pairs_of_equal_lines(spark, monkeypatch):
    """Entries with equal words are paired by blocks, and only sets that can overlap are compared."""
    monkeypatch.setattr(similar, "_HOT", 5)
    monkeypatch.setattr(similar, "_BLOCK", 4)
    for above in (0.5, 0.3, 0.8):
        rows = lines(random.Random(5), 200)
        df = similar.overlap_pairs(spark.createDataFrame(rows, SCHEMA), above)
        assert "count(1) AS both" not in plan(df)
        assert {(x.topic, x.a, x.b): x.overlap for x in df.collect()} == overlaps(rows, above)


def test_superseded_many_equal_lines(spark, monkeypatch):
    """20,000 equal lines in one topic, which made 200 million pairs in one task."""
    from .test_folds import supersessions

    monkeypatch.setattr(similar, "_HOT", 5)
    rows = lines(random.Random(6), 300, 3)
    got = {x.entry_id: x.by for x in similar.superseded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) > 50 and got == supersessions(rows)
    same = spark.range(20_000).selectExpr("id AS entry_id", "'t' AS topic", "cast(1000 - id div 20 AS int) AS days_old", "'all the same words' AS body")
    df = similar.superseded(same)
    assert "FlatMapCoGroupsInArrow" in plan(df)
    assert {x.entry_id: x.by for x in df.collect()} == {i: 19_999 for i in range(20_000 - 40)}


def test_diverse_top_made_in_many_tasks(spark):
    """Hits are made in their own tasks and thinned there; one task folds what is left."""
    import heapq

    from quillstone.operators.search import diverse_top

    for seed in range(3):
        r = random.Random(seed)
        rows = [(i, f"t{int(r.random() ** 2 * 5)}", round(r.choice((1, 2, 4)) * r.random(), 2)) for i in range(900)]
        held = []
        for e, t, s in rows:
            if len(held) < 10:
                heapq.heappush(held, (s, -e, t))
            elif s > held[0][0] and (sum(x[2] == t for x in held) < 3 or s > 1.5 * held[0][0]):
                heapq.heapreplace(held, (s, -e, t))
        df = diverse_top(spark.createDataFrame(r.sample(rows, 900), "entry_id long, topic string, score double").repartition(5), 10)
        assert "Repartition 1, false" not in plan(df)
        assert sorted((x.score, -x.entry_id, x.topic) for x in df.collect()) == sorted(held)


def test_calls_in_one_scan(spark):
    """Lines are read once and their text isn't shuffled: definitions aren't joined to them."""
    from quillstone.operators import code

    text = ["before(1)", "pub fn main() {", "    a1::run_all(x(2), yy(3)); foo (1)", "// fn no() gone(1)", "fn helper(x: u8) { helper(1); other(2)", "let v = Vec::new();", "fn other() {", "if (a) while(b) __x9(c)"]
    df = code.calls(spark.createDataFrame([("a.rs", i + 1, x) for i, x in enumerate(text)], "file string, line_no int, line string"))
    assert "Join" not in plan(df)
    want = {(1, "<module>", "before"), (3, "main", "run_all"), (3, "main", "yy"), (5, "helper", "other"), (6, "helper", "new"), (8, "other", "__x9")}
    assert {(x.line_no, x.caller, x.callee) for x in df.collect()} == want
