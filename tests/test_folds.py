"""Queries whose result depends on the order of entries, over whole tables, against plain Python."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.plans import registry
from quillstone.plans.similar import _aged
from quillstone.sources.views import table

registry.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def first_line(body):
    return next((x for x in (body or "").split("\n") if x.strip(" ")), "")


def words(line):
    return {w.lower() for w in re.split(r"[ \t\n\x0b\f\r]+", line) if len(w.encode()) >= 3}


@pytest.fixture(scope="module")
def aged(spark):
    rows = _aged(spark, SF).select("entry_id", "topic", "days_old", "relevance", "body").collect()
    return sorted((r.entry_id, r.topic, r.days_old, r.relevance, first_line(r.body)) for r in rows)


def of(spark, name, *cols):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, SF).select(*cols).collect())


def by_topic(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def supersessions(rows):
    """{older: newer} of entries (id, topic, days, …, line), met pair by pair in log order."""
    gone = {}
    for group in by_topic(rows).values():
        sets = {r[0]: words(r[-1]) for r in group}
        group = [r for r in group if len(sets[r[0]]) >= 3]
        for n, a in enumerate(group):
            for b in group[n + 1 :] if a[0] not in gone else ():
                x, y = sets[a[0]], sets[b[0]]
                if b[0] in gone or not x & y or len(x & y) * 100 // len(x | y) < 60 or abs(a[2] - b[2]) < 2:
                    continue
                old, new = (a, b) if a[2] > b[2] else (b, a)
                gone[old[0]] = new[0]
    return gone


def leaders(rows, most=50, percent=40):
    out = {}
    for group in by_topic(rows).values():
        heads = []
        for r in group[:most]:
            s = words(r[-1])
            lead = next((i for i, x in heads if s | x and len(s & x) * 100 // len(s | x) >= percent), None)
            if lead is None:
                heads.append((r[0], s))
            out[r[0]] = r[0] if lead is None else lead
    return out


def test_superseded(spark, aged):
    assert of(spark, "superseded", "entry_id", "by") == sorted(supersessions(aged).items())


def test_leader_clusters(spark, aged):
    assert of(spark, "leader_clusters", "entry_id", "leader") == sorted(leaders(aged).items())


def test_folds_on_alike_lines(spark):
    """The same on lines of few words, of which many are alike."""
    from quillstone.operators import similar

    r = __import__("random").Random(2)
    rows = [(i, f"t{r.randrange(2)}", r.randrange(12), float(r.randrange(5)), " ".join(r.choice(("alpha", "beta", "gamma", "delta", "omega", "ab")) for _ in range(r.randrange(0, 7)))) for i in range(150)]
    df = spark.createDataFrame(rows, "entry_id long, topic string, days_old int, relevance double, body string")
    want = supersessions(rows)
    assert len(want) > 20 and {x.entry_id: x.by for x in similar.superseded(df).collect()} == want
    groups = leaders(rows)
    assert len(set(groups.values())) < len(groups) == 100 and {x.entry_id: x.leader for x in similar.leader_clusters(df).collect()} == groups
    assert {x.entry_id: (x.relevance, x.chain, x.by) for x in similar.compressed(df).collect()} == briefing(rows)


def test_batch_dedup(spark):
    rows = sorted((r.conv_id * 1000 + r.turn, r.role, r.text) for r in table(spark, SF, "conversations").collect())
    held, want = {}, []
    for pos, role, text in rows:
        head, s, mine = text[:60].lower(), set(T._py_tokens(text)), held.setdefault(role.lower(), [])
        if not any(h == head or (s | x and len(s & x) / len(s | x) > 0.7) for h, x in mine):
            mine.append((head, s))
            want.append((pos, role, text))
    assert of(spark, "batch_dedup", "pos", "topic", "text") == want


def test_debounce(spark):
    last, want = {}, []
    for r in sorted(table(spark, SF, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts")).collect(), key=lambda r: (r.ts, r.event_id)):
        if r.user_id not in last or (r.ts - last[r.user_id]).total_seconds() >= 48 * 3600:
            last[r.user_id] = r.ts
            want.append((r.event_id,))
    assert of(spark, "session_debounce", "event_id") == sorted(want)


def term(line):
    bare = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in line.split()]
    fit = [w for w in bare if len(w.encode()) >= 3 and w[0].isupper()]
    return max(reversed(fit), key=lambda w: len(w.encode())) if fit else None


def briefing(rows):
    """{entry: (relevance, chain, by)} of all passes, one after the other."""
    best = {}
    for r in rows:
        if len(r[4].encode()) >= 10:
            best.setdefault(r[4].lower(), []).append(r)
    top = {k: max(v, key=lambda r: (r[3], r[0])) for k, v in best.items() if len({r[1] for r in v}) > 1}
    rows = [r for r in rows if r[4].lower() not in top or top[r[4].lower()][1] == r[1]]
    by = supersessions(rows)
    score = {r[0]: r[3] * (0.5 if r[0] in by else 1.0) for r in rows}
    chain = {}

    def folded(rows, key, least, name):
        """Keep the newest of each group of `least` rows that have a key."""
        groups = {}
        for r in rows:
            if key(r) is not None:
                groups.setdefault((r[1], key(r)), []).append(r)
        gone = set()
        for g in groups.values():
            if len(g) >= least:
                newest = min(g, key=lambda r: (r[2], -r[0]))
                gone |= {r[0] for r in g} - {newest[0]}
                chain[newest[0]], score[newest[0]] = name, score[newest[0]] + len(g)
        return [r for r in rows if r[0] not in gone], len(gone)

    total = len(rows)
    rows, gone = folded(rows, lambda r: term(r[4]), 2, "term")
    if gone * 100 // total <= 60:
        free = lambda r: r[0] not in chain and r[0] not in by
        rows, _ = folded(rows, lambda r: r[2] // 2 if free(r) else None, 3, "batch")
        lead = leaders([r for r in rows if free(r)])
        rows, _ = folded(rows, lambda r: lead.get(r[0]), 2, "similar")
    return {r[0]: (score[r[0]], chain.get(r[0]), by.get(r[0])) for r in rows}


def test_compressed_briefing(spark, aged):
    got = {r.entry_id: (r.relevance, r.chain, r.by) for r in registry.QUERIES["compressed_briefing"](spark, SF).collect()}
    assert got and got == briefing(aged)
