import random

from pulsegrid.llm import decontam as D

from . import brute


def data(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the"] * 30
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([3, 8, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "..!"), (None, "no id here at all"), (53, "Émile Ärger")]
    items.append((60, items[4][1]))
    docs = []
    for d in range(60):
        text = say(rng.randint(0, 80))
        if d % 3 == 0:
            part = rng.choice([t for _, t in items if t]).split()
            text += " " + "-".join(part).upper() + ". " + say(5)
        docs.append((d, text))
    return [*docs, (100, None), (101, ""), (None, items[0][1]), (0, docs[0][1])], items


def run(spark, docs, items, **options):
    df = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id bigint, text string, row string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, n int")
    got = D.contamination(df, bench, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids), r.contaminated) for r in got), key=repr)


def test_matches_brute_force(spark):
    docs, items = data()
    want = sorted(brute.contamination(docs, [x for x in items if x[0] is not None]), key=repr)
    assert run(spark, docs, items) == want
    assert sum(x[4] for x in want) > 10


def test_benchmark_in_several_parts_gives_the_same(spark):
    docs, items = data(4)
    assert run(spark, docs, items, part_windows=40) == run(spark, docs, items)


def test_empty_tables(spark):
    docs, items = data()
    assert all(x[2] == 0 for x in run(spark, docs, []))
    assert run(spark, [], items) == []


def test_the_rarest_shingle_is_the_anchor(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, "a b c d e f g h i j k l") for i in range(5)], "doc_id bigint, text string")
    windows = D.item_windows(items)
    keys = {5: __import__("numpy").sort(__import__("numpy").array(windows.first().shingles, dtype="int64").view("uint64"))}
    best = D.rarest_shingles(windows, D.shingle_counts(docs, keys)).first()
    assert best["at"] == 8 and best["k"] == 5
