import numpy as np

from pulsegrid.llm import _text as T

from . import brute

TEXTS = ["Hello, World! ÄÖ ß-1", "", None, "  \n\tA b\x0bC  ", "one two three four five six", "x" * 5000 + " y", "\x00\x1f nul"]


def test_words_match_the_patterns():
    for member, plain in ((T.SOLID, brute.solid_words), (T.ALNUM, brute.alnum_words)):
        w = T.words_of(TEXTS, member)
        got = [[w.text(i, i + 1) for i in range(a, z)] for a, z in zip(w.first[:-1], w.first[1:])]
        assert got == [plain(t) for t in TEXTS]


def test_equal_words_have_equal_hashes_and_others_differ():
    w = T.words_of(["ab ba ab abc a b AB"], T.SOLID)
    assert w.hash[0] == w.hash[2] == w.hash[6]
    assert len(set(w.hash.tolist())) == 5


def test_shingle_sets_have_the_right_sizes():
    texts = ["a b c d e f a b c d e f", "a b", "", None, "a b c d e"]
    sets = T.shingle_sets(T.words_of(texts, T.SOLID), 5)
    assert [len(s) for s in sets] == [len(brute.shingles(brute.solid_words(t), 5)) for t in texts]
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)


def test_chunks_cover_all_rows():
    assert list(T.chunks(["aaa", None, "bbbb", "c"], 4)) == [(0, 2), (2, 3), (3, 4)]
    assert list(T.chunks([])) == []


def test_big_integers_beside_nulls_stay_exact(spark):
    df = spark.createDataFrame([(2**62 + 1, "a"), (None, "b")], "doc_id bigint, text string")
    got = T.map_frames(df, lambda bs: bs, df.schema).collect()
    assert {r.doc_id for r in got} == {2**62 + 1, None}
