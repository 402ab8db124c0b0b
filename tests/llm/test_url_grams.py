import numpy as np
import pytest

from quillspark.llm import url_filter


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(5)
    word = lambda a, n: "".join(rng.choice(list(a), n))
    urls = [f"http://{word('aeiou', 6)}.com/{word('rst', 9)}" for _ in range(200)] + [f"http://{word('xzqk', 6)}.net/es/{word('0123', 9)}" for _ in range(200)]
    urls += [f"http://{word('aeiouxzqk', 5)}.org/{word('rst0123', 7)}" for _ in range(200)]
    urls += [None, "", "x", "http://é\U0001F642￿.org/￿", "http://long.org/" + "ab1" * 30_000, urls[0], urls[0]]
    return spark.createDataFrame([*enumerate(urls), (None, "http://aa.com/")], "page_id long, url string")


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("max_grams", [0, 30, 700])
def test_more_grams_than_are_sent_change_no_score(spark, df, max_grams):
    want = rows(url_filter.judge(spark, df))
    assert len({r[5] for r in want}) > 500 and {r[4] for r in want if r[3] is None} == {"allow", "block"}
    assert rows(url_filter.judge(spark, df, max_grams=max_grams)) == want


def test_more_grams_of_one_kind(spark, df):
    only = df.filter("url like '%.com/%' or url like '%.org/%'")
    assert rows(url_filter.judge(spark, only, max_grams=30)) == rows(url_filter.judge(spark, only))
