import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_seed_terms_of_chinese_chunks(spark):
    assert one(spark, text.seed_terms(F.lit("连衣裙穿搭 abc 上海"))) == ["连衣裙穿搭", "连衣", "穿搭", "abc", "上海", "连衣裙穿搭abc上海"]
    assert one(spark, text.seed_terms(F.lit(""))) == []


def test_match_score(spark):
    assert one(spark, text.match_score(F.lit("ab"), F.lit("xaby"), F.lit("zz"))) == pytest.approx(5.0)
    assert one(spark, text.match_score(F.lit(""), F.lit("x"), F.lit("x"))) == 0


def test_titles(spark):
    assert one(spark, text.topic_tags(F.lit("看 #[春天]# 和 #夏天[话题]# #[春天]#"))) == ["春天", "夏天"]
    assert one(spark, text.shown_title(F.lit(" "), F.lit("#夏天[话题]#"))) == "(无标题) #夏天[话题]#"
    assert one(spark, text.shown_title(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "(无标题)"
    assert one(spark, text.shown_title(F.lit(" a "), F.lit("b"))) == "a"


def weigh(cut, freq):
    return sum(math.log1p(freq.get(t, 0)) + 0.15 * min(len(t), 6) for t in cut)


def allowed(cut, chunk, freq):
    return all(len(t) <= search.LONGEST_TERM and (t in freq or t == chunk or (i == len(cut) - 1 and len(t) >= 2)) for i, t in enumerate(cut))


@pytest.mark.parametrize("chunk", ["连衣裙穿搭", "上海天气预报", "abcabc", "ab", "上海天气预报上海天气预报"])
def test_segmentation_against_all_cuts(spark, chunk):
    freq = {"连衣": 5, "连衣裙": 3, "裙": 2, "穿搭": 9, "上海": 8, "天气": 4, "天气预报": 2, "预报": 3, "abc": 4, "a": 2}
    terms = spark.createDataFrame(list(freq.items()), "term string, freq long")
    found = search.segmented(spark.createDataFrame([(chunk,)], "chunk string"), terms).first().terms
    assert "".join(found) == chunk
    n = len(chunk)
    cuts = [[chunk[a:b] for a, b in itertools.pairwise((0, *c, n))] for k in range(n) for c in itertools.combinations(range(1, n), k)]
    fine = [c for c in cuts if allowed(c, chunk, freq)] if n > 2 else [[chunk]]
    assert weigh(found, freq) == pytest.approx(max(weigh(c, freq) for c in fine))


def test_corrections(spark):
    counted = spark.createDataFrame([("summer dress", 50), ("winter dress", 20), ("red shoes", 3)], "query string, n long")
    typed = spark.createDataFrame([("sumer dress",), ("summer dress",), ("xx",), ("something else",)], "query string")
    out = search.corrected_queries(typed, counted, search.term_scores(counted), 0.5).collect()
    assert [(r.query, r.corrected) for r in out] == [("sumer dress", "summer dress")]


def test_best_request_ties_go_to_the_first(spark):
    past = spark.createDataFrame([(1, 10, "red shoes"), (1, 11, "red shoes"), (1, 9, "hat")], "user long, request long, target string")
    asked = spark.createDataFrame([(1, "shoes")], "user long, query string")
    assert search.best_requests(asked, past).first().request == 10
