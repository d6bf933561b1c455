"""Cases worked by hand from the definitions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewater.functions import parsing, scoring, text
from tidewater.operators import assembly, evaluation, history, metrics, recall, routes, search, serving, training, vectors
from tidewater.operators.relational import cold_start, cumulated, quantiles, standardised
from tidewater.sources import files
from tidewater.streaming import behaviour


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_interaction_score_is_the_sum(spark):
    row = spark.createDataFrame([(1, 1, 0, 0, 0, math.e - 1), (0, -1, 0, 0, 0, -5.0), (None, None, 0, 0, 1, None)], "click int, like int, collect int, comment int, share int, page_time double")
    assert [r.x for r in row.select(scoring.interaction_score().alias("x")).collect()] == pytest.approx([3.2, 0.0, 3.0])


def test_swing_counts_pairs_of_users(spark):
    # users 1 and 2 share items 1, 2 and 3; user 3 has 1 and 2
    graph = spark.createDataFrame([(u, i, 1.0) for u, items in ((1, (1, 2, 3)), (2, (1, 2, 3)), (3, (1, 2))) for i in items], "user long, item long, score double")
    found = {(r.src, r.dst): r.score for r in recall.swing(graph).collect()}
    w = {1: 3**-0.5, 2: 3**-0.5, 3: 2**-0.5}
    assert found[1, 2] == pytest.approx(w[1] * w[2] / 4 + 2 * w[1] * w[3] / 3) and found[1, 3] == pytest.approx(w[1] * w[2] / 4)
    assert found[1, 2] == pytest.approx(found[2, 1])


def test_swing_takes_weights_before_items_are_trimmed(spark):
    # item 9 keeps its best two users of three; user 3 still counts it among its items
    rows = [(1, 9, 3.0), (2, 9, 2.0), (3, 9, 1.0), (1, 5, 1.0), (2, 5, 1.0), (3, 5, 1.0)]
    graph = spark.createDataFrame(rows, "user long, item long, score double")
    found = {(r.src, r.dst): r.score for r in recall.swing(graph, 10, 2).collect()}
    # item 5 keeps users 1 and 2 too; both have two items, both in common
    assert found[9, 5] == pytest.approx(0.5 / 3)


def test_transitions_of_every_item_before(spark):
    steps = spark.createDataFrame([(1, 0, 7, 2.0), (2, 3, 7, 2.0), (7, 1, 7, 2.0), (1, 0, 8, 0.0), (1, 1, 7, 100.0)], "src long, recency int, dst long, y double")
    found = {(r.src, r.dst): r.score for r in recall.sequence_transitions(steps).collect()}
    assert found == {(1, 7): pytest.approx(1.44 * 1.18 + 3.5 * 1.18 / 1.32), (2, 7): pytest.approx(1.44 / 1.96)}


def test_block_recall_is_the_recall_of_each_request(spark):
    import random

    draw = random.Random(7)
    rows = [(u, r // 64, 1000 * u + r, draw.choice([-5, 1 << 40, 1, 2, 3, 4, 5, 99]), n) for u in range(3) for r in range(70) for n in range(3)]
    history = spark.createDataFrame(rows, "user long, block long, request long, item long, recency long")
    pairs = [(s, s ^ d, draw.choice([0.5, 0.5, -0.25, draw.random()])) for s in (-5, 1 << 40, 1, 2, 3, 4, 5) for d in range(1, 30)]
    index = spark.createDataFrame(pairs, "src long, dst long, score double")
    key = lambda r: (r.request, r.rank, r.found, round(r.score, 9))
    found = recall.block_recall(history, index, 12, 2)
    assert sorted(map(key, found.collect())) == sorted(map(key, recall.i2i_recall(history, index, 12).collect()))


def test_transitions_are_dealt_once_and_lists_are_not_sent_to_each_request(spark):
    import __spark_entry__

    plan = recall.sequence_transitions(spark.createDataFrame([(1, 0, 7, 2.0)], "src long, recency int, dst long, y double"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    for name in ("transition_recall", "offline_rec_recall"):
        found = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString(), name  # shares are written by then


def test_similar_users_come_in_shares(spark):
    graph = spark.createDataFrame([(1, 7, 2.0), (2, 7, 1.0), (3, 7, 3.0), (2, 8, 1.0), (3, 8, 2.0), (4, 9, 1.0)], "user long, item long, score double")
    near = recall.usercf(graph, 1, 2)
    a, b = 1 / math.log(4), 1 / math.log(3)
    n1, n2, n3 = math.sqrt(4 * a), math.sqrt(a + b), math.sqrt(9 * a + 4 * b)
    found = {r.user: (r.other, r.score) for r in near.collect()}
    of_3 = (3 * a + 2 * b) / (n2 * n3)
    assert found == {1: (3, pytest.approx(6 * a / (n1 * n3))), 2: (3, pytest.approx(of_3)), 3: (2, pytest.approx(of_3))}
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()  # shares are written by then


def test_items_of_similar_users_are_found_in_shares_and_kept_small(spark):
    import random

    draw = random.Random(3)
    edges = {(draw.randrange(40) * 300, draw.choice([None, -7, 1 << 40, *range(20)])): draw.choice([0.5, 1.0, draw.random()]) for _ in range(400)}
    graph = spark.createDataFrame([(u, i, s) for (u, i), s in edges.items()], "user long, item long, score double")
    near = {(r.user, r.other): r.score for r in recall.usercf(graph, 5, 1).collect()}
    sums = {}
    for (u, v), x in near.items():
        for (w, i), s in edges.items():
            if w == v:
                sums[u, i] = sums.get((u, i), 0.0) + x * s
    want = {}
    for (u, i), s in sums.items():
        want.setdefault(u, []).append((-round(s, 9), i is not None, i or 0, i, s))
    want = {(u, x[3]): x[4] for u, rows in want.items() for x in sorted(rows)[:6]}
    for digits, shares in ((None, 3), (6, 2)):
        out = recall.usercf_recall(graph, 5, 6, digits, shares)
        rows = {(r.user, r.item): r.score for r in out.collect()}
        assert rows.keys() == want.keys()
        assert all(rows[k] == (pytest.approx(want[k]) if digits is None else round(want[k], 6)) for k in want)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # found in shares, whose shuffles are gone by then
        assert len(out.inputFiles()) > 0 and all("/found-" in f for f in out.inputFiles())  # one compressed table for each share


def test_edges_fall_back_to_clicks(spark):
    rows = spark.createDataFrame([(1, 2, 0.0, 1), (1, 3, -1.0, 0)], "user long, item long, label double, click int")
    assert recall.edges(rows).count() == 0
    assert [(r.user, r.item, r.score) for r in recall.edges(rows, click="click").collect()] == [(1, 2, 1.0)]


def test_scaled_counters(spark):
    rows = spark.createDataFrame([(0, 5.0), (3, 5.0)], "n long, c double")
    out = sorted(tuple(r) for r in standardised(rows, ["n"], ["c"]).collect())
    x = math.log(4) / 2 / (math.log(4) / math.sqrt(2))
    assert out == [(pytest.approx(-x), 0.0), (pytest.approx(x), 0.0)]


def test_users_without_requests_are_coldest(spark):
    users, requests = spark.createDataFrame([(1,), (2,), (3,)], "user long"), spark.createDataFrame([(2,), (3,), (3,), (3,)], "user long")
    assert sorted(tuple(r) for r in cold_start(users, requests).collect()) == [(1, 0), (2, 1)]


def test_truth_prefers_any_detail(spark):
    rows = spark.createDataFrame([(1, [(1, 5)], [(1, 8), (2, 9)]), (2, [], [(2, 9), (1, 9), (3, -1)])], "r int, a array<struct<position:int,item:long>>, b array<struct<position:int,item:long>>")
    assert [r.t for r in rows.select(training.truth_list(F.col("a"), F.col("b")).alias("t")).collect()] == [[5], [9]]


def test_summary_of_a_history(spark):
    rows = spark.createDataFrame([(1, 10, 1), (1, 11, 0), (2, 10, 0)], "user long, vec_id long, recency int")
    v = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 2.0])], "vec_id long, v array<double>")
    found = {r.user: r.v for r in history.summarised(rows, v).collect()}
    x = [0.34 * 0.35 / 1.35 + 0.26 * 0.5 + 0.14 * 0.5 + 0.08, 0.34 * 2 / 1.35 + 0.26 * 1 + 0.18 * 2 + 0.14 * 1 + 0.08 * 2]
    n = math.hypot(*x)
    assert found[1] == pytest.approx([x[0] / n, x[1] / n]) and found[2] == pytest.approx([1.0, 0.0])


def test_built_texts(spark):
    pairs = [(" a ", "b\n", "title：a\ncontent：b"), ("a", " ", "title：a"), (None, "b", "content：b"), (None, None, "content：")]
    assert [one(spark, text.built(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b, _ in pairs] == [x for *_, x in pairs]


def test_terms_of_latin_letters_are_not_corrected(spark):
    terms = spark.createDataFrame([("summer", 50), ("连衣裙子", 50), ("连衣", 50)], "term string, freq long")
    asked = spark.createDataFrame([("sumer",), ("连衣裙了",), ("连了",), ("123",)], "term string")
    assert [(r.term, r.known) for r in serving.corrections(terms, asked, 0.1).collect()] == [("连衣裙了", "连衣裙子")]


def test_normalised_queries(spark):
    pairs = {
        "ＡＢＣ　蘋果，手機！": "abc 苹果 手机", "beijing 今晚 1,234 公里": "北京 今天晚上 1234km", "2.5 公斤 \x07 10ML 3升": "2 5kg 10ml 3l", "東京/後天 “門”": "东京 后天 门",
        "a\U0001f600b (c) [d]": "a b c d", "1,2,3": "123", "  ": "", "x" * 120: "x" * 100,
    }
    assert {q: one(spark, text.normalized(F.lit(q))) for q in pairs} == pairs
    assert one(spark, text.normalized(F.lit(None).cast("string"))) == "" and one(spark, text.normalized(F.lit("ﬁne"), whole=True)) == "fine"


def test_intents_and_shapes(spark):
    assert one(spark, text.intents(F.lit("怎么对比推荐测评"))) == ["tutorial", "compare", "recommend"]
    shapes = {"裙": "short", "red shoes for rainy days": "long", "推荐 abc de fgh": "recommend", "abc defg hij": "default", "测评 abc de fgh": "long"}
    assert {q: one(spark, routes.query_shape(F.lit(q))) for q in shapes} == shapes


def test_chinese_queries_are_cut(spark):
    queries = spark.createDataFrame([("怎么连衣裙穿搭 abc 大",)], "query string")
    terms = spark.createDataFrame([("连衣裙", 9), ("穿搭", 8), ("怎么", 9)], "term string, freq long")
    stops = spark.createDataFrame([("怎么",)], "term string")
    found = search.query_terms(queries, terms, stops).first()
    assert found.terms == ["连衣裙", "穿搭", "abc", "怎么连衣裙穿搭abc大"]
    plan = search.plans(spark.createDataFrame([("怎么穿搭", ["怎么", "穿搭"])], "query string, terms array<string>"), stops).first()
    assert (plan.must, plan.intents, plan.service_query) == (["穿搭"], ["tutorial", "fashion"], "穿搭 教程 搭配")


def test_recent_queries_weigh_in_corrections(spark):
    counted = spark.createDataFrame([("summer dress", 50), ("simmer dress", 50)], "query string, n long")
    typed = spark.createDataFrame([("s mmer dress", ["simmer dress"]), ("s mmer dress", ["summer dress"])], "query string, recent array<string>")
    out = {r.recent[0]: r.corrected for r in search.corrected_queries(typed, counted, search.term_scores(counted), 0.1).collect()}
    assert out == {"simmer dress": "simmer dress", "summer dress": "summer dress"}


def test_common_short_terms_and_exemptions(spark):
    counted = spark.createDataFrame([("ab", 300), ("jk", 300), ("abc", 300)], "query string, n long")
    assert {r.term for r in search.term_scores(counted).collect()} == {"jk", "abc"} and "ab" in {r.term for r in search.stopwords(counted).collect()}


def test_printed_and_nested_lists(spark):
    printed = "array([5, 1.5]), array([-2, 9]), array([5, 2E-1]), ARRAY([ 7 , .5 ])"
    assert [tuple(x) for x in one(spark, parsing.printed_scores(F.lit(printed), 3))] == [(5, 1.5), (5, 0.2), (7, 0.5)]
    assert one(spark, parsing.printed_scores(F.lit(None).cast("string"), 3)) == []
    nan = float("nan")
    row = spark.createDataFrame([([[3.0, 0.5], [-1.0, 9.0], [4.0], [3.0, 2.0], [6.0, nan], [8.0, float("inf")], [9.0, 1.0]],)], "p array<array<double>>")
    assert [tuple(x) for x in row.select(parsing.nested_scores(F.col("p"), 6).alias("x")).first().x] == [(3, 0.5), (4, 1.0)]
    assert [tuple(x) for x in one(spark, parsing.plain_scores(F.array(F.lit(2), F.lit(-1), F.lit(2)), 9))] == [(2, 1.0)]
    assert one(spark, parsing.printed_ids(F.lit("[3, -4, 3, 12]"), 5)) == [3, 12] and one(spark, parsing.listed(F.lit(" a, b,,a "))) == ["a", "b"]
    assert one(spark, parsing.safe_int(F.lit("9007199254740993"))) == 9007199254740993 and one(spark, parsing.safe_int(F.lit("NaN"))) == -1
    assert one(spark, parsing.ordered_unique(F.array(F.lit(2), F.lit(None), F.lit(1), F.lit(2)))) == [2, 1]


def test_edits_beyond_the_limit(spark):
    assert one(spark, text.bounded_edits(F.lit("abcdef"), F.lit("uvwxyz"), 2)) == 3 and one(spark, text.bounded_edits(F.lit("abc"), F.lit("abd"), 2)) == 1


def test_quantiles_and_running_sums(spark):
    values = [1.0, 2.0, 2.0, 4.0, 10.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert quantiles(rows, "v", [0.0, 0.2, 0.5, 0.9, 1.0]).first()[0] == pytest.approx([1.0, 1.8, 2.0, 7.6, 10.0])
    counts = spark.createDataFrame([(i, i) for i in range(1, 2001)], "v long, n long")
    assert all(r.n_before == (r.v - 1) * r.v // 2 for r in cumulated(counts, "v", ["n"]).collect())
    scored = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "s double, y int")
    assert metrics.auc(scored, "s", "y").first().auc == pytest.approx(3.5 / 4)
    assert metrics.auc(scored.where("y = 0"), "s", "y").first().auc == 0.5


def test_weighted_centroids(spark):
    rows = spark.createDataFrame([(1, [1.0], 0.0), (1, [3.0], -2.0), (2, [1.0], 1.0), (2, [4.0], 2.0)], "g long, v array<double>, w double")
    found = {r.g: r.value for r in vectors.mean_vector(rows, "g", "v", F.col("w")).collect()}
    assert found == {1: pytest.approx(2.0), 2: pytest.approx(3.0)}


def test_missing_vectors_fall_back(spark):
    v = lambda rows: spark.createDataFrame(rows, "request long, v array<double>")
    h = spark.createDataFrame([(1, [0.0, 2.0], 2), (3, [0.0, 5.0], 1), (4, [0.0, 0.0], 1)], "request long, v array<double>, n long")
    out = {r.request: r.q for r in history.blended_vectors(v([(1, [3.0, 0.0]), (2, [0.0, 4.0]), (5, [0.0, 0.0])]), h, "rec").collect()}
    n = math.hypot(0.24, 0.76)
    assert out == {1: pytest.approx([0.24 / n, 0.76 / n]), 2: pytest.approx([0.0, 1.0]), 3: pytest.approx([0.0, 1.0])}
    assert history.usable_vectors(v([(1, [1.0, float("nan")]), (2, [1.0, 1.0])]), v([(1, [0.0, 0.0])])).count() == 0


def test_gate_of_a_search(spark):
    rows = [(1, i, i, 1.0, 0.5, int(i < 2), 0.3 if i == 2 else 0.0, 0.0, 0.0) for i in range(5)] + [(2, i, i, 1.0, 0.5, 0, 0.0, 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "request long, item long, rank int, preranking_score double, gbdt_score double, exact int, cover double, lexical double, intent double")
    out = {(r.request, r.item): r for r in assembly.search_adjusted(df, 4).collect()}
    # request 1: two evident, of the weak ones only item 2 has some evidence; request 2 has none evident, so all stay
    assert set(out) == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)} and out[1, 2].place == 3
    assert out[1, 0].preranking_score == pytest.approx(1 + 1.55 + 0.85) and out[2, 0].preranking_score == pytest.approx(1 - 0.72 - 2.20)


def test_deep_scores_for_the_first_only(spark):
    df = spark.createDataFrame([(1, i, i, float("nan") if i == 1 else 9.0, float(i)) for i in range(4)] + [(1, 0, 7, 1.0, 1.0)], "request long, item long, rank int, deep_score double, gbdt_score double")
    assert {r.item: r.dien_score for r in assembly.rank_stage(df, ranked=3, scored=2).collect()} == {0: 9.0, 1: 0.0, 2: 2.0}


def test_first_hits_of_nothing(spark):
    truth = spark.createDataFrame([(1, 1, 1.0), (2, 5, 1.0), (3, 1, 0.0)], "request long, item long, y double")
    found = spark.createDataFrame([(1, 1, 150)], "request long, item long, rank int")
    row = evaluation.full_recall(found, truth).first()
    assert (row.recall_100, row.recall_300, row.hit_300, row.mrr_300, row.first_hit, row.n_requests) == (0.0, 0.5, 0.5, pytest.approx(1 / 300), 150.0, 2)
    assert evaluation.full_recall(found.where("false"), truth).first().first_hit == -1.0


def test_examples_take_one_request_of_a_user(spark):
    rows = [(1, 1, 25, 25), (2, 1, 30, 30), (3, 2, 9, 90), (4, 3, 12, 11), (5, 4, 10, 10)]
    out = evaluation.examples(spark.createDataFrame(rows, "request long, user long, results long, behaviours long"), 3, 4).orderBy("place").collect()
    assert [r.request for r in out] == [5, 2, 4]


def test_draws_are_a_walk_through_the_sums(spark):
    items = spark.createDataFrame([(i, float(1 + i % 3)) for i in range(50)], "item long, w double")
    rows = spark.createDataFrame([(i, [1, 2, 99] if i % 2 else None) for i in range(40)], "id long, hard_negatives array<long>")
    out = training.negatives_drawn(rows, items, 3).collect()
    assert sorted((r.id, r.turn) for r in out) == [(i, t) for i in range(40) for t in range(3)]
    assert {(r.id % 2, r.turn, r.kind) for r in out} == {(0, t, "easy") for t in range(3)} | {(1, 0, "hard"), (1, 1, "easy"), (1, 2, "easy")}
    assert all(r.item in (1, 2) for r in out if r.kind == "hard")
    assert sorted(out) == sorted(training.negatives_drawn(rows.repartition(3), items, 3).collect())


def test_gap_is_measured_from_the_last_accepted(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, "rec", "click", 5, 9, i, start + dt.timedelta(seconds=s)) for i, s in enumerate((0, 1.5, 3, 4.5, 5.2, 60, 61.9, 62))]
    df = spark.createDataFrame(rows, "user long, scene string, action string, note long, request long, event_id long, ts timestamp")
    assert sorted(r.event_id for r in behaviour.gap_deduplicated(df, 2).collect()) == [0, 2, 4, 5, 7]
    other = df.withColumn("query", F.when(F.col("event_id") == 1, "x" * 80 + "y").otherwise("x" * 80)).withColumn("page_time", F.lit(1.02) + F.col("event_id") * 0.0)
    assert sorted(r.event_id for r in behaviour.gap_deduplicated(other, 2).collect()) == [0, 2, 4, 5, 7]
    liked = df.withColumn("like", (F.col("event_id") == 1).cast("int"))
    assert sorted(r.event_id for r in behaviour.gap_deduplicated(liked, 2).collect()) == [0, 1, 2, 4, 5, 7]


def test_deletion_takes_the_newest_match(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, "rec", 5, r, i, start + dt.timedelta(seconds=i)) for i, r in enumerate((9, 8, 8))] + [(1, "rec", 6, 1, 10, start), (2, "rec", 5, 9, 11, start)]
    df = spark.createDataFrame(rows, "user long, scene string, note long, request long, event_id long, ts timestamp")
    ask = lambda *a: spark.createDataFrame([a], "user long, scene string, note long, ts timestamp, request long")
    kept, gone = behaviour.deleted(df, ask(1, "rec", 5, None, None))
    assert sorted(r.event_id for r in kept.collect()) == [0, 1, 10, 11] and gone.count() == 0
    kept, gone = behaviour.deleted(df, ask(1, "rec", 5, None, 9))
    assert sorted(r.event_id for r in kept.collect()) == [1, 2, 10, 11] and [tuple(r) for r in gone.collect()] == [(1, "rec", 5)]
    kept, gone = behaviour.deleted(df, ask(1, "rec", 6, start, 1))
    assert sorted(r.event_id for r in kept.collect()) == [0, 1, 2, 11] and gone.count() == 1
    kept, gone = behaviour.deleted(df, ask(1, "rec", 7, None, None))
    assert kept.count() == 5 and gone.count() == 0


def test_deletion_does_not_depend_on_the_order_of_what_is_asked(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(u, "rec", 5, 0, 2 * u + j, start + dt.timedelta(seconds=j)) for u in range(200) for j in range(1 + u % 2)]
    df = spark.createDataFrame(rows, "user long, scene string, note long, request long, event_id long, ts timestamp")
    turned = lambda batches: (b.sample(frac=1) for b in batches)  # noqa: E731 (another order at each reading)
    asked = df.select("user", "scene", "note").distinct().withColumns({"ts": F.lit(None).cast("timestamp"), "request": F.lit(None).cast("long")})
    kept, gone = behaviour.deleted(df, asked.coalesce(1).mapInPandas(turned, asked.schema))
    assert sorted(r.event_id for r in kept.collect()) == [2 * u for u in range(1, 200, 2)]
    assert sorted(r.user for r in gone.collect()) == list(range(0, 200, 2))


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    schema = "user long, scene string, action string, ts timestamp"
    start = dt.datetime(2024, 1, 1)
    for i, minutes in enumerate(((0, 1), (120,), (121,), (122,), (2, 119), (240,))):
        spark.createDataFrame([(1, "rec", "click", start + dt.timedelta(minutes=m)) for m in minutes], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = behaviour.windowed_counts(stream, "1 hour").writeStream.format("memory").queryName("late").outputMode("update").start()
    try:
        q.processAllAvailable()
        found = {(r.window.start.hour, r.n) for r in spark.sql("select * from late").collect()}
    finally:
        q.stop()
    assert (0, 2) in found and (0, 3) not in found and (1, 1) in found


def test_images_below_their_folder(spark):
    paths = {" /image/a.jpg": "a.jpg", "b/c.jpg": "b/c.jpg", "../x": None, "a/../../x": None, "": None, "//image/d..e.jpg": "d..e.jpg"}
    assert {p: one(spark, files.image_path(F.lit(p))) for p in paths} == paths


def test_only_what_is_asked_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id as request", "id % 7 as rank", "id as a", "id as b").write.parquet(str(tmp_path / "t"))
    found = files.ranked_rows(spark, str(tmp_path / "t"), "request", 5, 10, ["request", "rank"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<request:bigint,rank:bigint>" in plan and "EqualTo(request,5)" in plan and files.columns_of(spark, str(tmp_path / "t")) == ["request", "rank", "a", "b"]


def test_external_negatives(spark):
    rows = spark.createDataFrame([(1, 1, [9]), (2, 1, [9]), (3, 1, None)], "request long, item long, hard_negatives array<long>")
    mined = spark.createDataFrame([(1, [5, 6]), (2, []), (3, [])], "request long, hard_negatives array<long>")
    assert {r.request: r.hard_negatives for r in training.with_external(rows, mined).collect()} == {1: [5, 6], 2: [9], 3: []}
    assert training.negative_mode(rows, "auto") == ("hard", "hard_negatives") and training.negative_mode(rows.where("request = 3"), "hard") == ("easy", "hard_negatives")
    assert training.negative_mode(rows.drop("hard_negatives"), "auto") == ("easy", None)


def test_plans_have_no_cartesian_product_and_no_window_over_all_rows(spark):
    import __spark_entry__

    for name in ("vector_top_k", "item_vector_recall", "metric_bundle", "discretized_relevance", "vocabulary_codes", "swing_index", "usercf_recall"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_suggestions_do_not_broadcast_exploded_keys(spark, tmp_path):
    """Their rows are many times those of the catalogue, whose size is all that Spark knows."""
    rows = [("red shoes", 5), ("red hat", 2), ("old red shoes", 1), ("blue hat", 4)]
    spark.createDataFrame(rows, "query string, n long").write.parquet(str(tmp_path / "counted"))
    counted = spark.read.parquet(str(tmp_path / "counted"))
    found = serving.suggestions(counted.where("n = 5").select(F.substring("query", 1, 4).alias("typed")), counted, 12)
    assert "Join [key#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin [key#" not in plan
    assert [r.query for r in found.orderBy("rank").collect()] == ["red shoes", "red hat", "old red shoes"]
