"""The dataflow on a hand-made corpus with known results, and its parts on edge cases."""

import pytest
from pyspark.sql import functions as F

from pathkin.functions.stemming import porter_stem
from pathkin.operators import evaluate, extract, parse, similarity, stats, testset
from pathkin.plans.pipeline import build, run_pipeline
from pathkin.sources.tsv import object_path, read_keyed_value, read_tsv, write_tsv

LINES = """causes	Smoking/NN/nsubj/2 causes/VBZ/ROOT/0 cancer/NN/dobj/2	10	1990,10
causes	stress/NN/nsubj/2 causes/VBZ/ROOT/0 headaches/NNS/dobj/2	4	1990,4
treated	headaches/NNS/nsubjpass/3 are/VBP/auxpass/3 treated/VBN/ROOT/0 with/IN/prep/3 aspirin/NN/pobj/4	6	1991,6
controlled	cancer/NN/nsubjpass/2 controlled/VBN/ROOT/0 with/IN/prep/2 aspirin/NN/pobj/3	3	1992,3
controlled	stress/NN/nsubjpass/2 controlled/VBN/ROOT/0 with/IN/prep/2 Exercise/NN/pobj/3	5	1992,5
treated	stress/NN/nsubjpass/2 treated/VBN/ROOT/0 with/IN/prep/2 exercise/NN/pobj/3	2	1993,2
with	with/IN/prep/2 treated/VBN/ROOT/0 patients/NNS/dobj/2 drugs/NNS/pobj/1	7	1994,7
is	cancer/NN/nsubj/2 is/VBZ/ROOT/0 disease/NN/attr/2	50	1995,50
having	patients/NNS/nsubj/2 having/VBG/ROOT/0 cancer/NN/dobj/2	8	1996,8
cat	cat/NN/nn/2 food/NN/ROOT/0	9	1997,9
a	x/NN/nsubj/0 causes/VBZ/ROOT/0 y/NN/dobj/2	9	1997,9
bad	1/2/CD/num/2 causes/VBZ/ROOT/0 y/NN/dobj/2	9	1997,9
bad	x/NN/nsubj/2 causes/VBZ/ROOT/0 y/NN/dobj/2	NaNcount
short	x/NN/nsubj/2
controlled	headaches/NNS/nsubjpass/2 controlled/VBN/ROOT/0 with/IN/prep/2 aspirin/NN/pobj/3	4	1999,4
gave	doctor/NN/nsubj/2 gave/VBD/ROOT/0 patients/NNS/iobj/2 aspirin/NN/dobj/2	3	1999,3""".split("\n")

MI = {
    ("X caus Y", "X", "smoking"): (10, 1.4213856809), ("X caus Y", "X", "stress"): (4, 0.4097847693), ("X caus Y", "Y", "cancer"): (10, 0.8335990160), ("X caus Y", "Y", "headaches"): (4, 1.4213856809),
    ("X control with Y", "X", "cancer"): (3, 1.5755363608), ("X control with Y", "X", "headaches"): (4, 0.6592456289), ("X control with Y", "X", "stress"): (5, 0.7870790004),
    ("X control with Y", "Y", "aspirin"): (7, 0.5770075306), ("X control with Y", "Y", "exercise"): (5, 1.2390641241), ("X gave Y", "X", "doctor"): (6, 1.8632184332), ("X gave Y", "X", "patients"): (3, 0.5639354491),
    ("X gave Y", "Y", "aspirin"): (6, 0.7105389233), ("X gave Y", "Y", "patients"): (3, 0.6592456289), ("X have Y", "X", "patients"): (8, 1.6625477377), ("X have Y", "Y", "cancer"): (8, 1.1700712527),
    ("X treat with Y", "X", "drugs"): (7, 1.3523928094), ("X treat with Y", "X", "headaches"): (6, 0.8415671857), ("X treat with Y", "X", "stress"): (2, -0.3523552828), ("X treat with Y", "Y", "aspirin"): (6, 0.1997132995),
    ("X treat with Y", "Y", "exercise"): (2, 0.0996298409), ("X treat with Y", "Y", "patients"): (7, 0.9957178655),
}
SIMILAR = {
    ("X caus Y", "X caus Y"): 0.28762082, ("X caus Y", "X control with Y"): 0, ("X caus Y", "X have Y"): 0, ("X control with Y", "X control with Y"): 0.69182404, ("X control with Y", "X gave Y"): 0,
    ("X control with Y", "X treat with Y"): 0.88464785, ("X gave Y", "X gave Y"): 0.48202109, ("X gave Y", "X have Y"): 0, ("X gave Y", "X treat with Y"): 0, ("X have Y", "X have Y"): 1, ("X treat with Y", "X treat with Y"): 0.61934130,
}
STEMS = """associate associ characterize character confuse confus derive deriv destroy destroi differ differ include includ indicate indic produce produc resemble resembl substitute substitut use us have have
die die get get convert convert caused caus controlled control treated treat destroyed destroi provides provid using us carries carri having have doing do died di dying dy given given matting mat mating mate
agreed agre feed feed relational relat generalization gener geology geologi possibly possibl sky sky ties ti as as be be""".split()


def frame(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


@pytest.fixture(scope="module")
def mi(spark):
    return stats.mutual_information(extract.extract_triples(parse.valid_records(parse.parse_lines(frame(spark, LINES))))).cache()


def test_stems():
    assert {a: porter_stem(a) for a in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))
    assert porter_stem(None) is None and porter_stem("") == ""


def test_mutual_information_of_the_hand_corpus(mi):
    assert {(r.p, r.slot, r.w): (r.c, float(r.mi)) for r in mi.collect()} == MI


def test_triples_by_verb_form_are_the_sums_of_events(spark):
    records = parse.valid_records(parse.parse_lines(frame(spark, LINES)))
    a = stats.triple_counts(extract.extract_events(records)).collect()
    assert {(*r,) for r in a} == {(*r,) for r in extract.extract_triples(records).collect()}


def test_marginals_add_up(spark, mi):
    rows = stats.marginals(mi.select("p", "slot", "w", "c")).collect()
    for slot in "XY":
        assert {kind: sum(r.n for r in rows if r.slot == slot and r.kind == kind) for kind in ("PS", "SW", "S")} == {"PS": 58, "SW": 58, "S": 58}


def every_pair(spark):
    names = sorted({k[0] for k in MI})
    return spark.createDataFrame([(a, b, "POS") for i, a in enumerate(names) for b in names[i:]], "p1 string, p2 string, label string")


def test_similarity_of_the_hand_corpus(spark, mi):
    pairs = every_pair(spark)
    found = similarity.similarity(similarity.numerators(mi, pairs), stats.denominators(mi)).collect()
    assert {(r.p1, r.p2): pytest.approx(r.s, abs=1e-8) for r in found} == SIMILAR
    single = similarity.similarity(similarity.numerators(mi, pairs, "single"), stats.denominators(mi)).collect()
    assert all(r.s <= 1 + 1e-12 for r in single), single
    with pytest.raises(ValueError):
        similarity.numerators(mi, pairs, "other")


def test_results_do_not_depend_on_partitions(spark):
    a = build(frame(spark, LINES).repartition(7), every_pair(spark)).similarity.select("p1", "p2", "s").collect()
    b = build(frame(spark, LINES[::-1]).coalesce(1), every_pair(spark)).similarity.select("p1", "p2", "s").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize(
    "line, reason",
    [
        ("", "blank"), (" \t ", "blank"), ("short\tx/NN/nsubj/2", "fields"), ("a\tx/NN/nsubj/0 \t+5", None), ("a\t x/NN/nsubj/0\t5", "token"), ("a\tx/NN/nsubj/0\t5.0", "count"), ("a\tx/NN/nsubj/0\t 5 \tz", "count"),
        ("a\t/NN/nsubj/0\t5", None), ("a\tx/NN/nsubj/2\t5", "head"), ("a\tx/NN/nsubj/-1\t5", "head"), ("a\t1/2/CD/num/0\t5", "token"), ("a\tx/NN/nsubj/0\t99999999999999999999", "count"), (None, "blank"),
    ],
)
def test_line_policy(spark, line, reason):
    assert parse.parse_lines(frame(spark, [line])).first().reason == reason


def shortest(heads, start, goal):
    """Breadth-first search in token order."""
    around = {}
    for i, h in enumerate(heads, 1):
        if h:
            around.setdefault(i, []).append(h)
            around.setdefault(h, []).append(i)
    paths, queue = {start: [start]}, [start]
    for here in queue:
        for there in around.get(here, []):
            if there not in paths:
                paths[there] = [*paths[here], there]
                queue.append(there)
    return paths.get(goal)


def test_paths_equal_breadth_first_search(spark):
    import random

    r = random.Random(4)
    cases = [[r.randint(0, n) for _ in range(n)] for n in range(2, 9) for _ in range(25)]
    lines = [f"w\t{' '.join(f'w{i}/NN/x/{h}' for i, h in enumerate(heads))}\t1\t{k}" for k, heads in enumerate(cases)]
    df = frame(spark, lines).withColumn("k", F.element_at(F.split("value", "\t"), -1).cast("int"))
    rows = extract.dependency_paths(extract.noun_pairs(parse.valid_records(parse.parse_lines(df)))).select("k", "n1.id", F.col("n2.id").alias("to"), "path").collect()
    assert len(rows) == sum(len(h) * (len(h) - 1) // 2 for h in cases)
    wrong = [(cases[x.k], x.id, x.to, x.path) for x in rows if x.path != shortest(cases[x.k], x.id, x.to)]
    assert not wrong


def test_templates_and_pairs(spark, tmp_path):
    rows = [("Y resemble X", "X resembl Y"), ("X  confuse   with Y", "X confus with Y"), ("X use In Y", "X us in Y"), ("X be", None), ("X give rise to Y", "X give rise Y"), (None, None), ("", None)]
    df = testset.normalise_templates(spark.createDataFrame(rows, "t string, want string"), "t", "got").collect()
    assert [r.got for r in df if r.got != r.want] == []
    (tmp_path / "positive.txt").write_text("X use Y\tX cause Y\textra\n\nX be\tX cause Y\nlonely\nX use Y\tX get Y\n")
    (tmp_path / "negative.txt").write_text("Y cause X\tX use Y\n")
    pairs = testset.load_test_pairs(spark, [str(tmp_path / "positive.txt"), str(tmp_path / "negative.txt")]).collect()
    assert {(r.p1, r.p2): r.label for r in pairs} == {("X caus Y", "X us Y"): "NEG", ("X get Y", "X us Y"): "POS"}
    (tmp_path / "empty-positive.txt").write_text("\n")
    with pytest.raises(ValueError):
        testset.load_test_pairs(spark, [str(tmp_path / "empty-positive.txt")])


def test_strict_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿X use Y\tX get Y\n# note\n\nX do Y\tX be Y\tmore\n", encoding="utf-8")
    assert [(r.left_raw, r.right_raw, r.label) for r in testset.read_strict(spark, str(tmp_path / "a.txt"), 1).collect()] == [("X use Y", "X get Y", 1), ("X do Y", "X be Y", 1)]
    (tmp_path / "b.txt").write_text("X use Y\tX get Y\nbroken\n")
    with pytest.raises(Exception, match="b.txt:2"):
        testset.read_strict(spark, str(tmp_path / "b.txt"), 1).collect()


def test_evaluation(spark):
    rows = [("a", "b", "POS", 0.9), ("a", "c", "NEG", 0.8), ("a", "d", "POS", 0.8), ("b", "c", "NEG", 0.1), ("b", "d", "POS", 0.05), ("c", "d", "UNK", 0.5)]
    scored = spark.createDataFrame(rows, "p1 string, p2 string, label string, s double")
    swept = {r.t: (r.tp, r.fp, r.tn, r.fn) for r in evaluate.threshold_sweep(scored).collect()}
    assert swept == {0.9: (1, 0, 2, 2), 0.8: (2, 1, 1, 1), 0.1: (2, 2, 0, 1), 0.05: (3, 2, 0, 0)}
    one = evaluate.confusion_matrix(scored, 0.8).first()
    assert (one.tp, one.fp, one.tn, one.fn) == (2, 1, 1, 1) and one.f1 == pytest.approx(2 / 3)
    assert evaluate.best_threshold(evaluate.threshold_sweep(scored), 1).first().t == 0.8
    assert [(r.outcome, r.p1, r.p2) for r in evaluate.error_samples(scored, 0.8, 1).orderBy("outcome").collect()] == [("FN", "b", "d"), ("FP", "a", "c"), ("TN", "b", "c"), ("TP", "a", "d")]


def test_tsv_and_pipeline(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus/a.txt").write_text("\n".join(LINES))
    (tmp_path / "positive.txt").write_text("X control with Y\tX treat with Y\nX cause Y\tX have Y\n")
    (tmp_path / "negative.txt").write_text("X have Y\tX have Y\n")
    out = str(tmp_path / "out")
    run_pipeline(spark, str(tmp_path / "corpus"), str(tmp_path / "positive.txt"), str(tmp_path / "negative.txt"), out)
    got = read_tsv(spark, out, "p1 string, p2 string, label string, s double").collect()
    assert [(r.p1, r.p2, r.label, round(r.s, 6)) for r in sorted(got)] == [("X caus Y", "X have Y", "POS", 0.0), ("X control with Y", "X treat with Y", "POS", 0.884648), ("X have Y", "X have Y", "NEG", 1.0)]
    with pytest.raises(Exception):
        write_tsv(spark.range(1), out)
    (tmp_path / "t.txt").write_text("a\tX\t1.5\nbad\t1\na\tX\tq\n")
    assert [(*r,) for r in read_keyed_value(spark, str(tmp_path / "t.txt"), ["p", "slot"], "denom").collect()] == [("a", "X", 1.5)]
    assert object_path("/a/b/", "c/") == "s3://c/a/b" and object_path("s3://c/d") == "s3://c/d"


def test_streaming_counts(spark, tmp_path):
    from pathkin.streaming.events import stream_verb_counts, triples_of

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(LINES[:8]))
    query = stream_verb_counts(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("verb_counts").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        (tmp_path / "in/b.txt").write_text("\n".join(LINES[8:]))
        query.processAllAvailable()
        got = {(r.p, r.slot, r.w): r.c for r in triples_of(spark.table("verb_counts")).collect()}
    finally:
        query.stop()
    assert got == {k: v[0] for k, v in MI.items()}


@pytest.mark.parametrize("t, counts, rates", [(0.0264642943, (930, 42, 5, 126), (0.956790, 0.880682, 0.917160)), (0.0823973854, (965, 42, 6, 104), (0.958292, 0.902713, 0.929672))])
def test_published_counts_give_the_published_rates(spark, t, counts, rates):
    rows = [(f"a{k}", f"b{k}", label, s) for n, label, s in zip(counts, ("POS", "NEG", "NEG", "POS"), (t + 0.1, t, t / 2, 0.0)) for k in range(n)]
    got = evaluate.confusion_matrix(spark.createDataFrame(rows, "p1 string, p2 string, label string, s double"), t).first()
    assert (got.tp, got.fp, got.tn, got.fn) == counts and (got.precision, got.recall, got.f1) == pytest.approx(rates, abs=1e-6)


def test_runs_over_nothing_are_errors(spark, tmp_path):
    (tmp_path / "positive.txt").write_text("X cause Y\tX have Y\n")
    (tmp_path / "negative.txt").write_text("X use Y\tX have Y\n")
    run = lambda corpus: run_pipeline(spark, str(corpus), str(tmp_path / "positive.txt"), str(tmp_path / "negative.txt"), str(tmp_path / "out"))
    (tmp_path / "empty").write_text("head\tonly\n")
    with pytest.raises(ValueError, match="no PS, SW, S marginals"):
        run(tmp_path / "empty")
    (tmp_path / "single").write_text("causes\ta/NN/nsubj/2 causes/VBZ/ROOT/0 b/NN/dobj/2\t3\n")  # information is 0 everywhere
    with pytest.raises(ValueError, match="positive information"):
        run(tmp_path / "single")


def test_first_pairs_follow_the_lists(spark, tmp_path):
    (tmp_path / "negative.txt").write_text("X a Y\tX b Y\nX c Y\tX d Y\n")
    (tmp_path / "positive.txt").write_text("X z Y\tX y Y\n\nX m Y\tX n Y\n")
    pairs = testset.read_pairs(spark, [str(tmp_path / "positive.txt"), str(tmp_path / "negative.txt")])
    assert [(r.left_raw, r.label) for r in testset.first_pairs(pairs, 3).collect()] == [("X z Y", "POS"), ("X m Y", "POS"), ("X a Y", "NEG")]


def test_sweep_in_ranges_equals_counting(spark):
    import random

    r = random.Random(1)
    rows = [(f"p{k}", f"q{k}", r.choice(("POS", "NEG", "UNK")), round(r.random() * 1.3, 3)) for k in range(900)]
    scored = spark.createDataFrame(rows, "p1 string, p2 string, label string, s double")
    known = [(label, s) for _, _, label, s in rows if label != "UNK"]
    for steps in (1, 7, 4096):
        for row in evaluate.threshold_sweep(scored, steps).collect():
            want = [sum(label == one and (s >= row.t) == hit for label, s in known) for one, hit in (("POS", True), ("NEG", True), ("NEG", False), ("POS", False))]
            assert [row.tp, row.fp, row.tn, row.fn] == want
