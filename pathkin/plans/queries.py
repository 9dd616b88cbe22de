"""Queries over the generated corpus, each with independent DuckDB SQL that derives its rows from the relational tables without parsing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stemming import stem_table
from ..operators import evaluate, extract, parse, similarity, stats, testset
from ..sources import generated
from ..session import durable, shared_dir, write_text
from ..sources.tsv import read_keyed_value, read_lines, read_tsv, write_tsv
from .pipeline import build, run_pipeline, volumes


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_lines(generated.corpus_lines(spark, sf))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return parse.valid_records(_parsed(spark, sf))


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    return durable(extract.extract_triples(_records(spark, sf)), "triples")


def _mi(spark: SparkSession, sf: str) -> DataFrame:
    return durable(stats.mutual_information(_triples(spark, sf)), "information")


def _pairs(spark: SparkSession) -> DataFrame:
    return testset.canonical_pairs(generated.test_pairs(spark))


def _scored(mi: DataFrame, pairs: DataFrame) -> DataFrame:
    found = similarity.similarity(similarity.numerators(mi, pairs), stats.denominators(mi))
    return similarity.labelled(found, pairs)


def _every_pair(mi: DataFrame) -> DataFrame:
    """Pairs to evaluate, linear in the number of predicates: POS, those of the same verb; NEG, each with the next ten of its prepositions (or of none) in order of verbs."""
    named = stats.positive(mi).select("p").distinct().withColumn("_t", F.split("p", " ")).select("p", F.get("_t", F.lit(1)).alias("verb"), F.when(F.size("_t") > 3, F.get("_t", F.lit(2))).otherwise("").alias("prep"))
    same = named.select("verb", F.col("p").alias("p1")).join(named.select("verb", F.col("p").alias("p2")), "verb").filter("p1 <= p2").select("p1", "p2", F.lit("POS").alias("label"))
    after = F.collect_list("p").over(Window.partitionBy("prep").orderBy("verb").rowsBetween(1, 10))
    other = named.withColumn("o", after).select("p", F.explode("o").alias("o")).select(F.least("p", "o").alias("p1"), F.greatest("p", "o").alias("p2"), F.lit("NEG").alias("label"))
    return same.unionByName(other)


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    mi = _mi(spark, sf)
    return _scored(mi, _every_pair(mi)).select("p1", "p2", "label", F.round("s", 6).alias("s"))


def corpus_parse_tokens(spark, sf):
    return _records(spark, sf).select("l_orderkey", "l_linenumber", F.explode("toks").alias("t"), "count").select("l_orderkey", "l_linenumber", "t.*", "count")


def corpus_rejects(spark, sf):
    return parse.rejected_lines(_parsed(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def pos_class_counts(spark, sf):
    t = F.col("t")
    kind = F.when(extract.is_noun(t), "noun").when(extract.is_verb(t), F.when(extract.is_auxiliary(t), "auxiliary").otherwise("verb")).when(extract.is_preposition(t), "preposition").otherwise("other")
    return _records(spark, sf).select(F.explode("toks").alias("t")).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("tokens"))


def noun_pairs(spark, sf):
    return extract.noun_pairs(_records(spark, sf)).select("l_orderkey", "l_linenumber", F.col("n1.id").alias("id1"), F.col("n2.id").alias("id2"))


def dependency_paths(spark, sf):
    paths = extract.dependency_paths(extract.noun_pairs(_records(spark, sf)))
    return paths.select("l_orderkey", "l_linenumber", F.concat_ws(",", F.transform("path", lambda i: i.cast("string"))).alias("path"))


def predicate_keys(spark, sf):
    return extract.predicate_counts(_records(spark, sf))


def slot_events(spark, sf):
    return extract.event_counts(_records(spark, sf))


def triple_counts(spark, sf):
    return _triples(spark, sf)


def marginals(spark, sf):
    return stats.marginals(_triples(spark, sf))


def mutual_information(spark, sf):
    return _mi(spark, sf).select("p", "slot", "w", "c", F.col("mi").cast("double").alias("mi"))


def denominators(spark, sf):
    return stats.denominators(_mi(spark, sf)).select("p", "slot", F.col("denom").cast("double").alias("denom"))


def shared_features(spark, sf):
    return stats.shared_features(_mi(spark, sf))


def numerators(spark, sf):
    return similarity.numerators(_mi(spark, sf), _pairs(spark)).select("p1", "p2", "slot", F.col("contrib").cast("double").alias("contrib"))


def similarity_(spark, sf):
    mi = _mi(spark, sf)
    found = similarity.similarity(similarity.numerators(mi, _pairs(spark)), stats.denominators(mi))
    return found.select("p1", "p2", *[F.round(c, 6).alias(c) for c in ("sim_x", "sim_y", "s")])


def similarity_labeled(spark, sf):
    return _scored(_mi(spark, sf), _pairs(spark)).select("p1", "p2", "label", F.round("s", 6).alias("s"))


def similarity_sorted(spark, sf):
    return similarity_labeled(spark, sf).orderBy("p1", "p2")


def testset_normalized(spark, sf):
    return _pairs(spark)


def testset_stats(spark, sf):
    return testset.test_set_stats(generated.test_pairs(spark))


def testset_sample(spark, sf):
    return testset.first_pairs(generated.test_pairs(spark)).select("left_raw", "right_raw", "label")


def stage_volumes(spark, sf):
    return volumes(build(generated.corpus_lines(spark, sf), _pairs(spark)))


def stem_verbs(spark, sf):
    return stem_table(generated.base_rows(spark, sf), "verb")


def threshold_sweep(spark, sf):
    rates = ("precision", "recall", "f1")
    return evaluate.threshold_sweep(_evaluated(spark, sf)).select("t", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in rates])


#: Threshold of the evaluation queries below.
T = 0.5


def confusion_matrix(spark, sf):
    rates = ("precision", "recall", "f1")
    return evaluate.confusion_matrix(_evaluated(spark, sf), T).select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in rates])


def error_samples(spark, sf):
    return evaluate.error_samples(_evaluated(spark, sf), T)


def run_comparison(spark, sf):
    """The corpus is parsed once, for the run on its finished part and that on the whole."""
    pairs, records = _pairs(spark), durable(_records(spark, sf), "records")
    run = lambda rows: _scored(durable(stats.mutual_information(durable(extract.extract_triples(rows), "triples")), "information"), pairs)
    return evaluate.run_comparison(run(records.filter("status = 'F'")), run(records)).select("p1", "p2", "label", F.round("s_small", 6).alias("s_small"), F.round("s_large", 6).alias("s_large"))


def tsv_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/tsv-{uuid.uuid4().hex}"
    write_tsv(_triples(spark, sf), path, ["p", "slot", "w", "c"])
    one = read_tsv(spark, path, "p string, slot string, w string, c bigint").select("slot", "c", F.lit("typed").alias("reader"))
    two = read_keyed_value(spark, path, ["p", "slot", "w"], "c").select("slot", F.col("c").cast("bigint").alias("c"), F.lit("keyed").alias("reader"))
    return one.unionByName(two).groupBy("reader", "slot").agg(F.count(F.lit(1)).alias("triples"), F.sum("c").alias("total"))


def _hard_files(spark: SparkSession, sf: str) -> str:
    """A folder with the hard records as corpus files and two test files; returns its path."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    generated.hard_lines(spark, sf).select("value").write.text(f"{path}/corpus")
    for name, lines in HARD_TESTS.items():
        write_text(spark, f"{path}/{name}", "".join(f"{line}\n" for line in lines))
    return path


#: Test files as users write them: blank lines, lines of one column, columns beyond two, a pair that both lists name.
HARD_TESTS = {
    "positive-preds.txt": ["X cause Y\tX use Y", "", "X treats with Y\tX treat IN Y", "X gave Y", "X gave  Y\tX have Y\tmore", "X gave Y\tX gave Y", "X cause\tX use Y"],
    "negative-preds.txt": ["X gave Y\tX caused Y", "X using Y\tX causes Y", " ", "X heal Y\tX gave Y"],
    "strict-preds.txt": ["# pairs", "X cause Y\tX use Y", "", " X gave Y \t X have Y \tmore"],
}


def _hard_mi(spark: SparkSession, sf: str) -> DataFrame:
    records = parse.valid_records(parse.parse_lines(generated.hard_lines(spark, sf)))
    return durable(stats.mutual_information(durable(extract.extract_triples(records), "triples")), "information")


def hard_rejects(spark, sf):
    lines = read_lines(spark, f"{_hard_files(spark, sf)}/corpus")
    return parse.parse_lines(lines).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


def hard_paths(spark, sf):
    paths = extract.dependency_paths(extract.noun_pairs(parse.valid_records(parse.parse_lines(generated.hard_lines(spark, sf)))))
    path = F.coalesce(F.array_join(F.transform("path", lambda i: i.cast("string")), ","), F.lit("none"))
    return paths.select("kind", "nation", F.col("n1.id").alias("id1"), F.col("n2.id").alias("id2"), path.alias("path"))


def hard_events(spark, sf):
    lines = read_lines(spark, f"{_hard_files(spark, sf)}/corpus")
    events = extract.extract_events(parse.valid_records(parse.parse_lines(lines)))
    return events.groupBy("p", "slot", "w", "c").agg(F.count(F.lit(1)).alias("events"))


def hard_information(spark, sf):
    return _hard_mi(spark, sf).select("p", "slot", "w", "c", F.col("mi").cast("double").alias("mi"))


def hard_unlabelled(spark, sf):
    """Pairs of the negative file are looked for, but have no label."""
    mi, path = _hard_mi(spark, sf), _hard_files(spark, sf)
    pairs = testset.load_test_pairs(spark, [f"{path}/positive-preds.txt", f"{path}/negative-preds.txt"])
    found = similarity.similarity(similarity.numerators(mi, pairs), stats.denominators(mi))
    return similarity.labelled(found, pairs.filter("label = 'POS'")).select("p1", "p2", "label", F.round("s", 6).alias("s"))


def file_pairs(spark, sf):
    path = _hard_files(spark, sf)
    return testset.read_pairs(spark, [f"{path}/positive-preds.txt", f"{path}/negative-preds.txt"]).select("left_raw", "right_raw", "label", "precedence")


def file_pairs_strict(spark, sf):
    return testset.read_strict(spark, f"{_hard_files(spark, sf)}/strict-preds.txt", 1)


def file_run(spark, sf):
    """The launcher, from corpus and test files to its output, which is read again."""
    path = _hard_files(spark, sf)
    run_pipeline(spark, f"{path}/corpus", f"{path}/positive-preds.txt", f"{path}/negative-preds.txt", f"{path}/out")
    return read_tsv(spark, f"{path}/out", "p1 string, p2 string, label string, s double").withColumn("s", F.round("s", 6))


QUERIES = {
    f.__name__.rstrip("_"): f
    for f in (
        corpus_parse_tokens, corpus_rejects, pos_class_counts, noun_pairs, dependency_paths, predicate_keys, slot_events, triple_counts, marginals, mutual_information, denominators,
        shared_features, numerators, similarity_, similarity_labeled, testset_normalized, testset_stats, testset_sample, stage_volumes, stem_verbs, threshold_sweep, confusion_matrix, error_samples, run_comparison, similarity_sorted, tsv_roundtrip,
        hard_rejects, hard_paths, hard_events, hard_information, hard_unlabelled, file_pairs, file_pairs_strict, file_run,
    )
}

# ---- SQL ----
_BASE = """
stems(verb, stem) AS (VALUES ('caused','caus'), ('controlled','control'), ('treated','treat'), ('destroyed','destroi'), ('provides','provid'), ('using','us'), ('carries','carri')),
base AS (
  SELECT l_orderkey, l_linenumber, o_orderstatus AS status, (l_orderkey + l_linenumber) % 8 AS kind, p_brand AS brand, c_mktsegment || '-' || p_size AS seg,
    ['caused','controlled','treated','destroyed','provides','using','carries'][l_suppkey % 7 + 1] AS verb,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'with' WHEN '2-HIGH' THEN 'by' WHEN '3-MEDIUM' THEN 'for' WHEN '4-NOT SPECIFIED' THEN 'in' ELSE 'to' END AS prep,
    CAST(l_quantity AS BIGINT) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
)"""
_EVENTS = """
ev AS (
  SELECT 'X ' || stem || CASE WHEN kind <= 2 THEN '' ELSE ' ' || prep END || ' Y' AS p, lower(brand) AS x, lower(seg) AS y, n AS c, status
  FROM base JOIN stems USING (verb) WHERE kind <= 5
),
events AS (SELECT p, 'X' AS slot, x AS w, c, status FROM ev UNION ALL SELECT p, 'Y', y, c, status FROM ev)"""


def _stages(source: str = "events", tag: str = "") -> str:
    return f"""
triples{tag} AS (SELECT p, slot, w, CAST(sum(c) AS BIGINT) AS c FROM {source} GROUP BY ALL),
mi{tag} AS (
  SELECT p, slot, w, c, CAST(round(ln(c::DOUBLE * s::DOUBLE / (ps::DOUBLE * sw::DOUBLE)), 10) AS DECIMAL(28, 10)) AS mi FROM (
    SELECT *, sum(c) OVER (PARTITION BY p, slot) AS ps, sum(c) OVER (PARTITION BY slot, w) AS sw, sum(c) OVER (PARTITION BY slot) AS s FROM triples{tag})
),
pos{tag} AS (SELECT * FROM mi{tag} WHERE mi > 0),
den{tag} AS (SELECT p, slot, sum(mi) AS denom FROM pos{tag} GROUP BY ALL),
feat{tag} AS (SELECT slot, w, count(*) AS predicates FROM pos{tag} GROUP BY ALL HAVING count(*) >= 2)"""


def _similar(pairs: str = "pairs", tag: str = "") -> str:
    return f"""
num{tag} AS (
  SELECT t.p1, t.p2, slot, sum((a.mi + b.mi) * CASE WHEN t.p1 = t.p2 THEN 1 ELSE 2 END) AS contrib
  FROM {pairs} t JOIN pos{tag} a ON a.p = t.p1 JOIN pos{tag} b USING (slot, w) JOIN feat{tag} USING (slot, w) WHERE b.p = t.p2 GROUP BY ALL
),
wide{tag} AS (SELECT p, sum(denom) FILTER (slot = 'X') AS dx, sum(denom) FILTER (slot = 'Y') AS dy FROM den{tag} GROUP BY p),
sums{tag} AS (SELECT p1, p2, coalesce(sum(contrib) FILTER (slot = 'X'), 0) AS nx, coalesce(sum(contrib) FILTER (slot = 'Y'), 0) AS ny FROM num{tag} GROUP BY ALL),
sim{tag} AS (
  SELECT p1, p2, label, sim_x, sim_y, sqrt(sim_x * sim_y) AS s FROM (
    SELECT m.p1, m.p2, label, nx::DOUBLE / (a.dx + b.dx)::DOUBLE AS sim_x, ny::DOUBLE / (a.dy + b.dy)::DOUBLE AS sim_y
    FROM sums{tag} m JOIN {pairs} t USING (p1, p2) JOIN wide{tag} a ON a.p = m.p1 JOIN wide{tag} b ON b.p = m.p2
    WHERE a.dx IS NOT NULL AND a.dy IS NOT NULL AND b.dx IS NOT NULL AND b.dy IS NOT NULL)
)"""


_PAIRS = """
raw(l, r, label) AS (VALUES
  ('X caus Y','X control Y','POS'), ('X treat with Y','X control with Y','POS'), ('X destroi Y','X us Y','POS'), ('X provid Y','X carri Y','POS'), ('X us in Y','X carri in Y','POS'),
  ('X treat Y','X treat Y','POS'), ('X caus by Y','X caus for Y','POS'), ('X be Y','X caus Y','POS'), ('X us to Y','X provid to Y','POS'), ('X caus Y','X treat Y','NEG'),
  ('X control Y','X caus Y','NEG'), ('X carri to Y','X us to Y','NEG'), ('X provid for Y','X destroi with Y','NEG'), ('X control Y','X carri Y','NEG'), ('X treat with Y','X give Y','NEG')),
pairs AS (SELECT least(l, r) AS p1, greatest(l, r) AS p2, min(label) AS label FROM raw GROUP BY ALL)"""
_ALL_PAIRS = """
named AS (SELECT DISTINCT p, split_part(p, ' ', 2) AS verb, CASE WHEN len(string_split(p, ' ')) > 3 THEN split_part(p, ' ', 3) ELSE '' END AS prep FROM pos),
every AS (
  SELECT a.p AS p1, b.p AS p2, 'POS' AS label FROM named a JOIN named b USING (verb) WHERE a.p <= b.p
  UNION ALL SELECT least(a.p, b.p), greatest(a.p, b.p), 'NEG' FROM (SELECT *, row_number() OVER (PARTITION BY prep ORDER BY verb) AS k FROM named) a JOIN (SELECT *, row_number() OVER (PARTITION BY prep ORDER BY verb) AS k FROM named) b ON a.prep = b.prep AND b.k BETWEEN a.k + 1 AND a.k + 10)"""

_CORPUS = f"WITH {_BASE}"
_COUNTED = f"WITH {_BASE}, {_EVENTS}, {_stages()}"
_SIMILAR = f"{_COUNTED}, {_PAIRS}, {_similar()}"
_EVALUATED = f"{_COUNTED}, {_ALL_PAIRS}, {_similar('every')}, sc AS (SELECT p1, p2, label, round(s, 6) AS s FROM sim)"
_RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1"""
_TOKENS = """
tok AS (
  SELECT l_orderkey, l_linenumber, n, unnest(CASE
    WHEN kind <= 2 THEN [{'id': 1, 'word': brand, 'pos': 'NN', 'rel': 'nsubj', 'head': 2}, {'id': 2, 'word': verb, 'pos': 'VBD', 'rel': 'ROOT', 'head': 0}, {'id': 3, 'word': seg, 'pos': 'NN', 'rel': 'dobj', 'head': 2}]
    WHEN kind <= 4 THEN [{'id': 1, 'word': brand, 'pos': 'NN', 'rel': 'nsubjpass', 'head': 2}, {'id': 2, 'word': verb, 'pos': 'VBN', 'rel': 'ROOT', 'head': 0}, {'id': 3, 'word': prep, 'pos': CASE WHEN prep = 'to' THEN 'TO' ELSE 'IN' END, 'rel': 'prep', 'head': 2}, {'id': 4, 'word': seg, 'pos': 'NN', 'rel': 'pobj', 'head': 3}]
    WHEN kind = 5 THEN [{'id': 1, 'word': prep, 'pos': CASE WHEN prep = 'to' THEN 'TO' ELSE 'IN' END, 'rel': 'prep', 'head': 2}, {'id': 2, 'word': verb, 'pos': 'VBN', 'rel': 'ROOT', 'head': 0}, {'id': 3, 'word': seg, 'pos': 'NN', 'rel': 'dobj', 'head': 2}, {'id': 4, 'word': brand, 'pos': 'NN', 'rel': 'pobj', 'head': 1}]
    ELSE [{'id': 1, 'word': brand, 'pos': 'NN', 'rel': 'nsubj', 'head': 2}, {'id': 2, 'word': 'is', 'pos': 'VBZ', 'rel': 'ROOT', 'head': 0}, {'id': 3, 'word': seg, 'pos': 'NN', 'rel': 'attr', 'head': 2}] END) AS t
  FROM base WHERE kind <= 6
)"""

ORACLE_SQL = {
    "corpus_parse_tokens": f"{_CORPUS}, {_TOKENS} SELECT l_orderkey, l_linenumber, t.id AS id, t.word AS word, t.pos AS pos, t.rel AS rel, t.head AS head, n AS count FROM tok",
    "corpus_rejects": f"{_CORPUS} SELECT CASE l_linenumber % 3 WHEN 0 THEN 'token' WHEN 1 THEN 'count' ELSE 'fields' END AS reason, count(*) AS lines FROM base WHERE kind = 7 GROUP BY ALL",
    "pos_class_counts": f"{_CORPUS}, {_TOKENS} SELECT CASE WHEN t.pos = 'NN' THEN 'noun' WHEN t.word = 'is' THEN 'auxiliary' WHEN t.pos LIKE 'VB%' THEN 'verb' WHEN t.pos IN ('IN', 'TO') THEN 'preposition' ELSE 'other' END AS kind, count(*) AS tokens FROM tok GROUP BY ALL",
    "noun_pairs": f"{_CORPUS} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN kind = 5 THEN 3 ELSE 1 END AS INTEGER) AS id1, CAST(CASE WHEN kind IN (3, 4, 5) THEN 4 ELSE 3 END AS INTEGER) AS id2 FROM base WHERE kind <= 6",
    "dependency_paths": f"{_CORPUS} SELECT l_orderkey, l_linenumber, CASE WHEN kind = 5 THEN '3,2,1,4' WHEN kind IN (3, 4) THEN '1,2,3,4' ELSE '1,2,3' END AS path FROM base WHERE kind <= 6",
    "predicate_keys": f"{_CORPUS}, {_EVENTS} SELECT p, count(*) AS pairs FROM ev GROUP BY p",
    "slot_events": f"{_CORPUS}, {_EVENTS} SELECT p, slot, w, c, count(*) AS events FROM events GROUP BY ALL",
    "triple_counts": f"{_COUNTED} SELECT * FROM triples",
    "marginals": f"{_COUNTED} SELECT CASE WHEN grouping(p) = 0 THEN 'PS' WHEN grouping(w) = 0 THEN 'SW' ELSE 'S' END AS kind, p, slot, w, CAST(sum(c) AS BIGINT) AS n FROM triples GROUP BY GROUPING SETS ((p, slot), (slot, w), (slot))",
    "mutual_information": f"{_COUNTED} SELECT p, slot, w, c, mi::DOUBLE AS mi FROM mi",
    "denominators": f"{_COUNTED} SELECT p, slot, denom::DOUBLE AS denom FROM den",
    "shared_features": f"{_COUNTED} SELECT * FROM feat",
    "numerators": f"{_SIMILAR} SELECT p1, p2, slot, contrib::DOUBLE AS contrib FROM num",
    "similarity": f"{_SIMILAR} SELECT p1, p2, round(sim_x, 6) AS sim_x, round(sim_y, 6) AS sim_y, round(s, 6) AS s FROM sim",
    "similarity_labeled": f"{_SIMILAR} SELECT p1, p2, label, round(s, 6) AS s FROM sim",
    "similarity_sorted": f"{_SIMILAR} SELECT p1, p2, label, round(s, 6) AS s FROM sim ORDER BY p1, p2",
    "testset_normalized": f"WITH {_PAIRS} SELECT * FROM pairs",
    "testset_stats": f"""WITH w(l, r, label) AS (VALUES {', '.join(str(p) for p in generated.TEST_PAIRS)})
      SELECT 'pairs' AS measure, count(*) AS n FROM w UNION ALL SELECT 'pairs_' || label, count(*) FROM w GROUP BY label UNION ALL SELECT 'templates', count(*) FROM (SELECT l FROM w UNION SELECT r FROM w)""",
    "testset_sample": f"SELECT * FROM (VALUES {', '.join(str(p) for p in generated.TEST_PAIRS)}) t(left_raw, right_raw, label) LIMIT 5",
    "stage_volumes": f"""{_SIMILAR}, m AS (SELECT p, slot, w, CASE WHEN grouping(p) = 0 THEN 'PS' WHEN grouping(w) = 0 THEN 'SW' ELSE 'S' END AS kind, sum(c) AS n FROM triples GROUP BY GROUPING SETS ((p, slot), (slot, w), (slot))),
      t AS (SELECT 'triples' AS stage, p || chr(9) || slot || chr(9) || w || chr(9) || c AS line FROM triples UNION ALL SELECT 'marginals', concat_ws(chr(9), kind, coalesce(p, ''), slot, coalesce(w, ''), n::VARCHAR) FROM m
      UNION ALL SELECT 'mi', concat_ws(chr(9), p, slot, w, c::VARCHAR, mi::VARCHAR) FROM mi UNION ALL SELECT 'denominators', concat_ws(chr(9), p, slot, denom::VARCHAR) FROM den
      UNION ALL SELECT 'numerators', concat_ws(chr(9), p1, p2, slot, contrib::VARCHAR) FROM num UNION ALL SELECT 'similarity', concat_ws(chr(9), p1, p2, printf('%.10f', sim_x), printf('%.10f', sim_y), printf('%.10f', s), label) FROM sim)
      SELECT stage, count(*) AS records, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM t GROUP BY stage""",
    "stem_verbs": f"{_CORPUS} SELECT verb AS word, stem FROM stems WHERE verb IN (SELECT verb FROM base)",
    "threshold_sweep": f"""{_EVALUATED}, e AS (SELECT s, count(*) FILTER (label = 'POS') AS pos, count(*) FILTER (label = 'NEG') AS neg FROM sc GROUP BY s),
      r AS (SELECT s AS t, CAST(sum(pos) OVER d AS BIGINT) AS tp, CAST(sum(neg) OVER d AS BIGINT) AS fp, CAST(sum(neg) OVER () - sum(neg) OVER d AS BIGINT) AS tn, CAST(sum(pos) OVER () - sum(pos) OVER d AS BIGINT) AS fn
        FROM e WINDOW d AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT t, tp, fp, tn, fn, {_RATES} FROM r""",
    "confusion_matrix": f"""{_EVALUATED}, r AS (SELECT count(*) FILTER (label = 'POS' AND s >= {T}) AS tp, count(*) FILTER (label = 'NEG' AND s >= {T}) AS fp, count(*) FILTER (label = 'NEG' AND s < {T}) AS tn, count(*) FILTER (label = 'POS' AND s < {T}) AS fn FROM sc)
      SELECT tp, fp, tn, fn, {_RATES} FROM r""",
    "error_samples": f"""{_EVALUATED}, o AS (SELECT *, CASE label WHEN 'POS' THEN CASE WHEN s >= {T} THEN 'TP' ELSE 'FN' END ELSE CASE WHEN s >= {T} THEN 'FP' ELSE 'TN' END END AS outcome FROM sc)
      SELECT outcome, CAST(place AS INTEGER) AS place, p1, p2, label, s FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY abs(s - CAST({T} AS DOUBLE)), p1, p2) AS place FROM o) WHERE place <= 5""",
    "run_comparison": f"""{_SIMILAR}, finished AS (SELECT * FROM events WHERE status = 'F'), {_stages('finished', '_f')}, {_similar('pairs', '_f')}
      SELECT p1, p2, sim.label, round(sim_f.s, 6) AS s_small, round(sim.s, 6) AS s_large FROM sim_f JOIN sim USING (p1, p2)""",
    "tsv_roundtrip": f"{_COUNTED} SELECT reader, slot, count(*) AS triples, CAST(sum(c) AS BIGINT) AS total FROM triples, (VALUES ('typed'), ('keyed')) r(reader) GROUP BY ALL",
}

# The hard records' events by hand: f stands for the nation's filler, m for the factor of its count.
_HARD = """
hand(p, x, y, m) AS (VALUES
  ('X gave Y', 'f', 'patients', 1), ('X gave Y', 'f', 'aspirin', 1), ('X gave Y', 'patients', 'aspirin', 1),
  ('X have Y', 'patients', 'f', 1), ('X treat Y', 'f', 'disease', 1), ('X caus Y', 'f', 'f', 1), ('X caus Y', 'f', 'pain', 1), ('X caus Y', 'f', 'pain', 1),
  ('X cure Y', 'f', 'cold', 0), ('X heal Y', 'f', 'wound', -1), ('X us Y', 'patients', 'f', 1),
  ('X treat with Y', 'f', 'drugs', 1), ('X treat in Y', 'f', 'clinics', 1), ('X treat with Y', 'drugs', 'clinics', 1), ('X caus Y', 'smoking', 'f', 1),
  ('X gave Y', 'f', 'doctors', 1), ('X gave Y', 'f', 'patients', 1), ('X gave Y', 'f', 'aspirin', 1), ('X gave Y', 'doctors', 'patients', 1), ('X gave Y', 'doctors', 'aspirin', 1), ('X gave Y', 'patients', 'aspirin', 1),
  ('X caus Y', 'f', 'pain', 1)),
nat AS (SELECT n_nationkey AS nation, lower(replace(n_name, ' ', '_')) AS name FROM nation),
hev AS (SELECT p, CASE x WHEN 'f' THEN name ELSE x END AS x, CASE y WHEN 'f' THEN name ELSE y END AS y, CAST(m * (nation + 1) AS BIGINT) AS c FROM hand, nat),
events AS (SELECT p, 'X' AS slot, x AS w, c FROM hev UNION ALL SELECT p, 'Y', y, c FROM hev),
triples AS (SELECT p, slot, w, CAST(sum(c) AS BIGINT) AS c FROM events GROUP BY ALL),
mi AS (
  SELECT p, slot, w, c, CAST(round(ln(c::DOUBLE * s::DOUBLE / (ps::DOUBLE * sw::DOUBLE)), 10) AS DECIMAL(28, 10)) AS mi FROM (
    SELECT *, sum(c) OVER (PARTITION BY p, slot) AS ps, sum(c) OVER (PARTITION BY slot, w) AS sw, sum(c) OVER (PARTITION BY slot) AS s FROM triples) WHERE c > 0 AND ps > 0 AND sw > 0 AND s > 0
),
pos AS (SELECT * FROM mi WHERE mi > 0),
den AS (SELECT p, slot, sum(mi) AS denom FROM pos GROUP BY ALL),
feat AS (SELECT slot, w, count(*) AS predicates FROM pos GROUP BY ALL HAVING count(*) >= 2),
pairs(p1, p2, label) AS (VALUES ('X caus Y', 'X us Y', 'NEG'), ('X treat in Y', 'X treat with Y', 'POS'), ('X gave Y', 'X have Y', 'POS'), ('X gave Y', 'X gave Y', 'POS'), ('X caus Y', 'X gave Y', 'NEG'), ('X gave Y', 'X heal Y', 'NEG'))"""
_HARD_PATHS = """(VALUES ('three nouns', 1, 3, '1,2,3'), ('three nouns', 1, 4, '1,2,4'), ('three nouns', 3, 4, '3,2,4'), ('no auxiliary by form', 1, 3, '1,2,3'), ('cycle of three', 1, 3, '1,3'), ('cycle of four', 1, 3, '1,2,3'),
  ('no path', 1, 3, 'none'), ('repeated events', 1, 2, '1,3,2'), ('repeated events', 1, 4, '1,3,4'), ('repeated events', 2, 4, '2,3,4'), ('zero count', 1, 3, '1,2,3'), ('negative count', 1, 3, '1,2,3'),
  ('auxiliary before the verb', 1, 4, '1,2,3,4'), ('two prepositions', 1, 4, '1,2,3,4'), ('two prepositions', 1, 6, '1,2,5,6'), ('two prepositions', 4, 6, '4,3,2,5,6'), ('object first', 1, 3, '1,2,3'),
  ('four nouns', 1, 2, '1,3,2'), ('four nouns', 1, 4, '1,3,4'), ('four nouns', 1, 5, '1,3,5'), ('four nouns', 2, 4, '2,3,4'), ('four nouns', 2, 5, '2,3,5'), ('four nouns', 4, 5, '4,3,5'), ('self loop', 1, 3, '1,2,3'))"""

ORACLE_SQL |= {
    "hard_rejects": "SELECT reason, each * (SELECT count(*) FROM nation) AS lines FROM (VALUES ('valid', 13), ('blank', 1), ('head', 1)) v(reason, each)",
    "hard_paths": f"SELECT kind, n_nationkey AS nation, CAST(id1 AS INTEGER) AS id1, CAST(id2 AS INTEGER) AS id2, path FROM {_HARD_PATHS} v(kind, id1, id2, path), nation",
    "hard_events": f"WITH {_HARD} SELECT p, slot, w, c, count(*) AS events FROM events GROUP BY ALL",
    "hard_information": f"WITH {_HARD} SELECT p, slot, w, c, mi::DOUBLE AS mi FROM mi",
    "hard_unlabelled": f"WITH {_HARD}, {_similar()} SELECT p1, p2, CASE label WHEN 'POS' THEN 'POS' ELSE 'UNK' END AS label, round(s, 6) AS s FROM sim",
    "file_pairs": """SELECT left_raw, right_raw, label, CAST(precedence AS INTEGER) AS precedence FROM (VALUES ('X cause Y', 'X use Y', 'POS', 0), ('X treats with Y', 'X treat IN Y', 'POS', 0), ('X gave  Y', 'X have Y', 'POS', 0), ('X gave Y', 'X gave Y', 'POS', 0),
      ('X cause', 'X use Y', 'POS', 0), ('X gave Y', 'X caused Y', 'NEG', 1), ('X using Y', 'X causes Y', 'NEG', 1), ('X heal Y', 'X gave Y', 'NEG', 1)) v(left_raw, right_raw, label, precedence)""",
    "file_pairs_strict": "SELECT left_raw, right_raw, CAST(1 AS INTEGER) AS label FROM (VALUES ('X cause Y', 'X use Y'), ('X gave Y', 'X have Y')) v(left_raw, right_raw)",
    "file_run": f"WITH {_HARD}, {_similar()} SELECT p1, p2, label, round(s, 6) AS s FROM sim",
}
