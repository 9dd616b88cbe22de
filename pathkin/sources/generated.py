"""A parsed corpus made from the relational test tables, and the test set that goes with it.

Each line of lineitem becomes one corpus line; what kind of sentence it is depends on its keys. The words come from
the part's brand, the customer's segment with the part's size, the supplier and the order's priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERBS = ["caused", "controlled", "treated", "destroyed", "provides", "using", "carries"]
PREPOSITIONS = {"1-URGENT": "with", "2-HIGH": "by", "3-MEDIUM": "for", "4-NOT SPECIFIED": "in", "5-LOW": "to"}

#: Template pairs as a user would write them, with the label of their list.
TEST_PAIRS = [
    ("X cause Y", "X control Y", "POS"), ("X treat with Y", "X control with Y", "POS"), ("X destroy Y", "X use Y", "POS"), ("X provide Y", "Y carry X", "POS"),
    ("X  use   In Y", "X carry in Y", "POS"), ("X treat Y", "X treat Y", "POS"), ("X cause by Y", "X cause for Y", "POS"), ("X be Y", "X cause Y", "POS"),
    ("X be", "X cause Y", "POS"), ("X use to the Y", "X provide to Y", "POS"), ("X cause Y", "X treat Y", "NEG"), ("Y control X", "X cause Y", "NEG"),
    ("X carry to Y", "X use to Y", "NEG"), ("X provide for Y", "X destroy with Y", "NEG"), ("X control Y", "X carry Y", "NEG"), ("X treat with Y", "X give Y", "NEG"),
]


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, status, kind, brand, seg, verb, prep, n): what each corpus line is made of."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    joined = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    prep = F.lit(None).cast("string")
    for priority, word in PREPOSITIONS.items():
        prep = F.when(F.col("o_orderpriority") == priority, word).otherwise(prep)
    return joined.select(
        "l_orderkey", "l_linenumber", F.col("o_orderstatus").alias("status"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).alias("kind"), F.col("p_brand").alias("brand"),
        F.concat_ws("-", "c_mktsegment", "p_size").alias("seg"), F.element_at(F.array(*[F.lit(v) for v in VERBS]), (F.col("l_suppkey") % 7 + 1).cast("int")).alias("verb"),
        prep.alias("prep"), F.col("l_quantity").cast("bigint").alias("n"),
    )


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, status, value): value is the corpus line."""
    tag = F.when(F.col("prep") == "to", "TO").otherwise("IN")
    cat = F.concat
    active = cat("brand", F.lit("/NN/nsubj/2 "), "verb", F.lit("/VBD/ROOT/0 "), "seg", F.lit("/NN/dobj/2"))
    passive = cat("brand", F.lit("/NN/nsubjpass/2 "), "verb", F.lit("/VBN/ROOT/0 "), "prep", F.lit("/"), tag, F.lit("/prep/2 "), "seg", F.lit("/NN/pobj/3"))
    both = cat("prep", F.lit("/"), tag, F.lit("/prep/2 "), "verb", F.lit("/VBN/ROOT/0 "), "seg", F.lit("/NN/dobj/2 "), "brand", F.lit("/NN/pobj/1"))
    auxiliary = cat("brand", F.lit("/NN/nsubj/2 is/VBZ/ROOT/0 "), "seg", F.lit("/NN/attr/2"))
    slash = cat(F.lit("1/2/CD/num/2 "), "verb", F.lit("/VBZ/ROOT/0 "), "seg", F.lit("/NN/dobj/2"))
    ngram = F.when(F.col("kind") <= 2, active).when(F.col("kind") <= 4, passive).when(F.col("kind") == 5, both).when(F.col("kind") == 6, auxiliary).otherwise(F.when(F.col("l_linenumber") % 3 == 0, slash).otherwise(active))
    bad = F.col("kind") == 7
    count = F.when(bad & (F.col("l_linenumber") % 3 == 1), F.lit("NaNcount")).otherwise(F.col("n").cast("string"))
    line = F.when(bad & (F.col("l_linenumber") % 3 == 2), cat("verb", F.lit("\t"), ngram)).otherwise(cat("verb", F.lit("\t"), ngram, F.lit("\t"), count, F.lit("\t1990,1")))
    # the tables are small for the work that each line is, so that their few splits would leave cores idle; a corpus on disk is read as it is split
    rows = base_rows(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", "status", line.alias("value"))


def test_pairs(spark: SparkSession) -> DataFrame:
    """(left_raw, right_raw, label, precedence, place): the negative list is read last."""
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("left_raw"), F.lit(b).alias("right_raw"), F.lit(label).alias("label"), F.lit(int(label == "NEG")).alias("precedence"), F.lit(k).alias("place")) for k, (a, b, label) in enumerate(TEST_PAIRS)]))
    return spark.range(1, numPartitions=1).select(rows.alias("r")).select("r.*")


#: Records of kinds that the corpus above lacks; {f} is a filler of each nation's own, {n} its key plus one.
HARD_LINES = {
    "three nouns": "{f}/NN/nsubj/2 gave/VBD/ROOT/0 patients/NNS/iobj/2 aspirin/NN/dobj/2\t{n}",
    "no auxiliary by form": "patients/NNS/nsubj/2 having/VBG/ROOT/0 {f}/NN/dobj/2\t{n}",
    "cycle of three": "{f}/NN/nsubj/2 treats/VBZ/ROOT/3 drug/NN/dobj/1\t{n}",
    "cycle of four": "{f}/NN/nsubj/2 treats/VBZ/ROOT/3 disease/NN/dobj/4 cures/VBZ/conj/1\t{n}",
    "no path": "{f}/NN/nsubj/2 runs/VBZ/ROOT/0 dog/NN/ROOT/0\t{n}",
    "repeated events": "{f}/NN/nsubj/3 {f}/NN/nsubj/3 causes/VBZ/ROOT/0 pain/NN/dobj/3\t{n}",
    "zero count": "{f}/NN/nsubj/2 cures/VBZ/ROOT/0 cold/NN/dobj/2\t0",
    "negative count": "{f}/NN/nsubj/2 heals/VBZ/ROOT/0 wound/NN/dobj/2\t-{n}",
    "auxiliary before the verb": "patients/NNS/nsubj/2 is/VBZ/ROOT/0 using/VBG/xcomp/2 {f}/NN/dobj/3\t{n}",
    "two prepositions": "{f}/NN/nsubj/2 treated/VBN/ROOT/0 with/IN/prep/2 drugs/NNS/pobj/3 in/IN/prep/2 clinics/NNS/pobj/5\t{n}",
    "object first": "{f}/NN/dobj/2 causes/VBZ/ROOT/0 Smoking/NN/nsubj/2\t{n}",
    "four nouns": "{f}/NNP/nsubj/3 doctors/NNS/nsubj/3 gave/VBD/ROOT/0 patients/NNS/iobj/3 aspirin/NN/dobj/3\t{n}",
    "self loop": "{f}/NN/nsubj/2 causes/VBZ/ROOT/2 pain/NN/dobj/2\t{n}",
    "blank": " ",
    "head outside": "{f}/NN/nsubj/9 causes/VBZ/ROOT/0 pain/NN/dobj/2\t{n}",
}


def hard_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, nation, value): each of HARD_LINES once for each nation, the head word in front, with a year's count behind."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("line")) for k, v in HARD_LINES.items()]))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.replace("n_name", F.lit(" "), F.lit("_")).alias("f"), kinds.alias("k"))
    line = F.replace(F.replace("k.line", F.lit("{f}"), F.col("f")), F.lit("{n}"), (F.col("n_nationkey") + 1).cast("string"))
    value = F.when(F.col("k.kind") == "blank", line).otherwise(F.concat(F.lit("head\t"), line, F.lit("\t1990,1")))
    return rows.select("k.kind", F.col("n_nationkey").alias("nation"), value.alias("value"))
