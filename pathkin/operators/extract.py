"""Token arrays to slot events: noun pairs, paths between them, predicates and fillers.

Each token has one head, so that a record is a forest (or, if malformed, holds cycles) and the path between two
tokens runs up one ancestor chain and down the other. Chains are array expressions and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged
from ..functions.stemming import with_stem

# Auxiliary verbs by surface form; grammatical relations.
AUXILIARIES = ["be", "is", "are", "was", "were", "been", "being", "have", "has", "had", "do", "does", "did"]
SUBJECTS = ["nsubj", "nsubjpass"]
OBJECTS = ["dobj", "obj", "iobj"]


def is_noun(t: Column) -> Column:
    return t["pos"].startswith("NN")


def is_verb(t: Column) -> Column:
    return t["pos"].startswith("VB")


def is_preposition(t: Column) -> Column:
    return t["pos"].isin("IN", "TO")


def is_auxiliary(t: Column) -> Column:
    return F.lower(t["word"]).isin(AUXILIARIES)


def noun_pairs(records: DataFrame) -> DataFrame:
    """records with one row for each pair of nouns n1, n2 in token order."""
    nouns = F.filter("toks", is_noun)
    pairs = F.flatten(F.transform("_nouns", lambda a: F.transform(F.filter("_nouns", lambda b: b["id"] > a["id"]), lambda b: F.struct(a.alias("n1"), b.alias("n2")))))
    return staged(records, _nouns=nouns).filter(F.size("_nouns") >= 2).withColumn("_pair", F.explode(pairs)).select(*records.columns, "_pair.n1", "_pair.n2")


def _chain(start: Column) -> Column:
    """start and its ancestors; at most as many as there are tokens."""
    head = lambda chain: F.get(F.col("toks"), F.element_at(chain, -1) - 1)["head"]
    step = lambda chain, _: F.when(head(chain) == 0, chain).otherwise(F.array_append(chain, head(chain)))
    return F.aggregate("toks", F.array(start), step)


def dependency_paths(pairs: DataFrame) -> DataFrame:
    """pairs with path: token ids from n1 to n2, both included; null if no path joins them.

    A path goes up n1's chain to a token that n2's chain holds too, and down from there; the shortest has the
    smallest sum of places. Where heads run in a cycle of even length, two ways round can be equally short: then the one that a
    breadth-first search in token order takes first, which is the way up if the token where n1's chain enters the cycle comes before its predecessor in it.
    """
    chains = staged(pairs, _up=F.array_distinct(_chain(F.col("n1.id"))), _down=F.array_distinct(_chain(F.col("n2.id"))))
    place = lambda chain, x: F.array_position(chain, x).cast("int")
    last = F.element_at("_up", -1)
    way_up = F.get("toks", last - 1)["head"] < last
    meeting = lambda x: F.struct((place("_up", x) + place("_down", x)).alias("steps"), F.when(way_up, -place("_up", x)).otherwise(place("_up", x)).alias("rank"), x.alias("id"))
    met = staged(chains, _top=F.array_min(F.transform(F.filter("_up", lambda x: F.array_contains("_down", x)), meeting))["id"])
    path = F.concat(F.slice("_up", 1, place("_up", F.col("_top"))), F.reverse(F.slice("_down", 1, place("_down", F.col("_top")) - 1)))
    return staged(met, path=F.when(F.col("_top").isNotNull(), path)).drop("_up", "_down", "_top")


def chosen_verbs(paths: DataFrame) -> DataFrame:
    """paths with verb_id, verb (lower case) and prep, for pairs whose path has a verb that is no auxiliary.

    The verb is the first such verb from n1 on, the preposition the first preposition (null if there is none).
    """
    on_path = F.transform("path", lambda i: F.get("toks", i - 1))
    walked = staged(paths.filter(F.col("path").isNotNull()), _on=on_path)
    verb, prep = F.get(F.filter("_on", lambda t: is_verb(t) & ~is_auxiliary(t)), F.lit(0)), F.get(F.filter("_on", is_preposition), F.lit(0))
    chosen = staged(walked, verb_id=verb["id"], verb=F.lower(verb["word"]), prep=F.lower(prep["word"]))
    return chosen.filter("verb_id IS NOT NULL").drop("_on")


def with_key(df: DataFrame) -> DataFrame:
    """df (verb, prep) with p, the predicate 'X stem [prep ]Y'."""
    return with_stem(df, "verb", "_stem").withColumn("p", F.concat_ws(" ", F.lit("X"), "_stem", "prep", F.lit("Y"))).drop("_stem")


def _scores(noun: str) -> tuple[Column, Column]:
    """How well a noun fits X (subject of the verb) and Y (its object, or the object of a preposition of it)."""
    own = F.col(f"{noun}.head") == F.col("verb_id")
    rel = F.col(f"{noun}.rel")
    above = F.get("toks", F.col(f"{noun}.head") - 1)
    x = F.when(own & rel.isin(SUBJECTS), 100).otherwise(0)
    by_preposition = (rel == "pobj") & is_preposition(above) & (above["head"] == F.col("verb_id")) & (above["rel"] == "prep")
    return x, F.when(own & rel.isin(OBJECTS), 100).when(by_preposition, 80).otherwise(0)


def slot_fillers(chosen: DataFrame) -> DataFrame:
    """chosen with x and y, the lower-cased fillers: the better subject is X, else the better object Y, else token order."""
    (x1, y1), (x2, y2) = _scores("n1"), _scores("n2")
    scored = chosen.withColumn("_x", x1 - x2).withColumn("_y", y1 - y2)
    swap = (F.col("_x") < 0) | ((F.col("_x") == 0) & (F.col("_y") > 0))
    first, second = F.lower("n1.word"), F.lower("n2.word")
    return scored.withColumn("x", F.when(swap, second).otherwise(first)).withColumn("y", F.when(swap, first).otherwise(second)).drop("_x", "_y")


def verb_events(records: DataFrame) -> DataFrame:
    """(verb, prep, slot, w, c): two events for each noun pair with a predicate, repeats included."""
    filled = slot_fillers(chosen_verbs(dependency_paths(noun_pairs(records))))
    both = F.array(F.struct(F.lit("X").alias("slot"), F.col("x").alias("w")), F.struct(F.lit("Y").alias("slot"), F.col("y").alias("w")))
    return filled.select("verb", "prep", F.explode(both).alias("_e"), F.col("count").alias("c")).select("verb", "prep", "_e.slot", "_e.w", "c")


def extract_events(records: DataFrame) -> DataFrame:
    """(p, slot, w, c): the events under their predicate, in one pass; only verb forms go through Python."""
    return with_key(verb_events(records)).select("p", "slot", "w", "c")


def event_counts(records: DataFrame) -> DataFrame:
    """(p, slot, w, c, events): how often each event occurs. Counted by verb form first, so that stems are looked up for the much smaller result."""
    forms = verb_events(records).groupBy("verb", "prep", "slot", "w", "c").agg(F.count(F.lit(1)).alias("events"))
    return with_key(forms).groupBy("p", "slot", "w", "c").agg(F.sum("events").alias("events"))


def predicate_counts(records: DataFrame) -> DataFrame:
    """(p, pairs): for how many noun pairs each predicate stands."""
    forms = chosen_verbs(dependency_paths(noun_pairs(records))).groupBy("verb", "prep").agg(F.count(F.lit(1)).alias("pairs"))
    return with_key(forms).groupBy("p").agg(F.sum("pairs").alias("pairs"))


def extract_triples(records: DataFrame) -> DataFrame:
    """(p, slot, w, c): the events summed up, by verb form first, in the JVM; stems are then looked up for the verb forms of that much smaller result."""
    forms = verb_events(records).groupBy("verb", "prep", "slot", "w").agg(F.sum("c").alias("c"))
    return with_key(forms).groupBy("p", "slot", "w").agg(F.sum("c").alias("c"))
