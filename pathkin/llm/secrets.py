"""Secret scans: candidates by pattern, false positives removed by a random forest (DataFrame functions only).

A candidate is a run of text that one of ``PATTERNS`` finds; values have no greatest length. The forest looks at its length, the changes
between kinds of characters, how much of it dictionary words cover, whether it is part of a path, and the
neighbouring words. The dictionary is counted in the corpus itself: the ``dictionary_words`` words of four letters and more that occur most
often in all texts (a bounded table; beside it the stand-ins below). The forest is fitted on labelled findings (texts with one candidate each, and
whether it is a secret): a sample of at most ``labelled`` rows whose features come from the same expressions. The fitted trees
become CASE expressions, so that a scan is one pass over the texts without a shuffle or a join.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Published formats of credentials, and names under which they are assigned. Values have no greatest length: a cut
# one would leave its rest in the text. A run of hex digits is tried at its start (or after a match) only, so that scans stay linear.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:\s*+[A-Za-z][A-Za-z-]*+: [^\n]*+\n)*+[A-Za-z0-9+/=\s\\]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----)?",
    "aws_key": r"A(?:KI|SI)A[0-9A-Z]{16}(?![0-9A-Za-z])",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[0-9A-Za-z-]{10,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "payment_key": r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "api_secret": r"sk-[A-Za-z0-9_-]{20,}",
    "web_token": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    "url_password": r"(?<=://)[A-Za-z0-9._-]++:[^\s/:@\"']{6,}+@",
    "assigned": r"(?i:(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access_key|auth_key|credential)[a-z0-9_-]{0,20}[\"']?\s{0,3}(?:=>|:=|[:=])\s{0,3}(?:bearer )?[\"']?[^\s\"'<>,;(){}|]{8,}+)",
    "hex": r"(?:\G|(?<![0-9a-fA-F]))[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
}
#: Words that stand-ins and ordinary names are made of.
STAND_INS = "example sample test testing dummy placeholder changeme change your here insert enter default value none null true false undefined password passwd secret token apikey key user username admin root login account email name string config setting env process public private local host server database service client header request response session cookie index file path image data version release build master main branch module package function method class object array number text todo fixme xxxx abcdef 123456 qwerty letmein welcome foobar hello world".split()
#: Neighbouring words of secrets, and of things that only look like one.
NEAR_SECRET = "token|secret|passw|pwd|credential|api.?key|access.?key|auth|bearer|private"
NEAR_OTHER = "commit|sha1|sha256|sha512|md5|hash|checksum|digest|integrity|uuid|guid|etag|revision|fingerprint|example|sample|dummy|placeholder|fixture|image|color|blob|tree|parent|version|asset"

FINDER = "|".join(PATTERNS.values())
_LEAD = r"^(?i:[a-z0-9_-]{0,60}[\"']?\s{0,3}(?:=>|:=|[:=])\s{0,3}(?:bearer )?[\"']?)"
FEATURES = ["length", "distinct", "changes", "digits", "uppers", "symbols", "repeats", "stand_ins", "dictionary", "hex", "prefixed", "assigned", "in_path", "has_path", "near_secret", "near_other"]


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def _kind(match: Column) -> Column:
    kind = F.lit("hex")
    for name in reversed([k for k in PATTERNS if k != "hex"]):
        kind = F.when(match.rlike("^(?:" + PATTERNS[name].replace("(?<=://)", "") + ")$"), name).otherwise(kind)
    return kind


def common_words(docs: DataFrame, n: int = 2000) -> list[str]:
    """The n words of four to twenty letters that occur most often in all texts, A-Z lowered; ties in code-point order."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter(F.length("word").between(4, 20))
    found = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(n)
    return sorted(r["word"] for r in found.collect())


def _candidates(rows: DataFrame, dictionary: list[str]) -> DataFrame:
    """rows (with text) and their matches, the text between them as pieces, and found: a struct with the features of each match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = rows.withColumn("matches", F.regexp_extract_all(text, F.lit(FINDER), F.lit(0)))
    some = F.size("matches") > 0
    marked = marked.withColumn("pieces", F.when(some, F.split(text, FINDER, -1)))

    def describe(match: Column, i: Column) -> Column:
        lead = F.when(_kind(match) == "assigned", F.regexp_extract(match, _LEAD, 0)).otherwise(F.lit(""))
        return F.struct(
            i.alias("i"), match.alias("match"), lead.alias("lead"), _kind(match).alias("kind"), F.substring(match, F.length(lead) + 1, F.length(match)).alias("value"),
            F.substring(F.get("pieces", i), -60, 60).alias("before"), F.substring(F.get("pieces", i + 1), 1, 40).alias("after"),
        )

    def covered(v: Column) -> Column:
        """The share of letters in words of the dictionary; words are runs of letters, parted where a capital begins one."""
        parts = F.regexp_extract_all(v, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0))
        known = F.filter(parts, lambda w: F.lower(w).isin(dictionary or [""]))
        return F.aggregate(known, F.lit(0), lambda s, w: s + F.length(w)) / F.greatest(F.length(v), F.lit(1))

    def measure(x: Column) -> Column:
        v, lower = x["value"], F.lower(x["value"])
        around = F.lower(F.concat(x["before"], x["lead"], F.lit(" "), x["after"]))
        stand_ins = "(?:" + "|".join(sorted(STAND_INS, key=len, reverse=True)) + ")"
        features = [
            F.length(v), F.size(F.array_distinct(F.split(v, ""))) / F.greatest(F.length(v), F.lit(1)),
            F.regexp_count(v, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) / F.greatest(F.length(v), F.lit(1)),
            _share(v, "[^0-9]"), _share(v, "[^A-Z]"), _share(v, "[A-Za-z0-9]"), _share(v, r"(?s)(?!(.)\1\1).") ,
            F.lit(1.0) - _share(lower, stand_ins), covered(v), v.rlike("^[0-9a-fA-F]+$"), ~x["kind"].isin("hex", "assigned"), x["kind"] == "assigned",
            x["before"].rlike(r"(?:://\S*|[/\\.])$"), v.rlike(r"[/\\]|\.[a-z]{2,4}$"), around.rlike(NEAR_SECRET), around.rlike(NEAR_OTHER),
        ]
        return F.struct(x["i"].alias("i"), x["match"].alias("match"), x["lead"].alias("lead"), x["kind"].alias("kind"), x["value"].alias("value"), *[f.cast("double").alias(n) for n, f in zip(FEATURES, features)])

    marked = marked.withColumn("found", F.when(some, F.transform("matches", describe)))
    return marked.withColumn("found", F.transform("found", measure))


class Forest:
    """Bagged decision trees over the features, as nested tuples (feature, threshold, below, above) with shares of secrets at the leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x[rows], y[rows], depth, rng) for rows in (rng.integers(0, len(y), len(y)) for _ in range(trees))] if len(y) else [1.0]

    def _grow(self, x, y, depth, rng):
        share = float(y.mean())
        if not depth or len(y) < 8 or share in (0.0, 1.0):
            return share
        best = None
        for f in rng.permutation(x.shape[1])[: max(1, round(x.shape[1] ** 0.5) + 1)].tolist():
            values = np.unique(x[:, f])
            if len(values) < 2:
                continue
            for t in np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 17), method="nearest")).tolist():
                below = x[:, f] <= t
                n, a, b = below.sum(), y[below].mean(), y[~below].mean()
                impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if best is None or impurity < best[0]:
                    best = (impurity, f, t)
        if best is None:
            return share
        below = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[below], y[below], depth - 1, rng), self._grow(x[~below], y[~below], depth - 1, rng)

    def column(self, x: Column) -> Column:
        """The mean of the trees' leaves as an expression over the fields of x."""

        def case(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(x[FEATURES[node[0]]] <= F.lit(node[1]), case(node[2])).otherwise(case(node[3]))

        total = case(self.trees[0])
        for tree in self.trees[1:]:
            total = total + case(tree)
        return total / F.lit(float(len(self.trees)))


def labelled_findings(n: int = 1500, seed: int = 3) -> list[tuple[str, int]]:
    """A made set of labelled findings: texts with one candidate each, and 1 if it is a secret."""
    r = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    hex_ = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum = string.ascii_letters + string.digits
    say = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 8)))
    name = lambda: r.choice(["token", "secret", "api_key", "password", "passwd", "auth_token", "client_secret", "access_key", "db_password", "API_KEY", "apiKey"])
    equals = lambda: r.choice([" = ", "=", ": ", ' = "', '="', "='", ': "'])
    word = lambda: r.choice(STAND_INS)
    secrets = [
        lambda: f'{name()}{equals()}{hex_(r.choice([32, 40, 40, 40, 64]))}"', lambda: f"{name()}{equals()}{pick(alnum, r.randint(16, 48))}", lambda: f"{name()}{equals()}{pick(alnum + '!@#$%^&*-_', r.randint(10, 24))}",
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: f"xoxb-{r.randint(10**10, 10**11)}-{pick(alnum, 24)}",
        lambda: "AIza" + pick(alnum + "_-", 35), lambda: "sk_live_" + pick(alnum, 24), lambda: "sk-" + pick(alnum, 40), lambda: f"eyJ{pick(alnum, 20)}.{pick(alnum, 40)}.{pick(alnum, 30)}",
        lambda: f"postgres://{word()}:{pick(alnum, 14)}@", lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{pick(alnum + '+/', 200)}\n-----END RSA PRIVATE KEY-----", lambda: f"bearer token: {hex_(40)}",
    ]
    others = [
        lambda: f"{name()}{equals()}{word()}_{word()}_{word()}", lambda: f"{name()}{equals()}your-{word()}-here", lambda: f"{name()}{equals()}{r.choice('x*0.a-')*r.randint(8, 40)}",
        lambda: f"commit {hex_(40)}", lambda: f"sha256 {hex_(64)}", lambda: f"md5 checksum {hex_(32)}", lambda: f"/assets/{hex_(32)}.png", lambda: f"https://host/blob/{hex_(40)}/file", lambda: f"etag {hex_(32)}", lambda: f"uuid {hex_(32)}",
        lambda: f"{name()}{equals()}process.env.{word()}", lambda: f"{name()}: {''.join(r.choice(syllables) for _ in range(r.randint(4, 9)))}", lambda: f"{name()}{equals()}/var/{word()}/{word()}/{word()}", lambda: f"sk_test_{word()}{word()}{word()}{word()}",
        lambda: "AKIA" + "EXAMPLE" * 2 + "AB", lambda: f"{name()}: {word()}{word()}{r.randint(1, 999)}", lambda: "ghp_" + "x" * 36, lambda: f"fingerprint {hex_(64)}", lambda: f"http://{word()}:{word()}@",
    ]
    return [(f"{say()} {r.choice(kinds)()} {say()}", y) for k in range(n) for y, kinds in ((k % 2, others if k % 2 == 0 else secrets),)]


class Scanner:
    """A forest and the dictionary that its features are measured with."""

    def __init__(self, forest: Forest, dictionary: list[str]):
        self.forest, self.dictionary = forest, dictionary


def features_of(spark: SparkSession, findings: list[tuple[str, int]], dictionary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of each candidate in labelled findings, and the labels."""
    found = _candidates(spark.createDataFrame(findings, "text string, y int"), dictionary).select("y", F.explode("found").alias("f")).select("y", *[f"f.{n}" for n in FEATURES]).collect()
    return np.array([[r[n] for n in FEATURES] for r in found], np.float64).reshape(-1, len(FEATURES)), np.array([r["y"] for r in found], np.float64)


def fit_scanner(docs: DataFrame, findings: list[tuple[str, int]] | None = None, labelled: int = 2000, dictionary_words: int = 2000, seed: int = 5) -> Scanner:
    """A scanner for docs from a random sample of at most ``labelled`` findings, whose features it collects; without findings, from the made set."""
    rows = findings if findings is not None else labelled_findings()
    if len(rows) > labelled:
        rows = random.Random(seed).sample(rows, labelled)
    dictionary = common_words(docs, dictionary_words)
    return Scanner(Forest(*features_of(docs.sparkSession, rows, dictionary)), dictionary)


def _judged(rows: DataFrame, scanner: Scanner) -> DataFrame:
    def judge(x: Column) -> Column:
        return F.struct(x["i"].alias("i"), x["match"].alias("match"), x["lead"].alias("lead"), x["kind"].alias("kind"), x["value"].alias("value"), scanner.forest.column(x).alias("score"))

    return _candidates(rows, scanner.dictionary).withColumn("found", F.transform("found", judge))


def secret_findings(docs: DataFrame, scanner: Scanner | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, finding, start, length, kind, value, score, is_secret) for each candidate in docs (doc_id, text).

    start is the place of the value in the text in characters, from 1; finding numbers a text's candidates
    from 0. is_secret: the forest's score is at least the threshold. Null and empty texts have no
    findings; repeated rows each have theirs; an empty table gives an empty result; other columns are not read. Long texts are scanned whole.
    """
    scanner = scanner or fit_scanner(docs)
    rows = _judged(docs.select("doc_id", "text"), scanner).filter(F.size("matches") > 0)
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))
    places = F.aggregate(
        F.zip_with("pieces", "matches", lambda p, m: F.struct(F.length(p).alias("p"), F.coalesce(F.length(m), F.lit(0)).alias("m"))), begin,
        lambda s, x: F.struct((s["at"] + x["p"] + x["m"]).alias("at"), F.array_append(s["starts"], s["at"] + x["p"]).alias("starts")),
    )
    rows = rows.select("doc_id", places["starts"].alias("starts"), "found").select("doc_id", "starts", F.explode("found").alias("f"))
    return rows.select(
        "doc_id", F.col("f.i").alias("finding"), (F.get("starts", F.col("f.i")) + F.length("f.lead")).alias("start"), F.length("f.value").alias("length"),
        F.col("f.kind").alias("kind"), F.col("f.value").alias("value"), F.round("f.score", 6).alias("score"), (F.col("f.score") >= F.lit(float(threshold))).alias("is_secret"),
    )


def redacted(docs: DataFrame, scanner: Scanner | None = None, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret's value in text replaced by mark; nothing else changes.

    Null texts stay null; all columns, whatever their names, and all rows stay, repeated ones too. An empty table stays one.
    """
    scanner = scanner or fit_scanner(docs)
    rows = _judged(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "text"), scanner)
    is_secret = lambda x: x["score"] >= F.lit(float(threshold))
    parts = F.transform("found", lambda x: F.concat(F.get("pieces", x["i"]), F.when(is_secret(x), F.concat(x["lead"], F.lit(mark))).otherwise(x["match"])))
    text = F.when(F.exists("found", is_secret), F.concat(F.array_join(parts, ""), F.element_at("pieces", -1))).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op9_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"))
