"""Secret scan: candidate tokens judged by a random forest compiled into Spark columns.

Candidates are parts of a text, between white space and signs such as quotes, commas, braces
or ampersands, that hold a digit and a letter among at least MIN_LENGTH key-like characters in
a row, or have a known format, or are assigned to a credential's name right before; so a word
may hold several. Features are the candidate's length, its letters' kinds and transitions, how
much of it dictionary words cover, whether it is a path, and its neighbouring words. The forest is fitted on labelled findings - credentials of known
formats and what is mistaken for them, written out by a fixed rule - so that it removes
false findings. Scanning uses built-in functions alone.
"""

from __future__ import annotations

import random
import string
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, trees

MIN_LENGTH, THRESHOLD = 12, 0.5

# Names of credentials, words of a dictionary, words that stand by things that are no secrets.
NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential"
DICTIONARY = "example|sample|dummy|placeholder|changeme|insert|your|here|test|fake|none|null|undefined|password|secret|token|key|user|name|value|default|string|number|http|https|www|com|org|net|html|json|file|path|home|usr|lib|src|data|image|version|release|build|license|the|and|for|with|this|that"
INNOCENT = "commit|sha|sha1|sha256|md5|checksum|hash|digest|etag|uuid|guid|id|version|release|isbn|doi|phone|tel|order|build|revision|color"

# Formats that are candidates with or without a digit.
FORMATS = "(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30}|sk_(?:live|test)_[A-Za-z0-9]{16}"

SPACE = "[\\x20\\x09-\\x0D]"
CORE = "[A-Za-z0-9+/_.~=-]"

FEATURES = ["length", "digit_share", "upper_share", "lower_share", "sign_share", "distinct_share", "turns", "vowel_turns", "dictionary", "is_path", "is_hex", "known_format", "assigned", "named_before", "innocent_before", "quoted"]


#: Ends a part of a word; what may stand in a key does not.
CUT = "[\"'`(){}\\[\\]<>,;|&?\\\\]"
#: A run of key-like characters with a digit and a letter, from its first character on.
KEYED = f"(?<!{CORE})(?={CORE}*[0-9])(?={CORE}*[A-Za-z]){CORE}{{{MIN_LENGTH},}}"
#: What stands before the value of a credential.
NAMED = f"(?i)(?:{NAMES})[\"'`]?{SPACE}?(?:=|:|:=|=>){SPACE}?[\"'`(<\\[]?$"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, candidate, word, before, lead, after) of every candidate; start counts characters from 0.

    lead is what stands before the candidate in its word, before and after are the words around it.
    """
    words = F.split(F.col("text"), SPACE)
    # most texts have no word that qualifies, and one pass of two expressions says so: a run with a digit has six others beside it
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = some.where(F.col("text").rlike(f"[0-9]{CORE}{{{MIN_LENGTH // 2 - 1},}}|{CORE}{{{MIN_LENGTH // 2 - 1},}}[0-9]|(?i:{NAMES})[\"'`]?{SPACE}?:?[=:]|{FORMATS}"))
    some = some.select("doc_id", words.alias("words"))
    named = f"(?i)(?:{NAMES})[\"'`]?"

    def is_one(w: Column, i: Column) -> Column:
        one, two = F.get("words", i - 1), F.get("words", i - 2)
        follows = one.rlike("[=:]>?$") & (one.rlike(f"{named}[=:]$") | (one.rlike("^(?::?=>?|:)$") & two.rlike(f"{named}$")))
        return w.rlike(FORMATS) | (w.rlike("[0-9]") & w.rlike(KEYED)) | w.rlike(f"{named}[=:]") | F.coalesce((F.length(w) >= 6) & follows, F.lit(False))

    at = F.filter(F.transform("words", lambda w, i: F.when(is_one(w, i), i)), lambda i: i.isNotNull())
    found = some.select("doc_id", "words", F.explode(at).alias("i"))
    near = lambda a, n: F.array_join(F.filter(F.slice("words", F.greatest(a, F.lit(1)), n), lambda w: w != ""), " ")
    found = found.select(
        "doc_id",
        (F.length(F.array_join(F.slice("words", F.lit(1), F.col("i")), " ")) + F.when(F.col("i") > 0, 1).otherwise(0)).cast("long").alias("at"),
        F.get("words", F.col("i")).alias("word"),
        near(F.col("i") - 3, F.least(F.col("i"), F.lit(4))).alias("before"),
        near(F.col("i") + 2, F.lit(2)).alias("after"),
    )
    # the parts of the word, each with where it starts
    parts = F.split("word", CUT)
    starts = lambda i: F.length(F.array_join(F.slice(parts, F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0)
    found = found.select("*", F.posexplode(parts).alias("k", "part")).where(F.length("part") >= 6)
    found = found.withColumn("from", starts(F.col("k")))
    # a credential's name and its = or : are not of the candidate, nor are closing signs
    own = F.regexp_extract("part", f"^(.*?(?i:{NAMES})[=:]+)", 1)
    found = found.withColumn("from", F.col("from") + F.length(own)).withColumn("candidate", F.regexp_extract(F.substr("part", F.length(own) + 1), "^(.*?)[!*#$%.:]*$", 1))
    found = found.withColumn("lead", F.substr("word", F.lit(1), F.col("from"))).where(F.length("candidate") >= 6)
    assigned = F.concat_ws(" ", "before", "lead").rlike(NAMED)
    found = found.where(F.col("candidate").rlike(FORMATS) | F.col("candidate").rlike(KEYED) | assigned)
    return found.select("doc_id", (F.col("at") + F.col("from")).alias("start"), "candidate", "word", "before", "lead", "after")


def featured(found: DataFrame) -> DataFrame:
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1)).cast("double")
    low, before = F.lower(c), F.concat_ws(" ", "before", "lead")
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return found.select(
        "*",
        F.length(c).cast("double").alias("length"),
        share("[0-9]").alias("digit_share"),
        share("[A-Z]").alias("upper_share"),
        share("[a-z]").alias("lower_share"),
        share("[^A-Za-z0-9]").alias("sign_share"),
        (F.size(F.array_distinct(F.split(low, ""))) / n).alias("distinct_share"),
        share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])").alias("turns"),
        share("(?i)[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])").alias("vowel_turns"),
        ((n - F.length(F.regexp_replace(low, DICTIONARY, ""))) / n).alias("dictionary"),
        flag(c.rlike("^(?:[a-z]+://|/|\\.{1,2}/|[A-Za-z]:\\\\|[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+)|@|^[a-z0-9.-]+\\.[a-z]{2,4}$")).alias("is_path"),
        flag(c.rlike("^(?:0x)?(?:[0-9a-f]+|[0-9A-F]+)$")).alias("is_hex"),
        flag(c.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^sk_(?:live|test)_[A-Za-z0-9]{16,}$|^xox[abprs]-|^AIza[0-9A-Za-z_-]{30,}$|^eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]+")).alias("known_format"),
        flag(before.rlike(NAMED)).alias("assigned"),
        flag(before.rlike(f"(?i)(?:{NAMES})")).alias("named_before"),
        flag(before.rlike(f"(?i)(?:^|[^a-z])(?:{INNOCENT})[^a-z]*$")).alias("innocent_before"),
        flag(F.col("lead").rlike("[\"'`]$")).alias("quoted"),
    )


def findings(n: int = 2400, seed: int = 5) -> list[tuple[str, int]]:
    """Labelled findings in context: (line, 1 for a secret). Formats and decoys in turn, letters by a seeded rule.

    Every third line holds its finding among others of no interest in one word: an object, a query, assignments.
    """
    r = random.Random(seed)
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexes, upper, mixed = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    word = lambda: "".join(r.choice(["tion", "er", "an", "the", "or", "st", "re", "ing", "en", "ly", "men", "te", "ca", "do"]) for _ in range(r.randint(1, 4)))
    name = lambda: r.choice(["token", "secret", "api_key", "password", "apikey", "auth", "access_key", "pwd", "TOKEN", "Password"])
    sign = lambda: r.choice([" = ", "=", ": ", ":", " := "])
    quote = lambda x: r.choice(['"{}"', "{}", "'{}'"]).format(x)
    secrets = [
        lambda: "AKIA" + some(upper, 16),
        lambda: f"{r.choice(['aws', 'key', word()])} {r.choice(['AKIA', 'ASIA']) + some(upper, 16)}",
        lambda: f"{r.choice(['ghp', 'gho', 'ghs'])}_{some(mixed, 36)}",
        lambda: f"sk_live_{some(mixed, 24)}",
        lambda: f"AIza{some(mixed + '_-', 35)}",
        lambda: f"xoxb-{some(string.digits, 12)}-{some(mixed, 24)}",
        lambda: f"eyJ{some(mixed, 30)}.eyJ{some(mixed, 40)}.{some(mixed + '_-', 43)}",
        lambda: name() + sign() + quote(some(hexes, r.choice([16, 18, 20, 32, 40, 64]))),
        lambda: name() + sign() + quote(some(hexes, 40).upper()),
        lambda: name() + sign() + quote(some(mixed + "+/", r.choice([20, 32, 40, 44]))),
        lambda: name() + sign() + quote(some(mixed + "!@#%", r.randint(9, 16)) + "7"),
        lambda: f"Authorization: Bearer {some(mixed + '-_', 40)}9",
        lambda: some(mixed, 40) + "4+/x",
    ]
    decoys = [
        lambda: f"{r.choice(['commit', 'sha1', 'checksum', 'etag', 'md5:', 'digest'])} {some(hexes, r.choice([32, 40, 64]))}",
        lambda: some(hexes, r.choice([32, 40])),
        lambda: f"{r.choice(['uuid', 'id', word()])} {uuid.UUID(int=r.getrandbits(128))}",
        lambda: f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
        lambda: f"https://{word()}.example.org/{word()}/{r.randint(1, 99999)}.html?page={r.randint(1, 9)}",
        lambda: f"/usr/lib/{word()}/{word()}{r.randint(1, 9)}.{r.randint(0, 20)}.so",
        lambda: f"{word()}/{word()}_{r.randint(1, 2030)}/{word()}-v{r.randint(1, 9)}.json",
        lambda: f"version {word()}-{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}-beta{r.randint(1, 9)}",
        lambda: f"{name()}{sign()}{quote(r.choice(['your-token-here1', 'changeme123', 'example-key-1', 'password123', 'xxxxxxxxxxxx1', 'insert_your_key_here2', 'test1test2test3', 'placeholder-0001']))}",
        lambda: f"{name()}{sign()}{quote(r.choice(['undefined', 'string', 'required', 'username', 'null,null']))}",
        lambda: f"{word()}{word()}{r.randint(10, 9999)}{word()}",
        lambda: f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:00Z",
        lambda: "AKIA" + "IOSFODNN7EXAMPLE",
        lambda: f"{some(string.ascii_uppercase, 2)}{some(string.digits, 20)}",
        lambda: f"{word().title()}{word().title()}{r.randint(1, 9)}{word().title()}Handler",
    ]
    out = []
    for i in range(n):
        label = i % 2
        kinds = secrets if label else decoys
        found = kinds[i // 2 % len(kinds)]()
        if i // 2 % 3 == 2 and " " not in found:
            found = r.choice(['{{"{}":"x","{}":"{}"}}'.format(word(), word(), found.strip("\"'")), f"id={r.randint(1, 99)};{found};lang=en", f"/p?q={word()}&{found}&n=1", f"[{word()},{found}]"])
        out.append((f"{word()} {word()} {found} {word()} {word()}.", label))
    return out


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None) -> list[trees.Node]:
    """A forest on labelled findings (line, label); by default those of findings()."""
    labelled = labelled or findings()
    lines = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled)], "doc_id long, text string")
    rows = np.array([tuple(r) for r in featured(candidates(lines)).select("doc_id", "start", *FEATURES).collect()], float).reshape(-1, len(FEATURES) + 2)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    y = np.array([labelled[int(i)][1] for i in rows[:, 0]])
    return trees.forest(rows[:, 2:], y, trees=16, depth=5)


def scan(docs: DataFrame, forest: list[trees.Node]) -> DataFrame:
    """Candidates of docs (doc_id, text) with their score: doc_id, start, length, candidate, score, is_secret.

    Rows with is_secret false are the findings that the forest removes. Null and empty texts have no
    candidates, repeated rows are scanned each, a null doc_id stays null, other columns are ignored, an
    empty table gives no rows. score is the mean vote of the trees, is_secret says score >= THRESHOLD.
    """
    votes = reduce(lambda a, b: a + b, [trees.tree_column(t, FEATURES) for t in forest]) / len(forest)
    judged = featured(candidates(docs)).select("doc_id", "start", F.length("candidate").cast("long").alias("n"), "candidate", votes.alias("score"))
    return judged.select("doc_id", "start", F.col("n").alias("length"), "candidate", "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def masked(candidate: Column) -> Column:
    """The first four characters of a secret, the others as stars: enough to find it, not to use it."""
    return F.concat(F.substring(candidate, 1, 4), F.regexp_replace(F.expr("substring(candidate, 5)"), ".", "*"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = train(spark)
    found = scan(common.table(spark, sf_dir, "documents"), forest)
    return found.select("doc_id", "start", "length", masked(F.col("candidate")).alias("masked"), "score", "is_secret")
