"""Secret scan with a random forest that removes false positives, in DataFrame functions only.

Candidates are runs of [A-Za-z0-9+/_.-] with a digit and a letter and with '=' as padding, of 16 characters or more, beside secret
words of 8 or more; in NAME=value the name is a word beside the value. What a secret word is set to in quotes is a candidate from 8 characters, whatever
signs it has, and without a digit too. Their features are length, transitions between character classes, the share of distinct characters, dictionary coverage, the path of
the document (tests, examples, lock files) and the words beside the candidate. The forest (Spark ML, which
runs in the JVM) is trained on labelled findings; ``labelled_findings`` makes a table of them by rules, and any table with
the same columns may take its place.

Defined results: null and empty texts have no findings; a null path counts as an ordinary one; repeated
rows are scanned each; positions count code points, ends are exclusive; without labelled findings of both
labels every candidate is reported with probability 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stopwords
from ..functions.arrays import bound
from .pii import _located
from .storage import staged

# Words that secrets rarely hold, words beside them, and parts of paths.
DICTIONARY = "example sample test dummy your my key token secret password here name value file path user admin config default index class function return import package version build module object string number array error message request response server client service data base table column view model list item page image color width height style script content window document event change update create delete insert select order group public private static void the and for with this that from have not are was will can about which their other into more some time only over also after first well even want because these give most"
SECRET_WORDS = "token|secret|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key|signing[_-]?key|client[_-]?secret"
HARMLESS_WORDS = "commit|sha1|sha256|sha512|md5|hash|checksum|digest|uuid|guid|revision|integrity|etag|example|sample|placeholder|fixture|id"
TEST_PATHS = r"(?:^|[/_.-])(?:tests?|spec|fixtures?|examples?|samples?|docs?|mocks?|package-lock|yarn|poetry)(?:[/_.-]|$)"

SIGN = "[A-Za-z0-9+/_.-]"
TOKEN = rf"(?<!{SIGN})(?=[A-Za-z+/_.-]*+[0-9])(?=[0-9+/_.-]*+[A-Za-z]){SIGN}{{8,}}+(?:={{1,2}}(?![A-Za-z0-9+/_=.-]))?"
#: A quoted value of a secret word: any characters but quotes and white space. The quote and the value are looked for before the word, which costs far more.
QUOTED = rf"(?<=[\"'`])(?=[^\"'`\s]{{8,}}+[\"'`])(?<=(?i:{SECRET_WORDS})[\"'`]?\s{{0,3}}(?:[:=]|:=|=>)\s{{0,3}}[\"'`])[^\"'`\s]{{8,}}+(?=[\"'`])"
CANDIDATE = f"{QUOTED}|{TOKEN}"
SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
#: Length from which a run is a candidate wherever it stands.
LONG = 16
TREES, DEPTH, FINDINGS, THRESHOLD = 40, 7, 6000, 0.5

BESIDE = rf"(?:{SECRET_WORDS})[^\n]{{0,12}}"

FEATURES = (
    "size", "changes", "case_changes", "distinct", "digits", "upper", "symbols", "hex", "covered", "uuid", "dotted", "repeats",
    "secret_word", "harmless_word", "assigned", "quoted", "test_path",
)


def candidates(text: Column) -> Column:
    """Array of (start, end, hit, before, after)."""

    def whole(found: Column) -> Column:
        """A name before the hit can be a hit of its own, and is still what stands before it."""

        def make(x: Column, i: Column) -> Column:
            last = F.get(found, i - 1)
            before = F.concat(F.coalesce(F.right(last["before"], F.lit(40)), F.lit("")), F.coalesce(F.right(last["hit"], F.lit(40)), F.lit("")), x["before"])
            return F.struct(
                x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.right(before, F.lit(40)).alias("before"), F.left(x["after"], F.lit(20)).alias("after")
            )

        return F.transform(found, make)

    near = bound(_located(text, CANDIDATE, F.lit(True)), whole)
    return F.filter(near, lambda x: (F.length(x["hit"]) >= LONG) | F.lower(x["before"]).rlike(rf"{BESIDE}\z"))


def _share(hit: Column, pattern: str) -> Column:
    return (F.length(hit) - F.length(F.regexp_replace(hit, pattern, ""))) / F.length(hit)


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to a table with hit, before, after and path."""
    hit, low = F.col("hit"), F.lower("hit")
    n = F.length(hit).cast("double")
    cls = F.regexp_replace(F.translate(hit, SIGNS[:62], "a" * 26 + "A" * 26 + "0" * 10), "[^aA0]", "_")
    dictionary = "|".join(sorted({w for w in (*DICTIONARY.split(), *stopwords.ALL) if len(w) > 2 and w.isalpha()}, key=lambda w: (-len(w), w)))
    near = F.lower("before")
    flag = lambda c: c.cast("double")
    made = {
        "size": F.log2(n),
        "changes": F.regexp_count(cls, F.lit(r"a(?=[^a])|A(?=[^A])|0(?=[^0])|_(?=[^_])")) / n,
        "case_changes": F.regexp_count(hit, F.lit("[a-z](?=[A-Z])")) / n,
        "distinct": F.size(F.filter(F.array(*map(F.lit, SIGNS)), lambda c: F.contains(hit, c))) / F.least(n, F.lit(64.0)),
        "digits": _share(hit, "[0-9]"),
        "upper": _share(hit, "[A-Z]"),
        "symbols": _share(hit, "[^A-Za-z0-9]"),
        "hex": flag(hit.rlike("^[0-9a-f]+$") | hit.rlike("^[0-9A-F]+$")),
        "covered": _share(low, dictionary),
        "uuid": flag(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "dotted": F.regexp_count(hit, F.lit("[./]")).cast("double"),
        "repeats": F.regexp_count(hit, F.lit(r"(.)\1")) / n,
        "secret_word": flag(near.rlike(rf"{BESIDE}\z")),
        "harmless_word": flag(near.rlike(rf"(?:^|[^a-z])(?:{HARMLESS_WORDS})[^a-z\n]{{0,6}}\z")),
        "assigned": flag(near.rlike(r"[=:]\s*[\"'`]?\z")),
        "quoted": flag(near.rlike(r"[\"'`]\z") & F.col("after").rlike("^[\"'`]")),
        "test_path": flag(F.coalesce(F.lower("path"), F.lit("")).rlike(TEST_PATHS)),
    }
    return found.withColumns({k: made[k].cast("double") for k in FEATURES})


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(hit, before, after, path, label): ``n`` findings made by rules from a counter and its digests."""
    i = F.col("id")
    hashed = lambda salt: F.sha2(F.concat(i.cast("string"), F.lit(salt)), 256)
    pick = lambda salt, values: F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(values))).cast("int"))
    b64 = F.base64(F.unhex(hashed("b")))
    word = lambda salt: pick(salt, DICTIONARY.split())
    alnum = F.translate(b64, "+/=", "xyz")
    long = lambda salt, n: F.base64(F.unhex(F.concat(*(hashed(f"{salt}{k}") for k in range(n)))))
    safe = lambda salt, n: F.translate(long(salt, n), "+/=", "-_")
    kind = F.pmod(F.xxhash64(i, F.lit("kind")), F.lit(12))
    secret = (
        F.when(kind < 2, F.concat(F.substring(alnum, F.lit(1), (7 + i % 8).cast("int")), (i % 10).cast("string")))
        .when(kind == 2, F.concat(F.lit("eyJ"), safe("j", 1), F.lit(".eyJ"), safe("k", 4), F.lit("."), safe("l", 1)))
        .when(kind == 3, F.when(i % 2 == 0, long("m", 4)).otherwise(long("m", 24)))
        .when((kind == 4) & (i % 2 == 0), F.translate(F.substring(alnum, F.lit(1), (9 + i % 6).cast("int")), "0123456789", "qwkzjvxbhd"))
        .when(kind == 4, F.concat(F.substring(alnum, F.lit(1), (4 + i % 4).cast("int")), pick("z", ["!", "#", "$", "@", "%!"]), F.substring(alnum, 20, 5)))
        .when(i % 10 < 4, F.substring(hashed("h"), 1, 40))
        .when(i % 10 == 4, F.upper(F.substring(hashed("h"), 1, 40)))
        .when(i % 10 < 7, F.substring(F.translate(b64, "+/=", "xyz"), 1, 32))
        .when(i % 10 == 7, b64)
        .when(i % 10 == 8, F.concat(pick("p", ["sk_live_", "ghp_", "xoxb-", "AKIA"]), F.substring(F.translate(b64, "+/=", "xyz"), 1, 24)))
        .otherwise(F.substring(hashed("h"), 1, 32))
    )
    harmless = (
        F.when(kind < 2, F.concat(F.rpad(F.concat_ws("_", word("a"), word("b")), (7 + i % 8).cast("int"), "_item"), (i % 10).cast("string")))
        .when(kind == 3, F.when(i % 2 == 0, long("o", 4)).otherwise(long("o", 24)))
        .when(kind == 4, F.rpad(F.concat(word("a"), pick("y", ["", "-", "_", "."]), word("b"), pick("y", ["", "-", "_", "."]), word("c")), (8 + i % 12).cast("int"), "s"))
        .when(i % 10 < 2, F.substring(hashed("n"), 1, 40))
        .when(i % 10 == 2, F.concat_ws("-", *(F.substring(hashed("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
        .when(i % 10 < 5, F.concat_ws("_", F.lit("your"), word("a"), word("b"), F.lit("1234")))
        .when(i % 10 == 5, F.concat_ws("-", word("a"), word("b"), word("c"), (i % 97).cast("string")))
        .when(i % 10 == 6, F.concat(F.lit("xxxxxxxxxxxxxxxx"), (i % 10).cast("string")))
        .when(i % 10 == 7, F.concat_ws("/", word("a"), word("b"), F.lit("v2"), word("c"), F.concat(word("d"), F.lit(".js"))))
        .when(i % 10 == 8, F.concat(word("a"), F.initcap(word("b")), F.initcap(word("c")), F.initcap(word("d")), F.lit("2")))
        .otherwise(F.substring(hashed("n"), 1, 32))
    )
    label = (F.pmod(F.xxhash64(i, F.lit("label")), F.lit(2))).cast("int")
    lead = pick("w", ["the value of ", "and then ", "it was ", "see ", "in this way ", ""])
    sign = pick("s", [' = "', ": ", "=", ' = "', " = '"])
    good_word = pick("g", ["token", "secret", "password", "api_key", "access_key", "auth", "TOKEN", "client_secret"])
    bad_word = pick("q", ["commit ", "sha256:", "checksum ", "uuid ", "hash = ", "example token = ", "id=", "see ", "in ", "", "version "])
    tail = F.when(sign.endswith('"'), F.lit('"')).when(sign.endswith("'"), F.lit("'")).otherwise(F.lit(" "))
    fake = (label == 0) & (F.when(kind < 2, i % 2 == 0).otherwise((kind != 3) & (i % 10).between(3, 8)))
    before = F.when(kind == 4, F.concat(lead, good_word, F.lit(' = "'))).when(label == 1, F.concat(lead, good_word, sign)).when(fake & (i % 3 == 0), F.concat(lead, good_word, sign)).when((kind == 3) & (i % 3 > 0), F.lit("data:image/png;base64,")).otherwise(F.concat(lead, bad_word))
    after = F.when(kind == 4, F.lit('"')).when((label == 1) | (fake & (i % 3 == 0)), tail).otherwise(F.lit(" "))
    path = F.when((label == 0) & (i % 4 == 0), pick("t", ["tests/data.py", "docs/guide.md", "package-lock.json"])).otherwise(pick("t", ["src/main.py", "app/config.yml", "notes.txt"]))
    return spark.range(n).select(
        F.when(label == 1, secret).otherwise(harmless).alias("hit"), before.alias("before"), after.alias("after"), path.alias("path"), label.alias("label")
    )


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """A forest fitted on labelled findings, or None if they don't have both labels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.where(F.col("label").isin(0, 1) & F.col("hit").isNotNull() & (F.length("hit") > 0)).select(
        "hit", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "path", F.col("label").cast("double").alias("label")
    )
    if rows.select("label").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(rows)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=4, featureSubsetStrategy="onethird").fit(data)


def scan(docs: DataFrame, model, threshold: float = THRESHOLD, path: str = "source") -> DataFrame:
    """One row per finding: (doc_id, start, end, sha256 of the secret, probability)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    text = F.col("text").cast("string")
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    # A text without such a run of 16 characters, or of 8 beside a secret word, or a quoted value of one, is not taken apart.
    possible = text.rlike(rf"{SIGN}{{{LONG - 2}}}") | text.rlike(rf"(?i){BESIDE}{TOKEN}") | text.rlike(QUOTED)
    rows = docs.where(possible).select("doc_id", where.alias("path"), F.inline(candidates(text)))
    # Features of a list inside a generator would be computed again for each; the table is small.
    rows = staged(rows, "secret-candidates")
    if model is None:
        scored = rows.withColumn("probability", F.lit(0.5))
    else:
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(rows))
        scored = model.transform(data).withColumn("probability", vector_to_array("probability")[1])
    return scored.where(F.col("probability") >= threshold).select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2("hit", 256).alias("secret_sha256"), "probability"
    )
