"""Secret scan: candidates by shape, then a random forest on length, character transitions, dictionary coverage, path and
neighbouring words removes false positives. DataFrame and Spark ML functions only; the forest runs in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, word_array

#: Characters of a candidate by itself, and of one behind an assignment to a key word.
MIN_LENGTH = 16
MIN_ASSIGNED = 8
CORE = r"[A-Za-z0-9][A-Za-z0-9+/_.~=-]{6,}[A-Za-z0-9=]"
KEY_WORDS = r"(?i)(pass(word|wd|phrase)?|secret|token|api_?-?key|access_?-?key|private_?-?key|auth|bearer|credential)s?\W*$"
#: Characters of the words before and after that features look at.
NEAR = 128
#: In a word: a key name with = or :, the value behind it (quoted, or up to a delimiter or the next name), the user part of an address,
#: and a core that is an assignment by itself. Values of one kind don't overlap, so all of a word's values are no more than a few
#: times its length.
NAME = r"(?i:(?:pass(?:word|wd|phrase)?|secret|token|api_?-?key|access_?-?key|private_?-?key|auth|bearer|credential)s?|(?:pass|secret|token|api_?key)\w{0,64})[\"'`\\\])]{0,4}(?:=>|:=|={1,3}|:{1,2})"
VALUE = r"""(?:\\?"[^"]{%d,}|\\?'[^']{%d,}|`[^`]{%d,}|(?:(?!%s)[^\s"'`\\,;&<>(){}\[\]|]){%d,}+)""" % (MIN_ASSIGNED, MIN_ASSIGNED, MIN_ASSIGNED, NAME, MIN_ASSIGNED)
USER = r"//[^\s/@:]*:"
SELF = r"(?i)^(pass(word)?|secret|token|api_?key)\w*="
OTHER_WORDS = r"(?i)(commit|sha\d*|md5|checksum|digest|hash|uuid|guid|revision|version|build|id|isbn|order|invoice)\W*$"
SAMPLE_PATH = r"(?i)(test|example|sample|fixture|mock|demo|doc)"
PLACEHOLDER = r"(?i)(example|changeme|placeholder|dummy|your[_-]|xxxx|0000|1234567|<[^<>]*>|\.\.\.)"
DICTIONARY_WORDS = 400
FEATURES = [
    "length", "digits", "uppers", "lowers", "symbols", "distinct",
    "letter_digit", "case_turns", "vowel_turns", "longest_letters", "hex_only",
    "coverage", "placeholder", "path_sample", "path_depth",
    "key_before", "assigned", "quoted", "other_before", "plain_before", "plain_after",
]


@dataclass(frozen=True)
class Scanner:
    forest: RandomForestClassificationModel
    dictionary: list


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The `size` most frequent words of 3 to 12 letters over all texts, ties by word. Counting is partial before the shuffle;
    `size` words reach the driver."""
    words = docs.select(F.explode(word_array(F.col("text"))).alias("w")).where(F.length("w").between(3, 12))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("w").rlike(r"^\p{L}+$"))
    low = counts.groupBy(F.lower("w").alias("w")).agg(F.sum("n").alias("n"))
    return [r["w"] for r in low.orderBy(F.desc("n"), "w").limit(size).collect()]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, word_no (from 0), quoted (whether the word has a quote), part_no, value, before2, before1 and after of every candidate in
    every whole text.

    Candidates of a word are the values behind a key word with = or : (in the word or before it, MIN_ASSIGNED characters) or in
    the user part of an address, then every core of MIN_LENGTH characters, or of MIN_ASSIGNED behind a key word with = or :.
    A core equal to an assigned value of its word is left out. Cores are parted at inner =; a core without a part long enough stays whole. before1 is the
    name in the word where there is one. Values without quotes end at white space, the next name or one of , ; & < > | and brackets,
    without punctuation at the end. before2 and before1 are the last NEAR characters of what stands there, after the first. Words may be as
    long as texts: rows carry no word, and work and rows grow with its length. Null and empty texts have none."""
    words = docs.select("doc_id", F.col(path).alias("path"), F.explode(F.array(word_array(F.col("text")))).alias("ws"))
    w = lambda i, k: F.coalesce(F.get(F.col("ws"), i + k), F.lit(""))

    def wanted(i: Column) -> Column:
        word = F.get(F.col("ws"), i)
        n = F.length(word)
        return (n >= MIN_LENGTH) | ((n > MIN_ASSIGNED) & (F.contains(word, F.lit("=")) | F.contains(word, F.lit(":")))) | ((n >= MIN_ASSIGNED) & (i > 0) & _behind(w(i, -1), w(i, -2)))

    at = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), wanted)
    rows = F.transform(at, lambda i: F.struct(i.alias("word_no"), F.get(F.col("ws"), i).alias("word"), F.right(w(i, -2), F.lit(NEAR)).alias("before2"), F.right(w(i, -1), F.lit(NEAR)).alias("before1"), F.left(w(i, 1), F.lit(NEAR)).alias("after")))
    out = words.where(F.size("ws") > 0).select("doc_id", "path", F.explode(rows).alias("c")).select("doc_id", "path", "c.*")
    out = out.withColumn("wide", _wide()).withColumns({"cores": F.regexp_extract_all("word", F.lit(CORE), F.lit(0)), "gaps": F.split("word", CORE, -1)})
    parts = F.flatten(F.transform("cores", lambda c, k: _parts(c, k)))
    out = out.withColumn("known", F.transform("wide", lambda s: s["value"]))
    out = out.withColumn("parts", parts).withColumn("others", F.array_except(F.transform("parts", lambda s: s["value"]), "known"))
    # a part is new if it is among the others or, where that is the longer list, not among the known
    new = lambda s: F.when(F.size("others") < F.size("known"), F.array_contains("others", s["value"])).otherwise(~F.array_contains("known", s["value"]))
    alone = F.concat(F.filter("wide", lambda s: F.length(s["value"]) >= MIN_ASSIGNED), F.filter("parts", new))
    out = out.withColumn("quoted", F.col("word").rlike("[\"'`]"))
    return out.select("doc_id", "path", "word_no", "quoted", "after", F.posexplode(alone).alias("part_no", "v")).select("doc_id", "path", "word_no", "quoted", "part_no", "v.value", "v.before2", "v.before1", "after")


def _found(value: Column, before2: Column, before1: Column) -> Column:
    return F.struct(value.alias("value"), before2.alias("before2"), before1.alias("before1"))


def _wide() -> Column:
    """Values behind an assignment, of any characters: at the head of the word, behind names in it, and in user parts."""
    before1, before2 = F.col("before1"), F.col("before2")
    bare = lambda x: F.when(x.rlike(r"^\\?[\"'`]"), F.regexp_replace(x, r"^\\?[\"'`]|\\+$", "")).otherwise(F.regexp_replace(x, r"(?<![.,;:!?*#&\\])[.,;:!?*#&\\]+$", ""))
    head = F.regexp_extract("word", r"^[(\[{<]*(" + VALUE + ")", 1)
    heads = F.filter(F.array(_found(bare(head), before2, before1)), lambda s: _behind(before1, before2))
    named = F.transform(F.regexp_extract_all("word", F.lit(f"(?=({NAME}{VALUE}))"), F.lit(1)), lambda m: let(F.regexp_extract(m, "^" + NAME, 0), lambda name: _found(bare(F.substr(m, F.length(name) + 1)), before1, F.regexp_replace(name, "[^=:]+$", ""))))
    user = F.transform(F.regexp_extract_all("word", F.lit(USER + r"[^\s/@]{%d,}(?=@)" % MIN_ASSIGNED), F.lit(0)), lambda m: let(F.regexp_extract(m, "^" + USER, 0), lambda name: _found(F.substr(m, F.length(name) + 1), before1, name)))
    return F.concat(heads, named, user)


def _parts(core: Column, k: Column) -> Column:
    """The parts of core k that are long enough, else the core if it is."""
    before1, before2 = F.col("before1"), F.col("before2")
    near = F.right(F.regexp_replace(F.concat(F.when(k > 0, F.get("cores", k - 1)).otherwise(""), F.get("gaps", k)), r"(?<![\"'`\\(\[{>])[\"'`\\(\[{>]+$", ""), F.lit(NEAR))
    inside = (k > 0) | F.right(near, F.lit(1)).isin("=", ":")
    first = lambda v: _found(v, F.when(inside, before1).otherwise(before2), F.when(inside, near).otherwise(before1))
    enough = lambda s: F.length(s["value"]) >= F.when(_behind(s["before1"], s["before2"]) | s["value"].rlike(SELF), MIN_ASSIGNED).otherwise(MIN_LENGTH)

    def cut(ps: Column) -> Column:
        value = lambda p, j: F.when(j < F.size(ps) - 1, F.rtrim(p, F.lit("="))).otherwise(p)
        return F.filter(F.transform(ps, lambda p, j: F.when(j > 0, _found(value(p, j), before1, F.get(ps, j - 1))).otherwise(first(value(p, j)))), enough)

    whole = F.filter(F.array(first(core)), enough)
    return let(let(F.split(core, "(?<==)(?=[^=])", -1), cut), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))


def _behind(before1: Column, before2: Column) -> Column:
    """Whether what follows before1 is assigned to a key word, or the secret of a user part."""
    return (F.right(before1, F.lit(1)).isin("=", ":") & (before1.rlike(KEY_WORDS) | before2.rlike(KEY_WORDS) | before1.rlike(NAME + "$"))) | before1.rlike("^" + USER + "$")


def _assigned() -> Column:
    return _behind(F.col("before1"), F.col("before2")) | F.col("value").rlike(SELF)


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds FEATURES as doubles; shares are of the value's length."""
    v, low = F.col("value"), F.lower("value")
    n = F.length("value").cast("double")
    share = lambda pattern, of=v: F.regexp_count(of, F.lit(pattern)) / n
    plain = lambda c: F.col(c).rlike(r"^\W*\p{L}*\W*$")
    known = "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")" if words else "(?!)"
    flag = lambda c: c.cast("double")
    made = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64.0)),
        "letter_digit": share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "case_turns": share("(?<=[a-z])(?=[A-Z])"),
        "vowel_turns": share("(?<=[aeiou])(?=[b-df-hj-np-tv-z])", low),
        "longest_letters": F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), lambda x: F.length(x))) / n,
        "hex_only": flag(v.rlike("^[0-9a-fA-F]+$")),
        "coverage": 1 - F.length(F.regexp_replace(low, known, "")) / n,
        "placeholder": flag(v.rlike(PLACEHOLDER)),
        "path_sample": flag(F.coalesce(F.col("path"), F.lit("")).rlike(SAMPLE_PATH)),
        "path_depth": F.least(F.regexp_count(F.coalesce(F.col("path"), F.lit("")), F.lit("/")), F.lit(10)).cast("double"),
        "key_before": flag(F.col("before1").rlike(KEY_WORDS) | F.col("before2").rlike(KEY_WORDS) | F.col("before1").rlike(f"{NAME}$|^{USER}$")),
        "assigned": flag(_assigned()),
        "quoted": flag(F.col("quoted")),
        "other_before": flag(F.col("before1").rlike(OTHER_WORDS) | F.col("before2").rlike(OTHER_WORDS)),
        "plain_before": flag(plain("before1")),
        "plain_after": flag(plain("after")),
    }
    return found.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in made.items()})


def _assemble(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows)


def labelled_findings(spark: SparkSession, words: list[str], n: int = 12_000, seed: int = 5) -> DataFrame:
    """n made-up findings with is_secret: random credentials in assignments and bare forms, and look-alikes (long words,
    revisions, identifiers, numbers, addresses, placeholders). Nothing in them comes from a text but dictionary words."""
    dic = F.array(*[F.lit(w) for w in (words or ["word", "other"])])
    r = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1 << 30))
    word = lambda k: F.get(dic, F.pmod(r(k), F.size(dic)).cast("int"))
    pick = lambda k, *xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(r(k), F.lit(len(xs))).cast("int"))
    key = F.sha2(F.concat_ws("-", "id", F.lit(str(seed))), 512)
    b64 = F.translate(F.base64(F.unhex(key)), "\n\r", "")
    alnum = F.regexp_replace(b64, "[+/=]", "")
    name = pick(1, "token", "password", "secret", "api_key", "access_key", "auth", "passwd", "credential")
    quote = pick(2, '"', "'", "")
    long_word = F.concat(*[word(20 + k) for k in range(4)])
    tail = pick(3, "", ".", ",", "***", "###", "!!", "&&&", ";")
    bare = lambda v: (v, word(4), word(5))
    secret = [
        (F.concat(quote, F.substring(key, 1, 40), quote, tail), name, F.lit("=")),
        (F.concat(quote, F.substring(alnum, 1, 32), quote, tail), word(6), F.concat(name, F.lit(":"))),
        (F.concat(quote, F.substring(b64, 1, 44), quote), name, F.lit("=")),
        (F.concat(quote, F.substring(alnum, 1, 14), quote, tail), name, pick(7, "=", ":")),
        bare(F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16)), tail)),
        bare(F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36), tail)),
        (F.concat(F.substring(alnum, 3, 48), tail), word(6), pick(8, "Bearer", "token:", "secret=")),
        (F.concat(F.substring(key, 9, 64), tail), name, pick(9, "=", ":")),
    ]
    other = [
        bare(F.concat(long_word, tail)),
        bare(F.concat(F.initcap(long_word), word(30), tail)),
        (F.concat(F.substring(key, 1, 40), tail), word(6), pick(10, "commit", "revision", "sha1:", "digest")),
        (F.concat_ws("-", F.substring(key, 1, 8), F.substring(key, 9, 4), F.substring(key, 13, 4), F.substring(key, 17, 4), F.substring(key, 21, 12)), pick(11, "id", "uuid", "order"), pick(12, "=", ":", "is")),
        bare(F.concat(F.lpad(r(13).cast("string"), 9, "4"), F.lpad(r(14).cast("string"), 9, "7"), tail)),
        bare(F.concat(word(15), F.lit("."), F.pmod(r(16), F.lit(99)).cast("string"), F.lit("@"), word(17), F.lit(".example.com"), tail)),
        (F.concat(quote, pick(18, "changeme_example_1", "xxxxxxxxxxxxxxxxxxxx", "your_token_goes_here", "<placeholder_value>", "1234567890abcdef"), quote), name, pick(19, "=", ":")),
        bare(F.concat_ws("/", word(31), word(32), word(33), word(34))),
        bare(F.concat_ws(".", F.pmod(r(35), F.lit(256)).cast("string"), F.pmod(r(36), F.lit(256)).cast("string"), F.pmod(r(37), F.lit(256)).cast("string"), F.lit("1234"))),
        bare(F.upper(F.concat(long_word, tail))),
    ]
    kinds = [(*x, 1.0) for x in secret] + [(*x, 0.0) for x in other]
    at = F.pmod(r(0), F.lit(len(kinds))).cast("int")
    out = spark.range(n).select(
        F.explode(F.array(F.get(F.array(*[F.struct(w.alias("word"), b2.alias("before2"), b1.alias("before1"), F.lit(y).alias("is_secret")) for w, b2, b1, y in kinds]), at))).alias("f"),
        F.concat(pick(40, "src", "lib", "test", "docs", "app"), F.pmod(r(41), F.lit(50)).cast("string")).alias("path"),
        word(42).alias("after"),
    )
    found = out.select("path", "after", "f.*").withColumn("value", F.regexp_extract("word", CORE, 0)).withColumn("quoted", F.col("word").rlike("[\"'`]"))
    return found.where(F.length("value") >= MIN_ASSIGNED)


def fit(docs: DataFrame, findings: DataFrame | None = None, trees: int = 24, depth: int = 8, dictionary_words: int = DICTIONARY_WORDS, max_findings: int = 12_000, seed: int = 5) -> Scanner:
    """Learns the dictionary from all texts and the forest from at most about max_findings labelled findings (columns value,
    quoted, before2, before1, after, path, is_secret 0/1), picked by hash; made-up ones where none are given."""
    spark = docs.sparkSession
    words = dictionary(docs, dictionary_words)
    rows = labelled_findings(spark, words, max_findings, seed) if findings is None else findings
    share = min(1.0, max_findings / max(rows.count(), 1)) if findings is not None else 1.0
    rows = rows.where(F.pmod(F.xxhash64("value", "before1", "before2"), F.lit(1_000_000)) < int(share * 1_000_000))
    train = materialize(with_features(rows, words).select(*FEATURES, F.col("is_secret").cast("double").alias("label")), "secret-train")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=3).fit(_assemble(train))
    return Scanner(forest, words)


def score(found: DataFrame, scanner: Scanner) -> DataFrame:
    """found with p_secret (rounded to 6 places)."""
    scored = scanner.forest.transform(_assemble(with_features(found, scanner.dictionary)))
    return scored.withColumn("p_secret", F.round(vector_to_array("probability")[1], 6)).drop("features", "rawPrediction", "probability", "prediction", *FEATURES)


def scan(docs: DataFrame, scanner: Scanner, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row a candidate: doc_id, path, word_no, quoted, part_no (place among the word's candidates), value, before2, before1,
    after, p_secret and is_secret (p_secret >= threshold).

    Null and empty texts and texts without candidates give no rows; null paths and ids are returned as they are; repeated rows
    give each their candidates; a core that stands in a word twice is two candidates; an empty table gives no rows; other
    columns are not looked at. No shuffle."""
    return score(candidates(docs.select("doc_id", path, "text"), path), scanner).withColumn("is_secret", F.col("p_secret") >= threshold)


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with the value of every finding that is_secret replaced in the text of its document, longest values first."""
    values = found.where("is_secret").groupBy("doc_id").agg(F.collect_set("value").alias("vs"))
    out = docs.join(values.withColumnsRenamed({"doc_id": "_tl_id", "vs": "_tl_vs"}), F.col("doc_id").eqNullSafe(F.col("_tl_id")), "left")
    order = F.array_sort("_tl_vs", lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).otherwise(F.when(x < y, -1).when(x > y, 1).otherwise(0)))
    text = F.aggregate(order, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark)))
    return out.withColumn("text", F.when(F.col("_tl_vs").isNull(), F.col("text")).otherwise(text)).drop("_tl_id", "_tl_vs")
