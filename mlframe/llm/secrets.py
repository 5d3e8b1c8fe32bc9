"""Secret scan: pattern candidates, and a random forest that removes false positives. DataFrame functions only."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns, words and formats (fixed values).
KEYWORD = r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth[_-]?key)"
ASSIGNED = rf"(?i:{KEYWORD})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?[^\s\"',;]{{6,}}+"
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
CANDIDATE = rf"{ASSIGNED}|{BARE}"
HEAD = rf"^(?i:{KEYWORD})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
KNOWN = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})"
HARMLESS = r"(?i)\b(?:commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|example|sample|dummy|placeholder|test|version|build|order|invoice|isbn|phone|card|tel|revision|etag|path|file|image|page)\W*$"
PATHLIKE = r"(?:https?://|www\.|[/\\~.][\w./\\-]*)$"
PLACEHOLDER = r"(?i)^(?:x{4,}|\*{4,}|\.{3,}|<.*>|\$\{.*\}|(?:your|my|change|example|test|dummy|sample|none|null|true|false)[\w-]*)"
#: Words of prose and of code; a random string has few of them (fixed values; ``fit_forest`` takes a longer list).
DICTIONARY = """
the and ing ion ent tion her for that this with from have not you are was all one out word other more time first people over after also than then there where when which
que una los las para con por como des les pour dans avec sur und der die das nicht mit auf ein eine
access account action address admin archive array article asset backup base block body branch build button cache card cell change channel check class client cloud cluster code color column comment config console content copy count country data date default detail device document domain drive element email entry error event example export feature field file filter folder form format group guide handler header help history home host image import index input item job json key language layer level library license light line link list load local login main market master member memory menu message method metric mobile mode model module name network news note number object option order output owner package page panel part password path
""".split()  # noqa: SIM905

#: Characters by which transitions are counted: letters in either case, one sign for digits and one for all else.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0-"

FEATURES = ("length", "transitions", "changes", "digits", "upper", "lower", "distinct", "vowels", "hex", "covered", "slashes", "assigned", "keyword", "harmless", "path", "known", "placeholder", "quoted")
#: Characters of context on either side of a candidate.
CONTEXT = 40


class Forest(NamedTuple):
    """Trees (nested tuples of feature number, threshold, left, right, or a vote), the log-probability of each pair of SYMBOLS that a string of words has, and the words of the dictionary."""

    trees: list
    transitions: list[float]
    dictionary: list[str]


def signs(value: Column) -> Column:
    """Pieces of at most 1,024 characters of a value, each as an array of SYMBOLS: no array has an element for every character of a long value."""
    plain = F.translate(F.lower(value), "123456789", "000000000")
    return F.transform(F.regexp_extract_all(F.regexp_replace(plain, "[^a-z0]", "-"), F.lit("(?s).{1,1024}"), F.lit(0)), lambda piece: F.split(piece, ""))


def place(sign: Column) -> Column:
    return F.instr(F.lit(SYMBOLS), sign) - 1


def learn_transitions(strings: DataFrame) -> list[float]:
    """Log-probability of the second sign after the first in the column ``value``, one count added everywhere; one number for each pair of SYMBOLS."""
    size = len(SYMBOLS)
    pieces = strings.select(F.explode(signs(F.col("value"))).alias("s")).where(F.size("s") > 1)
    pairs = pieces.select(F.explode(F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: place(a) * size + place(b))).alias("pair"))
    counts = [1.0] * size * size
    for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect():
        counts[r["pair"]] += r["n"]
    totals = [sum(counts[k * size : (k + 1) * size]) for k in range(size)]
    return [math.log(c / totals[k // size]) for k, c in enumerate(counts)]


def mean_transition(value: Column, transitions: list[float]) -> Column:
    """Mean of ``transitions`` over neighbouring characters of a value; 0 with fewer than two."""
    table = F.array(*[F.lit(float(x)) for x in transitions])
    size = len(SYMBOLS)
    of = lambda s: F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(0.0), lambda total, k: total + table[place(s[k - 1]) * size + place(s[k])])
    found = F.aggregate(signs(value), F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n")), lambda done, s: F.struct((done["total"] + F.when(F.size(s) > 1, of(s)).otherwise(0.0)).alias("total"), (done["n"] + F.size(s) - 1).alias("n")))
    return F.when(found["n"] > 0, found["total"] / found["n"]).otherwise(0.0)


def features(match: Column, left: Column, right: Column, transitions: list[float], dictionary: list[str]) -> Column:
    """struct of value and FEATURES for a candidate and the text around it."""
    value = F.regexp_replace(match, HEAD, "")
    assigned = match.rlike(HEAD)
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda pattern: (F.length(F.regexp_replace(value, pattern, "")) * F.lit(1.0)) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "\u0001"), "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    one = lambda c: c.cast("double")
    letters = lambda c: F.array_distinct(F.split(c, ""))
    # Of long values by pieces, so no array has an element for every character.
    distinct = F.when(n <= 1024, F.size(letters(value))).otherwise(F.size(F.aggregate(F.regexp_extract_all(value, F.lit("(?s).{1,1024}"), F.lit(0)), F.array().cast("array<string>"), lambda found, piece: F.array_union(found, letters(piece)))))
    return F.struct(
        value.alias("value"),
        one(F.least(F.length(value), F.lit(200))).alias("length"),
        mean_transition(value, transitions).alias("transitions"),
        ((F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n).alias("changes"),
        share("[^0-9]").alias("digits"),
        share("[^A-Z]").alias("upper"),
        share("[^a-z]").alias("lower"),
        (distinct / F.least(n, F.lit(40))).alias("distinct"),
        share("(?i)[^aeiou]").alias("vowels"),
        one(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        (1 - F.length(F.regexp_replace(F.lower(value), "(?:" + "|".join(map(re.escape, sorted(set(dictionary), key=lambda w: (-len(w), w)))) + ")", "")) / n).alias("covered"),
        share("[^/\\\\.]").alias("slashes"),
        one(assigned).alias("assigned"),
        one(F.concat(left, match).rlike(rf"(?i){KEYWORD}\W{{0,8}}\S*$")).alias("keyword"),
        one(left.rlike(HARMLESS)).alias("harmless"),
        one(left.rlike(PATHLIKE) | right.rlike(r"^\.[A-Za-z]{2,4}\b")).alias("path"),
        one(value.rlike(KNOWN)).alias("known"),
        one(value.rlike(PLACEHOLDER)).alias("placeholder"),
        one(left.rlike("[\"'=:]\\s*$") | match.rlike("[\"']")).alias("quoted"),
    )


def labelled_findings(spark: SparkSession, rows: int = 2400, start: int = 0) -> DataFrame:
    """Labelled findings by rule, for want of a table of reviewed ones: match, before, after, label (1: a secret).

    Every row's strings come from hashes of its number (from ``start`` on), so the table is the same everywhere, and ranges that do not overlap share no row; a user's own reviewed findings of this schema may take its place. Secrets: vendor keys, assigned random values and random values beside a key word. Others: digests and commits, uuids, card and order numbers, paths, urls, identifiers, versions, placeholders and long words.
    """
    number = F.col("id").cast("string")
    hexes = lambda salt: F.sha2(F.concat(F.lit(salt), number), 256)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(hexes(salt))), "[=]", "")
    digits = lambda salt: F.regexp_replace(F.concat(F.conv(F.substring(hexes(salt), 1, 12), 16, 10), F.conv(F.substring(hexes(salt), 13, 12), 16, 10)), "[^0-9]", "")
    pick = lambda salt, words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(words))) + 1).cast("int"))
    prose = ("the men of old were there ", "en la casa de mi ", "und das ist die ", "dans le jardin avec ", "as it was said, ", "")
    key = pick("k", ("password", "token", "secret", "api_key", "passwd", "access_key", "PASSWORD", "Token"))
    equal = pick("e", ("=", " = \"", ": ", "='", ":", " = "))
    size = (F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(28)) + 12).cast("int")
    random = F.when(F.pmod(F.col("id"), F.lit(3)) == 0, F.substring(hexes("a"), 1, 40)).when(F.pmod(F.col("id"), F.lit(3)) == 1, b64("b"))
    random = F.coalesce(random, hexes("c"))
    words = F.concat(pick("w1", ("config", "user", "image", "system", "server")), pick("w2", ("Index", "_data", "-main", "Order", "/file")), pick("w3", ("Default", "-value", "_name", "Request", "/page")), F.substring(digits("w"), 1, 2))
    upper = F.upper(F.regexp_replace(b64("u"), "[+/]", "Q"))
    kinds = [
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), pick("p", prose)),
        (1, F.concat(key, equal, F.substring(random, 1, size)), pick("p", prose)),
        (1, F.concat(key, equal, F.substring(random, 1, size)), pick("p", prose)),
        (1, F.substring(random, 1, F.greatest(size, F.lit(20))), F.concat(pick("p", prose), key, F.lit(" is "))),
        (1, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64("g"), "[+/]", "x"), 1, 36)), pick("p", prose)),
        (0, F.substring(hexes("d"), 1, 40), F.concat(pick("p", prose), pick("h", ("commit ", "sha1 ", "checksum: ", "digest ", "hash ")))),
        (0, F.regexp_replace(F.substring(hexes("i"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.concat(pick("p", prose), pick("h", ("uuid ", "id ", "", "guid: ")))),
        (0, F.substring(digits("m"), 1, 16), pick("p", prose)),
        (0, F.concat(words, F.lit("/"), F.substring(digits("s"), 1, 5), F.lit("/"), pick("w4", ("index", "main", "home"))), F.concat(pick("p", prose), pick("h", ("https://example.com/", "/home/user/", "./", "path ")))),
        (0, words, pick("p", prose)),
        (0, F.concat(key, equal, pick("x", ("xxxxxxxx", "<password>", "${TOKEN}", "changeme", "example-value", "********"))), pick("p", prose)),
        (0, F.concat(F.lit("release-"), F.substring(digits("v"), 1, 4), F.lit("-build-"), F.substring(digits("v"), 5, 3)), F.concat(pick("p", prose), F.lit("version "))),
    ]
    what = F.pmod(F.col("id"), F.lit(len(kinds)))
    chosen = F.coalesce(*[F.when(what == k, F.struct(F.lit(label).alias("label"), match.alias("match"), before.alias("before"))) for k, (label, match, before) in enumerate(kinds)])
    return spark.range(start, start + rows).select(chosen.alias("c"), pick("q", (" and then it", "\" of the", ", la", "", ". Und")).alias("after")).select("c.match", "c.before", "after", "c.label")


def fit_forest(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7, max_findings: int = 50_000, dictionary: list[str] = DICTIONARY) -> Forest:
    """Random forest on labelled findings (match, before, after, label), at most ``max_findings`` of them, drawn by hash. Transitions are learned from ``dictionary``, whose words also make up a candidate's dictionary coverage, and from what is labelled harmless. Without findings of both labels no candidate is a secret."""
    labels = {r["label"]: r["n"] for r in findings.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    total = sum(labels.values())
    if not (labels.get(0) and labels.get(1)):
        return Forest([0.0], [0.0] * len(SYMBOLS) ** 2, dictionary)
    if total > max_findings:
        findings = findings.where(F.pmod(F.xxhash64("match", "before", "after"), F.lit(1 << 20)) < int((1 << 20) * max_findings / total))
    words = findings.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in dictionary])).alias("value"))
    transitions = learn_transitions(findings.where("label = 0").select(F.regexp_replace("match", HEAD, "").alias("value")).unionAll(words))
    rows = findings.select(features(F.col("match"), F.col("before"), F.col("after"), transitions, dictionary).alias("f"), F.col("label").cast("double").alias("label")).select("f.*", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="6").fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    return Forest([read_tree(t) for t in re.split(r"\n\s*Tree \d+[^\n]*\n", model.toDebugString)[1:]], transitions, dictionary)


def read_tree(text: str):
    """A tree of the printed form: (feature number, threshold, left, right), or the predicted label."""
    lines = iter([line.strip() for line in text.splitlines() if line.strip()])

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        m = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", line)
        left = node()
        next(lines)  # Else
        return int(m[1]), float(m[2]), left, node()

    return node()


def vote(tree, row: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(row[FEATURES[feature]] <= threshold, vote(left, row)).otherwise(vote(right, row))


def vote_in_python(tree, row: dict) -> float:
    """The same as :func:`vote`, for tests."""
    while not isinstance(tree, float):
        feature, threshold, left, right = tree
        tree = left if row[FEATURES[feature]] <= threshold else right
    return tree


def judged(text: Column, docs: DataFrame, forest: Forest, least_score: float, mask: str) -> DataFrame:
    """``docs`` with the columns _matches, _secrets and _redacted for ``text``; a projection."""
    found = docs.withColumn("_matches", F.when(text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))))
    found = found.withColumn("_between", F.when(F.col("_matches").isNotNull(), F.split(text, CANDIDATE, -1)))
    numbers = F.sequence(F.lit(0), F.size("_matches") - 1)
    match, between = (lambda i: F.col("_matches")[i]), (lambda i: F.col("_between")[i])
    found = found.withColumn("_rows", F.transform(numbers, lambda i: features(match(i), F.right(between(i), F.lit(CONTEXT)), F.left(between(i + 1), F.lit(CONTEXT)), forest.transitions, forest.dictionary)))
    found = found.withColumn("_scores", F.transform("_rows", lambda r: sum((vote(t, r) for t in forest.trees[1:]), vote(forest.trees[0], r)) / len(forest.trees)))
    value = lambda i: F.col("_rows")[i]["value"]
    masked = lambda i: F.concat(F.substring(match(i), F.lit(1), F.length(match(i)) - F.length(value(i))), F.lit(mask))
    fixed = lambda i: F.concat(F.when(F.col("_scores")[i] >= least_score, masked(i)).otherwise(match(i)), between(i + 1))
    each = F.transform(numbers, lambda i: F.struct(i.alias("ordinal"), value(i).alias("value"), F.col("_scores")[i].alias("score")))
    found = found.withColumn("_secrets", F.coalesce(F.filter(each, lambda s: s["score"] >= least_score), F.array().cast("array<struct<ordinal:int,value:string,score:double>>")))
    return found.withColumn("_redacted", F.when(F.size("_secrets") > 0, F.concat(between(0), F.array_join(F.transform(numbers, fixed), ""))).otherwise(text))


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.5, mask: str = "<SECRET>") -> DataFrame:
    """Finds secrets in every whole text and masks them; one row per row of ``docs``, a projection without a shuffle.

    Candidates are values assigned to key words (six characters or more) and runs of 16 or more letters, digits and + / _ - with a digit; the forest's share of votes from length, character transitions, dictionary coverage, path and neighbouring words is a candidate's score.

    Columns: doc_id, n_candidates, n_secrets (score of ``least_score`` or more), secrets (array of struct(ordinal among candidates, value, score)), redacted (the text with each secret value replaced by ``mask``; other text unchanged). Null text: zeros, no secrets, redacted null. Repeated rows give repeated rows; an empty table none; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = judged(F.col("text"), base, forest, least_score, mask)
    return found.select("doc_id", F.when(F.col("_matches").isNotNull(), F.size("_matches")).otherwise(0).cast("long").alias("n_candidates"), F.size("_secrets").cast("long").alias("n_secrets"), F.col("_secrets").alias("secrets"), F.col("_redacted").alias("redacted"))


def mask(docs: DataFrame, forest: Forest, text_col: str = "text", chars_col: str = "n_chars", least_score: float = 0.5, mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with secrets masked in ``text_col`` and ``chars_col`` (if there is one) set anew where a text changed; all other columns and all rows stay."""
    found = judged(F.col(text_col), docs, forest, least_score, mask)
    changed = F.size("_secrets") > 0
    out = {text_col: F.col("_redacted")} | ({chars_col: F.when(changed, F.length("_redacted").cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))} if chars_col in docs.columns else {})
    return found.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents``: counts, digests of the values found, and a digest of the masked text."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit_forest(labelled_findings(spark)))
    return found.select("doc_id", "n_candidates", "n_secrets", F.transform("secrets", lambda s: F.sha2(s["value"], 256)).alias("secrets_sha256"), F.transform("secrets", lambda s: s["score"]).alias("scores"), F.sha2("redacted", 256).alias("redacted_sha256"))
