"""Secret scans: a random forest removes false positives among candidates, all in DataFrame functions.

A candidate is a run of at least 16 key characters with a digit in it, the value after
a secret word and ``=`` or ``:`` (of any length and characters, quoted or not), a
key with a fixed prefix, a signed token of three parts, the password in a url, or a whole private-key block.  Its features are its length, its character transitions, the share of it that
dictionary words of the corpus cover, hints in its path, and the words beside it.  The
forest (Spark ML) learns from labelled findings, a frame of

    before string     up to ``BEFORE`` characters before the candidate
    candidate string  the candidate itself
    after string      up to ``AFTER`` characters after it
    path string       where it was found (may be null)
    label double      1 for a secret, 0 for a false positive
    kind string       what a reviewer calls it (optional; ``evaluation`` reports by it)

of which at most ``MAX_FINDINGS`` are used.  ``seeded_findings`` makes such a frame from
known shapes of keys and of harmless strings where no reviewed findings are at hand; what
it teaches is those shapes, so a user with reviewed findings should pass them.

Defined cases: null and empty texts have no candidates; null doc_ids stay; a null
path has no hints; repeated rows give repeated findings; what two patterns find at one place
is one candidate; a very long text is searched whole by one task; a probability at ``CUT`` is
a secret; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import attach, saved

#: Key characters; a run of at least 16 of them with a digit is a candidate.
KEY = r"[A-Za-z0-9_+/\-]"
CANDIDATE = rf"(?<!{KEY})(?=[A-Za-z_+/\-]*+[0-9]){KEY}{{16,}}+={{0,2}}"
#: Words that name a secret before it, words that name something harmless, and hints in paths.
_NAMES = r"(token|secret|passw(or)?d|passwd|api[_\- ]?key|access[_\- ]?key|auth|bearer|credential|private[_\- ]?key)"
SECRET_WORDS = rf"(?i){_NAMES}\W{{0,12}}$"
HARMLESS_WORDS = r"(?i)(commit|sha(1|256)?|md5|checksum|digest|uuid|etag|revision|version|isbn|order|card|phone|id)\W{0,12}$"
HARMLESS_PATHS = r"(?i)(test|example|sample|fixture|docs?/|lock)"
#: The value after a secret word and = or :, up to its closing quote or, unquoted, to white space; and keys of fixed prefixes, with or without a digit.
_SIGN = r"[\"'`]?\s{0,4}(?:=>|:=|==?|:)\s{0,4}"
_NAMED = rf"(?<=(?i:{_NAMES}){_SIGN}"
VALUE = rf"(?<=[=:>\s\"'`])(?![=>\s\"'`])(?:{_NAMED}\")[^\"\r\n]+(?=\")|{_NAMED}')[^'\r\n]+(?=')|{_NAMED}`)[^`\r\n]+(?=`)|{_NAMED}[\"'`]?)[^\s\"'`]*[^\s\"'`,;])"
NAMED = rf"(?i){_NAMES}{_SIGN}"
FIXED = (
    r"(?:(?:AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}"
    r"|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})"
)
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[A-Za-z0-9+/=\s\\:,\-]*?-----END [A-Z ]{0,32}PRIVATE KEY-----"
URL_PASSWORD = r"(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/@\"'<>]{1,256}(?=@[A-Za-z0-9])"
PREFIXED = rf"(?<!{KEY}){FIXED}(?!{KEY})|{KEY_BLOCK}|{URL_PASSWORD}"
#: What stands before the password in a url.
URL_BEFORE = r"://[^\s/:@]{1,64}:$"
#: Words of this many letters or more, seen this often in the corpus, are dictionary words.
MIN_LETTERS, MIN_COUNT = 4, 5
#: Characters of context kept on either side.
BEFORE, AFTER = 40, 20
#: Neighbouring matches that context is put together from.
NEIGHBOURS = 7
FEATURES = ["length", "letter_digit", "case_change", "digit_share", "upper_share", "hex", "distinct_share", "covered", "secret_word", "harmless_word", "assigned", "quoted", "fixed", "symbols", "word_before", "word_after", "harmless_path"]
#: A finding at or above this probability is a secret.
CUT = 0.5
#: Bound of the labelled findings that training reads.
MAX_FINDINGS = 20_000


def _findings(pattern: str) -> Column:
    """An array of (found, gap, before, after), one for each match of ``pattern`` in ``text``.

    ``gap`` is the number of characters since the match before.  Context is put together from
    the neighbouring matches and what lies between them, so that a text of many matches
    costs no more for each; ``NEIGHBOURS`` of them are long enough, as a match stands at least
    six characters after the one before."""
    found, between = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)  # the i-th piece stands before the i-th match

    def around(zipped: Column, i: Column) -> Column:
        def part(field: str, k: Column) -> Column:
            return F.coalesce(F.when(k >= 0, F.get(zipped, k)[field]), F.lit(""))

        back = [x for k in range(NEIGHBOURS, 0, -1) for x in (part("between", i - k), part("found", i - k))]
        ahead = [x for k in range(1, NEIGHBOURS + 1) for x in (part("between", i + k), part("found", i + k))]
        own = F.get(zipped, i)
        before, after = F.concat(*back, own["between"]), F.concat(*ahead)
        return F.struct(own["found"].alias("found"), F.length(own["between"]).alias("gap"), F.right(before, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"))

    def placed(zipped: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(zipped) - 2), lambda i: around(zipped, i))

    # One element: the arrays are made once and bound to a name for all indices.
    both = F.array(F.arrays_zip(found.alias("found"), between.alias("between")))
    every = F.flatten(F.transform(both, placed))
    return F.when(F.col("text").rlike(NAMED if pattern == VALUE else pattern) & (F.size(found) > 0), every).otherwise(F.array().cast("array<struct<found:string,gap:int,before:string,after:string>>"))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, start (characters from 0), candidate, before, after: a row for each candidate.

    Places are running sums over a text's matches, which meet in one task; texts don't travel."""
    text = F.col("text").cast("string")
    texts = docs.where(text.rlike(CANDIDATE) | text.rlike(NAMED) | text.rlike(PREFIXED)).select("doc_id", F.col(path).cast("string").alias("path"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    lists = F.array(*map(_findings, (CANDIDATE, VALUE, PREFIXED)))
    each = texts.select("row", "doc_id", "path", F.posexplode(lists).alias("kind", "c")).select("row", "doc_id", "path", "kind", F.posexplode("c").alias("pos", "c"))
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("c.gap").cast("long") + F.length("c.found")).over(upto) - F.length("c.found")
    rows = each.select("row", "doc_id", "path", start.alias("start"), F.col("c.found").alias("candidate"), F.col("c.before").alias("before"), F.col("c.after").alias("after"))
    # What two patterns find at the same place is one candidate.
    return rows.dropDuplicates(["row", "start", "candidate"]).drop("row")


def dictionary(docs: DataFrame) -> DataFrame:
    """Words (a-z only) that the whole corpus has at least ``MIN_COUNT`` times."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word"))
    return words.where(F.length("word") >= MIN_LETTERS).groupBy("word").count().where(F.col("count") >= MIN_COUNT).select("word")


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """candidate, the share of its characters in letter runs that are dictionary words, and its rows in ``found``."""
    distinct = found.groupBy("candidate").agg(F.count(F.lit(1)).alias("rows"))
    runs = distinct.select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(f"[a-z]{{{MIN_LETTERS},}}"), F.lit(0))).alias("word"))
    shares = runs.join(words, "word").groupBy("candidate").agg((F.sum(F.length("word")) / F.first(F.length("candidate"))).alias("covered"))
    return saved(distinct.join(shares, "candidate", "left"))


def featured(found: DataFrame, covered: DataFrame) -> DataFrame:
    c, length = F.col("candidate"), F.length("candidate")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / length

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("double")

    # One string may be found over and over.
    out = attach(found, covered, "candidate", "rows").drop("rows").withColumns({
        "length": length.cast("double"),
        "letter_digit": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "case_change": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / length,
        "covered": F.coalesce("covered", F.lit(0.0)),
        "secret_word": flag(F.col("before").rlike(SECRET_WORDS)),
        "harmless_word": flag(F.col("before").rlike(HARMLESS_WORDS)),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(F.col("before").rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]")),
        "fixed": flag(c.rlike(f"^({FIXED}|{KEY_BLOCK})$") | F.col("before").rlike(URL_BEFORE)),
        "symbols": share(f"(?!{KEY}|\\s).").cast("double"),
        "word_before": flag(F.col("before").rlike(r"[a-z]{2,}[.,;]?\s+$")),
        "word_after": flag(F.col("after").rlike(r"^[.,;]?\s+[a-z]{2,}")),
        "harmless_path": flag(F.col("path").rlike(HARMLESS_PATHS)),
    })
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(out)


def seeded_findings(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """Labelled findings of known shapes, by ``kind``; the digests of row numbers serve as random strings."""
    shapes = ("hex", "hex", "hex", "upper hex", "base64", "prefixed", "digest", "number", "number", "version", "uuid", "path")
    values_of = ("short value", "letters", "punctuated", "prefixed letters", "mixed case", "word with digit", *["placeholder"] * 4)

    def kind_of(names: tuple[str, ...], at: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int")).alias("kind")

    n = F.col("id")
    hexes = F.sha2(n.cast("string"), 256)
    mixed = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), n.cast("string")), 256))), "=", "")
    digits = F.translate(F.sha2(F.concat(F.lit("d"), n.cast("string")), 512), "abcdef", "")
    pick = F.pmod(F.xxhash64(F.lit("kind"), n), F.lit(12))
    side = F.pmod(F.xxhash64(F.lit("side"), n), F.lit(4))
    name = F.element_at(F.array(*map(F.lit, ("token", "api_key", "SECRET", "password", "auth_token", "access key"))), (F.pmod(F.xxhash64(F.lit("name"), n), F.lit(6)) + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, ("commit", "sha256", "checksum", "uuid", "order", "revision"))), (F.pmod(F.xxhash64(F.lit("name"), n), F.lit(6)) + 1).cast("int"))
    size = F.when(side == 0, 32).when(side == 1, 64).otherwise(40)
    key = F.when(pick <= 2, F.substring(hexes, F.lit(1), size)).when(pick == 3, F.upper(F.substring(hexes, F.lit(1), size))).when(pick == 4, F.substring(mixed, 1, 40)).when(pick == 5, F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))))
    harmless = (
        F.when(pick == 6, F.substring(hexes, F.lit(1), size)).when(pick <= 8, F.substring(digits, 1, 16)).when(pick == 9, F.concat(F.lit("release_candidate_version_"), F.substring(digits, 1, 2)))
        .when(pick == 10, F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 12))).otherwise(F.concat(F.lit("path/to/some/folder/part-"), F.substring(digits, 1, 5)))
    )
    opening = F.when(side % 2 == 0, F.concat(name, F.lit(' = "'))).otherwise(F.concat(name, F.lit(": '")))
    plain = F.when(side % 2 == 0, F.concat(F.lit("see "), label, F.lit(" "))).otherwise(F.lit("and then with "))
    known = spark.range(rows).select(
        F.when(pick <= 5, opening).otherwise(plain).alias("before"),
        F.when(pick <= 5, key).otherwise(harmless).alias("candidate"),
        F.when(pick <= 5, F.when(side % 2 == 0, F.lit('" the next')).otherwise(F.lit("' and"))).otherwise(F.lit(" of the same")).alias("after"),
        F.when(side == 3, F.lit("src/app.py")).otherwise(F.lit("conf/run")).alias("path"),
        (pick <= 5).cast("double").alias("label"),
        kind_of(shapes, pick),
    )
    # Short, letter-only and punctuated values, keys of fixed prefixes, and plain words after the same names.
    kind = F.pmod(F.xxhash64(F.lit("value"), n), F.lit(10))
    letters = F.translate(hexes, "0123456789", "ghijklmnop")
    both = F.concat(F.substring(letters, 1, 5), F.upper(F.substring(letters, 6, 5)), F.substring(digits, 1, 2))
    value = (
        F.when(kind == 0, F.substring(mixed, F.lit(1), 6 + F.pmod(n, F.lit(9)).cast("int"))).when(kind == 1, F.substring(letters, F.lit(1), 8 + F.pmod(n, F.lit(25)).cast("int")))
        .when(kind == 2, F.concat(F.substring(mixed, 1, 5), F.lit("!"), F.substring(mixed, 7, 4), F.lit("@#"), F.substring(mixed, 12, 6))).when(kind == 3, F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))))
        .when(kind == 4, both).when(kind == 5, F.concat(F.substring(letters, 1, 7), F.substring(digits, 1, 1)))
        .otherwise(F.element_at(F.array(*map(F.lit, ("required", "None", "null", "true", "string", "expired", "the", "must", "is", "${VALUE}", "<value>", "os.environ"))), (F.pmod(n, F.lit(12)) + 1).cast("int")))
    )
    bare, loose = side == 2, (kind == 3) & (side == 1)
    leading = F.when(loose, "and then with ").when((kind > 5) | bare, F.concat(name, F.when(side % 2 == 0, "=").otherwise(": "))).otherwise(opening)
    trailing = F.when((kind > 5) | bare | loose, " of the same").otherwise(F.when(side % 2 == 0, '" the next').otherwise("' and"))
    values = spark.range(rows // 2).select(leading.alias("before"), value.alias("candidate"), trailing.alias("after"), F.when(side == 3, "src/app.py").otherwise("conf/run").alias("path"), (kind <= 5).cast("double").alias("label"), kind_of(values_of, kind))
    return known.unionAll(values)


def train(findings: DataFrame, words: DataFrame, trees: int = 24, depth: int = 6, seed: int = 5, max_findings: int = MAX_FINDINGS) -> RandomForestClassificationModel:
    """Fit the forest on at most ``max_findings`` labelled findings, those of the least hashes."""
    order = F.xxhash64("candidate", "before", "after", "path")
    chosen = saved(findings.select("before", "candidate", "after", "path", "label").orderBy(order, "candidate", "before", "after", "path", "label").limit(max_findings))
    rows = featured(chosen, coverage(chosen, words)).select("features", "label")
    # In one part and one order, since trees are drawn by part: the bound above bounds it.
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.repartition(1).sortWithinPartitions(F.xxhash64(vector_to_array("features")), "label"))


def held_out_finding() -> Column:
    """A fifth of the findings, by their candidate."""
    return F.pmod(F.xxhash64(F.lit("held out"), "candidate"), F.lit(5)) == 0


def evaluation(findings: DataFrame, words: DataFrame, **options) -> DataFrame:
    """kind, label, findings, judged_secret: how a forest trained on four fifths judges the other fifth.

    For kinds of label 1, judged_secret / findings is the recall; for those of label 0 it is
    the rate of false alarms."""
    findings = saved(findings)
    model = train(findings.where(~held_out_finding()), words, **options)
    tested = findings.where(held_out_finding())
    judged = model.transform(featured(tested, coverage(tested, words)))
    return judged.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("findings"), F.count_if(vector_to_array("probability")[1] >= CUT).alias("judged_secret"))


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """doc_id, start, candidate, probability, is_secret: a row for each candidate of every text."""
    findings = seeded_findings(docs.sparkSession) if findings is None else findings
    words = saved(dictionary(docs))
    model = train(findings, words)
    found = saved(candidates(docs, path))
    judged = model.transform(featured(found, coverage(found, words)))
    probability = vector_to_array("probability")[1]
    return judged.select("doc_id", "start", "candidate", probability.alias("probability"), (probability >= CUT).alias("is_secret"))
