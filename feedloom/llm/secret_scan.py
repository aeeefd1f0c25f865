"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OF = "[A-Za-z0-9_+/-]"
#: A candidate: 12 or more such characters on end, with a digit or a capital after a small letter among them.
CANDIDATE = rf"(?<!{_OF})(?=[A-Za-z_+/-]*+[0-9]|{_OF}*?[a-z][A-Z]){_OF}{{12,}}+={{0,2}}+"
#: Of two units in Java; no candidate holds one.
_WIDE = r"[\x{10000}-\x{10FFFF}]"
#: Marks set around candidates; where a text holds them itself, they stand as blanks.
_OPEN, _CLOSE = "\x01", "\x02"

NAMES_SECRET = r"(?i)(pass(word|wd|phrase)?|secret|token|api.?key|access.?key|credential|bearer|auth|private.?key)"
#: A value assigned to a secret-like name: quoted up to its quote, else up to white space without closing marks; 6 characters or more of any kind.
_NAMED = rf"{NAMES_SECRET.replace('(?i)(', '(?i:').replace('(word', '(?:word')}[\w.-]{{0,24}}[\"']?[ \t]{{0,3}}(?::=|=>|[=:])[ \t]{{0,3}}[\"']?"
_QUOTED = r"(?<=%s)(?=(?:[^%s\\\n]|\\.){6})[^%s\\\n]*+(?:\\.[^%s\\\n]*+)*+(?=%s)"
ASSIGNED = rf"({_NAMED})({_QUOTED % (('"',) * 5)}|{_QUOTED % (("'",) * 5)}|(?<![\"'])(?![\"'])(?=\S{{6}})\S*[^\s\"',.;)](?<=\S{{6}}))"
#: What a line must hold for ASSIGNED to match in it: a cheap test before the pattern.
_HINTS = ("pass", "secret", "token", "api", "access", "credential", "bearer", "auth", "private")

NAMES_OTHER = r"(?i)(sha\d*|md5|digest|checksum|commit|revision|uuid|guid|etag|version|build|image|example|sample|dummy|placeholder|test)"
NAMED = r"^(AKIA|ASIA|ghp_|gho_|sk_live_|xox[bp]-|eyJ)"

FEATURES = ["length", "digits", "upper", "letter_digit", "digit_letter", "case_change", "same", "variety", "hex_only", "separators", "dictionary", "named", "secret_near", "secret_named", "other_near", "assigned", "quoted", "punctuation", "blanks", "reference", "secret_behind", "test_path", "deep_path"]


def _contexts(marked: Column) -> Column:
    """(candidate, before, after) of each marked candidate: up to 60 characters before and 40 behind it on its line, other candidates included.

    A text is cut at the opening marks. As a candidate has 6 characters or more, 11 pieces hold all that a context can.
    """

    def of(pieces: Column) -> Column:
        def one(i: Column) -> Column:
            own = F.element_at(pieces, i)
            candidate = F.substring_index(own, _CLOSE, 1)
            begin = F.greatest(i - 11, F.lit(1))
            before = F.replace(F.array_join(F.slice(pieces, begin, i - begin), ""), F.lit(_CLOSE), F.lit(""))
            after = F.replace(F.array_join(F.slice(pieces, i, 8), ""), F.lit(_CLOSE), F.lit(""))
            after = F.substring_index(F.substring(after, F.length(candidate) + 1, F.lit(40)), "\n", 1)
            return F.struct(candidate.alias("candidate"), F.right(F.substring_index(before, "\n", -1), F.lit(60)).alias("before"), after.alias("after"))

        return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(2), F.size(pieces)), one))

    return F.flatten(F.transform(F.array(F.split(marked, _OPEN, -1)), of))  # the array binds the pieces, so they are cut once


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, finding, candidate, before, after, path): every candidate of the whole texts, numbered in order from 0.

    First come the runs of CANDIDATE, then the values of ASSIGNED that are not just such a run. Each pattern goes over a text once, ASSIGNED
    only over lines with a name and a sign; candidates are marked in the text and contexts cut around the marks.

    before and after are cut from the whole line by place, other candidates included; characters beyond U+FFFF stand there as U+FFFD.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    text = F.col(text_col)
    text = F.when(text.rlike(f"[{_OPEN}{_CLOSE}]|{_WIDE}"), F.translate(F.regexp_replace(text, _WIDE, "\ufffd"), _OPEN + _CLOSE, "  ")).otherwise(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(path, F.lit("")).alias("path"))

    def may_assign(line: Column) -> Column:
        small = F.lower(line)
        return (line.contains("=") | line.contains(":")) & reduce(lambda x, y: x | y, [small.contains(h) for h in _HINTS])

    lines = F.array_join(F.filter(F.split("text", "\n", -1), may_assign), "\n")
    runs = _contexts(F.regexp_replace("text", CANDIDATE, f"{_OPEN}$0{_CLOSE}"))
    values = _contexts(F.regexp_replace(lines, ASSIGNED, f"$1{_OPEN}$2{_CLOSE}"))
    empty = F.array().cast("array<struct<candidate:string,before:string,after:string>>")
    found = F.concat(F.coalesce(runs, empty), F.coalesce(F.filter(values, lambda v: ~v["candidate"].rlike(f"^{CANDIDATE}$")), empty))
    return rows.select("doc_id", "path", F.posexplode(found).alias("finding", "c")).select("doc_id", "finding", "c.candidate", "c.before", "c.after", "path")


def corpus_words(docs: DataFrame, text_col: str = "text", top: int = 2000) -> list[str]:
    """The `top` lower-case words of 4 to 16 letters that stand in most documents: the dictionary, counted over all texts and collected in bounded size.

    Ties go by the alphabet; no texts give no words.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?<![^\s])[a-z]{4,16}(?=[\s.,;:!?])"), F.lit(0)))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(top)
    return [row["word"] for row in counted.collect()]


def with_features(findings: DataFrame, words: list[str]) -> DataFrame:
    """findings (candidate, before, after, path) with the columns of FEATURES as doubles; nulls count as empty text.

    words: the dictionary, of which a candidate's runs of letters are or are not.
    """
    c, before, after, path = (F.coalesce(F.col(n), F.lit("")) for n in ("candidate", "before", "after", "path"))
    size = F.greatest(F.length(c), F.lit(1))

    def times(pattern: str, of=c):
        return F.regexp_count(of, F.lit(pattern))

    parts = F.regexp_extract_all(F.lower(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", "_")), F.lit("[a-z]{4,}"), F.lit(0))
    known = F.filter(parts, lambda x: x.isin(words)) if words else F.slice(parts, 1, 0)
    values = {
        "length": F.length(c), "digits": times("[0-9]") / size, "upper": times("[A-Z]") / size,
        "letter_digit": times("[A-Za-z](?=[0-9])") / size, "digit_letter": times("[0-9](?=[A-Za-z])") / size, "case_change": times("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / size,
        "same": times(r"(.)(?=\1)") / size, "variety": F.size(F.array_distinct(F.split(c, ""))) / size, "hex_only": c.rlike("^[0-9a-f]+$"), "separators": times("[_/+-]") / size,
        "dictionary": F.length(F.array_join(known, "")) / size, "named": c.rlike(NAMED),
        "secret_near": before.rlike(NAMES_SECRET), "secret_named": before.rlike(NAMES_SECRET + r"[\w.-]{0,24}[\"']?\s*(:=|=>|[=:])\s*[\"']?$"), "other_near": before.rlike(NAMES_OTHER), "assigned": before.rlike(r"[=:]\s*[\"']?$"), "quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "punctuation": times(r"[^A-Za-z0-9\s_+/=-]") / size, "blanks": times(r"\s") / size, "reference": c.rlike(r"^[$<{%\[]|[()]|(?i)^(null|none|true|false|undefined|required|optional|string|changeme)\b"),
        "secret_behind": after.rlike(NAMES_SECRET), "test_path": path.rlike("(?i)(test|example|sample|fixture|mock|docs?/)"), "deep_path": F.length(F.regexp_replace(path, "[^/]", "")),
    }
    return findings.withColumns({n: v.cast("double") for n, v in values.items()})


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: int = 5) -> DataFrame:
    """(candidate, before, after, path, label): made-up labelled findings, for use where nobody has labelled any.

    Half are keys, passwords and tokens as configurations and notes hold them; half are what looks like them: digests,
    build numbers, identifiers, placeholders, long words with numbers. All follow from the row's number and the seed.
    """
    row = spark.range(0, rows, 1, 4).withColumn("r", F.sha2(F.concat_ws(":", F.lit(seed), "id"), 512))
    pick = lambda at, n: F.pmod(F.conv(F.substring("r", at, 7), 16, 10).cast("long"), F.lit(n)).cast("int")
    one_of = lambda at, of: F.element_at(F.array(*map(F.lit, of)), pick(at, len(of)) + 1)
    hexes = lambda at, n: F.substring("r", at, n)
    letters = lambda at, n, of: F.concat(*(F.substring(F.lit(of), pick(at + 2 * k, len(of)) + 1, 1) for k in range(n)))
    capital, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = one_of(3, ["the", "with", "notes", "and", "stand", "reading", "der", "pour", "esta"])
    name = one_of(9, ["password", "passwd", "secret", "api_key", "token", "access_token", "auth_token", "client_secret", "clientSecret", "awsSecretAccessKey", "apiTokenProd", "client_secret_v2"])
    other = one_of(9, ["sha256", "md5", "commit", "digest", "checksum", "build", "revision", "etag"])
    noun = one_of(15, ["chapter", "section", "version", "image", "record", "order", "module", "template", "fixture"])
    human = F.concat(F.initcap(one_of(21, ["tr0ub", "hunter", "dragon", "summer", "s3cure", "monkey", "letme1n", "qwerty", "blue", "winter"])), one_of(23, ["4dor&", "!", "", "!Pass#", "@", "$x", ".", "-", "%", "?"]), pick(25, 3000).cast("string"), one_of(33, ["", "!", "#", "3"]))
    plain = F.concat(one_of(21, ["hunter", "dragon", "monkey", "correct", "sunset", "purple"]), one_of(23, ["horse", "battery", "staple", "river", "tiger", "cloud"]), one_of(27, ["", "2024", "moon"]))
    true_kinds = [
        (human, F.concat(word, F.lit(" "), name, F.lit(' = "'))), (human, F.concat(one_of(41, ["db_", ""]), name, one_of(43, ["=", ": "]))), (plain, F.concat(one_of(41, ["db_", ""]), name, one_of(43, ["=", ": ", ' = "', ": '"]))),
        (F.concat(F.lit("AKIA"), letters(21, 16, capital)), F.concat(word, F.lit(" "))),
        (hexes(21, 18), F.concat(word, F.lit(" "), name, F.lit("="))),
        (hexes(21, 40), F.concat(word, F.lit(" "), name, F.lit(' = "'))),
        (F.concat(F.lit("ghp_"), letters(21, 36, mixed)), F.concat(name, F.lit(": "))),
        (letters(21, 24, mixed), F.concat(name, F.lit("='"))),
        (hexes(21, 24), F.concat(F.lit('{"'), name, F.lit('": "'))),
        (letters(21, 40, mixed + "+/"), F.concat(word, F.lit(" "), name, F.lit(" = "))),
    ]
    false_kinds = [
        (F.concat(one_of(21, ["${", "<", "{{", "$(", "%("]), name, one_of(23, ["}", ">", "}}", ")", ")s"])), F.concat(name, one_of(43, ["=", ": ", ' = "']))),
        (one_of(21, ["required", "optional", "changeme", "string", "undefined", "your password here", "getToken(user)", "os.environ['KEY']", "see the manual", "placeholder", "example"]), F.concat(name, one_of(43, ["=", ": ", ' = "']))),
        (one_of(21, ["reading notes", "Anna Miller", "the sample text", "section", "chapter"]), F.concat(one_of(31, ["author", "Author", "authors"]), one_of(43, [": ", "=", ' = "']))),
        (hexes(21, 40), F.concat(other, F.lit(" "))), (hexes(21, 64), F.concat(other, F.lit(":"))),
        (F.concat(noun, pick(21, 900).cast("string"), F.lit("_"), word, pick(31, 90).cast("string")), F.concat(word, F.lit(" "))),
        (F.concat(F.lit("2024-01-"), F.lpad((pick(21, 28) + 1).cast("string"), 2, "0"), F.lit("T12")), F.concat(word, F.lit(" "))),
        (F.lpad(pick(21, 1_000_000_000).cast("string"), 14, "4"), F.concat(word, F.lit(" "))),
        (F.concat(F.lit("your_"), name, F.lit("_here"), pick(21, 10).cast("string")), F.concat(name, F.lit("="))),
        (F.concat(F.lit("EXAMPLE"), letters(21, 4, capital), F.lit("EXAMPLE1")), F.concat(F.lit("example "), name, F.lit("="))),
        (F.concat(F.lit("xxxxxxxxxxxx"), pick(21, 1000).cast("string")), F.concat(name, F.lit(' = "'))),
        (F.concat(hexes(21, 8), F.lit("-"), hexes(29, 4), F.lit("-"), hexes(33, 4), F.lit("-"), hexes(37, 12)), F.concat(word, F.lit(" "))),
        (F.concat(noun, F.initcap(word), F.initcap(noun), F.lit("Value")), F.concat(word, F.lit(" "))),
        (one_of(21, ["clientSecret", "awsSecretAccessKey", "apiTokenProd", "client_secret_v2"]), one_of(31, ['{"', "const ", "", '"'])),
        (hexes(21, 40), F.concat(name, F.lit("=x, "), other, F.lit(" "))),
    ]
    kind, label = pick(60, 60), F.col("id") % 2
    choose = lambda k: F.when(label == 1, F.element_at(F.array(*(x[k] for x in true_kinds)), kind % len(true_kinds) + 1)).otherwise(F.element_at(F.array(*(x[k] for x in false_kinds)), kind % len(false_kinds) + 1))
    before = choose(1)
    after = F.when(before.endswith('"'), F.lit('" ')).when(before.endswith("'"), F.lit("' ")).otherwise(F.lit(" "))
    path = one_of(67, ["src/app/settings.py", "deploy/values.yaml", "notes/a.txt", "tests/data/b.json", "docs/guide.md", "", "web/app.js", "ops/run.sh"])
    return row.select(choose(0).alias("candidate"), before.alias("before"), F.concat(after, word).alias("after"), path.alias("path"), label.cast("int").alias("label"))


def train(findings: DataFrame, words: list[str] | None = None, trees: int = 20, depth: int = 8, seed: int = 3) -> PipelineModel:
    """A random forest over the features of labelled findings (candidate, before, after, path, label 0 or 1).

    words: the dictionary (corpus_words()). Rows of other labels teach nothing; without both labels there is nothing to learn, an error.
    """
    if findings.where(F.col("label").isin(0, 1)).select("label").distinct().count() < 2:
        raise ValueError("labelled findings of both kinds are needed")
    rows = with_features(findings.where(F.col("label").isin(0, 1)), words or []).select(*FEATURES, F.col("label").cast("double").alias("label"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", predictionCol="rf_prediction", rawPredictionCol="rf_raw", probabilityCol="rf_probability")
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def scan(docs: DataFrame, model: PipelineModel, words: list[str] | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, finding, candidate, score, is_secret) for every candidate in docs; score is the forest's share for "secret".

    The work is one pass over the texts without a shuffle. Null and empty texts have no candidates; a null path counts
    as empty; rows that repeat give their candidates again; candidates of equal text and context score alike; no rows give none.
    """
    scored = model.transform(with_features(candidates(docs, id_col, text_col, path_col), words or []))
    score = F.get(vector_to_array("rf_probability"), 1)
    return scored.select("doc_id", "finding", "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))
