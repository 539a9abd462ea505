"""Secret scan with a random forest that removes false positives (operator 8): DataFrame expressions only."""

from __future__ import annotations

import math
import random
import string
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: What candidates look like. A key name with a value, issued tokens, private keys, long random runs.
#: A match goes on to the end of its run; names, gaps and values have any length. Runs are possessive, and a name or a
#: signed token is looked for from the beginning of its run alone, so a run is read a fixed number of times. What stands
#: before a signed token in its run is part of the match and not of the value. A private key goes up to its END line,
#: whatever stands between; without one, over its headers and base64 text. More specific rules come first.
HEADER = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
RULES = [
    ("private_key", rf"{HEADER}(?:(?>[\s\S]*?(?=-----(?:BEGIN|END) |\z))-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----|(?:\s*+[A-Za-z-]++: [^\n]*+)*+[A-Za-z0-9+/=\s\\]*+)"),
    ("cloud_key_id", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{16}\b"),
    ("issued_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}+|github_pat_[A-Za-z0-9_]{30,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk[-_](?:live[-_]|test[-_]|proj-)?[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{35,}+|npm_[A-Za-z0-9]{36,}+|hf_[A-Za-z0-9]{30,}+|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{30,}+)"),
    ("signed_token", r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})[A-Za-z0-9_-]*?\beyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    ("named_value", r"(?i)(?<![a-z0-9_.-])(?=[a-z0-9_.-]*?(?:password|passwd|pwd|secret|token|api_?key|apikey|access_?key|private_?key|auth|credential))[a-z0-9_.-]++[\"']?\s*+(?:=>|:=|=|:)\s*+[\"']?[^\s\"'<>,;]{6,}+"),
    ("long_run", r"\b[A-Za-z0-9+/_-]{32,}+={0,2}"),
]
CANDIDATE = "|".join(f"(?:{'(?i:' + p[4:] + ')' if p.startswith('(?i)') else p})" for _, p in RULES)
WIDE = 60
NAMED = [n for n, _ in RULES].index("named_value")

#: Words that tell of secrets, and words that tell of none.
TELLING = "password passwd pwd secret token key apikey api credential auth login bearer private access signin".split()
HARMLESS = "example sample test dummy fake placeholder changeme your xxx commit sha sha1 sha256 md5 digest checksum hash uuid guid integrity etag revision blob template null none true false undefined redacted doi isbn".split()
FEATURES = ["length", "digits", "upper", "lower", "signs", "changes", "transitions", "distinct", "repeats", "hexlike", "words", "spelled", "vowels", "telling", "harmless", "harmless_value", "assigned", "quoted", "path", "prefix", "issued", "named"]


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def value_of(rule: Column, found: Column) -> Column:
    """The part of a match that would be secret: what a name is given, the token in its run, else the whole. It ends
    where the match ends."""
    value = F.when(rule == "named_value", F.regexp_extract(found, r"(?:=>|:=|=|:)\s*+[\"']?([^\s\"'<>,;]+)[^=:]*$", 1)).when(rule == "signed_token", F.regexp_extract(found, r"\beyJ[A-Za-z0-9_-]{8,}+\.eyJ.*$", 0)).otherwise(found)
    return F.when(F.length(value) > 0, value).otherwise(found)


#: Letters count by their place, digits as one sign, all else as another.
SIGNS = 28


def transitions(value: Column) -> Column:
    """The numbers of the value's pairs of adjacent signs."""
    code = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("0", "9"), 26).otherwise(27)
    signs = F.transform(F.split(F.lower(value), ""), code)
    n = F.greatest(F.size(signs) - 1, F.lit(0))
    return F.zip_with(F.slice(signs, 1, n), F.slice(signs, 2, n), lambda a, b: a * SIGNS + b)


def word_runs(text: Column) -> Column:
    """Distinct lower-case runs of four letters or more, cut where lower case meets upper case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")), F.lit(r"\p{L}{4,}+"), F.lit(0)))


def dictionary(docs: DataFrame, id_col: str, text: str, most: int = 4000, least: int = 3) -> list[str]:
    """The ``most`` words that stand in most documents, of those in ``least`` or more, counted over all of ``docs``;
    ties by the word. ``most`` bounds what reaches the driver and every task."""
    # Among plain words alone: what stands beside a sign may be a secret's part.
    plain = F.regexp_extract_all(docs[text], F.lit(r"(?<!\S)\p{L}{4,}+(?=[.,;:!?]?(?:\s|\z))"), F.lit(0))
    counts = docs.select(F.explode(F.array_distinct(F.transform(plain, F.lower))).alias("w")).groupBy("w").count().where(F.col("count") >= least)
    return [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(most).orderBy("w").select("w").collect()]


def featured(found: DataFrame, model: Transitions) -> DataFrame:
    """Adds the forest's features to rows of (rule, found, before, after): ``value`` is the part that would be secret.

    ``transitions`` is the mean log odds of the value's pairs of signs between secrets and others; ``words`` the share
    of its letters in dictionary words, ``spelled`` that without runs of up to three letters and runs of five or more
    consonants; path and neighbouring words come from the name, and ``WIDE`` characters on either side."""
    around = F.lower(F.concat_ws(" ", "before", F.when(F.col("rule") == "named_value", F.regexp_extract("found", r"^[^=:]*", 0)), "after"))
    any_of = lambda words: r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])"
    n = F.greatest(F.length("value"), F.lit(1))
    share = lambda p: count_of(F.col("value"), p) / n
    letters = F.array_distinct(F.split("value", ""))
    odds = F.array(*(F.lit(x) for x in model.odds))
    known = F.array(*(F.lit(w) for w in model.words)) if model.words else F.array().cast("array<string>")
    total = lambda a: F.aggregate(a, F.lit(0), lambda t, w: t + F.length(w))
    # An address that goes on to the end: looked for in the last word alone, as values have any length.
    site = F.element_at(F.split(F.concat("before", "value", "after"), r"[ \t\f\x0B]|[\r\n](?!\z)"), -1).rlike("(?i)https?://")
    return (
        found.withColumn("value", value_of(F.col("rule"), F.col("found")))
        .withColumns({"_pairs": transitions(F.col("value")), "_runs": word_runs(F.col("value"))})
        .withColumns({
            "length": F.least(n, F.lit(400)).cast("double"),
            "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "signs": share("[^A-Za-z0-9]"),
            "changes": share(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])"),
            "transitions": F.aggregate("_pairs", F.lit(0.0), lambda t, p: t + F.get(odds, p)) / F.greatest(F.size("_pairs"), F.lit(1)),
            "distinct": F.size(letters) / n,
            "repeats": share(r"(.)(?=\1)"),
            "hexlike": F.col("value").rlike(r"^[0-9a-fA-F-]+$").cast("double"),
            "words": total(F.array_intersect("_runs", known)) / F.greatest(total(F.col("_runs")), F.lit(1)),
            "spelled": F.length(F.regexp_replace("value", r"(?i)[^a-z]|(?<![a-z])[a-z]{1,3}(?![a-z])|[bcdfghjklmnpqrstvwxz]{5,}", "")) / n,
            "vowels": share("[aeiouAEIOU]"),
            "telling": F.least(count_of(around, any_of(TELLING)), F.lit(3)).cast("double"),
            "harmless": F.least(count_of(around, any_of(HARMLESS)), F.lit(3)).cast("double"),
            "harmless_value": F.lower("value").rlike("(?:" + "|".join(w for w in HARMLESS if len(w) > 4) + r"|(.)\1{4}|1234|abcd)").cast("double"),
            "assigned": (F.col("rule") == "named_value").cast("double") + F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
            "quoted": F.col("after").rlike("^[\"']").cast("double"),
            "path": (site | F.concat("before", "value", "after").rlike(r"(?i)[a-z0-9]/[a-z0-9]++/[a-z0-9]|\.(?:js|css|png|html|py|lock)\b")).cast("double"),
            "prefix": F.col("value").rlike(r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox|sk[-_]|AIza|npm_|hf_|SG\.|eyJ|-----BEGIN)").cast("double"),
            "issued": F.col("rule").isin("private_key", "cloud_key_id", "issued_token", "signed_token").cast("double"),
            "named": (F.col("rule") == "named_value").cast("double"),
        }).drop("_pairs", "_runs")
    )


def labelled_findings(spark: SparkSession, rows: int = 3000, seed: int = 8) -> DataFrame:
    """Labelled findings (rule, found, before, after, label) for training: issued keys, named values and random
    runs that are secret; digests, identifiers, placeholders, paths and prose that are not. ``rows`` bounds them."""
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    syllables = lambda: "".join(rng.choice(("the", "an", "er", "on", "re", "th", "in", "at", "es", "or", "ti", "ed", "ou", "la", "que", "ung", "sch", "ción", "port", "user", "main")) for _ in range(rng.randint(1, 3)))
    vocabulary = [syllables() for _ in range(600)]
    # Most words of harmless values are words of the texts around; some are new.
    word = lambda: rng.choice(vocabulary) if rng.random() < 0.8 else syllables()
    prose = lambda n: " ".join(word() for _ in range(n))
    name = lambda: rng.choice(("password", "passwd", "db_password", "token", "auth_token", "secret", "client_secret", "api_key", "API_KEY", "apiKey", "access_key", "SECRET_KEY", "credential"))
    out = []
    for _ in range(rows):
        before, after = (prose(6) + " ")[-WIDE:], (" " + prose(6))[:WIDE]
        kind = rng.random()
        sep, quote = rng.choice(("=", " = ", ": ", ":", " := ")), rng.choice(("", '"', "'"))
        if kind < 0.12:
            out.append(("cloud_key_id", rng.choice(("AKIA", "ASIA")) + pick(string.ascii_uppercase + string.digits, 16), before, after, 1))
        elif kind < 0.2:
            body = rng.choice((f"ghp_{pick(alnum, 36)}", f"xoxb-{pick(string.digits, 12)}-{pick(alnum, 24)}", f"sk_live_{pick(alnum, 24)}", f"sk-{pick(alnum, 48)}", f"AIza{pick(alnum, 35)}", f"glpat-{pick(alnum, 20)}", f"npm_{pick(alnum, 36)}"))
            out.append(("issued_token", body, before, after, 1))
        elif kind < 0.24:
            out.append(("private_key", f"-----BEGIN RSA PRIVATE KEY-----\n{pick(alnum + '+/', 300)}\n-----END RSA PRIVATE KEY-----", before, after, 1))
        elif kind < 0.28:
            out.append(("signed_token", f"eyJ{pick(alnum, 30)}.eyJ{pick(alnum, 60)}.{pick(alnum, 43)}", before, after, 1))
        elif kind < 0.5:
            value = rng.choice((pick(hexes, rng.choice((12, 16, 18, 20, 32, 40, 64))), pick(alnum, rng.randint(10, 44)), pick(alnum + "!#%&*@$^", rng.randint(8, 24))))
            out.append(("named_value", f"{name()}{sep}{quote}{value}", before, quote + after, 1))
        elif kind < 0.56:
            out.append(("long_run", pick(alnum, rng.randint(36, 64)), before + rng.choice(("bearer ", "key ", "secret ", "login ")), after, 1))
        elif kind < 0.68:
            value = rng.choice(("changeme", "your_password_here", "xxxxxxxxxx", "<password>", "example", "placeholder", "undefined", "${PASSWORD}", "os.environ['X']", "getpass()", "test1234", "dummy-value", "password", "process.env.KEY", "redacted", word() + word() + word(), word() + "_" + word()))
            out.append(("named_value", f"{name()}{sep}{quote}{value}", before, quote + after, 0))
        elif kind < 0.74:
            out.append(("named_value", f"{rng.choice(('token', 'author', 'authority', 'secretary', 'passwords', 'tokenizer', 'key'))}: {word()}{word()}", before, after, 0))
        elif kind < 0.84:
            out.append(("long_run", pick(hexes, rng.choice((32, 40, 64))), before + rng.choice(("commit ", "sha256:", "md5 ", "digest ", "checksum ", "etag ", "revision ", "hash ")), after, 0))
        elif kind < 0.88:
            out.append(("long_run", "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), before + rng.choice(("uuid ", "id ", "guid ", "")), after, 0))
        elif kind < 0.95:
            out.append(("long_run", "".join(word() for _ in range(14))[: rng.randint(32, 60)], before, after, 0))
        else:
            out.append(("long_run", "/".join(word() + word() for _ in range(8)), before + "https://www.example.com/", after, 0))
    return spark.createDataFrame([r for r in out], "rule string, found string, before string, after string, label int").coalesce(1)


@dataclass
class Transitions:
    """Log odds of each pair of adjacent signs, and the dictionary."""

    odds: list[float]
    words: list[str]


@dataclass
class Forest:
    trees: RandomForestClassificationModel
    odds: list[float]


_models: dict[str, Forest] = {}


def forest(spark: SparkSession, *, rows: int = 3000, trees: int = 24, depth: int = 8, seed: int = 8) -> Forest:
    """The random forest over :func:`labelled_findings` and the transition odds that it reads, counted in the same
    rows; trained once for each application and setting."""
    key = f"{spark.sparkContext.applicationId}/{rows}/{trees}/{depth}/{seed}"
    if key not in _models:
        findings = labelled_findings(spark, rows, seed)
        counted = findings.select("label", F.explode(transitions(value_of(F.col("rule"), F.col("found")))).alias("p")).groupBy("p", "label").count().collect()
        counts = {(r["p"], r["label"]): r["count"] for r in counted}
        total = [sum(n for (_, k), n in counts.items() if k == label) for label in (0, 1)]
        odds = [math.log((counts.get((p, 1), 0) + 1) / (total[1] + SIGNS**2)) - math.log((counts.get((p, 0), 0) + 1) / (total[0] + SIGNS**2)) for p in range(SIGNS**2)]
        around = findings.select(F.monotonically_increasing_id().alias("i"), F.concat_ws(" ", "before", "after").alias("t"))
        model = Transitions(odds, dictionary(around, "i", "t"))
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(findings, model)).select("features", F.col("label").cast("double").alias("label"))
        _models[key] = Forest(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data), odds)
    return _models[key]


def judged(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds ``value`` and ``share``, the forest's share of votes, to candidates."""
    model = forest(found.sparkSession)
    scored = model.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(found, Transitions(model.odds, words))))
    return scored.withColumn("share", F.get(vector_to_array("probability"), F.lit(1)))


def matches(cut: DataFrame, text: Column, k: int) -> DataFrame:
    """Adds ``_r{k}``: the matches of rule ``k`` as (start, end) of the value, the same of the whole match, and it.

    The text is cut by the pattern once; the lengths of the cuts and matches give the places, so nothing is
    searched twice."""
    name, pattern = RULES[k]
    cut = cut.withColumn("_found", F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    cut = cut.withColumn("_rest", F.when(F.size("_found") > 0, F.split(text, pattern, -1)))
    gaps = F.transform("_found", lambda f, i: F.length(F.get("_rest", i)) + F.length(f))
    # The running sum: each match ends where the gap before it and itself have been passed.
    ends = F.aggregate(gaps, F.array(F.lit(0)), lambda a, g: F.array_append(a, F.element_at(a, -1) + g))
    cut = cut.withColumn("_ends", ends)

    def placed(f: Column, i: Column) -> Column:
        end = F.get("_ends", i + 1)
        start = end - F.length(f)
        return F.struct((end - F.length(value_of(F.lit(name), f))).alias("vs"), F.lit(1).alias("kind"), (-end).alias("ve"), F.lit(k).alias("rank"), start.alias("start"), f.alias("found"))

    return cut.withColumn(f"_r{k}", F.transform("_found", placed)).drop("_found", "_rest", "_ends")


def standing(found: Column) -> Column:
    """Of all rules' matches those that no better one holds, by place.

    Every match is one of its own rule's; a value inside a key or token of a more specific rule, or inside a longer
    one, is that rule's, and a long run inside a named value or its name is the named value's. A named value or long
    run that reaches beyond a key or token stays beside it, so that neither hides the other."""
    names = F.transform(F.filter(found, lambda x: x["rank"] == NAMED), lambda x: F.struct(x["start"].alias("vs"), F.lit(0).alias("kind"), x["ve"].alias("ve"), x["rank"].alias("rank"), x["start"].alias("start"), F.lit("").alias("found")))
    # In this order whatever holds a value comes before it: begun earlier or longer or more specific.
    inside = lambda a, x: (-x["ve"] <= a["issued"]) | ((x["rank"] > NAMED) & (-x["ve"] <= a["named"]))
    empty = F.struct(F.lit(0).alias("issued"), F.lit(0).alias("named"), F.filter(found, lambda x: F.lit(False)).alias("out"))
    swept = F.aggregate(F.array_sort(F.concat(found, names)), empty, lambda a, x: F.struct(
        F.when(x["rank"] < NAMED, F.greatest(a["issued"], -x["ve"])).otherwise(a["issued"]).alias("issued"),
        F.when(x["kind"] == 0, F.greatest(a["named"], -x["ve"])).otherwise(a["named"]).alias("named"),
        F.when((x["kind"] == 0) | inside(a, x), a["out"]).otherwise(F.array_append(a["out"], x)).alias("out")))
    return swept["out"]


def candidates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(row columns but the text, start, rule, found, before, after): the matches of every rule that stand, in order.

    Each rule reads the text on its own, so that none takes another's beginning; texts without a match end at the
    first filter."""
    t = F.col(text)
    cut = docs.where(t.rlike(CANDIDATE))
    for k in range(len(RULES)):
        cut = matches(cut, t, k)
    kept = [c for c in docs.columns if c != text]
    cut = cut.select(*kept, t.alias("_text"), F.concat(*(f"_r{k}" for k in range(len(RULES)))).alias("_all"))
    one = cut.select(*kept, "_text", F.explode(standing(F.col("_all"))).alias("_m"))
    found, place = F.col("_m.found"), F.col("_m.start") + 1
    return one.select(
        *kept, F.col("_m.start").cast("long").alias("start"), F.get(F.array(*(F.lit(n) for n, _ in RULES)), F.col("_m.rank")).alias("rule"), found.alias("found"),
        F.substring(F.col("_text"), F.greatest(place - WIDE, F.lit(1)), F.least(place - 1, F.lit(WIDE))).alias("before"),
        F.substring(F.col("_text"), place + F.length(found), F.lit(WIDE)).alias("after"),
    )


def scan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5, words: list[str] | None = None) -> DataFrame:
    """(id, start, length, rule, value, probability, secret): each candidate with the forest's share of votes.

    Candidates of two rules may overlap where neither holds the other (see :func:`standing`). ``start`` and ``length``
    (code points) are those of the secret value. ``words`` is the dictionary; without it, :func:`dictionary` of
    ``docs``. Null and empty texts have none; repeated rows have theirs each; an empty table gives no rows; texts and
    secrets have any length; columns beside the two are not read, whatever their names. No shuffle: rows are
    independent.
    """
    if words is None:
        words = dictionary(docs, id_col, text)
    scored = judged(candidates(docs.select(docs[id_col].alias("_id"), docs[text].alias("_t")), "_id", "_t"), words)
    return scored.select(
        F.col("_id").alias(id_col), (F.col("start") + F.length("found") - F.length("value")).cast("long").alias("start"),
        F.length("value").cast("long").alias("length"), "rule", "value", F.col("share").alias("probability"),
    ).withColumn("secret", F.col("probability") >= threshold)


def merged(spans: Column) -> Column:
    """Sorted spans with those that overlap made one, named by the first."""
    end = lambda x: x["start"] + x["length"]
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), (F.greatest(end(last(a)), end(x)) - last(a)["start"]).alias("length"), last(a)["rule"].alias("rule"))))
    return F.aggregate(spans, F.filter(spans, lambda x: F.lit(False)), lambda a, x: F.when((F.size(a) > 0) & (x["start"] < end(F.get(a, F.size(a) - 1))), joined(a, x)).otherwise(F.array_append(a, x)))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every found secret replaced by its rule's name in brackets, and ``n_chars`` told anew.

    Rows keep their number and order of columns, and columns of any name and texts of any length their content; null
    and empty texts stay, repeated rows are each replaced, an empty table gives no rows. Rows are written once with a number; those without
    a candidate pass as they are, and only the few others meet their findings by that number.
    """
    words = dictionary(docs, id_col, text)
    numbered = docs.select(F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"), F.coalesce(docs[text].rlike(CANDIDATE), F.lit(False)).alias("some"), F.monotonically_increasing_id().alias("number"))
    held = materialize(numbered, "numbered")
    few = held.where("some").select("row", "number", F.col("row").getField(text).alias("t"))
    found = scan(few, id_col="number", text="t", threshold=threshold, words=words).where("secret").groupBy("number").agg(
        merged(F.array_sort(F.collect_set(F.struct("start", "length", "rule")))).alias("spans"))
    spans = F.col("spans")
    pieces = F.transform(spans, lambda s, i: F.concat(
        F.substring(F.col("t"), F.when(i == 0, 1).otherwise(F.get(spans, i - 1)["start"] + F.get(spans, i - 1)["length"] + 1).cast("int"),
                    (s["start"] - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["start"] + F.get(spans, i - 1)["length"])).cast("int")),
        F.lit("["), s["rule"], F.lit("]")))
    last = F.element_at(spans, -1)
    clean = F.concat(F.array_join(pieces, ""), F.substring(F.col("t"), (last["start"] + last["length"] + 1).cast("int"), F.lit(2**31 - 1)))
    told = few.join(found, "number", "left").withColumn("clean", F.when(spans.isNull(), F.col("t")).otherwise(clean))

    def column(c: str) -> Column:
        old = F.col("row").getField(c)
        if c == text:
            return F.col("clean").alias(c)
        return F.when(spans.isNull(), old).otherwise(F.length("clean").cast(docs.schema[c].dataType)).alias(c) if c == n_chars else old.alias(c)

    return held.where("not some").select(*(F.col("row").getField(c).alias(c) for c in docs.columns)).unionByName(told.select(*map(column, docs.columns)))
