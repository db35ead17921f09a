"""Secret scan: candidates by form, false positives removed by a random forest.

Everything is DataFrame functions and pyspark.ml, so the scan stays in the JVM. Candidates are values assigned to a secret word
in English, German, Spanish or French, by a sign or by "is" (of any alphabet, at least MIN_VALUE characters), passwords in URLs, runs of
at least MIN_LENGTH token characters wherever they stand, and what a private key's marks enclose, as one; one regular expression marks them and a split yields them with the text before and after. Features are the
candidate's length and make-up, log-odds of its character transitions (learned with the forest), changes of character class, the
share that dictionary words cover, signs of a path, and the neighbouring words. A random forest learned from labelled findings
turns them into a probability.

Edge cases: null and empty texts have no candidates; equal candidates are each reported; a candidate of any length is one
candidate, and a text may hold any number; columns of other names are ignored by find() and kept by redact(). find() reports
each row's candidates under the row's key, also of null and repeated keys. redact() goes by the text alone, so rows can't take
each other's spans; in a redacted text the control character MARK has become a space. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import sent_if_few, staged

MIN_LENGTH = 16
MIN_VALUE = 6
SIDE = 48
MARK = "\x01"

#: Words that names, paths and prose are made of, and words that stand by secrets or by harmless digests.
DICTIONARY = (
    "about", "account", "action", "admin", "after", "agent", "array", "asset", "async", "base", "batch", "block", "buffer", "build", "button",
    "cache", "change", "check", "class", "client", "code", "column", "common", "config", "content", "context", "control", "core", "count", "create",
    "data", "date", "default", "delete", "device", "document", "element", "error", "event", "example", "export", "factory", "field", "file", "filter",
    "first", "form", "format", "from", "function", "group", "handler", "header", "home", "http", "image", "import", "index", "info", "input",
    "interface", "internal", "item", "java", "lang", "last", "library", "list", "local", "main", "manager", "message", "method", "model", "module",
    "name", "network", "node", "number", "object", "option", "order", "output", "package", "page", "param", "parse", "path", "process", "project",
    "property", "public", "query", "read", "record", "release", "report", "request", "resource", "response", "result", "return", "schema", "script", "search",
    "server", "service", "session", "source", "spring", "state", "static", "status", "stream", "string", "style", "system", "table", "target", "task",
    "template", "test", "text", "thread", "time", "type", "update", "user", "util", "value", "version", "view", "window", "with", "work", "write",
)
SECRET_WORDS = (
    "token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "bearer", "credential", "client_secret", "key",
    "passwort", "kennwort", "geheimnis", "zugangscode", "contraseña", "contrasena", "clave", "mot de passe", "jeton")
HARMLESS_WORDS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "revision", "etag", "integrity", "build", "example", "sample", "image", "version")


_BY_SIGN = r"[A-Za-z0-9_]{0,16}[\"']?\s{0,3}(?::=|=>|[=:])\s{0,3}"
_BY_WORD = r"\s{1,3}(?i:is|ist|lautet|es|est)\s{0,3}:?\s{1,3}"
_ASSIGNED = rf"((?i:{'|'.join(SECRET_WORDS)}|contraseÑa)(?:{_BY_SIGN}|{_BY_WORD})[\"'`]?)([^\s\"'`]{{{MIN_VALUE - 1},}}[^\s\"'`.,;:)\]}}])"
_IN_URL = r"(://[^\s/:@]{1,64}:)([^\s/@]{3,}+)(?=@)"
_TOKEN = rf"(?<![A-Za-z0-9_+/-])([A-Za-z0-9_+/-]{{{MIN_LENGTH},}}+(?:={{1,2}}(?![\w+/\"'=-])|(?![\"']\s{{0,3}}:|[\"']?\s{{0,3}}=)))"
_BLOCK = rf"(-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----)([^-]{{{MIN_LENGTH},}}+)(?=-----END)"
FORM = f"{_ASSIGNED}|{_IN_URL}|{_TOKEN}|{_BLOCK}"


def split_parts(text: Column) -> Column:
    """Text between candidates at even places from 0, candidates at odd ones."""
    return F.split(F.regexp_replace(F.translate(text, MARK, " "), FORM, f"$1$3$6{MARK}$2$4$5$7{MARK}"), MARK, -1)


def _starts(parts: Column) -> Column:
    """Characters before each part: running sums in blocks of the root of their number, so that no long array is copied often."""
    lengths, wide = F.transform(parts, F.length), F.greatest(F.ceil(F.sqrt(F.size(parts))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / wide).cast("int")), lambda i: F.slice(lengths, i * wide + 1, wide))
    zero = F.lit(0).cast("int")
    running = lambda xs, at: F.slice(F.aggregate(xs, F.array(at), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), F.lit(1), F.size(xs))
    base = running(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, n: acc + n)), zero)
    return F.flatten(F.zip_with(blocks, base, running))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start (characters before it), candidate, and up to SIDE characters before and after."""
    rows = docs.select(F.col(key).alias("key"), split_parts(F.col(text)).alias("parts")).where(F.size("parts") > 1).withColumn("starts", _starts(F.col("parts")))
    at = F.sequence(F.lit(1), F.size("parts") - 1, F.lit(2))
    part = lambda i: F.get("parts", i)
    found = F.transform(at, lambda i: F.struct(F.get("starts", i).cast("long").alias("start"), part(i).alias("candidate"), F.substring(part(i - 1), -SIDE, SIDE).alias("before"), F.substring(part(i + 1), 1, SIDE).alias("after")))
    return rows.select("key", F.inline(found))


#: Letters without case, digits as one, all else as one.
_CODES = 28


def _transitions(c: Column) -> Column:
    """The candidate's pairs of neighbouring characters as numbers below _CODES squared."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "{"), "[^a-z{]", "|")  # both follow z
    codes = F.transform(F.filter(F.split(plain, ""), lambda x: x != ""), lambda x: F.ascii(x) - 97)
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * _CODES + b)


def transition_odds(findings: DataFrame) -> list[float]:
    """Log-odds of each transition between secrets and other findings; rare ones are smoothed."""
    counts = {(r["label"], r["t"]): r["n"] for r in findings.select((F.col("label") > 0).alias("label"), F.explode(_transitions(F.col("candidate"))).alias("t")).groupBy("label", "t").agg(F.count("*").alias("n")).collect()}
    total = {label: sum(n for (k, _), n in counts.items() if k == label) for label in (False, True)}
    share = lambda label, t: (counts.get((label, t), 0) + 1) / (total[label] + _CODES**2)
    return [log(share(True, t) / share(False, t)) for t in range(_CODES**2)]


def _share(pattern: str, of: Column) -> Column:
    """Share of the characters that the pattern covers."""
    return (F.length(of) - F.length(F.regexp_replace(of, pattern, ""))) / F.greatest(F.length(of), F.lit(1))


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def features(odds: list[float]) -> dict[str, Column]:
    c, before, after = F.col("candidate"), F.lower("before"), F.lower("after")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "1"), "[A-Z]", "2"), "[^012]", "3")
    pairs, table = _transitions(c), F.array(*[F.lit(x) for x in odds])
    near = F.regexp_extract(before, r"(\S*\s*\S*\s*\S*)$", 1)
    return {
        "length": F.least(F.length(c), F.lit(200)).cast("double"),
        "digits": _share("[0-9]", c),
        "upper": _share("[A-Z]", c),
        "symbols": _share("[^A-Za-z0-9]", c),
        "vowels": _share("[aeiouyAEIOUY]", c),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.greatest(F.length(c), F.lit(1)),
        "transitions": F.aggregate(pairs, F.lit(0.0), lambda acc, t: acc + F.get(table, t)) / F.greatest(F.size(pairs), F.lit(1)),
        "changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / F.greatest(F.length(c) - 1, F.lit(1)),
        "hex": _flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "dictionary": _share(f"({'|'.join(DICTIONARY)})", F.lower(c)),
        "slashes": F.least(F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))), F.lit(6)).cast("double"),
        "in_url": _flag(before.rlike(r"://\S*:$") & after.rlike("^@")),
        "path": _flag(c.rlike(r"^/?[A-Za-z0-9_-]{1,20}(/[A-Za-z0-9_-]{1,20}){2,}") | after.rlike(r"^\.[a-z]{1,5}\b") | before.rlike(r"(://|www\.|[./~])\S*$")),
        "separators": _share("[_-]", c),
        "secret_word": _flag(near.rlike(f"({'|'.join(SECRET_WORDS)})")),
        "harmless_word": _flag(near.rlike(f"({'|'.join(HARMLESS_WORDS)})")),
        "assigned": _flag(before.rlike(r"([=:]|\s(is|ist|lautet|es|est))\s*[\"'`]?$")),
        "key_block": _flag(before.rlike("private key-----$")),
        "quoted": _flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        "placeholder": _flag(F.lower(c).rlike(r"example|placeholder|changeme|your[_-]|xxxx|dummy|(.)\1{7}|01234567|abcdefgh")),
    }


def labelled_findings(spark: SparkSession, n: int = 4000, first: int = 0) -> DataFrame:
    """A labelled set made by rule from the ids first to first + n - 1: before, candidate, after, label. Random keys and passwords
    of usual alphabets and lengths in assignments and URLs are secrets; paths, identifiers, words, digests that are named as such,
    UUIDs and placeholders are not. Sets of other ids share hardly any findings."""
    h = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), F.col("id").cast("string")), 256)
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    b64 = F.base64(F.unhex(F.concat(h("b"), h("c"))))
    word = lambda salt: pick(DICTIONARY, salt)
    keyed = F.concat(pick(("the ", "", "with set ", "x. ", "env "), 1), F.when(F.col("id") % 7 == 0, F.upper(pick(SECRET_WORDS, 2))).otherwise(pick(SECRET_WORDS, 2)), pick((" = ", "=", ": ", " = \"", "=\"", ": '", "\": \""), 3))
    said = F.concat(pick(("the ", "", "das ", "la ", "le "), 32), pick(SECRET_WORDS, 33), pick((" is ", " ist ", " lautet: ", " es ", " est ", " : "), 34))
    block = F.concat(F.lit("-----BEGIN "), pick(("RSA ", "", "EC ", "OPENSSH "), 35), F.lit("PRIVATE KEY-----"))
    prose = F.concat(pick(("in the ", "see ", "of ", "and ", "with these "), 4), word(5), pick((" ", ", ", " (", "\n"), 6))
    harmless = F.concat(pick(("at ", "", "from "), 7), pick(HARMLESS_WORDS, 8), pick((" ", ": ", " = ", "=\"", "-"), 9))
    camel = F.concat(word(10), F.initcap(word(11)), F.initcap(word(12)), F.initcap(word(13)), F.initcap(word(20)))
    snake = F.concat_ws("_", word(10), word(11), word(12), word(13))
    path = F.concat(pick(("/", "", "/home/"), 14), F.concat_ws("/", word(10), word(11), word(12), word(13)))
    syllables = F.concat(*[pick(("an", "the", "ing", "er", "tion", "keit", "ver", "ment", "ción", "ou", "sch", "re"), 30 + i) for i in range(7)])
    uuid = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12))
    holder = F.concat(pick(("your-", "EXAMPLE", "example-", "changeme-", "dummy_"), 15), pick(("xxxxxxxxxxxxxxxx", "key-placeholder", "0123456789abcdef", "AAAAAAAAAAAAAAAA"), 16))
    hex_key = F.expr("substring(sha2(concat('k-', cast(id as string)), 512), 1, cast(pmod(xxhash64(id, 17), 45) + 20 as int))")
    mixed = F.translate(F.substring(b64, 5, 12), "\r\n+/aeiou", "xy!#@4$&%*")
    password = F.substring(mixed, 1, (F.pmod(F.xxhash64("id", F.lit(19)), F.lit(6)) + 7).cast("int"))
    spoken = F.concat(F.initcap(word(21)), pick(("", "-", "_", "."), 22), F.substring(b64, 30, 3), pick(("!", "#", "7", "?", "2024"), 23))
    short_hex = F.substring(h("s"), 1, (F.pmod(F.xxhash64("id", F.lit(24)), F.lit(9)) + 8).cast("int"))
    plain = F.concat(word(25), pick(("", "s", "ing", "_id", "-name", ".txt", "()"), 26), pick(("", "able", "ment", "ation"), 27))
    url = F.concat(pick(("see ", "", "url=", "at "), 28), pick(("https://", "postgres://", "redis://", "amqp://", "ftp://"), 29), word(10), F.lit(":"))
    adverb = pick(("importante", "obligatoire", "erforderlich", "falsch", "nécessaire", "incorrecta", "abgelaufen", "invalide", "required", "missing", "secreto", "geheim", "trop court", "demasiado corta", "wichtig", "invalid"), 36)
    kinds = [
        (1, said, password, " "), (1, said, spoken, "\n"), (1, said, hex_key, " "), (0, said, adverb, " "), (0, said, plain, " "), (0, said, F.translate(syllables, "ó", "o"), " "),
        (1, block, F.concat(F.lit("\n"), b64, F.lit("\n"), F.base64(F.unhex(h("k"))), F.lit("\n")), "-----END"), (0, block, pick(("\n<your private key here>\n", "\n...your key goes here...\n", "\nxxxxxxxxxxxxxxxxxxxxxxxx\n"), 37), "-----END"),
        (1, keyed, password, '"'), (1, keyed, password, " "), (1, keyed, spoken, " "), (1, keyed, short_hex, "\n"), (1, url, password, "@"), (1, url, hex_key, "@"), (1, url, spoken, "@"),
        (0, keyed, plain, " "), (0, keyed, plain, '"'), (0, keyed, F.concat(word(10), F.lit("."), word(11), F.lit("()")), "\n"), (0, url, F.lpad((F.col("id") % 60000 + 1024).cast("string"), 4, "0"), "@"),
        (0, keyed, pick(("required", "optional", "string", "<password>", "********", "${SECRET}", "{{token}}", "None", "process.env.TOKEN", "os.environ"), 31), "\n"),
        (1, keyed, hex_key, '"'), (1, keyed, F.expr("substring(sha2(concat('q-', cast(id as string)), 256), 1, 40)"), '"'), (1, keyed, F.upper(hex_key), '"'), (1, keyed, F.translate(F.substring(b64, 1, 44), "\r\n+", "xy/"), '"'),
        (1, keyed, F.concat(pick(("sk_live_", "AKIA", "ghp_", "xoxb-", "glpat-"), 18), F.translate(F.substring(b64, 3, 28), "\r\n+/", "xyAB")), "\n"),
        (1, prose, F.concat(pick(("sk_live_", "AKIA", "ghp_", "xoxb-", "glpat-"), 18), F.translate(F.substring(b64, 3, 28), "\r\n+/", "xyAB")), " "),
        (0, prose, path, ".py"), (0, prose, path, " "), (0, prose, camel, "()"), (0, keyed, camel, "."), (0, prose, snake, " "), (0, keyed, snake, "("), (0, prose, F.translate(syllables, "ó", "o"), ". "), (0, prose, F.upper(F.translate(syllables, "ó", "o")), " "),
        (0, harmless, F.expr("substring(sha2(concat('d-', cast(id as string)), 256), 1, element_at(array(32, 40, 64), cast(pmod(id, 3) + 1 as int)))"), " "), (0, prose, uuid, " "), (0, keyed, holder, '"'), (0, prose, F.lpad(F.lit(""), 24, "-"), "\n"),
        (0, prose, F.lpad(F.conv(F.substring(h("n"), 1, 12), 16, 10), 16, "7"), " "), (0, F.concat(F.lit("https://"), word(5), F.lit(".org/")), path, " "),
    ]
    base = spark.range(first, first + n, 1, 4)
    branch = lambda i: F.element_at(F.array(*[k[i] if isinstance(k[i], Column) else F.lit(k[i]) for k in kinds]), (F.col("id") % len(kinds) + 1).cast("int"))
    return base.select(F.substring(branch(1), -SIDE, SIDE).alias("before"), branch(2).alias("candidate"), branch(3).alias("after"), branch(0).cast("double").alias("label"))


@dataclass
class SecretModel:
    odds: list[float]
    forest: PipelineModel


def _featured(rows: DataFrame, odds: list[float], keep: list[str]) -> DataFrame:
    return rows.select(*keep, *[c.cast("double").alias("f_" + k) for k, c in features(odds).items()])


def fit(findings: DataFrame, trees: int = 32, depth: int = 9, seed: int = 11) -> SecretModel:
    """The forest for findings of before, candidate, after and label. The findings are the bounded training set."""
    odds = transition_odds(findings)
    rows = _featured(findings, odds, ["label"])
    assembler = VectorAssembler(inputCols=rows.columns[1:], outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="p")
    return SecretModel(odds, PipelineModel([assembler, forest.fit(assembler.transform(rows))]))


def score(findings: DataFrame, model: SecretModel, keep: list[str]) -> DataFrame:
    """The columns `keep` of findings (before, candidate, after) and probability."""
    kept = F.struct(*keep).alias("kept")
    scored = model.forest.transform(_featured(findings.select(kept, "before", "candidate", "after"), model.odds, ["kept"]))
    return scored.select("kept.*", vector_to_array("p")[1].alias("probability"))


def find(docs: DataFrame, model: SecretModel, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every candidate: key, start, length, sha256 of it, probability and whether it is taken for a secret."""
    rows = candidates(docs, key, text).withColumns({"length": F.length("candidate").cast("long"), "sha256": F.sha2("candidate", 256)})
    scored = score(rows, model, ["key", "start", "length", "sha256"])
    return scored.select(F.col("key").alias(key), "start", "length", "sha256", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: SecretModel, text: str = "text", label: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """docs with each secret in text replaced by label; other rows and columns as they are."""
    found = find(docs.select(F.sha2(text, 256).alias("of"), text), model, "of", text, threshold)
    flags = F.array_sort(F.collect_set(F.struct("start", "is_secret")))
    spans = staged(found.groupBy("of").agg(F.transform(flags, lambda x: x["is_secret"]).alias("flags"), F.max("is_secret").alias("any")).where("any").select("of", "flags"), "secrets")
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # whatever their names, columns can't clash with those of spans
    t = F.col("row")[text]
    joined = rows.join(sent_if_few(spans, 2 + F.size("flags") / 16), F.sha2(t, 256) == F.col("of"), "left")
    parts = F.transform(split_parts(t), lambda x, i: F.when((i % 2 == 1) & F.get("flags", F.floor(i / 2).cast("int")), label).otherwise(x))
    new = F.when(F.col("flags").isNull(), t).otherwise(F.array_join(parts, ""))
    return joined.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
