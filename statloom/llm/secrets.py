"""Secret scanner: candidate strings, and a random forest that removes false positives.

Candidates are: runs of at least `least` letters, digits and key signs with a digit in them;
values of at least `short` signs that are given to a name such as token or password; passwords in
URLs; strings that begin like the keys of well-known services; and private key blocks. The forest
sees a candidate's length, its transitions between kinds of characters, how much of it common
word parts cover, its path (the document's source) and the words beside it. It is trained on
labelled findings: given ones (columns as features() has them, and label), or those of
labelled_findings(), texts made with known secrets and look-alikes in them, where the label says
which was put in and not what a rule over the features thinks. Training takes at most `sample`
findings, half of each label where there are so many; everything else covers all rows.

Every step is a DataFrame operation; nothing runs Python on the executors.

A null or empty text has no findings, a null source counts as empty, a null doc_id is kept.
Texts count in whole, however long. A secret that a document repeats is one finding with a
count; rows that repeat doc_id and text count as one document, whose counts add up. Given
findings of one label only can't train a forest and are an error. An empty table gives no
rows; other columns are ignored by scan() and kept by redact().
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stage, unused

LEAST, SHORT = 16, 8
SAMPLE = 20_000
#: Texts that labelled_findings() makes.
MADE = 9_000
#: Names that secrets are given to, in lower case.
NAMES = "token|secret|passw|passphrase|pwd|api.?key|apikey|auth|credential|private.?key|access.?key|bearer"
#: Names of values that look like secrets and are none.
OTHERS = "commit|sha\\d*|md5|hash|checksum|digest|uuid|guid|etag|revision|build|version|order|invoice|isbn|phone|call|id|ref|sum|image"
#: Beginnings of the keys of well-known services.
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|rk_live_|sk-|AIza|eyJ|SG\\.|npm_|hf_"
#: Frequent parts of words, for the share of a candidate that they cover.
PARTS = "the|ing|and|ion|ent|tion|for|ment|that|with|ver|ter|her|est|ous|able|ness|ism|ist|ate|ere|all|are|was|one|you|not|this|from|have|data|user|name|file|test|null|true|http|www|com|org|der|die|und|ein|ich|sch|que|les|des|las|los|con|por"
#: Words of values that stand for a secret and are none.
STANDINS = "your|example|change.?me|placeholder|sample|dummy|redacted|xxxx|\\*\\*\\*\\*|environ|getenv|config|secret|token|passw|key|none|null|undefined|required|default"
#: Paths that seldom hold live secrets.
TAME = "test|example|sample|fixture|doc|mock"
FEATURES = (
    "length", "digits", "capitals", "marks", "calls", "turns", "distinct", "vowels", "covered", "standin", "longest_letters", "longest_digits", "hex", "uuid",
    "prefixed", "block", "quoted", "assigned", "named", "in_url", "other_name", "words_near", "tame_path",
)
_QUOTE = "[\"'`]"
_PEM = r"(?s)(-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z))"
_NAMED = f"(?i)(?:{NAMES})[a-z0-9_.\\-]*{_QUOTE}?"
_URL = "://[^/\\s:@]*:([^/\\s@]{4,})@"


def _inline(n: int) -> str:
    """A name and a value of at least n signs in one chunk; group 1 is a quoted value, group 2 another."""
    return f"{_NAMED}(?:[=:]+>?)(?:{_QUOTE}([^\\s\"'`]{{{n},}})|([^\\s\"'`,;)\\]}}]{{{n},}}))"


def candidates(docs: DataFrame, least: int = LEAST, short: int = SHORT) -> DataFrame:
    """(row, doc_id, source, secret, before, after): a row for each candidate, with the words beside it."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    run = f"[A-Za-z0-9+/_\\-]{{{least},}}"
    inline = _inline(short)
    text = F.col("text").cast("string")
    chunks = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source.alias("source"),
        F.xxhash64("doc_id", "text").alias("row"),
        F.split(text, r"\s+").alias("w"),
        F.when(F.contains(text, F.lit("PRIVATE KEY-----")), F.regexp_extract_all(text, F.lit(_PEM), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("blocks"),
    )
    at = lambda i: F.coalesce(F.try_element_at("w", F.when(i > 0, i)), F.lit(""))

    def given(i: Column) -> Column:
        """Whether the words before chunk i give it to a telling name."""
        sign = at(i - 1)
        ends = F.right(sign, F.lit(1)).isin("=", ":")
        alone = F.length(sign) <= 2
        return ends & F.when(alone, at(i - 2).rlike(f"{_NAMED}$")).otherwise(sign.rlike(f"{_NAMED}[=:]+$"))

    def wanted(i: Column) -> Column:
        c = F.element_at("w", i)
        # a chunk's length tells most chunks apart before any pattern does
        long = (F.length(c) >= least) & c.rlike(run) & c.rlike("[0-9]")
        other = (F.length(c) >= short) & (given(i) | (F.contains(c, F.lit("@")) & c.rlike(_URL)) | c.rlike(f"(?:{PREFIXES})[A-Za-z0-9_.\\-]{{12,}}") | (c.rlike("[=:]") & c.rlike(inline)))
        return (long | other) & ((F.size("blocks") == 0) | ~F.contains(F.concat_ws(" ", "blocks"), c))

    spots = F.transform(
        F.filter(F.sequence(F.lit(1), F.size("w")), wanted),
        lambda i: F.struct(F.element_at("w", i).alias("chunk"), F.concat_ws(" ", at(i - 2), at(i - 1)).alias("before"), at(i + 1).alias("after"), given(i).alias("given")),
    )
    whole = F.transform("blocks", lambda b: F.struct(b.alias("chunk"), F.lit("").alias("before"), F.lit("").alias("after"), F.lit(False).alias("given")))
    found = chunks.where("size(w) > 0").select("row", "doc_id", "source", F.explode(F.concat(spots, whole)).alias("x")).select("row", "doc_id", "source", "x.*")
    c = F.col("chunk")
    got = lambda pattern, k=1: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    value = F.coalesce(got(f"^({_QUOTE})([^\"'`]{{{short},}})\\1", 2), got(f"^([^\\s\"'`,;)\\]}}]{{{short},}})"))
    value = F.coalesce(F.when(F.col("given"), value), got(inline, 1), got(inline, 2))
    named = F.filter(F.array(value, got(_URL)), lambda x: x.isNotNull())
    runs = F.filter(F.regexp_extract_all(c, F.lit(f"({run})"), F.lit(1)), lambda r: r.rlike("[0-9]") | r.rlike(f"^(?:{PREFIXES})"))
    keys = F.regexp_extract_all(c, F.lit(f"((?:{PREFIXES})[A-Za-z0-9_.\\-]{{11,}}[A-Za-z0-9_\\-])"), F.lit(1))
    inside = lambda r, held: F.exists(held, lambda v: F.contains(v, r))
    named = F.concat(named, F.filter(keys, lambda k: ~inside(k, named)))
    every = F.when(F.startswith(c, F.lit("-----BEGIN ")), F.array(c)).otherwise(F.array_distinct(F.concat(named, F.filter(runs, lambda r: ~inside(r, named)))))
    found = found.withColumn("secret", F.explode(every))
    lead = F.concat_ws(" ", "before", F.expr("substring_index(chunk, secret, 1)"))
    return found.select("row", "doc_id", "source", "secret", lead.alias("before"), F.concat(F.expr("substring_index(chunk, secret, -1)"), F.lit(" "), F.col("after")).alias("after"))


def _count(column: Column, pattern: str) -> Column:
    return F.regexp_count(column, F.lit(pattern)).cast("double")


def _longest(column: Column, outside: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(column, outside), F.length)), F.lit(0)).cast("double")


def features(found: DataFrame) -> DataFrame:
    """candidates() with the columns of FEATURES."""
    s, low, before = F.col("secret"), F.lower("secret"), F.lower("before")
    n = F.length("secret").cast("double")
    turns = _count(s, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")
    flag = lambda c: c.cast("double")
    return found.select(
        "*",
        n.alias("length"),
        (_count(s, "[0-9]") / n).alias("digits"),
        (_count(s, "[A-Z]") / n).alias("capitals"),
        (_count(s, "[^A-Za-z0-9]") / n).alias("marks"),
        _count(s, r"[(){}\[\]<>$\\]").alias("calls"),
        (turns / n).alias("turns"),
        (F.size(F.array_distinct(F.split(low, ""))) / n).alias("distinct"),
        (_count(low, "[aeiou]") / n).alias("vowels"),
        (1 - F.length(F.regexp_replace(low, PARTS, "")) / n).alias("covered"),
        flag(low.rlike(STANDINS)).alias("standin"),
        _longest(low, "[^a-z]").alias("longest_letters"),
        _longest(s, "[^0-9]").alias("longest_digits"),
        flag(low.rlike("^[0-9a-f]+$")).alias("hex"),
        flag(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")).alias("uuid"),
        flag(s.rlike(f"^(?:{PREFIXES})")).alias("prefixed"),
        flag(F.startswith(s, F.lit("-----BEGIN "))).alias("block"),
        flag(before.rlike("[\"'`]$")).alias("quoted"),
        flag(before.rlike("[=:]>?\\s*[\"'`]?$")).alias("assigned"),
        flag(before.rlike(f"({NAMES})[a-z0-9_.\\-]*[\"'`]?\\s*[=:]*>?\\s*[\"'`]?$")).alias("named"),
        flag(before.rlike("://[^/\\s]*:?$")).alias("in_url"),
        flag(before.rlike(f"\\b(?:{OTHERS})[\"'`]?\\s*[=:#,/]*\\s*[\"'`]?(?:sha\\d+:)?$")).alias("other_name"),
        _count(F.concat_ws(" ", "before", "after"), "\\p{L}{2,}").alias("words_near"),
        flag(F.lower("source").rlike(TAME)).alias("tame_path"),
    )


def labelled_findings(spark: SparkSession, made: int = MADE, seed: int = 1, least: int = LEAST, short: int = SHORT) -> DataFrame:
    """features() of the findings of `made` texts with a known secret or a known look-alike in each, and label (1 or 0)."""
    i = F.col("id")
    hashed = lambda k: F.sha2(F.concat_ws("-", F.lit(str(seed)), i.cast("string"), F.lit(str(k))), 256)
    pick = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), i, F.lit(k)), F.lit(n)).cast("int")
    of = lambda k, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), pick(k, len(xs)) + 1)
    cut = lambda x, low, high, k: F.substring(x, F.lit(1), pick(k, high - low + 1) + low)
    # the building blocks are written first, so that no expression below holds all of them
    part = lambda k: F.element_at(F.split(F.lit(PARTS), r"\|"), pick(k, len(PARTS.split("|"))) + 1)
    plain64 = F.base64(F.unhex(F.concat(hashed("a"), hashed("b"))))
    base = spark.range(0, made, 1, 1).select(
        i, F.concat(hashed("c"), hashed("d")).alias("hexes"), F.regexp_replace(plain64, "[+/=\\s]", "").alias("mixed"), F.regexp_replace(plain64, "\\s", "").alias("base64"),
        *[F.concat(part(f"{k}1"), part(f"{k}2"), F.when(pick(k, 2) == 1, part(f"{k}3")).otherwise("")).alias(f"w{k}") for k in range(9)],
        *[F.lpad(F.pmod(F.xxhash64(F.lit(seed), i, F.lit(f"n{k}")), F.lit(10**18)).cast("string"), 18, "7").alias(f"n{k}") for k in range(4)],
    )
    base = stage(base, "made")
    word = lambda k: F.col(f"w{k}")
    number = lambda k, n: F.substring(F.col(f"n{k}"), 1, n)
    hexes, mixed, base64 = F.col("hexes"), F.col("mixed"), F.col("base64")
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    sign = of("sign", *"!@#$%&*?.")
    passwords = [F.concat(F.initcap(word(1)), number(0, 3), sign), F.concat(cut(mixed, 6, 12, "p3"), sign, number(1, 2)), cut(mixed, 9, 15, "p5"), F.concat(word(2), sign, number(2, 4))]
    keys = [F.substring(hexes, 1, 32), F.substring(hexes, 1, 40), F.substring(hexes, 1, 64), cut(mixed, 20, 44, "k1"), cut(base64, 24, 60, "k2")]
    service = [F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), F.concat(F.lit("xoxb-"), number(0, 11), F.lit("-"), F.substring(mixed, 1, 24)), F.concat(F.lit("AIza"), F.substring(mixed, 1, 35))]
    password, key = of("pw", *passwords), of("key", *keys)
    block = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), base64, F.lit("\n-----END RSA PRIVATE KEY-----"))
    name = of("name", "token", "api_key", "apikey", "secret", "client_secret", "password", "passwd", "auth_token", "access_key", "SECRET_KEY", "db_password", "API-KEY", "credential")
    link = of("link", " = ", "=", ": ", " := ", " : ", " => ")
    quote = of("quote", '"', '"', "'", "")
    given = F.concat(name, link, quote)
    other = F.concat(of("other", "commit", "sha256", "checksum", "id", "uuid", "order", "build", "etag", "md5", "image", "ref", "digest"), of("l2", " ", "=", ": ", " = ", ":"), quote)
    identifier = of("ident", F.concat(word(3), F.initcap(word(4)), number(1, 2), F.initcap(word(5))), F.concat_ws("_", word(3), word(4), number(1, 2)), F.concat_ws("-", word(3), word(4), word(5), number(1, 4)))
    standins = [F.concat(F.lit("your_"), name, F.lit("_here")), F.lit("changeme123"), F.lit("xxxxxxxxxxxxxxxx"), F.concat(F.lit("${"), F.upper(name), F.lit("}")), F.concat(F.lit("<"), name, F.lit(">")), F.concat(F.lit("os.environ['"), name, F.lit("']")), F.concat(F.lit("get_"), name, F.lit("()")), F.concat(F.lit("self."), name), F.lit("required_field"), F.lit("********"), F.concat(F.lit("config."), word(6), F.lit("."), name)]
    stamp = of("stamp", F.concat(F.lit("IMG_"), number(0, 8), F.lit("_"), number(1, 6), F.lit(".jpg")), F.concat(F.lit("2024-01-"), number(2, 2), F.lit("T"), number(3, 6), F.lit("Z"), number(1, 3)))
    none = F.lit("")
    end, closing = of("q3", "", '"', ")", "."), of("q4", "", ",", ".", "$$$", ")")
    kinds = [  # (secret or not, planted string, what stands before it, what stands after)
        (1, password, given, quote), (1, key, given, quote), (1, of("service", *service), given, quote),
        (1, key, F.concat(F.lit('{"'), name, F.lit('": "')), F.lit('"}')),
        (1, key, F.concat(F.lit("export "), F.upper(F.replace(name, F.lit("-"), F.lit("_"))), F.lit("=")), none),
        (1, key, F.lit("Authorization: Bearer "), none),
        (1, of("service", *service), of("q2", "", '"', "("), end),
        (1, password, F.concat(of("scheme", "postgres", "https", "amqp", "ftp"), F.lit("://"), word(6), F.lit(":")), F.concat(F.lit("@"), word(7), F.lit(".example.org/db"))),
        (1, block, none, none),
        (0, of("plain", F.substring(hexes, 1, 40), F.substring(hexes, 1, 64), uuid, number(0, 16)), other, quote),
        (0, of("bare", F.substring(hexes, 1, 40), uuid, number(0, 16), number(1, 18)), none, closing),
        (0, identifier, none, closing), (0, stamp, none, closing), (0, identifier, other, quote),
        (0, of("standin", *standins), given, quote),
        (0, of("var", F.concat_ws("_", word(5), name), F.concat(F.lit("self."), word(3), F.lit("_"), word(4))), F.concat(name, link), none),
        (0, F.concat(F.lit("https://"), word(6), F.lit(".example.org/"), number(2, 4), F.lit("/"), identifier), none, none),
        (0, base64, F.lit("data:image/png;base64,"), none),
        (0, F.concat(word(6), F.lit("."), word(7), F.lit("@mail.example.org")), F.lit("mail: "), none),
    ]
    texts = None
    for k, (label, planted, lead, tail) in enumerate(kinds):
        tame = F.when(F.lit(label == 1) & (pick("path", 10) > 0), of("src", "web", "src/app", "config", "forum", "")).otherwise(of("src2", "web", "src/app", "tests/fixtures", "docs/examples", ""))
        text = F.concat(word(0), F.lit(" "), word(8), F.lit(" "), lead, planted, tail, F.lit(" "), word(5), F.lit(" "), word(3))
        own = base.where(F.pmod(i, F.lit(len(kinds))) == k).select(i.alias("doc_id"), tame.alias("source"), text.alias("text"), F.lit(label).alias("secret_in"), planted.alias("planted"))
        texts = own if texts is None else texts.unionByName(own)
    texts = stage(texts, "labelled-texts")
    found = features(candidates(texts, least, short)).join(texts.select("doc_id", "secret_in", "planted"), "doc_id")
    # a string that holds a whole planted secret, or is a long piece of it, is the secret's finding
    hit = F.contains("planted", F.col("secret")) & (F.length("secret") >= F.length("planted") / 2)
    return found.withColumn("label", F.when(hit, F.col("secret_in")).otherwise(0).cast("double")).drop("secret_in", "planted")


def _forest(known: DataFrame, sample: int, trees: int):
    """A forest trained on at most `sample` findings, half of each label: those with the least hashes."""
    known = known.select(*FEATURES, F.col("label").cast("double").alias("label"), F.xxhash64(*FEATURES).alias("h"))
    halves = [known.where(F.col("label") == x).orderBy("h", *FEATURES).limit(sample // 2) for x in (0.0, 1.0)]
    chosen = stage(halves[0].unionByName(halves[1]).coalesce(1), "labelled")
    count = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}  # two rows
    if len(count) < 2:
        raise ValueError("labelled findings of both labels are needed")
    weight = F.when(F.col("label") == 1, F.lit(1.0 / count[1.0])).otherwise(F.lit(1.0 / count[0.0]))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=10, minInstancesPerNode=2, seed=7, weightCol="weight", labelCol="label", featuresCol="features")
    model = forest.fit(vector.transform(chosen.withColumn("weight", weight)))
    return lambda found: model.transform(vector.transform(found)).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def _judged(docs: DataFrame, labelled: DataFrame | None, least: int, short: int, sample: int, trees: int, threshold: float) -> DataFrame:
    """candidates with probability and verdict. The texts are read once: candidates are few, and are written for what follows."""
    found = stage(features(candidates(docs, least, short)), "candidates")
    known = labelled if labelled is not None else labelled_findings(docs.sparkSession, least=least, short=short)
    return _forest(known, sample, trees)(found).where(F.col("probability") > threshold)


def scan(docs: DataFrame, labelled: DataFrame | None = None, least: int = LEAST, short: int = SHORT, sample: int = SAMPLE, trees: int = 30, threshold: float = 0.5) -> DataFrame:
    """(doc_id, secret, occurrences, context, probability): the findings that the forest takes for secrets."""
    kept = _judged(docs, labelled, least, short, sample, trees, threshold)
    return kept.groupBy("row", "doc_id", "secret").agg(F.count("*").alias("occurrences"), F.min("before").alias("context"), F.max("probability").alias("probability")).drop("row")


def redact(docs: DataFrame, labelled: DataFrame | None = None, least: int = LEAST, short: int = SHORT, sample: int = SAMPLE, trees: int = 30, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by `mark`, and n_chars, where there is one, made to fit; no row goes, and all columns stay, whatever their names."""
    kept = _judged(docs, labelled, least, short, sample, trees, threshold)
    row, hits = unused(docs, "__row"), unused(docs, "__found")
    # longest first, so that no secret leaves the rest of a longer one behind; a text bounds its own list
    secrets = kept.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_set(F.struct(F.length("secret").alias("n"), "secret")), asc=False).alias(hits))
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    clean = F.aggregate(hits, F.col("text"), lambda text, x: F.replace(text, x["secret"], F.lit(mark)))
    out = keyed.join(secrets, row, "left")
    new = {"text": F.when(F.col(hits).isNull(), F.col("text")).otherwise(clean)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(hits).isNull(), F.col("n_chars")).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))
    return out.withColumns(new).select(*docs.columns)
