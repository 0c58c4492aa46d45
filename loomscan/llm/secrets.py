"""Secret scans in DataFrame operations: candidate strings, and a random forest against false positives.

A pattern cuts every text into candidates and what lies between them.  Each candidate's
length, character transitions, dictionary coverage, path and neighbouring words are
features of a random forest that Spark's own trainer fits on labelled findings.  The
forest is written out as one SQL expression over the array of a row's candidates, so a
scan is a single pass without shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscan.llm.graph import keep

_T = "A-Za-z0-9+/_~\\-"
#: An unquoted value's characters; a dot or question mark at its end belongs to the sentence.
_V = rf"{_T}!@#$%^&*|.?"
_ASSIGNED = r"(?<=[=: \t\"'])(?<=[=:][ \t]{0,3}"
# A link is no value, nor is quoted text that holds assignments of its own; what they assign is.
_LINK = r"(?!(?:[A-Za-z][A-Za-z0-9+.\-]{0,31}:)?//)"


def _quoted(mark: str) -> str:
    names = rf"(?![A-Za-z_][A-Za-z0-9_.\-]{{2,63}}[=:][^={mark}])(?![^\s{mark}]*[?&;,{{][A-Za-z_][A-Za-z0-9_.\-]{{0,63}}[=:])"
    return rf"{_ASSIGNED}{mark}){_LINK}{names}[^\s{mark}]{{8,}}+(?={mark})"


#: A key block up to its end line or, where there is none, its key's characters; a web
#: token; a link's password; what follows the word bearer; the whole of an assigned value
#: from 8 characters on; or a long run with a digit.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^\-]++|-(?!----(?:END|BEGIN) ))*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:\s|\\[rn]){0,4}+[A-Za-z0-9+/=_\-]{6,}+)*+"
    r"|(?<=:)(?<=://[^\s/@:]{1,64}:)[^\s/@]{8,}+(?=@)"
    r"|(?<=r[ ])(?<=\b[Bb]earer[ ])[A-Za-z0-9._~+/\-]{16,}+={0,2}"
    rf"|(?<![{_T}.])eyJ[A-Za-z0-9_\-]{{8,}}+\.[A-Za-z0-9_\-]++\.[A-Za-z0-9_\-]++"
    rf"|{_quoted(chr(34))}|{_quoted(chr(39))}"
    rf"|{_ASSIGNED}[\"']?){_LINK}[{_V}]{{8,}}?(?<![.?])(?=&[A-Za-z0-9_.\-]{{1,64}}=|[.?]*+(?![{_V}]))(?:={{1,2}}(?=[\s\"',;)\]}}<]|\z))?"
    rf"|(?<![{_T}])(?=[{_T}]*[0-9])[{_T}]{{16,}}+={{0,2}}"
)
# Common parts of identifiers, prose and placeholders.
DICTIONARY = "about account address after alpha and api app article auth background bank base beta build button cache card change changeme chapter client code com config content count data date default demo dev download draft edit email en example file final first for format from group guide hash header help here home host html http https id image index info invoice item key label language last left legal level library license line link list local login long main media member menu message model module my name network new news next node note number object of order org page part password path pdf photo placeholder plan png point post press price private product profile project public queue read record ref release report request result review root sample script search secret section server service session set settings shop short site source staging start state static status store style support system table tag target task temp template test text the time title to token topic total type update upload url user utm value version video view web wiki word work www xml year your".split()
# Words of passphrases, and words that stand where a value would.
NOUNS = "correct horse battery staple river window orange candle forest silver monkey dragon purple winter garden tiger bridge coffee planet rocket shadow mirror guitar pepper falcon meadow copper violet hammer island".split()
REMARKS = "required optional mandatory unavailable disabled undefined forbidden incorrect something everything authentication authorization description information administrator following available conditions sometimes Reference Introduction Summary! Attention! Important! protected encrypted confidential redacted".split()
# Frequent pairs of letters in words.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
# How some issuers' keys begin.
ISSUED = r"\A(AKIA|ASIA|gh[pousr]_|github_pat_|[sr]k_(live|test)_|xox[abprs]-|glpat-|AIza|eyJ|-----BEGIN|npm_|SG\.)"
SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|credential|bearer|passwort|kennwort|geheimnis|mot de passe|mdp|jeton|contrase(ñ|n)a|secreto|://[^\s/@:]{1,64})\W{0,6}\Z"
OTHER_WORDS = r"(?i)(sha\d*|md5|commit|checksum|hash|digest|uuid|guid|rev(ision)?|build|version|card|phone|tel|order|invoice|ref|number|id|etag|file|path|see|page|isbn|tracking)\W{0,6}\Z"
TRIAL_PATHS = r"(?i)(test|example|sample|mock|fixture|demo|doc)"

FEATURES = ["length", "transitions", "digits", "upper", "others", "distinct", "dictionary", "pairs", "hex", "numeric", "issued", "assigned", "quoted", "secret_word", "other_word", "trial_path"]


def _features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda x: x / n
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    gone = F.length(F.regexp_replace(value, "(?i)(" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))) + ")", ""))
    return [
        n,
        share(runs - 1),
        share(F.length(value) - F.length(F.translate(value, "0123456789", ""))),
        share(F.regexp_count(value, F.lit("[A-Z]"))),
        share(F.regexp_count(value, F.lit("[^A-Za-z0-9]"))),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        share(n - gone),
        share(F.regexp_count(F.lower(value), F.lit("(?=" + "|".join(PAIRS) + ")"))),
        yes(value.rlike(r"\A([0-9a-f]+|[0-9A-F]+)\z")),
        yes(value.rlike(r"\A[0-9][0-9 -]*\z")),
        yes(value.rlike(ISSUED)),
        yes(before.rlike(r"[=:]\s{0,3}[\"']?\Z")),
        yes(before.rlike(r"[\"']\Z") & after.rlike(r"\A[\"']")),
        yes(before.rlike(SECRET_WORDS)),
        yes(before.rlike(OTHER_WORDS)),
        yes(path.rlike(TRIAL_PATHS)),
    ]


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """before, value, after, path, label: findings that are secret or not by how they are made.

    A bounded number of rows, each drawn from its own hash: issued keys, random keys
    after secret words, and assigned passwords, against checksums, commit and record
    numbers, cards, identifiers, links, file names, placeholders, remarks and trial keys.
    """
    hexes = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512)
    dense = lambda salt: F.regexp_replace(F.base64(F.unhex(hexes(salt))), r"[\r\n]", "")
    pick = lambda salt, *of: F.element_at(F.array(*(F.lit(x) for x in of)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(of))) + 1).cast("int"))
    words = lambda salt: pick(salt, *DICTIONARY)
    digits = lambda salt: F.translate(hexes(salt), "abcdef", "135790")
    noise = lambda salt: F.substring(F.translate(hexes(salt), "0123456789abcdef", "etaoinshrdlucmfw"), 1, 9)
    quote = pick("q", '"', '"', "'", "")
    gap = pick("g", " = ", "=", ": ", ":", " := ")
    keyed = F.concat(noise("n"), F.lit(" "), pick("k", "token", "secret", "api_key", "apikey", "password", "auth_token", "access_key", "client_secret", "credentials", "Token", "API_KEY", "bearer"), gap, quote)
    other = F.concat(noise("n"), F.lit(" "), pick("o", "commit", "sha256", "sha1", "checksum", "md5", "uuid", "id", "order", "ref", "build", "revision", "digest", "card", "etag", "with", "that", "the", "de", "und"), pick("og", " ", ": ", " = ", "="), pick("oq", "", "", '"'))
    plain = F.concat(noise("p"), F.lit(" "), noise("r"), F.lit(" "))
    lead = F.substring(F.concat(noise("s"), noise("t"), noise("u")), 1, 3)
    issued = F.concat(pick("i", "ghp_", "sk_live_", "AKIA", "glpat-", "xoxb-", "npm_", "AIza"), F.translate(F.substring(dense("i"), 1, 32), "+/=", "aZ9"))
    token = F.concat(F.lit("eyJ"), F.translate(F.substring(dense("a"), 1, 30), "+/=", "xY_"), F.lit("."), F.translate(F.substring(dense("b"), 1, 60), "+/=", "xY_"), F.lit("."), F.translate(F.substring(dense("c"), 1, 43), "+/=", "xY_"))
    mark = lambda salt: pick(salt, "!", "@", "#", "$", "%", "^", "&", "*", "$!", "#@", ":", ",", "(?", ");")
    mixed = F.concat(F.translate(F.substring(dense("z"), 1, 5), "+/=", "!#x"), mark("m1"), F.translate(F.substring(dense("y"), 1, 3), "+/=", "@%x"), mark("m2"), F.substring(dense("b"), 1, 2), F.when(F.col("id") % 2 == 0, mark("m3")).otherwise(""), F.substr(F.translate(dense("x"), "+/=", "$*x"), F.lit(1), (F.lit(1) + F.col("id") % 14).cast("int")))
    dotted = F.substr(F.translate(dense("z"), "abcdefghijklABCDEFGH+/=", "!@#$%^&*(),;:?!@#$%&:;x"), F.lit(1), (F.lit(12) + F.col("id") % 14).cast("int"))
    strong = F.when(F.col("id") % 3 == 0, dotted).otherwise(mixed)
    uuid = F.concat_ws("-", *(F.substring(hexes("w"), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    kinds = [
        (1, keyed, F.substr(hexes("x"), F.lit(1), (F.lit(16) + F.col("id") % 33).cast("int"))),
        (1, keyed, F.when(F.col("id") % 2 == 0, F.substring(hexes("x"), 1, 32)).otherwise(F.substring(hexes("x"), 1, 64))),
        (1, keyed, F.substring(dense("y"), 1, 40)),
        (1, keyed, F.translate(F.substring(dense("y"), 1, 24), "+/=", "_-x")),
        (1, plain, issued),
        (1, keyed, F.when(F.col("id") % 3 == 0, token).otherwise(issued)),
        (1, keyed, F.concat(F.translate(F.substring(dense("z"), 1, 9), "+/=", "!#x"), F.substring(digits("z"), 1, 3))),
        (1, keyed, strong),
        (1, keyed, F.substr(F.translate(dense("l"), "0123456789+/=", "qWeRtYuIoPaSd"), F.lit(1), (F.lit(12) + F.col("id") % 21).cast("int"))),
        (1, keyed, F.concat(pick("n1", *NOUNS), pick("n2", *NOUNS), pick("n3", *NOUNS), F.when(F.col("id") % 2 == 0, pick("n4", *NOUNS)).otherwise(""))),
        (0, keyed, pick("rm", *REMARKS)),
        (0, F.concat(noise("c"), gap), F.when(F.col("id") % 2 == 0, pick("rm", *REMARKS)).otherwise(F.concat(noise("v"), F.substring(noise("m"), 1, 5)))),
        (0, keyed, F.concat(pick("get", "get", "load", "the", "current", "user"), F.initcap(words("w1")), F.initcap(words("w2")), F.initcap(words("w3")))),
        (0, keyed, F.concat(words("w1"), pick("sep", "_", ".", "-"), words("w2"), pick("sep", "_", ".", "-"), words("w3"))),
        (0, other, F.concat_ws(".", words("w1"), words("w2"), pick("ext", "pdf", "txt", "com", "org", "html"))),
        (0, other, F.when(F.col("id") % 3 == 0, F.substring(hexes("x"), 1, 40)).when(F.col("id") % 3 == 1, F.substring(hexes("x"), 1, 64)).otherwise(F.substring(hexes("x"), 1, 32))),
        (0, other, uuid),
        (0, plain, F.substring(digits("d"), 1, 16)),
        (0, other, F.when(F.col("id") % 2 == 0, F.substring(digits("d"), 1, 16)).otherwise(F.substring(digits("d"), 1, 19))),
        (0, keyed, F.substring(digits("d"), 1, 12)),
        (0, plain, F.concat_ws("/", words("w1"), words("w2"), words("w3"), F.substring(digits("d"), 1, 4))),
        (0, plain, F.concat_ws("-", words("w1"), words("w2"), words("w3"), words("w4"), F.substring(digits("d"), 1, 2))),
        (0, keyed, F.concat_ws("_", F.lit("your"), words("w1"), F.lit("token"), F.lit("here"), F.substring(digits("d"), 1, 2))),
        (0, keyed, F.concat(F.repeat(pick("rp", "x", "0", "1", "a"), 16), F.substring(digits("d"), 1, 2))),
        (0, keyed, F.concat(words("w1"), words("w2"), F.substring(digits("d"), 1, 3), F.lit("changeme"))),
    ]
    df = spark.range(0, rows, 1, 1)
    which = F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(len(kinds)))
    trial = F.pmod(F.xxhash64(F.lit("trial"), "id"), F.lit(12)) == 0
    ends = F.when(quote == "", F.concat(F.lit(" "), lead)).otherwise(F.concat(quote, lead))
    usual = pick("fp", "src1", "web/news", "app/config.py", "crawl")
    made = None
    # A projection for each kind: one for all of them is too much code to be compiled.
    for i, (label, before, value) in enumerate(kinds):
        path = usual if label else F.when(trial, pick("tp", "tests/fixtures/a.py", "docs/example.md", "sample.env")).otherwise(usual)
        part = df.where(which == i).select("id", before.alias("before"), value.alias("value"), ends.alias("after"), path.alias("path"), F.lit(float(label)).alias("label"))
        made = part if made is None else made.unionByName(part)
    return made.repartition(1).sortWithinPartitions("id").drop("id")


def _tree(node) -> str:
    """A fitted tree's share of secrets as SQL over c.f, the array of features."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return repr(round(stats[1] / (stats[0] + stats[1]), 6)) + "D"
    split = node.split()
    return f"IF(c.f[{split.featureIndex()}] <= {split.threshold()!r}D, {_tree(node.leftChild())}, {_tree(node.rightChild())})"


def train(findings: DataFrame, trees: int = 24, depth: int = 6, seed: int = 11) -> str:
    """The forest as an SQL expression for the probability that candidate c is a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    f = _features(F.col("value"), F.col("before"), F.col("after"), F.col("path"))
    rows = keep(findings.coalesce(1).select("label", *(c.alias(n) for n, c in zip(FEATURES, f))))  # read once a level of the trees
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(data)
    return "(" + " + ".join(_tree(t._call_java("rootNode")) for t in model.trees) + f") / {trees}D"


def _hits(text: Column, path: Column, forest: str) -> tuple[Column, Column]:
    """A row's candidates with what precedes each, and what follows the last one."""
    some = text.rlike(CANDIDATE)
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(text, CANDIDATE, -1)
    # One place more than there are candidates, which is dropped; c: the candidate before.
    zipped = F.arrays_zip(found.alias("v"), gaps.alias("b"), F.slice(gaps, 2, 1 << 30).alias("a"), F.concat(F.array(F.lit("")), found).alias("c"))
    zipped = F.filter(zipped, lambda z: z["v"].isNotNull())
    near = F.transform(zipped, lambda z: F.struct(z["v"].alias("v"), z["b"].alias("b"), F.substring(F.concat(F.substring(z["c"], -48, 48), F.substring(z["b"], -48, 48)), -48, 48).alias("near"), F.substring(z["a"], 1, 8).alias("a")))
    near = F.transform(near, lambda z: F.struct(z["v"].alias("v"), z["b"].alias("b"), F.array(*_features(z["v"], z["near"], z["a"], path)).alias("f")))
    return F.when(some, near), F.when(some, F.element_at(gaps, -1)).otherwise(text)


def scan(docs: DataFrame, forest: str, text: str = "text", path: str | None = "source", least: float = 0.5) -> DataFrame:
    """docs' own columns, and _hits array<struct<v, b, p, secret>> and _rest.

    v: a candidate; b: the text between it and the one before; p: the probability that
    it is a secret; secret: p is at least `least`.  _rest: the text after the last one.
    Null and empty texts have no candidates; a null path is an ordinary one; repeated
    rows are scanned one by one.
    """
    at = F.col(f"`{path}`").cast("string") if path and path in docs.columns else F.lit("")
    hits, rest = _hits(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(at, F.lit("")), forest)
    found = docs.withColumns({"_hits": hits, "_rest": rest})
    scored = f"transform(transform(_hits, c -> named_struct('v', c.v, 'b', c.b, 'p', {forest})), c -> named_struct('v', c.v, 'b', c.b, 'p', c.p, 'secret', c.p >= {least}D))"
    return found.withColumn("_hits", F.coalesce(F.expr(scored), F.expr("cast(array() as array<struct<v:string,b:string,p:double,secret:boolean>>)")))


def findings(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, value, probability, secret for each candidate; start counts characters from 0."""
    numbered = scanned.select(F.col(key), F.monotonically_increasing_id().alias("_row"), "_hits")
    rows = numbered.select(key, "_row", F.posexplode(F.transform("_hits", lambda z: F.struct(F.length(z["b"]).alias("gap"), z["v"].alias("v"), z["p"].alias("p"), z["secret"].alias("secret")))).alias("_pos", "c"))
    upto = F.sum(F.col("c.gap") + F.length("c.v")).over(W.partitionBy("_row").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0))
    return rows.select(key, (upto - F.length("c.v")).alias("start"), F.col("c.v").alias("value"), F.col("c.p").alias("probability"), "c.secret")


def redacted(mark: str = "[SECRET]") -> Column:
    """A scanned row's text with every secret replaced."""
    parts = F.transform("_hits", lambda z: F.concat(z["b"], F.when(z["secret"], F.lit(mark)).otherwise(z["v"])))
    return F.concat(F.array_join(parts, ""), F.col("_rest"))
