import random
import re

from pyspark.sql import functions as F

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ["n", "cls", "rep", "h", "unit", "bucket", "items", "spans", "toxicity", "_hits", "_rest", "doc", "n_words", "size", "shard", "slot", "component", "id", "row", "length"]


def words(text, kind=ALNUM):
    return kind.findall((text or "").translate(LOW))


def documents(spark, texts, first=0):
    """Rows of (id, text) or texts, with the columns of documents and further ones of clashing names."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("src1"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("x") for c in CLASHES})


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


MESSY = [(None, "no id here at all, six words"), (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "ONE two"), (6, "Größe café 北京 🙂 naïve\x00x"), (7, "a" * 20000), (8, "seven more words stand in this row"), (8, "seven more words stand in this row")]
