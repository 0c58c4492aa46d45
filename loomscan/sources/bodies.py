"""Bodies that are known already, each stored once under its digest, with an index by scan, slot and address.

Two tables of parts below a path.  `bodies` holds digest and text; a body goes in only if
its digest isn't there.  `index` holds scan, slot, url, digest and when; of an address the
latest entry counts.  Each put writes new files beside the old ones and ends with a note
that names them, so that a put that dies adds nothing; `compact` writes both tables anew
as one generation, of which the index keeps the latest entries and the bodies those that
it names, and readers change over with the note.

The slot says what a body is: the entry page (html) or a script (js); an answer from here
has that kind whatever its text looks like.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.functions import url
from loomscan.sources import files
from loomscan.sources.shared import keep

#: Slots, and the content type that makes an answer of that kind.
SLOTS = {"html": "text/html", "js": "text/javascript"}
_INDEX = "scan string, slot string, url string, digest string, at long"
_BODIES = "digest string, text string"


class Bodies:
    """The cache below a path; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _notes(self) -> list[str]:
        """The parts that count: of the latest generation, and those that came after it."""
        system, root = files.at(self.path)
        notes = [json.loads(files.read(system, i.path)) | {"name": i.base_name} for i in files.listed(system, f"{root}/notes") if i.base_name.endswith(".json")]
        notes.sort(key=lambda n: (n["at"], n["name"]))
        first = max((k for k, n in enumerate(notes) if n["whole"]), default=0)
        return [n["part"] for n in notes[first:]]

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/{name}" for part in self._notes()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _add(self, index: DataFrame, bodies: DataFrame, at: int, whole: bool) -> None:
        part = f"part-{uuid.uuid4().hex}"
        index.write.parquet(f"{self.path}/{part}/index")
        bodies.write.parquet(f"{self.path}/{part}/bodies")
        system, root = files.at(self.path)
        system.create_dir(f"{root}/notes", recursive=True)
        files.write_json(system, f"{root}/notes/{at:020d}-{part}.json", {"part": part, "at": at, "whole": whole})

    def index(self) -> DataFrame:
        """scan, slot, url, digest: the latest entry of each address."""
        newest = self._table("index", _INDEX).groupBy("scan", "slot", "url").agg(F.max_by("digest", F.struct("at", "digest")).alias("digest"))
        return newest

    def bodies(self) -> DataFrame:
        """digest and text, each digest once."""
        return self._table("bodies", _BODIES)

    def put(self, rows: DataFrame) -> None:
        """Stores scan, slot, url and text; null texts are left out, other columns aren't read.

        Addresses are kept by their key.  Of rows of one scan, slot and key with different
        texts the one with the greatest digest counts.
        """
        at = time.time_ns()
        given = rows.where(F.col("text").isNotNull() & F.col("slot").isin(*SLOTS)).select("scan", "slot", url.normalize(F.col("url")).alias("url"), F.sha2("text", 256).alias("digest"), "text")
        entries = keep(given.groupBy("scan", "slot", "url").agg(F.max("digest").alias("digest")))
        fresh = entries.join(self.index(), ["scan", "slot", "url", "digest"], "left_anti").withColumn("at", F.lit(at))
        missing = fresh.select("digest").distinct().join(self.bodies().select("digest"), "digest", "left_anti")
        texts = given.select("digest", "text").join(missing, "digest").groupBy("digest").agg(F.first("text").alias("text"))
        self._add(fresh, texts, at, whole=False)

    def compact(self) -> None:
        """One generation of the entries that count and the bodies that they name; older parts go."""
        system, root = files.at(self.path)
        old = self._notes()
        index = keep(self.index().withColumn("at", F.lit(0).cast("long")))
        named = self.bodies().join(index.select("digest").distinct(), "digest", "left_semi")
        self._add(index, named, time.time_ns(), whole=True)
        kept = set(self._notes())
        for i in files.listed(system, f"{root}/notes"):
            if not any(part in i.base_name for part in kept):
                system.delete_file(i.path)
        for part in old:
            files.remove(system, f"{root}/{part}")

    def answers(self) -> DataFrame:
        """scan, url, slot, status, content_type and text of every stored address."""
        kind = F.create_map(*(F.lit(x) for pair in SLOTS.items() for x in pair))
        return self.index().join(self.bodies(), "digest").select("scan", "url", "slot", F.lit(200).alias("status"), kind[F.col("slot")].alias("content_type"), "text")


def before(answers: DataFrame, starts: DataFrame, responses: DataFrame) -> DataFrame:
    """responses, and before them what is stored: rows that `discover` takes, for scans of its own.

    answers: as `Bodies.answers`; starts: scan, start.  A start is answered by its page
    in the slot html, any other address by one in the slot js.  Stored answers are
    their scan's alone; addresses that no scan has stored are answered for all.  Rows have
    a column scan, null where an answer is for all scans.
    """
    entries = starts.select("scan", url.normalize(F.col("start")).alias("url")).distinct().withColumn("slot", F.lit("html"))
    pages = answers.join(entries, ["scan", "url", "slot"], "left_semi")
    scripts = answers.where("slot = 'js'").join(entries.select("scan", "url"), ["scan", "url"], "left_anti")
    stored = pages.unionByName(scripts).select("scan", "url", "status", "content_type", "text")
    return stored.unionByName(responses.withColumn("scan", F.lit(None).cast(starts.schema["scan"].dataType)), allowMissingColumns=True)


def with_stored(answers: DataFrame, responses: DataFrame) -> DataFrame:
    """responses, and what is stored of addresses that they don't answer."""
    lacking = answers.groupBy("url").agg(F.min_by(F.struct("status", "content_type", "text"), F.struct("scan", "slot")).alias("x"))
    lacking = lacking.join(responses.select(url.normalize(F.col("url")).alias("url")), "url", "left_anti").select("url", "x.*")
    return responses.unionByName(lacking, allowMissingColumns=True)
