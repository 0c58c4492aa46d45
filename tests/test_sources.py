"""Recordings, trees of results, bodies by digest."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from loomscan.sources import bodies, captures, files, tree


def exchanges(spark, n=400):
    rows = [(f"https://s{i % 7}.test/{'é' if i % 3 else 'x'}/{i}", "HEAD" if i % 10 == 0 else "GET", 200 if i % 4 else 404, f"line {i}\n\"quoted\" 🙂" * (i % 5), {"Etag": str(i)} if i % 2 else None) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "GET", None, None, None)], "url string, method string, status int, text string, headers map<string,string>")


def test_recording_comes_back(spark, tmp_path):
    df = exchanges(spark)
    captures.record(df, str(tmp_path / "r"), block=2000)
    captures.record(df.limit(0), str(tmp_path / "r"))
    back = captures.recorded(spark, str(tmp_path / "r"), df.columns)
    key = lambda r: (r.url or "", r.method, r.status or 0, r.text or "", tuple((r.headers or {}).items()))
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    assert back.rdd.getNumPartitions() > 5


def test_filters_on_url_skip_partitions(spark, tmp_path):
    path = str(tmp_path / "r")
    captures.record(exchanges(spark), path, block=1500)
    every = captures.recorded(spark, path, ["url", "method"])
    whole = every.rdd.getNumPartitions()
    some = every.where("url like 'https://s3.test/%'")
    assert some.count() == sum(1 for i in range(400) if i % 7 == 3)
    assert every.where("url like 'https://s3.test/%'").rdd.getNumPartitions() < whole / 2
    assert every.where("url = 'https://s3.test/x/3'").rdd.getNumPartitions() <= 2
    assert every.where("url in ('https://s3.test/x/3', 'nowhere')").count() == 1
    assert every.where("method = 'PUT'").rdd.getNumPartitions() == 1 and every.where("method = 'PUT'").count() == 0 and every.where("method = 'HEAD'").count() == 40
    assert every.where("url > 'https://s5' and url < 'https://s6'").count() == sum(1 for i in range(400) if i % 7 == 5)
    assert every.where("url is null").count() == 1


def test_recordings_from_elsewhere_are_read_by_ranges(spark, tmp_path):
    os.makedirs(tmp_path / "r")
    lines = [json.dumps({"url": f"https://a.test/{i}", "body": "aMO8", "status": 200}) for i in range(300)]
    (tmp_path / "r" / "given.jsonl").write_text("\n".join(lines[:200]) + "\n\n" + "\n".join(lines[200:]))
    for block in (1, 7, 64, 1000, 10**6):
        captures.register(spark)
        rows = spark.read.format("exchanges").schema("url string, text string, method string").option("block", block if block > 1 else 50).load(str(tmp_path / "r")).collect()
        assert sorted(r.url for r in rows) == sorted(f"https://a.test/{i}" for i in range(300)) and {(r.text, r.method) for r in rows} == {("hü", "GET")}


def test_a_failed_recording_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    captures.record(exchanges(spark, 50), path)
    before = sorted(os.listdir(path))
    bad = exchanges(spark, 50).withColumn("status", F.when(F.col("url").contains("/17"), F.raise_error(F.lit("no"))).otherwise(F.col("status")).cast("int"))
    with pytest.raises(Exception, match="no"):
        captures.record(bad, path)
    assert sorted(os.listdir(path)) == before
    captures.record(exchanges(spark, 3), path, mode="overwrite")
    assert captures.recorded(spark, path, ["url"]).count() == 4


def tree_rows(spark, n, mark):
    rows = [(f"s{i % 3}", tree.SLOTS[i % 4], f"d{i % 5}/f {i}.txt", f"{mark}{i}") for i in range(n)]
    return spark.createDataFrame(rows, "scope string, slot string, path string, content string")


def files_in(path):
    return {os.path.relpath(f, path): open(f).read() for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f)}


def test_tree_is_replaced_by_scope(spark, tmp_path):
    path = str(tmp_path / "t")
    tree.save(tree_rows(spark, 60, "a").repartition(5), path)
    assert files_in(path) == {f"s{i % 3}/{tree.SLOTS[i % 4]}/d{i % 5}/f {i}.txt": f"a{i}" for i in range(60)}
    tree.save(tree_rows(spark, 12, "b").where("scope = 's1'"), path)
    now = files_in(path)
    assert {k: v for k, v in now.items() if k.startswith("s1/")} == {f"s1/{tree.SLOTS[i % 4]}/d{i % 5}/f {i}.txt": f"b{i}" for i in range(1, 12, 3)}
    assert sum(k.startswith("s2/") for k in now) == 20
    back = {(r.scope, r.slot, r.path): bytes(r.content).decode() for r in tree.stored(spark, path).collect()}
    assert back == {tuple(k.split("/", 2)): v for k, v in now.items()}
    assert tree.stored(spark, str(tmp_path / "nowhere")).count() == 0


def test_a_killed_task_leaves_the_old_tree(spark, tmp_path):
    path = str(tmp_path / "t")
    tree.save(tree_rows(spark, 60, "a"), path)
    before = files_in(path)

    def dies(batches):
        for i, b in enumerate(batches):
            yield b
            if b.column("scope").to_pylist().count("s2"):
                os._exit(9)

    rows = tree_rows(spark, 60, "b").repartition(4).mapInArrow(dies, "scope string, slot string, path string, content string")
    with pytest.raises(Exception):
        tree.save(rows, path)
    assert files_in(path) == before and sorted(os.listdir(path)) == ["s0", "s1", "s2"]
    for scope, slot, name in (("..", "js", "a"), ("s", "js", "../a"), ("s", "other", "a"), ("s", "js", "/a"), ("s", "js", "")):
        with pytest.raises(Exception, match="no place in the tree"):
            tree.save(spark.createDataFrame([(scope, slot, name, "x")], "scope string, slot string, path string, content string"), path)
    assert files_in(path) == before and sorted(os.listdir(path)) == ["s0", "s1", "s2"]


def test_a_driver_that_died_while_publishing_is_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    tree.save(tree_rows(spark, 12, "a"), path)
    writer = tree.TreeWriter(path)
    [batch] = tree_rows(spark, 12, "b").select("scope", "slot", "path", F.col("content").cast("binary").alias("content")).toArrow().combine_chunks().to_batches()
    message = writer.write(iter([batch]))
    system, root = files.at(path)
    files.write_json(system, f"{root}/{writer.job}/ready.json", message.scopes)
    system.create_dir(f"{root}/{writer.job}/old")
    system.move(f"{root}/s0", f"{root}/{writer.job}/old/s0")  # and here it died
    assert {bytes(r.content)[:1] for r in tree.stored(spark, path).collect()} == {b"b"}
    assert sorted(os.listdir(path)) == ["s0", "s1", "s2"]
    other = tree.TreeWriter(path)
    other.write(iter([batch]))
    other.abort([])
    assert sorted(os.listdir(path)) == ["s0", "s1", "s2"]


def stored_rows(spark, rows):
    return spark.createDataFrame(rows, "scan string, slot string, url string, text string")


def test_equal_bodies_are_stored_once(spark, tmp_path):
    cache = bodies.Bodies(spark, str(tmp_path / "c"))
    assert cache.answers().count() == 0
    cache.put(stored_rows(spark, [(f"s{i % 3}", "js", f"https://a.test/{i}#x", "same") for i in range(30)] + [("s0", "html", "https://a.test", "page"), ("s0", "js", "https://a.test/n", None), ("s0", "css", "https://a.test/c", "x")]))
    assert cache.bodies().count() == 2 and cache.index().count() == 31
    cache.put(stored_rows(spark, [("s0", "js", "https://a.test/0", "new"), ("s1", "js", "https://a.test/1", "same"), ("s9", "js", "https://a.test/9", "page")]))
    assert cache.bodies().count() == 3 and cache.index().count() == 32
    before = {(r.scan, r.slot, r.url): (r.text, r.content_type) for r in cache.answers().collect()}
    assert before["s0", "js", "https://a.test/0"] == ("new", "text/javascript") and before["s0", "html", "https://a.test"] == ("page", "text/html") and before["s9", "js", "https://a.test/9"][0] == "page"
    cache.put(stored_rows(spark, [("s9", "js", "https://a.test/9", "last")]))
    cache.put(stored_rows(spark, []))
    before["s9", "js", "https://a.test/9"] = ("last", "text/javascript")
    cache.compact()
    assert {(r.scan, r.slot, r.url): (r.text, r.content_type) for r in cache.answers().collect()} == before
    assert cache.bodies().count() == 4 and len(os.listdir(tmp_path / "c")) == 2  # the notes and one part
    # A put that died has written a part that no note names.
    os.makedirs(tmp_path / "c" / "part-dead" / "index")
    assert cache.index().count() == 32
