"""Cookies against a jar that goes through sets and requests in the order of time."""

import random

from loomscan.operators import cookies


class Jar:
    def __init__(self):
        self.held = {}

    def set(self, at, host, name, value, domain, path, age):
        expires = None if age is None else 0 if age <= 0 else at + 1000 * age
        if expires is None or expires > at:
            key = (name, domain or host, path or "/", host)
            self.held.pop(key, None)
            self.held[key] = (value, expires)

    def header(self, at, host, path):
        fit = []
        for (name, domain, p, _), (value, expires) in self.held.items():
            if (expires is None or expires > at) and (host == domain or host.endswith("." + domain)) and (p == "/" or p == path or path.startswith(p) and (p.endswith("/") or path[len(p)] == "/")):
                fit.append((-len(p), f"{name}={value}"))
        return "; ".join(t for _, t in sorted(fit, key=lambda x: x[0]))


def test_headers_are_those_of_a_jar(spark):
    r = random.Random(4)
    jar, sets, asks, expected = Jar(), [], [], {}
    for at in range(1500):
        host = r.choice(["a.test", "b.a.test", "c.b.a.test", "hot.test", "hot.test", "hot.test"])
        if r.random() < 0.4:
            domain, path, age = r.choice([None, None, "a.test", ".a.test", "hot.test"]), r.choice([None, "/", "/x", "/x/", "/x/y"]), r.choice([None, None, None, 0, -1, 1, 5])
            name, more = f"n{r.randrange(3)}", ["HttpOnly", "Max-Age=no"]
            if domain:
                more.append(f" DOMAIN = {domain} ")
            if path:
                more.append(f"path={path}")
            if age is not None:
                more += [f"Max-Age={age}", "Expires=Wed, 21 Oct 2099 07:28:00 GMT"]
            r.shuffle(more)
            sets.append((f"https://{host}/s", at * 700, ["; ".join([f" {name} = v{at}=", *more]), "noname", "=x"]))
            jar.set(at * 700, host, name, f"v{at}=", domain and domain.lstrip("."), path, age)
        else:
            path = r.choice(["", "/", "/x", "/x/", "/xy", "/x/y", "/x/y/z", "/q"])
            asks.append((at, f"https://{host}:8443{path}?q", at * 700))
            expected[at] = jar.header(at * 700, host, path or "/")
    requests = spark.createDataFrame([*asks, (-1, "nowhere", 5), (-2, "https://hot.test/", None), (-3, None, 5)], "id int, url string, at long")
    responses = spark.createDataFrame([*sets, ("nowhere", 1, ["a=b"]), (None, 1, ["a=b"]), ("https://hot.test/", None, ["a=b"]), ("https://hot.test/", 3, None)], "url string, at long, set_cookie array<string>")
    got = {x.id: x.cookie for x in cookies.headers(requests.repartition(3), responses.repartition(3)).collect()}
    assert got == expected | {-1: "", -2: "", -3: ""}


def test_dates_and_empty_tables(spark):
    rows = spark.createDataFrame([("https://a.test/", 0, ["a=1; Expires=Thu, 01-Jan-1970 00:00:05 GMT", "b=2; expires=never", "c=3; Expires=Wed, 21 Oct 2099 07:28:00 GMT", "d=4; Expires=Thu, 01 Jan 1970 00:00:00 GMT"])], "url string, at long, set_cookie array<string>")
    assert {x.name: x.expires for x in cookies.parsed(rows).collect()} == {"a": 5000, "b": None, "c": 4096250880000}
    asks = spark.createDataFrame([(1, "https://a.test/", 4000), (2, "https://a.test/", 6000)], "id int, url string, at long")
    assert {x.id: x.cookie for x in cookies.headers(asks, rows).collect()} == {1: "a=1; b=2; c=3", 2: "b=2; c=3"}
    assert {x.cookie for x in cookies.headers(asks, rows.limit(0)).collect()} == {""} and cookies.headers(asks.limit(0), rows).count() == 0


def test_addresses_are_parsed_after_requests_are_dealt_out(spark):
    asks = spark.createDataFrame([(1, "https://a.test/", 4000)], "id int, url string, at long")
    sets = spark.createDataFrame([("https://a.test/", 0, ["a=1"])], "url string, at long, set_cookie array<string>")
    above, _, below = cookies.headers(asks, sets)._jdf.queryExecution().optimizedPlan().toString().partition("RepartitionByExpression [id")
    assert "RLIKE" in above and "RLIKE" not in below.split("LogicalRDD")[0] and below


def _sent(spark):
    """Rows that all exchanges so far have sent."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_requests_are_not_sent_once_for_each_cookie(spark):
    asks = spark.range(1000).selectExpr("id", "'https://b.a.test/x/y' as url", "id + 100 as at")
    sets = spark.range(60).selectExpr("'https://b.a.test/' as url", "id as at", "array(concat('n', id, '=v', if(id % 2 = 0, '; Domain=a.test', ''))) as set_cookie")
    before = _sent(spark)
    got = cookies.headers(asks, sets).collect()
    assert len(got) == 1000 and {r.cookie for r in got} == {"; ".join(f"n{i}=v" for i in range(60))}
    assert _sent(spark) - before < 4 * 1060


def test_the_jar_at_work_forgets_no_change():
    # Long enough for logs to be cut, replaced expiries to be thrown away, and merged cookies, too.
    r, model, jar, held = random.Random(5), Jar(), cookies._Jar(), cookies.HELD
    cookies.HELD = 200
    try:
        for at in range(12000):
            host = r.choice(["a.test", "b.a.test", "c.a.test"]) if at < 9000 else "a.test"
            if r.random() < 0.9:
                domain, path, age = r.choice([host, "a.test"]), r.choice(["/", "/x"]), r.choice([None, 1, 3, 9000])
                name = f"n{r.randrange(20)}"
                model.set(at * 700, host, name, str(at), domain, path, age)
                jar.set(domain, path, host, f"{name}={at}", age and at * 700 + 1000 * age)
            else:
                path = r.choice(["/", "/x/y", "/xy"])
                assert jar.header(host, path, at * 700) == model.header(at * 700, host, path)
    finally:
        cookies.HELD = held


def test_groups_of_hosts_and_stretches(spark, monkeypatch):
    r = random.Random(6)
    jar, sets, asks, expected = Jar(), [], [], {}
    hosts = ["s1.test", "a.s1.test", "b.s1.test", "s2.test", "a.s2.test", "s3.test", "hot.test", "hot.test", "a.hot.test", "alone"]
    for at in range(1200):
        host = r.choice(hosts)
        if r.random() < 0.5:
            domain, path, age = r.choice([None, None, "test", ".".join(host.split(".")[-2:])]), r.choice([None, "/p1", "/p2/", "/p2/q", "//"]), r.choice([None, None, 1, 200])
            name = f"n{r.randrange(12 if host == 'hot.test' else 2)}"
            sets.append((f"https://{host}/s", at * 700, [f"{name}=v{at}" + (f"; Domain={domain}" if domain else "") + (f"; Path={path}" if path else "") + (f"; Max-Age={age}" if age else "")]))
            jar.set(at * 700, host, name, f"v{at}", domain, path, age)
        else:
            path = r.choice(["/", "/p1", "/p2/q/r", "//p1", "/p3"])
            asks.append((at, f"https://{host}{path}", at * 700))
            expected[at] = jar.header(at * 700, host, path)
    requests = spark.createDataFrame([*asks, (-1, "nowhere", 5), (-2, "https://hot.test/", None)], "id int, url string, at long")
    responses = spark.createDataFrame(sets, "url string, at long, set_cookie array<string>")
    monkeypatch.setattr(cookies, "ROWS", 50)
    for most in (10, 10_000):  # many groups, of which sites and hosts are cut up, and one
        monkeypatch.setattr(cookies, "MOST", most)
        got = {x.id: x.cookie for x in cookies.headers(requests, responses).collect()}
        assert got == expected | {-1: "", -2: ""}


def test_sets_of_one_time(spark):
    # By place in their response, domain and host; of one cookie's the greatest value holds.
    sets = spark.createDataFrame([("https://b.a.test/", 1, ["x=1; Domain=a.test", "y=1"]), ("https://a.test/", 1, ["x=2", "w=0"]), ("https://b.a.test/", 1, ["x=3; Domain=a.test", "y=0"])], "url string, at long, set_cookie array<string>")
    asks = spark.createDataFrame([(i, "https://b.a.test/", i) for i in range(4)], "id int, url string, at long")
    assert {x.id: x.cookie for x in cookies.headers(asks, sets).collect()} == {0: "", 1: "", 2: "x=2; x=3; w=0; y=1", 3: "x=2; x=3; w=0; y=1"}


def test_addresses_are_parsed_after_requests_are_dealt_out_by_groups(spark, monkeypatch):
    monkeypatch.setattr(cookies, "MOST", 1)
    asks = spark.createDataFrame([(1, "https://a.test/", 4000), (2, "https://b.test/", 4000)], "id int, url string, at long")
    sets = spark.createDataFrame([("https://a.test/", 0, ["a=1", "b=1"]), ("https://b.test/", 0, ["a=2"])], "url string, at long, set_cookie array<string>")
    out = cookies.headers(asks, sets)
    _, *below = out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression [id")
    assert below and not any("RLIKE" in b.split("LogicalRDD")[0] for b in below)
    assert {x.id: x.cookie for x in out.collect()} == {1: "a=1; b=1", 2: "a=2"}
