"""Personal data, source divergence and periodic runs against brute-force versions, and on messy and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomscan.llm import divergence, pii, queries, runs

from .helpers import CLASHES, LOW, MESSY, documents, prose


# Periodic runs


def plain_runs(x, least, times):
    found = {}
    for p in range(1, len(x) // times + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, rounds):
    r = random.Random(seed)
    for _ in range(rounds):
        x = [r.randrange(r.choice([1, 2, 2, 3, 5, 50])) for _ in range(r.randrange(70))]
        for _ in range(r.randrange(4)):
            if x:
                a = r.randrange(len(x))
                again = x[a : a + r.randrange(1, 12)] * r.randrange(2, 9)
                x[a : a + r.randrange(3)] = again[: len(again) - r.randrange(3)]
        if x and r.random() < 0.3:
            x += x[r.randrange(len(x)) :] * r.randrange(1, 5)
        yield x


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (4, 3)])
def test_runs_are_those_of_brute_force(least, times):
    for x in sequences(times, 1500):
        expected = plain_runs(x, least, times)
        assert sorted((s, e - s, p) for s, e, p in runs.runs(x, least, times)) == sorted(expected), x
        assert runs.text_runs(np.array(x, np.int32), least, times) == expected, x


def test_factors_are_the_longest_that_began_before():
    for x in sequences(7, 300):
        at = 0
        for begin, end, earlier in runs.factors(x):
            assert begin == at
            longest = max((next((k for k in range(len(x) - begin) if x[j + k] != x[begin + k]), len(x) - begin) for j in range(begin)), default=0)
            assert end - begin == max(longest, 1)
            assert earlier < begin and (not longest or x[earlier : earlier + longest] == x[begin:end])
            at = end
        assert at == len(x)


def plain_row(doc_id, text):
    w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, 6, 4)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), best[0], best[1], best[2], 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def saved(spark, rows, tmp_path):
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_runs_of_documents(spark, tmp_path):
    rows = [*MESSY, *((i, prose(i, 5 + 7 * (i % 40), 30)) for i in range(100, 300)), (400, "la la la la la la"), (401, "a b a b a b a\tb\n a"), (402, "x " * 3000 + "y"), (403, (prose(3, 40) + " ") * 9)]
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, saved(spark, rows, tmp_path)).collect()]
    assert Counter(got) == Counter(plain_row(*r) for r in rows)


def test_runs_of_a_very_long_text(spark):
    period = prose(8, 9000, 10**6)
    text = " ".join([prose(9, 300_000, 50_000), *[period] * 5, prose(10, 200_000, 50_000)])
    [row] = runs.periodic_runs(documents(spark, [(1, text)])).collect()
    assert [tuple(r) for r in row.runs] == [(300_000, 45_000, 9000)] and row.collapsed == " ".join([prose(9, 300_000, 50_000), period, prose(10, 200_000, 50_000)])


def test_runs_of_an_empty_table(spark):
    assert runs.periodic_runs(documents(spark, [(1, "x")]).limit(0)).collect() == []


# Source divergence


def plain_audit(rows, least=10, ranks=10):
    within, terms, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        within[lang].update(set(found))
        terms[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in within[lang].items() if n >= least}
        every = Counter()
        for s in sources:
            every.update({t: n for t, n in terms[lang, s].items() if t in kept})
        total = lambda c: sum(c[t] for t in kept)
        share = lambda c, t, n: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept))
        p = {s: {t: share(terms[lang, s], t, total(terms[lang, s])) for t in kept} for s in sources}
        q = {t: share(every, t, total(every)) for t in kept}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            found = [("pair", o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [("term", t, apart(p[s][t], q[t])) for t in kept if terms[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, most in ((found, None), (own, ranks)):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, i + 1) for i, r in enumerate(part[:most])]
    return out


def audited(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: divergence.F.lit("x") for c in CLASHES})
    return df


def sources_of(seed, n):
    r = random.Random(seed)
    out = [(None, None, None), ("xx", "a", "only few terms"), ("xx", "b", None), ("de", "", "Ärger über 🙂 Ä"), ("en", None, "A-b_c1d")]
    for i in range(n):
        lang, source = r.choice(["en", "en", "de"]), r.choice(["hot"] * 3 + ["s1", "s2", "S2", "ß"])
        out.append((lang, source, prose(r.randrange(n), r.randrange(40), 26).translate(str.maketrans("0123456789", "abcdefGHIé")) + " 🙂 und"))
    return out


@pytest.mark.parametrize("chunk", [3, 1024])
def test_divergence_is_that_of_brute_force(spark, chunk):
    rows = sources_of(1, 400)
    got = divergence.audit_sources(audited(spark, rows).repartition(5), chunk=chunk).collect()
    assert Counter(map(tuple, got)) == Counter(plain_audit(rows))


def test_divergence_hands_counts_on_early(spark, monkeypatch):
    rows = sources_of(2, 150)
    expected = plain_audit(rows, least=3, ranks=2)
    got = divergence.audit_sources(audited(spark, rows).coalesce(1), least=3, ranks=2).collect()
    assert Counter(map(tuple, got)) == Counter(expected)


def test_shares_of_large_counts_are_exact():
    counts = np.array([0, 1, 7 * 10**14, 4 * 10**15], np.int64)
    total, terms = 5 * 10**15 + 3, 10**9
    p = divergence.share(counts, total, terms)
    assert p.tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]
    q = p[::-1].copy()
    assert divergence.divergence(p, q).tolist() == [(int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p, q)]


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit_sources(audited(spark, sources_of(3, 1)).limit(0)).collect() == []


# Personal data


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def plain_base(text):
    digits = lambda v: re.sub(r"[^0-9]", "", v)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m.group())]


ODD = [
    "a@b.cc_x@d.ee, a@b.cc@d.ee; .a.@-.-.- b@c d@e.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.000255 1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 11111111", "+49 (30) 1234-567 +1 2 +12345678 ++1 234 567 89 01 +1234567890123456", "🙂 x@y.zz 🙂 +1 (243) 555-5526.",
    "+1 (243) 555-5526 4111111111111111", "10.0.0.1@x.yy", "4111111111111111.1.2.3", "a" * 3000 + "@" + "b." * 500 + "c", "1 " * 3000, "+" * 200 + "1" + " " * 500, "1.1." * 800, "x@y.zz " * 400,
]


def test_base_spans_are_those_of_brute_force(spark):
    r = random.Random(5)
    mixed = ["".join(r.choice("aZ0123456789@.+-() _%🙂 ") for _ in range(r.randrange(120))) for _ in range(400)]
    rows = [*MESSY, *enumerate([*ODD, *mixed], 100)]
    got = pii.find_pii(documents(spark, rows), [0.0] * len(pii.FEATURES) + [-1.0]).select("doc_id", "_base", "_spans", *CLASHES[:3]).collect()
    assert Counter((g.doc_id, tuple(map(tuple, g._base))) for g in got) == Counter((i, tuple(plain_base(t))) for i, t in rows)
    assert all(g._base == g._spans for g in got)


SPELLED = {
    "en": ("you can write to {} at any time", "her telephone: {} until noon", "Call {} now", "credit card: {} expires soon"),
    "de": ("Kontakt: {} oder später", "Telefon: {} ab neun", "Handy {} bitte", "Kreditkarte: {} gilt noch"),
    "fr": ("courriel : {} pour tout", "téléphone : {} le matin", "appeler le {} demain", "carte : {} valable"),
    "es": ("correo: {} siempre", "teléfono: {} por la tarde", "llamar al {} hoy", "tarjeta: {} vence"),
}
DECOYS = ["order 4539578763621487 shipped", "invoice 2024-01-15 2024-02-15 paid", "ISBN 978-3-16-148410-0 in print", "between 1914-1918 and 1939-1945", "about 30000000 euros in all", "version 12.34.56789012 is out", "look at the dot on it", "pages 1000-1020 of it", "Bestellnummer 123456789 liegt vor", "commit 1234567890123 is broken", "12.10.2023 and 13.10.2023", "a total of 1 000 000 000 dollars"]


def written(seed, lang):
    """Texts of one language with data that no base pattern takes, and where it is."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("123456789") for _ in range(k))
    mail = r.choice(["anna.{}(at)mail{}.com", "anna{}[at]web{}[dot]de", "anna{} at web{} dot org"]).format(n(2), n(1))
    phone = r.choice([f"0{n(2)} {n(3)} {n(4)}", f"0{n(3)}/{n(3)}-{n(3)}", f"(0{n(2)}) {n(4)} {n(3)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}"])
    values = [mail, phone, f"0{n(2)} {n(3)} {n(5)}"]
    return [(prose(seed, 8) + " " + s, v, k) for s, v, k in zip(SPELLED[lang], values, ("email", "phone", "phone"))]


def test_voters_find_what_is_spelled_otherwise(spark):
    rows, planted = [], {}
    for j, lang in enumerate(SPELLED):
        for i in range(60):
            for form, value, kind in written(1000 * j + i, lang):
                doc = len(rows)
                text = form.format(value)
                rows.append((doc, text))
                planted[doc] = (lang, kind, text.index(value), text.index(value) + len(value))
    clean = set()
    for i in range(600):
        clean.add(len(rows))
        rows.append((len(rows), prose(i, 10) + " " + DECOYS[i % len(DECOYS)] + " " + prose(i + 1, 5)))
    for i in range(200):
        rows.append((len(rows), f"{prose(i, 5)} u{i}@mail.example.com and +1 (243) 555-{1000 + i} or 4111111111111111, 81.2.69.{i}"))
    docs = documents(spark, rows)
    model = pii.train(docs)
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r._spans] for r in pii.find_pii(docs, model).select("doc_id", "_spans").collect()}
    for lang in SPELLED:
        mine = [(d, p) for d, p in planted.items() if p[0] == lang]
        assert sum(p[1:] in got[d] for d, p in mine) >= 0.95 * len(mine), lang
    assert sum(bool(got[d]) for d in clean) <= 0.02 * len(clean)
    # Spans of the classifier lie where no base span is.
    base = {r.doc_id: [tuple(s) for s in r._base] for r in pii.find_pii(docs, model).select("doc_id", "_base").collect()}
    for d, spans in got.items():
        own = [(pii.KINDS.index(k), a, b) for k, a, b in spans]
        assert all(b in own for b in base[d])
        assert all(e <= c or f <= b for k, b, e in set(own) - set(base[d]) for _, c, f in base[d])


def test_reliabilities_come_from_agreement():
    r = random.Random(3)
    votes = Counter()
    right = (0.95, 0.9, 0.6, 0.8, 0.7, 0.85)
    for _ in range(20000):
        truth = r.random() < 0.3
        votes[tuple(0 if r.random() < 0.3 else (1 if truth else -1) * (1 if r.random() < p else -1) for p in right)] += 1
    prior, weight = pii.reliabilities([(0, v, n) for v, n in votes.items()])
    assert abs(1 / (1 + np.exp(-prior[0])) - 0.3) < 0.05
    order = sorted(range(6), key=lambda i: weight[i][1] - weight[i][-1])
    assert order[0] == 2 and order[-1] == 0


def test_pii_of_texts_without_any_and_of_an_empty_table(spark):
    for docs in (documents(spark, MESSY), documents(spark, MESSY).limit(0)):
        model = pii.train(docs)
        assert all(not r._spans for r in pii.find_pii(docs, model).select("_spans").collect())


def test_pii_has_no_python_in_its_plan(spark):
    docs = documents(spark, [(1, "a@b.cc")])
    for df in (pii.patterns(docs), pii.find_pii(docs, [0.1] * len(pii.FEATURES) + [0.0])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pii_of_a_very_long_text(spark):
    text = "x@y.zz 1234567 " * 60_000
    [row] = pii.find_pii(documents(spark, [(1, text)]), [0.0] * len(pii.FEATURES) + [-1.0]).select("_base").collect()
    assert len(row._base) == 60_000 and row._base[-1].end == len(text) - 9
