import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tessera.llm import pii
from tessera.llm.common import documents
from tests.llm.conftest import SF

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d)
                    or kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, k, e, kind in sorted(out)), [sum(x[1] == k for x in out) for k in range(4)]


def check(df, text_of):
    rows = df.collect()
    for r in rows:
        want, n = brute(text_of[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r.doc_id, want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    return rows


def test_base_spans_match_brute_force_on_documents(spark):
    table = documents(spark, SF)
    check(pii.op3_pii(spark, SF), {r.doc_id: r.text for r in table.collect()})


def test_base_spans_on_hard_texts(docs):
    texts = [
        "a@b.c_d@e.f", "x@y.z@q.r", "é😀 mail a.b@c-d.e-f.gh, 😀ip 1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.256 0001.002.3.04 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (555) 555-2485) +1 2 +49 30 1234567890123456", "4111111111111111" * 2, "....@a.b", "a@b", "@b.c", "1" * 3000 + ".1.1.1", "a" * 3000 + "@" + "b." * 900 + "c", " ".join(["1.1.1.1"] * 700), "+" * 500 + "1" + " 2" * 12,
        "", None, "a@b.cc@d.ee", "+1+1 555 555 2485", "١٢٣.1.1.1 １.1.1.1.1", "5 5 4111 1111 1111\n1111", "378282246310005 30569309025904 6011-0000-0000 0004"]
    rows = list(enumerate(texts))
    check(pii.pii(docs(rows)), dict(rows))


def test_edges(awkward, nothing):
    assert pii.pii(awkward).count() == 11
    assert pii.pii(nothing).count() == 0
    out = pii.redacted(awkward)
    assert out.columns == awkward.columns and out.count() == 11


def test_contexts_find_unseen_identifiers(docs):
    rows = [(i, f"words before; reach me by phone: +1 (212) 555-{1000 + i} or later {i}") for i in range(40)]
    rows += [(100, "no country code, reach me by phone: 212-555-7777 or later"), (101, "it cost 212-555-7777 more"), (102, "phone: nothing")]
    got = {r.doc_id: r for r in pii.pii(docs(rows)).collect()}
    text = dict(rows)[100]
    at = text.index("212")
    assert got[100].spans == f"phone:{at}:{at + 12}" and got[100].n_added == 1 and got[100].n_phone == 0
    assert got[101].spans == "" and all(got[i].n_added == 0 for i in range(40))
    masked = {r.doc_id: r.text for r in pii.redacted(docs(rows)).collect()}
    assert masked[100] == text[:at] + "[PHONE]" + text[at + 12 :] and masked[101] == dict(rows)[101]
    assert masked[3].startswith("words before; reach me by phone: [PHONE] or later")


def test_long_arrays_have_right_places(spark):
    n = 1000
    df = spark.createDataFrame([(" ".join(f"a{i}@b.cd" for i in range(n)),)], "text string")
    got = pii.with_found(df, {"m": pii.BASE["email"]}).head().m
    text = df.head().text
    assert [(x.s, x.e) for x in got] == [m.span() for m in re.finditer(RULES["email"], text)] and len(got) == n


def test_contexts_are_the_words_beside_a_match(docs):
    text = "alpha beta (1.2.3.4), gamma 5.6.7.8 9.9.9.9\n7.7.7.7 omega"
    got = pii.with_found(docs([(1, text)]), {"m": pii.BASE["ip"]}).head().m
    assert [x.p for x in got] == [
        ["<1 beta", "<2 alpha beta", ">1 gamma"], ["<1 gamma", "<2 (0.0.0.0), gamma", ">1 0.0.0.0"],
        ["<1 0.0.0.0", "<2 gamma 0.0.0.0", ">1 0.0.0.0"], ["<1 0.0.0.0", "<2 0.0.0.0 0.0.0.0", ">1 omega"]]


def test_added_spans_and_scores_match_brute_force(spark, docs):
    rng = random.Random(2)
    words = ["call", "phone:", "host", "costs", "see", "mail"]

    def value(kind):
        return {"call": f"+1 212 555 {rng.randrange(1000, 9999)}", "phone:": f"(212) 555-{rng.randrange(1000, 9999)}" if rng.random() < 0.1 else f"+1 (212) 555-{rng.randrange(1000, 9999)}",
                "host": f"10.0.{rng.randrange(256)}.{rng.randrange(256)}" if rng.random() < 0.8 else f"fe80::{rng.randrange(16, 99)}", "costs": f"{rng.randrange(10**6, 10**7)}",
                "see": f"a{rng.randrange(99)}@b.cd" if rng.random() < 0.5 else f"{rng.randrange(10**7)}", "mail": f"x{rng.randrange(99)}@{rng.choice(['b.cd', 'host'])}"}[kind]

    rows = [(i, " ".join(f"{w} {value(w)} and" for w in rng.choices(words, k=4))) for i in range(150)]
    table = pii.with_mentions(pii.with_found(docs(rows).select("doc_id", "text"), {k: pii.BASE[k] for k in pii.KINDS} | {"token": pii.TOKEN}).withColumn("base", pii.base_spans()))
    mentions = {r.doc_id: [(m.s, m.e, m.k, m.v, m.p) for m in r.m] for r in table.select("doc_id", "m").collect()}
    seen = {(p, v, k) for ms in mentions.values() for _, _, k, v, ps in ms for p in ps}
    total, guess = {}, {}
    for p, v, k in seen:
        total[p] = total.get(p, 0) + 1
    for _ in range(pii.ROUNDS):
        mass = {}
        for p, v, k in seen:
            for kind, c in ([(k, 1.0)] if k is not None else guess.get(v, {}).items()):
                mass[p, kind] = mass.get((p, kind), 0) + c
        good = {(p, k): m / (total[p] + 0.5) for (p, k), m in mass.items() if total[p] >= pii.MIN_INSTANCES and m >= pii.MIN_INSTANCES and m / (total[p] + 0.5) >= pii.MIN_SCORE}
        miss = {}
        for p, v, k in seen:
            if k is None:
                for (q, kind), c in good.items():
                    if q == p:
                        miss[v, kind] = miss.get((v, kind), 1.0) * max(1 - c, 1e-6)
        guess = {}
        for (v, kind), x in miss.items():
            guess.setdefault(v, {})[kind] = 1 - x
    want, n = {}, 0
    for i, ms in mentions.items():
        spans = []
        for s, e, k, v, ps in ms:
            hits = [(good[p, kind], -kind) for p in ps for kind in range(4) if (p, kind) in good and re.search(pii.LOOSE[pii.KINDS[kind]], v)] if k is None else []
            if k is not None or hits:
                spans.append((s, k if k is not None else -max(hits)[1], e))
                n += k is None
        want[i] = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    assert n > 20 and {r.doc_id: r.spans for r in pii.pii(docs(rows)).collect()} == want
    assert any(f"phone:{t.index('(212)')}:{t.index('(212)') + 14}" in want[i] for i, t in rows if " (212)" in t and "+1 (212)" not in t)


def masked(text, spans):
    out, at = "", 0
    for s, k, e in spans:
        if s >= at:
            out += text[at:s] + f"[{pii.KINDS[k].upper()}]"
        at = max(at, e)
    return out + text[at:]


def test_masking_matches_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab\n😀é ") for _ in range(rng.choice([0, 5, 4096, 8192, 20_000])))
        spans = sorted((s, rng.randrange(4), min(len(text), s + rng.choice([1, 3, 5000]))) for s in (rng.randrange(len(text)) for _ in range(rng.choice([0, 1, 40]))) ) if text else []
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<s:int,k:int,e:int>>")
    assert {r.i: r.masked for r in pii.with_masked(df).collect()} == {i: masked(t, x) for i, t, x in rows}


def test_long_texts_take_linear_time(docs):
    def rows(n):
        many = " ".join(f"id{i} 10.0.{i % 250}.{i % 199} host" for i in range(n))
        return [(1, many), (2, " ".join(map(str, range(4 * n)))), (3, "9" * 10 * n), (4, " ".join(f"x{i}" for i in range(2 * n)))]

    def seconds(n):
        some = docs(rows(n))
        began = time.time()
        got = {r.doc_id: r for r in pii.pii(some).collect()}
        assert got[1].n_ip == n and got[2].n_ip == 0
        assert {r.doc_id: r.text.count("[IP]") for r in pii.redacted(some).collect()} == {1: n, 2: 0, 3: 0, 4: 0}
        return time.time() - began

    seconds(1000)  # compiles
    one = seconds(12_000)
    assert seconds(24_000) < 3.2 * one  # a square would take four times as long


def test_scan_of_any_length(spark):
    rng = random.Random(3)
    sizes = [1, 2, 31, 32, 33, 1023, 1024, 1025, 5000, 33_000]
    rows = [(i, [rng.randrange(-9, 10) for _ in range(n)]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, x array<int>")
    for zero, step, plain in ((0, lambda a, b: a + b, lambda a, b: a + b), (-100, pii.larger, max)):
        got = {r.i: r.y for r in df.select("i", pii.scan(F.col("x"), zero, step).alias("y")).collect()}
        for i, x in rows:
            at, want = zero, []
            for v in x:
                at = plain(at, v)
                want.append(at)
            assert got[i] == want


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd", 1, "r", None)], "doc_id long, text string, _row int, spans string, masked string")
    assert tuple(pii.redacted(df).head()) == (1, "mail [EMAIL]", 1, "r", None)
