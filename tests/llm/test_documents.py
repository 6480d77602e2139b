"""Pseudonyms, toxicity, page extraction, language, chat windows and near-duplicates."""

import datetime
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tritloom.llm import bpe, chatfmt, htmlmain, langid, pii, simhash, toxicity

from ..oracle import SF

# ---- PII


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


KEY = "a key of the tests"


def masked(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("pii", F.lit("clash"))
    return [(r.text, r.pii_kinds) for r in pii.pseudonymise(df, **{"key": KEY} | kw).orderBy("doc_id").collect()]


def test_pseudonyms_keep_format_and_link_equal_values(spark):
    texts = [
        "call +1 (858) 555-2896 or (858) 555-2896 or 858-555-2896", "4111 1111 1111 1111 and 4111111111111111, not 4111111111111112", "10.0.0.1 but 999.1.1.1",
        "und.34@mail7.example.com", "1984-02-29 1999-12-31 2001-13-01 12/11/1999 25/12/2003 12/31/1999 31.02.2000", "GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32",
        "123-45-6789 000-12-3456", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "", None, "plain 12345678901234567890 text", "see +1 (858) 555-2896 again " + "x" * 100_000,
    ]
    got = masked(spark, texts)
    kinds = [k for _, k in got]
    assert [len(k) for k in kinds] == [3, 2, 1, 1, 5, 1, 1, 1, 0, 0, 0, 1]
    shape = lambda t: re.sub(r"[0-9]", "9", t)
    for k in (0, 1, 4, 6):
        assert shape(got[k][0]) == shape(texts[k]) and got[k][0] != texts[k]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[1][0])
    assert luhn(cards[0].replace(" ", "")) and cards[0].replace(" ", "") == cards[1] and cards[2] == "4111111111111112"
    assert got[2][0].endswith(" but 999.1.1.1") and max(map(int, got[2][0].split(" ")[0].split("."))) <= 255
    assert got[3][0].endswith("@mail7.example.com") and re.fullmatch(r"[a-z]{3}\.\d\d@.*", got[3][0])
    assert "2001-13-01" in got[4][0] and "31.02.2000" in got[4][0] and int(got[4][0].split(" ")[0][-2:]) > 28
    moved = (x := got[5][0].split(" and ")[0].replace(" ", ""))[4:] + x[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and got[5][0].endswith("GB83 WEST 1234 5698 7654 32")
    assert got[8][0] == "" and got[9][0] is None and got[10][0] == texts[10]
    assert got[0][0][5:22] == got[11][0][4:21]
    assert masked(spark, texts[:1], key="other")[0][0] != got[0][0]


def test_international_numbers_and_short_dates(spark):
    phones = ["+44 20 7946 0958", "+33 1 23 45 67 89", "+49 30 901820", "+34 912 34 56 78", "+49 (0)30/901820", "+441632960", "+49 30 123 4567 89", "+1 858 555 2896", "+33\u00a01\u202f23 45 67 89"]
    dates = ["3/7/1987", "03/07/1987", "07-03-1987", "31.1.2000", "1-31-2000", "25/2/2003"]
    not_any = ["+1 234", "+1234567", "3/77/1987", "12-11-1999-5", "1.2.3", "a + 12 345 678 b"]
    got = masked(spark, [f"at {x}, or" for x in phones + dates + not_any])
    assert [k for _, k in got] == [["phone"]] * len(phones) + [["date"]] * len(dates) + [[]] * len(not_any)
    for (new, _), x in zip(got, phones, strict=False):
        assert re.sub(r"[0-9]", "9", new) == re.sub(r"[0-9]", "9", f"at {x}, or") and new != f"at {x}, or"
    dated = [new for new, _ in got[len(phones) : len(phones) + len(dates)]]
    assert dated[0] == dated[1] and all(new != f"at {x}, or" for new, x in zip(dated, dates, strict=True))


def test_permutations_are_bijections(spark):
    days = [f"{y}-{m:02d}-{d:02d}" for y in range(1900, 2100) for m in range(1, 13) for d in range(1, 32) if d <= (28 + (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)) if m == 2 else 30 if m in (4, 6, 9, 11) else 31)]
    df = spark.createDataFrame([(x,) for x in days], "text string")
    pseudonymise = lambda x: pii.pseudonymise(x, key=KEY)
    got = pseudonymise(df).where("size(pii_kinds) = 1").agg(F.countDistinct("text")).first()[0]
    assert got == len(days)
    slash = [f"{a:02d}/{b:02d}/{y}" for y in (1999, 2000) for a in range(1, 32) for b in range(1, 13)] + [f"{b:02d}/{a:02d}/2000" for a in range(13, 29) for b in range(1, 13)]
    df = spark.createDataFrame([(x,) for x in sorted(set(slash))], "text string")
    out = pseudonymise(df).where("size(pii_kinds) = 1")
    assert out.agg(F.countDistinct("text")).first()[0] == out.count() > 700
    ips = spark.range(3000).select(F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("id") / 256).cast("int"), (F.col("id") % 256).cast("int")).alias("text"))
    assert pseudonymise(ips).agg(F.countDistinct("text")).first()[0] == 3000
    ssn = spark.range(3000).select(F.concat(F.lit("665-01-"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("text"))
    out = pseudonymise(ssn)
    assert out.agg(F.countDistinct("text")).first()[0] == 3000 and out.where("text like '666%' or text like '000%' or text like '9%'").count() == 0


def feistel(key, kind, left, right, a, b):
    """The rounds, in plain Python."""
    for i in range(pii.ROUNDS):
        other = right if i % 2 == 0 else left
        turn = int(hashlib.sha256("|".join(map(str, (key, kind, i, a, b, other))).encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + turn) % a
        else:
            right = (right + turn) % b
    return left, right


def chars(kind, x, letters=26):
    left, right = x[: len(x) // 2], x[len(x) // 2 :]
    for i in range(pii.ROUNDS):
        half, other = (left, right) if i % 2 == 0 else (right, left)
        mac = hashlib.sha512("|".join(map(str, (KEY, kind, i, len(x), other))).encode()).digest()
        new = ""
        for j, c in enumerate(half):
            for first, n in (("0", 10), ("a", letters), ("A", letters)):
                if ord(first) <= ord(c) < ord(first) + n:
                    c = chr(ord(first) + (ord(c) - ord(first) + mac[j % 64]) % n)
                    break
            new += c
        left, right = (new, right) if i % 2 == 0 else (left, new)
    return left + right


def digits(kind, d):
    h, k = len(d) // 2, len(d) - len(d) // 2
    x, y = feistel(KEY, kind, int(d[:h]), int(d[h:]), 10**h, 10**k)
    return f"{x:0{h}d}{y:0{k}d}"


def refill(m, new, of):
    new = iter(new)
    return "".join(next(new) if c in of else c for c in m)


LATE = [(m, d) for m in range(1, 13) for d in (29, 30, 31) if m != 2 and not (d == 31 and m in (4, 6, 9, 11))]
LATE_DATES = [(y, *x) for y in range(1900, 2100) for x in LATE] + [(y, 2, 29) for y in range(1904, 2100, 4)]


def late(y, m, d):
    at = LATE_DATES.index((y, m, d))
    while True:
        x, z = feistel(KEY, "late", at // 76, at % 76, 77, 76)
        at = x * 76 + z
        if at < len(LATE_DATES):
            return LATE_DATES[at]


def fresh(m):
    """A match and its kind, in plain Python; None where validation fails."""
    D, S = "0123456789", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if "@" in m:
        local, domain = m.split("@", 1)
        return "email", (chars("email", local) if local.isascii() else "=" + chars("email=", local.encode().hex(), 6)) + "@" + domain
    if re.fullmatch("[0-9A-Fa-f]{32,64}", m):
        return "secret", chars("secret", m, 6)
    if re.match("[A-Z]{2}[0-9]{2}", m):
        x = m.replace(" ", "")
        mod = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
        if not (15 <= len(x) <= 34 and "02" <= x[2:4] <= "98" and mod(x[4:] + x[:4]) == 1):
            return None
        body = chars("iban", x[4:])
        return "account", refill(m, f"{x[:2]}{98 - mod(body + x[:2] + '00'):02d}{body}", S)
    if found := re.fullmatch("([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{1,2})([-/.])([0-9]{1,2})[-/.]([0-9]{4})", m):
        iso = found[1] is not None
        y, a, b = map(int, found.group(1, 2, 3) if iso else found.group(7, 4, 6))
        month, day = (a, b) if iso else (min(a, b), max(a, b))
        try:
            datetime.date(y, month, day)
        except ValueError:
            return None
        if day > 28:
            y, month, day = late(y, month, day)
        elif iso:
            x, z = feistel(KEY, "date", (month - 1) * 28 + day - 1, y - 1900, 336, 200)
            y, month, day = 1900 + z, x // 28 + 1, x % 28 + 1
        elif day <= 12:
            x, z = feistel(KEY, "day", (a - 1) * 12 + b - 1, y - 1900, 144, 200)
            return "date", f"{x // 12 + 1:02d}{found[5]}{x % 12 + 1:02d}{found[5]}{1900 + z}"
        else:
            x, z = feistel(KEY, "day", (month - 1) * 16 + day - 13, y - 1900, 192, 200)
            y, month, day = 1900 + z, x // 16 + 1, x % 16 + 13
        if iso:
            return "date", f"{y}-{month:02d}-{day:02d}"
        return "date", found[5].join(f"{v:02d}" for v in ((day, month) if a > b else (month, day))) + f"{found[5]}{y}"
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
        a, b, c, d = map(int, m.split("."))
        x, z = feistel(KEY, "ip", a * 256 + b, c * 256 + d, 65536, 65536)
        return ("ip", f"{x // 256}.{x % 256}.{z // 256}.{z % 256}") if max(a, b, c, d) < 256 else None
    if re.match(r"[+(]|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}$", m):
        c = re.match(r"([+][0-9]{1,3})?", m)[0]
        return "phone", c + refill(m[len(c) :], digits("phone", "".join(x for x in m[len(c) :] if x in D)), D)
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        a, b, y = map(int, m.split("-"))
        if not (1 <= a <= 899 and a != 666 and b and y):
            return None
        x, z = feistel(KEY, "ssn", (a - (1 if a < 666 else 2)) * 99 + b - 1, y - 1, 88902, 9999)
        a = x // 99
        return "ssn", f"{a + (1 if a < 665 else 2):03d}-{x % 99 + 1:02d}-{z + 1:04d}"
    if re.search("[A-Za-z]", m):
        return "secret", chars("token", m)
    d = "".join(x for x in m if x in D)
    if not (re.fullmatch(pii.ISSUERS, d) and luhn(d)):
        return None
    body = d[:4] + digits("card", d[4:-1])
    return "card", refill(m, body + next(c for c in D if luhn(body + c)), D)


def brute_pii(text):
    kinds, out, at = [], "", 0
    for found in regex.finditer(pii.PATTERN, text or "") if re.search("[0-9@]", text or "") else ():
        new = fresh(found[0])
        kinds += [new[0]] if new else []
        out += text[at : found.start()] + (new[1] if new else found[0])
        at = found.end()
    return (None if text is None else out + text[at:]), kinds


def test_pseudonyms_against_plain_python(spark):
    """Every kind, and every text of the documents table."""
    R = random.Random(1)
    some = lambda n, of="0123456789": "".join(R.choice(of) for _ in range(n))
    texts = [None, "", "иван@mail.ru or jürgen.1@x.de", 'api_key = "AbCd1234efGH5678", password: ' + some(60, "abC12"), "token=" + some(40, "0123456789abcdef"), "GB00WEST12345698765432 GB82 WEST 1234 5698 7654 32"]
    for prefix, n in (("4", 13), ("4", 16), ("51", 16), ("2221", 16), ("34", 15), ("6011", 16), ("3530", 19), ("9", 16), ("30", 14)):
        while True:
            d = prefix + some(n - len(prefix))
            if luhn(d):
                break
        texts.append(f"card {d} of")
    texts += [".".join(str(R.randrange(300)) for _ in range(4)) for _ in range(20)]
    texts += [f"{R.randint(1890, 2100)}-{R.randint(1, 13):02d}-{R.randint(1, 31):02d} {R.randint(1, 31)}/{R.randint(1, 31)}/{R.randint(1900, 2099)} {R.randint(29, 31)}.{R.randint(1, 12)}.{R.randint(1900, 2099)}" for _ in range(60)]
    texts += [f"{R.randint(0, 999):03d}-{R.randint(0, 99):02d}-{some(4)} +{R.randint(1, 999)} {some(3)} {some(5)} ({some(3)}) {some(3)}-{some(4)}" for _ in range(30)]
    for text, got in zip(texts, masked(spark, texts), strict=True):
        assert (got[0], list(got[1])) == brute_pii(text)
    spark.conf.set(pii.SETTING, KEY)
    try:
        found = {r.doc_id: r for r in pii.op4(spark, SF).collect()}
    finally:
        spark.conf.unset(pii.SETTING)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        text, kinds = brute_pii(r.text)
        assert (found[r.doc_id].text, found[r.doc_id].kinds, found[r.doc_id].n_replaced) == (text, ",".join(kinds), len(kinds))


def test_pseudonym_edges_and_keys(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org or 10.0.0.1"), (2, None), (1, "mail a.b@c.org or 10.0.0.1")], "doc_id bigint, text string").withColumn("pii_kinds", F.lit("clash")).withColumn("__key2", F.lit(1))
    out = pii.pseudonymise(df, key="never shown")
    assert out.columns == df.columns and "never shown" not in out._jdf.queryExecution().toString() and pii.pseudonymise(df.limit(0)).count() == 0
    rows = out.collect()
    assert rows[0].text == rows[2].text != pii.pseudonymise(df).first().text and list(rows[0].pii_kinds) == ["email", "ip"]
    many = spark.createDataFrame([(1, " ".join(f"10.{k // 256}.{k % 256}.7" for k in range(20_000)))], "doc_id bigint, text string")
    assert len(set(pii.pseudonymise(many).first().text.split(" "))) == 20_000


# ---- toxicity


def test_block_max_search_equals_brute_force():
    R = random.Random(5)
    vectors = []
    for _ in range(700):
        t = np.array(sorted(R.sample(range(30), R.randint(1, 6))))
        w = np.array([R.choice([1.0, 1.7, 2.2]) for _ in t])
        vectors.append((t, w / np.linalg.norm(w)))
    ids = R.sample(range(10_000), 700)
    index = toxicity.BlockMaxIndex(vectors, ids, [0] * 700, 30)
    dense = np.zeros((700, 30))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 700, 13):
        places, cosines = index.nearest(*vectors[q], k=9, without=int(index.place[q]))
        scores = np.round(dense @ dense[q], 12)
        scores[q] = 0
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if s > 0)[:9]
        assert np.allclose(cosines, [-s for s, _ in want], atol=1e-9)
        exact = {i for s, i in want if -s > cosines[-1] + 1e-9}
        assert set(index.ids[places].tolist()[: len(exact)]) == exact


def test_block_max_index_takes_two_passes(monkeypatch):
    """However many blocks reach the kth score: the best ones, then all others at once."""
    draws, ranges, calls = np.random.default_rng(3), toxicity._ranges, []
    vectors = [(np.arange(30), x / np.linalg.norm(x)) for x in draws.random((64 * 60, 30))]
    index = toxicity.BlockMaxIndex(vectors, list(range(64 * 60)), [0] * (64 * 60), 30)
    monkeypatch.setattr(toxicity, "_ranges", lambda *a: calls.append(1) or ranges(*a))
    places, cosines = index.nearest(*vectors[7])
    assert len(calls) == 3  # the entries, and the postings of either pass
    scores = np.round(np.array([w @ vectors[7][1] for _, w in vectors]), 12)
    assert np.allclose(cosines, np.sort(scores)[::-1][: toxicity.K], atol=1e-11) and index.ids[places[0]] == 7


def brute_toxicity(docs, labels):
    """Neighbours and votes of every text by dense vectors; docs: [(id, text)], labels: {id: 0 or 1}."""
    examples = sorted({(i, labels[i], t) for i, t in docs if i in labels}, key=lambda x: x[:2])
    counts = {t: toxicity.term_counts(t) for _, t in docs}
    words = sorted(set().union(*(counts[t] for _, _, t in examples)))
    df = {w: sum(w in counts[t] for _, t in docs) for w in words}
    groups = {(min((zlib.crc32(w) for w in counts[t]), default=None), y): counts[t] for _, y, t in examples if counts[t]}
    n = [sum(y == k for _, y in groups) for k in (0, 1)]
    weight = {}
    for w in words:
        a, b = (sum(w in c for (_, y), c in groups.items() if y == k) for k in (1, 0))
        p = min(1, (a + b) / sum(n))
        z = (a / n[1] - b / n[0]) / (max(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1])) ** 0.5
        weight[w] = math.log((1 + len(docs)) / (1 + df[w])) * max(1.0, abs(z) / toxicity.Z) ** toxicity.POWER

    def vector(t):
        v = np.array([(1 + math.log(counts[t][w])) * weight[w] if w in counts[t] else 0.0 for w in words])
        return v / (np.linalg.norm(v) or 1)

    every = np.array([vector(t) for _, _, t in examples])
    for i, t in docs:
        near = sorted((-round(float(s), 9), e[0], e[1]) for s, e in zip(every @ vector(t), examples, strict=True) if s > 1e-12)[: toxicity.K]
        yield i, near, sum(-s * y for s, _, y in near) / sum(-s for s, _, _ in near) if near else None


def test_toxicity_query_against_brute_force(spark):
    """Neighbours, votes and scores of a small corpus, with ties, copies, repeated labels and odd texts."""
    R = random.Random(3)
    word = lambda: "w" + str(R.randrange(60))
    docs = []
    for i in range(120):
        bad = i % 5 == 0
        docs.append((i, " ".join([word() for _ in range(R.randint(1, 30))] + (["scum"] * R.randint(1, 2) if bad else []))))
    docs += [(200 + k, docs[10][1]) for k in range(5)] + [(300, None), (301, ""), (302, "zzz"), (7, docs[8][1]), (303, "scum " * 20_000)]
    labels = {i: int(i % 5 == 0) for i in range(0, 120, 2)} | {200: 1, 201: 1}
    rows = [(i, y) for i, y in labels.items()] + [(10, 0), (10, 1), (None, 1), (5, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash"))
    model = toxicity.fit(df, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
    got = sorted((r.doc_id, [(-round(c, 9), n) for c, n in zip(r.cosines, r.neighbours, strict=True)], round(r.score, 9)) for r in toxicity.score(df, model).collect())
    want = sorted((i, [x[:2] for x in near], round(float(np.interp(vote, *model.knots)) if near else model.base, 9)) for i, near, vote in brute_toxicity(docs, labels))
    for (i, near, score), (j, wanted, expected) in zip(got, want, strict=True):
        assert i == j and abs(score - expected) < 1e-6 and np.allclose([s for s, _ in near], [s for s, _ in wanted], atol=1e-8)
        last = wanted[-1][0] if wanted else 0
        assert {n for s, n in near if s < last - 1e-7} == {n for s, n in wanted if s < last - 1e-7}


def test_toxicity_held_out_and_edges(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.op5(spark, sf).cache()
    got = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted and r.toxic for r in got)
    assert right / sum(r.toxic for r in got) > 0.85 and right / sum(r.predicted for r in got) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    assert found.where("size(neighbours) > 0").count() > 0.95 * found.count()
    found.unpersist()
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you scum"), (3, "you scum"), (None, "x" * 200_000)], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    none = docs.limit(0)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == 5 and toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0
    many = spark.range(3000).select(F.lit(3).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert toxicity.examples_of(many, spark.createDataFrame([(3, 1)], "doc_id bigint, toxic int"), examples=100).count() < 200


# ---- pages


def test_page_extraction():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site"><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>One   two&nbsp;three.<p><b>Bold</b> text<br>next<script>var t="</p>";</script></p>
    <div class="ad-slot">Buy <div>now</div></div><aside>Related</aside><p>Of.</p><form><input><button>Go</button>Sign up</form>
    <section id="comments"><article class="comment">Nice!</article></section></article><footer>&copy; 2020</footer></body></html>"""
    assert htmlmain.main_text(page) == ["Head & line", "One two three.", "Bold text next", "Of."]
    assert htmlmain.main_text(None) == htmlmain.main_text("") == htmlmain.main_text("<nav>x</nav>") == htmlmain.main_text("<!-- x") == []
    assert htmlmain.main_text("just < text") == ["just < text"]
    long = "word " * 60
    plain = f'<body><div class="menu"><a href="#">a</a></div><ul><li><a href="/">Home page link</a></li></ul><div><p>{long}</p><p>short</p><p>{long}</p></div><div class="footer">c</div></body>'
    assert htmlmain.main_text(plain) == [long.strip(), "short", long.strip()]
    assert len(htmlmain.main_text("<p>" + "x" * 300_000)[0]) == 300_000


def test_long_tags_are_no_text():
    uri = "data:image/png;base64," + "A" * 100_000
    for tag in (f'<img src="{uri}">', f"<img alt='a > b' src={uri} >", f'<span data-state="{"<b>" * 40_000}">x</span>'):
        got = htmlmain.main_text(f"<article><p>One {tag} two</p></article>")
        assert got in (["One two"], ["One x two"])
    for odd in ('<a b="' * 100_000, "<a b='\"c" * 100_000, "<a " * 100_000, '<p "<' * 100_000 + ">"):  # linear: quadratic takes minutes
        htmlmain.main_text(odd)


def test_cuts_go_by_whole_attributes_and_words():
    kept = ('style="overflow:hidden"', 'data-hidden="false"', 'data-id="sidebar"', 'class="content no-sidebar"', "data-role=search", 'title="class=ad id=menu hidden"', 'class="has-comments" aria-hidden="false"')
    for attributes in kept:
        for name in ("article", "div"):
            assert htmlmain.main_text(f"<{name} {attributes}><p>Text of the page.</p></{name}>") == ["Text of the page."], attributes
    for attributes in ("hidden", 'HIDDEN=""', "class='big ad'", "id=sidebar", 'class="site-footer"', 'class="commentList"', 'data-x="hidden" role="search"', 'class = "comment-12"'):
        assert htmlmain.main_text(f"<div {attributes}><p>Text of the page.</p></div><p>Rest.</p>") == ["Rest."], attributes


def brute_spans(lengths):
    """Surge and dive points by the sums of all windows, written out."""
    window = [sum(lengths[k : k + htmlmain.SPAN]) for k in range(len(lengths))]
    surge = min(htmlmain.SURGE, max(window, default=0))
    dive = min(htmlmain.DIVE, surge)
    fit = [k for k, x in enumerate(lengths) if window[k] >= surge and x >= htmlmain.DIVE] or [k for k, x in enumerate(lengths) if window[k] >= surge and x]
    out, k = [], 0
    while surge and k < len(lengths):
        if k in fit:
            end = next((j for j in range(k, len(lengths)) if window[j] < dive), len(lengths))
            out.append((k, max(j for j in range(k, end) if lengths[j]) + 1))
            k = end
        else:
            k += 1
    return out


def test_line_blocks_sums_and_points():
    assert htmlmain.line_blocks([4, 0, 100, 1, 90, 0, 0, 0, 4]) == [(2, 5)]
    assert htmlmain.line_blocks([4]) == [(0, 1)] and htmlmain.line_blocks([]) == htmlmain.line_blocks([0, 0]) == []
    R = random.Random(9)
    for _ in range(500):
        lengths = [R.choice([0, 0, 3, 12, 24, 25, 40, 79, 80, 300]) for _ in range(R.randint(0, 30))]
        assert htmlmain.line_blocks(lengths) == brute_spans(lengths)


STORY = "Long text of a story that goes on and on for some lines. " * 4


@pytest.mark.parametrize(
    "page,want",
    [
        ('<body><h1>Title</h1><p>{0}</p><p>short</p><div class="legal">Copyright 2020</div><div>Call us now</div></body>', ["Title", "{0}", "short"]),
        ("<body><div><p>{0}</p><p><a href=x>{0}</a></p><p>{0}</p></div></body>", ["{0}"] * 3),
        ("<body><article><p>A teaser of another story with a line of text that is long enough for a surge of its own.</p></article><div><h1>T</h1><p>{0}</p><p>{0}</p><p>end</p></div></body>", ["T", "{0}", "{0}", "end"]),
        ('<div id="page" class="has-sidebar"><p>{0}</p></div>', ["{0}"]),
        ('<div class="sidebar-page"><p>{0}</p><p>a</p><p>b</p><p>c</p><p>d</p><p>{0}</p><div class=sidebar>x</div></div>', ["{0}", "a", "b", "c", "d", "{0}"]),
        ('<body><div class="ad">{0}</div><article><p>Tiny.</p></article></body>', ["Tiny."]),
        ('<div class="comments">{0}<p>a</p><p>b</p><p>c</p><p>d</p><p>e</p></div><div><p>Tiny.</p></div>', ["Tiny."]),
        ("<body><div id=s><h1>T</h1><p>intro</p><div class=body><p>{0}</p><p>{0}</p></div><p>end.</p></div><p>foot</p></body>", ["T", "intro", "{0}", "{0}", "end."]),
        ('<article><p>Price</p><p class="share-price">12.3</p><p id="search-algorithms">{0}</p></article>', ["Price", "12.3", "{0}"]),
        ("<body><div>{0}</div><div>{0}</div><div>tiny.</div></body>", ["{0}", "{0}", "tiny."]),
        ("<div><p>{0}</p><ul><li>a</li><li>b</li></ul></div><table><tr><td>c</td></tr></table>", ["{0}", "a", "b"]),
    ],
)
def test_pages_without_marked_article(page, want):
    assert htmlmain.main_text(page.replace("{0}", STORY)) == [x.replace("{0}", STORY.strip()) for x in want]


def test_given_pages_with_and_without_article_tags(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want = [x.text for x in htmlmain.read_page(article).lines if x.text]
        assert htmlmain.main_text(r.html) == want
        assert htmlmain.main_text(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r.html)) == want


def test_unclosed_and_deep_elements_take_linear_time():
    for odd in ("<p>x" + "<iframe src=a>" * 100_000, "<div>" * 50_000 + STORY, "<ul><li>" * 30_000 + STORY):
        htmlmain.main_text(odd)


def test_page_query_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>é</p>"), (3, "u", "<p>é</p>")], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.page_id, r.text) for r in htmlmain.extract(pages).collect()) == [(1, ""), (2, ""), (3, "é"), (3, "é")]
    assert htmlmain.extract(pages.limit(0)).count() == 0


# ---- language


def test_language_held_out_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, where=~langid.held_out())
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and sum(r.rejected for r in got) <= 0.01 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ²³ !!"), (4, "Der die das und"), (None, "the " * 50_000)], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    found = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and found[4].lang_pred == "de" and found[None].lang_pred == "en"
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {4, None} and kept.where("doc_id < 4").count() == 0
    none = langid.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0
    same = spark.range(2000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("word a"), F.when(F.col("id") < 1000, F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    assert 20 < langid.sample_of(same, per_language=50).count() <= 50


# ---- chat


@pytest.mark.parametrize("budget,history", [(20, 0), (60, 2), (200, 4)])
def test_chat_windows_round_trip(budget, history):
    R, encode = random.Random(budget), bpe.coder(*bpe.vocabulary()).encode
    for _ in range(300):
        turns = [(R.choice(["user", "assistant", "system", "a:b", "\\", "x\\c:", "", "</turn>"]), "".join(R.choice(["a", "###", " </turn>\n", "</turn>", "\\", "\n", ": ", "#", " ", "é"]) for _ in range(R.randint(0, 60)))) for _ in range(R.randint(1, 40))]
        conv = chatfmt._Conversation(budget, history, encode)
        windows = [w for r, t in turns for w in conv.add(r, t)] + list(conv.windows(True))
        back, loss = [], ""
        for _, repeated, new, tokens, text, spans in windows:
            found = chatfmt.parse(text)
            assert len(found) == repeated + new and (tokens <= budget or new == 1) and tokens >= len(encode(text)) // 4 - len(found)
            back += [(a, b) for a, b, _, _ in found[repeated:]]
            loss += "".join(chatfmt.unescape(text[s["start"] : s["end"]]) for s in spans)
            if turns[0][0] == "system" and windows[0][4] != text:
                assert found[0][:2] == turns[0]
        assert back == turns and loss == "".join(t for r, t in turns if r == "assistant")


def test_chat_query_against_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    convs = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    said = "\\### Assistant: </turn> ok"
    convs[-7] = [("user", said), ("assistant", said)]
    got = {r.conv_id: r for r in chatfmt.op8(spark, SF).collect()}
    assert set(got) == set(convs)
    for k, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[k].formatted_chars > sum(len(t) for _, t in turns)


def test_chat_null_and_long_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (None, 0, "assistant", "x"), (2, 0, "assistant", "y" * 50_000), (1, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = {r.conv_id: r for r in chatfmt.read_back(chatfmt.windows(df)).collect()}
    assert got[1].n_turns == 3 and got[None].loss_chars == 1 and got[2].loss_chars == 50_000
    assert chatfmt.windows(df.limit(0)).count() == 0


# ---- near-duplicates


def brute_mark(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    parent = {m: m for m in marks}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    every = sorted(marks)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {m: find(m) for m in every}


def test_fingerprints_and_components(spark):
    R = random.Random(8)
    word = lambda: "w" + str(R.randrange(400))
    base = [[word() for _ in range(120)] for _ in range(6)]
    texts = [None, "", " \t\n", "One", "one", "two WORDS", "\x1ca b\x85c d e"]
    for b in base:
        for _ in range(12):
            c = list(b)
            for _ in range(R.randint(0, 4)):
                c[R.randrange(len(c))] = word()
            texts.append(" ".join(c))
    texts += [" ".join(base[0])] * 5 + ["long " * 30_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("mark", F.lit("clash"))
    got = simhash.near_duplicates(docs).collect()
    marks = {i: brute_mark(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.mark & (1 << 64) - 1 for r in got} == marks
    roots = brute_components(set(marks.values()))
    first = {}
    for i in sorted(marks):
        first.setdefault(roots[marks[i]], i)
    assert {r.doc_id: r.component_id for r in got} == {i: first[roots[m]] for i, m in marks.items()}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (None, "z y x w"), (5, "a b c d"), (5, "a b c d")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(odd).collect()) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]


@pytest.mark.parametrize("most,again,near", [(simhash.MOST, 2, 60), (3, 1, 60), (3, 2, 6)])
def test_links_join_exactly_the_near_ones(spark, most, again, near):
    """Random and clustered marks; a small bound sends buckets through further rounds."""
    R = random.Random(most)
    marks = {R.getrandbits(64) for _ in range(150)}
    for seed in sorted(marks)[:5]:
        for _ in range(near):
            m = seed
            for _ in range(R.randint(0, 5)):
                m ^= 1 << R.randrange(64)
            marks.add(m)
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "mark bigint")
    edges = simhash.links(df, most=most, again=again)
    pairs = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in edges.collect()]
    want = brute_components(marks)
    parent = {m: m for m in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    groups = lambda f: sorted(sorted(m for m in marks if f(m) == r) for r in {f(m) for m in marks})
    assert groups(find) == groups(want.get)
    got = {r.node: r.root for r in simhash.components(edges, broadcast=0 if most == 3 else simhash.BROADCAST).collect()}
    assert groups(lambda m: got.get(m - (1 << 64) if m >> 63 else m, m - (1 << 64) if m >> 63 else m)) == groups(want.get)


def test_large_buckets_are_split_on_the_bits_left():
    """A bucket of marks that agree in one segment only: no bucket of the next round holds over a few of them."""
    R = random.Random(6)
    marks = np.array(sorted({R.getrandbits(42) for _ in range(5000)}), dtype=np.int64)  # the top 22 bits are all zero
    key, left = np.zeros(len(marks), np.int64), np.full(len(marks), (1 << 42) - 1, np.int64)
    sizes = {}
    for batch in simhash._keyed_again(4, False)(iter([pa.RecordBatch.from_arrays([pa.array(key), pa.array(left), pa.array(marks)], names=["key", "left", "mark"])])):
        for k, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sizes[k] = sizes.get(k, 0) + 1
            assert rest & ~((1 << 42) - 1) == 0 and bin(rest).count("1") == 28
    assert max(sizes.values()) < 20 and sum(sizes.values()) == 42 * len(marks)


def test_long_chains_become_one_component(spark):
    n = 200
    chain = spark.range(n).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    for bound in (simhash.BROADCAST, 0):
        got = simhash.components(chain, broadcast=bound).collect()
        assert sorted(r.node for r in got) == list(range(n + 1)) and {r.root for r in got} == {0}
