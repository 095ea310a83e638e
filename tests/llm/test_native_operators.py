"""Ops 4, 7 and 9 against Python's own regular expressions, direct recomputation and small graphs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lodegraph.llm import order_minhash, personal_data, url_filter

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    d = [int(c) for c in digits(s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def base(text):
    text = text or ""
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(m),
        "phone": lambda m: 8 <= len(digits(m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, r in zip(ok, (EMAIL, IP, CARD, PHONE), strict=True) for m in r.finditer(text) if ok[k](m[0])]


def noise(rng, n):
    parts = ["a@b.co", "x.y+z@host.example.com", "@", ".", "-", " ", "1.2.3.4", "300.1.1.1", "0010.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+49 (30) 123-4567", "+1", "+12345678", "7", "é", "𝄞", "", "a_b%", "(555) 123-4567", "123-45-6789", "DE44 5001 0517 5407 3249 31", "joe [at] mail [dot] org", "call me:", "\n"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_base_spans_like_python(spark):
    rng = random.Random(1)
    texts = [None, "", *[noise(rng, rng.randrange(1, 30)) for _ in range(400)]]
    texts += ["a@" + "b." * 3000 + "c", "1" * 5000, "1 " * 3000, "1." * 3000, "+1" + " " * 5000, "a" * 20000 + "@", "4111 1111 1111 1111 " * 700, "x@y.zz " * 900, "a@b.c_d@e.f", "a@b.cd@e.f", "a@b..c", "1.2.3.4.5.6.7.8", "+1 2345678.", "12-34 5678--9"]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in personal_data.digest(spark, frame).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        r = got[i]
        assert [r[f"n_{k}"] for k in personal_data.BASE] == [sum(x[0] == k for x in want) for k in personal_data.BASE], t
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t
        assert r["spans"].startswith(joined)
        more = [x.split(":") for x in r["spans"][len(joined) :].lstrip(",").split(",") if x]
        assert all(k in personal_data.LOOSE for k, *_ in more)
        assert not [1 for _, s, e in more for _, a, b in want if int(s) < b and a < int(e)]


def test_redaction_takes_every_base_span(spark):
    rng = random.Random(2)
    texts = [None, "", "nothing here", *[noise(rng, 12) for _ in range(60)]]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t) if t else 5) for i, t in enumerate(texts)], DOCS)
    got = personal_data.redact(spark, frame)
    assert got.dtypes == frame.dtypes
    for r in got.collect():
        t = texts[r["doc_id"]]
        if t is None:
            assert r["text"] is None and r["n_chars"] == 5
            continue
        assert r["n_chars"] == len(r["text"])
        if not base(t) and not re.search(r"[0-9]|\[at\]", t):
            assert r["text"] == t
        for k, s, e in base(t):
            assert f"<{k}>" in r["text"] or any(a <= s < b and (a, b) != (s, e) for _, a, b in base(t))


def test_estimate_prefers_agreeing_votes():
    counts = {"email/y/y/y/b": 900, "number/y/y/y/b": 40, "number/n/n/n/b": 300, "number/y/-/-/b": 30, "phone/y/y/y/b": 200}
    likely = personal_data.estimate(counts)
    assert likely["number/y/y/y/b"] > 0.5 > likely["number/n/n/n/b"]
    assert personal_data.estimate({}) == {}


def test_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert personal_data.digest(spark, none).collect() == []
    assert personal_data.redact(spark, none).collect() == []
    assert order_minhash.fingerprints(spark, none).collect() == []
    assert url_filter.verdicts(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_edited_texts_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", 9)
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(300)]
    docs = [(7 * i - 50, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 4, 60, 300])))) for i in range(60)]
    docs += [(1000, None), (1001, "same text " * 40), (1002, "same text " * 40), (1003, "𝄞é " * 50), (1004, "x" * 3000)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS)
    got = {r["doc_id"]: r for r in order_minhash.fingerprints(spark, frame).collect()}
    docs.sort()
    assert len(got) == len(docs)
    texts = {}
    for (i, t), (_, nxt) in zip(docs, [*docs[1:], docs[0]], strict=True):
        t, nxt, r = t or "", nxt or "", got[i]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert texts.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(t) > 400 and nxt != t:
            assert r["near_edited"] > r["near_next"]
        if edited == t:
            assert r["near_edited"] == 1 and r["edited_fingerprint"] == r["fingerprint"]
    assert got[1001]["near_next"] == 1


def test_order_and_repeats_count(spark):
    words = [f"w{i}" for i in range(80)]
    half = words[40:] + words[:40]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(half)), (3, " ".join(words * 2)), (4, " ".join(words))], "doc_id long, text string")
    code = {r["doc_id"]: r["code"] for r in order_minhash.codes(frame, "text", "code").collect()}
    assert code[1] == code[4] and code[1] != code[2] and code[1] != code[3]
    assert len(code[1]) <= 1 << order_minhash.BINS_LOG2 and len({c >> 24 for c in code[1]}) == len(code[1])


def hashed(*values):
    """Spark's xxhash64: each value with the hash of those before it as the seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if not isinstance(v, np.int32) else int(v).to_bytes(4, "little", signed=True), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def plain_fingerprint(text):
    """Order MinHash from the docstring, by loops."""
    words = [w[i : i + 8] for w in re.findall(r"[^ \t\n\x0b\f\r]+", text) for i in range(max(1, len(w) - 7))]
    pieces = [hashed(w) for w in words]
    mers = [hashed(*pieces[i : i + 3]) for i in range(len(pieces) - 2)] or ([hashed(*pieces)] if pieces else [])
    low = lambda m: ((m << 28) & ((1 << 64) - 1)) >> 28  # noqa: E731  36 bits
    signed = lambda m: low(m) - (1 << 36) if low(m) >> 35 else low(m)
    bins, seen = {}, {}
    for i, m in enumerate(mers):
        n = seen[low(m)] = seen.get(low(m), -1) + 1
        h = hashed(signed(m), np.int32(n)) & ((1 << 64) - 1)
        bins.setdefault(h & 63, []).append(((h >> 6) & ((1 << 29) - 1), i))
    out = ""
    for b in sorted(bins):
        first = sorted(i for _, i in sorted(bins[b])[:2])
        out += f"{(b << 24) + (hashed(*[mers[i] for i in first]) & 0xFFFFFF):08x}"
    return out


def plain_likeness(a, b):
    a, b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (a, b))
    either = {x[:2] for x in a | b}
    return len(a & b) / len(either) if either else 1.0


@pytest.mark.parametrize("rows", [7, 1000])
def test_fingerprints_like_plain_loops(spark, monkeypatch, rows):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", rows)
    monkeypatch.setattr(order_minhash, "MAX_COARSE", 5)
    rng = random.Random(7)
    vocab = ["a", "be", "see", "extraordinary", "word", "naïve", "日本語テキストの長い文", "x"]
    docs = [(rng.choice([-(1 << 63) + 1, i * 3, 1 << 62]) if i % 9 == 0 else 5 * i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 30, 200])))) for i in range(90)]
    docs += [(None, f"null id {i}") for i in range(20)] + [(77, f"same id {i}") for i in range(20)] + [(4, None), (1 << 62, "z " * 3000)]
    got = [r.asDict() for r in order_minhash.fingerprints(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    order = sorted(((i is not None, i or 0, hashed(t or ""), t or "") for i, t in docs))
    want = []
    for (has, i, _, t), (*_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        f, e, n = (plain_fingerprint(x) for x in (t, edited, nxt))
        want.append({"doc_id": i if has else None, "n_chars": len(t), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": f, "edited_fingerprint": e, "near_edited": plain_likeness(f, e), "near_next": plain_likeness(f, n)})
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeated_and_missing_ids(spark):
    frame = spark.createDataFrame([(None, "a b c d e f g h"), (5, "one two three four"), (5, "one two three four"), (5, None)], "doc_id long, text string")
    assert len(order_minhash.fingerprints(spark, frame).collect()) == 4


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


@pytest.mark.parametrize("url", [None])
def test_rules(spark, url):
    urls = [url, "", "no scheme", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net/en", "http://example.net", "http://x.org/fr/?q", "http://b.example.com/de/1", "http://b.example.com/en/1", "ftp://myexample.com/de/", "x://É.Net/p#a://b", "http://example.net?x=/en/", "http://u@example.net:80/en/", "a://b://c/d"]
    rules = {f"{h}{p}": (v, h, p) for v, h, p in url_filter.RULES}
    pages = spark.createDataFrame([(i, u, None, "c") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.verdicts(spark, pages).collect()}
    for i, u in enumerate(urls):
        host, path = host_path(u)
        fits = [k for k, (_, h, p) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == rules[rule][0]
        assert got[i]["verdict"] in ("allow", "block")


def host_balance(pages, damping=0.85, rounds=200):
    """Distrust less trust of every host, by dictionaries."""
    hosts, links, seeds = set(), {}, {}
    for _, url, page in pages:
        host, path = host_path(url)
        if not host:
            continue
        fits = [(h, p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        seeds.setdefault(host, []).append(max(fits, key=lambda f: len(f[0] + f[1]))[2] if fits else None)
        hosts.add(host)
        for to in re.findall("href=['\"]?(?:https?:)?//([^/'\"> ]+)", page or ""):
            to = to.lower()
            if to != host:
                links[host, to] = links.get((host, to), 0) + 1
                hosts.add(to)
    above = set()
    for h in hosts:
        p = h.split(".")
        above |= {(".".join(p[i:]), ".".join(p[i + 1 :])) for i in range(len(p) - 2)}
    for a, b in above:
        for e in ((a, b), (b, a)):
            links[e] = links.get(e, 0) + 1

    def spread(verdict, edges):
        rest = {h: (1 - damping) * v.count(verdict) / len(v) for h, v in seeds.items()}
        total = {}
        for (a, _), n in edges.items():
            total[a] = total.get(a, 0) + n
        mass = dict(rest)
        for _ in range(rounds):
            new = dict(rest)
            for (a, b), n in edges.items():
                new[b] = new.get(b, 0) + damping * mass.get(a, 0) * n / total[a]
            mass = new
        return mass

    good, bad = spread("allow", links), spread("block", {(b, a): n for (a, b), n in links.items()})
    return {h: bad.get(h, 0) - good.get(h, 0) for h in seeds}


def test_trust_spreads_over_links(spark):
    """A linked table at production parameters, against direct iteration."""
    rng = random.Random(6)
    hosts = [f"{x}{i}.{top}" for i in range(8) for x, top in (("www.a", "org"), ("b", "net"), ("c", "example.net"), ("d", "test"), ("m.e", "test"), ("f", "example.com"))]
    link = lambda h: rng.choice(["<a href='https://{}/x'>x</a>", '<link rel=canonical href="//{}/y">', "<a href=http://{}>z</a>", "<a href='/{}'>own</a>"]).format(h.upper() if rng.random() < 0.2 else h)
    pages = [(i, f"http://{h}/{rng.choice(['en', 'fr', 'de', ''])}/{i}", "".join(link(rng.choice(hosts)) for _ in range(rng.randrange(5)))) for i, h in enumerate(hosts * 3)]
    pages += [(998, None, link("x.org")), (999, "no host", None)]
    got = {r["page_id"]: r for r in url_filter.verdicts(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = host_balance(pages)
    assert len(got) == len(pages)
    seen = set()
    for i, url, _ in pages:
        if got[i]["rule"] is None:
            host = host_path(url)[0]
            if abs(want.get(host, 0) - url_filter.THRESHOLD) > 0.002:
                assert got[i]["verdict"] == ("block" if want.get(host, 0) > url_filter.THRESHOLD else "allow")
                seen.add(got[i]["verdict"])
    assert seen == {"allow", "block"}


def test_private_use_characters_are_no_separators(spark):
    texts = ["+49\ue00012345678", "41111111\ue00011111111", "41111111\ue00111111111", "a@b\ue000c.de x\ue000@y.zz", "\ue000 4111 1111 1111 1111 \ue000", "+49 30\ue001123456"]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    for r in personal_data.digest(spark, frame).collect():
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def test_near_texts_are_alike_at_every_length(spark):
    """Across 64 code points, and in words without white space at edit distance 1."""
    words = "the cat sat on a mat by the old red door of my tiny house and ate"
    rng = random.Random(4)
    run = "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(400))
    frame = spark.createDataFrame([(1, words[:63], words[:64]), (2, run, run[:5] + "x" + run[5:]), (3, words[:20], words[40:60])], "doc_id long, a string, b string")
    frame = order_minhash.codes(order_minhash.codes(frame, "a", "ca"), "b", "cb")
    got = {r[0]: r[1] for r in frame.select("doc_id", order_minhash.likeness(frame["ca"], frame["cb"])).collect()}
    assert got[1] > 0.5 and got[2] > 0.5 and got[3] < 0.2
