"""Media, BPE, PII and URL operators against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomdex.llm import bpe, media, pii, urls

ROWS = [
    (1, "plain words only"),
    (2, None),
    (3, ""),
    (4, "x" * 576),
    (5, "y" * 575 + "é"),
    (6, "Mail me: a.b+c@example.com or a@b.c%d@e.f, ip 10.0.0.255 10.0.0.256 1.2.3.4.5.6.7.8 001.2.3.4"),
    (7, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, phone +1 (555) 010-9999, +12 3, iban GB82 WEST 1234 5698 7654 32 x"),
    (8, "ssn 123-45-6789 then 🙂 é 000-12-3456 and +44.20.7946.0958 <|endoftext|> tail"),
    (9, "same text twice " * 900),
    (9, "same text twice " * 900),
    (None, "no id a@b.co"),
    (10, "z" * 30000 + "@" + "1" * 30000 + " " * 3000),
    (11, "中文 句子　x 한국어 𠀀 \u001f\u0085 ʼn"),
]


def test_media_round_trip(spark, docs_of):
    got = media.digest(docs_of(ROWS)).collect()
    assert len(got) == len(ROWS)
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=key) == sorted(want, key=key)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 9}) == 1
    files = media.with_media(docs_of(ROWS))
    rows = media.clips(files).filter("doc_id = 9").orderBy("clip").collect()
    assert rows[0].first_frame == 0 and rows[-1].last_frame == 24 and rows[-1].end_s == 1.0
    assert media.digest(docs_of([])).count() == 0


def test_media_shots_and_limits():
    import numpy as np

    dark, light = np.full((20, 576), 10, np.uint8), np.full((20, 576), 200, np.uint8)
    assert media.shots(np.concatenate([dark, light])).tolist() == [0, 20]
    noise = np.random.default_rng(0).integers(0, 256, (5, 576), dtype=np.uint8)
    assert (media.decode_rows(media.encode_rows(noise.ravel(), np.array([0, noise.size])))[0] == noise).all()
    with pytest.raises(ValueError):
        media.index_of(b"RIFFxxxxWAVE")


def _tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_bpe_equals_library(spark, docs_of):
    from tokenizers import Tokenizer

    path = _tokenizer_path()
    ref = Tokenizer.from_file(path)
    rnd = random.Random(5)
    bits = [" ", "  ", "\n", "a", "word", " the", "'s", "'ll", "1", "23", "é", "ß", "—", "中", "<|endoftext|>", "!?", "\t", " Of", "x y z ", "\u00a0"]
    shared = "".join(rnd.choice(bits) for _ in range(3000))
    rows = ROWS + [(100 + k, "".join(rnd.choice(bits) for _ in range(rnd.randrange(3000))) + shared) for k in range(20)]
    got = {(r.doc_id, r.decoded): list(r.ids) for r in bpe.encode(docs_of(rows), path).collect()}
    for i, t in rows:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        assert got[(i, ref.decode(ids, skip_special_tokens=False))] == ids
    digest = {r.doc_id: r for r in bpe.digest(docs_of(rows), path).collect()}
    ids = ref.encode(rows[-1][1], add_special_tokens=False).ids
    assert digest[rows[-1][0]].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert digest[2].n_tokens == 0
    assert bpe.digest(docs_of([]), path).count() == 0


def test_bpe_reuses_shared_chunks():
    import numpy as np

    enc = bpe.Encoder(_tokenizer_path())
    rnd = random.Random(1)
    passage = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(6000))
    for head in ("first ", "another start "):
        text = (head + passage).encode()
        assert enc.encode(text, np.frombuffer(text, np.uint8)) == enc.library.encode(head + passage).ids
    assert enc.hits > 5


def _luhn(digits):
    total = sum(d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for k, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def brute_spans(text):
    """Base spans by the plain expressions."""
    out = []
    for k, (kind, pattern) in enumerate(pii.PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_base_spans(spark, docs_of):
    rnd = random.Random(2)
    bits = ["a", "@", ".", "b", "%", "+", "-", " ", "1", "2", "40", "255", "256", "(", ")", "4111111111111111", "é", "🙂", "x@y.zz", "1.2.3.4", "+442079460958", "\n", "_"]
    rows = [(k, t) for k, (_, t) in enumerate(ROWS)] + [(100 + k, "".join(rnd.choice(bits) for _ in range(rnd.randrange(120)))) for k in range(300)]
    got = {r.doc_id: r for r in pii.digest(docs_of(rows)).collect()}
    for i, t in rows:
        spans = brute_spans(t or "")
        text = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (t, text, got[i].spans)
        assert got[i].n_email == sum(x[3] == "email" for x in spans)
        kept = [x for x in got[i].spans.split(",") if x.split(":")[0] in pii.PLAIN]
        assert ",".join(kept) == text
    assert "iban:" in got[6].spans and "ssn:4:15" in got[7].spans and "ssn:" in got[7].spans
    assert pii.digest(docs_of([])).count() == 0


def test_pii_redaction_keeps_columns(spark, docs_of):
    docs = docs_of(ROWS)
    out = pii.redact(docs, length_col="n_chars")
    assert out.columns == docs.columns and out.count() == len(ROWS)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] == "plain words only" and text[2] is None and text[3] == ""
    assert text[6].startswith("Mail me: <EMAIL> or <EMAIL><EMAIL>, ip <IP> 10.0.0.256 <IP>.<IP>")
    assert "<CARD>" in text[7] and "4111-1111-1111-1112" in text[7] and "<IBAN>" in text[7]
    assert not any(brute_spans(t or "") for t in text.values())


def test_pii_runs_in_the_jvm(spark, docs_of):
    plan = pii.digest(docs_of(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_url_rules_against_brute_force(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/1?x=1"), (2, "https://a.example.com/en/2#t"), (3, "http://b.net/es/3"), (4, "http://b.net/fr"), (5, None), (6, "no scheme"), (7, "x://com/"), (8, "x://com"), (9, "http://notexample.com/en/"), (3, "http://b.net/es/3"), (None, "http://q.org/a")]
    rows += [(100 + k, f"http://{'bad' if k % 3 == 0 else 'ok'}{k % 7}.site.org/{'ads' if k % 3 == 0 else 'doc'}/{k}.html") for k in range(90)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([(100 + k, k % 3 == 0 or k == 1) for k in range(0, 60)] + [(1, None)], "doc_id long, blocked boolean")
    got = urls.judge(pages, labels).collect()
    assert len(got) == len(rows)

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        return "".join(c.lower() if c.isascii() else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]

    by = {(r.page_id, r.host, r.path): r for r in got}
    for i, u in rows:
        host, path = split(u)
        r = by[(i, host, path)]
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r.rule == (max(fits)[1] if fits else None)
        if fits:
            assert r.verdict == max(fits)[2]
        elif i and i >= 100:
            assert r.verdict == ("block" if (i - 100) % 3 == 0 else "allow"), (u, r)
    assert {r.verdict for r in got if r.page_id in (5, 6)} == {"allow"}
    assert urls.judge(pages.limit(0), labels).count() == 0
    assert urls.judge(pages, labels.limit(0)).count() == len(rows)


def test_mined_rules_match_as_brute_force(spark):
    rnd = random.Random(4)
    data = [([f"k{j}={rnd.randrange(3)}" for j in range(4)], rnd.random() < 0.4) for _ in range(400)]
    bags = spark.createDataFrame([(sorted(i), b) for i, b in data], "items array<string>, blocked boolean")
    rules = urls.mine(bags, 0.01, 0.5)
    found = {tuple(r.items): r.confidence for r in urls.matched(bags, rules).collect()}
    import itertools

    best = {}
    for items in {tuple(sorted(i)) for i, _ in data}:
        for n in range(1, 5):
            for sub in itertools.combinations(items, n):
                cover = [b for i, b in data if set(sub) <= set(i)]
                if sum(cover) >= 0.01 * len(data) and sum(cover) >= 0.5 * len(cover):
                    best[items] = max(best.get(items, 0), sum(cover) / len(cover))
    assert found.keys() == best.keys() and all(abs(found[k] - best[k]) < 1e-12 for k in best)
    assert rules.filter(F.size("antecedent") == 0).isEmpty()


def test_pii_iban_before_capitals_and_numbers(spark, docs_of):
    iban = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"]
    tails = [" Please pay", " The rest", " BIC COBADEFF", " 2024", " x", "", ".", " GB82WEST12345698765432"]
    rows = [(k, f"IBAN {i}{t}") for k, (i, t) in enumerate((i, t) for i in iban for t in tails)]
    rows += [(900, "DE89370400440532013000X"), (901, "DE88370400440532013000 Please"), (902, "A" * 20000 + " " + "DE89 " * 4000)]
    got = {r.doc_id: r.spans for r in pii.digest(docs_of(rows)).collect()}
    for k, (i, t) in enumerate((i, t) for i in iban for t in tails):
        assert f"iban:5:{5 + len(i)}" in got[k].split(","), (i, t, got[k])
        assert got[k].count("iban:") == 1 + ("WEST12" in t)
    assert not any("iban:" in got[k] for k in (900, 901, 902))
    clear = {r.doc_id: r.text for r in pii.redact(docs_of(rows)).collect()}
    assert clear[0] == "IBAN <IBAN> Please pay" and clear[15] == clear[7] == "IBAN <IBAN> <IBAN>"


def test_pii_context_on_both_sides_and_along_lists(spark, docs_of):
    numbers = [f"{200 + k}-45-{6000 + k}" for k in range(9)]
    rows = [
        (1, "SSNs: " + ", ".join(numbers)),
        (2, f"{numbers[0]} is my social security number"),
        (3, ", ".join(numbers) + " are social security numbers"),
        (4, f"ssn {numbers[0]} and far from it, " + "w " * 40 + numbers[1] + " part"),
        (5, f"part {numbers[0]}, {numbers[1]}"),
    ]
    got = {r.doc_id: r.spans.count("ssn:") for r in pii.digest(docs_of(rows)).collect()}
    assert got == {1: 9, 2: 1, 3: 9, 4: 1, 5: 0}
    clear = {r.doc_id: r.text for r in pii.redact(docs_of(rows)).collect()}
    assert clear[1] == "SSNs: " + ", ".join(["<SSN>"] * 9) and clear[2] == "<SSN> is my social security number"
    assert {k: t.count("<SSN>") for k, t in clear.items()} == got


def test_url_rules_need_more_than_luck(spark):
    rnd = random.Random(11)
    urls_of = lambda n: [f"http://{rnd.choice(['www', 'm', 'blog'])}.{rnd.choice('abcdefgh')}site.org/{rnd.choice(['en', 'fr', 'de'])}/{rnd.randrange(9999)}?page={rnd.randrange(3)}" for _ in range(n)]
    rows = list(enumerate(urls_of(900)))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    luck = spark.createDataFrame([(i, rnd.random() < 0.15) for i, _ in rows], "doc_id long, blocked boolean")
    assert urls.judge(pages, luck).filter("mined is not null").count() == 0
    planted = [(i, u.replace("/en/", "/en/a/casino-bonus/b/") if i % 9 == 0 else u + "&ref=x&sid=7" if i % 9 == 1 else u) for i, u in rows]
    bad = lambda u: "casino" in u or "sid=" in u
    pages = spark.createDataFrame([*planted, (5000, "http://h/" + "x/" * 20000), (5001, "http://" + "a." * 5000 + "org/?" + "&" * 50)], "page_id long, url string")
    got = urls.judge(pages, spark.createDataFrame([(i, bad(u)) for i, u in planted], "doc_id long, blocked boolean")).collect()
    test = [(r.mined is not None, bad(dict(planted)[r.page_id])) for r in got if r.held_out and r.page_id < 5000]
    assert len(test) > 100 and all(a == b for a, b in test)
    assert [r.verdict for r in got if r.page_id >= 5000] == ["allow", "allow"]


def test_url_rules_beyond_a_broadcast(spark, monkeypatch):
    bags = spark.createDataFrame([([f"a={k % 3}", f"b={k % 5}"], k % 3 == 0) for k in range(60)], "items array<string>, blocked boolean")
    few = sorted(map(tuple, urls.matched(bags, urls.mine(bags)).collect()), key=str)
    monkeypatch.setattr(urls, "BROADCAST", 0)
    assert few and sorted(map(tuple, urls.matched(bags, urls.mine(bags)).collect()), key=str) == few
