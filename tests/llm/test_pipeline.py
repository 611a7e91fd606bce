"""The pipeline on a small corpus whose cases are planted, against plain Python."""

import random
import re

import pytest

from loomdex.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    rnd = random.Random(8)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghi") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    passage = prose(60)
    rows, toxic = [], set()
    for k in range(400):
        text = prose(rnd.randrange(40, 90))
        if k % 5 == 1:
            words = text.split()
            for _ in range(6):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zounds", "vilest", "knaves", "wretch"]))
            text = " ".join(words)
            toxic.add(k)
        elif k % 20 == 2:
            text = text + " " + passage + " " + prose(20)
        elif k % 20 == 3:
            text += " mail a.b@example.org"
        rows.append((k, text, "en", "s", len(text)))
    rows += [(1000 + k, rows[4][1] + (" extra" if k else ""), "en", "s", 1) for k in range(3)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out, docs = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, d)
        path = f"{d}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs
    return rows, toxic, passage, out, d


def test_stages_take_effect(stages):
    rows, toxic, passage, out, _ = stages
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    text = {i: t for i, t, *_ in rows}
    assert all(out[s].columns == columns for s in ("toxicity", "minhash", "suffix", "pii"))
    clean = {r.doc_id for r in out["toxicity"].collect()}
    assert clean == set(text) - toxic
    kept = {r.doc_id for r in out["minhash"].collect()}
    assert kept == clean - {1000, 1001, 1002}
    cut = {r.doc_id: r for r in out["suffix"].collect()}
    assert cut.keys() == kept
    for i in kept:
        if i < 400 and i % 20 == 2:
            assert passage[5:-5] not in cut[i].text and len(cut[i].text) > 40
        else:
            assert cut[i].text == text[i]
        assert cut[i].n_chars == (None if cut[i].text is None else len(cut[i].text))
    private = {r.doc_id: r.text for r in out["pii"].collect()}
    for i in kept:
        assert private[i] == (cut[i].text and cut[i].text.replace("a.b@example.org", "<EMAIL>"))


def test_packing_holds_every_token_once(stages):
    *_, out, _ = stages
    length = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out["pii"].collect()}
    bins = out["packing"].collect()
    seen = {}
    for b in bins:
        assert b.used == sum(b.lengths) <= b.capacity and b.capacity in packing.CAPACITIES
        assert b.capacity == min(c for c in packing.CAPACITIES if c >= b.used)
        for d, s, n in zip(b.doc_ids, b.starts, b.lengths):
            seen.setdefault(d, []).append((s, n - 1))
    assert {d: sum(n for _, n in p) for d, p in seen.items()} == length
    assert len({b.bin_id for b in bins}) == len(bins)


def test_run_equals_the_stages(spark, stages):
    import corpus_pipeline

    *_, out, d = stages
    key = lambda df: sorted((r.used, tuple(r.doc_ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, d)) == key(out["packing"])
