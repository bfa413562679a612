"""Registered queries on the small tables against plain Python: packing, fingerprint groups, languages, quality rules."""

import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash

from voltlake.llm import language_id, packing, queries, simhash

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return [(int(r.doc_id), r.text, r.lang) for r in pd.read_parquet(DIR / "documents.parquet").itertuples()]


def test_packing(spark, docs):
    pytest.importorskip("tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, text, _ in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.piece_bounds(len(ids), 1024)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    out = queries.QUERIES["op1_best_fit_packing"](spark, str(DIR)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    filled = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024 and len(filled) <= -(-sum(filled.values()) // 1024) * 1.02 + 2


def test_fingerprint_groups(spark, docs):
    def slow(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fp, root = {i: slow(text) for i, text, _ in docs}, {i: i for i, _, _ in docs}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = queries.QUERIES["op6_simhash_near_dedup"](spark, str(DIR)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == {i: (f"{fp[i]:016x}", find(i)) for i in fp} and len(out) == len(docs)


def test_a_fingerprint_of_many_documents(spark):
    rows = [(i, "the same text in all of these documents, word by word") for i in range(500)] + [(None, "the same text in all of these documents, word by word"), (900, "another text that is not like the first one in any way")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for salt_rows in (1 << 16, 20):
        out = simhash.near_duplicates(df, salt_rows=salt_rows).collect()
        assert len(out) == len(rows) and {r["component_id"] for r in out} == {0, 900}


def test_languages(spark, docs):
    out = {r["doc_id"]: r for r in queries.QUERIES["op9_language_id"](spark, str(DIR)).collect()}
    assert len(out) == len(docs) and {i: r["held_out"] for i, r in out.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs}
    known = {lang for i, text, lang in docs if lang and text}
    for i, text, _ in docs:
        lettered = any(c.isalpha() for c in text or "")
        assert (out[i]["lang_pred"] in known) == lettered and (lettered or out[i]["lang_pred"] == "und") and 0 <= out[i]["score"] <= 1
    right = [out[i]["lang_pred"] == lang for i, text, lang in docs if lang and out[i]["held_out"] and out[i]["lang_pred"] != "und"]
    assert len(right) > 20 and np.mean(right) > 0.97


def test_leader_and_temperature():
    """The regularised leader against its definition, coordinate by coordinate; the temperature against a grid."""
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(50, 4, replace=False)), rng.random(4), int(rng.integers(0, 3))) for _ in range(40)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.5
    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= l1 else -(z[k] - np.sign(z[k]) * l1) / ((beta + n[k] ** 0.5) / alpha + l2)
    for i in np.random.default_rng(0).permutation(len(rows)):
        at, x, label = rows[i]
        w = np.array([[weight((a, c)) for c in range(3)] for a in at.tolist()])
        logits = x @ w
        p = np.exp(logits) / np.exp(logits).sum()
        for j, a in enumerate(at.tolist()):
            for c in range(3):
                g = x[j] * (p[c] - (c == label))
                before = n.get((a, c), 0.0)
                n[a, c] = before + g * g
                z[a, c] = z.get((a, c), 0.0) + g - (n[a, c] ** 0.5 - before**0.5) / alpha * w[j, c]
    got = language_id.ftrl(rows, 3, epochs=1, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=0)
    assert all(got[a, c] == pytest.approx(weight((a, c))) for a, c in z) and (got == 0).sum() > 0
    logits = rng.normal(size=(300, 3)) * 4
    labels = np.array([rng.choice(3, p=np.exp(x / 2.5) / np.exp(x / 2.5).sum()) for x in logits])
    assert language_id.fit_temperature(logits, labels) == pytest.approx(2.5, rel=0.35)


def test_languages_of_awkward_rows(spark):
    rows = [(i, "der die das und nicht" if i % 2 else "the and of with that", "de" if i % 2 else "en", "x") for i in range(80)] + [(200, None, "de", None), (201, "", None, None), (202, "12 %", "en", "q"), (203, "und die " * 50_000, None, None), (None, "the of", "en", "z"), (3, "der die das und nicht", "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language_id.fit(df.where(~language_id.held_out()))
    out = language_id.identify(df, model).collect()
    assert len(out) == len(rows) and Counter(r["lang_pred"] for r in out) == {"de": 42, "en": 41, "und": 3}
    assert language_id.identify(df.limit(0), model).count() == 0 and language_id.identify(df, language_id.fit(df.limit(0))).where("lang_pred <> 'und'").isEmpty()


def test_quality_rules(spark, docs):
    def slow(text):
        w = WORD.findall(text or "")
        grams, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if grams[tuple(w[i : i + 5])] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)

    out = {r["doc_id"]: r for r in queries.QUERIES["op10_quality_rules"](spark, str(DIR)).collect()}
    assert {i: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for i, r in out.items()} == {i: slow(text) for i, text, _ in docs}
    labels = pd.read_parquet(DIR / "labels.parquet").dropna(subset=["quality"])
    bad = [out[r.doc_id]["kept"] for r in labels.itertuples() if r.quality == 0 and r.doc_id in out]
    good = [out[r.doc_id]["kept"] for r in labels.itertuples() if r.quality == 1 and r.doc_id in out]
    assert not any(r["kept"] for r in out.values() if r["base_failed"]) and np.mean(bad) < 0.1 and np.mean(good) > 0.9
