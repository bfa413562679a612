"""The registered query of document fingerprints against plain Python, on the table and on awkward rows."""

import hashlib
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from voltlake.llm import fingerprints, queries

DIR = Path("/root/testdata/sf0.01")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def held(rows, out):
    """out, row by row, against rows (id, text) in the order of ids; the errors of both likenesses."""
    texts = [t or "" for _, t in rows]
    want, errors = [], []
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, after))
    got = sorted(out, key=lambda r: (r["doc_id"], r["edited_sha256"]))
    want.sort(key=lambda w: (w[0], w[2]))
    prints = {}
    for r, (i, n, sha, text, edited, after) in zip(got, want):
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, n, sha)
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"] and prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        errors.append((abs(r["near_edited"] - likeness(text, edited)), abs(r["near_next"] - likeness(text, after)), len(shingles(text))))
    assert len(got) == len(want)
    return np.array(errors)


@pytest.mark.skipif(not DIR.exists(), reason="no test tables")
def test_registered_query(spark):
    docs = pd.read_parquet(DIR / "documents.parquet").sort_values("doc_id")
    errors = held([(int(r.doc_id), r.text) for r in docs.itertuples()], queries.QUERIES["op8_document_fingerprints"](spark, str(DIR)).collect())
    assert errors[:, 0].mean() < 0.03 and errors[:, 1].mean() < 0.001 and errors[errors[:, 2] >= 80, 0].max() < 0.15


def test_awkward_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "é"), (5, "one two"), (6, "a b c d e f g h"), (7, "a b c d e f g h"), (9, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, fingerprint string, id long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op8_document_fingerprints"](spark, str(tmp_path)).collect()
    held(rows, out)
    by = {r["doc_id"]: r for r in out}
    assert by[6]["near_next"] == 1.0 and by[1]["near_next"] == 1.0 and by[1]["fingerprint"] == "" and by[5]["near_next"] == 0.0
    df.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert queries.QUERIES["op8_document_fingerprints"](spark, f"{tmp_path}/empty").count() == 0
