"""Keys joined to a name or a separator are found like keys that stand alone."""

import random

from pyspark.sql import functions as F

from seekframe.llm import secrets


def test_glued_keys(spark):
    r = random.Random(5)
    keys = ["".join(r.choice("0123456789ABCDEF") for _ in range(32)) for _ in range(60)]
    keys += ["".join(r.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(24)) for _ in range(60)]
    forms = ["{}", "SIGNING_KEY={}", "key-{}", "my_key_{}_old", "a/{}-b", "example_key={}", "{}=x"]
    rows = [(n * len(forms) + m, f"see {form.format(k)} here") for n, k in enumerate(keys) for m, form in enumerate(forms)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hit = {x["doc_id"] for x in secrets.scan(df).where(F.exists("found", lambda s: s["rank"] == 3)).select("doc_id").collect()}
    out = {x["doc_id"]: x["text"] for x in secrets.redact(df).collect()}
    alone = [n for n in range(len(keys)) if n * len(forms) in hit]
    assert len(alone) > 110
    for n in alone:
        for m in range(len(forms)):
            assert n * len(forms) + m in hit, rows[n * len(forms) + m]
            assert "[SECRET]" in out[n * len(forms) + m]


def test_allowed_parts(spark):
    texts = [
        "550e8400-e29b-41d4-a716-446655440000", "src/internationalization2024/plain_words/abcdefghijklmnopqrst12/x", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
        "dir=src/abcdefghijklmnopqrstuv12/x", "example_key=aB3/xY9+Qw7Zr5Tt8Kk2Lm4Nn6", "key=aB3/xY9+Qw7Zr5Tt8Kk2Lm4Nn6",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: [tuple(s) for s in x["found"] if s["rank"] == 3] for x in secrets.scan(df).collect()}
    assert found[0] == found[1] == found[2] == []
    assert not any(s <= 12 and e >= 30 for s, _, e in found[3] if s >= 4)
    assert found[4] == [(12, 3, 38)] and len(found[5]) == 1
