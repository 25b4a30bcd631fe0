import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracklore.llm import substring_dedup as sd

from .conftest import table


def brute(rows, length):
    seen = Counter(raw[p:p + length] for _, t in rows for raw in [(t or "").encode()] for p in range(len(raw) - length + 1))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p:p + length]] > 1:
                gone[p:p + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(c for c, g in zip(raw, gone, strict=False) if not g)
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_removal_matches_brute_force(spark, docs, rows, none):
    assert table(sd.deduplicated(docs)) == brute(rows, 400)
    assert sd.deduplicated(none).collect() == []


@pytest.mark.parametrize("group", [1000, 3])
def test_short_lengths_and_split_groups(spark, group):
    rng = random.Random(group)
    core = "".join(rng.choice("abcd ") for _ in range(70))
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 40))) + core[rng.randint(0, 20):rng.randint(40, 70)] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, "abc" * 100), (201, "a" * 200), (201, core), (202, "a" * 47 + "b" + "a" * 47)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert table(sd.deduplicated(df, 48, widths=(8, 2, 1), group=group)) == brute(rows, 48)


def test_kept_bytes_and_a_table(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = sd.deduplicated(documents, with_text=True)
    assert table(got.drop("kept")) == brute(rows, 400)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.collect())


@pytest.mark.parametrize("seed", range(6))
def test_classes_match_equal_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(1, 2 + seed, 300), 0).astype(np.uint16)
    text[100:160] = text[20:80]
    order, kind = sd.classes(text, 12)
    padded = np.concatenate([text, np.full(12, 999, np.uint16)])
    heads = [tuple(padded[p:p + 12].tolist()) for p in order.tolist()]
    whole = [999 not in h for h in heads]
    for i in range(1, len(heads)):
        if whole[i] and whole[i - 1]:
            assert (heads[i] == heads[i - 1]) == (kind[i] == kind[i - 1])
