import base64
import hashlib
import io
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.llm import decontamination, discriminant, license_scan, pseudonyms, quality_rules, warc

from .conftest import PASSAGE, table

WORD, BENCH = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = Counter(line for line in text.split("\n") if WORD.search(line))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), len(hit)


def test_quality_rules_match_brute_force(spark, docs, rows, none):
    got = table(quality_rules.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = [(d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]) for d, t in rows for m in [measured(t)]]
    assert got == sorted(want, key=repr)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality(docs).collect()}
    assert kept[10] and kept[15] and not any(kept[d] for d in (1, 2, 3, 4, 19, 20, 21))
    assert quality_rules.quality(none).collect() == []


def test_ablation_counts_from_the_ledger(spark, docs):
    ledger = quality_rules.ledger(docs, "doc_id", "key")
    bits = [r["fail_bits"] for r in ledger.collect()]
    whole = quality_rules.mask(quality_rules.POLICIES["v2"])
    for r in quality_rules.ablation(ledger, "v2").collect():
        one = quality_rules.mask([r["rule"]])
        assert r["n_failed"] == sum(b & one != 0 for b in bits)
        assert r["n_only"] == sum(b & whole == one for b in bits)
        assert r["n_kept_without"] == sum(b & whole & ~one == 0 for b in bits)


def contaminated(rows, items, span=13):
    out = []
    for d, t in rows:
        words = BENCH.findall(low(t))
        hit, ids = set(), set()
        for item, text in items:
            own = BENCH.findall(low(text))
            n = min(span, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p] == own[i] and words[p:p + n] == own[i:i + n]:
                        hit.update(range(p, p + n))
                        if item is not None:
                            ids.add(str(item))
        out.append((d, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def test_decontamination_matches_brute_force(spark, docs, rows, none):
    some = [t for d, t in rows if d and d > 100]
    text = next(t for d, t in rows if d == 15)
    items = [(1, PASSAGE), (2, PASSAGE.upper()), (3, "shared0 text SHARED1"), (4, "one"), (5, None), (6, ""), (None, some[0]), (10, some[3]), (7, "straße über été the of and x9"),
             (8, " ".join(text.split()[150:163])), (9, " ".join(text.split()[200:240])), (9, "ab ab ab ab"), (11, "absent words " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    assert table(decontamination.decontaminate(docs, bench)) == contaminated(rows, items)
    assert decontamination.decontaminate(none, bench).collect() == []
    assert not any(r["contaminated"] for r in decontamination.decontaminate(docs, bench.limit(0)).collect())


def test_rows_of_one_doc_id_are_judged_by_their_own_text(spark):
    filler = [f"f{i}" for i in range(900)]
    long_ = " ".join([*filler[:500], PASSAGE, *filler[500:]])
    short, other = " ".join(filler[:40]), " ".join(filler[860:]) + " " + PASSAGE
    rows = [(d, t) for d in (7, None) for t in (long_, short, other, "", None)] + [(7, long_), (8, short)]
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[30:60]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = table(decontamination.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")))
    assert got == contaminated(rows, items)


def test_seeds_outside_the_text_or_on_other_words_give_no_run():
    words, item = PASSAGE.split()[:20], PASSAGE.split()
    assert decontamination.extended(words, item, [(500, 3), (21, 2), (20, 20), (5, 7)], 13) == []
    assert decontamination.extended(words, item, [(500, 3), (4, 4)], 13) == [(0, 20)]


@pytest.mark.parametrize("span", range(1, 16))
def test_winnowing_guarantee(span):
    rng = np.random.default_rng(span)
    h = rng.integers(0, 6, 300).astype(np.uint64)
    place, _ = decontamination.winnow(h, np.array([0, 300]), span)
    k = span // 2 + 2 if span > 3 else span
    for a in range(300 - span + 1):
        assert ((place >= a) & (place + k <= a + span)).any()


def pages(rows):
    return [(10 * i + 1, f"http://x/{i} y", t) for i, (d, t) in enumerate(rows)] + [(None, None, "nameless"), (5, "u", rows[5][1]), (5, "u", rows[5][1]), (None, "u", rows[6][1])]


def test_archives_match_brute_force(spark, rows, tmp_path):
    data = pages(rows)
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(5)
    first = {}
    for p, _, t in data:
        if p is not None:
            first[t or ""] = min(p, first.get(t or "", p))
    copies = Counter(t or "" for *_, t in data)
    want = []
    for p, _, t in data:
        raw = (t or "").encode()
        base = first.get(t or "") if copies[t or ""] > 1 else None
        revisit = base is not None and base != p
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", base if revisit else None))
    assert table(warc.archives(spark, df)) == sorted(want, key=repr)
    files = warc.write(df, str(tmp_path / "w"), file_bytes=20_000)
    for size in (1, 700, 100_000) if files.count() > 2 else ():
        got = warc.read(files, size) if size > 1 else warc.read(files.limit(1), 37)
        digest = sorted((r["page_id"], r["payload_bytes"]) for r in got.where("page_id is not null").collect())
        assert digest == sorted((w[0], w[1]) for w in want if w[0] is not None) if size > 1 else digest
    assert warc.archives(spark, df.limit(0)).collect() == []


def test_false_magic_is_no_member():
    inner = warc.record(1, "u", warc.MAGIC * 50, None, "d")
    blob = warc.MAGIC + b"junk" + inner + warc.MAGIC[:2] + warc.record(2, "u", b"", 1, "d")
    for step in (1, 13, len(blob)):
        got = [raw for a in range(0, len(blob), step) for raw in warc.records(io.BytesIO(blob), a, min(a + step, len(blob)), len(blob))]
        assert [warc.parse(r)["warc-record-id"] for r in got] == ["<urn:page:1>", "<urn:page:2>"]


def test_license_scan_matches_brute_force(spark, docs, rows, none):
    want = []
    for d, t in rows:
        words = BENCH.findall(low(t))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            own = phrase.split()
            at = [i for i in range(len(words)) if words[i:i + len(own)] == own]
            places += at
            labels |= {label} if at else set()
        want.append((d, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = license_scan.scan(docs)
    assert table(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(want, key=repr)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())
    assert license_scan.scan(none).collect() == []


def test_notices_tolerate_an_inserted_word(spark):
    text = "x y redistribution and use in source and also binary forms with or without modification are permitted provided that the conditions are met z"
    got = license_scan.scan(spark.createDataFrame([(1, text), (2, "use in source and binary")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["bsd", ""] and got[0]["n_base"] == 0 and got[0]["score"] > 0.8


VALUES = ["a.b@ex1.org", "4111 1111 1111 1111", "10.20.30.40", "2024-02-29", "31/12/1999", "12/31/1999", "+1 (374) 555-3953", "123-45-6789", "DE89 3704 0044 0532 0130 00",
          'token = "61fedef2798093a39309a7b84b6ac5168d2ba910"', "password=a59e367ba78ab7f8eb", "+44 20 7946 0958"]


@pytest.mark.parametrize("value", VALUES)
def test_pseudonyms_keep_format_and_invert(value):
    new, counts = pseudonyms.masked(f"see {value} now", b"k" * 32)
    assert sum(counts.values()) == 1 and value not in new and len(new) == len(f"see {value} now") or "." in value
    again, second = pseudonyms.masked(new, b"k" * 32, back=True)
    assert second == counts and again == f"see {value} now"
    assert pseudonyms.masked(f"{value}, and", b"k" * 32)[0][:-5] == new[4:-4]


@pytest.mark.parametrize("value", ["+1 (017) 555-7713", "(132) 555-1352", "374-155-3953", "+44 20 7946 0958 1234", "+500 12345", "233.254.104.120", "0.0.0.0", "255.255.255.255", "192.168.001.010"])
def test_phones_and_addresses_outside_the_usual_ranges(value):
    new, counts = pseudonyms.masked(f"see {value} now", b"k" * 32)
    assert sum(counts.values()) == 1 and value not in new
    assert pseudonyms.masked(new, b"k" * 32, back=True) == (f"see {value} now", counts)
    assert pseudonyms.masked("see 256.1.2.3 now", b"k" * 32) == ("see 256.1.2.3 now", {})


def test_classes_of_addresses_and_phones_stay_apart():
    new = lambda v: pseudonyms.masked(v, b"k" * 32)[0]
    for i in range(200):
        a, b = f"{224 + i % 32}.{i}.7.9", f"{1 + i}.{i}.7.9"
        assert not 0 < int(new(a).split(".")[0]) < 224 and 0 < int(new(b).split(".")[0]) < 224
    assert re.sub(r"\D", "", new("+1 (017) 555-7713"))[1:] == re.sub(r"\D", "", new("017-555-7713"))
    assert [int(p) for p in new("192.168.001.010").split(".")] == [int(p) for p in new("192.168.1.10").split(".")]


@pytest.mark.parametrize("before, value, behind", [
    ("pay ", "4111 1111 1111 1111", " 12/26"), ("pay ", "4111 1111 1111 1111", " 123"), ("pay ", "4111-1111-1111-1111", "-12"), ("12 ", "4111 1111 1111 1111", ""), ("no. 77 12 ", "4111111111111111", " 9 9"),
    ("to ", "DE89 3704 0044 0532 0130 00", " EUR 50"), ("to ", "DE89370400440532013000", " BIC COBADEFF"), ("QQ12 ", "DE89 3704 0044 0532 0130 00", " X"), ("NO99 ", "NO93 8601 1117 947", " NOK 7"),
])
def test_cards_and_ibans_inside_longer_runs(before, value, behind):
    alone, one = pseudonyms.masked(value, b"k" * 32)
    new, counts = pseudonyms.masked(before + value + behind, b"k" * 32)
    assert alone != value and counts == one and new == before + alone + behind


def test_runs_without_a_value_stay():
    for text in ("4111111111111112 x", "4111 1111 1111 1112 12", "DE88 3704 0044 0532 0130 00 EUR", "0000 0000 0000 0000 000", "1 2 3 4"):
        assert pseudonyms.masked(text, b"k" * 32) == (text, {})


def test_feistel_is_a_permutation():
    for size in (2, 10, 97, 1000):
        got = [pseudonyms.permuted(b"k", "t", v, size) for v in range(size)]
        assert sorted(got) == list(range(size))
        assert [pseudonyms.permuted(b"k", "t", v, size, back=True) for v in got] == list(range(size))


@pytest.mark.parametrize("n", [38, 40, 46, 300, 9000])
def test_long_names_and_hosts(n):
    rng = np.random.default_rng(n)
    name, host = ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for _ in range(2))
    value = f"{name}@{host}.example.org"
    new, counts = pseudonyms.masked(f"see {value} now", b"k" * 32)
    assert counts == {"email": 1} and pseudonyms.masked(new, b"k" * 32, back=True) == (f"see {value} now", counts)
    for a, b in zip((name, host), re.match("see ([a-z]*)@([a-z]*)", new).groups(), strict=True):
        for part in (slice(0, n // 2), slice(n // 2, n)):  # no part of a name stays
            assert sum(x == y for x, y in zip(a[part], b[part], strict=True)) < n // 6 + 4


@pytest.mark.parametrize("n", [12, 13, 65, 128])
def test_long_credentials_change_everywhere(n):
    value = ("0123456789abcdef" * 8)[:n]
    new, counts = pseudonyms.masked(f"token={value}", b"k" * 32)
    assert counts == {"secret": 1} and pseudonyms.masked(new, b"k" * 32, back=True)[0] == f"token={value}"
    for part in (slice(6, 6 + n // 4), slice(6 + n // 4, 6 + n // 2), slice(6 + n // 2, 6 + 3 * n // 4), slice(6 + 3 * n // 4, 6 + n)):
        assert sum(x == y for x, y in zip(new[part], f"token={value}"[part], strict=True)) < n // 8 + 3


def test_pseudonyms_leave_the_rest_alone(spark, docs, rows, none):
    got = {(r["doc_id"], r["text"]): r for r in pseudonyms.report(docs, "k").collect()}
    for d, t in rows:
        if d != 18:
            assert got[d, t]["n_found"] == 0
    (text,) = [r["text"] for r in got.values() if r["doc_id"] == 18]
    card = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", text)
    assert len(card) == 2 and re.sub(r"\D", "", card[0]) == re.sub(r"\D", "", card[1]) != "4111111111111111"
    assert "4111111111111112" in text and "29/02/2023" in text and "2024-02-29" not in text
    assert pseudonyms.report(none, "k").collect() == []


def test_discriminant_learns_held_out_labels(spark, sf, docs, none):
    documents, labels = (spark.read.parquet(f"{sf[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    got = discriminant.scored(documents, labels)
    assert got.count() == documents.count() and got.where("score < 0 or score > 1 or isnan(score)").count() == 0
    rows = got.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.9
    few = discriminant.scored(docs, labels.limit(0))
    assert few.count() == docs.count() and {r["score"] for r in few.collect()} == {0.5}
    assert discriminant.scored(none, labels).collect() == []


def test_discriminant_matches_a_plain_fit(spark):
    rng = np.random.default_rng(4)
    c = (rng.random(300) < 0.3).astype(int)
    x = rng.normal(size=(300, 4)) * [1, 3, 0.2, 5] + np.outer(c, [1, 0, 0.3, -2])
    x[:, 3] += x[:, 1] * (1 + c)
    df = spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(c, x)], "c int, s0 double, s1 double, s2 double, s3 double").repartition(5)
    model = discriminant.fit(df)
    z = (x - x.mean(0)) / x.std(0)
    density = []
    for k in (0, 1):
        y = z[c == k]
        n, p, s = len(y), 4, np.cov(y.T, bias=True)
        t2, t = np.trace(s @ s), np.trace(s)
        rho = min(1, ((1 - 2 / p) * t2 + t * t) / ((n + 1 - 2 / p) * (t2 - t * t / p)))
        s = (1 - rho) * s + rho * t / p * np.eye(p) + 1e-4 * np.eye(p)
        d = z - y.mean(0)
        density.append(-0.5 * ((d @ np.linalg.inv(s)) * d).sum(1) - 0.5 * np.linalg.slogdet(s)[1])
    want = density[1] - density[0]
    assert np.allclose(model.difference(x), want, atol=1e-6)
    order = np.argsort(want)
    score = model.score(x)
    assert (np.diff(score[order]) >= -1e-12).all() and abs(score.mean() - c.mean()) < 0.05


def test_license_rows_without_a_doc_id_are_scanned_apart(spark):
    rows = [(None, f"text {i} under the MIT License" if i % 2 else f"text {i} of nothing") for i in range(40)] + [(None, None)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_base"], r["base_labels"], r["first_word"]) for r in got if r["n_base"]) == [(1, "mit", 4)] * 20 and len(got) == 41
