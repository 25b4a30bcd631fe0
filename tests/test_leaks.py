"""Near copies across splits against every pair."""

import math
import random

from tracklore.operators import leaks as K

SCHEMA = "clip_id long, split string, source string, signer int, start double, end double, path array<double>"


def brute(clips, limit):
    def standard(p):
        p = [float(x) for x in p]
        at = [i * (len(p) - 1) / 63 for i in range(64)]
        p = [p[int(w)] + (w - int(w)) * (p[min(int(w) + 1, len(p) - 1)] - p[int(w)]) for w in at]
        m = math.fsum(p) / 64
        s = math.sqrt(math.fsum((x - m) ** 2 for x in p) / 64)
        return [(x - m) / s if s > 1e-12 else 0.0 for x in p]

    ok = [(c, standard(c[6])) for c in clips if None not in c and c[6] and not any(x is None or math.isnan(x) for x in c[6]) and c[4] < c[5]]
    out = set()
    for a, pa in ok:
        for b, pb in ok:
            if a[1] < b[1] and a[2:4] == b[2:4] and a[4] < b[5] and b[4] < a[5]:
                if math.sqrt(sum((x - y) ** 2 for x, y in zip(pa, pb)) / 64) <= limit:
                    out.add((a[0], b[0]))
    return out


def test_trajectory_leaks_equal_all_pairs_for_any_bucket(spark):
    rnd = random.Random(3)
    shapes = [[rnd.gauss(0, 1) for _ in range(40)] for _ in range(6)]
    clips = []
    for i in range(150):
        shape = rnd.choice(shapes)
        noise = rnd.choice([0.02, 0.3, 0.6])
        scale, shift = rnd.uniform(0.5, 3), rnd.uniform(-9, 9)
        start = float(rnd.randrange(-40, 100))
        clips.append((i, rnd.choice(["train", "val", "test"]), rnd.choice("ab"), rnd.randrange(2), start, start + rnd.choice([1, 20, 90]),
                      [x * scale + shift + rnd.gauss(0, noise) for x in shape]))
    clips += [(200, "val", None, 1, 0.0, 9.0, [1.0]), (201, "val", "a", 1, 5.0, 5.0, [1.0, 2.0]), (202, "test", "a", 1, 0.0, 9.0, []),
              (203, "test", "a", 1, 0.0, 9.0, None), (204, "test", "a", 1, 0.0, 9.0, [1.0, None]), (205, "test", "a", 1, 0.0, 9.0, [math.nan])]
    want = brute(clips, 0.5)
    assert len(want) > 30
    for bucket in (7.0, 300.0):
        got = [(r.clip, r.other) for r in K.trajectory_leaks(spark.createDataFrame(clips, SCHEMA), 0.5, bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_copies_are_counted_and_never_paired(spark):
    path = [float(x * x % 7) for x in range(30)]
    clips = [(i, "train", "s", 1, 0.0, 10.0, path) for i in range(400)] + [(1000 + i, "val", "s", 1, 4.0, 12.0, path) for i in range(300)]
    rows = K.trajectory_leaks(spark.createDataFrame(clips, SCHEMA), 0.1, 10.0).collect()
    assert [(r.clip, r.other, r.split, r.overlap, r.copies, r.other_copies) for r in rows] == [(0, 1000, "train", 6.0, 400, 300)]
    assert K.trajectory_leaks(spark.createDataFrame([], SCHEMA), 0.1, 10.0).count() == 0


def test_pairs_are_found_across_packs(spark, monkeypatch):
    rnd = random.Random(8)
    clips = [(i, rnd.choice(["train", "val", "test"]), "a", 0, float(rnd.randrange(4)), 9.0, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    monkeypatch.setattr(K, "PACK", (3, 7))
    got = [(r.clip, r.other) for r in K.trajectory_leaks(spark.createDataFrame(clips, SCHEMA), 0.9, 20.0).collect()]
    want = brute(clips, 0.9)
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
