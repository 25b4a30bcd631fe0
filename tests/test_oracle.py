"""Registered queries against DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import TABLES, rows_of  # noqa: E402

SAMPLE = """a22_top_n_leaderboard a23_user_rank a24_weekly_xp a30_weakest_category_recommendation w34_streak w35_combo
w37_complete_lesson_xp w38_sm2_server w39_sm2_device a28_upcoming_reviews a59_likes_views a44_bleu a46_ece_mce
a47_sequence_uncertainty a49_conformal_threshold a50_conformal_sets_aps a51_weighted_conformal_quantile a53_epistemic_mi
w1_interpolate_gaps w2_impute_all w3_clean_hands w5_kinematics_9d w8_ema_anchor w14_hand_frame_align w15_phonology_19d
w17_canonicalize_handedness w18_ensure_min_frames w20_motion_aware_sample w22_jump_clamp w28_extract_spans w29_bio_segments
a8_build_vocab a10_weight_audit a13_unk_rate o9_missing_ids o11_deterministic_split j15_cross_split_leak
j16_near_duplicate_leak w41_merge_adjacent_pairs f2_clean_spelled_label j17_spelling_candidates f13_segment_unspaced
j11_hard_negatives j13_weave_spelled_spans t5_gated_majority t7_one_euro_filter t17_rate_limit t18_revocation_ttl
s8_manifest a1_sample_quality""".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, sf, duck, name):
    df = entry_module.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    duck.execute(entry_module.oracle_sql()[name])
    want = rows_of([c[0] for c in duck.description], duck.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 200


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
