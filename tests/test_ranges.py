"""JSON arrays by byte ranges against the json module, and many transcripts in one scan."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracklore.sources import ranges as G
from tracklore.sources import readers as R

nasty = st.text(alphabet='\\"{}[],: aé\n', max_size=12)
value = st.recursive(nasty | st.integers(), lambda v: st.lists(v, max_size=3) | st.dictionaries(nasty, v, max_size=3), max_leaves=8)


def by_ranges(path, size):
    """What the tasks do, with the states of the ranges summed up in order."""
    total, out, in_string, depth = path.stat().st_size, [], 0, 0
    with open(path, "rb") as f:
        base = int(f.read(64).lstrip()[:1] == b"[")
        for start in range(0, total, size):
            out += [text for _, text in G._elements(f, start, size, in_string, depth, base)]
            block = G._block(f, start, size)
            depth += int(G._depths(block, in_string)[0].sum())
            in_string = (in_string + int((block == 34).sum())) & 1
    return [json.loads(t) for t in out]


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(objects=st.lists(st.dictionaries(nasty, value, max_size=3), max_size=6), size=st.integers(1, 40), ascii_only=st.booleans(), lines=st.booleans())
def test_ranges_of_any_size_give_every_object_once(tmp_path, objects, size, ascii_only, lines):
    p = tmp_path / "a.json"
    texts = [json.dumps(o, ensure_ascii=ascii_only) for o in objects]
    p.write_text("\n".join(texts) if lines else "[" + ", ".join(texts) + "]", encoding="utf-8")
    assert by_ranges(p, size) == objects


def test_json_objects_on_spark_with_tiny_ranges_and_many_files(spark, tmp_path):
    want = {}
    for k in range(3):
        objects = [{"gloss": f"G{k}-{i} \\\"{{[", "instances": [{"video_id": str(i), "frame_start": i}] * (i % 4)} for i in range(60)]
        (tmp_path / f"{k}.json").write_text(json.dumps(objects, indent=k or None))
        want[f"{tmp_path}/{k}.json"] = objects
    (tmp_path / "none.json").write_text("")
    got = G.json_objects(spark, [*want, f"{tmp_path}/none.json"], 57).collect()
    assert {p: [json.loads(r.json) for r in sorted(got, key=lambda r: r.place) if r.path == p] for p in want} == want
    (tmp_path / "open.json").write_text('[{"a": 1}, {"a": ')
    with pytest.raises(Exception, match="has no end"):
        G.json_objects(spark, [f"{tmp_path}/open.json"], 5).collect()


def test_many_transcripts_are_one_scan_and_the_last_file_wins(spark, tmp_path):
    paths = []
    for k in range(40):
        sep = ",;\t|"[k % 4]
        rows = [["note", "clip_id", "text"], ["n", f"own{k}", f'"quoted {sep} ""word"" {k}"'], ["n", "all", f"from {k}"], ["n", "all", f"again {k}"], ["n", f"short{k}"]]
        p = tmp_path / f"part {99 - k}.csv"
        p.write_text("\n".join(sep.join(r) for r in rows) + "\n")
        paths.append(str(p))
    (tmp_path / "empty.csv").write_text("")
    got = {r.clip_id: r.text for r in R.transcripts(spark, [*paths, str(tmp_path / "empty.csv")]).collect()}
    assert got["all"] == "again 39" and len(got) == 41
    assert all(got[f"own{k}"] == f'quoted {",;" [k % 2] if k % 4 < 2 else chr(9) if k % 4 == 2 else "|"} "word" {k}' for k in range(40))
    assert R.transcripts(spark, []).count() == 0 and R.transcripts(spark, [str(tmp_path / "empty.csv")]).count() == 0
