import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracklore.llm import packing, store, token_files
from tracklore.llm.tokens import Encoder, worker_path


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_library_s_ids(name, rows):
    import pyarrow as pa

    texts = [t for _, t in rows] + ["<|endoftext|> a<|endoftext|>b", "it's, don't! e.g. 3.14\r\n\r\n x", "  two  spaces ", "́.á,"]
    lib = Tokenizer.from_file(worker_path(name))
    got = []
    for _, ids, at in Encoder(worker_path(name)).closed(pa.array(texts, pa.string()), 2):
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [lib.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_the_library_sees_few_pieces_at_once():
    import pyarrow as pa

    class Spy:
        def __init__(self, lib):
            self.lib, self.most = lib, 0

        def encode_batch_fast(self, texts, **how):
            self.most = max(self.most, sum(len(t.split()) for t in texts))
            return self.lib.encode_batch_fast(texts, **how)

    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" + ("9" if i % 2 else "") for i in range(17_000))
    enc = Encoder(worker_path("byte_bpe_50k.json"))
    want = enc.lib.encode(text, add_special_tokens=False).ids + [2]
    enc.lib = Spy(enc.lib)
    assert [ids.tolist() for _, ids, _ in enc.closed(pa.array([text]), 2)] == [want]
    assert enc.lib.most <= 5_000


def test_batches_follow_bytes_and_not_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 2_000, 1, 1).select("id", F.repeat(F.lit("long text "), 1_000).alias("text"))  # 20 MB in one task
    seen = store.map_arrow(rows, lambda batches: ({"n": [b.num_rows], "size": [b.nbytes]} for b in batches), "n long, size long").collect()
    assert sum(r["n"] for r in seen) == 2_000
    assert max(r["size"] for r in seen) <= 6 << 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 40), 1 << 40), max_size=700))
def test_elias_fano_round_trip(values):
    v = np.sort(np.array(values, np.int64))
    e = token_files.EliasFano.of(v)
    assert e.all().tolist() == v.tolist() == [e.get(i) for i in range(len(v))]


def encoded(rows, name):
    lib = Tokenizer.from_file(worker_path(name))
    return [(d, np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t in rows]


def test_token_files_match_brute_force(spark, docs, rows, none, tmp_path):
    want, start = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for d, ids in encoded(order, "word_bpe_49k.json"):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.token_files(spark, docs).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    files = token_files.write(docs, str(tmp_path / "small"), "word_bpe_49k.json", 2, shard_ids=500)
    assert files.count() > 5 and sorted(map(tuple, token_files.read(files).collect()), key=lambda r: r[1]) == want
    for r in files.collect():
        system, inner = store.filesystem(r["path"])
        shard = token_files.TokenFile(system.open_input_file(inner).read())
        at = shard.offsets()
        for i in range(r["n_docs"]):
            assert (shard.doc(i) == shard.ids[at[i]:at[i + 1]]).all()
    assert token_files.token_files(spark, none).collect() == []


def test_packing_is_whole_and_gapless(spark, docs, rows, none):
    got = packing.packed(spark, docs, size=256).collect()
    want = sorted((d is None, d or 0, len(i)) for d, i in encoded(rows, "byte_bpe_50k.json"))
    sequences, crcs = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        crcs[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    for d, ids in encoded(rows, "byte_bpe_50k.json"):
        for piece, start, length, crc in crcs[d] if d not in (None, 8) else []:
            assert zlib.crc32(ids[start:start + length].tobytes()) == crc
            assert length == 256 or piece == 0
    assert sum(r["length"] for r in got) == sum(n for *_, n in want)
    assert len(sequences) <= 1.05 * sum(n for *_, n in want) / 256 + 1
    assert packing.packed(spark, none).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_plan_places_every_piece_once(counts):
    n = np.zeros(65, np.int64)
    for length, many in counts.items():
        n[length] = many
    plan = packing.Plan(n, 64)
    length = np.repeat(np.arange(65), n)
    number = np.arange(len(length)) - np.repeat(np.cumsum(n) - n, n)
    sequence, offset = plan.place(length, number)
    used = np.zeros((plan.sequences, 64), int)
    for s, o, m in zip(sequence, offset, length, strict=True):
        used[s, o:o + m] += 1
    assert used.max(initial=0) <= 1 and (np.diff(used, axis=1) <= 0).all()


def fewest(lengths, size):
    """Exact smallest number of sequences for a few pieces: longest first, into every different room."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[i]}):
            rest = list(rooms)
            rest.remove(room)
            place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, size - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.integers(6, 24).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), min_size=1, max_size=9))))
def test_plans_are_near_the_exact_optimum(case):
    size, lengths = case
    plan = packing.Plan(np.bincount(lengths, minlength=size + 1), size)
    assert fewest(lengths, size) <= plan.sequences <= 11 / 9 * fewest(lengths, size) + 1


def test_packed_ids_are_the_ids_of_the_pieces(spark, docs):
    for r in packing.packed(spark, docs, size=256, with_ids=True).collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
