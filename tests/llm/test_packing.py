import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verdure.llm.packing import Slots, encoder, fullest, minimum_bin_slack, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_fullest_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 12) for _ in range(rng.randint(0, 9))]
        counts = np.bincount(items, minlength=20) if items else np.zeros(20, int)
        room = rng.randint(0, 19)
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room)
        got = fullest(counts, room)
        assert sum(n * k for n, k in got) == best and all(k <= counts[n] for n, k in got)


def lower_bound(counts, room):
    """Martello and Toth's bound: pieces over half a bin can't share one, and take room from the smaller ones."""
    n, best = np.arange(len(counts)), 0
    for k in range(room // 2 + 1):
        large, middle, small = n > room - k, (n > room / 2) & (n <= room - k), (n >= k) & (n <= room / 2)
        spare = counts[middle].sum() * room - (counts * n)[middle].sum()
        best = max(best, counts[large].sum() + counts[middle].sum() + max(0, -(-((counts * n)[small].sum() - spare) // room)))
    return best


def test_bins_hold_everything_once():
    rng = random.Random(2)
    lengths = [rng.randint(1, 64) for _ in range(3000)]
    counts = np.bincount(lengths, minlength=65)
    bins = minimum_bin_slack(counts, 64)
    held = np.zeros(65, int)
    for uses, times in bins:
        assert sum(n * k for n, k in uses) <= 64
        for n, k in uses:
            held[n] += k * times
    assert (held == counts).all()
    assert lower_bound(counts, 64) <= sum(t for _, t in bins) <= lower_bound(counts, 64) + 2
    slots, places = Slots(bins, 64), defaultdict(list)
    for n in range(1, 65):
        for s, o in zip(*slots.place(np.full(counts[n], n), np.arange(counts[n]))):
            places[s].append((o, n))
    for v in places.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n


@pytest.mark.parametrize("text", ["", "Hello  world's 12 x\n\n y", "ünï cödé ☃ 字", "<|endoftext|> in a text", " \t   ", "aaaa" * 500, "'Tis IT'S we'll"])
def test_fast_ids_are_the_library_ids(text):
    own = Tokenizer.from_file(PATH)
    assert encoder(PATH)(text).tolist() == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" + " " * 2_000_000 + "b", "\n" * 1_000_000, "x\u3000" + "\t " * 200_000, "z" * 300_000, "?!" * 200_000])
def test_very_long_runs(text):
    own = Tokenizer.from_file(PATH)
    assert encoder(PATH)(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, edge, edge_rows, empty):
    own = Tokenizer.from_file(PATH)
    rows = pack(edge, PATH, keep_ids=True).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length == len(r.ids) // 4 <= 1024
    assert set(by) == {r[0] for r in edge_rows}
    for doc_id, text, *_ in edge_rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by[doc_id], key=lambda r: r.piece)
        if doc_id != 11:
            assert b"".join(bytes(p.ids) for p in pieces) == ids.tobytes()
            assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
            assert all(p.length == 1024 for p in pieces[1:])
    assert len(by[11]) == 2
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    assert pack(empty, PATH).collect() == []
