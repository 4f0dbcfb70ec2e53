"""Token counts, packing, token files and sampled segmentations, against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webgauge.llm import pretok, sentencepiece_sampling
from webgauge.llm.encode import encoder
from webgauge.llm.packing import best_fit_decreasing, dual_feasible_bound, pack_documents
from webgauge.llm.sentencepiece_sampling import Sampler, decode_segmentations, sample_segmentations, segmentation_digests
from webgauge.llm.token_counts import count_tokens, counter
from webgauge.llm.token_files import BITS, BYTES, block_index, crc32_combine, decode_block, encode_block, read_tokens, tokens_through_files, write_token_files

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def texts():
    rng = random.Random(3)
    alphabet = "ab's tlrevmd  \n\t!?1é2ΣİǺ日🙂\x85\xa0\x1c"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return out + ["", " ", "aaaaaaaaaaaa", "it's they'll we've 'S", "x<|endoftext|>y", "<|startoftext|>", "a" * 3000]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_counts_equal_the_library(name):
    path, t = public_tokenizers.path(name), texts()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(t, add_special_tokens=False)]
    ids, n = encoder(path).encode(t)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert counter(path).count(t).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("name", FILES)
def test_ids_of_marks_that_change_places(name):
    """Marks in every order, those that only one of Python and the library knows among them."""
    import unicodedata

    rng, path = random.Random(9), public_tokenizers.path(name)
    marks = [chr(c) for c in range(0x20000) if unicodedata.combining(chr(c))]
    hard = ["İ", "i\u0307", "I", "ſ", "\u212a", "Å", "ẞ", "Σ", "ς", "ﬁ", "e\u0301", "가", "ᄀ\u1161", "\u200b", "'S", "½", "日", " ", "\x85", "Ǆ", "ᾼ", "the"]
    piece = lambda: rng.choice(marks) if rng.random() < 0.5 else rng.choice(hard)
    t = ["".join(piece() for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["İ\u09cd", "İ\u0f7a", "İ\u085b", "\u1acc\U0001e4ee"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(t, add_special_tokens=False)]
    ids, n = encoder(path).encode(t)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert counter(path).count(t).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("name", FILES)
def test_ids_of_random_texts_over_all_planes(name):
    rng, path = random.Random(1), public_tokenizers.path(name)
    pools = [(0x20, 0x7F), (0xA0, 0x600), (0x10000, 0x20000), (0x13400, 0x14400), (0, 0xD800), (0xE000, 0x110000), (0x11380, 0x113E3), (0x16100, 0x16140), (0x10D40, 0x10D90), (0x1C80, 0x1C8B), (0xA7C0, 0xA7E0), (0x300, 0x370)]
    t = ["".join(chr(rng.randrange(*rng.choice(pools))) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(t, add_special_tokens=False)]
    ids, n = encoder(path).encode(t)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert counter(path).count(t).tolist() == [len(w) for w in want]


def test_classes_of_all_code_points():
    from tokenizers import Regex, pre_tokenizers

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    for kind, pattern in pretok.CLASSES.items():
        want = {points[i] for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text) for i in range(a, b)}
        assert set(np.flatnonzero(pretok._class_table() == kind).tolist()) == want


def test_merged_symbols_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = ["hello", "aaaaaaa", "internationalisation", "ééé", "1234567"]
    symbols, n = counter(path).ids(words)
    assert [x.tolist() for x in np.split(symbols, np.cumsum(n)[:-1])] == [e.ids for e in Tokenizer.from_file(path).encode_batch(words, add_special_tokens=False)]


def test_count_tokens_of_odd_rows(spark, make_docs, odd_rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(make_docs(odd_rows)).collect())
    lib = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    want = []
    for i, t in odd_rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i is None, i or 0, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert count_tokens(make_docs([])).count() == 0


def test_bound_is_valid_and_packing_feasible():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        where, offset, bins = best_fit_decreasing(sizes, 100)
        assert np.bincount(where, weights=sizes).max() <= 100
        assert dual_feasible_bound(np.bincount(sizes, minlength=101), 100) <= bins
    # seven items over a half each need a bin of their own
    assert dual_feasible_bound(np.bincount([51] * 7, minlength=101), 100) == 7
    # three of a third and a bit: two fit
    assert dual_feasible_bound(np.bincount([34] * 6, minlength=101), 100) == 3


@pytest.mark.parametrize("cell_rows", [4, 50_000])
def test_packing_of_odd_rows(spark, make_docs, odd_rows, cell_rows):
    got = pack_documents(make_docs(odd_rows), cell_rows=cell_rows).toPandas()
    assert len(got.groupby("sequence_id").length.sum()) >= -(-got.length.sum() // 4096)
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    q = got.sort_values(["sequence_id", "offset"])
    assert ((q.groupby("sequence_id").length.cumsum() - q.length) == q.offset).all()
    lib = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    want = []
    for i, t in odd_rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i or -1, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    have = got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("int64").itertuples(index=False)
    assert sorted(map(tuple, have)) == sorted(want)
    assert pack_documents(make_docs([])).count() == 0


def test_exchange_reaches_the_bound(spark, make_docs):
    docs = make_docs([(i, "a " * (500 + 37 * (i % 60))) for i in range(300)])
    got = pack_documents(docs, cell_rows=40).toPandas()
    sizes = got.length.to_numpy()
    apart = sum(best_fit_decreasing(sizes[i::8], 4096)[2] for i in range(8))
    assert dual_feasible_bound(np.bincount(sizes, minlength=4097), 4096) <= got.sequence_id.nunique() < apart
    assert got.sequence_id.nunique() <= best_fit_decreasing(sizes, 4096)[2] + 3


@pytest.mark.parametrize("mode", [BYTES, BITS])
def test_blocks_round_trip(mode):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.zeros(9, np.uint32), rng.integers(0, 2**32, 1001, dtype=np.uint32), rng.integers(0, 50257, 65536, dtype=np.uint32)):
        assert (decode_block(encode_block(ids, mode)) == ids).all()


def test_crc_of_joined_parts():
    data = bytes(range(256)) * 5
    for cut in (0, 1, 700, len(data)):
        assert crc32_combine(zlib.crc32(data[:cut]), zlib.crc32(data[cut:]), len(data) - cut) == zlib.crc32(data)


@pytest.mark.parametrize("block_ids", [64, 1 << 16])
def test_token_files_round_trip(spark, make_docs, odd_rows, tmp_path, block_ids):
    from webgauge.llm.token_files import read_digests

    path = write_token_files(make_docs(odd_rows), str(tmp_path / f"t{block_ids}"), block_ids=block_ids)
    got = read_digests(spark, path).toPandas().sort_values("start")
    lib = Tokenizer.from_file(public_tokenizers.path(FILES[1]))
    by_id = {}
    for i, t in odd_rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        by_id.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
    assert len(got) == len(odd_rows)
    assert (got.start == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]])).all()
    ids = [None if np.isnan(x) else int(x) for x in got.doc_id]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert sorted((i or -1, n, c) for i, n, c in zip(ids, got.n_tokens, got.ids_crc32)) == sorted((i or -1, n, c) for i, v in by_id.items() for n, c, _ in v)
    parts = read_tokens(spark, path).where("doc_id = 7").orderBy("segment").collect()
    assert [x for r in parts for x in r.ids] == by_id[7][0][2]
    assert block_index(spark, path).agg({"n_ids": "sum"}).first()[0] == got.n_tokens.sum()


def test_token_files_of_nothing(spark, make_docs):
    assert tokens_through_files(make_docs([])).count() == 0


def test_sampling_is_lossless_and_reproducible(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    encoded = sample_segmentations(docs, seed=1)
    again = sorted((r.doc_id or 0, tuple(r.ids)) for r in sample_segmentations(docs.repartition(3), seed=1).collect())
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in encoded.collect()) == again
    assert sorted((r.doc_id or 0, r.text) for r in decode_segmentations(encoded).collect()) == sorted((i or 0, t or "") for i, t in odd_rows)
    assert all(r.lossless for r in segmentation_digests(docs).collect())
    assert segmentation_digests(make_docs([])).count() == 0


def test_sampling_follows_the_lattice_distribution():
    s = Sampler(public_tokenizers.path("piece_bpe_32k.model"), theta=1e-4)
    word, n = "▁thin", 40_000
    score = {bytes(s.raw[i]).decode(): x for i, x in zip(s.id, s.score)}
    paths = {}

    def walk(rest, path, total):
        if not rest:
            paths[path] = np.exp(total)
        for k in range(1, len(rest) + 1):
            if rest[:k] in score:
                walk(rest[k:], (*path, rest[:k]), total + score[rest[:k]])

    walk(" thin", (), 0.0)
    z = sum(paths.values())
    ids, count = s.sample(["thin"] * n, np.arange(n) * 7919)
    seen = {}
    for x in np.split(ids, np.cumsum(count)[:-1]):
        p = tuple(s.raw[i].decode() for i in x)
        seen[p] = seen.get(p, 0) + 1
    assert set(seen) <= set(paths) and len(word) == 5
    for p, w in paths.items():
        assert abs(seen.get(p, 0) / n - w / z) < 0.01


def test_sampling_of_a_long_run_follows_one_lattice():
    """How often each place of a run of over 48 characters is a boundary, against sums over all its paths."""
    s = Sampler(public_tokenizers.path("piece_bpe_32k.model"), theta=1e-4)
    score = {bytes(s.raw[i]).decode(): x for i, x in zip(s.id, s.score)}
    n = 4000
    for text in ("thinking" * 13, "https://example.org/" + "station" * 8 + "?a=日本語" + "ation" * 12):
        run = " " + text
        edges = [(i, j, score[run[i:j]] if run[i:j] in score else s.byte_score) for i in range(len(run)) for j in range(i + 1, min(i + s.longest, len(run)) + 1) if run[i:j] in score or j == i + 1]
        ahead, back = np.full(len(run) + 1, -np.inf), np.full(len(run) + 1, -np.inf)
        ahead[0] = back[-1] = 0
        for i, j, x in edges:
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + x)
        for i, j, x in reversed(edges):
            back[i] = np.logaddexp(back[i], back[j] + x)
        want = np.exp(ahead + back - ahead[-1])
        assert want[48] < 0.9
        ids, count = s.sample([text] * n, np.arange(n) * 7919)
        size = np.array([len(b) for b in s.raw])
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in run])])
        seen = np.zeros(len(run) + 1)
        for x in np.split(ids, np.cumsum(count)[:-1]):
            assert s.decode(x) == text
            seen += np.isin(at, np.concatenate([[0], np.cumsum(size[x])]))
        assert np.abs(seen / n - want).max() < 0.04


def test_sampling_is_the_same_wherever_a_long_run_is_parted(monkeypatch):
    texts = ["日本語の文章です" * 40, "aGVsbG8gd29ybGQ" * 300, "one\ttwo\nthree\tand" * 30, "https://example.org/" + "x1/Y2-z" * 50]
    parted = Sampler(public_tokenizers.path("piece_bpe_32k.model"))
    ids, count = parted.sample(texts, np.arange(4))
    monkeypatch.setattr(sentencepiece_sampling, "SEGMENT_CHARS", 1 << 40)
    whole = Sampler(public_tokenizers.path("piece_bpe_32k.model"))
    ids_whole, count_whole = whole.sample(texts, np.arange(4))
    assert ids.tolist() == ids_whole.tolist() and count.tolist() == count_whole.tolist()
    assert len(parted.cache.keys) > len(whole.cache.keys)
