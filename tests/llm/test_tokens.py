"""Token files (op1) and packing (op6): exact round trips against the tokenizer."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fleetscope.llm import packing, token_files
from fleetscope.llm.common import new_path, workers_import
from fleetscope.llm.tokens import TextEncoder
from tests.llm import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_word_memo_gives_the_tokenizers_ids(ids):
    for limit in (3, 100_000):
        enc = TextEncoder(PATH, max_words=limit)
        for t in corpus.texts():
            assert np.frombuffer(enc.encode((t or "").encode()), enc.dtype).tolist() == ids(t)
    enc, odd = TextEncoder(PATH), "a,b don't ...hi!! (hello) [x]'s 's <b>hi</b> É! ...ÉA, ß. ×a 1,2 a1 -a- it's, 'twas_ a'b' œuvre İ ΑΣ ﬁ"
    assert np.frombuffer(enc.encode_all([odd.encode(), b""])[0], enc.dtype).tolist() == ids(odd)
    whole = TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not whole.by_word and np.frombuffer(whole.encode(b"a  b"), whole.dtype).tolist() == whole._ids("a  b")


def test_word_memo_keeps_words_met_again_and_stays_bounded(ids):
    enc, learned = TextEncoder(PATH, max_words=100), []
    learn = enc._learn
    enc._learn = lambda words: (learned.extend(words), learn(words))
    for k in range(20):
        text = "again " + " ".join(corpus.prose(random.Random(k), 400).split()[:30]) + " " + " ".join(f"w{k}x{i}" for i in range(30))
        assert np.frombuffer(enc.encode(text.encode()), enc.dtype).tolist() == ids(text)
        assert len(enc.memo) + len(enc.old) <= 100 + 4 * 61  # each half and what one text may add: a word, its core and marks
    assert learned.count(b"again") == 1 and learned.count(b"w0x0") == 1


def test_words_share_their_letters_whatever_marks_stand_beside(ids):
    text = 'word, Word. (WORD) "word" -word- word!! word;a,b:word Éa éa, ÉA.'
    enc = TextEncoder(PATH)
    assert np.frombuffer(enc.encode(text.encode()), enc.dtype).tolist() == ids(text)
    assert {w for w in enc.memo if w.decode().isalpha()} == {b"word", b"a", b"b", "éa".encode()}
    assert all(w.decode().isalpha() or not any(c.isalnum() for c in w.decode()) for w in enc.memo)


def test_a_unit_is_looked_up_once_in_some_blocks_and_blocks_may_cut_texts(ids):
    import pyarrow as pa

    texts = [None, "", "same words, " * 200, " \t", "x" * 50 + " <|endoftext|> <|ENDOFTEXT|> it's 42 中文 É", "é", "end"]
    want = [ids(t) for t in texts]
    for block, blocks in ((1, 1), (7, 3), (1 << 20, 1), (100, 1000)):
        enc, seen = TextEncoder(PATH, block=block, blocks=blocks), []
        look = enc._look_up
        enc._look_up = lambda units: (seen.extend(units), look(units))[1]
        for kind in (pa.string(), pa.large_string()):
            column = pa.array(["before", *texts], kind).slice(1)
            assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode_column(column)] == want
    assert seen.count(b"same") == seen.count(b"words") == seen.count(b",") == 2  # once in each of two columns


def test_token_files_round_trip(spark, ids):
    workers_import(spark)
    folder = new_path(spark, "tokens-test")
    manifest = token_files.write_token_files(corpus.frame(spark), folder, PATH, 2, length=16, rows_per_batch=4, n_files=3)
    got = sorted((tuple(r) for r in token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    want, at = [], 0
    for r in sorted(corpus.rows(), key=lambda r: (r[0] is not None, r[0])):
        a = np.asarray([*ids(r[1]), 2], "<u4")
        want.append((r[0], at, len(a), zlib.crc32(a.tobytes())))
        at += len(a)
    assert got == want
    part = manifest.orderBy("part").first()
    file = token_files.TokenFile(part.tokens)
    stream = np.concatenate([file.ids(i)[file.mask(i)] for i in range(len(file))])
    assert len(stream) == part.n_tokens and sum(file.mask(i, "ends").sum() for i in range(len(file))) == part.n_docs
    assert file.ids(0).base is not None and len(file.ids(0)) == 16  # a view


def test_empty_tables(spark):
    workers_import(spark)
    empty = corpus.frame(spark, [])
    manifest = token_files.write_token_files(empty, new_path(spark, "tokens-test"), PATH, 2, n_files=2)
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0
    assert packing.pack_documents(empty, PATH, 1).count() == 0


@pytest.mark.parametrize("limits", [(2048, 64, 2047), (128, 3, 100)])
def test_pieces_hold_every_id_once_within_limits(spark, ids, limits):
    workers_import(spark)
    got = packing.pack_documents(corpus.frame(spark, parts=2), PATH, 1, max_tokens=limits[0], max_segments=limits[1],
                                 max_loss=limits[2], pool=8).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for r in corpus.rows():
        a, at = np.asarray([*ids(r[1]), 1], "<u4"), 0
        for p in sorted(by_doc[r[0]], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(a) and p.ids_crc32 == zlib.crc32(a[at:at + p.length].tobytes())
            at += p.length
        assert at == len(a)
    for pieces in by_seq.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        assert sum(p.length for p in pieces) <= limits[0] and len(pieces) <= limits[1]
        assert sum(p.length - 1 for p in pieces) <= limits[2]


def test_whole_examples_are_packed_under_three_limits():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 400, 500)
    loss = np.minimum(300, tokens * rng.random(500)).astype(int)
    bins = packing.pack_vectors(tokens, loss, (512, 4, 300))
    assert sorted(k for b in bins for k, _, _ in b) == list(range(500))
    for b in bins:
        k = [x[0] for x in b]
        assert tokens[k].sum() <= 512 and len(k) <= 4 and loss[k].sum() <= 300
    with pytest.raises(ValueError):
        packing.pack_vectors(np.asarray([600]), np.asarray([1]), (512, 4, 300))
    assert len(bins) < 1.25 * max(tokens.sum() / 512, 500 / 4, loss.sum() / 300)


@pytest.mark.parametrize("shape", ["short", "long", "mixed"])
def test_sequences_are_filled(shape):
    rng = np.random.default_rng(5)
    size = {"short": rng.integers(5, 16, 4096), "long": rng.integers(1000, 9000, 300),
            "mixed": np.where(rng.random(3000) < 0.9, rng.integers(1, 40, 3000), rng.integers(100, 5000, 3000))}[shape]
    packer, rows = packing._Packer(0, (2048, 2048, 2047), 16, np.dtype("<u2")), []
    for i, n in enumerate(size.tolist()):
        rows += packer.add(i, np.full(n, 7, "<u2"))
        if len(packer.pool) >= 1024:
            rows += packer.pack(last=False)
    rows += packer.pack(last=True)
    used = defaultdict(int)
    for r in rows:
        used[r[5]] += r[2]
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in used.values())
    assert sum(used.values()) == size.sum() and max(used.values()) <= 2048
    assert size.sum() >= 0.98 * padded


@pytest.mark.parametrize("limits", [(64, 4, 20), (256, 9, 255)])
def test_prompts_bear_no_loss_and_three_limits_hold(spark, ids, limits):
    workers_import(spark)
    texts = [r[1] for r in corpus.rows()]
    rows = [(i, q, a, "x") for i, (q, a) in enumerate(zip([None, "", *texts], [*texts, None, ""]))]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string, n_loss string").repartition(2)
    got = packing.pack_documents(df, PATH, 1, max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2], pool=16,
                                 min_cut=4, prompt_col="prompt").collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, prompt, text, _ in rows:
        free = len(ids(prompt))
        a, at = np.asarray([*ids(prompt), *ids(text), 1], "<u4"), 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(a[at:at + p.length].tobytes())
            assert p.n_loss == sum(k >= free and k > at for k in range(at, at + p.length))
            at += p.length
        assert at == len(a) == by_doc[i][0].doc_tokens
    for pieces in by_seq.values():
        assert sum(p.length for p in pieces) <= limits[0] and len(pieces) <= limits[1]
        assert sum(p.n_loss for p in pieces) <= limits[2]
