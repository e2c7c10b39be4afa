import sys
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import documents, prose
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from spanlake.llm import huffman, tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "a", "İstanbul ΣΑΣ ς", "été café", "don't we'll 's", "x y z\x1c1", "...!!",
       "<|endoftext|> and <|startoftext|>", "3.14,2;7 ½ ²", "A.\r\nB,\tC", "日本語 テキスト", "w" * 5000,
       "end.%%% (see) [x]. 'tis", "́lone", "KK ﬁne"]


def test_pieces_equal_whole_texts():
    whole = Tokenizer.from_file(PATH)
    texts = [t or "" for t in ODD] + [prose(k, 50).title() + "." for k in range(30)]
    for text, got in zip(texts, tokenfiles.encode_texts(PATH, texts)):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def _all_letters():
    """Every character that is a letter to Python, in words of eight with their upper case."""
    chars = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    words = ["".join(chars[k:k + 8]) for k in range(0, len(chars), 8)]
    return words + [w.upper() for w in words]


def test_every_letter_beside_plain_words():
    words = _all_letters()
    odd = [c for c in map(chr, range(0x3000)) if c.isalpha() and len(c.lower()) > 1 or len(c.upper()) > 1]
    texts = [" ".join(words[k:k + 50]) + " plain words" for k in range(0, len(words), 50)]
    texts += [f"a{c}b {c} plain {c}. {c.upper()}x J\u030c H\u0331" for c in odd]
    for text, got in zip(texts, tokenfiles.encode_texts(PATH, texts)):
        assert np.frombuffer(got, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text


def test_one_odd_text_leaves_the_others_alone():
    texts = [f"plain english words number {w} here" for w in "one two three four five six seven eight".split()]
    want = [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
    for batch in ([*texts, "\u0130stanbul g\u00fczel"], texts):
        got = tokenfiles.encode_texts(PATH, batch)
        assert [np.frombuffer(g, "<u4").tolist() for g in got[:8]] == want


LETTERS = st.characters(categories=["Lu", "Ll", "Lt", "Lm", "Lo", "Mn"])
MIXED = st.one_of(st.text(max_size=60), st.text(LETTERS, max_size=60),
                  st.text(st.sampled_from("\u0130I\u0307\u03a3\u03c2J\u030cH\u0331\u00df\u1e9e\ufb01\u01c5\u0149ab .'!\n"), max_size=40))


@settings(max_examples=400, deadline=None)
@given(MIXED)
def test_pieces_equal_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    got = tokenfiles.encode_texts(PATH, [text])[0]
    whole = WHOLE.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(got, "<u4").tolist() == whole


WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=80), st.integers(7, 20))
def test_code_is_complete_and_limited(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[counts > 0].astype(float)
    assert (lengths[counts == 0] == 0).all() and (used <= limit).all()
    if len(used) > 1:
        assert (2.0 ** -used).sum() == 1
    if len(used) > 1 and limit >= 16:  # no limit in effect: as good as plain Huffman
        import heapq
        heap, total = sorted(counts[counts > 0].tolist()), 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            total += a + b
            heapq.heappush(heap, a + b)
        assert total == int((lengths * counts).sum())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=40), min_size=1, max_size=12), st.integers(1, 9))
def test_block_round_trip(rows, interval):
    ids = np.array([i for r in rows for i in r], np.int64)
    n = np.array([len(r) for r in rows])
    lengths = huffman.code_lengths(np.bincount(ids, minlength=301), 12)
    if not len(ids):
        return
    data, at, marks = huffman.pack(ids, n, lengths, huffman.canonical_codes(lengths), interval)
    mark_at = np.r_[0, np.cumsum((n + interval - 1) // interval)]
    block = huffman.write_block([None, *range(1, len(rows))], n, [data[at[k]:at[k + 1]].tobytes() for k in range(len(n))],
                                [marks[mark_at[k]:mark_at[k + 1]] for k in range(len(n))], interval)
    docs, counts, got = huffman.read_block(block, huffman.decode_table(lengths))
    assert docs == [None, *range(1, len(rows))] and counts.tolist() == n.tolist() and got.tolist() == ids.tolist()


def test_files(spark):
    rows = [(k * 3 % 101, prose(k, 3 + k), "en", "s") for k in range(101)]
    rows += [(500 + k, t, None, None) for k, t in enumerate(ODD)]
    rows += [(None, "no id", None, None), (4, "twice", "en", "s"), (4, "twice", "en", "s"), (999, prose(1, 30_000), "en", "s")]
    got = tokenfiles.token_file_index(documents(spark, rows).repartition(3), PATH).collect()
    want = sorted(((-1 if d is None else d), len(i), zlib.crc32(np.array(i, "<u4").tobytes()))
                  for d, i in ((d, WHOLE.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _, _ in rows))
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    assert sorted(g[1:] for g in got) == want
    at, last = 0, -1
    for start, doc_id, n, _ in got:
        assert start == at and doc_id >= last
        at, last = at + n, doc_id


def test_ids_come_back(spark, tmp_path):
    rows = [(1, "the words of the", "en", "s"), (2, None, "en", "s")]
    tokenfiles.write_token_files(documents(spark, rows), PATH, str(tmp_path / "f"))
    got = {r.doc_id: r.ids for r in tokenfiles.read_token_ids(spark, str(tmp_path / "f")).collect()}
    assert got == {1: WHOLE.encode("the words of the", add_special_tokens=False).ids + [2], 2: [2]}


def test_empty(spark):
    assert tokenfiles.token_file_index(documents(spark, []), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokenfiles._check_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def _letters(k: int) -> str:
    """A word of letters for each number."""
    word = ""
    while True:
        k, digit = divmod(k, 26)
        word += chr(97 + digit)
        if not k:
            return word


def test_words_stay_known(monkeypatch):
    """What a worker has met does not meet the tokenizer again, also after many other words."""
    seen, encode = [], tokenfiles._encode_pieces
    monkeypatch.setattr(tokenfiles, "_encode_pieces", lambda t, c, p, *more: seen.append(len(p)) or encode(t, c, p, *more))
    monkeypatch.setattr(tokenfiles, "worker_cache", lambda name, own=types.SimpleNamespace(): own)
    first = " ".join(f"q{_letters(k)}q" for k in range(50))
    tokenfiles.encode_texts(PATH, [first])
    for low in (0, 220_000):
        tokenfiles.encode_texts(PATH, [" ".join(_letters(k) + "x" for k in range(low, low + 220_000))])
    assert sum(seen) >= 440_000
    seen.clear()
    got = tokenfiles.encode_texts(PATH, [first])[0]
    assert sum(seen) == 0
    assert np.frombuffer(got, "<u4").tolist() == WHOLE.encode(first, add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [0, 7, 60])
def test_full_cache_gives_the_same_ids(monkeypatch, kept):
    monkeypatch.setattr(tokenfiles, "CACHED_PIECES", kept)
    monkeypatch.setattr(tokenfiles, "worker_cache", lambda name, own=types.SimpleNamespace(): own)
    texts = [t or "" for t in ODD] + [prose(k, 40).title() + "!? Été, " + _letters(k) * 30 for k in range(40)]
    texts += ["word", "word.", "word,%%%", "'s", "s'", "don't.", "İx.", "é́.", "é!", "..", ".a.", "<|endoftext|>."]
    for low in range(0, len(texts), 5):
        some = texts[low:low + 5] + texts[:3]
        for text, got in zip(some, tokenfiles.encode_texts(PATH, some), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("chars", [1, 200, 10_000])
def test_groups_run_on_over_batches(monkeypatch, chars):
    """Texts of several Arrow batches are taken together, and none is lost or changed."""
    monkeypatch.setattr(tokenfiles, "CHARS_AT_ONCE", chars)
    rows = [(k, t) for k, t in enumerate([*ODD, *[prose(k, 9) for k in range(20)], None])]
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows[k:k + 4]], pa.int64()),
                                           pa.array([t for _, t in rows[k:k + 4]], pa.string())], ["doc_id", "text"])
               for k in range(0, len(rows), 4)]
    groups = list(tokenfiles._groups(iter(batches)))
    assert [(i, t) for ids, texts in groups for i, t in zip(ids, texts, strict=True)] == [(i, t or "") for i, t in rows]
    assert all(sum(map(len, texts[:-1])) < chars for _, texts in groups)
    assert (len(groups) == 1) == (chars == 10_000)
    assert list(tokenfiles._groups(iter([]))) == []
