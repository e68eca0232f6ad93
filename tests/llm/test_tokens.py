import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm.arrays import portions
from larkspur.llm.packing import Schedule, Tiers
from larkspur.llm.tokens import Encoder, tokenizer_path

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {n: Encoder(n, limit=400) for n in NAMES}
BITS = st.sampled_from(
    [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "　", "The", "isn't", "'tis", "('s", "'", "’", "—", "“", "×", "à", "Ã", "we'LL", "x1y22", "été", "É", "é", "İ", "ΣΑΣ", "ß", "日本", "😀", "...", "'", "<|endoftext|>", "<|startoftext|>", "$$#", "ａ", "word", "\x00", "ǅ", "ɐ", "_"]
)
TEXTS = st.lists(st.one_of(st.lists(BITS, max_size=12).map("".join), st.text(max_size=20)), max_size=6)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=1500, deadline=None)
@given(texts=TEXTS)
def test_ids_equal_those_of_whole_texts(name, texts):
    e = ENCODERS[name]
    ids, n = e.encode(texts)
    whole = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in whole]
    assert ids.tolist() == [i for x in whole for i in x]
    (_, data, offsets), = portions(pa.array([*texts, ""], pa.large_string()), 1 << 62)
    ended, m = e.encode_ended(data, offsets, 7)
    assert ended[-1] == 7 and m[-1] == 1
    ended, m = ended[:-1], m[:-1]
    assert ended.tolist() == [i for x in whole for i in [*x, 7]] and m.tolist() == [len(x) + 1 for x in whole]


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens_are_those_of_the_library_as_loaded(name):
    fresh = Tokenizer.from_file(tokenizer_path(name))
    texts = ["the end<|endoftext|> next", "plain words", "", "<|startoftext|>a", "<|endoftext|><|endoftext|>", "THE <|ENDOFTEXT|> end", "<|endof", "text|> apart"]
    ids, n = Encoder(name).encode(texts)
    whole = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(whole[0]) == 4
    assert n.tolist() == [len(x) for x in whole]
    assert ids.tolist() == [i for x in whole for i in x]


@settings(max_examples=200, deadline=None)
@given(
    counts=st.lists(st.integers(1, 300), min_size=1, max_size=7),
    weighted=st.booleans(),
    length=st.integers(1, 64),
    scale=st.sampled_from([1, 10**12]),
)
def test_windows_are_full_and_meet_their_shares(counts, weighted, length, scale):
    counts = [c * scale for c in counts]
    weights = [float(1 + k % 3) for k in range(len(counts))] if weighted else None
    s = Schedule(counts, weights)
    total = sum(counts)
    at = np.minimum(np.arange(40) * length, total)
    given_ = s.given(at)
    assert [int(x) for x in given_.sum(axis=1)] == at.tolist()
    assert (np.diff(given_, axis=0) >= 0).all() and (given_ <= np.array(counts, dtype=object)).all()
    assert [int(x) for x in s.given(np.array([total]))[0]] == counts
    if not weighted:
        ideal = at[:, None].astype(float) * np.array(counts, float) / total
        assert (np.abs(given_.astype(float) - ideal) <= len(counts) + 1).all()
    q = len(counts) - 1
    w = s.window_of(q, counts[q] - 1, length)
    assert int(s.given(np.array([w * length]))[0, q]) < counts[q] <= int(s.given(np.array([(w + 1) * length]))[0, q])


@settings(max_examples=200, deadline=None)
@given(counts=st.lists(st.integers(1, 60), min_size=1, max_size=30), weighted=st.booleans(), fan=st.integers(2, 40), length=st.integers(1, 64))
def test_tiers_are_one_order_of_all_queues(counts, weighted, fan, length):
    s = Tiers(counts, [float(1 + k % 3) for k in range(len(counts))] if weighted else None, fan)
    total = sum(counts)
    places = [s.order(q, np.arange(n)) for q, n in enumerate(counts)]
    assert sorted(x for p in places for x in p.tolist()) == list(range(total))
    at = np.minimum(np.arange(total // length + 2) * length, total)
    flat = Schedule(counts).given(at)
    for q, p in enumerate(places):
        assert (np.diff(p) > 0).all()
        own, lead = s.given(q, at)
        assert own.tolist() == [int((p < x).sum()) for x in at]
        assert lead.tolist() == [sum(int((o < x).sum()) for o in places[:q]) for x in at]
        if not weighted and fan >= len(counts):
            assert own.tolist() == flat[:, q].tolist()


def test_tiers_of_more_tokens_than_products_of_64_bits_hold():
    s = Tiers([10**12, 1, 3 * 10**12, 5, 7], fan=2)
    own, _ = s.given(0, np.array([4000, 4 * 10**12 + 13]))
    assert abs(int(own[0]) - 1000) <= 4 and int(own[1]) == 10**12
    assert s.order(0, np.array([999_999]))[0] // 4 in range(999_990, 1_000_010)


@pytest.mark.parametrize("name", NAMES)
def test_a_text_with_millions_of_different_words(name):
    """More pieces than the store remembers, in one text."""
    text = " ".join(f"{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760 % 26)}{chr(97 + i // 175760 % 26)}" for i in range(2_600_000))
    e = Encoder(name)
    ids, n = e.encode([text])
    part = 26_000 * 6  # the library itself, piece by piece: every word but the first of a part has the blank before it
    want = [x.ids for x in e.library.encode_batch([text[i : i + part].rstrip(" ") if i == 0 else " " + text[i : i + part].rstrip(" ") for i in range(0, len(text), part)], add_special_tokens=False)]
    assert n.tolist() == [sum(map(len, want))] and ids.tolist() == [i for x in want for i in x]
