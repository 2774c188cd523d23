"""The replay of merges: all words at once, each word once, the same ids as the plain loop."""

import random
import re
import struct

import pytest
import regex

from packloom.llm import bpe_replay

BYTES = {bytes([b]): b for b in range(256)}
RANKS = BYTES | {b"ab": 256, b"cd": 257, b"abcd": 258}
# The split pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _loop(word, ranks):
    """The lowest-ranked pair of neighbours is joined, leftmost first, until none is a token."""
    if word in ranks:
        return [ranks[word]]
    parts = [bytes([b]) for b in word]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[part] for part in parts]


@pytest.mark.parametrize("seed", range(40))
def test_replay_is_the_loop_for_any_order_of_ranks(seed, monkeypatch):
    # Ranks in any order: a join can make a pair of a lower rank than its own.
    draw = random.Random(seed)
    letters = b"abcd"[: draw.randrange(1, 5)]
    made = {bytes(draw.choices(letters, k=draw.randrange(2, 7))) for _ in range(draw.randrange(1, 80))}
    tokens = [*BYTES, *sorted(made)]
    draw.shuffle(tokens)
    ranks = {token: rank for rank, token in enumerate(tokens)}
    words = [bytes(draw.choices(letters, k=draw.randrange(0, 90))) for _ in range(60)]
    want = [_loop(word, ranks) for word in words]
    vocabulary = bpe_replay.Ranks(ranks)
    for limit in (0, 20, bpe_replay.PASSED_WORD, 100):
        monkeypatch.setattr(bpe_replay, "PASSED_WORD", limit)
        got = bpe_replay.replay(words, vocabulary)
        assert [list(struct.unpack(f"<{len(ids) // 4}I", ids)) for ids in got] == want, limit


def test_short_words_are_not_looked_up_one_by_one():
    class Counted(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

    vocabulary = bpe_replay.Ranks(RANKS)
    vocabulary.pairs = Counted(vocabulary.pairs)
    draw = random.Random(4)
    words = list({bytes(draw.choices(b"abcd", k=9)) for _ in range(2000)})
    assert len(bpe_replay.replay(words, vocabulary)) == len(words)
    assert vocabulary.pairs.n < 10


def test_a_word_is_replayed_once_for_all_marks_behind_it(monkeypatch):
    replayed = []
    replay = bpe_replay.replay
    monkeypatch.setattr(bpe_replay, "replay", lambda words, vocabulary: replayed.extend(words) or replay(words, vocabulary))
    encoder = bpe_replay.Encoder(RANKS, PATTERN, bpe_replay.SEGMENTS)
    for mark in ",.;:!?)":
        encoder.encode([f"x abcdab{mark} bé{mark}", f"12{mark}"])
    assert replayed.count(b" abcdab") == replayed.count(" bé".encode()) == replayed.count(b"12") == 1


def test_no_match_reaches_across_segments():
    draw, split, cut = random.Random(5), regex.compile(PATTERN).findall, re.compile(bpe_replay.SEGMENTS).findall
    pools = ["abAZ09'sStTreveMmllDd", " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u3000", "!\"#&'()*+,-./:;@[\\]_`{|}~", "éÀÿ×÷ªº²½µ", "\u0301…’“—", "жя日한一Ⅻ٣", "😀\u200d\ufeff\x00"]
    for _ in range(5000):
        text = "".join(draw.choice(draw.choice(pools)) for _ in range(draw.randrange(1, 40)))
        assert "".join(cut(text)) == text
        assert [word for piece in cut(text) for word in split(piece)] == split(text), text
