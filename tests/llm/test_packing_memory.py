"""What a worker remembers of pre-tokens stays small."""

from inkstone.llm import packing
from inkstone.llm.queries import tokenizer


def test_remembered_words_are_bounded():
    encoder = packing.Encoder(tokenizer("word_bpe_49k.json"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(letters[n // 26**k % 26] for k in range(4))
    texts = [" ".join(word(n) for n in range(at, at + 5000)).encode() for at in range(0, 250_000, 5000)]
    found = encoder(texts)
    arrays = (encoder.hashes, encoder.number, *(g.values for g in (encoder.words, encoder.at, encoder.length, encoder.flat, encoder.place, encoder.size)))
    assert encoder.at.n <= 200_000 and sum(a.nbytes for a in arrays) < 20 << 20
    for k in (0, 25, 49):
        assert found[k].tolist() == encoder.whole(texts[k]).tolist()
