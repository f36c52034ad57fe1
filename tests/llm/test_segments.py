"""Joined ids of segments are those of the whole text."""

from array import array

import public_tokenizers
import pytest

from logweave.llm.library_tokens import LibraryTokens, read_vocabulary

TEXTS = ["", " ", "\n", "\n\n", " x", "tail ", "tail\n", "a  b\n\nc", "a \nb", "a\n b", "a\t b", "a\t\nb", "x\n\ty", "\r\nab\r\ncd",
         "It's 's\n's don't", "one, two; three... four?! (five), six.", "One,\nTwo.\nthree", "1 2\n3 4.5,6", ",, . a",
         "<|endoftext|> x<|endoftext|>\n<|endoftext|>.", "　 日本 語\n日", "a​b ​c", "\xe9 \xc9, ő\xe9.\n\xf1",
         "\x85 a\x85b", " \xad a\xad", "a\x00b \x00c", "a\x1c b\nc\x1d d", "word " * 500 + "x" * 3000]


@pytest.mark.parametrize("kind, name", [("bytes", "byte_bpe_50k.json"), ("words", "word_bpe_49k.json")])
def test_segments_equal_whole_texts(kind, name):
    own = LibraryTokens(read_vocabulary(public_tokenizers.path(name)), kind)
    want = [array("I", e.ids).tobytes() for e in own.tok.encode_batch(TEXTS, add_special_tokens=False)]
    data = [t.encode() for t in TEXTS]
    assert own.encode(data) == want
    assert own.encode(data) == want  # from the cache
    own.seen.limit = own.runs.limit = 3  # generations turn at every text
    assert [own.encode([t])[0] for t in data] == want
