import hashlib

import public_tokenizers

from graphloom.llm import bpe


def test_the_digest_is_of_decoded_ids():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        t = bpe.WordTokenizer(f.read())
    text = "Some words, and  some more; naïve words " + "x" * 3000
    ids = t.ids(text)
    n, _, digest = t.digest(t.parts(text))
    assert n == len(ids)
    assert digest == hashlib.sha256(t.decode(ids).encode()).hexdigest()
    # A fault in decoding an id shows, though the text has been encoded before.
    t.strings[ids[0]] = t.named[t.numbers[ids[0]]] = "fault"
    faulty = t.digest(t.parts(text))[2]
    assert faulty != digest and faulty == hashlib.sha256(t.decode(ids).encode()).hexdigest()
