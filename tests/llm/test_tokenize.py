import base64
import random

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from undaflow.llm.tokenize import PATTERN, Codec, Counter, Utf8Stream

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["the", " ", "  ", "\n", "'s", "é", "üß", "漢字", "123", "!!", "\t", "\x1c", "\x85", "a" * 300, "ab" * 90, "<|endoftext|>", "🙂", "́", "von", "'LL", "--", "　", "0" * 70]


def texts(n=400, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", "x" * 3000, "€" * 700, " " * 500 + "a"]


def test_pattern_is_the_published_one():
    assert PATTERN == P.PATTERN


def test_encode_equals_library_and_round_trips():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = Codec(RANKS)
    for t in texts():
        ids = codec.encode(t)
        assert ids == lib.encode_ordinary(t), repr(t)
        assert "".join(codec.decode(ids, step=1)) == t


def test_count_equals_library_at_every_chunk_size():
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for chunk in (7, 64, 1 << 16):
        c = Counter(P.path("byte_bpe_50k.json"), special=("<|endoftext|>",), chunk=chunk)
        for t in texts(150):
            assert c.count(t) == len(lib.encode(t, add_special_tokens=False).ids), (chunk, t)


def test_stream_waits_for_whole_characters():
    s = Utf8Stream()
    assert [s.feed(bytes([b])) for b in "a€".encode()] == ["a", "", "", "€"]
    assert s.feed(b"\xf0\x9f") == "" and s.close() == "�"


def test_stream_equals_the_codec_on_any_bytes():
    """Also on bytes that are no UTF-8, cut anywhere."""
    import codecs

    r = random.Random(9)
    pieces = [b"a", "é".encode(), "漢".encode(), "🙂".encode(), b"\xff", b"\xc0", b"\xe0\x80", b"\xed\xa0", b"\xf4\x90", b"\x80", b"\xf0\x9f"]
    for _ in range(500):
        data = b"".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        s, c, out, want, at = Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace"), "", "", 0
        while at < len(data):
            n = r.randint(1, 3)
            out += s.feed(data[at : at + n])
            want += c.decode(data[at : at + n])
            at += n
        assert out + s.close() == want + c.decode(b"", True) == data.decode("utf-8", "replace")
