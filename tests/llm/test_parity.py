"""op4 compares every chunk with sentencepiece and decodes its ids."""

import os
import subprocess
import sys
import zlib
from pathlib import Path

from tokenizers import decoders

from loomwork.llm import spm


class Other:
    """The sentencepiece library, wrong about one word."""

    def __init__(self, real, word):
        self.real, self.word = real, word

    def encode(self, texts, **options):
        return [[*x, 0] if t == self.word else x for t, x in zip(texts, self.real.encode(texts, **options), strict=True)]


def codec():
    with open(spm.MODEL, "rb") as f:
        return spm.Codec(f.read(), spm.PARITY)


def test_every_chunk_is_compared():
    words = [f"word{k}" for k in range(40)]
    assert any(zlib.crc32(f" {w}".encode()) % 8 for w in words)
    for word in words:
        found = codec_of_word(word)
        assert [same for _, _, same in found] == [False, True], word


def codec_of_word(word, shared=[]):
    if not shared:
        shared.append(codec())
        shared.append(shared[0].other)
    shared[0].forget()
    shared[0].other = Other(shared[1], word)
    return list(shared[0].encode([f"a text with {word} in it", "and one without"]))


def test_ids_are_decoded():
    c = codec()
    texts = ["Two  spaces, ünïcode \U0001f600 and \n lines ", "", " lead"]
    assert all(exact for _, exact, _ in c.encode(texts))
    whole = c.decode([ids.tolist() for ids, _, _ in c.encode(texts)])
    assert whole == texts
    c.forget()
    c.pieces.decoder = decoders.Sequence([decoders.Fuse()])
    assert not all(exact for _, exact, _ in c.encode(texts))


def test_chunks_that_come_again_are_known():
    """Of 200,000 words that come twice each is encoded once."""
    with open(spm.MODEL, "rb") as f:
        c = spm.Codec(f.read(), 0)
    learned, one = [], c._learned
    c._learned = lambda chunks: learned.append(len(chunks)) or one(chunks)
    texts = [" ".join(f"w{i}" for i in range(at, at + 1000)) for at in range(0, 200_000, 1000)]
    first = [ids for ids, _, _ in c.encode(texts)]
    assert all((a == b).all() for a, b in zip(first, (ids for ids, _, _ in c.encode(texts)), strict=True))
    assert sum(learned) == 200_000 and max(learned) <= spm.LEARN


def test_a_worker_encodes_in_its_own_thread():
    """The library's threads would each keep memory in every worker that lives on."""
    text = """
import os
from loomwork.llm import spm
codec = spm._codec(open(spm.MODEL, "rb").read(), 0)
before = len(os.listdir("/proc/self/task"))
list(codec.encode([" ".join(f"w{i}" for i in range(20_000))]))
assert len(os.listdir("/proc/self/task")) == before
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    assert subprocess.run([sys.executable, "-c", text], cwd=Path(spm.__file__).parents[2], env=env).returncode == 0
