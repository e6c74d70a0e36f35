"""What the cache of encoded chunks keeps, and what a worker holds after many distinct words."""

import random
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clausewell.llm.token_cache import ChunkEncoder, TokenizerEncoder


def test_words_in_use_outlive_words_seen_once():
    encoded = []

    def fresh(chunks):
        encoded.extend(chunks)
        return [(np.array([len(x) for x in chunks]), np.ones(len(chunks), np.int64))]

    coder = ChunkEncoder(str.split, fresh, False, 7, most=100)
    coder.encode([" ".join(f"early{k}" for k in range(60))])
    for run in range(40):
        found = coder.encode([f"often other{run} " * 2, " ".join(f"once{run}-{k}" for k in range(30)), ""])
        assert [x.tolist() for x in found] == [[5, 5 + len(str(run))] * 2 + [7], [len(f"once{run}-{k}") for k in range(30)] + [7], [7]]
    assert encoded.count("often") == 1  # it came when the first quarter was full
    assert len(coder.codes) <= 100 + 62


HELD = """
import re, sys
import pyarrow as pa, public_tokenizers
from clausewell.llm.token_cache import encoder

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

coder, start = encoder(public_tokenizers.path("byte_bpe_50k.json"), True, 1), held()
for run in range(20):
    for ids in coder.each(pa.array([" ".join(f"w{run * 40000 + k:x}" for k in range(j, j + 1000)) for j in range(0, 40000, 1000)])):
        pass
print(held() - start)
"""


def test_a_worker_holds_little_after_many_distinct_words():
    found = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert float(found.stdout) < 90


@pytest.mark.parametrize("name, keep_blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_plain_words_go_to_the_model_at_once(name, keep_blanks):
    """Their ids, and those of chunks between them, are the library's; none but the other chunks takes its whole way."""
    path, draw = public_tokenizers.path(name), random.Random(3)
    coder, library = TokenizerEncoder(path, keep_blanks, None, special_as_text=False), Tokenizer.from_file(path)
    letters = "abcdefghijklmnopqrstuvwxyzQZÀÉÖØßéøÿþÐ"
    words = ["".join(draw.choices(letters, k=draw.randint(1, 14))) + "".join(draw.choices(".,;:!?", k=draw.choice((0, 0, 1, 2, 5)))) for _ in range(3000)]
    odd = ["don't", "it's.", "x86", "(word)", "ǅ", "İstanbul", "ﬁne", "é", "naïve—", "«été»", "漢字", "a_b", "<|endoftext|>", "9.", "...", "ı", "œuvre", "×", "a÷b"]
    taken, cutter = [], coder.cutter
    coder.cutter = SimpleNamespace(encode_batch_fast=lambda x, **how: taken.extend(x) or cutter.encode_batch_fast(x, **how))
    for x in (words, odd, [y for pair in zip(words, odd * 200, strict=False) for y in pair]):
        text = " ".join(x)
        assert coder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert {y.strip() for x in taken for y in x.split(coder.mark)} <= {*odd, ""}
