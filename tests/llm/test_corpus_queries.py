import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer
from twins import SMALL, check

from clausewell.llm.queries import ORACLES, QUERIES
from clausewell.llm.token_cache import TokenizerEncoder

#: Texts whose blanks, marks, capitals or special tokens could be cut wrongly.
ODD = [
    "", None, " ", "a", "\n", "a\nb", "\na b", "a b\n", "a  b", " a", "a ", "a \n b", "a\n\nb c", "x\ty", "\r\nA B", " \n", "\n\n", "<|endoftext|> <|startoftext|>b",
    "|> <| b<|", "<", "x<\n<|endoftext|>", "J\u030c H\u0331 \u1e9e \u0130 I\u030a", "\u00e1 \u0338b\n\u0338c", "a\x1cb c\x1f", "a\u3000b", "It's DON'T  '  s", "\u00e9 z \x85 q"]


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(name, texts, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return {k: [*tokenizer.encode(t, add_special_tokens=False).ids, end] for k, t in texts.items()}


@pytest.mark.parametrize("name, keep_blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_ids_of_whole_texts(name, keep_blanks, docs):
    coder = TokenizerEncoder(public_tokenizers.path(name), keep_blanks, 1)
    for texts in (ODD, ODD[5:] + ODD, list(docs.values())):
        want = encoded(name, {k: t or "" for k, t in enumerate(texts)}, 1)
        assert [x.tolist() for x in coder.each(pa.array(texts, pa.string()), most_bytes=50_000)] == list(want.values())
    coder.most = 400  # the cache forgets many times
    assert [x.tolist() for x in coder.each(pa.array(texts, pa.string()), most_bytes=5_000)] == list(want.values())


def slow_sets(texts):
    out = {}
    for k, text in texts.items():
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        out[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}
    return out


def slow_components(texts):
    sets, root, inverted = slow_sets(texts), {}, {}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in sorted(sets):
        root[k] = k
        common = Counter(o for gram in sets[k] for o in inverted.get(gram, ()))
        for other, n in common.items():
            if 100 * n >= 80 * (len(sets[k]) + len(sets[other]) - n):
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
        for gram in sets[k]:
            inverted.setdefault(gram, []).append(k)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


def test_quality_on_held_out_rows(spark):
    scored = QUERIES["op1_quality_qda"](spark, SMALL)
    both = scored.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    held = [r for r in both if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in both)
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in both)


def test_packing_holds_every_id_once(spark, docs):
    ids, found = encoded("byte_bpe_50k.json", docs, 1), QUERIES["op3_sum_of_squares_packing"](spark, SMALL).collect()
    starts, places = {}, {}
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(part), crc(part), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        starts.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in [*starts.values(), *places.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
    assert all(sum(x for _, x in starts[k]) == len(ids[k]) for k in docs)
    assert all(sum(x for _, x in p) <= 2048 for p in places.values())
    assert len(places) * 2048 <= 1.1 * sum(map(len, ids.values())) + 8 * 2048


def test_token_files_read_back(spark, docs):
    at, found = 0, {r.doc_id: r for r in QUERIES["op6_arrow_token_files"](spark, SMALL).collect()}
    for k, ids in sorted(encoded("word_bpe_49k.json", docs, 2).items()):
        assert (found[k].start, found[k].n_tokens, found[k].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert found.keys() == docs.keys()


def test_sentencepiece_round_trip(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in QUERIES["op9_sentencepiece_viterbi"](spark, SMALL).collect():
        assert r.round_trip
        assert r.merged_crc32 == crc(model.encode(docs[r.doc_id]))


def test_ngram_components(spark, docs):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_ngram_trie_join"](spark, SMALL).collect()}
    assert found == slow_components(docs)


def test_secret_findings_are_candidates(spark, docs):
    for r in QUERIES["op8_secret_forest"](spark, SMALL).collect():
        assert re.fullmatch(r"[A-Za-z0-9_+/=\-]{16,}", docs[r.doc_id][r.start : r.start + r.length])
