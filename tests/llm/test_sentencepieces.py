"""Best paths against a plain search over all paths, and long texts without blanks."""

import random
import re
import time

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from twins import SMALL

from clausewell.llm import sentencepieces
from clausewell.llm.queries import QUERIES
from test_corpus_queries import crc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces(model):
    n = model.vocab_size()
    kept = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): (model.get_score(i), i) for i in kept}


def bounds(pieces, known={}):  # noqa: B006
    if not known:
        known["both"] = max(map(len, pieces)), min(s for s, _ in pieces.values()) - 10
    return known["both"]


def slow_best(model, pieces, text):
    """The best score of any path, and the ids of the path that ends in the longest pieces among equals."""
    if not text:
        return 0.0, []
    marked, (longest, floor) = "▁" + text.replace(" ", "▁"), bounds(pieces)
    best = [(0.0, [])]
    for end in range(1, len(marked) + 1):
        score, ids = best[end - 1]
        top = (score + floor, [*ids, *(model.piece_to_id(f"<0x{b:02X}>") for b in marked[end - 1].encode())])
        for size in range(min(end, longest), 0, -1):
            if hit := pieces.get(marked[end - size : end]):
                score, ids = best[end - size]
                if score + hit[0] > top[0]:
                    top = (score + hit[0], [*ids, hit[1]])
        best.append(top)
    return best[-1]


def test_best_paths_against_all_paths(spark, model, pieces):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    scores = {i: s for s, i in pieces.values()}
    coder = sentencepieces.piece_encoder(PATH, sentencepieces.viterbi)
    words = sorted({w for t in sorted(set(texts.values()), key=len)[:120] for w in re.split(" +", t) if w})
    assert len(words) > 1000
    best = {w: slow_best(model, pieces, w) for w in words}
    for w, found in zip(words, coder.encode(words), strict=True):
        total, path = best[w]
        assert found.tolist() == path
        if all(i in scores for i in path):
            assert sum(scores[i] for i in path) == total
    # the query's ids of a whole text are those of its chunks
    short = {k: t for k, t in texts.items() if len(t) < 4000 and "  " not in t and t.strip(" ") == t and t}
    rows = {r.doc_id: r for r in QUERIES["op9_sentencepiece_viterbi"](spark, SMALL).collect()}
    for k in list(short)[:25]:
        whole = [i for w in short[k].split(" ") for i in (best.get(w) or slow_best(model, pieces, w))[1]]
        assert (rows[k].n_pieces, rows[k].ids_crc32) == (len(whole), crc(whole))


def test_long_chunks_are_walked_as_short_ones_are_batched(model, pieces, monkeypatch):
    rng = random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABCab01+/=", "aeiou", "中文字符日本語", "é😀ab", "thein"]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 2, 40, 300, 500)] + ["the" * 150, "internationalisation" * 20]
    for method in (sentencepieces.viterbi, sentencepieces.merges):
        batched = [x.tolist() for x in sentencepieces.PieceEncoder(PATH, method).encode(texts)]
        monkeypatch.setattr(sentencepieces, "LONG", 1)
        walked = [x.tolist() for x in sentencepieces.PieceEncoder(PATH, method).encode(texts)]
        monkeypatch.undo()
        assert walked == batched
        if method is sentencepieces.merges:
            assert walked == [model.encode(t) for t in texts]
        else:
            assert walked == [slow_best(model, pieces, t)[1] for t in texts]


def test_a_megabyte_without_blanks(spark, model):
    rng = random.Random(3)
    rows = [(1, "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))), (2, "".join(rng.choice("中文字符日本語漢学生") for _ in range(300_000)))]
    began = time.time()
    found = {r.doc_id: r for r in sentencepieces.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH).collect()}
    assert time.time() - began < 120
    for k, text in rows:
        assert found[k].round_trip and found[k].merged_crc32 == crc(model.encode(text))


def test_methods_share_one_lattice_a_chunk(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(200).collect()] + [None, "", "é😀 ab", "x" * 700]
    seen, lattice = [], sentencepieces.PieceTable.lattice
    monkeypatch.setattr(sentencepieces.PieceTable, "lattice", lambda self, chunks: seen.extend(chunks) or lattice(self, chunks))
    monkeypatch.setattr(sentencepieces, "_ENCODERS", {})
    run, held = [], pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    docs = type("Docs", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, f, _: run.extend(f(iter([held])))})()
    sentencepieces.encode_documents(docs, PATH, with_ids=True)
    assert len(seen) == len(set(seen)) > 1000
    rows = pa.Table.from_batches(run).to_pylist()
    for method, name in ((sentencepieces.viterbi, "ids_crc32"), (sentencepieces.merges, "merged_crc32")):
        alone = sentencepieces.PieceEncoder(PATH, method).encode([t or "" for t in texts])
        assert [r[name] for r in rows] == [crc(x) for x in alone]
