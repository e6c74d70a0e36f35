"""Random access to the written token files, without copies."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from clausewell.llm import token_files
from clausewell.llm.common import Scratch

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_rows_are_slices_of_the_mapped_file(spark):
    docs = spark.createDataFrame([(k, " ".join(f"word{k} and{j}" for j in range(k * 37 % 500))) for k in range(200)], "doc_id bigint, text string")
    files = token_files.write_files(docs, Scratch(spark, "t"), WORD, keep_blanks=False, end_id=2, length=64, files=3).orderBy("part").collect()
    library = Tokenizer.from_file(WORD)
    whole = [i for r in docs.orderBy("doc_id").collect() for i in [*library.encode(r.text, add_special_tokens=False).ids, 2]]
    at = 0
    assert len(files) == 3
    for f in files:
        with pa.memory_map(f.path.removeprefix("file://") + ".arrow") as source:
            reader = token_files.FileReader(source)
            used = pa.total_allocated_bytes()
            n_rows = sum(reader.file.get_batch(k).num_rows for k in range(reader.file.num_record_batches))
            assert n_rows == -(-f.n_tokens // 64) and reader.held() == f.n_tokens
            for r in np.random.default_rng(1).permutation(n_rows).tolist():
                ids, mask = reader.row(r)
                assert ids.type == pa.uint16() and len(ids) == len(mask) == 64
                assert source.size() > 0 and pa.total_allocated_bytes() == used
                size = mask.true_count
                assert size == min(64, f.n_tokens - 64 * r) and mask[:size].true_count == size
                assert ids.to_numpy()[:size].tolist() == whole[at + 64 * r : at + 64 * r + size]
            assert np.concatenate(list(reader.ids(70, 100))).tolist() == whole[at + 70 : at + 170]
            del reader, ids, mask
        at += f.n_tokens
    assert at == len(whole)
