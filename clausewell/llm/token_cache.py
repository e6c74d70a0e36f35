"""Batch encoding with the tokenizers library, one call per distinct blank-delimited chunk.

Byte-pair merges never cross the pre-tokenizer's pieces, and neither vocabulary's pieces cross a boundary before a
blank-delimited chunk, so a text's ids are the joined ids of its chunks. Words repeat, so a bounded cache of encoded
chunks saves most of the merging work. ``tests/llm`` holds this against whole-text encoding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The code points with the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A chunk with its one leading space, or blanks as a byte-level pre-tokenizer groups them.
SPACED = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Chunks alone, for pre-tokenizers that drop blanks.
BARE = re.compile(f"[^{WHITE}]+")
#: Blanks other than space and line feed, and those that only Python calls blank.
RARE = [chr(c) for c in (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
PYTHON_BLANK = [chr(c) for c in range(0x1C, 0x20)]


#: Texts that are cut by the patterns above: those whose blanks are more than single spaces and line feeds between words,
#: and, where blanks are dropped, also those with combining marks, which may join a small letter but not its capital.
NOT_PLAIN = {True: r"\A | \z|  |\n\n| \n|\n |[" + "".join(RARE) + "]", False: "[\u0300-\u036f" + "".join(RARE + PYTHON_BLANK) + "]"}


#: Words that pre-tokenizers of the kinds below leave whole, and marks behind them, which become one piece: letters of every
#: Unicode version that normalizers at most make small, and no apostrophe, which may cut.
WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)").fullmatch
#: By ``keep_blanks``: the normalizer and the pre-tokenizer, as the library writes them, for which that holds.
_BYTES = '{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":%s}'
_CUT = r"""{"type":"Split","pattern":{"Regex":"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},"behavior":"Removed","invert":true}"""
_SMALL = r"""{"type":"Sequence","normalizers":[{"type":"NFC"},{"type":"Replace","pattern":{"Regex":"\\s+"},"content":" "},{"type":"Lowercase"}]}"""
WHOLE_WORDS = {True: ("", _BYTES % "true"), False: (_SMALL, '{"type":"Sequence","pretokenizers":[' + _CUT + "," + _BYTES % "false" + "]}")}
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = "".join(chr(b) if b in _PRINTED else chr(256 + sum(x not in _PRINTED for x in range(b))) for b in range(256))


class Codes(dict):
    """chunk -> code; a chunk that is not known gets the next code and waits in ``fresh`` to be encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        self.fresh.append(chunk)
        return code


class Store:
    """The ids of coded chunks, one after the other; arrays grow by doubling."""

    def __init__(self, kind):
        self.used = 0
        self.starts, self.lengths, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, kind)

    def add(self, at: int, flat: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the chunks from code ``at`` on."""
        end = at + len(lengths)
        while len(self.lengths) < end:
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[at:end] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at:end] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``codes``, joined, and where each one's begin and end."""
        lengths = self.lengths[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.arange(ends[-1]) + np.repeat(self.starts[codes] - ends[:-1], lengths)], ends


class ChunkEncoder:
    """Encode whole texts to id arrays. ``split`` cuts a text into chunks; ``encode_fresh`` gives the ids of distinct
    chunks as one flat array and their lengths, for each of ``forms`` ways to encode. Beyond ``most`` chunks the cache
    keeps half as many, those that most runs used, and forgets the rest; a use counts half after each time."""

    def __init__(self, split, encode_fresh, wide: bool, end_id: int | None = None, most: int = 200_000, forms: int = 1):
        self.split, self.encode_fresh, self.end, self.most = split, encode_fresh, end_id, most
        self.kind = np.uint32 if wide else np.uint16
        self.codes, self.stores, self.uses = Codes(), [Store(self.kind) for _ in range(forms)], np.zeros(1 << 12, np.int32)
        if end_id is not None:  # the end of a document is a chunk with code 0
            self.codes[None] = 0
            for store in self.stores:
                store.add(0, np.array([end_id]), np.ones(1, np.int64))

    def _room(self) -> None:
        if len(self.codes) > self.most:
            n, first = len(self.codes), int(self.end is not None)
            order = np.argsort(-self.uses[first:n], kind="stable")[: self.most // 2] + first
            kept = np.concatenate([np.arange(first), np.sort(order)])
            names = list(self.codes)
            self.codes = Codes()
            self.codes.update((names[k], code) for code, k in enumerate(kept.tolist()))
            self.uses = self.uses[kept] >> 1
            for k, old in enumerate(self.stores):
                self.stores[k] = Store(self.kind)
                self.stores[k].add(0, old.of(kept)[0], old.lengths[kept])

    def _learn(self) -> None:
        """Encode the waiting chunks."""
        fresh, self.codes.fresh = self.codes.fresh, []
        for store, found in zip(self.stores, self.encode_fresh(fresh), strict=True):
            store.add(len(self.codes) - len(fresh), *found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One id array per text, with the end id appended when there is one."""
        return self.encode_forms(texts)[0]

    def encode_forms(self, texts: list[str]) -> list[list[np.ndarray]]:
        """As ``encode``, for each way to encode; texts are cut once for all."""
        self._room()
        code = self.codes.__getitem__
        rows = [np.array(list(map(code, self.split(t))), np.int64) for t in texts]
        return self._join(np.concatenate(rows), np.cumsum([len(r) for r in rows])) if rows else [[] for _ in self.stores]

    def _join(self, codes: np.ndarray, until: np.ndarray) -> list[list[np.ndarray]]:
        """The id arrays of texts whose chunks follow one another in ``codes``, each up to its place in ``until``."""
        if self.codes.fresh:
            self._learn()
        n = len(self.codes)
        while len(self.uses) < n:
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.uses[:n] += np.bincount(codes, minlength=n) > 0
        if self.end is not None:
            codes, until = np.insert(codes, until, 0), until + np.arange(1, len(until) + 1)
        out = []
        for store in self.stores:
            flat, ends = store.of(codes)
            out.append(np.split(flat.astype(np.uint32), ends[until[:-1]]))
        return out


class TokenizerEncoder(ChunkEncoder):
    """Chunks encoded by the tokenizers library; ``keep_blanks`` says whether blanks are part of the tokens, and
    ``special_as_text`` whether special tokens that a text quotes are plain text or, as the library has it by default,
    tokens."""

    def __init__(self, path: str, keep_blanks: bool, end_id: int | None, special_as_text: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.keep_blanks, self.tokenizer = keep_blanks, Tokenizer.from_file(path)
        self.cutter = Tokenizer.from_file(path) if special_as_text else self.tokenizer
        self.tokenizer.encode_special_tokens = special_as_text
        self.mark, self.mark_id = next((t.content, k) for k, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not t.normalized)
        self.lowers = not keep_blanks and self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        self.pattern, split = NOT_PLAIN[keep_blanks], (SPACED if keep_blanks else BARE).findall
        if not special_as_text:  # a special token cuts a text before blanks do
            marks = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
            cut, words = re.compile("(" + "|".join(sorted(marks, key=len, reverse=True)) + ")").split, split
            split = lambda t: words(t) if "<|" not in t else [x for k, part in enumerate(cut(t)) for x in ([part] if k % 2 else words(part))]
            self.pattern += r"|<\|"
        shape = tuple(x.__getstate__().decode() if x else "" for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        self.merged = self.tokenizer.model.tokenize if shape == WHOLE_WORDS[keep_blanks] and type(self.tokenizer.model).__name__ == "BPE" else None
        self.marks: dict[str, list[int]] = {"": []}
        super().__init__(split, self._encode if self.merged is None else self._encode_words, self.tokenizer.get_vocab_size() > 1 << 16, end_id)

    def _encode_words(self, fresh: list[str], step: int = 4096) -> list[tuple[np.ndarray, np.ndarray]]:
        """Plain words and the marks behind them go to the model at once, which takes less time than the library's whole way
        and gives the same ids; the other chunks take that way."""
        flats, lengths, rest = [np.zeros(0, np.int64)], np.zeros(len(fresh), np.int64), []
        for at in range(0, len(fresh), step):
            ids: list[int] = []
            for k, x in enumerate(fresh[at : at + step], at):
                if not (found := WORD(x)):
                    rest.append(k)
                    continue
                word, marks = found.groups()
                word = word if self.keep_blanks else word.lower()
                word = word.replace(" ", BYTE_CHARS[32]) if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)
                before = len(ids)
                ids += [t.id for t in self.merged(word)]
                if marks not in self.marks and len(self.marks) < 1000:
                    self.marks[marks] = [t.id for t in self.merged(marks)]
                ids += self.marks[marks] if marks in self.marks else [t.id for t in self.merged(marks)]
                lengths[k] = len(ids) - before
            flats.append(np.array(ids, np.int64))
        flat = np.concatenate(flats)
        if not rest:
            return [(flat, lengths)]
        others, sizes = self._encode([fresh[k] for k in rest])[0]
        is_word = np.ones(len(fresh), bool)
        is_word[rest], lengths[rest] = False, sizes
        of_word, out = np.repeat(is_word, lengths), np.zeros(lengths.sum(), np.int64)
        out[of_word], out[~of_word] = flat, others
        return [(out, lengths)]

    def _encode(self, fresh: list[str], joined: int = 64, step: int = 32) -> list[tuple[np.ndarray, np.ndarray]]:
        """``joined`` chunks become one input, each closed by a special token that cuts it off; a chunk that could hold
        a special token is encoded on its own. ``step`` inputs are encoded at a time, since result objects are large."""
        odd = [k for k, x in enumerate(fresh) if "<|" in x]
        even = [x for x in fresh if "<|" not in x] if odd else fresh
        inputs = [self.mark.join(even[at : at + joined]) + self.mark for at in range(0, len(even), joined)]
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(inputs), step):
            found.extend(np.array(e.ids, np.int64) for e in self.cutter.encode_batch_fast(inputs[at : at + step], add_special_tokens=False))
        flat = np.concatenate(found)
        ends = np.flatnonzero(flat == self.mark_id)
        lengths, flat = np.diff(ends, prepend=-1) - 1, flat[flat != self.mark_id]
        if not odd:
            return [(flat, lengths)]
        parts = np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([fresh[k] for k in odd], add_special_tokens=False), strict=True):
            parts.insert(k, np.array(e.ids, np.int64))
        return [(np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)))]

    def each(self, texts: pa.Array, most_bytes: int = 1_000_000) -> Iterator[np.ndarray]:
        """The id array of every text in turn; texts are encoded in runs of about ``most_bytes``, or one at a time."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right")))
            run = texts.slice(at, end - at)
            odd = pc.match_substring_regex(run, self.pattern).to_numpy(zero_copy_only=False)
            plain, rest = iter(self._plain(run.filter(pa.array(~odd)))), iter(self.encode(run.filter(pa.array(odd)).to_pylist()))
            yield from (next(rest if o else plain) for o in odd.tolist())
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # these would keep what a run held, some 100 MB in all
                pool.release_unused()
            at = end

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        """As ``encode``, for texts of words between single spaces and line feeds: Arrow finds a run's distinct words."""
        if not len(texts):
            return []
        self._room()
        texts = pc.ascii_lower(texts) if self.lowers else texts
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n " if self.keep_blanks else " "), " ")
        words = lists.flatten().dictionary_encode()
        at, known, offsets = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_numpy()
        code, table = self.codes.__getitem__, np.zeros(len(known), np.int64)
        if not self.keep_blanks:
            table[:] = list(map(code, known))
            return self._join(table[at], offsets[1:].astype(np.int64))[0]
        bare = at == (known.index("\n") if "\n" in known else -1)
        bare[1:] |= bare[:-1].copy()  # line feeds and what follows them have no space before
        bare[offsets[:-1]] = True
        spaced, alone = (np.flatnonzero(np.bincount(at[m], minlength=len(known))) for m in (~bare, bare))
        table[spaced] = [code(" " + known[k]) for k in spaced]
        codes = table[at]
        table[alone] = [code(known[k]) for k in alone]
        codes[bare] = table[at[bare]]
        return self._join(codes, offsets[1:].astype(np.int64))[0]


_ENCODERS: dict[tuple, TokenizerEncoder] = {}


def encoder(path: str, keep_blanks: bool, end_id: int | None) -> TokenizerEncoder:
    """One encoder per Python worker, whose cache serves all its tasks; its ids are the library's by default."""
    key = (path, keep_blanks, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = TokenizerEncoder(*key, special_as_text=False)
    return _ENCODERS[key]
