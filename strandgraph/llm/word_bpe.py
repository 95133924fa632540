"""Encoding whole texts with a tokenizers file that drops white space between words.

The vocabulary's pre-tokenizer never joins characters across a space, so a text's ids are the
ids of its space-separated words in order. A worker therefore asks the library once per new
word and remembers the answer. A word of letters followed by punctuation is two pre-tokens,
so its letters and its punctuation are remembered apart; the library sees letters in bulk,
many words in one text, and the end-of-word pieces tell the words apart again. Remembered words
are keys of 64 bits, some 20 bytes a word, so that all a worker has met fit in memory.
"""

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memo import Memo, gather

_ENCODERS: dict[str, "WordEncoder"] = {}
_TAIL = ".,;:!?"
_SLICE_BYTES = 8 << 20


class WordEncoder(Memo):
    """Ids of texts from the ids of their words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("ids do not fit 16 bits")
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        super().__init__(np.dtype(np.uint16))

    def _mixed(self, words: list[str]) -> tuple[list, list]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [x for ids in found for x in ids], [len(ids) for ids in found]

    def _letters(self, words: list[str]) -> tuple[list, list]:
        """Ids of words of letters, all in one library call."""
        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self._mixed(words)  # a letter whose lower case holds a mark
        return ids, np.diff(stops, prepend=0).tolist()

    def fresh(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        letters = pc.utf8_is_alpha(strings).to_numpy(zero_copy_only=False)
        order = np.argsort(~letters, kind="stable")
        texts = strings.take(pa.array(order)).to_numpy(zero_copy_only=False).tolist()
        ids, sizes, border = [], [], int(letters.sum())
        for first, last, encode in ((0, border, self._letters), (border, len(texts), self._mixed)):
            for i in range(first, last, 512):
                found, lengths = encode(texts[i : min(i + 512, last)])
                ids.append(np.array(found, dtype=np.uint16))
                sizes.append(np.array(lengths, dtype=np.int64))
        sizes, back = np.concatenate(sizes), np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return gather(np.concatenate(ids), (np.cumsum(sizes) - sizes)[back], sizes[back]), sizes[back]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other and their counts."""
        core = pc.utf8_rtrim(words, _TAIL)
        # whole, if its lower case is two characters or NFC, which the library applies first, takes it apart
        letters = pc.and_not(pc.utf8_is_alpha(core), pc.match_substring(core, "\u0130"))
        letters = pc.and_(letters, pc.equal(pc.utf8_normalize(core, "NFC"), core))
        tails = pc.struct_field(pc.extract_regex(words, f"(?P<tail>[{_TAIL}]*)$"), 0)
        tails = pc.if_else(letters, tails, "").dictionary_encode()
        cores = pc.if_else(letters, pc.utf8_lower(core), words).dictionary_encode()
        both = pa.concat_arrays([cores.dictionary, tails.dictionary]).dictionary_encode()
        entry = self.entries(both.dictionary)
        entry = entry[both.indices.to_numpy()]
        pairs = np.stack([entry[cores.indices.to_numpy()], entry[len(cores.dictionary) + tails.indices.to_numpy()]], axis=1)
        sizes = self.sizes[pairs]
        return gather(self.flat, self.starts[pairs].ravel(), sizes.ravel()), sizes.sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text starts (and the last ends).
        A null text is empty."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        del lists
        index, (ids, sizes) = coded.indices.to_numpy(), self._words(coded.dictionary)
        starts, lengths = (np.cumsum(sizes) - sizes)[index], sizes[index]
        stops = np.concatenate([[0], np.cumsum(lengths)])[bounds - bounds[0]]
        return gather(ids, starts, lengths), stops


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about `most` bytes of text, so that long texts do not pile up in memory."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
