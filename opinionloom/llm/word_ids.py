"""Ids of many texts by a lower-casing tokenizer with word ends, each distinct word tokenized once."""

from __future__ import annotations

import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Words a worker remembers across slices; it forgets all of them when there are more.
REMEMBERED = 250_000
WORDS_PER_TEXT = 256
WORD_END = "</w>"
#: A word of plain letters and the signs behind it are tokenized one by one.
_WORD = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[.,;:!?]*)$"


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + count]`` side by side."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordIds:
    """Right for lower-casing tokenizers whose pre-tokenizer drops white space and parts letters from signs, so that no
    token or special token crosses these places, and whose last token of a word is marked as such."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()
        probes = ("ab cd", "ab\ncd\t ef", "a's <|x|> b", " ab  c ", "École, ab?! Cd.", "x;y z...", "")
        whole = [e.ids for e in self.tokenizer.encode_batch(list(probes), add_special_tokens=False)]
        if [i.tolist() for i in self.ids(pa.array(probes))] != whole:
            raise ValueError(f"{file} doesn't tokenize words one by one")

    def _forget(self) -> None:
        self.codes: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.counts = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(counts.sum())), counts

    def _remember(self, names: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.codes.update(zip(names, range(len(self.starts), len(self.starts) + len(names)), strict=True))
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.used += len(ids)

    def _codes_of(self, names: list[str], words: bool) -> np.ndarray:
        """Codes of distinct names; plain words are tokenized many at a time and told apart by their ends."""
        new = [n for n in names if n not in self.codes]
        if words:
            ids, _ = self._encode([" ".join(new[at : at + WORDS_PER_TEXT]) for at in range(0, len(new), WORDS_PER_TEXT)])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(new):
                raise ValueError("the tokenizer doesn't close every word")
            self._remember(new, ids, np.diff(last, prepend=-1))
        else:
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                self._remember(part, *self._encode(part))
        return np.fromiter(map(self.codes.__getitem__, names), np.int64, len(names))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without special tokens added; a null text has none."""
        if len(self.codes) > REMEMBERED:
            self._forget()
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary
        parted = pc.extract_regex(names, _WORD)
        plain = pc.is_valid(parted).to_numpy(zero_copy_only=False)
        # two parts a name: the word and its signs, or the whole name and nothing
        parts = np.zeros((len(names), 2), np.int64)
        for column, (field, lower) in enumerate((("word", True), ("signs", False))):
            values = pc.struct_field(parted, field).filter(pa.array(plain))
            own = (pc.utf8_lower(values) if lower else values).dictionary_encode()
            codes = self._codes_of(own.dictionary.to_pylist(), words=lower)
            parts[plain, column] = codes[own.indices.to_numpy(zero_copy_only=False)]
        rest = names.filter(pa.array(~plain)).to_pylist()
        parts[~plain, 0] = self._codes_of(rest, words=False)
        own = gather(self.flat, self.starts[parts.ravel()], self.counts[parts.ravel()])
        sizes = self.counts[parts].sum(1)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[codes]
        ids = gather(own, (np.cumsum(sizes) - sizes)[codes], counts)
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        bounds = np.concatenate(([0], np.cumsum(counts)))[offsets].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@cache
def word_ids(file: str) -> WordIds:
    return WordIds(file)
