"""Token ids of whole texts by a public vocabulary file, with the ids of words that came before kept at hand."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .blobs import ranges
from .common import kept_for

#: Texts of these characters alone are cut into words here: their composed form is themselves, lower case goes letter
#: by letter, and what is a letter, digit, mark or space is beyond doubt. Any other text goes to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")
_WORD = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\w\s]|_)+")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _ByteLetters(dict):
    """What stands for each letter in a byte-level vocabulary, worked out when it is first met.

    A byte stands for the character of its number if that prints; the others, in order, are U+0100 and what follows.
    Lower case may lie far from its capital (U+018F becomes U+0259), so that any letter can be asked for.
    """

    def __init__(self):
        super().__init__()
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.letter = [chr(b if b in prints else next(others)) for b in range(256)]

    def __missing__(self, code: int) -> str:
        out = self[code] = "".join(self.letter[b] for b in chr(code).encode())
        return out


_BYTES = _ByteLetters()


class WordTokens(dict):
    """Numbers of words (what stands between spaces), whose ids lie one after another in an array.

    All is forgotten beyond ``limit`` words. Texts are lower-cased and new words cut into pieces here, as the
    vocabulary file says, and the file's model gives each piece's ids.
    """

    def __init__(self, path: str, limit: int = 500_000):
        import tokenizers

        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.limit = limit
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self):
        self.clear()
        self.fresh: list[str] = []
        self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0

    def __missing__(self, word):
        self.fresh.append(word)
        at = self[word] = len(self)
        return at

    def _learn(self):
        tokenize, sizes, ids = self.model.tokenize, [], []
        for word in self.fresh:
            before = len(ids)
            for piece in _WORD.findall(word):
                ids += [t.id for t in tokenize(piece if piece.isascii() else piece.translate(_BYTES))]
            sizes.append(len(ids) - before)
        self.fresh = []
        ids, sizes = np.array(ids, np.uint16), np.array(sizes, np.int32)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin = np.concatenate([self.begin, (self.used + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer gives them without special tokens added."""
        if len(self) > self.limit:
            self._forget()
        plain = [_PLAIN.fullmatch(x) is not None and not any(s in x for s in _SPECIAL) for x in texts]
        words = pc.ascii_split_whitespace(pa.array([x.lower() if p else "" for x, p in zip(texts, plain, strict=True)], pa.large_string()))
        counts = pc.list_value_length(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        of = np.fromiter(map(self.__getitem__, coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        if self.fresh:
            self._learn()
        at = of[coded.indices.to_numpy()]
        sizes = self.size[at]
        ids = self.flat[ranges(self.begin[at], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        out = np.split(ids, ends[:-1]) if len(ends) else []
        for i, p in enumerate(plain):
            if not p:
                out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint16)
        return out


def word_tokens(path: str) -> WordTokens:
    """One for each vocabulary file and process, so that a worker's later tasks find the words of earlier ones."""
    kept = kept_for("tokens")
    if path not in kept:
        kept[path] = WordTokens(path)
    return kept[path]
