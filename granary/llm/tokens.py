"""Token ids inside tasks, with a bounded memory of the words met before.

The vocabulary drops white space and never merges across it, so a text's ids are those of its words in a row. Letters
and marks at a word's end are separate tokens too, and case doesn't count. So a word not met before is looked up
without the marks at its end, and words of letters are encoded many at a time: each ends at its only word-end token.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

#: Words that a worker keeps, and words met later that it keeps until there are so many.
WORDS, LATER = 500_000, 100_000
#: Marks that may be split off at a word's end.
MARKS = b".,;:!?|#$%&*"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """ids(text) as little-endian unsigned 16-bit integers; ends: by id, whether the token closes a sentence."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        size = self.model.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 ids needs wider integers")
        self.known: dict[bytes, bytes] = {}
        self.later: list[bytes] = []
        self.ends, self.closing = np.zeros(size, bool), np.zeros(size, bool)
        for token, number in self.model.get_vocab().items():
            self.ends[number] = token.removesuffix("</w>").endswith((".", "!", "?"))
            self.closing[number] = token.endswith("</w>")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def learn(self, words: list[bytes]) -> None:
        known, split, letters, others = self.known, [], {}, []
        for word in words:
            base = word.rstrip(MARKS)
            if not base.decode().isalpha():
                others.append(word)
                continue
            if len(base) < len(word):
                split.append((word, base, word[len(base) :]))
                if (marks := word[len(base) :]) not in known:
                    known[marks] = self.encode(marks.decode()).tobytes()
            if base not in known:
                letters[base] = None
        bases = list(letters)
        for at in range(0, len(bases), 512):
            part = bases[at : at + 512]
            ids = self.encode(b" ".join(part).decode())
            cuts = (np.flatnonzero(self.closing[ids]) + 1).tolist()
            if len(cuts) != len(part):  # letters that the vocabulary's rules don't take for letters
                others += part
                continue
            for base, a, b in zip(part, [0, *cuts], cuts, strict=False):
                known[base] = ids[a:b].tobytes()
        for word in others:
            known[word] = self.encode(word.decode()).tobytes()
        for word, base, marks in split:
            known[word] = known[base] + known[marks]
        if len(known) > WORDS:
            self.later += [*words, *bases]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes; a null text has none."""
        out, known = [], self.known
        for at in range(0, len(texts), 64):
            split = [t.encode().lower().split() if t else [] for t in texts[at : at + 64]]
            found = [list(map(known.get, words)) for words in split]
            new = {w for words, ids in zip(split, found, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
            if new:
                if len(self.later) > LATER:
                    for word in self.later:
                        known.pop(word, None)
                    self.later = []
                self.learn(list(new))
                for words, ids in zip(split, found, strict=True):
                    if None in ids:
                        for i, x in enumerate(ids):
                            if x is None:
                                ids[i] = known[words[i]]
            out += map(b"".join, found)
        return out


@cache
def word_tokens(path: str) -> WordTokens:
    """One for each worker process."""
    return WordTokens(path)
