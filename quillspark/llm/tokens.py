"""Token ids by the tokenizers library, with a bounded memory of space-separated chunks.

Both vocabularies here split a text into pieces before merging, and no piece spans a
cut before a single space that a non-space character follows. So a text's ids are its
chunks' ids in order, and a chunk that comes again needs no second encoding. Strings of special
tokens are found by the library before that split, so a text that holds one goes to the
library as it is, and its ids are the library's.
"""

from __future__ import annotations

import re

import numpy as np

#: Chunks remembered at most, and the longest chunk that is remembered.
MEMORY, LONGEST = 1_000_000, 64
_loaded: dict[tuple[str, bool], "Encoder"] = {}
_ODD, _SPACE = re.compile(r" (?:\s|\Z)"), re.compile(r"\s")
_MARKS = frozenset(",.;:!?")


class Encoder:
    """``encode``: texts to little-endian unsigned 32-bit ids, as the library gives them.

    keep_space: a space belongs to the piece after it (else white space is dropped).
    """

    def __init__(self, path: str, keep_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library tells apart, and how they begin.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.begins = {t[:1] for t in self.added} | {t[:1].upper() for t in self.added}
        self.space = " " if keep_space else ""
        self._marks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # by chunk, without the space before it
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes that an id stands for
        for t, i in vocabulary.items():
            self.width[i] = len(t.removesuffix("</w>"))

    def chunks(self, text: str) -> list[str]:
        """The first chunk, and those after a space."""
        if not self.space:
            text = text.replace("\n", " ")
            # lower-casing twice is lower-casing once, but for letters that depend on their neighbours
            return (text if "\u03a3" in text or "\u0130" in text else text.lower()).split(" ")
        parts = text.split(" ")
        if not _ODD.search(text):
            return parts
        out, now = [], parts[0]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(now)
                now = p
            else:
                now += " " + p
        out.append(now)
        return out

    def special(self, text: str) -> bool:
        """Whether a special token's string may be in ``text``."""
        if not any(x in text for x in self.begins):
            return False
        low = text.lower()  # chunks are lower-cased, and might become such strings
        return any(t in low for t in self.added)

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _many(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks encoded as one text, told apart by the bytes that each id stands for."""
        joined = " ".join(chunks)
        ids = np.array(self.tokenizer.encode_batch_fast([self.space + joined], add_special_tokens=False)[0].ids, "<u4")
        raw = np.frombuffer((joined if self.space else self.tokenizer.normalizer.normalize_str(joined)).encode(), np.uint8)
        ends = np.append(np.flatnonzero(raw == 0x20), len(raw))
        ends += 1 if self.space else -np.arange(len(ends))
        upto = np.cumsum(self.width[ids])
        at = np.searchsorted(upto, ends) + 1
        if len(ends) != len(chunks) or not len(ids) or upto[-1] != ends[-1] or (upto[at - 1] != ends).any():
            return self._each([self.space + c for c in chunks])
        b, at = ids.tobytes(), (4 * at).tolist()
        return [b[x:y] for x, y in zip([0, *at], at)]

    def _learn(self, new: set[str]) -> None:
        known = self.known
        # a letters-only chunk and one mark after it are two pieces
        cut = [c for c in new if c[-1:] in _MARKS and c[:-1].isalpha()]
        new = new.difference(cut).union([c[:-1] for c in cut]).difference(known)
        odd = [c for c in new if not c or len(c) > LONGEST or " " in c]
        if not self.space and _SPACE.search("".join(new)):
            odd = list({*odd, *(c for c in new if _SPACE.search(c))})
        known.update(zip(odd, self._each([self.space + c if c else c for c in odd])))
        rest = list(new.difference(odd))
        for i in range(0, len(rest), 4000):
            known.update(zip(rest[i : i + 4000], self._many(rest[i : i + 4000])))
        known.update([(c, known[c[:-1]] + self._mark(c[-1])) for c in cut])

    def _mark(self, c: str) -> bytes:
        if c not in self._marks:
            self._marks[c] = self._each([c])[0]
        return self._marks[c]

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [k for k, t in enumerate(texts) if self.special(t)]
        if odd:
            whole = dict(zip(odd, self._each([texts[k] for k in odd])))
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in whole]))
            return [whole[k] if k in whole else next(rest) for k in range(len(texts))]
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        cut = [self.chunks(t) for t in texts]
        heads = self._each([c.pop(0) for c in cut]) if self.space else [b""] * len(cut)
        new: set[str] = set()
        for c in cut:
            new.update(c)
        new = new.difference(known)  # looks each of the new up, not each of the known
        if new:
            self._learn(new)
        get = known.__getitem__
        out = [h + b"".join(map(get, c)) for h, c in zip(heads, cut)]
        for c in [c for c in new if len(c) > LONGEST]:
            del known[c]
        return out


def encoder(path: str, keep_space: bool) -> Encoder:
    """One encoder a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, keep_space) not in _loaded:
        _loaded[path, keep_space] = Encoder(path, keep_space)
    return _loaded[path, keep_space]


def groups(rows, size: int = 2 << 20):
    """(ids, texts) of about ``size`` characters from pairs; bounds what is encoded at once."""
    ids, texts, n = [], [], 0
    for i, t in rows:
        ids.append(i)
        texts.append(t or "")
        n += len(texts[-1])
        if n >= size:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts
