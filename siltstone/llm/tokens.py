"""Exact, fast encoding with the tokenizers library.

A text whose characters all lie in a set where Python's classes agree with the tokenizer's is cut at white space, where
pre-tokens end whatever stands around, and a bounded memory maps its words to ids; a word that is new is encoded by the
library, many of them as one text. Where spaces are kept and a space stands beside other white space, the text is cut into
pre-tokens by a compiled pattern instead, with a memory of its own. Merges never cross pre-tokens, so the ids equal the
library's for the whole text. Any other text, and any that contains a special token's string, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from siltstone.llm.common import CACHES

#: Characters on which str classes and the tokenizers' Unicode classes agree: no other numerals, separators or marks.
_ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ňŊ-žЀ-џ‐-‧€]")
_BYTE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORD = re.compile(r"'(?:[sdmt]|ll|ve|re)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
MEMORY = 700_000  #: words and pre-tokens kept per worker
SIGNS = ".,;:!?)"  #: each a pre-token of its own after a letter or numeral at a word's end
LONG = 64  #: characters beyond which a word is not kept
FEW = 50  #: new words below which each is encoded on its own
RUN = 500  #: new words encoded as one text
TOGETHER = 1 << 18  #: characters at which a group of texts that are looked up together ends
#: Where one of these stands, a space may belong to a run of white space.
_RUNS = ("  ", "\n ", " \n", "\t", "\x0b", "\x0c", "\r", "\x85", "\xa0")


def _has_runs(t: str) -> bool:
    a, b, c, d, e, f, g, h, i = _RUNS  # one after another: a generator costs more than the searches
    return a in t or b in t or c in t or d in t or e in t or f in t or g in t or h in t or i in t


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes whole texts to packed unsigned 32-bit ids (native order, little-endian on all supported hosts)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = "Lowercase" in repr(self.tokenizer.normalizer)
        self.pattern = _WORD if self.lower else _BYTE
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        #: Ids that end a word, or, where spaces are kept, that start with one (which the vocabulary writes as U+0120).
        vocab = self.tokenizer.get_vocab()
        self.marks = np.zeros(max(vocab.values()) + 1, bool)
        self.marks[[i for t, i in vocab.items() if (t.endswith("</w>") if self.lower else t.startswith("\u0120"))]] = True
        self.memory: dict[str, bytes] = {}  #: pre-token -> ids
        self.words: dict[str, bytes] = {}  #: word -> ids; where spaces are kept, of the word after a space
        self.signs = dict(zip(SIGNS, self._one_by_one(list(SIGNS))))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bool:
        return not _ODD.search(text) and not (self.special and self.special.search(text))

    def pieces(self, text: str) -> list[bytes]:
        """Packed ids of each pre-token of a plain text."""
        return self._look_up([self.pattern.findall(text.lower() if self.lower else text)], self.memory, self._pre_tokens)[0]

    def _look_up(self, found: list[list[str]], memory: dict[str, bytes], learn) -> list[list[bytes]]:
        """The ids of each word of each list; learn(words) gives those of words that memory lacks, which keeps the short ones."""
        out = [list(map(memory.get, words)) for words in found]
        gaps = [(words, ids, [i for i, x in enumerate(ids) if x is None]) for words, ids in zip(found, out) if None in ids]
        if gaps:
            fresh = learn(list({words[i] for words, _, at in gaps for i in at}))
            for words, ids, at in gaps:
                for i in at:
                    ids[i] = fresh[words[i]]
            if len(memory) + len(fresh) > MEMORY:
                memory.clear()
            memory.update(fresh if max(map(len, fresh)) <= LONG else {w: ids for w, ids in fresh.items() if len(w) <= LONG})
        return out

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_tokens(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            out.update(zip(part, self._one_by_one(part)))
        return out

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words. Those that hold a line break are put together from what stands before it and the pre-tokens
        from it on; those that end in a sign after a letter or numeral, from their stem and the sign."""
        known, stems, broken = self.words, {}, {}
        if not self.lower:  # elsewhere words hold no white space
            broken = {w: w.index("\n") for w in words if "\n" in w}
            words = [*(w for w in words if w not in broken), *{w[:at] for w, at in broken.items()}]
        rest = set()
        for w in words:
            if w[-1:] in self.signs and w[-2:-1].isalnum():
                stems[w] = w[:-1]
                rest.add(w[:-1])
            else:
                rest.add(w)
        rest = [w for w in rest if w not in known]
        out = self._encoded_words(rest) if rest else {}
        of = lambda w: known[w] if (ids := out.get(w)) is None else ids
        out.update([(w, of(stem) + self.signs[w[-1]]) for w, stem in stems.items()])
        if broken:
            tails = self._look_up([self.pattern.findall(w[at:]) for w, at in broken.items()], self.memory, self._pre_tokens)
            out.update([(w, of(w[:at]) + b"".join(tail)) for (w, at), tail in zip(broken.items(), tails)])
        return out

    def _encoded_words(self, words: list[str]) -> dict[str, bytes]:
        """Many are encoded as one text, with spaces between, and its ids are cut at those that the vocabulary marks as the
        end (or the start) of a word; a word that holds several pre-tokens has as many ends."""
        before = "" if self.lower else " "
        if len(words) < FEW:
            return dict(zip(words, self._one_by_one([before + w for w in words])))
        out: dict[str, bytes] = {}
        parts, alone = [words[at : at + RUN] for at in range(0, len(words), RUN)], []
        for at in range(0, len(parts), 8):
            group = parts[at : at + 8]
            for part, e in zip(group, self.tokenizer.encode_batch_fast([before + " ".join(part) for part in group], add_special_tokens=False)):
                ids = np.array(e.ids, dtype=np.uint32)
                marked = np.flatnonzero(self.marks[ids])
                ends = np.cumsum([1 if w.isalpha() else len(self.pattern.findall(w)) for w in part]) if self.lower else np.arange(1, len(part) + 1)
                if len(marked) != ends[-1]:
                    alone += part
                    continue
                cuts = [0, *(marked[ends - 1] + 1).tolist()] if self.lower else [*marked.tolist(), len(ids)]
                raw = ids.tobytes()
                out.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, cuts, cuts[1:]))
        for at in range(0, len(alone), 20_000):
            part = alone[at : at + 20_000]
            out.update(zip(part, self._one_by_one([before + w for w in part])))
        return out

    def encode_all(self, texts):
        """Packed ids of each text, in order; short texts are looked up together."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= TOGETHER:
                yield from self.encode_group(group)
                group, size = [], 0
        yield from self.encode_group(group)

    def encode_group(self, group: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(group)
        by_word, by_piece = [], []
        for k, t in enumerate(group):
            if not self.plain(t):
                out[k] = self.whole(t)
            elif self.lower or not (t[-1:].isspace() or _has_runs(t)):
                by_word.append(k)
            elif t:
                by_piece.append(k)
        if self.lower:
            for k, ids in zip(by_word, self._look_up([group[k].lower().split() for k in by_word], self.words, self._new_words)):
                out[k] = b"".join(ids)
        else:
            cut = [group[k].split(" ") for k in by_word]
            first = self._look_up([self.pattern.findall(words[0]) for words in cut], self.memory, self._pre_tokens)
            for k, head, ids in zip(by_word, first, self._look_up([words[1:] for words in cut], self.words, self._new_words)):
                out[k] = b"".join(head) + b"".join(ids)
            for k, ids in zip(by_piece, self._look_up([self.pattern.findall(group[k]) for k in by_piece], self.memory, self._pre_tokens)):
                out[k] = b"".join(ids)
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return self.encode_group([text])[0]


_OPEN: dict[str, Encoder] = {}
CACHES.append(_OPEN)  # with their vocabularies and memories; opening one anew takes some 0.1 s


def encoder(path: str) -> Encoder:
    """One per worker process and path."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def file_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
