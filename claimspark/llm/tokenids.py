"""Token ids of whole texts by the tokenizers library, with every word encoded once.

A text is cut where no token can reach across, and the ids of the pieces are kept in a dictionary. Most pieces are
a run of letters with marks behind; letters and marks are separate for the tokenizers in use, so a new
piece needs the ids of its letters alone, and these come from the library's merge step without
its normaliser and splitter. Everything else goes through the whole tokenizer. Tests compare with it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np

CACHE_WORDS = 300_000  # of each of two generations, together about 130 MB in a Python worker
MAX_MARKS = 10_000
MAX_KEPT = 64  # longer pieces are encoded but not kept
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch  # composed letters only: no normalisation changes them
MARKS = ".,;:!?$%&*#()/=+-"  # behind letters they make tokens of their own
# A cut before a space or line end is safe if the character before it or behind it is visible.
UNSAFE_CUT = re.compile(r"\s[ \n](?:\s|\Z)")
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]
SAFE_CUT = re.compile(r"(?= \S)")  # a space before a visible character always begins a token
CHUNK = 1 << 18  # characters worked on at once

_encoders: dict[tuple, Callable[[str], bytes]] = {}  # of this worker process, which serves many tasks


def _byte_marks() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def chunks(text: str) -> Iterator[str]:
    """The text in parts of about ``CHUNK`` characters, cut where a token begins in any case."""
    at = 0
    while at < len(text):
        cut = SAFE_CUT.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class WordIds:
    """Ids of pieces as little-endian 32-bit bytes, kept in a dictionary.

    When the dictionary is full it becomes the older one, from which pieces in use come back. ``spaced`` pieces
    follow a space that belongs to their first token, but for those that begin with a line end.
    """

    def __init__(self, full, bare, cache_words: int, lower: bool, spaced: bool):
        self.full, self.bare = full, bare
        self.cache_words, self.lower, self.space = cache_words, lower, " " if spaced else ""
        marks = _byte_marks()
        self.head = marks[32] if spaced else ""
        self.table = str.maketrans({chr(c): "".join(marks[b] for b in chr(c).encode()) for c in range(128, 256)})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = {"": b"", "\n": self.whole(["\n"])[0]}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(got.ids, dtype="<u4").tobytes() for got in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, cores: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(cores), 500):
            part = [core[1:] if core[0] == "\n" else self.head + core for core in cores[at:at + 500]]
            part = [core if core.isascii() else core.translate(self.table) for core in part]
            got = self.bare.encode(part, is_pretokenized=True, add_special_tokens=False)
            data = np.array(got.ids, dtype="<u4").tobytes()
            edges = (4 * np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(len(part) + 1))).tolist()
            out += [data[a:b] for a, b in zip(edges, edges[1:])]
        return out

    def ids_of(self, split: list[list[str]]) -> list[bytes]:
        """The ids of the pieces of each list, one after another."""
        found = [list(map(self.known.get, words)) for words in split]
        gaps = [[i for i, ids in enumerate(got) if ids is None] for got in found]
        missing = {words[i] for words, at in zip(split, gaps) for i in at}
        if missing:
            if len(self.known) > self.cache_words:
                self.known, self.older = {}, self.known
            extra = self.add(missing)
            known = self.known
            for words, got, at in zip(split, found, gaps):
                for i in at:
                    ids = known.get(words[i])
                    got[i] = extra[words[i]] if ids is None else ids
        return list(map(b"".join, found))

    def add(self, missing: set[str]) -> dict[str, bytes]:
        """Fill the dictionary; the ids of pieces too long for it are returned."""
        known, older, lower = self.known, self.older, self.lower
        back = [w for w in missing if w in older]
        if back:
            known.update(zip(back, map(older.__getitem__, back)))
            missing.difference_update(back)
        split, other, fresh = [], [], set()
        for word in missing:
            body = word[1:] if word[:1] == "\n" else word
            core = body.rstrip(MARKS)
            if len(word) > MAX_KEPT or not (core.isascii() and core.isalpha() or LATIN(core)):
                other.append(word)
                continue
            mark = body[len(core):]
            if lower:
                core = core.lower()
            if body is not word:
                core = "\n" + core
            if core not in known:
                if core in older:
                    known[core] = older[core]
                else:
                    fresh.add(core)
            if core != word:
                split.append((word, core, mark))
        fresh = list(fresh)
        line_end = self.marks["\n"]
        for core, ids in zip(fresh, self.letters(fresh)):
            known[core] = line_end + ids if core[0] == "\n" else ids
        marks = self.marks
        for word, core, mark in split:
            if mark not in marks:
                if len(marks) > MAX_MARKS:
                    del marks[next(reversed(marks))]
                marks[mark] = self.whole([mark])[0]
            known[word] = known[core] + marks[mark]
        extra = {}
        for word, ids in zip(other, self.whole([w if w[:1] == "\n" else self.space + w for w in other]) if other else ()):
            (known if len(word) <= MAX_KEPT else extra)[word] = ids
        return extra


def text_encoder(path: str, cache_words: int = CACHE_WORDS) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian 32-bit bytes.

    For byte-pair tokenizers whose splitter keeps letters and marks apart and either drops white space
    or takes one space into the token behind it. A worker process keeps the dictionary from task to task.
    """
    if (path, cache_words) in _encoders:
        return _encoders[path, cache_words]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    keeps_space = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
    lower = "Lowercase" in json.dumps(spec.get("normalizer"))
    full, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([])
    first = WordIds(full, bare, cache_words // 10 if keeps_space else cache_words, lower, False)
    behind = WordIds(full, bare, cache_words, lower, True) if keeps_space else None

    def encode_words(texts: list[str]) -> list[bytes]:
        return first.ids_of([text.replace("\n", " ").split(" ") for text in texts])

    def spaced(text: str) -> list[str] | None:
        """The pieces, or None if the text has white space whose tokens depend on what stands beside it."""
        if text[-1:].isspace() or any(s in text for s in ("  ", " \n", "\n\n", "\n ", *OTHER_SPACE)):
            if UNSAFE_CUT.search(text):
                return None
        return text.replace("\n", " \n").split(" ")

    def encode_spaced(texts: list[str]) -> list[bytes]:
        split = [spaced(text) for text in texts]
        heads, tails = first.ids_of([words[:1] for words in split if words]), behind.ids_of([words[1:] for words in split if words])
        plain = map(bytes.__add__, heads, tails)
        return [next(plain) if words else first.whole([text])[0] for text, words in zip(texts, split)]

    part = encode_spaced if keeps_space else encode_words

    def encode(texts: list[str]) -> list[bytes]:
        out, group, size = [], [], 0
        for text in texts:
            if size + len(text) > CHUNK and group:
                out += part(group)
                group, size = [], 0
            if len(text) > CHUNK:
                out.append(b"".join(part([c])[0] for c in chunks(text)))
            else:
                group.append(text)
                size += len(text)
        return out + part(group) if group else out

    _encoders[path, cache_words] = encode
    return encode
